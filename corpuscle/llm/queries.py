"""The queries of this subpackage by name, and the same in DuckDB's SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.decontaminate import op6_simhash_windows
from corpuscle.llm.edit_fingerprint import op3_edit_fingerprint
from corpuscle.llm.exact_top_k import op12_exact_top_k
from corpuscle.llm.jaccard_join import op9_jaccard_join
from corpuscle.llm.language_id import op1_language_id
from corpuscle.llm.licenses import op10_license_votes
from corpuscle.llm.line_dedup import op5_line_dedup
from corpuscle.llm.pattern_packing import op7_pattern_packing
from corpuscle.llm.secrets import op2_secret_links
from corpuscle.llm.substring_dedup import op4_substring_dedup
from corpuscle.llm.token_shards import op8_token_shards
from corpuscle.llm.vector_codes import op11_vector_codes
from corpuscle.llm.whitening import op13_whitening


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, a script beside the package: it isn't part of what ``--py-files`` ships."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _codes_sql(rounds: int = 6) -> str:
    """Product codes of embeddings: each round is a pair of tables, all distances and the floors of the means."""
    kept = "embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0"
    out = f"""
        with recursive kept as materialized (select vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::double)::bigint) as xs from embeddings where {kept}),
        e as materialized (select vec_id, (i // (w // 8)) as part, (i % (w // 8)) as place, x from (select vec_id, len(xs) as w, unnest(range(len(xs))) as i, unnest(xs) as x from kept)),
        b0 as materialized (select part, entry, place, x from e join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept) using (vec_id) where entry < 16)"""
    for r in range(rounds + 1):
        out += f""",
        a{r} as materialized (select vec_id, part, entry, d from (select e.vec_id, e.part, b.entry, sum((e.x - b.x) * (e.x - b.x)) as d from e join b{r} b using (part, place) group by all)
          qualify row_number() over (partition by vec_id, part order by d, entry) = 1)"""
        if r < rounds:
            out += f""",
        s{r} as materialized (select part, entry, place, sum(x) as s, count(*) as n from e join a{r} using (vec_id, part) group by all),
        b{r + 1} as materialized (select part, entry, place, case when n is null then x else (s - ((s % n + n) % n)) // n end::bigint as x from b{r} left join s{r} using (part, entry, place))"""
    return out + f""",
        c as (select vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by vec_id)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
          (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) from b{rounds}) as codebooks_sha256
        from c join kept using (vec_id)
    """


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_links": op2_secret_links,
    "op3_edit_fingerprint": op3_edit_fingerprint,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_windows": op6_simhash_windows,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_token_shards": op8_token_shards,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_license_votes": op10_license_votes,
    "op11_vector_codes": op11_vector_codes,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

ORACLES = {
    "op11_vector_codes": _codes_sql(),
    "op12_exact_top_k": """
        with kept as materialized (select vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)) as x from embeddings
                      where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        s as (select q.vec_id as query_id, k.vec_id, list_dot_product(q.x, k.x)::bigint as score from kept q join kept k on q.vec_id % 100 = 0 and q.vec_id <> k.vec_id)
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 10
    """,
    "op4_substring_dedup": r"""
        with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
        s as (select doc_id, words, i, list_slice(words, i, i + 34) as win from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w)),
        r as (select doc_id, i from (select doc_id, i, count(*) over (partition by win) as n from s) where n > 1),
        g as (select distinct doc_id, unnest(range(i, i + 35)) as p from r),
        t as (select doc_id, list(p) as gone from g group by doc_id)
        select w.doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
          sha256(coalesce(array_to_string(case when gone is null then words else list_filter(words, lambda x, i: not list_contains(gone, i)) end, ' '), '')) as kept_sha256
        from w left join t using (doc_id)
    """,
    "op5_line_dedup": r"""
        with l as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
                   from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents)),
        c as (select k from l where k <> '' group by k having count(distinct doc_id) >= 10),
        m as (select l.*, c.k is not null as gone from l left join c using (k))
        select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
          sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from m group by doc_id
    """,
    "op6_simhash_windows": r"""
        with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        iw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
        ds as (select doc_id, len(w) as n, p, array_to_string(list_slice(w, p + 1, p + 5), ' ') as s from (select *, unnest(range(0, len(w) - 4)) as p from dw)),
        ish as (select item_id, len(w) as n, p, array_to_string(list_slice(w, p + 1, p + 5), ' ') as s from (select *, unnest(range(0, len(w) - 4)) as p from iw)),
        hits as (select distinct ds.doc_id, ds.p, ds.n, i.item_id, i.n as m from ds join (select distinct item_id, n, s from ish) i using (s)),
        -- every window that shares a shingle with the item
        win as (select distinct doc_id, item_id, m, n, unnest(range(greatest(p - (least(n, m) - 5), 0), least(p, greatest(n - m, 0)) + 1)) as a from hits),
        ww as (select w.doc_id, w.item_id, w.m, w.n, w.a, d.s, count(*) as c from win w join ds d on d.doc_id = w.doc_id and d.p between w.a and w.a + w.m - 5 group by all),
        ic as (select item_id, s, count(*) as c from ish group by all),
        j as (select w.doc_id, w.item_id, w.a, w.m, sum(w.c) as z, sum(least(w.c, coalesce(i.c, 0))) as b from ww w left join ic i on i.item_id = w.item_id and i.s = w.s group by all),
        k as (select *, b / (z + m - 4 - b) as sim from j)
        select doc_id, item_id, a::bigint as start_word, least(m, z + 4)::bigint as n_words, round(sim, 9)::double as similarity from k where sim >= 0.8
        qualify row_number() over (partition by doc_id, item_id order by sim desc, a) = 1
    """,
}
