"""Secret scan with multipart credential linking.

Strong patterns (assignments, access keys, long hex runs) count alone. Weak candidates (identifiers, opaque tokens,
short assigned values, endpoints) count only where complementary parts stand in one scope: the parts of a document are
intervals, widened by ``reach`` code points, and an interval join by a sweep over sorted starts with running maxima of
ends links access identifiers, secrets and endpoints. The join is within a document, so it needs no shuffle, costs
O(n log n) in the document's parts, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm import common as C

#: Kinds in the order in which spans with one start are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: A maximal run of 18 or more equals a run that is cut at 18; so does one of 16 hex digits.
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Weak candidates. Identifiers by assignment; opaque tokens have digits and both cases; endpoints are URLs and hosts with ports.
#: None of them starts inside a run of its own characters, so each takes time in proportion to the text.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{3,})", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![\w.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}:[0-9]{2,5}(?![0-9])", re.A)


def parts(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, role) of all candidates; role: access, secret or endpoint. Weak ones don't overlap strong ones."""
    found, weak = [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append((m.start(), m.end(), "assign", "secret"))
            elif len(m[2]) >= 6:
                weak.append((m.start(), m.end(), "weak_secret", "secret"))
        weak += [(m.start(), m.end(), "weak_access", "access") for m in IDENTIFIER.finditer(text)]
        weak += [(m.start(), m.end(), "endpoint", "endpoint") for m in ENDPOINT.finditer(text)]
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            found.append((m.start(), m.end(), "access", "access"))
        elif m.end() - m.start() >= 8:
            weak.append((m.start(), m.end(), "weak_access", "access"))
    found += [(m.start(), m.end(), "hex", "secret") for m in HEX.finditer(text)]
    if found or weak:  # a bare token can only count beside another part
        weak += [(m.start(), m.end(), "weak_secret", "secret") for m in OPAQUE.finditer(text) if m[0] != m[0].lower() and m[0] != m[0].upper()]
    if weak and found:
        strong = sorted(found)
        starts, ends = [p[0] for p in strong], [*accumulate((p[1] for p in strong), max)]
        weak = [p for p in weak if not (i := bisect_right(starts, p[1] - 1)) or ends[i - 1] <= p[0]]
    return sorted({*found, *weak}, key=lambda p: (p[0], KINDS.index(p[2]), p[1]))


def link(found: list[tuple[int, int, str, str]], reach: int) -> list[dict]:
    """The spans to report, by start: strong ones, and weak ones with a complementary part within reach code points."""
    by_role = {}
    for role in ("access", "secret", "endpoint"):
        mine = [p for p in found if p[3] == role]
        by_role[role] = ([p[0] for p in mine], [*accumulate((p[1] for p in mine), max)])

    def near(p, role: str) -> bool:  # some part of the role starts before p's scope ends and ends after it begins
        starts, ends = by_role[role]
        i = bisect_right(starts, p[1] + reach)
        return i > 0 and ends[i - 1] >= p[0] - reach

    need = {"access": ("secret",), "secret": ("access", "endpoint"), "endpoint": ("secret",)}
    out = []
    for p in found:
        linked = any(near(p, role) for role in need[p[3]])
        if linked or p[2] in KINDS[:3]:
            out.append({"kind": p[2], "start": p[0], "end": p[1], "linked": linked})
    return out


def scan_secrets(docs: DataFrame, reach: int = 160, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in whole texts.

    Returns per row of docs: id_col, spans (array<struct<kind,start,end,linked>> by start, then kind; code points, end
    exclusive; linked: a complementary part stands within ``reach``).

    Defined cases: null or empty text has no spans; equal rows each have their own; a null or repeated id is carried
    through; an empty table gives an empty table; other columns aren't read.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("spans array<struct<kind:string,start:long,end:long,linked:boolean>>").fields])
    arrow_id, arrow_spans = to_arrow_type(id_type), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("linked", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, text_col, 4 << 20):
            spans = [link(p, reach) if t and (p := parts(t)) else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_id), pa.array(spans, arrow_spans)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets over the whole of documents; counts and a digest of the strong spans, and all spans as a string."""
    found = scan_secrets(C.documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
