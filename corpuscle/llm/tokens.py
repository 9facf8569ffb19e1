"""Token ids of whole texts by a public tokenizer, word by word with a bounded memory of words."""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: The parts whose ids a worker remembers at most.
REMEMBERED = 500_000
_SPLIT = re.compile(r"[ \n]+")
#: What a part is in a lower-cased Latin-1 text: the tokenizer's own pattern, with its classes written out for Latin-1.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r {_LETTERS}{_NUMBERS}]+")
#: Parts that are cut so, and are one part wherever they stand.
_WHOLE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[!-/:-@\\[-`{{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]+")
#: Characters that one of the two engines might take for white space and the other not.
_ODD = re.compile("[\x1c-\x1f\x85\xa0]")


class WordTokens:
    """Ids of texts for a tokenizer that drops white space and whose tokens end in </w> at the end of each part.

    A text is cut into parts; the ids of its parts, one after the other, are the ids of the whole (tests hold this
    against the tokenizer). Parts recur, so most cost a look-up. Latin-1 texts, for which composing is nothing and
    lower-casing goes letter by letter, are cut as the tokenizer cuts them, so new parts can be encoded many at once;
    other texts are cut at spaces and line ends only. encode() gives little-endian 32-bit ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    
    def cut(self, text: str) -> list[str]:
        """Parts of a text, each of which is known to encode() by its ids."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _SPLIT.split(text)
        if _ODD.search(text) or "<|" in text:  # special tokens aren't cut
            return _SPLIT.split(text)
        return _PARTS.findall(text.lower())

    def learn(self, parts: list[list[str]]) -> None:
        """Know the ids of all these parts, at most REMEMBERED; if there are too many in all, only of these."""
        new = {p for some in parts for p in some if p not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {"": b""}
            new = {p for some in parts for p in some if p}
        whole = [p for p in new if _WHOLE.fullmatch(p)]
        for lo in range(0, len(whole), 2048):  # many in one text: each part's ids end with an end
            some = whole[lo : lo + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                continue
            data, at = ids.tobytes(), 0
            for part, end in zip(some, (4 * ends).tolist(), strict=True):
                self.known[part] = data[at:end]
                at = end
        rest = [p for p in new if p not in self.known]
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[part] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.cut(t or "") for t in texts]
        if sum(map(len, split)) > REMEMBERED:  # never more new parts at once than are remembered
            return [x for t in texts for x in self.encode([t])] if len(texts) > 1 else [self._long(split[0])]
        self.learn(split)
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def _long(self, parts: list[str]) -> bytes:
        out = []
        for lo in range(0, len(parts), REMEMBERED // 2):
            some = parts[lo : lo + REMEMBERED // 2]
            self.learn([some])
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)


@cache
def word_tokens(path: str | None = None) -> WordTokens:
    """One for each path and worker; None is the default tokenizer, wherever this machine has it."""
    return WordTokens(path or default_path())


def default_path() -> str:
    """The public tokenizer that the queries use; looked up where it is needed, as it's a file of each machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
