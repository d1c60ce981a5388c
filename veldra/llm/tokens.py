"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: dynamic programming over prefixes. A piece of text has exactly one encoding, and so has each of its
prefixes, and the encoding of a prefix differs from that of the prefix before its last token by that token alone.
So one token per prefix is all there is to store. An automaton with suffix links yields the tokens that end at each
byte; of these exactly one is compatible with the last token of the prefix that it would follow: a pair is
compatible if the bytes of both together are encoded as just these two tokens. Following the stored tokens back
from the end gives the ids. The time is linear in the text, also for texts without any white space.

The vocabulary is read from a folder given by parameter on each executor; nothing of it is kept in the package.
Texts are cut into pieces by the vocabulary's own pattern first, and pieces that recur are looked up: the memo of a
Python worker is emptied when it holds MEMO pieces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MEMO = 200_000
#: Longer pieces are rare and not memoised.
MEMO_LENGTH = 64
#: Ids of null and of empty texts. No ids at all by default, so that nothing is invented.
NULL_IDS: tuple[int, ...] = ()
EMPTY_IDS: tuple[int, ...] = ()


def vocabulary_folder() -> str:
    """Where the vocabularies are: VELDRA_TOKENIZERS, or the installed package ``public_tokenizers``."""
    if at := os.environ.get("VELDRA_TOKENIZERS"):
        return at
    import public_tokenizers

    return os.path.dirname(public_tokenizers.__file__)


def _pattern() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except ImportError:
        return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixEncoder:
    """Exact BPE ids by dynamic programming over prefixes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.auto = ahocorasick.Automaton()
        for b, i in ranks.items():  # bytes as characters of the same number
            self.auto.add_word(b.decode("latin-1"), (i, len(b)))
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding of a short string by its merges, lowest rank first; only pairs of tokens are tested by it."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        last = [-1] * (n + 1)  # last token of the encoding of each prefix
        size = [0] * (n + 1)
        for end, (token, length) in self.auto.iter(data.decode("latin-1")):
            stop = end + 1
            if last[stop] >= 0:
                continue
            start = stop - length
            if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                last[stop], size[stop] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for p in self.cut(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(folder: str, name: str = "byte_bpe_50k") -> PrefixEncoder:
    """The encoder of a rank file ``<name>.tiktoken``; each Python worker makes it once."""
    key = (folder, name)
    if key not in _ENCODERS:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[key] = PrefixEncoder(ranks, _pattern())
    return _ENCODERS[key]


def _ids_batches(folder: str, name: str, null_ids: tuple[int, ...], empty_ids: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            texts, flat, ends = b.column(1), [], np.zeros(b.num_rows + 1, dtype=np.int32)
            for i, t in enumerate(texts.to_pylist()):
                flat += null_ids if t is None else enc.encode(t) if t else empty_ids
                ends[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return run


def spread(docs: DataFrame) -> DataFrame:
    """Few large input splits become one task per core at least; otherwise rows stay where they were read."""
    want = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(want) if docs.rdd.getNumPartitions() < want else docs


def encode_documents(
    docs: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None, null_ids: tuple[int, ...] = NULL_IDS, empty_ids: tuple[int, ...] = EMPTY_IDS
) -> DataFrame:
    """``(doc_id, ids)``, one row per row of ``docs (doc_id, text)``, without special tokens; strings of special
    tokens in a text are ordinary text. A null text has ``null_ids``, an empty one ``empty_ids``; blank texts are
    encoded as they are. Whole texts are encoded whatever their length. Repeated rows are encoded each."""
    return spread(docs.select("doc_id", "text")).mapInArrow(_ids_batches(folder or vocabulary_folder(), name, tuple(null_ids), tuple(empty_ids)), "doc_id BIGINT, ids ARRAY<INT>")
