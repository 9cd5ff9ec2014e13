"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as its bytes in a doubly linked list; a heap holds the
mergeable adjacent pairs by rank. The lowest is popped and merged again and
again, and the count is the number of initial symbols less the merges. No token
ids are produced. Counts of pre-tokens are kept in a bounded table, since words
recur.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); a special token's
string inside a text counts as one token, as the library's default has it; very
long pre-tokens cost O(n log n). Repeated rows give repeated results, an empty
table an empty result, and other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, prepare, text_rows

#: Fixed pattern of the byte-level pre-tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters, numbers and white space among the first 256 code points, and the same pattern over them for the faster engine.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r\x20\x85\xa0"
LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE_WORDS = 400_000
OVER_LIMIT = 1024

SCHEMA = fields(("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))


def byte_alphabet() -> list[str]:
    """The printable stand-in character of each byte: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], spare = chr(spare), spare + 1
    return out


def is_latin(text: str) -> bool:
    """Whether all code points are below 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class MergeCounter(dict):
    """Maps a pre-token to its number of tokens, computed at first use."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for c in byte_alphabet()]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: pair of ids -> rank and id of what it becomes, packed
        self.pair = {(vocab[a] << 20) | vocab[b]: (rank << 20) | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self.merge(word.encode("utf-8"))
        if len(word) <= 64:
            self[word] = n
        return n

    def merge(self, raw: bytes) -> int:
        """Symbols of ``raw`` less the merges that rank order makes."""
        n = len(raw)
        if n < 2:
            return n
        get = self.pair.get
        ids = [self.first[b] for b in raw]
        at = [get((a << 20) | b, -1) for a, b in zip(ids, ids[1:])]  # the merge of each symbol with its right neighbour
        heap = [(v >> 20) * n + i for i, v in enumerate(at) if v >= 0]
        if not heap:
            return n
        at.append(-1)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        right, left, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i = divmod(pop(heap), n)
            v = at[i]
            if v >> 20 != rank:
                continue  # the pair that was here has been merged meanwhile
            merges += 1
            made, j = v & 0xFFFFF, right[i]
            ids[i], at[j], k = made, -1, right[j]
            right[i] = k
            if k < n:
                left[k] = i
                v = at[i] = get((made << 20) | ids[k], -1)
                if v >= 0:
                    push(heap, (v >> 20) * n + i)
            else:
                at[i] = -1
            h = left[i]
            if h >= 0:
                v = at[h] = get((ids[h] << 20) | made, -1)
                if v >= 0:
                    push(heap, (v >> 20) * n + h)
        return n - merges

    def count(self, text: str) -> int:
        if self.special is not None and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count_plain(p) for p in parts)
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        return sum(map(self.__getitem__, (LATIN_WORD if is_latin(text) else WORD).findall(text)))


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = OVER_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=SCHEMA.names,
            )

    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *SCHEMA.fields[1:]])
    return rows.mapInArrow(run, schema)
