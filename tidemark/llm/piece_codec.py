"""SentencePiece BPE encoding by vectorised merge rounds; decoding by a table of byte strings.

The words of a batch that are not known yet stand in one flat array of symbols.
In each round every word takes the least rank among its adjacent pairs (a
segmented minimum), all leftmost pairs of that rank that don't overlap merge at
once, the array is compacted, and words without a pair leave it. That equals
merging one pair at a time, best score first and leftmost first, as long as no
pair that a merge makes goes before the merge's own rank. Pieces for which the
vocabulary has such a pair, and ranks that several pieces share, merge only
their leftmost pair in a round.

A word is a run of spaces with what follows it: no piece has a space inside, so
none crosses words. A line feed stands by itself if it is part of no piece, and
a word of letters ends before a punctuation mark that no piece has behind a
letter. Ids of words are kept in a bounded table.

Edge cases: a null or empty text gives the end id only; characters that the
vocabulary lacks become their bytes; strings of control pieces inside texts are
ordinary text; a space and U+2581 are the same. Invalid byte sequences decode to
one U+FFFD a byte. Repeated rows give repeated results, empty tables an empty
result, and other columns are ignored. A model with another normaliser, with
user-defined or unused pieces, or without byte fallback is refused.
"""

from __future__ import annotations

import codecs
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import fields, prepare, text_rows

SPACE = "▁"
CACHE_WORDS = 600_000
#: Words of more characters don't stay in the table.
LONG = 64
#: Texts that are encoded together; symbols that are merged together.
TEXTS = 128
SYMBOLS = 1 << 20
NO_PAIR = np.iinfo(np.int32).max
#: Letters and digits after which a word ends at a mark that no piece has behind one.
LATIN = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ]")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SCHEMA = fields(("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType(), False)), ("decoded", T.StringType()))

codecs.register_error("tidemark_each_byte", lambda e: ("�", e.start + 1))


class PieceCodec:
    """Encoder and decoder for one model."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        spec = model.normalizer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, a plain normaliser and no user-defined pieces are supported")
        vocab = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(c not in vocab for s in vocab for c in s) or any(SPACE in s.lstrip(SPACE) for s in vocab):
            raise ValueError("pieces must be made of known characters and hold spaces at their start only")
        self.end = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == "</s>")
        self.bytes = [0] * 256
        self.strings = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
                self.strings.append(bytes([int(p.piece[3:-1], 16)]))
            else:
                self.strings.append({CONTROL: "", UNKNOWN: " ⁇ "}.get(p.type, p.piece.replace(SPACE, " ")).encode())
        self._pairs(vocab, [p.score for p in model.pieces])
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for s, i in vocab.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        alone = "\n" if not any("\n" in s and len(s) > 1 for s in vocab) else ""
        after = {b for s in vocab for a, b in zip(s, s[1:]) if LATIN.match(a)}
        marks = re.escape("".join(c for c in string.punctuation if c not in after))
        letter = LATIN.pattern[1:-1]
        self.words = re.compile(f" *[^ {alone}{letter}]*[{letter}]+(?=[ {alone}{marks}]|\\Z)| *[^ {alone}]+| +" + (f"|{alone}" if alone else ""))
        #: The longest piece of spaces only. No pair starts with it, and pieces of spaces come last of all and from the left, so long runs start with it.
        self.blank = max((s for s in vocab if not s.strip(SPACE)), key=len)
        start = vocab[self.blank]
        last = max((r for r, s in zip(self.rank.tolist(), self.made.tolist())), default=0)
        own = [r for r, s in zip(self.rank.tolist(), self.made.tolist()) if not model.pieces[s].piece.strip(SPACE)]
        self.peel = len(self.blank) if len(self.blank) > 1 and set(own) == {last} and start not in set((self.keys // self.size).tolist()) else 0
        self.blank_id = np.array([start], "<i4").tobytes()
        self.cache: dict[str, bytes] = {}

    def _pairs(self, vocab: dict[str, int], scores: list[float]) -> None:
        """Sorted keys of all pairs of pieces that make a piece, with its rank, and which pieces merge alone."""
        self.size = len(scores)
        order = {s: r for r, s in enumerate(sorted({scores[i] for s, i in vocab.items() if len(s) > 1}, reverse=True))}
        rank = {i: order[scores[i]] if len(s) > 1 else -1 for s, i in vocab.items()}
        found = [(vocab[s[:k]] * self.size + vocab[s[k:]], i) for s, i in vocab.items() for k in range(1, len(s)) if s[:k] in vocab and s[k:] in vocab]
        found.sort()
        self.keys = np.array([k for k, _ in found], np.int64)
        self.made = np.array([i for _, i in found], np.int32)
        self.rank = np.array([rank[i] for _, i in found], np.int32)
        shared = np.bincount([r for r in rank.values() if r >= 0]) > 1
        self.alone = np.zeros(self.size, bool)
        self.alone[[i for i, r in rank.items() if r >= 0 and shared[r]]] = True
        for key, i in found:
            for part in divmod(key, self.size):
                if rank[i] <= rank[part]:
                    self.alone[part] = True

    def _look_up(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Rank and result of the pairs that start at these places."""
        at = at[at < len(symbol) - 1]
        a, b = symbol[at], symbol[at + 1]
        inside = (word[at] == word[at + 1]) & (a >= 0) & (b >= 0)
        rank[at] = NO_PAIR
        at, key = at[inside], a[inside] * self.size + b[inside]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[found] == key
        rank[at[known]] = self.rank[found[known]]
        made[at[known]] = self.made[found[known]]

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, the words together in one array."""
        code = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = self.symbol_of[code]
        symbol = np.where(symbol >= 0, symbol, -1 - code)  # an unknown character keeps its code
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        rank, made = np.full(len(symbol), NO_PAIR, np.int32), np.zeros(len(symbol), np.int32)
        self._look_up(symbol, word, np.arange(len(symbol)), rank, made)
        out: list[bytes] = [b""] * len(words)
        while len(symbol):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[start, len(symbol)])
            least = np.minimum.reduceat(rank, start)
            done = least == NO_PAIR
            if done.any():
                self._finish(symbol, word, start[done], length[done], out)
                stay = np.repeat(~done, length)
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                if not len(symbol):
                    break
                least, length = least[~done], length[~done]
                start = np.cumsum(length) - length
            # of pairs of that rank in a row, each with the last symbol of the one before, every other one merges
            hits = np.flatnonzero(rank == np.repeat(least, length))
            chained = np.r_[False, hits[1:] == hits[:-1] + 1]
            if chained.any():
                nth = np.arange(len(hits))
                hits = hits[(nth - np.maximum.accumulate(np.where(chained, 0, nth))) % 2 == 0]
            own = word[hits]
            later = np.r_[False, own[1:] == own[:-1]]
            if later.any():
                first = np.maximum.accumulate(np.where(later, 0, np.arange(len(hits))))
                hits = hits[~(later & self.alone[made[hits[first]]])]
            symbol[hits] = made[hits]
            left = np.ones(len(symbol), bool)
            left[hits + 1] = False
            symbol, word, rank, made = symbol[left], word[left], rank[left], made[left]
            hits -= np.arange(len(hits))
            self._look_up(symbol, word, np.concatenate([hits, hits[hits > 0] - 1]), rank, made)
            rank[-1] = NO_PAIR
        return out

    def _finish(self, symbol: np.ndarray, word: np.ndarray, start: np.ndarray, length: np.ndarray, out: list[bytes]) -> None:
        packed = symbol.astype("<i4").tobytes()
        known = np.minimum.reduceat(symbol, np.stack([start, start + length], 1).ravel()[: 2 * len(start) - int(start[-1] + length[-1] == len(symbol))])[::2] >= 0
        for w, a, b, ok in zip(word[start].tolist(), start.tolist(), (start + length).tolist(), known.tolist()):
            if ok:
                out[w] = packed[4 * a : 4 * b]
            else:
                ids = [i for s in symbol[a:b].tolist() for i in ([s] if s >= 0 else [self.bytes[x] for x in chr(-1 - s).encode()])]
                out[w] = np.array(ids, "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Enter the ids of these words."""
        part, held, total = [], [], 0
        for w in words:
            head = 0
            if self.peel and w.startswith("  "):
                head = max(0, (len(w) - len(w.lstrip(" ")) - 2) // self.peel)
            part.append(w[head * self.peel :])
            held.append((w, self.blank_id * head))
            total += len(w)
            if total > SYMBOLS:
                self.cache.update((name, first + ids) for (name, first), ids in zip(held, self.merge(part)))
                part, held, total = [], [], 0
        self.cache.update((name, first + ids) for (name, first), ids in zip(held, self.merge(part)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, each with the end id."""
        # the dummy prefix is one space before a text that is not empty
        split = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        wanted = set().union(*split)
        missing = wanted.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = wanted
        self.learn(missing)
        get, end = self.cache.__getitem__, np.array([self.end], "<i4").tobytes()
        out = [np.frombuffer(b"".join(map(get, s)) + end, "<i4") for s in split]
        for w in missing:
            if len(w) > LONG:
                del self.cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of these ids, without the space of the dummy prefix; bytes form no character across a piece without a text."""
        raw = b"".join(map(self.strings.__getitem__, ids))
        first = next((i for i in ids if self.strings[i]), None)
        if first is not None and self.strings[first].startswith(b" ") and first not in (self.bytes[32], 0):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
        parts = [[]]
        for i in ids:
            parts[-1].append(self.strings[i])
            if not self.strings[i]:
                parts.append([])
        text = "".join(b"".join(p).decode("utf-8", "tidemark_each_byte") for p in parts)
        return text[1:] if len(raw) < sum(len(x) for p in parts for x in p) else text


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (with the end id) and the decoded text of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                ids = c.encode([t or "" for t in part.column(1).to_pylist()])
                n = np.array([len(x) for x in ids], np.int64)
                ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()), type=kind)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, pa.array([c.decode(x.tolist()) for x in ids], pa.string())], names=SCHEMA.names)

    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *SCHEMA.fields[1:]])
    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids joined by a space and of the decoded text."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
