"""Exact BPE encoding by backtracking over longest matches; decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds every token occurrence of a
pre-token in one pass. From the left the longest occurrence is taken; each
choice is checked against the pair-compatibility relation (two adjacent tokens
are compatible when merging their concatenation leaves that boundary uncrossed)
and the encoder steps back where no token fits. The result is the one sequence
that rank-ordered merging gives. Decoding concatenates slices of one buffer
that holds all token strings, addressed by an offset table.

Edge cases: a null text is empty and gives no ids; strings of special tokens
inside a text become their ids and are decoded as such; texts with code points
that Python's Unicode tables don't know are split by the library's tables; very long pre-tokens are
encoded whole; an unknown byte can't occur as all 256 are in the vocabulary.
Repeated rows give repeated results, empty tables an empty result, and other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import fields, prepare, text_rows
from .token_count import LETTER, NUMBER, SPACE, byte_alphabet, is_latin

CACHE_WORDS = 250_000
PAIRS = 500_000
#: The pre-tokenizer's pattern over the first 256 code points, for the faster engine.
LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
SCHEMA = fields(("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.StringType()))


def unassigned() -> re.Pattern:
    """Code points without a category in Python's tables; the library's are newer and know some of them."""
    found, start = [], None
    for c in range(256, 0x110001):
        none = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if none and start is None:
            start = c
        elif not none and start is not None:
            found.append((start, c - 1))
            start = None
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found) + "]")


class Codec:
    """Encoder and decoder for a vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        vocab = self.vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            if out not in self.parts:
                self.parts[out] = (left, right)
                self.made[out] = r
        # A token with the suffix is entered as its characters and one mark; pre-tokens get the mark at their end.
        self.mark = "\0" if self.suffix else ""
        n = len(self.suffix)
        self.compatible: dict[int, bool] = {}
        sound: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for s, i in sorted(vocab.items(), key=lambda x: self.made.get(x[1], -1)):
            if i in self.parts:
                # a token that merging never makes is not a candidate
                left, right = self.parts[i]
                if left not in sound or right not in sound or not self.uncrossed(left, right, self.made[i]):
                    continue
            sound.add(i)
            key = s[:-n] + self.mark if n and s.endswith(self.suffix) and len(s) > n else s
            self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pre = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pre)
        self.unassigned = unassigned()
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = pre_tokenizers.Split(Regex(pre), "removed", invert=True)
        self.cache: dict[str, bytes] = {}
        self.packed = [struct.pack("<I", i) for i in range(max(max(vocab.values()), *self.special.values()) + 1)]
        self._offsets(spec)

    def _offsets(self, spec: dict) -> None:
        strings = {**{i: s for s, i in self.vocab.items()}, **{i: s for s, i in self.special.items()}}
        self.buffer, at, self.offset = "".join(strings[i] for i in sorted(strings)), 0, [0] * (max(strings) + 2)
        for i in range(max(strings) + 1):
            at += len(strings.get(i, ""))
            self.offset[i + 1] = at
        self.strings = [self.buffer[a:b] for a, b in zip(self.offset, self.offset[1:])]
        self.joint = " " if spec.get("decoder") is None else ""  # without a decoder the library joins tokens by a space

    def uncrossed(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below ``limit`` joins the end of a to the start of b.

        Merges are undone from the latest; two tokens that meet at the boundary
        once they both exist must not form a pair that merges earlier.
        """
        rank, parts, made = self.rank, self.parts, self.made
        while True:
            r = rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra > rb:
                limit, a = ra, parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, parts[b][0]  # of equal ranks the left one merges first
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled as pairs come up."""
        key = (a << 20) | b
        ok = self.compatible.get(key)
        if ok is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            ok = self.compatible[key] = self.uncrossed(a, b, 1 << 60)
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        alphabet = self.alphabet
        symbols = "".join([alphabet[b] for b in word.encode("utf-8")]) + self.mark
        # the longest match at each place is the first path of the search, and mostly stands
        found, last, end = [], -1, 0
        fits, table = self.fits, self.compatible
        for stop, (length, i) in self.automaton.iter_long(symbols):
            if stop + 1 - length != end or last >= 0 and not (ok if (ok := table.get((last << 20) | i)) is not None else fits(last, i)):
                break
            found.append(i)
            last, end = i, stop + 1
        return found if end == len(symbols) else self.search(symbols)

    def search(self, symbols: str) -> list[int]:
        """Depth-first over all matches, longest first; a place from which no path leads on is entered once."""
        n = len(symbols)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.automaton.iter(symbols):
            starts[end + 1 - length].append((end + 1, i))
        for s in starts:
            s.reverse()  # longest first
        out: list[int] = []
        at: list[int] = [0]  # start of each token that stands, and the end of the last
        choice: list[int] = [0]
        dead = set()
        while at[-1] < n:
            here, k = at[-1], choice[-1]
            options = starts[here]
            while k < len(options):
                stop, i = options[k]
                k += 1
                if stop not in dead and (not out or self.fits(out[-1], i)):
                    choice[-1] = k
                    out.append(i)
                    at.append(stop)
                    choice.append(0)
                    break
            else:
                if not out:
                    raise ValueError(f"no encoding for {symbols[:40]!r}")
                dead.add(here)
                at.pop(), choice.pop(), out.pop()
        return out

    def word_bytes(self, word: str) -> bytes:
        hit = self.cache.get(word)
        if hit is None:
            packed = self.packed
            hit = b"".join([packed[i] for i in self.encode_word(word)])
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            if len(word) <= 64:
                self.cache[word] = hit
        return hit

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of the normalised text."""
        if is_latin(text):
            return LATIN_WORD.findall(text.lower())
        if self.unassigned.search(text) is not None:
            # only the library's own tables say what these code points are
            return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        # lower case is taken for each character by itself, so a final sigma has no form of its own
        return self.words.findall("".join([c.lower() for c in text]) if "Σ" in text else text.lower())

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        parts = self.splitter.split(text) if any(s in text for s in self.special) else [text]
        get, out = self.word_bytes, []
        for p in parts:
            if p in self.special:
                out.append(self.packed[self.special[p]])
            elif p:
                out.extend(map(get, self.pieces(p)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The library's string for these ids."""
        strings = self.strings
        return self.joint.join([strings[i] for i in memoryview(ids).cast("I").tolist()])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())],
                    names=SCHEMA.names,
                )

    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *SCHEMA.fields[1:]])
    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode``'s rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
