"""Removal of byte strings that also occur in an earlier document.

Every byte that lies in a 50-byte string which also starts in a document with a
smaller doc_id is removed; strings are judged on the input, and matches never
cross documents.

1. Each 50-byte window has an anchor, the 20-gram of least hash inside it, which
   depends on the window's bytes alone; runs of windows share an anchor. Anchor
   hashes that two texts may hold set a bit of a filter of fixed size.
2. Runs whose anchor passes go on as fingerprints with their places, about 17
   bytes each. Within a task's batch, and then for each anchor, equal runs are
   settled: all but the least document's are repeats.
3. Only where runs of one anchor differ are bytes needed. They are cut from the
   texts for the least document of each run, trimmed to what a neighbour in the
   order of left and of right contexts may share, and joined to strings whose
   suffix arrays are built in linear time by grouping: suffixes are grouped by
   their Lyndon prefix in descending order along previous-smaller pointers, then
   each group's order is emitted without recursive renaming. Neighbours in it
   that agree on 50 bytes form a class; a window is a repeat where its class has
   a smaller doc_id.
4. Repeats are gathered by document and cut from its bytes.

Runs of one anchor are told apart by 64 bits of their bytes. An anchor with k
differing runs takes two of them for one with a probability of about k * k /
2**65: one in a million for six million runs, about as many as ``hot`` lets
through at 100 TB.
The filter only saves work: where it is full, all runs are sent, 20 bytes for
each 16 bytes of text. Hot anchors (``hot`` runs and more, of which there are at
most 2**20) and anchors of over ``split`` differing runs are dealt window by
window, so no anchor's runs fill a task or one suffix array.

Edge cases: a null text is empty; rows with a null doc_id neither remove nor
lose anything; rows that share a doc_id are not earlier than one another, and
each loses only its own repeats; ids of any type that sorts may be used; repeated
rows give repeated results; texts under 50 bytes lose nothing; an empty table
gives an empty result; long texts are cut into pieces that overlap by 49 bytes.
Other columns are ignored. What is left may not be valid UTF-8 and is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, prepare, table, text_rows

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
#: Bytes handled at once; a place in them takes PLACE bits beside the hash that picks anchors.
PIECE = 1 << 20
PLACE = np.uint64(20)
#: The filter has 2**FILTER bits.
FILTER = 27
#: Bytes of strings that one suffix array takes, unless one anchor alone has more.
BLOCK = 1 << 16
#: Anchors, and runs, that a task gathers before it sends them.
GATHER = 1 << 21
#: Occurrences in one batch from which an anchor's are counted, to find the hot ones.
COUNTED = 64

M1 = np.uint64(0x9E3779B97F4A7C15)
M2, M4, M8 = (np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64)) for e in (2, 4, 8))
MIX = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
WEIGHTS = np.random.default_rng(20240902).integers(1, 1 << 63, (2, LENGTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGN = np.uint64(1 << 63)
#: Widths in bytes of the columns of runs (anchor, run, doc, key, start, windows, place of the anchor), spans (doc, key, start, stop)
#: and strings (anchor, doc, key, start, windows, place of the anchor, whether to split).
RUN = (5, 8, 8, 8, 4, 1, 1)
SPANS = (8, 8, 4, 4)
REPS = (8, 8, 8, 4, 1, 1, 1)


class Sizes(NamedTuple):
    """How many parts anchors (2**deal for the filter, 2**parts for runs) and documents (2**docs) are dealt to, and limits."""

    deal: int
    parts: int
    docs: int
    hot: int
    split: int


def sizes_of(total: int, hot: int | None = None, split: int | None = None) -> Sizes:
    """Sizes for a corpus of ``total`` bytes: parts of about 2**21 anchors, 2**17 anchors and 4 MB of texts."""
    anchors = max(1, total // (SPAN // 2))
    bits = lambda n: max(0, int(n - 1).bit_length())
    return Sizes(max(4, bits(-(-anchors >> 21))), bits(-(-anchors >> 17)), bits(-(-total >> 22)), hot or max(1 << 16, anchors >> 20), split or 1 << 12)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def planes(widths: tuple[int, ...], columns: list[np.ndarray]) -> bytes:
    """Columns as planes of their low bytes, so that bytes that are zero everywhere compress to nothing."""
    return b"".join(np.ascontiguousarray(c).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for w, c in zip(widths, columns))


def unplaned(widths: tuple[int, ...], blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of all blobs, as unsigned 64-bit integers."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in widths]
    for blob in blobs:
        m, at = len(blob) // sum(widths), 0
        raw = np.frombuffer(blob, np.uint8)
        for out, w in zip(parts, widths):
            full = np.zeros((m, 8), np.uint8)
            full[:, :w] = raw[at : at + w * m].reshape(w, m).T
            out.append(full.reshape(-1).view("<u8"))
            at += w * m
    return [np.concatenate(p) for p in parts]


def doc_part(doc: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of Spark's xxhash64 of two longs; ``doc`` has its sign bit flipped."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(doc), 42, np.uint64)
    with np.errstate(over="ignore"):
        for x in (doc ^ SIGN, key):
            h = h + p5 + np.uint64(8)
            h = turn(h ^ (turn(x * p2, 31) * p1), 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h ^= h >> np.uint64(32)
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def dealt(part: np.ndarray, widths: tuple[int, ...], columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of the rows of each part."""
    order = np.argsort(part, kind="stable")
    columns = [c[order] for c in columns]
    part = part[order]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(at, [*at[1:], len(part)]):
        yield int(part[a]), planes(widths, [c[a:b] for c in columns])


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the 20 bytes from each place on."""
    h1 = a.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * M1 + h1[1:]
    h4 = h2[:-2] * M2 + h2[2:]
    h8 = h4[:-4] * M4 + h4[4:]
    h16 = h8[:-8] * M8 + h8[8:]
    return mixed(h16[:-4] * M4 + h4[16:])


def runs(a: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, its place, and first and last window of each run of windows with one anchor.

    ``a`` holds pieces one after the other and ``ends`` is, for each place, the
    end of its piece; windows that don't fit in their piece are none.
    """
    if len(a) < LENGTH:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    h = gram_hashes(a)
    m = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: len(m) - (SPAN - 16)], m[SPAN - 16 :])
    anchor = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
    n = len(anchor)
    fits = np.arange(n) + LENGTH <= ends[:n]
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1]) | (ends[1:n] != ends[: n - 1])) + 1
    first = np.r_[0, change]
    last = np.r_[change - 1, n - 1]
    ok = fits[first]
    first, last = first[ok], last[ok]
    return h[anchor[first]], anchor[first], first, last


class Powers:
    """Powers of MIX and of its inverse, made once a worker."""

    up = down = np.zeros(0, np.uint64)


def fingerprints(a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run, by prefix sums of a polynomial."""
    if not len(Powers.up):
        Powers.up, Powers.down = np.cumprod(np.full(PIECE, MIX)), np.cumprod(np.full(PIECE, INVERSE))
    total = np.r_[np.uint64(0), np.cumsum((a + np.uint64(1)) * Powers.up[: len(a)])]
    return mixed((total[last + LENGTH] - total[first]) * Powers.down[first] + (last - first).astype(np.uint64) * M2)


def window_hashes(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the 50 bytes from each of ``at`` on."""
    out = np.zeros((2, len(at)), np.uint64)
    for lo in range(0, len(at), 1 << 14):
        w = a[at[lo : lo + (1 << 14), None] + np.arange(LENGTH)] + np.uint64(1)
        for k in (0, 1):
            out[k, lo : lo + len(w)] = mixed((w * WEIGHTS[k]).sum(1, dtype=np.uint64))
    return out[0], out[1]


def pieces(ids: list, texts: list) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes, end of each place's piece, and for each place its row and the offset to subtract."""
    buf: list[bytes] = []
    marks: list[tuple[int, int]] = []  # row, where the piece starts in its text
    size = 0

    def pack():
        lengths = np.array([len(x) for x in buf])
        stop = np.cumsum(lengths)
        begin = stop - lengths
        which = np.repeat(np.arange(len(buf)), lengths)
        rows = np.array([r for r, _ in marks])
        shift = begin - np.array([s for _, s in marks])
        return b"".join(buf), stop[which], rows[which], shift[which]

    for row, (i, t) in enumerate(zip(ids, texts)):
        if i is None or not t:
            continue
        raw = t.encode("utf-8")
        if len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, PIECE - 2 * LENGTH):
            part = raw[at : at + PIECE - LENGTH - 1]
            if size + len(part) > PIECE - 1:
                yield pack()
                buf, marks, size = [], [], 0
            buf.append(part)
            marks.append((row, at))
            size += len(part)
    if buf:
        yield pack()


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array by grouping; ``s`` ends with its only least symbol.

    Groups are ranges of ``sa``. From the highest down, each group's members get
    their previous-smaller pointer, and the suffixes pointed at, by how often,
    leave their groups for new ones right behind. The second phase fills the
    ranges from the front, in the order of the suffix behind each Lyndon prefix.
    """
    n = len(s)
    order = np.argsort(np.array(s), kind="stable")
    sa = order.tolist()
    inverse = [0] * n
    group = [0] * n
    size = [0] * (n + 1)
    start, before = 0, -1
    for p, i in enumerate(sa):
        if s[i] != before:
            start, before = p, s[i]
        inverse[i] = p
        group[i] = start
        size[start] += 1
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        g = group[sa[end]]
        members = sa[g : end + 1]
        if len(members) > 1:
            members.sort()
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > g:
                p = prev[p]
            if p >= 0 and group[p] == g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            times: dict[int, list[int]] = {}
            for p, c in counts.items():
                times.setdefault(c, []).append(p)
            for c in sorted(times, reverse=True):
                moved = times[c]
                for p in moved:
                    old = group[p]
                    size[old] -= 1
                    at, here = old + size[old], inverse[p]
                    if at != here:
                        other = sa[at]
                        sa[at], sa[here] = p, other
                        inverse[p], inverse[other] = at, here
                fresh: dict[int, int] = {}
                for p in moved:
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = old + size[old]
                    group[p] = new
                for p in moved:
                    size[group[p]] += 1
        end = g - 1
    front = list(range(n + 1))
    done = [False] * n
    out = [-1] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = True
            j = prev[j]
    return out


def window_classes(strings: list[bytes], least: list[int]) -> list[np.ndarray]:
    """For each string and each of its windows, the least of ``least`` over strings that hold the window."""
    text = b"".join(strings)
    s = [x + 2 for x in text]
    s.append(1)
    lengths = np.array([len(x) for x in strings])
    begin = np.cumsum(lengths) - lengths
    limit = [0] * len(text)
    owner = [0] * len(text)
    for k, (b, n) in enumerate(zip(begin.tolist(), lengths.tolist())):
        for p in range(b, b + n - LENGTH + 1):
            limit[p] = 1
            owner[p] = k
    best = [0] * len(text)
    run: list[int] = []
    word = b""
    for p in suffix_array(s):
        if p >= len(text) or not limit[p]:
            continue
        w = text[p : p + LENGTH]
        if w != word:
            if run:
                low = min([least[owner[q]] for q in run])
                for q in run:
                    best[q] = low
            run, word = [], w
        run.append(p)
    if run:
        low = min([least[owner[q]] for q in run])
        for q in run:
            best[q] = low
    return [np.array(best[b : b + n - LENGTH + 1], np.uint64) for b, n in zip(begin.tolist(), lengths.tolist())]


def deal(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def short(h: np.ndarray, bits: int) -> np.ndarray:
    """What the filter's passes know of an anchor: its part and 32 low bits."""
    return (deal(h, bits).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def filter_bits(docs: DataFrame, sizes: Sizes) -> tuple[bytes, np.ndarray]:
    """The filter over anchor hashes that more than one text may hold, and the hot anchors."""
    sent = fields(("part", T.IntegerType()), ("hashes", T.BinaryType()), ("counts", T.BinaryType()))
    got = fields(("part", T.IntegerType()), ("segment", T.BinaryType()), ("hot", T.BinaryType()))
    bits = max(0, FILTER - sizes.deal)

    def send(found: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(found)
        key = np.sort(short(h, sizes.deal))
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[at, len(key)])
        # twice is enough to tell, but for the hot ones
        some = key[np.sort(np.r_[at, at[times > 1] + 1])]
        rows = {p: [b, None] for p, b in dealt((some >> np.uint64(32)).astype(np.int64), (4,), [some])}
        many = times >= COUNTED
        for p, b in dealt((key[at[many]] >> np.uint64(32)).astype(np.int64), (4, 4), [key[at[many]], times[many]]):
            rows[p][1] = b
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r[0] for r in rows.values()], pa.binary()), pa.array([r[1] for r in rows.values()], pa.binary())], names=sent.names)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for b in batches:
            with np.errstate(over="ignore"):
                for raw, ends, rows, _ in pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    h, _, first, _ = runs(np.frombuffer(raw, np.uint8), ends)
                    # once for each document; a repeat inside one document is none
                    owner = rows[first].astype(np.uint64)
                    o = np.lexsort((owner, h))
                    h, owner = h[o], owner[o]
                    found.append(h[np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]] if len(h) else h)
            if sum(map(len, found)) >= GATHER:
                yield send(found)
                found = []
        if sum(map(len, found)):
            yield send(found)

    def segments(key, t):
        h = np.sort(unplaned((4,), t.column("hashes").to_pylist())[0])
        twice = h[1:][h[1:] == h[:-1]]
        held = np.zeros(max(8, 1 << bits), np.uint8)
        held[(twice & np.uint64((1 << bits) - 1)).astype(np.int64)] = 1
        low, times = unplaned((4, 4), [x for x in t.column("counts").to_pylist() if x])
        kinds, which = np.unique(low, return_inverse=True)
        hot = kinds[np.bincount(which, times.astype(float), len(kinds)) >= sizes.hot]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([np.packbits(held).tobytes()], pa.binary()), "hot": pa.array([planes((4,), [hot])], pa.binary())})

    step = max(8, 1 << bits) // 8
    out = bytearray(step << sizes.deal)
    hot = [np.zeros(0, np.uint64)]
    for r in docs.select("doc", "text").mapInArrow(anchors, sent).groupBy("part").applyInArrow(segments, got).toLocalIterator():
        out[r.part * step : (r.part + 1) * step] = r.segment
        hot.append(unplaned((4,), [r.hot])[0] | np.uint64(r.part << 32))
    return bytes(out), np.sort(np.concatenate(hot))


def joined(doc: np.ndarray, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Spans sorted, those that touch made one; of one text, a later start has a later stop."""
    o = np.lexsort((start, key, doc))
    doc, key, start, stop = doc[o], key[o], start[o], stop[o]
    if not len(doc):
        return [doc, key, start, stop]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > stop[:-1])]
    return [doc[fresh], key[fresh], start[fresh], stop[np.r_[np.flatnonzero(fresh)[1:] - 1, len(stop) - 1]]]


def lows(anchor: np.ndarray, run: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (anchor, run, doc): where anchors start, where runs start, and whether the row is of its run's least doc."""
    if not len(anchor):
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new_run = new_anchor | np.r_[True, run[1:] != run[:-1]]
    return new_anchor, new_run, doc == doc[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]


DEALT_RUNS = fields(("part", T.IntegerType()), ("dp", T.IntegerType()), ("rows", T.BinaryType()))


def shared_runs(docs: DataFrame, bits: bytes, hot: np.ndarray, sizes: Sizes) -> DataFrame:
    """Runs whose anchor passes the filter, of the least document of each batch, and (with their part of documents) the repeats settled in it."""
    held = docs.sparkSession.sparkContext.broadcast((bits, hot))
    per_part = np.uint64((1 << max(0, FILTER - sizes.deal)) - 1)
    step = max(8, 1 << max(0, FILTER - sizes.deal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, many = np.frombuffer(held.value[0], np.uint8), held.value[1]
        found: list[list[np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            anchor, same, doc, key, start, n, off = (np.concatenate(c) for c in zip(*found))
            o = np.lexsort((doc, same, anchor))
            anchor, same, doc, key, start, n, off = (c[o] for c in (anchor, same, doc, key, start, n, off))
            _, _, low = lows(anchor, same, doc)
            out = [(p, -1, b) for p, b in dealt(deal(anchor[low], sizes.parts), RUN, [c[low] for c in (anchor, same, doc, key, start, n, off)])]
            gone = joined(*(c[~low] for c in (doc, key, start, start + n + np.uint64(LENGTH - 1))))
            out += [(p & ((1 << sizes.parts) - 1), p, b) for p, b in dealt(doc_part(gone[0], gone[1], sizes.docs), SPANS, gone)]
            return batch_of(DEALT_RUNS, out)

        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ SIGN
            key = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                for raw, ends, rows, shift in pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    a = np.frombuffer(raw, np.uint8)
                    h, place, first, last = runs(a, ends)
                    at = deal(h, sizes.deal) * step + (h & per_part).astype(np.int64)
                    passes = (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                    h, place, first, last = h[passes], place[passes], first[passes], last[passes]
                    if not len(h):
                        continue
                    same, n, off = fingerprints(a, first, last), last - first + 1, place - first
                    if len(many):
                        k = short(h, sizes.deal)
                        is_hot = many[np.minimum(np.searchsorted(many, k), len(many) - 1)] == k
                        f, m = first[is_hot], n[is_hot]
                        each = np.repeat(f - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
                        h1, h2 = window_hashes(a, each)
                        h, same, first = np.r_[h[~is_hot], h1], np.r_[same[~is_hot], h2], np.r_[first[~is_hot], each]
                        n, off = np.r_[n[~is_hot], np.ones(len(each), np.int64)], np.r_[off[~is_hot], np.zeros(len(each), np.int64)]
                    row = rows[first]
                    found.append([h, same, doc[row], key[row], (first - shift[first]).astype(np.uint64), n.astype(np.uint64), off.astype(np.uint64)])
                    size += len(h)
                    if size >= GATHER:
                        yield send()
                        found, size = [], 0
        if found:
            yield send()

    return docs.select("doc", "text", "key").mapInArrow(run, DEALT_RUNS)


BY_DOC = fields(("dp", T.IntegerType()), ("spans", T.BinaryType()), ("reps", T.BinaryType()))


def batch_of(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType]) for c, f in zip(columns, schema.fields)], names=schema.names)


def equal_runs(part: int, blobs: list[bytes], sizes: Sizes) -> list[tuple]:
    """Repeats among equal runs, and of anchors with differing runs the rows of each run's least document, dealt by documents."""
    anchor, same, doc, key, start, n, off = unplaned(RUN, blobs)
    o = np.lexsort((doc, same, anchor))
    anchor, same, doc, key, start, n, off = (c[o] for c in (anchor, same, doc, key, start, n, off))
    new_anchor, new_run, low = lows(anchor, same, doc)
    gone = [c[~low] for c in (doc, key, start, start + n + np.uint64(LENGTH - 1))]
    out = {p: [b, None] for p, b in dealt(doc_part(gone[0], gone[1], sizes.docs), SPANS, gone)}
    at = np.flatnonzero(new_anchor)
    if len(at):
        group = np.cumsum(new_anchor) - 1
        kinds = np.add.reduceat(new_run.astype(np.int64), at)
        least = np.minimum.reduceat(doc, at)
        most = np.maximum.reduceat(np.where(low, doc, np.uint64(0)), at)
        mixed_rows = low & ((kinds > 1) & (least != most))[group]
        many = np.bincount(group[mixed_rows], minlength=len(at)) > sizes.split
        full = anchor | np.uint64((part << 40) & ((1 << 64) - 1))
        reps = [c[mixed_rows] for c in (full, doc, key, start, n, off, many[group].astype(np.uint64))]
        for p, b in dealt(doc_part(reps[1], reps[2], sizes.docs), REPS, reps):
            out.setdefault(p, [None, None])[1] = b
    return [(p, *x) for p, x in out.items()]


def settled(dealt_runs: DataFrame, sizes: Sizes) -> DataFrame:
    """dp, spans of repeats, and places of runs whose bytes are needed."""

    def run(key, t):
        part, dps, blobs = key[0].as_py(), t.column("dp").to_pylist(), t.column("rows").to_pylist()
        out = [(d, b, None) for d, b in zip(dps, blobs) if d >= 0]
        return pa.Table.from_batches([batch_of(BY_DOC, out + equal_runs(part, [b for d, b in zip(dps, blobs) if d < 0], sizes))])

    return dealt_runs.groupBy("part").applyInArrow(run, BY_DOC)


STRINGS = fields(("part", T.IntegerType()), ("whole", T.BooleanType()), ("rows", T.BinaryType()), ("bytes", T.BinaryType()))


def strings_of(texts: DataFrame, reps: DataFrame, sizes: Sizes) -> DataFrame:
    """The bytes of runs, dealt by anchor; runs of anchors to split as their windows' hashes."""
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())

    def run(left, right):
        anchor, doc, key, start, n, off, split = unplaned(REPS, right.column("reps").to_pylist())
        where: dict[tuple[int, int], int] = {}
        if len(doc):
            own = (left.column("doc").to_numpy().astype(np.int64).view(np.uint64) ^ SIGN).tolist()
            for i, k in enumerate(zip(own, left.column("key").to_numpy().astype(np.int64).view(np.uint64).tolist())):
                where.setdefault(k, i)
        text = left.column("text")
        o = np.lexsort((start, key, doc))
        anchor, doc, key, start, n, off, split = (c[o] for c in (anchor, doc, key, start, n, off, split))
        last, raw, cut = None, b"", []
        for d, k, s, e in zip(doc.tolist(), key.tolist(), start.tolist(), (start + n + np.uint64(LENGTH - 1)).tolist()):
            if (d, k) != last:
                last, raw = (d, k), text[where[d, k]].as_py().encode("utf-8")
            cut.append(raw[s:e])
        out = []
        whole = split > 0
        some = np.flatnonzero(~whole)
        part = deal(mixed(anchor), sizes.parts)
        some = some[np.argsort(part[some], kind="stable")]
        at = np.flatnonzero(np.r_[True, part[some][1:] != part[some][:-1]]) if len(some) else []
        for a, b in zip(at, [*at[1:], len(some)]):
            i = some[a:b]
            out.append((int(part[i[0]]), False, planes(REPS, [c[i] for c in (anchor, doc, key, start, n, off, split)]), b"".join([cut[x] for x in i.tolist()])))
        which = np.flatnonzero(whole)
        if len(which):
            a = np.frombuffer(b"".join([cut[x] for x in which.tolist()]), np.uint8)
            m = n[which].astype(np.int64)
            begin = np.cumsum(m + LENGTH - 1) - (m + LENGTH - 1)
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            h1, h2 = window_hashes(a, np.repeat(begin, m) + inside)
            one, none = np.ones(len(h1), np.uint64), np.zeros(len(h1), np.uint64)
            rows = [h1, h2, np.repeat(doc[which], m), np.repeat(key[which], m), np.repeat(start[which], m) + inside.astype(np.uint64), one, none]
            out += [(p, True, b, None) for p, b in dealt(deal(h1, sizes.parts), RUN, rows)]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=STRINGS.names)

    def guarded(left, right):
        with np.errstate(over="ignore"):
            return run(left, right)

    return texts.groupBy("dp").cogroup(reps.groupBy("dp")).applyInArrow(guarded, STRINGS)


def shared_context(group: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The longest prefix of each row of ``context`` (bytes from 1, then zeros) that another row of its group has."""
    words = np.pad(context, ((0, 0), (0, -context.shape[1] % 8))).view(">u8").astype(np.uint64)
    o = np.lexsort((*words.T[::-1], group))
    s, g = context[o], group[o]
    same = (s[1:] == s[:-1]) & (s[1:] > 0) & (g[1:] == g[:-1])[:, None]
    length = np.r_[0, np.logical_and.accumulate(same, axis=1).sum(1), 0]
    out = np.empty(len(o), np.int64)
    out[o] = np.maximum(length[:-1], length[1:])
    return out


def trimmed(anchor: np.ndarray, n: np.ndarray, off: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run that another run of its anchor may hold (first > last: none).

    A window is the anchor with some bytes of left context and the rest of
    right context; the run that shares it shares both.
    """
    n, off = n.astype(np.int64), off.astype(np.int64)
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    at, wide = begin + off, np.arange(SPAN - 1)
    value = a + np.uint8(1)  # UTF-8 has no byte 255
    left = np.where(wide < off[:, None], value[np.maximum(at[:, None] - 1 - wide, 0)], 0).astype(np.uint8)
    behind = n + LENGTH - 1 - off - GRAM
    right = np.where(wide < behind[:, None], value[np.minimum(at[:, None] + GRAM + wide, len(a) - 1)], 0).astype(np.uint8)
    x, y = shared_context(anchor, left), shared_context(anchor, right)
    return np.maximum(0, off - x), np.minimum(n - 1, off - (SPAN - 1) + y)


def settle(groups: list[dict[bytes, list[tuple[int, int, int]]]]) -> list[tuple[int, int, int, int]]:
    """Repeats (doc, key, start, stop) of a block of anchors, each with its differing runs and their places."""
    strings = [s for g in groups for s in g]
    places = [x for g in groups for x in g.values()]
    out = []
    for s, at, low in zip(strings, places, window_classes(strings, [min(x)[0] for x in places])):
        for d, k, o in at:
            hit = np.flatnonzero(low < d)
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, b in zip(np.r_[hit[0], hit[cut + 1]].tolist(), np.r_[hit[cut], hit[-1]].tolist()):
                    out.append((d, k, o + a, o + b + LENGTH))
    return out


def differing_runs(rows: list[bytes], texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Repeats among the runs of each anchor, by suffix arrays."""
    anchor, doc, key, start, n, off, _ = unplaned(REPS, rows)
    joined_text = b"".join(texts)
    first, last = trimmed(anchor, n, off, np.frombuffer(joined_text, np.uint8))
    begin = np.cumsum(n + np.uint64(LENGTH - 1)).astype(np.int64) - n.astype(np.int64) - (LENGTH - 1)
    some = np.flatnonzero(first <= last)
    some = some[np.argsort(anchor[some], kind="stable")]
    groups: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    for g, d, k, s, b, f, e in zip(*(c[some].tolist() for c in (anchor, doc, key, start, begin, first, last))):
        groups.setdefault(g, {}).setdefault(joined_text[b + f : b + e + LENGTH], []).append((d, k, s + f))
    out: list[tuple[int, int, int, int]] = []
    block, size = [], 0
    for g in groups.values():
        if len({d for x in g.values() for d, _, _ in x}) > 1:
            block.append(g)
            size += sum(map(len, g))
        if size >= BLOCK:
            out += settle(block)
            block, size = [], 0
    return out + settle(block) if block else out


def string_repeats(strings: DataFrame, sizes: Sizes) -> DataFrame:
    """dp and spans of the repeats among differing runs."""

    def run(key, t):
        part, whole = key[0].as_py(), key[1].as_py()
        rows = t.column("rows").to_pylist()
        if whole:
            out = [(p, spans, None) for p, spans, _ in equal_runs(part, rows, sizes) if spans]
        else:
            found = np.array(differing_runs(rows, t.column("bytes").to_pylist()), np.uint64).reshape(-1, 4).T
            out = [(p, b, None) for p, b in dealt(doc_part(found[0], found[1], sizes.docs), SPANS, list(found))]
        return pa.Table.from_batches([batch_of(BY_DOC, out)])

    return strings.groupBy("part", "whole").applyInArrow(run, BY_DOC)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out



def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without null ids, with doc: the id as a long, or its rank where it is no integer."""
    docs = docs.where(F.col("doc_id").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return docs.withColumn("doc", F.col("doc_id").cast("long"))
    ranks = docs.select("doc_id").distinct().orderBy("doc_id").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    return docs.join(table(docs.sparkSession.createDataFrame(ranks, T.StructType([T.StructField("doc_id", kind), T.StructField("doc", T.LongType())])), "id-ranks"), "doc_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None, split: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept of every row."""
    prepare(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    texts = numbered(rows)
    by_id = texts.select("doc", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("n").alias("n"))
    stats = by_id.agg(F.coalesce(F.max(F.col("a") != F.col("b")), F.lit(False)).alias("several"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    sizes = sizes_of(stats.total, hot, split)
    # the texts of one id are told apart by their hash, where any id has several
    texts = texts.withColumn("key", F.xxhash64("text") if stats.several else F.lit(0).cast("long"))
    texts = texts.withColumn("dp", F.pmod(F.xxhash64("doc", "key"), F.lit(1 << sizes.docs).cast("long")).cast("int"))
    by_doc = table(settled(shared_runs(texts, *filter_bits(texts, sizes), sizes), sizes), "repeats")
    more = string_repeats(strings_of(texts, by_doc.where("reps is not null").select("dp", "reps"), sizes), sizes)
    spans = by_doc.where("spans is not null").select("dp", "spans").unionByName(more.select("dp", "spans"))
    rest = (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()))
    schema = T.StructType([rows.schema["doc_id"], *fields(*rest).fields])

    def cut(left, right):
        doc, key, start, stop = unplaned(SPANS, right.column("spans").to_pylist())
        o = np.lexsort((start, key, doc))
        doc, key, start, stop = doc[o], key[o], start[o], stop[o]
        at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, np.int64)
        ends = np.r_[at[1:], len(doc)].tolist()
        where = {k: (a, b) for k, a, b in zip(zip(doc[at].tolist(), key[at].tolist()), at.tolist(), ends)}
        own = zip((left.column("doc").to_numpy().astype(np.int64).view(np.uint64) ^ SIGN).tolist(), left.column("key").to_numpy().astype(np.int64).view(np.uint64).tolist())
        out = []
        for k, t in zip(own, left.column("text")):
            raw = t.as_py().encode("utf-8")
            a, b = where.get(k, (0, 0))
            gone = merged(list(zip(start[a:b].tolist(), stop[a:b].tolist())))
            last, kept = 0, []
            for x, y in gone:
                kept.append(raw[last:x])
                last = y
            kept.append(raw[last:])
            out.append((len(raw), sum(y - x for x, y in gone), len(gone), b"".join(kept)))
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([left.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=schema.names)

    out = texts.groupBy("dp").cogroup(spans.groupBy("dp")).applyInArrow(cut, schema)
    text = F.coalesce("text", F.lit("")).cast("binary")
    unnamed = rows.where(F.col("doc_id").isNull()).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), text.alias("kept"))
    return out.unionByName(unnamed)
