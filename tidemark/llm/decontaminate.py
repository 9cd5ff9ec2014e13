"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages over the benchmark's content terms. A
randomised range finder with one power step over the TF-IDF passages of the
whole corpus, and of the benchmark at equal mass, gives a latent space;
passages and benchmark items that are near in it by cosine are candidates. Terms
of many passages have no weight in that space. A part of an item of which those
terms alone would make a hit can't rely on the cosine, so it is looked up by its
terms: it is a candidate of every passage that has enough of them, however
common they are. A candidate is a hit if the
longest common subsequence of content terms covers ``COVER`` of the item, or
``COVER_WITH_ANSWER`` and the item's answer (its last ``ANSWER`` content terms)
is there as well, in order. An item of over ``STRIDE`` words is looked for in
parts of that many, and one part that is found is a hit of the item; only the
last part has the answer.

The corpus is tokenised once, into a table of content terms and their places;
all later passes read that. The driver holds matrices of (terms x rank), which
the benchmark bounds; a benchmark is handled in blocks of ``ITEMS`` items. Each
task adds up its share of the matrix and sends one, and those are added in
about the square root of as many groups before they meet the driver.

Edge cases: null or empty texts have no passages, null or empty items no hits;
repeated rows give repeated hits; empty tables give an empty result; an item of few content terms keeps
all its words as terms. Ties don't matter, as every item near a passage is
checked; the cosine is 0 where passage and item share no term with weight. Other columns are ignored by ``hits`` and kept by ``remove_hits``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, prepare, table, text_rows
from .near_dup import node_of

WORD = re.compile(r"\w+")
#: A passage has 2 * STRIDE words and starts each STRIDE words.
STRIDE = 64
RANK = 96
OVERSAMPLE = 10
COSINE = 0.2
COVER = 0.7
COVER_WITH_ANSWER = 0.5
ANSWER = 4
#: An item part with fewer content terms keeps all its words, and must then be there nearly whole.
MIN_TERMS = 4
COVER_PLAIN = 0.95
#: Least content terms for the answer to count.
ANSWER_TERMS = 8
ITEMS = 20_000
#: Share of items above which a term is no content term, and of passages above which it has no weight in the latent space.
COMMON_ITEMS = 0.025
COMMON_PASSAGES = 0.01
SLICE = 40_000
#: Counts of (passages x parts) that are added up at a time.
CELLS = 2_000_000
SEED = 11


class Bench:
    """A block of benchmark items as sequences of content terms."""

    def __init__(self, items: list[tuple]):
        words = [(i, WORD.findall((t or "").lower())) for i, t in items]
        parts = [(i, w[at : at + STRIDE]) for i, w in words for at in range(0, len(w), STRIDE)]
        final = [at + STRIDE >= len(w) for _, w in words for at in range(0, len(w), STRIDE)]
        seen = Counter(x for _, w in words for x in set(w))
        limit = max(5, COMMON_ITEMS * len(items))
        content = {x for x, n in seen.items() if n <= limit}
        plain = {k for k, (_, w) in enumerate(parts) if sum(x in content for x in w) < MIN_TERMS}
        self.terms = {x: k for k, x in enumerate(sorted(content.union(*(parts[k][1] for k in plain))))}
        #: item, its terms, the cover it needs, and that which is enough with its answer
        self.parts = []
        for k, (i, w) in enumerate(parts):
            s = [self.terms[x] for x in w if x in content or k in plain]
            if s:
                least = COVER_PLAIN if k in plain else COVER
                self.parts.append((i, s, least, COVER_WITH_ANSWER if k not in plain and final[k] and len(s) >= ANSWER_TERMS else least))


def sparse_documents(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id, number of words, and places and numbers of its content terms (32-bit integers)."""
    held = docs.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([docs.schema["doc_id"], *fields(("words", T.LongType()), ("places", T.BinaryType()), ("terms", T.BinaryType())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for b in batches:
            n, places, numbers = [], [], []
            for t in b.column(1).to_pylist():
                words = WORD.findall(t.lower()) if t else []
                k = np.array([get(w, -1) for w in words], np.int32)
                at = np.flatnonzero(k >= 0).astype(np.int32)
                n.append(len(words))
                places.append(at.tobytes())
                numbers.append(k[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def passages(words: list[int], places: list[bytes], numbers: list[bytes], v: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage and term of each distinct pair (of terms with weight, if given), the row of each passage, and each row's first passage."""
    last = np.array([max(0, -(-w // STRIDE) - 2) for w in words], np.int64)
    base = np.cumsum(last + 1) - (last + 1)
    lengths = [len(p) // 4 for p in places]
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.frombuffer(b"".join(places), np.int32) // STRIDE
    term = np.frombuffer(b"".join(numbers), np.int32).astype(np.int64)
    if weight is not None:
        some = weight[term] > 0
        row, at, term = row[some], at[some], term[some]
    keys = []
    for shift in (0, 1):
        p = at - shift
        ok = (p >= 0) & (p <= last[row])
        keys.append((base[row[ok]] + p[ok]) * v + term[ok])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    win = key // v
    return win, key % v, np.searchsorted(base, np.arange(int(base[-1] + last[-1] + 1)) if len(base) else [], "right") - 1, base


def rows_of(win: np.ndarray) -> np.ndarray:
    """Where each passage's entries start."""
    return np.flatnonzero(np.r_[True, win[1:] != win[:-1]]) if len(win) else np.zeros(0, np.int64)


def slices(win: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of passages with about SLICE entries."""
    ends = np.r_[start[1:], len(win)]
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(ends, start[at] + SLICE, "right")))
        yield at, stop
        at = stop


def unit_rows(win: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with weight as passage, term and value, every passage of length one."""
    keep = idf[term] > 0
    win, term = win[keep], term[keep]
    val = idf[term]
    start = rows_of(win)
    if len(win):
        norm = np.sqrt(np.add.reduceat(val * val, start))
        val = val / np.repeat(norm, np.diff(np.r_[start, len(win)]))
    return win, term, val.astype(np.float32)


def projected(win: np.ndarray, term: np.ndarray, val: np.ndarray, basis: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """Slices of (passages, their entries, passages times basis)."""
    start = rows_of(win)
    for a, b in slices(win, start):
        e = slice(int(start[a]), int(start[b]) if b < len(start) else len(win))
        z = np.add.reduceat(val[e, None] * basis[term[e]], start[a:b] - start[a], axis=0)
        yield win[start[a:b]], e, z


def gram_times(sparse: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Sum over passages x of x (x' omega), for every document."""
    v, k = omega.shape
    spark = sparse.sparkSession
    held = spark.sparkContext.broadcast((idf, omega.astype(np.float32)))
    schema = fields(("m", T.BinaryType()))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, om = held.value
        total = np.zeros((v, k))
        for b in batches:
            win, term, _, _ = passages(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), v, weight)
            win, term, val = unit_rows(win, term, weight)
            for _, e, z in projected(win, term, val, om):
                w, t, x = win[e], term[e], val[e]
                nth = np.cumsum(np.r_[0, w[1:] != w[:-1]])
                order = np.argsort(t, kind="stable")
                first = rows_of(t[order])
                total[t[order][first]] += np.add.reduceat(x[order, None] * z[nth[order]], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v * k)
        for b in batches:
            for m in b.column(0).to_pylist():
                total += np.frombuffer(m, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["m"])

    groups = max(1, int(sparse.rdd.getNumPartitions() ** 0.5))
    shares = sparse.mapInArrow(share, schema).repartition(groups).mapInArrow(add, schema)
    total = np.zeros(v * k)
    for r in shares.toLocalIterator():
        total += np.frombuffer(r.m, np.float32)
    return total.reshape(v, k)


def passage_counts(sparse: DataFrame, v: int) -> tuple[int, np.ndarray]:
    """The number of passages, and of those with each term."""
    schema = fields(("term", T.LongType()), ("n", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v + 1, np.int64)
        for b in batches:
            words = b.column(1).to_pylist()
            _, term, _, _ = passages(words, b.column(2).to_pylist(), b.column(3).to_pylist(), v)
            total[:v] += np.bincount(term, minlength=v)
            total[v] += sum(max(1, -(-w // STRIDE) - 1) for w in words if w)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=schema.names)

    out = np.zeros(v + 1, np.int64)
    for r in sparse.mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return int(out[v]), out[:v]


def bench_rows(bench: Bench, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs = sorted({(i, t) for i, (_, s, _, _) in enumerate(bench.parts) for t in s})
    return unit_rows(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), idf)


def dense(win: np.ndarray, term: np.ndarray, val: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]), np.float32)
    for w, _, z in projected(win, term, val, basis):
        out[w] = z
    return out


def latent_basis(sparse: DataFrame, bench: Bench, idf: np.ndarray, count: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of corpus and benchmark passages."""
    v = len(idf)
    k = min(RANK + OVERSAMPLE, v)
    win, term, val = bench_rows(bench, idf)
    mass = max(1.0, count / max(1, len(bench.parts)))

    def both(m: np.ndarray) -> np.ndarray:
        z = dense(win, term, val, len(bench.parts), m.astype(np.float32))
        own = np.zeros((v, k))
        np.add.at(own, term, val[:, None].astype(float) * z[win])
        return gram_times(sparse, idf, m) + mass * own

    q, _ = np.linalg.qr(both(np.random.default_rng(SEED).standard_normal((v, k))))
    small = q.T @ both(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)][:, :RANK]).astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with a word of bits for ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def judge(passage: list[int], item: list[int]) -> tuple[float, bool]:
    """Share of the item that the passage has in order, and whether its answer is there."""
    answer = item[-ANSWER:]
    return common_subsequence(item, passage) / len(item), common_subsequence(answer, passage) == len(answer)


def index_of(bench: Bench, idf: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts whose terms without weight are enough for a hit (or all), the terms that a hit of each needs, and by term: where its entries start, their parts (by order) and counts."""
    which = np.array([c for c, (_, s, _, less) in enumerate(bench.parts) if every or sum(idf[t] <= 0 for t in s) >= less * len(s) - 1e-9], np.int64)
    need = np.array([bench.parts[c][3] * len(bench.parts[c][1]) for c in which])
    entries = sorted((t, k, n) for k, c in enumerate(which) for t, n in Counter(bench.parts[c][1]).items())
    term, part, times = np.array(entries, np.int64).reshape(-1, 3).T
    return which, need, np.searchsorted(term, np.arange(len(idf) + 1)), part, times


def shared_parts(win: np.ndarray, term: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Passage and part, in order of passages, where a passage has as many of an indexed part's terms as a hit needs."""
    which, need, first, part, times = index
    start = rows_of(win)
    step = max(1, CELLS // max(1, len(which)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(start) if len(which) else 0, step):
        rows = min(step, len(start) - a)
        e = slice(int(start[a]), int(start[a + rows]) if a + rows < len(start) else len(win))
        n = first[term[e] + 1] - first[term[e]]
        at = np.repeat(first[term[e]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        nth = np.repeat(np.cumsum(np.r_[0, win[e][1:] != win[e][:-1]]), n)
        held = np.bincount(nth * len(which) + part[at], times[at], rows * len(which)).reshape(rows, -1)
        r, c = np.nonzero(held >= need - 1e-9)
        out.append((win[start[a + r]], which[c]))
    return tuple(np.concatenate(x) for x in zip(*out))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)


def block_hits(docs: DataFrame, items: list[tuple], item_type: T.DataType, by_terms: bool = False) -> DataFrame:
    bench = Bench(items)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", item_type), *fields(("cosine", T.DoubleType()), ("cover", T.DoubleType()), ("answer", T.BooleanType())).fields])
    spark = docs.sparkSession
    if not bench.parts:
        return spark.createDataFrame([], schema)
    v = len(bench.terms)
    sparse = table(sparse_documents(docs, bench.terms), "bench-terms")
    count, df = passage_counts(sparse, v)
    idf = np.where(df <= max(20, COMMON_PASSAGES * count), np.log((count + 1) / (df + 1)) + 1, 0.0)
    index = index_of(bench, idf, by_terms)
    basis = latent_basis(sparse, bench, idf, count)
    latent = unit(dense(*bench_rows(bench, idf), len(bench.parts), basis))
    held = spark.sparkContext.broadcast((idf, basis, latent, bench.parts, index))
    names = schema.names
    id_type = pa.int64() if isinstance(docs.schema["doc_id"].dataType, T.LongType) else None
    item_arrow = pa.int64() if isinstance(item_type, T.LongType) else pa.int32() if isinstance(item_type, T.IntegerType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, space, targets, parts, by_term = held.value
        plain = np.ones(len(parts), bool)
        plain[by_term[0]] = False
        for b in batches:
            ids = b.column(0).to_pylist()
            words, places, numbers = (b.column(i).to_pylist() for i in (1, 2, 3))
            win, term, owner, base = passages(words, places, numbers, v)
            listed, part = shared_parts(win, term, by_term)
            cosine = np.zeros(len(listed), np.float32)
            win, term, val = unit_rows(win, term, weight)
            pairs: list[tuple[int, int, float]] = []
            for w, _, z in projected(win, term, val, space):
                near = unit(z) @ targets.T
                r, c = np.nonzero((near >= COSINE) & plain)
                pairs += zip(w[r].tolist(), c.tolist(), near[r, c].tolist())
                lo, hi = np.searchsorted(listed, [w[0], w[-1] + 1])
                r = np.searchsorted(w, listed[lo:hi])
                cosine[lo:hi] = np.where(w[r] == listed[lo:hi], near[r, part[lo:hi]], 0)
            pairs += zip(listed.tolist(), part.tolist(), cosine.tolist())
            best: dict[tuple[int, int], tuple[float, float, bool]] = {}
            cached: dict[int, tuple[list[int], set[int]]] = {}
            for p, c, cos in pairs:
                if p not in cached:
                    row = int(owner[p])
                    at = np.frombuffer(places[row], np.int32)
                    lo, hi = np.searchsorted(at, [(p - base[row]) * STRIDE, (p - base[row] + 2) * STRIDE])
                    terms = np.frombuffer(numbers[row], np.int32)[lo:hi].tolist()
                    cached[p] = terms, set(terms)
                item, target, least, less = parts[c]
                terms, held_terms = cached[p]
                # no subsequence is longer than the terms that both have
                if sum(map(held_terms.__contains__, target)) < less * len(target):
                    continue
                cover, answer = judge(terms, target)
                if cover >= least or cover >= less and answer:
                    key = (int(owner[p]), item)
                    best[key] = max(best.get(key, (0.0, 0.0, False)), (cover, cos, answer))
            got = [(ids[row], i, x[1], x[0], x[2]) for (row, i), x in best.items()]
            columns = list(zip(*got)) if got else [[]] * 5
            kinds = (id_type or b.column(0).type, item_arrow, pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return sparse.mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", by_terms: bool = False) -> DataFrame:
    """doc_id, item_id, cosine, cover and answer of every document that holds a benchmark item.

    ``by_terms`` takes as candidates all passages with enough terms of a part,
    whatever their cosine: slow and without loss, to measure the recall against.
    """
    prepare(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    wanted = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind = wanted.schema["item_id"].dataType
    out, block = None, []
    for r in wanted.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) >= ITEMS:
            found = block_hits(rows, block, kind, by_terms)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = block_hits(rows, block, kind, by_terms)
        out = found if out is None else out.unionByName(found)
    return out


def remove_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; the text decides, so rows without an id, or of one id, are told apart."""
    keyed = docs.withColumn("_own_node", node_of(F.col(text_col).cast("string")))
    found = table(hits(keyed, benchmark, "_own_node", text_col).select(F.col("doc_id").alias("_hit")).distinct(), "bench-hits")
    return keyed.join(found, keyed["_own_node"] == found["_hit"], "left_anti").drop("_own_node")
