"""Near-duplicate classes by order MinHash, verified by banded alignment.

Equal texts are one node from the start. A node's five-word shingles are labelled
with their occurrence number; each of ``BANDS`` sketches takes the ``PICKED``
labelled shingles of least hash and keeps them in text order, so a band key
agrees when content and order do. In each bucket every node is paired with one
centre (another draw in each band), so pairs grow with members, not with their
square. Pairs are verified by aligning the shingle sequences: the longest common
subsequence among matches inside the band of offsets that the threshold allows
(Hunt-Szymanski over match points), and
similarity = common / (len a + len b - common), at least ``SIMILARITY``.

Verification runs in rounds. The first takes for each node the centre that it
shares most bands with. The second takes its other centres, unless links two
steps long already show both in one class. Then come the buckets that still hold
several components. Their nodes meet again by prefixes, which loses none: with
shingles in one order for all, rare ones first, two texts of the least
similarity share one of the first ``(1 - SIMILARITY) * n + 1`` of each. So a
passage that many hold brings nobody together, unless it is nearly all of a
text. ``CENTRE_ROUNDS`` times the holders of a shingle meet a centre of theirs;
then all pairs that are still of different components are verified if lengths
and places fit. Classes are connected components of the links; a class id is the
least doc_id in it. Exact copies are never expanded into pairs.

Edge cases: null and empty texts are one class; texts of under five words have
one shingle of all their words; rows with a null doc_id get the class of their
text (null if no other row has it); repeated rows give repeated results; an
empty table gives an empty result; long texts are aligned whole. Other columns
are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fields, prepare, table, text_rows

WORDS = 5
BANDS = 12
PICKED = 3
SIMILARITY = 0.8
#: Cells in which shingles are counted, to put the rare ones first.
CELLS = 1 << 18
#: Rounds in which the nodes of a prefix shingle meet one centre, so that fewer components are left for all pairs.
CENTRE_ROUNDS = 2
#: Match points per shingle beyond which the alignment goes row by row instead.
DENSE = 32
CACHE_WORDS = 300_000
#: Centres whose shingles a task keeps at hand.
CENTRES = 64

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SEEDS = np.random.default_rng(20240901).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Hashes of the five-word shingles in text order."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(_WORDS.__getitem__, words)), np.uint64)
    k = min(WORDS, len(w))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        h = w[:n].copy()
        for i in range(1, k):
            h = h * ODD + w[i : i + n]
        return mixed(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their occurrence number."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return h
    first = np.r_[True, s[1:] != s[:-1]]
    starts = np.flatnonzero(first)
    nth = np.arange(len(h)) - starts[np.cumsum(first) - 1]
    out = np.empty_like(h)
    out[order] = s + nth.astype(np.uint64) * ODD
    return mixed(out)


def sketch(h: np.ndarray) -> list[int]:
    """A band key for each sketch, as signed 64-bit integers."""
    if not len(h):
        return []
    x = labelled(h)
    n = min(PICKED, len(x))
    keys = []
    for band, seed in enumerate(SEEDS):
        v = x * seed
        at = np.argpartition(v, n - 1)[:n] if n < len(v) else np.arange(n)
        at.sort()
        keys.append(xxhash.xxh3_64_intdigest(x[at].tobytes(), seed=band) - (1 << 63))
    return keys


def prefix(h: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The first labelled shingles of a text, rare ones first, of which a text as similar as ``least`` has one among its own; and the text's length."""
    x = labelled(h)
    n = len(x)
    order = np.lexsort((x, counts[(x % np.uint64(CELLS)).astype(np.int64)]))
    return x[order[: n - int(np.ceil(least * n - 1e-9)) + 1]].view(np.int64), n


def common(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Length of the longest common subsequence whose matches have offsets of at most ``width``."""
    order = np.argsort(a, kind="stable")
    s = a[order]
    left, right = np.searchsorted(s, b, "left"), np.searchsorted(s, b, "right")
    count = right - left
    total = int(count.sum())
    if not total:
        return 0
    if total > DENSE * (len(a) + len(b)):
        return common_dense(a, b, width)
    j = np.repeat(np.arange(len(b)), count)
    within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    i = order[np.repeat(right, count) - 1 - within]  # for each place in b, places in a from the last to the first
    i = i[np.abs(i - j) <= width]
    if not len(i):
        return 0
    if len(i) == 1 or bool((np.diff(i) > 0).all()):
        return len(i)
    ends: list[int] = []
    for x in i.tolist():
        k = bisect.bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
        else:
            ends[k] = x
    return len(ends)


def common_dense(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """The same by dynamic programming over the band, a row of ``b`` at a time."""
    n = len(a)
    prev = np.zeros(n + 1, np.int32)
    for j in range(len(b)):
        low, high = max(0, j - width), min(n, j + width + 1)
        if low >= high:
            continue
        row = np.maximum(prev[low + 1 : high + 1], prev[low:high] + (a[low:high] == b[j]))
        row = np.maximum.accumulate(np.maximum(row, prev[low]))
        prev[low + 1 : high + 1] = row
        if high < n:
            prev[high + 1 :] = np.maximum(prev[high + 1 :], row[-1])
    return int(prev[-1])


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned similarity of two shingle sequences; exact where it is ``least`` or more."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    head = 0
    short = min(na, nb)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[na - rest :][::-1] != b[nb - rest :][::-1]) if rest else differ
    tail = 0 if not rest else int(differ[0]) if len(differ) else rest
    width = int((1 - 2 * least / (1 + least)) * (na + nb)) + 1
    same = head + tail
    x, y = a[head : na - tail], b[head : nb - tail]
    if len(x) and len(y):
        same += common(x, y, width)
    return same / (na + nb - same)


def node_of(text: str | Column) -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def nodes_and_sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node and band keys of every row."""
    rows = docs.select("doc_id", node_of("text").alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [sketch(shingles(t or "")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "keys"])

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


LINKS = fields(("a", T.BinaryType()), ("b", T.BinaryType()), ("linked", T.BooleanType()))


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b and whether they are similar; the texts meet the pairs by two joins."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    # members come last, so that the work is dealt by them and not by centres, of which a few may have most pairs
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        centres: dict[bytes, np.ndarray] = {}
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:  # rows come sorted by the member
                    last, own = a, shingles(ta.as_py() or "")
                if b not in centres:
                    if len(centres) >= CENTRES:
                        centres.clear()
                    centres[b] = shingles(tb.as_py() or "")
                out.append(similarity(own, centres[b], least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, LINKS)


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node) of every node that has a link: least labels spread along links and by jumps."""
    both = table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = spent = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("least"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        moved = table(lower.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("component"), (F.coalesce("further", "label") != F.col("old")).alias("changed")), "labels")
        discard(spent)
        spent, labels = moved, moved.select("node", "component")
        if moved.where("changed").isEmpty():
            discard(both)
            return labels


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links, found on the components that these join."""
    ca = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("further"))
    alone = joined.join(found.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), "component")
    return table(found.unionByName(alone).join(joined, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "near-components")


def mixed_nodes(members: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes in buckets that hold several components."""
    at = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    keys = at.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key")
    return at.join(keys, "key").select("node").distinct()


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many labelled shingles fall into each cell."""
    schema = fields(("n", T.BinaryType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for t in b.column(0):
                total += np.bincount((labelled(shingles(t.as_py() or "")) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for n in b.column(0).to_pylist():
                total += np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    groups = max(1, int(texts.rdd.getNumPartitions() ** 0.5))
    shares = texts.select("text").mapInArrow(count, schema).repartition(groups).mapInArrow(add, schema)
    return sum((np.frombuffer(r.n, np.int64) for r in shares.toLocalIterator()), np.zeros(CELLS, np.int64))


def prefixes(nodes: DataFrame, least: float) -> DataFrame:
    """key, at, node and n: the shingles in the prefix of each of ``nodes`` (node, text), their places in it, and the text's length."""
    held = nodes.sparkSession.sparkContext.broadcast(shingle_counts(nodes))
    schema = T.StructType([*fields(("node", T.BinaryType()), ("n", T.LongType())).fields, T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for b in batches:
            got = [prefix(shingles(t.as_py() or ""), counts, least) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([k for k, _ in got], pa.list_(pa.int64()))], names=schema.names)

    rows = nodes.select("node", "text").mapInArrow(run, schema)
    return rows.select("node", "n", F.posexplode("keys").alias("at", "key"))


def several(rows: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """The rows of keys that hold several components, with component, and a centre, its component, place and length.

    In the first turn the centre is the node in which the fewest shingles are
    rarer than the key: that with the least of its own, to which most are near.
    """
    at = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    draw = F.struct(F.when(F.lit(turn) == 1, F.col("at")), F.xxhash64("node", F.lit(turn)))
    keys = at.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min_by(F.struct("node", "component", "at", "n"), draw).alias("c")).where("c0 != c1")
    return at.join(keys.select("key", F.col("c.node").alias("b"), F.col("c.component").alias("cb"), F.col("c.at").alias("bt"), F.col("c.n").alias("nb")), "key")


def fitting(rows: DataFrame, least: float) -> DataFrame:
    """Pairs a (node) and b of different components that their lengths, and the places of a first common shingle, allow to be similar."""
    most = 1 + F.least(F.col("n") - 1 - F.col("at"), F.col("nb") - 1 - F.col("bt"))
    fits = (F.col("component") != F.col("cb")) & (F.least("n", "nb") >= F.lit(least - 1e-9) * F.greatest("n", "nb")) & (most >= F.lit(least / (1 + least) - 1e-9) * (F.col("n") + F.col("nb")))
    return rows.where(fits).select(F.col("node").alias("a"), "b").distinct()


def two_steps(links: DataFrame) -> DataFrame:
    """node and mark: the least node within a link, and of that again; equal marks mean one component."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("mark"))
    return one.join(one.select(F.col("node").alias("mark"), F.col("mark").alias("further")), "mark").select("node", F.col("further").alias("mark"))


def apart(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs whose nodes have different marks."""
    ma = marks.select(F.col("node").alias("a"), F.col("mark").alias("ma"))
    mb = marks.select(F.col("node").alias("b"), F.col("mark").alias("mb"))
    return pairs.join(ma, "a", "left").join(mb, "b", "left").where(F.coalesce("ma", "a") != F.coalesce("mb", "b")).select("a", "b")


def node_classes(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, component) of every node with a link."""
    rows = table(nodes_and_sketches(docs), "near-rows")
    nodes = rows.groupBy("node").agg(F.first("keys").alias("keys"))
    banded = table(nodes.select("node", F.explode("keys").alias("key")), "near-bands")
    # a key belongs to one band, so each band draws another centre
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", "key")).alias("centre")).where("size > 1").select("key", "centre")
    members = table(banded.join(buckets, "key"), "near-members")
    wanted = members.select("node").distinct()
    texts = table(docs.select(node_of("text").alias("node"), "text").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    # a the member and b the centre; a pair that occurs both ways counts once
    each = members.where(F.col("node") != F.col("centre")).groupBy(F.least("node", "centre").alias("x"), F.greatest("node", "centre").alias("y")).agg(F.count("*").alias("n"), F.first("node").alias("a"), F.first("centre").alias("b"))
    pairs = table(each.select("a", "b", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b")).alias("turn")), "near-pairs")
    done = table(verify(pairs.where("turn = 1"), texts, least), "near-links")
    links = done.where("linked").select("a", "b")
    rest = table(apart(pairs.where("turn > 1"), two_steps(links)), "near-pairs")
    second = table(verify(rest, texts, least), "near-links")
    done = done.unionByName(second)
    links = links.unionByName(second.where("linked").select("a", "b"))
    found = components(links)
    again = table(mixed_nodes(members, found).join(texts, "node"), "near-mixed")
    left = prefixes(again, least)
    for turn in range(1, CENTRE_ROUNDS + 2):
        left = table(several(left.select("key", "at", "node", "n"), found, turn), "near-prefixes")
        pairs = left
        if turn > CENTRE_ROUNDS:
            other = left.select("key", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("at").alias("bt"), F.col("n").alias("nb"))
            pairs = left.select("key", "at", "node", "n", "component").join(other, "key").where("node < b")
        seen = done.select("a", "b").union(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
        new = table(verify(fitting(pairs, least).join(seen, ["a", "b"], "left_anti"), again, least), "near-links")
        done = done.unionByName(new)
        linked = new.where("linked").select("a", "b")
        if not linked.isEmpty():
            found = merged(found, linked)
    return rows.select("doc_id", "node"), found


def classes(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row."""
    prepare(docs.sparkSession)
    rows, found = node_classes(text_rows(docs, id_col, text_col), least)
    least_id = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = least_id.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first")
    ids = placed.groupBy("component").agg(F.min("first").alias("class_id"))
    by_node = placed.join(ids, "component").select("node", "class_id")
    return rows.join(by_node, "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its least doc_id, and of several texts of that id the least node's.

    Rows without an id go unless their whole class has none; then one of the least node stays.
    """
    prepare(docs.sparkSession)
    rows, found = node_classes(text_rows(docs, id_col, text_col), least)
    placed = rows.join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias("_keep_id"), F.col("k.node").alias("_keep_node"))
    named = docs.withColumn("_own_node", node_of(F.col(text_col).cast("string")))
    kept = named.join(best, (F.col("_own_node") == F.col("_keep_node")) & named[id_col].eqNullSafe(F.col("_keep_id")), "left_semi")
    return kept.dropDuplicates([id_col, "_own_node"]).drop("_own_node")
