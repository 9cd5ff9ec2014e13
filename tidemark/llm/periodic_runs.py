"""Periodic runs of words by bit-parallel lags.

The word numbers of a text are held as bit planes, one big integer a bit. For
each lag q, XOR of every plane with itself shifted by q, and OR over the planes,
marks the places whose word differs from the word q further on. AND of the
matches with themselves, shifted by 1, 2, 4 and so on, leaves the starts of
stretches that are long enough. Most lags end after a plane or two, as no long
stretch is left by then.

A run is a maximal stretch with smallest period q and at least ``LEAST`` words
and ``TIMES`` periods. A stretch that has a smaller period too is the run of
that period, which was found before, as two periods of so long a stretch have
their greatest common divisor as a period.

Edge cases: a null or empty text, or one of white space, has no words and no
runs, and its longest run is null; of runs of equal length the first is the
longest, then the one of smaller period. A text of n words costs n * n / 256
word operations for each plane that a lag needs, and memory for its own words
only. Repeated rows give repeated results, empty tables an empty result, and
other columns are ignored; ``plant_repeats`` leaves rows without an id as they
are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, prepare, text_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 6
TIMES = 4
RUN = fields(("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()))
SCHEMA = fields(("doc_id", T.LongType()), ("n_words", T.LongType()), ("runs", T.ArrayType(RUN, False)), ("collapsed", T.StringType()))


def bit_planes(numbers: np.ndarray) -> list[int]:
    """One integer for each bit of the numbers, with bit i that of the i-th number; the planes that split them best come first."""
    planes = []
    for b in range(int(numbers.max(initial=0)).bit_length()):
        bits = np.packbits(((numbers >> b) & 1).astype(np.uint8), bitorder="little")
        planes.append(int.from_bytes(bits.tobytes(), "little"))
    return sorted(planes, key=lambda p: abs(2 * p.bit_count() - len(numbers)))


def stretches(starts: int, width: int) -> Iterator[tuple[int, int]]:
    """First place and length of each stretch of ones."""
    bits = np.unpackbits(np.frombuffer(starts.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.r_[0, bits.astype(np.int8), 0]))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


def runs_of(words: list[str], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start and then by period."""
    n, number = len(words), {}
    planes = bit_planes(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
    found: dict[tuple[int, int], int] = {}
    for q in range(1, n // times + 1):
        need = max(least, times * q) - q
        width = n - q
        if need > width:
            break
        full = (1 << width) - 1
        differ, at, starts = 0, 0, 0
        while True:
            if at < len(planes):
                p = planes[at]
                differ |= p ^ (p >> q)
                at += 1
            starts, held = full & ~differ, 1
            while held < need and starts:
                step = min(held, need - held)
                starts &= starts >> step
                held += step
            if not starts or at >= len(planes):
                break
        if starts:
            for start, length in stretches(starts, width):
                found.setdefault((start, length + need - 1 + q), q)
        if len(planes) == 0:
            break  # all words are equal, so every further lag gives the same stretch
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that repeat a run's first period."""
    if not runs:
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start and period) and the collapsed text of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.field("element", pa.struct([pa.field(f.name, pa.int64()) for f in RUN.fields]), nullable=False))
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                n, runs, texts = [], [], []
                for t in part.column(1).to_pylist():
                    words = WORD.findall(t) if t else []
                    own = runs_of(words, least, times)
                    n.append(len(words))
                    runs.append([dict(zip(RUN.names, r)) for r in own])
                    texts.append(collapse(words, own))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=SCHEMA.names)

    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *SCHEMA.fields[1:]])
    return rows.mapInArrow(run, schema)


def plant_repeats(docs: DataFrame, every: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where about one in ``every`` texts is made periodic from some word on; the id's checksum h decides.

    If ``every`` divides h, then with n words and g = h div ``every``, the words
    from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8) words from a.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / every).cast("long")

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        block = F.slice(words, a + 1, p)
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)), " ")

    some = F.col("text").isNotNull() & F.col("text").rlike(WORD.pattern)
    words = F.array(F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0)))
    return text_rows(docs, id_col, text_col).select("doc_id", F.when(some & (h % every == 0), F.transform(words, rewritten)[0]).otherwise(F.col("text")).alias("text"))


def summaries(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run, and digests of the runs and of the collapsed text."""
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    with_best = found.withColumn("_best", order)
    length, period = F.col("_best.length"), -F.col("_best.p")
    return with_best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
