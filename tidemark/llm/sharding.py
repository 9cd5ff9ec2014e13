"""Balanced shards: a minimax contiguous partition of ordered atomic groups.

Rows with equal text form one group that no cut may split; groups stand in the
order of their text's SHA-256. The smallest shard capacity for which a greedy
left-to-right filling needs no more than the wanted number of shards is found by
binary search, and the cuts are made where that filling makes them. A group at
least as large as an even share of what is left gets a shard to itself first, so
one huge group of copies doesn't empty the other shards.

The greedy check needs prefix sums of group sizes, but never all of them. The
driver holds cells of the hash space (a hex prefix, its bytes, its number of
groups). A check walks them with a lower and an upper bound for each cut; only
where these leave it open are the cells that the walk touched split by three
more hex digits, in one aggregation. At most 65,536 cells are fetched to begin
with and 4,096 for each cell split, whatever the number of groups, and the
result is exact.

Edge cases: a null text has no bytes (size 1) and belongs to the group of empty
texts; repeated rows are rows of one group; rows with a null doc_id are placed
like others; an empty table gives an empty result; with fewer groups than shards
some shards stay empty. Other columns are ignored.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, table, text_rows

SHARDS = 16
FIRST_DIGITS = 4
MORE_DIGITS = 3
#: Rows for each of the parts in which the rows of a shard are numbered.
SLOT_ROWS = 1 << 18


class Cells:
    """Sums of group sizes over hex-prefix cells, refined on demand."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.cells = self.fetch(groups, FIRST_DIGITS)
        self.index()

    @staticmethod
    def fetch(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        rows = groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return sorted((r.p, r.b, r.n) for r in rows)

    def index(self) -> None:
        self.start = [0, *accumulate(c[1] for c in self.cells)]
        self.total = self.start[-1]

    def split(self, at: set[int]) -> None:
        by_length: dict[int, list[str]] = {}
        for i in at:
            by_length.setdefault(len(self.cells[i][0]), []).append(self.cells[i][0])
        fine: list[tuple[str, int, int]] = []
        for length, prefixes in by_length.items():
            fine += self.fetch(self.groups.where(F.substring("key", 1, length).isin(prefixes)), length + MORE_DIGITS)
        gone = {self.cells[i][0] for i in at}
        self.cells = sorted([c for c in self.cells if c[0] not in gone] + fine)
        self.index()

    def step(self, x: int) -> tuple[int, int | None]:
        """The last known boundary at or before x, and the cell of several groups that x lies in, if it does."""
        if x >= self.total:
            return self.total, None
        i = bisect.bisect_right(self.start, x) - 1
        return self.start[i], i if self.start[i] < x and self.cells[i][2] > 1 else None

    def walk(self, capacity: int, shards: int) -> tuple[bool | None, set[int]]:
        """Whether ``shards`` of this capacity hold everything (None: open), and the cells to split if open."""
        low = high = 0
        touched: set[int] = set()
        for _ in range(shards):
            low, cell = self.step(low + capacity)
            if cell is not None:
                touched.add(cell)
            x = high + capacity
            edge, cell = self.step(x)
            if cell is None:
                high = edge
            else:
                high = x
                touched.add(cell)
        if low >= self.total:
            return True, set()
        return (False, set()) if high < self.total else (None, touched)

    def decide(self, capacity: int, shards: int) -> bool:
        while True:
            ok, touched = self.walk(capacity, shards)
            if ok is not None:
                return ok
            self.split(touched)

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """Keys at which a new shard begins."""
        out, x = [], 0
        for _ in range(shards - 1):
            x, cell = self.step(x + capacity)
            if x >= self.total:
                break
            out.append(self.cells[bisect.bisect_left(self.start, x)][0])
        return out


def smallest_capacity(cells: Cells, shards: int, largest: int) -> int:
    low = max(largest, -(-cells.total // shards))
    high = max(low, -(-cells.total // shards) + largest)
    while low < high:
        mid = (low + high) // 2
        if cells.decide(mid, shards):
            high = mid
        else:
            low = mid + 1
    cells.decide(low, shards)
    return low


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in each shard) and grown_shard of every row."""
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = table(
        text_rows(docs, id_col, text_col).select(
            "doc_id", F.sha2(text.cast("binary"), 256).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
        ),
        "shard-rows",
    )
    groups = table(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    top = [(r.key, r.bytes) for r in groups.orderBy(F.desc("bytes"), "key").limit(shards + 1).collect()]
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-rows.count() // SLOT_ROWS))
    alone: list[str] = []
    while len(alone) < min(shards - 1, len(top)) and top[len(alone)][1] * (shards - len(alone)) >= left:
        left -= top[len(alone)][1]
        alone.append(top[len(alone)][0])
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    cuts: list[str] = []
    if left:
        cells = Cells(rest)
        cuts = cells.cuts(smallest_capacity(cells, shards - len(alone), top[len(alone)][1]), shards - len(alone))
    at = F.lit(len(alone))
    for c in cuts:
        at = at + (F.col("key") >= c).cast("int")
    for i, key in enumerate(alone):
        at = F.when(F.col("key") == key, i).otherwise(at)
    placed = rows.withColumn("shard", at.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each quarter of a million rows or so
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("key", "doc_id")
    numbered = placed.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
