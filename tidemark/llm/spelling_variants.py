"""Groups of spelling variants by a trie self-join with active-node sets.

The vocabulary is dealt to tasks by the first letters of each word, so a task
holds a subtrie. A walk down the trie carries the active nodes of each node: all
nodes whose string is one insertion, deletion or replacement away. A child's are
its parent, its siblings, its own children, and the children by the same letter
of its parent's active nodes. Where a word ends, the active nodes at which a word
ends are its near words. A node is a range of the sorted words with a depth, so
a trie takes no more room than its words; below a node with a single word the
active nodes are followed by the rest of that word at once.

Two near words that differ behind their first ``least // 2`` letters share a
subtrie. All others share their last ones, and meet in a second trie over the
reversed words, which keeps pairs with different first letters only. A subtrie
of over ``GROUP`` words is cut again at twice the depth. An active node across
such a cut has spent its one edit, so its rest must be equal, and it is found by
an equi-join on the word without the letter at which the two differ; as many
words share such a key as there are letters, at most.

Edge cases: null and empty texts have no words; a null doc_id is the empty
string in the checksum that plants misspellings; ties between forms go to the
first word in code-point order. Repeated rows count again; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fields, prepare, table, text_rows

LETTERS = "A-Za-zÀ-ÿ"
LEAST = 6
OCCURRENCES = 5
#: A form has at least so many times the occurrences of its word.
RATIO = 5
#: Words in one subtrie.
GROUP = 20_000
#: Words that a task counts before it sends them on.
HELD = 100_000
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
COUNTS = fields(("word", T.StringType()), ("n", T.LongType()))
NEAR = fields(("word", T.StringType()), ("n_near", T.LongType()), ("near_n", T.LongType()), ("near", T.StringType()))


def words_of(doc_id, text: str, least: int, drop_every: int | None, runs: re.Pattern) -> Counter:
    """Occurrences of the words of one text of at least ``least`` letters; the checksum of id and word decides which lose a letter."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    folded: Counter = Counter()
    for raw, n in Counter(runs.findall(text)).items():
        folded[raw.lower() if raw.isascii() else raw.translate(LOWER)] += n
    if not drop_every:
        return folded
    for word, n in folded.items():
        h = zlib.crc32(word.encode(), seed)
        if h % drop_every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        out[word] += n
    return out


def count_words(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of the words that occur often enough in all texts together; A-Z are lower-cased.

    ``drop_every`` plants misspellings: if it divides the checksum h of
    "id:word", that word of that text loses its letter h % length.
    """
    prepare(docs.sparkSession)
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    total.update(words_of(doc_id, text, least, drop_every, runs))
                    if len(total) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=COUNTS.names)
                        total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=COUNTS.names)

    return text_rows(docs, id_col, text_col).mapInArrow(tally, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def near_in_trie(words: list[str], depth: int) -> Iterator[tuple[str, list[str]]]:
    """Each of these sorted distinct words, which share ``depth`` letters, with its near words among them."""

    def children(node: tuple[int, int, int]) -> Iterator[tuple[str, tuple[int, int, int]]]:
        lo, hi, d = node
        prefix = words[lo][:d]
        lo += len(words[lo]) == d
        while lo < hi:
            c = words[lo][d]
            end = bisect_left(words, prefix + chr(ord(c) + 1), lo, hi)
            yield c, (lo, end, d + 1)
            lo = end

    def child(node: tuple[int, int, int], c: str) -> tuple[int, int, int] | None:
        lo, hi, d = node
        prefix = words[lo][:d]
        a = bisect_left(words, prefix + c, lo, hi)
        if a == hi or words[a][d : d + 1] != c or not words[a].startswith(prefix):
            return None
        return a, bisect_left(words, prefix + chr(ord(c) + 1), a, hi), d + 1

    def ends(node: tuple[int, int, int]) -> bool:
        return len(words[node[0]]) == node[2]

    root = (0, len(words), depth)
    stack = [(root, {x for _, x in children(root)})] if words else []
    while stack:
        node, active = stack.pop()
        lo, hi, d = node
        if hi - lo == 1:
            word = words[lo]
            rest, near = word[d:], []
            for a, b, k in active:
                target = words[a][:k] + rest
                at = bisect_left(words, target, a, b)
                if at < b and words[at] == target and at != lo:
                    near.append(target)
            if near:
                yield word, near
            continue
        if ends(node) and (near := [words[a[0]] for a in active if ends(a)]):
            yield words[lo], near
        below = list(children(node))
        for c, down in below:
            mine = {x for a in active if (x := child(a, c)) is not None}
            mine.add(node)
            mine.update(x for _, x in below if x != down)
            mine.update(x for _, x in children(down))
            stack.append((down, mine))


def _turned(word: Column, reverse: bool) -> Column:
    return F.reverse(word) if reverse else word


def _trie_links(words: DataFrame, depth: int, reverse: bool, first: int) -> DataFrame:
    """NEAR rows of the words (word, s, n) whose turned string s shares its first ``depth`` letters; reversed ones with other first letters only."""

    def walk(rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
        n_of = dict(rows)
        for s, near in near_in_trie(sorted(n_of), depth):
            word = s[::-1] if reverse else s
            others = [(-n_of[x], x[::-1] if reverse else x) for x in near]
            if reverse:
                others = [o for o in others if o[1][:first] != word[:first]]
            if others:
                n, form = min(others)
                yield word, len(others), -n, form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=NEAR.names)

        key, rows = None, []
        for b in batches:
            found: list[tuple] = []
            for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s[:depth] != key:
                    if len(rows) > 1:
                        found += walk(rows)
                    key, rows = s[:depth], []
                rows.append((s, n))
            yield out(found)
        yield out(list(walk(rows)) if len(rows) > 1 else [])

    dealt = words.select("s", "n").repartition(F.substring("s", 1, depth)).sortWithinPartitions("s")
    return dealt.mapInArrow(run, NEAR)


def _cut_links(words: DataFrame, low: int, high: int, reverse: bool, first: int) -> DataFrame:
    """NEAR rows of pairs whose turned strings differ first at a place from ``low`` to ``high`` - 1.

    A word goes to the key of each such place: itself without the letter there,
    and itself whole, for the longer words that have one letter more there.
    """
    size = F.length("s")
    places = F.sequence(F.lit(low), F.least(F.lit(high - 1), size))
    spread = words.where(size >= low).select("word", "s", "n", F.explode(places).alias("place"))
    letter = F.expr("substring(s, place + 1, 1)")
    without = F.concat(F.expr("substring(s, 1, place)"), F.expr("substring(s, place + 2)"))
    # the longer word's letter there differs from its next one, else the two words would differ later
    last_of_equal = letter != F.expr("substring(s, place + 2, 1)")
    cut = F.struct(without.alias("rest"), F.lit(True).alias("cut"), last_of_equal.alias("shows"))
    whole = F.struct(F.col("s").alias("rest"), F.lit(False).alias("cut"), F.lit(False).alias("shows"))
    keyed = spread.select("word", "n", "place", F.inline(F.when(F.col("place") < size, F.array(cut, whole)).otherwise(F.array(whole))))
    member = F.struct((-F.col("n")).alias("minus_n"), "word", "cut", "shows")
    groups = keyed.groupBy("place", "rest").agg(F.collect_list(member).alias("members")).where("size(members) > 1")
    mine = groups.select(F.explode("members").alias("m"), "members")
    differs = (lambda x: F.substring(x["word"], 1, first) != F.substring(F.col("m.word"), 1, first)) if reverse else (lambda x: x["word"] != F.col("m.word"))
    meets = lambda x: x["cut"] & F.col("m.cut") | ~x["cut"] & F.col("m.shows") | x["shows"] & ~F.col("m.cut")
    others = mine.select(F.col("m.word").alias("word"), F.filter("members", lambda x: differs(x) & meets(x)).alias("others")).where("size(others) > 0")
    best = F.array_min(F.transform("others", lambda x: F.struct(x["minus_n"].alias("minus_n"), x["word"].alias("word"))))
    return others.select("word", F.size("others").cast("long").alias("n_near"), (-best["minus_n"]).alias("near_n"), best["word"].alias("near"))


def _links(words: DataFrame, first: int, reverse: bool, group: int) -> list[DataFrame]:
    """Parts of the links, by depth: subtries that are small enough, and the cuts through those that aren't."""
    left, depth, out = words.withColumn("s", _turned(F.col("word"), reverse)), first, []
    while True:
        key = F.substring("s", 1, depth)
        large = left.groupBy(key.alias("prefix")).count().where(F.col("count") > group).select("prefix")
        large = table(large, "large-subtries")
        if not large.head(1):
            discard(large)
            out.append(_trie_links(left, depth, reverse, first))
            return out
        hot = left.join(large, key == F.col("prefix"), "left_semi")
        out.append(_trie_links(left.join(large, key == F.col("prefix"), "left_anti"), depth, reverse, first))
        out.append(_cut_links(hot, depth, 2 * depth, reverse, first))
        left, depth = table(hot, "large-subtrie-words"), 2 * depth


def near_words(words: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """Of each word of ``words`` (word, n; distinct, of at least ``least`` letters) with a near one: n_near, and the near word of largest n with its n."""
    first = least // 2
    parts = _links(words, first, False, group) + _links(words, first, True, group)
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near"))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.minus_n")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form): forms are followed to the last, twice as far in each round.

    A form is more frequent than its word by a factor, so there are no cycles
    and the rounds are few.
    """
    at = table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = table(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(at)
        at = new
        if not at.where("moved").head(1):
            return at.select("word", "root")
        at = _without(at, "moved")


def _without(df: DataFrame, column: str) -> DataFrame:
    out = df.drop(column)
    out._tidemark_path = df._tidemark_path
    return out


def group_variants(words: DataFrame, least: int = LEAST, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n).

    A word's form is its near word of largest n, if that is ``ratio`` times the
    word's own or more; its root is the last form that can be reached.
    """
    prepare(words.sparkSession)
    held = table(words.select("word", "n"), "vocabulary")
    near = near_words(held, least, group)
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = table(
        held.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
        ),
        "variants",
    )
    end = roots(found.where("form is not null"))
    return found.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
