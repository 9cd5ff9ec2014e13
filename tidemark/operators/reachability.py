"""Connected components, strong components and cycles of graphs of any size, as joins over an edge table.

A graph's nodes are (group, node) pairs, so the graphs of all repositories are
searched together. Every round is
cut from the last by a table in the checkpoint folder. A hub's
edges are joined in parts: values of a node with over a thousandth of all edges
are copied for ``SALTS`` parts, and its edges are dealt among them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a hub's edges, and the edges from which a node may be a hub.
SALTS = 64
HUB = 100_000

#: Edges in or out of a node that is replaced by edges.
FEW = 64

#: The part of the edges that a round of replacing nodes may leave for another to follow.
KEPT = 0.8

#: Edges that labels follow between two tables.
HOPS = 2


def ensure_checkpoints(df: DataFrame) -> None:
    """Set the checkpoint folder to spark.checkpoint.dir where it is not set yet; only local mode may lack that."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if where is None:
            import tempfile

            where = "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoints-")
        sc.setCheckpointDir(where)


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, which cuts lineage and what the optimiser carries along; the tables ``spent`` are deleted then."""
    ensure_checkpoints(df)
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_cut = path
    for x in spent:
        if (old := getattr(x, "_tidemark_cut", None)) is not None:
            old = jvm.org.apache.hadoop.fs.Path(old)
            old.getFileSystem(conf).delete(old, True)
    return out


def hubs(rows: DataFrame, key: str, total: int, hub: int = HUB) -> list:
    """Keys of more than ``hub`` of the ``total`` rows and of a thousandth of them, so fewer than a thousand."""
    if total <= hub:
        return []
    counts = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return [r.key for r in counts.where(F.col("n") > max(hub, total // 1000)).collect()]


def join_values(rows: DataFrame, key: str, other: str, values: DataFrame, of: str, heavy: list, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of ``values`` whose ``of`` is their ``key``; rows of a heavy key are dealt out by ``other``."""
    if not heavy:
        return rows.join(values.withColumnRenamed(of, key), key, how)
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(k,) for k in heavy], f"_hub {rows.schema[key].dataType.simpleString()}"))  # fewer than a thousand
    parts = F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(table, F.col(key) == F.col("_hub"), "left").withColumn("_part", parts).drop("_hub")
    copies = F.when(F.col("_hub").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = values.join(table, F.col(of) == F.col("_hub"), "left").withColumn("_part", F.explode(copies)).drop("_hub").withColumnRenamed(of, key)
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame, a: str, b: str, hub: int = HUB) -> DataFrame:
    """node and component (its least node) of every node of ``edges``, by alternating large and small stars.

    A large star links a node's greater neighbours to the least node near it, a
    small star the lesser ones; both keep what is connected, and after a number
    of rounds that is logarithmic in the nodes every node is linked to the least
    of its component. Rows with a null end are left out.
    """
    ensure_checkpoints(edges)
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    ends = cut(ends.select(F.greatest("u", "v").alias("high"), F.least("u", "v").alias("low")).distinct())
    links = ends.where("high != low")
    mark = _mark(links)
    while mark[0]:
        near = links.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(links.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # a node's greater neighbours are the high ends of the links in which it is the low one
        large = join_values(links, "low", "high", least, "u", hubs(links, "low", mark[0], hub)).select("high", F.col("m").alias("low")).distinct()
        centre = large.groupBy("high").agg(F.min("low").alias("m"))
        spread = join_values(large, "high", "low", centre, "high", hubs(large, "high", mark[0], hub)).select(F.inline(F.array(F.struct(F.col("high"), F.col("m").alias("low")), F.struct(F.col("low").alias("high"), F.col("m").alias("low")))))
        links = cut(spread.where("high != low").distinct(), links)
        if mark == (mark := _mark(links)):
            break
    nodes = ends.select(F.explode(F.array("high", "low")).alias("node")).distinct()
    return nodes.join(links.select(F.col("high").alias("node"), "low"), "node", "left").select("node", F.coalesce("low", "node").alias("component"))


# --- strong components


def _least_label(nodes: DataFrame, edges: DataFrame, a: str, b: str, heavy: list, hub: int) -> DataFrame:
    """node and label, the least label among the nodes from which edges a -> b lead to it, and its own.

    Labels are checksums before names. That order is as good as random, so a
    label's own label reaches further by a factor in each round. A round follows
    ``HOPS`` edges before that, as its fixed costs are the most of a small graph's.
    """
    labels, total = nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node")).alias("label")), nodes.count()
    steps = edges.select(a, b).unionAll(nodes.select(F.col("node").alias(a), F.col("node").alias(b)))
    mark, held = None, ()
    while True:
        near = labels
        for _ in range(HOPS):
            near = join_values(steps, a, b, near, "node", heavy).groupBy(F.col(b).alias("node")).agg(F.min("label").alias("label"))
        pointers = near.withColumn("_at", F.col("label.node"))
        further = labels.where("label.node != node").select(F.col("node").alias("_own"), F.col("label").alias("further"))
        # many nodes have one label
        jumped = join_values(pointers, "_at", "node", further, "_own", hubs(pointers, "_at", total, hub), "left")
        labels = cut(jumped.select("node", F.least("label", F.coalesce("further", "label")).alias("label")), *held)
        held = (labels,)
        if mark == (mark := _mark(labels)):
            return labels


def _eliminate(left: DataFrame, salt: int, out_heavy: list, in_heavy: list) -> tuple[DataFrame, DataFrame]:
    """``left`` without nodes that few edges replace, and the edges a -> b of those nodes; ``ka`` or ``kb`` says which end went.

    Nodes without an edge in or out lie on no cycle and go at once. A node whose
    edges in times edges out are no more than its edges goes if its random number
    is the least among its neighbours, so no two neighbours go; an edge from each
    node before it to each node behind it keeps what reaches what.
    """
    chance = lambda c: F.xxhash64(F.lit(salt), c)
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(0).alias("into"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), F.lit(1).alias("into"), F.lit(0).alias("out")))
    degree = left.select(F.inline(ends)).groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out"), F.min(chance("other")).alias("nearest"))
    few = (F.col("into") * F.col("out") <= F.col("into") + F.col("out")) & (F.greatest("into", "out") <= FEW) & (chance("node") < F.col("nearest"))
    gone = degree.select("node", F.when(F.least("into", "out") == 0, "trimmed").when(few, "replaced").alias("k")).where("k is not null")
    told = join_values(left, "a", "b", gone.withColumnRenamed("k", "ka"), "node", out_heavy, "left")
    told = cut(join_values(told, "b", "a", gone.withColumnRenamed("k", "kb"), "node", in_heavy, "left").where("coalesce(ka, '') != 'trimmed' and coalesce(kb, '') != 'trimmed'").select("a", "b", "ka", "kb"), left)
    before, behind = told.where("kb is not null").select("a", F.col("b").alias("node")), told.where("ka is not null").select(F.col("a").alias("node"), "b")
    kept = told.where("ka is null and kb is null").select("a", "b").unionAll(before.join(behind, "node").where("a != b").select("a", "b"))
    return cut(kept.distinct()), told


def _restore(told: DataFrame, whole: DataFrame) -> DataFrame:
    """``whole`` (node and label) with the nodes of ``told``: a node lies in a component that has nodes both before and behind it."""
    sides = F.when(F.col("kb").isNotNull(), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), F.lit(True).alias("before"))).otherwise(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(False).alias("before")))
    near = told.where("ka is not null or kb is not null").select(F.inline(F.array(sides)))
    of = near.join(whole.select(F.col("node").alias("other"), "label"), "other", "left").withColumn("label", F.coalesce("label", "other"))
    both = of.groupBy("node", "label").agg(F.min("before").alias("low"), F.max("before").alias("high")).where("low != high").select("node", "label")
    return cut(whole.unionAll(both), whole, told)


def strong_components(edges: DataFrame, group: str, hub: int = HUB) -> DataFrame:
    """group, module and component (its least module) of the strongly connected components of each graph, single modules left out.

    Nodes that few edges replace go first, round by round while that makes the
    graph a fifth smaller, which leaves a graph of short ways. Each of its nodes
    takes the least label that reaches it; within the nodes of one label those
    that reach that label's node are its component. Edges between labels lie in
    no component, and the rest is searched again. The nodes that went are put
    back last round first. Null groups and names are left out.
    """
    ensure_checkpoints(edges)
    spark, kinds = edges.sparkSession, dict(edges.dtypes)
    named = cut(edges.where(f"{group} is not null and src is not null and dst is not null and src != dst").select(group, "src", "dst").distinct())
    total = named.count()
    names = cut(named.select(group, F.explode(F.array("src", "dst")).alias("module")).distinct().withColumn("id", F.monotonically_increasing_id()))
    numbered = named.select(F.struct(group, "src").alias("_src"), F.struct(group, "dst").alias("_dst"))
    number = lambda c: names.select(F.struct(F.col(group), F.col("module").alias(c[1:])).alias(c), F.col("id").alias(f"{c}_id"))
    for c, other in (("_src", "_dst"), ("_dst", "_src")):
        numbered = join_values(numbered, c, other, number(c), c, hubs(numbered, c, total, hub))
    left = cut(numbered.select(F.col("_src_id").alias("a"), F.col("_dst_id").alias("b")), named)
    went, salt = [], 0
    whole = spark.createDataFrame([], "node long, label long")
    while total:
        out_heavy, in_heavy = hubs(left, "a", total, hub), hubs(left, "b", total, hub)
        while total:
            left, told = _eliminate(left, salt, out_heavy, in_heavy)
            went.append(told)
            total, before, salt = left.count(), total, salt + 1
            if total > KEPT * before:
                break
        if not total:
            break
        both = cut(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        out_heavy, in_heavy = hubs(left, "a", total, hub), hubs(left, "b", total, hub)
        colour = _least_label(both, left, "a", "b", out_heavy, hub)
        ends = join_values(left, "a", "b", colour.withColumnRenamed("label", "la"), "node", out_heavy)
        inside = cut(join_values(ends, "b", "a", colour.withColumnRenamed("label", "lb"), "node", in_heavy).where("la = lb").select("a", "b"), left)
        back = _least_label(both, inside, "b", "a", in_heavy, hub).withColumnRenamed("label", "back")
        found = cut(colour.join(back, "node").where("label = back").select("node", F.col("label.node").alias("label")), colour, back)
        # an edge between nodes of one label either lies in the component, or both or one of its ends are not done yet
        rest = both.join(found.select("node"), "node", "left_anti")
        left = inside.join(rest.withColumnRenamed("node", "a"), "a", "left_semi").join(rest.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
        left = cut(left, inside, both)
        whole = whole.unionAll(found.where("node != label"))
        total = left.count()
    whole = cut(whole)
    for told in reversed(went):
        whole = _restore(told, whole)
    whole = whole.unionAll(whole.select(F.col("label").alias("node"), "label").distinct())
    of = cut(whole.join(names.withColumnRenamed("id", "node"), "node").select(group, "module", "label"), whole)
    least = of.groupBy("label").agg(F.min("module").alias("component"))
    return of.join(least, "label").select(F.col(group).cast(kinds[group]), "module", "component")


# --- cycles


def bounded_cycles(edges: DataFrame, group: str, depth: int, limit: int, hub: int = HUB) -> DataFrame:
    """group, cycle and length of the elementary cycles of each graph, from their least member, shortest first, at most ``limit`` a graph.

    Lengths are tried one after the other. Cycles of two are pairs that edges
    join both ways, so graphs with ``limit`` of them need no strong components.
    A longer path starts at its least node and is extended by one edge a join,
    inside a strong component, to nodes that can still reach the start in the
    steps that are left; the table of those grows by one step for each length. Graphs that have their ``limit`` take no part in
    longer searches: the limit is the report's, and what it leaves out are longer
    cycles, or later ones of the same length.
    """
    ensure_checkpoints(edges)
    ways = [F.max(F.col("src") < F.col("dst")).alias("up"), F.max(F.col("src") > F.col("dst")).alias("down")]
    sides = cut(edges.where(f"{group} is not null and src != dst").groupBy(group, F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).agg(*ways))
    out = _first(sides.where("up and down").select(group, F.array("low", "high").alias("path")), group, limit, None)
    found, full = _full(out, group, limit)
    if full is not None:
        sides = cut(sides.join(full, group, "left_anti"), sides)
    if depth == 2 or not sides.head(1):
        return out
    both = F.array(F.when(F.col("up"), F.struct(F.col("low").alias("src"), F.col("high").alias("dst"))), F.when(F.col("down"), F.struct(F.col("high").alias("src"), F.col("low").alias("dst"))))
    pairs = sides.select(group, F.inline(F.array_compact(both)))
    parts = strong_components(pairs, group, hub)
    member = lambda c, name: parts.select(group, F.col("module").alias(c), F.col("component").alias(name))
    inside = cut(pairs.join(member("src", "c"), [group, "src"]).join(member("dst", "d"), [group, "dst"]).where("c = d").select(group, "src", "dst"), sides)
    # of each start: the nodes above it from which it can be reached, and in how many steps
    reach = inside.where("src > dst").select(group, F.col("dst").alias("start"), F.col("src").alias("node"), F.lit(1).alias("steps"))
    reach = cut(reach)
    edge = reach
    for length in range(3, depth + 1):
        if not inside.head(1):
            break
        back = edge.join(inside.withColumnRenamed("dst", "node"), [group, "node"]).where("src > start").select(group, "start", F.col("src").alias("node")).distinct()
        edge = cut(back.join(reach, [group, "start", "node"], "left_anti").withColumn("steps", F.lit(length - 1)))
        reach = reach.unionAll(edge)
        usable = lambda left: reach.where(F.col("steps") <= left).select(group, "start", F.col("node").alias("dst"))
        path = inside.where("dst > src").withColumnRenamed("src", "start").join(usable(length - 1), [group, "start", "dst"]).select(group, "start", F.col("dst").alias("src"), F.array("start", "dst").alias("path"))
        for k in range(2, length):
            path = path.join(inside, [group, "src"]).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
            path = path.join(usable(length - k), [group, "start", "dst"]).select(group, "start", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"))
        out = out.unionAll(_first(path.select(group, "path"), group, limit, found))
        if length < depth:
            found, full = _full(out, group, limit)
            if full is not None:
                inside, reach, edge = (cut(x.join(full, group, "left_anti")) for x in (inside, reach, edge))
    return out


def _first(paths: DataFrame, group: str, limit: int, found: DataFrame | None) -> DataFrame:
    """The first ``paths`` of each graph as cycles, as many as ``limit`` leaves beside those already ``found``."""
    room = F.lit(limit)
    if found is not None:
        paths = paths.join(found, group, "left")
        room = F.lit(limit) - F.coalesce("had", F.lit(0))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("path"))
    ranked = paths.withColumn("nth", nth).where(F.col("nth") <= limit).where(F.col("nth") <= room)
    return cut(ranked.select(group, F.array_join("path", "->").alias("cycle"), F.size("path").cast("long").alias("length")))


def _full(out: DataFrame, group: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Cycles of each graph so far, and the graphs that have their limit, None where none has."""
    found = out.groupBy(group).agg(F.count("*").alias("had"))
    full = found.where(F.col("had") >= limit).select(group)
    return found, full if full.head(1) else None
