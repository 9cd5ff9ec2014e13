"""Duplicates, clusters and module graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reachability
from .reachability import connected_components, ensure_checkpoints, strong_components  # noqa: F401

# Fixed values of the duplicate and cycle rules.
BUCKET = 6
MIN_SIMILARITY = 0.85
MAX_DEPTH = 10
MAX_CYCLES = 100


def exact_duplicates(functions: DataFrame, key: str, member: str) -> DataFrame:
    """Star edges from the least member of each group to the others; all that connectivity needs."""
    low = functions.groupBy(key).agg(F.min(member).alias("representative"), F.count("*").alias("members")).where("members >= 2")
    return functions.join(low, key).where(F.col(member) != F.col("representative")).select("representative", F.col(member).alias("member"))


def size_classes(functions: DataFrame, size: str, member: str, same: list[str]) -> DataFrame:
    """Functions of equal ``same`` columns and size as one row: its representative (the least member) and how many there are."""
    return functions.groupBy(*same, F.col(size).alias("size")).agg(F.min(member).alias("representative"), F.count("*").alias("members"))


def size_class_members(functions: DataFrame, size: str, member: str, same: list[str]) -> DataFrame:
    """Each member with the representative that stands for it in pairs."""
    classes = size_classes(functions, size, member, same).withColumnRenamed("size", size)
    return functions.select(F.col(member).alias("member"), *same, size).join(classes, [*same, size]).select("member", "representative")


def _class_pairs(classes: DataFrame, same: list[str], band: Column) -> DataFrame:
    """Pairs of classes in the same or neighbouring bands, and each class of several with itself.

    Each row goes to its band and the next, which makes it an equi-join; a pair
    in neighbouring bands meets once, in the higher of them.
    """
    left = classes.select(*same, F.col("representative").alias("l"), F.col("size").alias("size_l"), F.col("members").alias("n_l"), band.alias("band"), band.alias("own_l"))
    right = classes.select(*same, F.col("representative").alias("r"), F.col("size").alias("size_r"), F.col("members").alias("n_r"), F.explode(F.array(band, band + 1)).alias("band"), band.alias("own_r"))
    pair = left.join(right, [*same, "band"]).where((F.col("own_l") != F.col("own_r")) | (F.col("l") < F.col("r")) | (F.col("l") == F.col("r")) & (F.col("n_l") > 1))
    bound = 2.0 * F.least("size_l", "size_r") / (F.col("size_l") + F.col("size_r"))
    first = F.col("l") <= F.col("r")
    n_a, n_b = F.when(first, F.col("n_l")).otherwise(F.col("n_r")), F.when(first, F.col("n_r")).otherwise(F.col("n_l"))
    return pair.where(bound >= MIN_SIMILARITY).select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), n_a.alias("n_a"), n_b.alias("n_b"), F.round(bound, 6).alias("bound"))


def similar_candidates(functions: DataFrame, size: str, member: str, same: list[str]) -> DataFrame:
    """Class pairs whose size buckets are at most one apart and whose lengths allow the similarity.

    Members of equal size are one class (``size_class_members`` says which), so
    a hot bucket's pairs grow with its sizes, not with its members.
    """
    return _class_pairs(size_classes(functions, size, member, same), same, F.floor(F.col("size") / BUCKET))


def length_bound_pairs(functions: DataFrame, size: str, member: str, same: list[str]) -> DataFrame:
    """Class pairs whose lengths allow the similarity, whatever their buckets; bands grow with the size."""
    ratio = (2 - MIN_SIMILARITY) / MIN_SIMILARITY
    return _class_pairs(size_classes(functions.where(F.col(size) > 0), size, member, same), same, F.floor(F.log(F.col("size") + F.lit(0.0)) / F.lit(math.log(ratio * 1.0001))))


def cluster_summary(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each component: representative, size, files, mean similarity of its member pairs (1.0 for pairs not compared) and rule.

    ``members`` has (component, node, file, name, line_start), ``pairs`` (a, b, similarity).
    The mean needs the number of pairs and the sum over compared ones only, so pairs are never expanded.
    """
    m = members.select("component", "node")
    known = pairs.join(m.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.sum(1.0 - F.col("similarity")).alias("lost"), F.min("similarity").alias("least"))
    out = members.groupBy("component").agg(F.min_by("node", F.struct("file", "line_start", "name")).alias("representative"), F.count("*").alias("members"), F.count_distinct("file").alias("files"))
    n_pairs = F.col("members") * (F.col("members") - 1) / 2
    exact = F.coalesce("least", F.lit(1.0)) >= 0.999
    rule = F.when(F.col("members") >= 3, "ENT-DUP-005").when(F.col("files") > 1, "ENT-DUP-004").when(exact, "ENT-DUP-001").otherwise("ENT-DUP-002")
    return out.join(known, "component", "left").select("component", "representative", "members", "files", F.round(1.0 - F.coalesce("lost", F.lit(0.0)) / n_pairs, 6).alias("avg_similarity"), exact.alias("is_exact"), rule.alias("rule_id"))


def boilerplate(functions: DataFrame, shape: str, member: str, file: str, clustered: DataFrame) -> DataFrame:
    """Shapes of three or more functions in two or more files, counted again without those already in clusters."""
    first = functions.groupBy(shape).agg(F.count("*").alias("n"), F.count_distinct(file).alias("f")).where("n >= 3 and f >= 2").select(shape)
    left = functions.join(first, shape, "left_semi").join(clustered.select(F.col("node").alias(member)), member, "left_anti")
    return left.groupBy(shape).agg(F.count("*").alias("members"), F.count_distinct(file).alias("files")).where("members >= 3")


def degrees(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct modules in and out of each, zero where none."""
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("fan_out")), e.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("fan_in"))
    return modules.select("module").join(out, "module", "left").join(into, "module", "left").na.fill(0, ["fan_in", "fan_out"])


def bounded_cycles(edges: DataFrame, group: str, depth: int = MAX_DEPTH, limit: int = MAX_CYCLES) -> DataFrame:
    """Elementary cycles of each graph, rotated to their least member, shortest first, at most ``limit`` a graph."""
    return reachability.bounded_cycles(edges, group, depth, limit)


def with_layers(edges: DataFrame, modules: DataFrame) -> DataFrame:
    a = modules.select(F.col("module").alias("src"), F.col("layer").alias("src_layer"))
    b = modules.select(F.col("module").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.join(a, "src").join(b, "dst")


def layer_violations(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """API modules that reach a repository module directly."""
    return with_layers(edges, modules).where("src_layer = 'api' and dst_layer = 'repository'").groupBy("src").agg(F.count_distinct("dst").alias("n_repositories"))


def cross_layer_coupling(edges: DataFrame, modules: DataFrame, least: int = 4) -> DataFrame:
    """Modules that depend on ``least`` layers or more; composition roots are exempt."""
    roots = modules.where("is_composition_root").select(F.col("module").alias("src"))
    return with_layers(edges, modules).join(roots, "src", "left_anti").groupBy("src").agg(F.count_distinct("dst_layer").alias("n_layers")).where(F.col("n_layers") >= least)


def dominant_pattern(modules: DataFrame, edges: DataFrame, share: float = 0.65, least: int = 3) -> DataFrame:
    """API modules that don't use services where most do."""
    uses = with_layers(edges, modules).where("dst_layer = 'service'").select(F.col("src").alias("module")).distinct().withColumn("u", F.lit(1))
    api = modules.where("layer = 'api'").join(uses, "module", "left").select("module", F.coalesce("u", F.lit(0)).alias("u"))
    rate = F.broadcast(api.agg(F.avg("u").alias("rate"), F.count("*").alias("n")))  # one row
    return api.join(rate, (F.col("n") >= least) & (F.col("rate") >= share) & (F.col("u") == 0)).select("module", F.round("rate", 6).alias("rate"))


def god_objects(members: DataFrame, owner: str, member: str, domain: str, least_members: int, least_domains: int) -> DataFrame:
    out = members.groupBy(owner).agg(F.count_distinct(member).alias("n_members"), F.count_distinct(domain).alias("n_domains"))
    return out.where((F.col("n_members") >= least_members) & (F.col("n_domains") >= least_domains))


def layer_of(path: Column) -> Column:
    """The first layer whose words the path has, in the fixed order."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"(^|/)(api|routes?|controllers?|endpoints?|views)(/|\.|$)"), "api")
        .when(p.rlike(r"(^|/)(repositor(y|ies)|dao|persistence)(/|\.|$)"), "repository")
        .when(p.rlike(r"(^|/)(models?|entit(y|ies)|schemas?|domain)(/|\.|$)"), "model")
        .when(p.rlike(r"(^|/)(services?|usecases?)(/|\.|$)"), "service")
        .when(p.rlike(r"(^|/)(config|settings)(/|\.|$)"), "config")
        .when(p.rlike(r"(^|/)(security|auth)(/|\.|$)"), "security")
        .when(p.rlike(r"(^|/)(utils?|helpers?|common)(/|\.|$)"), "utility")
        .otherwise("unknown")
    )


def module_edges(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports resolved by alias; the alias registered last wins.

    ``imports`` has (src, name), ``aliases`` (name, module, ord).
    """
    last = aliases.groupBy("name").agg(F.max_by("module", F.struct("ord", "module")).alias("dst"))
    return imports.join(last, "name").where("src != dst").select("src", "dst").distinct()


def _endings(name: Column) -> Column:
    """Every dotted ending of a name, the whole first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def module_targets(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``imports`` (src, module, name, level) with target, a known module or null, and external, the package of any other.

    ``modules`` has module and ord. A module goes by all its dotted endings; of
    two with one ending the later has it. A relative import means the module
    named by its package, the path and the name, else without the name; an
    absolute one its path, else path and name, else the ending registered first.
    All of that is an equi-join on the names in question. Without a name and a
    path an import has neither target nor package.
    """
    spread = modules.select("module", "ord", F.posexplode(_endings(F.col("module"))).alias("pos", "alias"))
    aliases = spread.groupBy("alias").agg(F.max_by("module", F.struct("ord", "module")).alias("target"), F.min(F.struct("ord", "pos")).alias("first"))
    asked = imports.select("src", "module", "name", "level").distinct()
    path = F.when(F.col("module") != "", F.col("module"))
    parts = F.split("src", r"\.")
    package = F.slice(parts, F.lit(1), F.size(parts) - 1)
    up = F.greatest(F.col("level") - 1, F.lit(0))
    base = F.slice(package, F.lit(1), F.when(F.size(package) >= up, F.size(package) - up).otherwise(F.size(package)))
    within = F.array_join(F.concat(base, F.array_compact(F.array(path))), ".")
    raw = F.coalesce(path, F.col("name"))
    case = lambda turn, alias: F.struct(F.lit(turn).alias("turn"), alias.alias("alias"))
    relative = F.array(case(0, F.when(within == "", F.col("name")).otherwise(F.concat_ws(".", within, "name"))), case(1, within))
    absolute = F.concat(F.array(case(0, raw), case(1, F.concat(path, F.lit("."), "name"))), F.transform(F.coalesce(_endings(raw), F.array().cast("array<string>")), lambda a: case(2, a)))
    tried = asked.select("*", F.inline(F.when(F.col("level") > 0, relative).otherwise(absolute)))
    found = tried.join(aliases, "alias").groupBy("src", "module", "name", "level").agg(F.min_by("target", F.struct("turn", "first")).alias("target"))
    keys = ("src", "module", "name", "level")
    other = found.select("target", *[F.col(k).alias(f"_{k}") for k in keys])
    out = asked.join(other, [asked[k].eqNullSafe(other[f"_{k}"]) for k in keys], "left")
    return out.select(*keys, "target", F.when(F.col("target").isNull(), F.split(raw, r"\.")[0]).alias("external"))


def not_trivial(functions: DataFrame) -> DataFrame:
    """Functions large enough to compare: two statements and ten nodes, and more for constructors."""
    return functions.where((F.col("statement_count") >= 2) & (F.col("node_count") >= 10) & ~((F.col("name") == "__init__") & (F.col("statement_count") <= 2)))


def central_config(modules: DataFrame, edges: DataFrame, least: int = 3, share: float = 0.15) -> DataFrame:
    """One row: how many modules depend on a configuration module, of how many, and whether that is a convention."""
    config = modules.where((F.col("layer") == "config") | F.lower("module").rlike("config|settings")).select(F.col("module").alias("dst"))
    dependents = edges.join(config, "dst", "left_semi").select(F.col("src").alias("module")).distinct().withColumn("d", F.lit(1))
    n = modules.select("module").join(dependents, "module", "left").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("dependents"), F.count("*").alias("modules"))
    return n.withColumn("is_convention", (F.col("dependents") >= least) | (F.col("modules") > 0) & (F.col("dependents") >= share * F.col("modules")) & (F.col("dependents") > 0))


# What a relative import may name, in the order it is tried.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def script_targets(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """``imports`` (path, module) of scripts with target: the file that a relative import names, by the first ending that exists, else null; and external: the package of any other.

    ``paths`` has path. Dots are resolved by folding the parts of the path.
    """
    folder = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    parts = F.concat(folder, F.split("module", "/"))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    asked = imports.select("path", "module").distinct()
    relative = asked.where(F.startswith("module", F.lit("."))).withColumn("base", F.array_join(folded, "/"))
    tried = relative.select("path", "module", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in SCRIPT_ENDINGS])).alias("turn", "target"))
    known = paths.select(F.col("path").alias("target")).distinct()
    first = tried.join(known, "target").groupBy("path", "module").agg(F.min_by("target", "turn").alias("target"))
    pieces = F.split("module", "/")
    package = F.when(F.startswith("module", F.lit("@")), F.array_join(F.slice(pieces, 1, 2), "/")).otherwise(pieces[0])
    out = asked.join(first, ["path", "module"], "left")
    return out.withColumn("external", F.when(F.startswith("module", F.lit(".")), F.when(F.col("target").isNull(), F.col("module"))).otherwise(package))
