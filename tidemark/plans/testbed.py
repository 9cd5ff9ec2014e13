"""Canonical tables drawn from the driver's test tables, for running operators without real scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines_of, route_group, route_path, short_hash

CATEGORIES = {"STANDARD": 0.20, "LARGE": 0.20, "SMALL": 0.15, "MEDIUM": 0.15, "ECONOMY": 0.15, "PROMO": 0.10}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with its part and order as findings; returnflag is the side of a comparison."""
    line, part, orders = read(spark, sf, "lineitem"), read(spark, sf, "part"), read(spark, sf, "orders")
    df = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    q, d = F.col("l_quantity"), F.col("l_discount")
    return df.select(
        F.col("l_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("repository_id"),
        F.col("o_orderdate").alias("started_at"),
        F.col("p_brand").alias("rule_id"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("src/m"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/f"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file"),
        F.col("l_linenumber").alias("line_start"),
        (F.col("l_linenumber") + 2).alias("line_end"),
        F.when(q >= 46, "critical").when(q >= 36, "high").when(q >= 21, "medium").when(q >= 6, "low").otherwise("info").alias("severity"),
        F.when(d <= 0.03, "high").when(d <= 0.07, "medium").otherwise("low").alias("confidence"),
        short_hash(F.col("p_brand"), F.col("l_suppkey"), F.col("p_type")).alias("fingerprint"),
        short_hash(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("long"), q.cast("long"), F.col("l_returnflag")).alias("id"),
        F.concat(F.lit("sym_"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"),
        F.col("p_name").alias("title"),
        F.col("l_returnflag").alias("side"),
    )


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(current, previous): every line stands on one of them."""
    f = findings(spark, sf)
    return f.where("side != 'A'"), f.where("side = 'A'")


def repo_loc(spark: SparkSession, sf: str) -> DataFrame:
    line, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("repository_id")).agg(F.sum("l_quantity").alias("loc"))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("repository_id"),
        F.concat(F.lit("repo-"), (F.col("o_custkey") % 400).cast("string")).alias("repo_name"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "scanning").otherwise("failed").alias("status"),
        (F.floor("o_totalprice") % 101).cast("int").alias("score"),
        F.col("o_orderpriority").alias("branch"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "js").when(F.col("lang") == "de", "go").otherwise("md")
    folder = F.when(F.col("doc_id") % 5 == 0, "tests/").when(F.col("doc_id") % 7 == 0, "node_modules/x/").when(F.col("doc_id") % 11 == 0, "api/").otherwise("src/")
    name = F.when(F.col("doc_id") % 13 == 0, "test_f").otherwise("f")
    return d.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/"), folder, name, F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "javascript").when(F.col("lang") == "de", "go").otherwise("unknown").alias("language"),
        F.col("source").alias("repository_id"),
        F.col("n_chars").alias("size"),
        F.size(lines_of(F.col("text"))).cast("long").alias("line_count"),
        F.col("text").alias("content"),
    )


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages")
    path = route_path(F.col("url"))
    return p.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("file"),
        path.alias("path"),
        route_group(path).alias("route_group"),
        (F.col("page_id") % 40).cast("int").alias("line"),
        (F.col("page_id") % 3 != 0).alias("guarded"),
        F.when(F.col("page_id") % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("p"), (F.col("page_id") % 97).cast("string")).alias("pattern"),
    )


def handlers(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as handlers of routes, some of which are public."""
    e, n = endpoints(spark, sf), F.col("page_id")
    own = F.element_at(F.array(*map(F.lit, ("/login", "/api/v1/health", "/auth/users", "/admin/health", "/password-recovery/x", "/docs/a", "/oauth/token/", ""))), (n % 8 + 1).cast("int"))
    symbol = F.when(n % 5 == 0, "purge_all_users").otherwise(F.col("pattern"))
    marks = F.when(n % 11 == 0, F.array(F.lit("allow_anonymous"))).otherwise(F.array().cast("array<string>"))
    return e.select("page_id", F.when(own == "", F.col("path")).otherwise(own).alias("route_path"), symbol.alias("symbol"), F.array("method").alias("methods"), marks.alias("decorators"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customer and part of every line, unless one number names both: as modules they are one."""
    line = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select("o_custkey", "l_partkey").where("o_custkey != l_partkey")


def _module(key: str) -> Column:
    return F.concat(F.lit("m"), F.col(key).cast("string"))


def imports(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of ``modules``, once for each line."""
    return _lines(spark, sf).select(_module("o_custkey").alias("src"), _module("l_partkey").alias("dst"))


def modules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(modules, edges): customers as modules of layers, each importing the parts that its lines name."""
    layer = lambda n: F.element_at(F.array(*map(F.lit, ("api", "service", "repository", "model", "config", "utility"))), (n % 6 + 1).cast("int"))
    s = read(spark, sf, "customer").select(_module("c_custkey").alias("module"), layer(F.col("c_custkey")).alias("layer"), (F.col("c_mktsegment") == "MACHINERY").alias("is_composition_root"))
    return s, imports(spark, sf).distinct()


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Imports among the modules of one nation, each nation a graph of its own; lines between nations leave as numbers, before any are compared."""
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    e = _lines(spark, sf).join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    e = e.join(c.withColumnRenamed("c_custkey", "l_partkey"), ["l_partkey", "nation"]).select("nation", "o_custkey", "l_partkey").distinct()
    return e.select("nation", _module("o_custkey").alias("src"), _module("l_partkey").alias("dst"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels")
    return d.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id").select("doc_id", "lang", "source", (F.col("n_chars") % 101).cast("int").alias("score"), (F.col("quality") == 1).alias("positive"), "quality", "toxic")
