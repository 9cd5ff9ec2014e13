"""Helpers that all corpus operators share: shipping code, scratch tables, readers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch sent to a Python worker; keeps batches of long texts small.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on executors and bound the Arrow batches.

    Idempotent for each SparkContext. Texts are long, so an Arrow batch holds
    at most ``ARROW_ROWS`` of them whatever the session's default says.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_tidemark_shipped", False):
        root = Path(__file__).resolve().parents[2]
        out = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_pkg.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted((root / "tidemark").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(out)
        sc._tidemark_shipped = True
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share; it goes when the application ends.

    The folder is spark.checkpoint.dir; only in local mode may that be unset, and a local one is made.
    """
    sc = spark.sparkContext
    where = getattr(sc, "_tidemark_scratch", None)
    if where is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="tidemark-scratch-")
        where = sc._tidemark_scratch = f"{shared.rstrip('/')}/tidemark-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return where


def discard(df: DataFrame) -> None:
    """Delete the files of a scratch table (from ``table``) that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, so that other names can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])
