"""What the operators of this subpackage share: tables, the shared folder, hashing columns, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for shuffle files that nothing can read any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, in a local session, a temporary one. On a cluster
    no folder of one machine will do, so there it must be set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='beliefline-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> SparkSession:
    """Keeps the Arrow batches that workers get small enough for long texts and packed rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a shared folder when the driver's Python ends."""
    atexit.register(_remove_quietly, spark, path)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone by then
        pass


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of each execution at its end, as nothing reads them once its table is written;
    the session's own setting comes back after."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts the lineage: an executor that is
    lost afterwards costs no recomputation. The folder goes when the driver's Python ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_materialised(df: DataFrame) -> None:
    """Deletes the table of a DataFrame from materialise() that nothing reads any more."""
    remove(df.sparkSession, df.shared_path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """The split of rows: crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of like, in their order."""
    return df.select(*(F.col(f"`{c}`") for c in like.columns))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names from stems that no column of df has, whatever the case of their letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def few(df: DataFrame, rows: int, each: int = 500_000) -> DataFrame:
    """df in as many tasks as ``rows`` rows call for, two a core at least: small tables need no more."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // each))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph; component is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each step points the neighbours of a node to
    the least of them, so the number of edges never grows and hub nodes only ever take part in aggregations and
    skew-splittable joins; the number of steps grows with the logarithm of the nodes. A step's edges are written to the shared folder. The end is reached when every node has
    one parent and no parent has one. Nodes without an edge do not appear; loops and null ends are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    e = materialise(e.distinct(), name)
    while True:
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(e.select("v", F.lit(0), F.lit(1)))
        open_ends = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)")
        if open_ends.agg(F.count("*")).first()[0] == 0:
            break
        rows = e.count()
        both = e.union(e.select("v", "u"))
        # large star: neighbours above u point to the least around u
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least.select("u", F.least("m", "u").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its lesser neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low)
        after = materialise(few(small.distinct(), rows), name)
        drop_materialised(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
