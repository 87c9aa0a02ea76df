"""Digests of files and trees: executors read files in blocks, folders combine what is below them.

No file is in memory as a whole, whatever its size, and no list of files reaches the driver: of a tree, its root's digest does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pinned import pinned

#: Bytes read at once, of a chunk that has a digest of its own, and children of a folder that are combined at once (about).
BLOCK, CHUNK, CHILDREN = 1 << 20, 64 << 20, 1024
#: What is no part of a tree.
SKIPPED_FOLDERS, SKIPPED_SUFFIXES = ("__pycache__", ".git", ".pytest_cache", ".ruff_cache"), (".pyc",)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, mounted or any other that pyarrow knows, and the path in it."""
    at = urlparse(path)
    return (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def digest_of(path: str, begin: int, size: int, block: int = BLOCK) -> str:
    """SHA-256 of a range of a file, a block in memory at a time."""
    out = hashlib.sha256()
    store, inside = _store(path)
    with store.open_input_file(inside) as f:
        f.seek(begin)
        while size > 0 and (data := f.read(min(block, size))):
            out.update(data)
            size -= len(data)
    return out.hexdigest()


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, name (below root), bytes of the files of a tree, empty ones too. Executors list its folders, those of a depth
    at a time; files are not read."""
    root = root.rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for pdf in frames:
            for folder in pdf["name"]:
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                rows = [(f"{folder}/{i.base_name}" if folder else i.base_name, i.base_name, i.size or 0, i.type == fs.FileType.Directory) for i in found]
                yield pd.DataFrame(rows, columns=["name", "last", "bytes", "is_folder"])

    level, out = spark.createDataFrame([("",)], "name string"), None
    while True:
        found = pinned(level.repartition("name").mapInPandas(run, "name string, last string, bytes long, is_folder boolean"), "listed")
        kept = found.where("not is_folder")
        for suffix in SKIPPED_SUFFIXES:
            kept = kept.where(~F.col("last").endswith(suffix))
        kept = kept.select(F.concat(F.lit(f"{root}/"), "name").alias("path"), "name", "bytes")
        out = kept if out is None else out.unionByName(kept)
        level = found.where(F.col("is_folder") & ~F.col("last").isin(*SKIPPED_FOLDERS)).select("name")
        if level.isEmpty():
            return out


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, name, bytes, sha256 of every file of a tree: each file is read by one task, in blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(sha256=[digest_of(p, 0, int(n)) for p, n in zip(pdf["path"], pdf["bytes"], strict=True)])

    return files(spark, root).mapInPandas(run, "path string, name string, bytes long, sha256 string")


def file_digests(spark: SparkSession, root: str, *, chunk: int = CHUNK) -> DataFrame:
    """name, bytes, digest of every file: that of its bytes if they are one chunk, else that of its chunks' digests. Chunks
    of a large file are read by as many tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(digest=[digest_of(p, int(a), int(n)) for p, a, n in zip(pdf["path"], pdf["begin"], pdf["size"], strict=True)]).drop(columns="path")

    rows = files(spark, root).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("bytes") / chunk) - 1, F.lit(0)).cast("int"))))
    rows = rows.withColumn("begin", F.col("chunk").cast("long") * chunk)
    rows = rows.select("path", "name", "bytes", "chunk", "begin", F.least(F.lit(chunk), F.col("bytes") - F.col("begin")).alias("size"))
    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "name", "chunk")
    read = dealt.mapInPandas(run, "name string, bytes long, chunk int, begin long, size long, digest string")
    # a file has a digest a chunk: 64 characters for each 64 MB
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"])
    by = read.groupBy("name", "bytes").agg(parts.alias("parts"))
    return by.select("name", "bytes", F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(F.sha2(F.concat_ws("", "parts"), 256)).alias("digest"))


def _combined(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, digest over the sorted lines ``name``, tab, ``digest``."""
    line = F.concat_ws("\t", "name", "digest")
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("digest"))


def folder_digests(found: DataFrame, *, children: int = CHILDREN) -> DataFrame:
    """folder ('' is the root), digest of every folder above the files (name, digest), from the deepest up. A folder's
    children are dealt by their names to as many parts as their number calls for; parts combine to the folder."""
    depth = F.size(F.split("name", "/"))
    deepest = found.agg(F.max(depth)).first()[0] or 0
    above = lambda c: F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    level, out = None, None
    for d in range(deepest, 0, -1):
        here = found.where(depth == d).select("name", "digest")
        rows = here if level is None else here.unionByName(level.select(F.col("folder").alias("name"), "digest"))
        rows = rows.withColumn("folder", above(F.col("name"))).withColumn("name", F.regexp_extract("name", "[^/]*$", 0))
        sizes = rows.groupBy("folder").agg(F.ceil(F.count("*") / children).alias("parts"))
        dealt = rows.join(sizes, "folder").withColumn("part", F.pmod(F.crc32(F.col("name").cast("binary")), F.col("parts")))
        parts = _combined(dealt, ["folder", "part"]).select("folder", F.format_string("%010d", "part").alias("name"), "digest")
        level = _combined(parts, ["folder"])
        out = level if out is None else out.unionByName(level)
    return out if out is not None else found.sparkSession.createDataFrame([], "folder string, digest string")


def tree_digest(spark: SparkSession, root: str, *, chunk: int = CHUNK, children: int = CHILDREN) -> str:
    """The digest of a tree's root: that of no lines if there are no files."""
    top = folder_digests(file_digests(spark, root, chunk=chunk).select("name", "digest"), children=children).where("folder = ''").first()
    return top["digest"] if top else hashlib.sha256(b"").hexdigest()
