"""Ledgers, graphs and manifests on Spark's writers, whose commits are atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a ledger entry; evidence_score alone may be NULL.
LEDGER_FIELDS = ("candidate", "agent", "modality", "source", "source_version", "query", "evidence_score", "mass_triple", "rate", "fold", "conflict", "recorded_at")


def append_ledger(entries: DataFrame, path: str) -> None:
    """Appends entries as JSON lines; an empty batch is an error."""
    if entries.isEmpty():
        raise ValueError("no ledger entries to write")
    entries.write.mode("append").json(path)


def ledger_rows(reports: DataFrame, long: DataFrame, *, agent: str, source: str, version: str, recorded_at: str) -> DataFrame:
    """An entry for each candidate and modality of a ranking."""
    rows = long.join(reports.select("candidate", "total_conflict"), "candidate")
    return rows.select(
        "candidate", F.lit(agent).alias("agent"), "modality", F.lit(source).alias("source"), F.lit(version).alias("source_version"), F.concat(F.lit("candidate="), F.col("candidate").cast("string")).alias("query"),
        F.col("score").alias("evidence_score"), F.col("discounted").alias("mass_triple"), "rate", F.lit("pooled").alias("fold"), F.col("total_conflict").alias("conflict"), F.lit(recorded_at).cast("timestamp").alias("recorded_at"),
    )


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def load_bundle(spark: SparkSession, path: str, *, phenotype: str, last: str) -> dict[str, DataFrame]:
    """nodes, edges, pool (candidate: every gene, markers too) and held_out (candidate: genes whose edge to the phenotype is
    dated after ``last``, dates compared as text) of a graph that save_graph() wrote."""
    nodes, edges = load_graph(spark, path)
    late = edges.where((F.col("dst") == phenotype) & (F.col("release_date") > last)).select(F.col("src").alias("candidate")).distinct()
    return {"nodes": nodes, "edges": edges, "pool": nodes.where("kind = 'gene'").select(F.col("key").alias("candidate")).distinct(), "held_out": late}


def write_atomic(spark: SparkSession, path: str, text: str) -> str:
    """UTF-8 text under a path of any Hadoop file system: written beside it, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.partial")
    fs = to.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(beside, to):
        raise OSError(f"{path} could not be written")
    return path


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]  # one small file


def write_json(spark: SparkSession, path: str, payload) -> str:
    """A summary as sorted, indented JSON."""
    import json

    return write_atomic(spark, path, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def write_yaml(spark: SparkSession, path: str, payload: dict) -> str:
    import yaml

    return write_atomic(spark, path, yaml.safe_dump(payload, sort_keys=False))


def render(title: str, sections: dict) -> str:
    """Nested sections as indented text, keys sorted."""

    def lines(value, pad: str) -> list[str]:
        if isinstance(value, dict):
            pairs = [(f"{k}:" if isinstance(v, dict | list | tuple) else f"{k} = {v}", v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))]
        elif isinstance(value, list | tuple):
            pairs = [(f"[{i}]" if isinstance(v, dict | list | tuple) else f"- {v}", v) for i, v in enumerate(value)]
        else:
            return [f"{pad}{value}"]
        return [x for head, v in pairs for x in (f"{pad}{head}", *(lines(v, pad + "  ") if isinstance(v, dict | list | tuple) else ()))]

    out = [title, "=" * len(title), ""]
    for name, value in sections.items():
        out += [name, "-" * len(name), *lines(value, ""), ""]
    return "\n".join(out).rstrip() + "\n"


def write_report(spark: SparkSession, path: str, title: str, sections: dict) -> str:
    return write_atomic(spark, path, render(title, sections))


def save_checkpoint(spark: SparkSession, path: str, parameters: dict, *, seed: int, step: int, config: dict) -> str:
    """Parameters (lists of numbers by name) with their digest, seed, step and configuration."""
    import hashlib
    import json

    body = {k: [float(x) for x in v] for k, v in parameters.items()}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    write_json(spark, path, {"version": 1, "parameters": body, "seed": seed, "step": step, "config": config, "sha256": digest})
    return digest


def load_checkpoint(spark: SparkSession, path: str) -> dict:
    """What save_checkpoint() wrote; another version or a wrong digest is an error."""
    import hashlib
    import json

    found = json.loads(read_text(spark, path))
    if found.get("version") != 1 or hashlib.sha256(json.dumps(found["parameters"], sort_keys=True).encode()).hexdigest() != found["sha256"]:
        raise ValueError(f"{path} is no checkpoint of this version, or it is damaged")
    return found
