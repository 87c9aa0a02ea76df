"""Readers of clinical, expression, dependency, response, graph and network files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The projects that clinical files may name.
PROJECTS = ("TCGA-COAD", "TCGA-READ")
MISSING = ("", "NA")


def require(df: DataFrame, *columns: str) -> DataFrame:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def clinical(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of strings with case_id; a project_id outside the known ones is an error."""
    df = require(spark.read.csv(path, sep="\t", header=True), "case_id")
    if "project_id" in df.columns:
        odd = df.where(~F.coalesce(F.col("project_id").isin(*PROJECTS), F.lit(False))).select("project_id").limit(1).collect()
        if odd:
            raise ValueError(f"unknown project {odd[0][0]!r}")
    return df


def series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, genes) of a series matrix: ids from the accession line, first fields of the table's lines in order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    fields = F.split(F.regexp_replace("value", '"', ""), "\t")
    samples = lines.where(F.col("value").startswith("!Sample_geo_accession")).select(F.posexplode(F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))).alias("pos", "sample"))
    genes = lines.where(~F.col("value").startswith("!") & F.col("value").contains("\t")).select("seq", fields[0].alias("gene"))
    return samples, genes


def gene_effects(spark: SparkSession, path: str) -> DataFrame:
    """model, gene, effect: a wide matrix as rows; labels are cut at the bracket, empty and NA cells dropped."""
    wide = spark.read.csv(path, header=True)
    model, *genes = wide.columns
    long = wide.select(F.col(f"`{model}`").alias("model"), *(F.col(f"`{g}`") for g in genes)).unpivot("model", [F.col(f"`{g}`") for g in genes], "label", "cell")
    ok = F.col("cell").isNotNull() & ~F.col("cell").isin(*MISSING)
    return long.where(ok).select("model", F.split_part("label", F.lit(" ("), F.lit(1)).alias("gene"), F.col("cell").cast("double").alias("effect"))


def drug_responses(spark: SparkSession, path: str, gene_column: str = "gene") -> DataFrame:
    """gene, response; the last row of a gene counts."""
    df = require(spark.read.csv(path, header=True), gene_column, "response").withColumn("seq", F.monotonically_increasing_id())
    ok = F.col("response").isNotNull() & ~F.col("response").isin(*MISSING)
    return df.where(ok).groupBy(F.col(gene_column).alias("gene")).agg(F.max_by(F.col("response").cast("double"), "seq").alias("response"))


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON document's edges list."""
    doc = require(spark.read.json(path, multiLine=True), "edges")
    return doc.select(F.inline("edges"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON document with entities and edges; seq keeps the order."""
    doc = require(spark.read.json(path, multiLine=True), "entities", "edges")
    numbered = lambda c: doc.select(F.posexplode(c).alias("seq", "x")).select("seq", "x.*")
    return numbered("entities"), numbered("edges")


def network(spark: SparkSession, path: str) -> DataFrame:
    """seq, name, substrates, products, rule, low, high of a JSON document of reactions; only the sign of a coefficient
    counts, and a missing rule is the reaction's id."""
    schema = "reactions array<struct<id: string, metabolites: map<string, double>, gene_reaction_rule: string, lower_bound: double, upper_bound: double, subsystem: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("reactions").alias("seq", "r"))
    side = lambda sign: F.array_sort(F.map_keys(F.map_filter("r.metabolites", lambda k, v: v * sign > 0)))
    rule = F.coalesce(F.nullif("r.gene_reaction_rule", F.lit("")), "r.id")
    return rows.select("seq", F.col("r.id").alias("name"), side(-1).alias("substrates"), side(1).alias("products"), rule.alias("rule"), F.col("r.subsystem").alias("pathway"), F.coalesce("r.lower_bound", F.lit(0.0)).alias("low"), F.coalesce("r.upper_bound", F.lit(1000.0)).alias("high"))


def last_row(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("__r = 1").drop("__r")


def inventory(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """name, exists of files under a root on any Hadoop file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}")
        rows.append((n, bool(p.getFileSystem(conf).exists(p))))
    return spark.createDataFrame(rows, "name string, exists boolean")


def config(path: str) -> dict:
    """One YAML mapping; an empty file is an empty one."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def merged(base: dict, over: dict) -> dict:
    """base with over laid on it, mappings merged by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def scalar(text: str):
    """A configuration value from text: boolean, null, number, list or the text itself."""
    word = text.strip()
    if word.lower() in ("true", "false", "null", "none"):
        return {"true": True, "false": False}.get(word.lower())
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            continue
    if word[:1] == "[" and word[-1:] == "]":
        return [scalar(x) for x in word[1:-1].split(",")] if word[1:-1].strip() else []
    return text


def overridden(base: dict, assignments: list[str]) -> dict:
    """base with dotted assignments (a.b=value); mappings on the way are made."""
    out = base
    for a in assignments:
        name, sign, value = a.partition("=")
        if not sign:
            raise ValueError(f"{a!r} is no assignment")
        over = scalar(value)
        for key in reversed(name.split(".")):
            over = {key: over}
        out = merged(out, over)
    return out


def experiment(root: str, name: str, assignments: list[str] | None = None) -> dict:
    """An experiment's mapping with its data, model and train blocks, each inline or the name of a file in the folder of
    that block, overlaid by <block>_override and then by the assignments."""
    found = config(f"{root}/experiment/{name}.yaml")
    for block in ("data", "model", "train"):
        value = found.get(block)
        whole = config(f"{root}/{block}/{value}.yaml") if isinstance(value, str) else value or {}
        found[block] = merged(whole, found.pop(f"{block}_override", None) or {})
    return overridden(found, assignments or [])
