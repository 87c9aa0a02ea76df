"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star edges.

A document's words are lower-cased (A-Z) runs of anything but ASCII white space; its set holds the distinct
five-word shingles, or the whole sequence where it is shorter. Documents with equal sets collapse to one node first,
so groups of copies of any size cost one row after a map-side combine. Each distinct set gets ``bands * rows`` bins
of one permutation; an empty bin copies the first non-empty one of its own random order (optimal densification), so
each bin still collides with the probability of the Jaccard similarity. A band's bucket holds only sets of sizes that may
link: a set stands in two of them, by classes of size. Buckets that hold two sets or more propose
star-shaped edges, one a set: to that of its bucket mates that has the most mates in all, which is near the middle of
its group. Full sets confirm them exactly, and links contract; components that still share a bucket propose one more
edge each. Sets in buckets whose members are then apart meet in an exact join: shingles are ordered by how many of those
sets hold them, and a pair is a candidate only if the rare ends of both sets, whose lengths the threshold bounds, share a
shingle early enough to reach the overlap that is needed. So any two members of a bucket end in one component or are
ruled out by a bound or by their full sets, and texts made of one template cost what their own words cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textkernels as K
from .common import connected_components, drop_materialised, materialise

BANDS, ROWS = 44, 5
#: Ids that are broadcast at most (8 bytes each), so that only the texts asked for move; beyond, texts are joined by shuffles.
FEW_IDS = 500_000


def densified(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures of sets (ascending hashes), one row each; rows of empty sets are 0."""
    n = len(offsets) - 1
    sig = np.zeros((n, bins), np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    at = row * bins + (K.mix(hashes) % np.uint64(bins)).astype(np.int64)
    flat = sig.reshape(-1)
    flat[at[::-1]] = hashes[::-1] | np.uint64(1)  # the least of a bin comes last, so it stays
    empty = flat == 0
    empty[np.repeat(np.diff(offsets) == 0, bins)] = False
    todo = np.flatnonzero(empty)
    filled = sig != 0
    step = 0
    while len(todo) and step < 8 * bins:
        step += 1
        base = todo // bins
        probe = (K.mix((todo - base * bins).astype(np.uint64) * np.uint64(0x10001) + np.uint64(step << 32)) % np.uint64(bins)).astype(np.int64)
        hit = filled[base, probe]
        flat[todo[hit]] = sig[base[hit], probe[hit]]
        todo = todo[~hit]
    for x in todo:  # hardly ever: the next bin in the circle
        r, j = divmod(int(x), bins)
        order = np.roll(filled[r], -j)
        flat[x] = sig[r, (j + int(np.argmax(order))) % bins]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    k = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        k += sig.reshape(len(sig), bands, rows)[:, :, j] * K._STEP[j]
    return K.mix(k + K.random_words(bands, 3))


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, whatever the order (chance of any clash among n sets: n^2 / 2^65)."""
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(K.mix(hashes + np.uint64(0xABCDEF)), out=run[1:])
    return K.mix(run[offsets[1:]] - run[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _signatures(id_type: pa.DataType, bands: int, rows: int, k: int):
    schema = pa.schema([("doc_id", id_type), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                h, o = K.shingle_sets(K.Words(data, offsets, lower=True), k)
                sizes = np.diff(o)
                sig = densified(h, o, bands * rows)
                keys = band_keys(sig, bands, rows).view(np.int64)
                have = np.flatnonzero(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)), pa.array(keys[have].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(set_ids(h, o).view(np.int64), mask=sizes == 0), lists], schema=schema)

    return run


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set), and the band keys of each row."""
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _signatures(to_arrow_type(kind), bands, rows, k), f"doc_id {kind.simpleString()}, n_shingles long, set_id long, bands array<long>"
    )


def size_classes(n: Column, percent: int) -> Column:
    """Two numbers for a set's size; sets that may link share one. Sizes of linked sets differ by a factor of
    100 / percent at most, less than the width of a class, so their classes are the same or next to each other."""
    c = F.floor(F.log(n.cast("double")) / math.log(100.5 / percent))
    return F.array(c, c + 1)


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_a, at_a = K.utf8(batch.column(2))
            bytes_b, at_b = K.utf8(batch.column(3))
            for i, j in K.chunks(at_a + at_b):
                ha, oa = K.shingle_sets(K.Words(bytes_a[at_a[i] : at_a[j]], at_a[i : j + 1] - at_a[i], lower=True), k)
                hb, ob = K.shingle_sets(K.Words(bytes_b[at_b[i] : at_b[j]], at_b[i : j + 1] - at_b[i], lower=True), k)
                na, nb = np.diff(oa), np.diff(ob)
                row = np.concatenate([np.repeat(np.arange(j - i), na), np.repeat(np.arange(j - i), nb)])
                h = np.concatenate([ha, hb])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=j - i) if len(h) else np.zeros(j - i, int)
                good = np.flatnonzero((100 * both >= percent * (na + nb - both)) & (both > 0))
                if len(good):
                    part = batch.slice(i, j - i).select([0, 1]).take(pa.array(good))
                    yield part

    return run


def _shingle_rows(k: int):
    """(set_id, shingle) of texts: a row for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                h, o = K.shingle_sets(K.Words(data, offsets, lower=True), k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(o)))), pa.array(h.view(np.int64))], names=["set_id", "shingle"])

    return run


def candidates(sets: DataFrame, texts: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """(a, b, component_a, component_b, met): all pairs of different components that may link, and no other pair that
    a bound rules out. sets: set_id, n_shingles, component; texts: set_id, text.

    Shingles are ordered by the number of sets that hold them (or others with the same 31 low bits), ties by hash; a
    shingle of one set alone only counts.
    Let a be the larger set. A link needs an overlap of percent / (100 + percent) of both sizes, that is percent / 100
    of a's at least and 2 percent / (100 + percent) of b's. So the first shingle that both hold, in that order, stands
    among the first n - overlap + 1 of each, and so early that the rest can make up the overlap.
    """
    rows = texts.select("set_id", "text").mapInArrow(_shingle_rows(k), "set_id long, shingle long").withColumn("short", F.col("shingle").bitwiseAND((1 << 31) - 1).cast("int"))
    often = rows.groupBy("short").agg(F.count("*").cast("int").alias("often")).where("often > 1")  # any order of shingles will do, so 31 bits count
    lists = rows.join(often, "short").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("common"))
    lists = lists.join(sets, "set_id").withColumn("alone", F.expr("n_shingles - size(common)"))
    reach = f"n_shingles - cast(ceil({percent} * n_shingles / 100) as int) + 1 - alone"
    ends = lists.where(f"{reach} > 0").select("set_id", "component", "n_shingles", "alone", F.posexplode(F.expr(f"slice(common, 1, cast({reach} as int))")).alias("place", "s"))
    ends = ends.select(F.col("s.shingle").alias("shingle"), "set_id", "component", "n_shingles", F.expr("alone + place").alias("place"))
    # a shingle that one component alone holds early says nothing
    split = ends.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    ends = materialise(ends.join(split, "shingle", "left_semi"), "ends")
    short = f"n_shingles - cast(ceil(2 * {percent} * n_shingles / {100 + percent}) as int) + 1"
    side = lambda df, c: df.select("shingle", *(F.col(x).alias(f"{x}_{c}") for x in ("set_id", "component", "n_shingles", "place")))
    larger, smaller = side(ends, "a"), side(ends.where(f"place < {short}"), "b")
    met = larger.join(smaller, "shingle").where(
        f"component_a <> component_b and (n_shingles_b < n_shingles_a or n_shingles_b = n_shingles_a and set_id_b < set_id_a) and 100 * n_shingles_b >= {percent} * n_shingles_a"
        f" and {100 + percent} * least(n_shingles_a - place_a, n_shingles_b - place_b) >= {percent} * (n_shingles_a + n_shingles_b)"
    )
    return met.groupBy(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "component_a", "component_b").agg(F.count("*").alias("met"))


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) once links (a, b) have joined components; ends without one are their own."""
    end = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    alone = joined.join(component, joined["component"] == component["node"], "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return component.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")).union(alone)


def _texts(k: int):
    """Keeps the rows whose text gives the set that it is asked for (an id may stand on rows of different texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                h, o = K.shingle_sets(K.Words(data, offsets, lower=True), k)
                good = set_ids(h, o).view(np.int64) == part.column(0).to_numpy()
                if good.any():
                    yield part.filter(pa.array(good))

    return run


def with_set_ids(docs: DataFrame, name: str, *, text_col: str = "text", k: int = 5) -> DataFrame:
    """docs with the id of each row's set of shingles (null for an empty set) as a last column."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(at))
            for i, j in K.chunks(offsets):
                h, o = K.shingle_sets(K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), k)
                ids = pa.array(set_ids(h, o).view(np.int64), mask=np.diff(o) == 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, ids], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id reachable over links), kept, n_copies.

    Links join sets with 100 * intersection >= percent * union. A null or blank text has an empty set and links with
    nothing; it is its own component. Rows with a null id stay alone with a null component and are kept. Rows that
    repeat an id count by their texts: each belongs to the component of its own set. Other columns of docs, whatever
    their names, are not read. n_copies counts the rows with exactly the same set; set_id names it.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialise(signatures(read, bands=bands, rows=rows, k=k), "minhash")
    sets = marked.where("set_id is not null and doc_id is not null").groupBy("set_id")
    sets = sets.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    banded = sets.select("set_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = banded.join(shared.select("key"), "key").join(sets.select("set_id", "n_shingles"), "set_id")
    sized = sized.select("set_id", "key", F.explode(size_classes(F.col("n_shingles"), percent)).alias("size")).select("set_id", F.xxhash64("key", "size").alias("key"))
    sized = materialise(sized, "sized")
    buckets = materialise(sized.join(sized.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "buckets")
    drop_materialised(sized)
    # the first stars: each set meets the one of its bucket mates with the most mates in all, the middle of its group
    mates = buckets.groupBy("set_id").agg(F.sum("n").alias("mates"))
    ranked = buckets.join(mates, "set_id").select("key", "set_id", F.struct("mates", "set_id").alias("rank"))
    hubs = ranked.join(ranked.groupBy("key").agg(F.max("rank").alias("top")), "key").groupBy("set_id").agg(F.max("top")["set_id"].alias("hub")).where("set_id <> hub")
    members = materialise(mates.join(sets, "set_id").select("set_id", "rep", "n_shingles", "mates"), "members")
    reps = members.select("set_id", F.col("rep").alias("doc_id"))
    texts = read.join(F.broadcast(reps.select("doc_id")), "doc_id", "left_semi") if reps.count() <= FEW_IDS else read
    texts = texts.join(reps, "doc_id").select("set_id", "text")
    texts = texts.mapInArrow(_texts(k), "set_id long, text string")
    again = marked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    texts = materialise(texts if again.isEmpty() else texts.dropDuplicates(["set_id"]), "texts")  # only rows that repeat an id repeat a set

    def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs that link; of the texts only those asked for move, if their ids are few enough to be broadcast."""
        pairs = materialise(pairs.select("a", "b"), "pairs")
        ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "asked")
        texts = texts.join(F.broadcast(ids), "set_id", "left_semi") if ids.count() <= FEW_IDS else texts
        side = lambda c: texts.select(F.col("set_id").alias(c), F.col("text").alias(f"text_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        out = materialise(both.mapInArrow(_confirm(k, percent), "a long, b long"), "links")
        for done in (pairs, ids):
            drop_materialised(done)
        return out

    def apart(component: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        now = buckets.select("key", "set_id").join(component.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return materialise(now.join(mixed, "key"), "apart")

    component = materialise(connected_components(confirmed(hubs.select(F.col("set_id").alias("a"), F.col("hub").alias("b")), texts)), "components")
    # the second: in a bucket, the middle of each component meets that of the bucket
    now = apart(component)
    inner = materialise(texts.join(now.select("set_id").distinct(), "set_id", "left_semi"), "texts")
    heads = now.join(members.select("set_id", "mates"), "set_id").groupBy("key", "component").agg(F.max(F.struct("mates", "set_id")).alias("head"))
    tops = heads.groupBy("key").agg(F.max("head").alias("top"))
    again = heads.join(tops, "key").select(F.col("head.set_id").alias("a"), F.col("top.set_id").alias("b")).where("a <> b").distinct()
    found = confirmed(again, inner)
    if not found.isEmpty():
        component = materialise(merged(component, found), "components")
    drop_materialised(now)
    # what is still apart: for each set and other component the likeliest candidate, then all that are left
    now = apart(component)
    inside = materialise(now.select("set_id", "component").distinct().join(members.select("set_id", "n_shingles"), "set_id"), "inside")
    possible = materialise(candidates(inside, inner.join(inside.select("set_id"), "set_id", "left_semi"), k=k, percent=percent), "candidates")
    likeliest = possible.groupBy("a", "component_a", "component_b").agg(F.max_by("b", F.struct("met", "b")).alias("b"))
    likeliest = likeliest.groupBy("b", "component_a", "component_b").agg(F.min("a").alias("a"))
    found = confirmed(likeliest, inner)
    if not found.isEmpty():
        component = materialise(merged(component, found), "components")
    own = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"now_{c}"))
    left = possible.join(own("a"), "a", "left").join(own("b"), "b", "left").where("coalesce(now_a, a) <> coalesce(now_b, b)").join(likeliest, ["a", "b"], "left_anti")
    late = confirmed(left.select("a", "b"), inner)
    if not late.isEmpty():
        component = merged(component, late)
    for done in (now, inside, possible, buckets, members, texts, inner):
        drop_materialised(done)
    groups = marked.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    groups = groups.join(component.withColumnRenamed("node", "set_id"), "set_id", "left")
    whole = groups.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    groups = groups.join(whole, "component", "left").select("set_id", "n_copies", F.coalesce("lowest", "least").alias("least"))
    out = marked.drop("bands").join(groups, "set_id", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "set_id")


#: The same in DuckDB's SQL, by an exact join on shared shingles.
ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, unnest(case when len(w) = 0 then []::varchar[] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) end) as s from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= 75 * ((select n from sizes where doc_id = a.doc_id) + (select n from sizes where doc_id = b.doc_id) - count(*))),
reach as (select a as doc_id, b as other from links union select r.doc_id, l.b from reach r join links l on l.a = r.other),
least as (select doc_id, min(other) as other from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) as component_id, d.doc_id <= coalesce(other, d.doc_id) as kept
from documents d left join sizes using (doc_id) left join least using (doc_id)
"""
