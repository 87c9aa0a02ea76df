"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their features
than the corpus does, with Gumbel noise, so that the highest scores are a weighted sample without replacement.

A feature is a run of 1 to n consecutive words, its bucket the CRC-32 of its UTF-8 bytes modulo the number of buckets.
One scan of a text finds them all: a ring keeps the zlib states of the runs that began at the last n words, and each
word extends every state by a space and itself. The buckets of each document are written once, with their counts; the
corpus's counts, the weights and the draw are made from them, and no text is read twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernels as K
from .common import bounded_batches, materialise, unused

#: Letters and digits of ASCII, letters in lower case, and all that is not ASCII make words; other bytes part them.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


def word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    raw, at = raw.translate(_KEPT), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def ring_scan(pieces: Iterator[list[bytes]], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece its number of words and the CRC-32 of every run of 1 to n consecutive words that ends in it."""
    ring: list[int] = []  # states of the runs that began at the last words, the latest first
    for words in pieces:
        found: list[int] = []
        for word in words:
            spaced = b" " + word
            ring = [crc32(word), *[crc32(spaced, state) for state in ring[: n - 1]]]
            found += ring
        yield len(words), np.array(found, np.uint32)


def features(docs: DataFrame, *, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, buckets (distinct, ascending) and counts of each row's whole text.

    A null text has no words. Rows are independent: repeated and null ids give a row each; other columns are not read.
    """
    if n < 1 or buckets < 1:
        raise ValueError("n and buckets are 1 at least")
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    lists = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", lists), ("counts", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                raw, words, total, held, times = data.tobytes(), [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    scanned = list(ring_scan(word_pieces(raw[a:b]), n))
                    found = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in scanned)])
                    words.append(sum(w for w, _ in scanned))
                    total.append(len(found))
                    u, c = np.unique(found % np.uint32(buckets), return_counts=True)
                    held.append(u.astype(np.int32))
                    times.append(c.astype(np.int32))
                ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(total, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (held, times))], schema=schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all rows of features(): summed in each task first; a number a bucket comes here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(mine, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mine[at])], names=["bucket", "n"])

    sums = found.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the corpus, each count plus one."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def with_weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of gains over a row's features. gain is a number a bucket."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(gain)
    kind = found.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            lists = batch.column(3)
            each = gain[lists.flatten().to_numpy()] * batch.column(4).flatten().to_numpy().astype(np.int64)
            ends = lists.offsets.to_numpy().astype(np.int64)
            run_ = np.concatenate([[0], np.cumsum(each)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(run_[ends - ends[0]]), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")


def with_scores(weighted: DataFrame, seed: int = 2024) -> DataFrame:
    """Adds score: the weight and Gumbel noise in thousandths, which the id and the seed alone decide. A null id counts
    as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + noise)


def with_places(rows: DataFrame, *order, place: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the given order of all rows, without a window over all of them: rows are
    dealt and sorted by ranges, written with their place in their range, and the rows of the ranges before are added
    (a number a partition is broadcast). Rows that the order leaves equal get their places in any order."""
    at, part, before = unused(rows, "__at", "__part", "__before")
    spark = rows.sparkSession
    dealt = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "places")
    sizes = sorted(dealt.groupBy(F.shiftright(at, 33).alias(part)).count().collect())
    seen, starts = 0, []
    for number, n in sizes:
        starts.append((number, seen))
        seen += n
    starts = spark.createDataFrame(starts, f"`{part}` long, `{before}` long")
    dealt = dealt.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(starts), part)
    return dealt.withColumn(place, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, part, before)


def resample(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs, drawn towards the texts of target.

    Of the N rows with min_words words, the floor(percent * N / 100) highest scores are drawn: rank is 1, 2, 3 ... in
    the order of score, ties to the lesser id; the rank of the others is null. Null and empty texts have no features,
    weigh 0 and are not drawn (unless min_words is 0). Repeated ids are rows of their own with the same noise; null ids
    come last among ties. An empty target, or no documents, leaves the counts at zero, which is no error.
    """
    found = materialise(features(docs, n=n, buckets=buckets, id_col=id_col, text_col=text_col), "features")
    aim = features(target.withColumn("__no_id", F.lit(0)), n=n, buckets=buckets, id_col="__no_id", text_col=text_col)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    scored = with_scores(with_weights(found, gain), seed)
    fit = F.col("n_words") >= min_words
    ranked = with_places(scored.where(fit), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), place="rank")
    drawn = percent * ranked.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(names))


def drawn_documents(docs: DataFrame, resampled: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn, with all their columns; rows that share an id share its fate."""
    (key,) = unused(docs, "__id")
    ids = resampled.where("rank is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_semi")


#: The same in SQL, with CRC-32 by its table of 256 remainders, once a distinct word.
ORACLE = r"""
with crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select i::bigint as i from range(256) r(i))),
texts as (select doc_id, 1 as corpus, text from documents union all select 0, 0, text from benchmark),
tokens as (select doc_id, corpus, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as w from texts where text is not null),
counted as (select doc_id, corpus, w, count(*) as n from tokens group by all),
codes as (select w, hex(encode(w)) as h from (select distinct w from counted)),
crcs as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h)::bigint // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from codes, crc),
sums as (select corpus, bucket, sum(n)::bigint as n from counted join crcs using (w) group by all),
totals as (select sum(n) filter (corpus = 1)::double as s, sum(n) filter (corpus = 0)::double as t from sums),
gain as (
  select c.bucket, floor(1000 * ln((coalesce(b.n, 0) + 1)::double * (s + 10000) / ((c.n + 1)::double * (t + 10000))))::bigint as g
  from (select * from sums where corpus = 1) c left join (select * from sums where corpus = 0) b using (bucket), totals
),
weights as (select doc_id, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from counted join crcs using (w) join gain using (bucket) where corpus = 1 group by doc_id),
scored as (
  select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents d left join weights using (doc_id)
),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select s.doc_id::bigint as doc_id, n_features::bigint as n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from scored s left join placed using (doc_id)
"""
