"""Importance resampling towards a target corpus, over hashed word windows.

An untrained pre-tokenizer of the ``tokenizers`` library (a Regex Split over
ASCII-lowered text) gives the words with their offsets; every run of 1 to ``MAX_N``
neighbouring offset pairs is a feature, its words joined by one space, and goes into
one of ``BUCKETS`` buckets by CRC-32.  With the corpus' S features (s in a bucket)
and the target's T (t), a bucket's gain is the whole part, downwards, of
``1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))``; a document's weight is the
mean gain of its features, and its score the weight plus Gumbel noise drawn from its id
alone, so the highest scores are a sample without replacement by importance.

Plan: texts are read once; a document's bucket histogram goes to a table in the
shared folder (bucket and count arrays, no text).  Counting the corpus and scoring
are passes over that table: at most ``BUCKETS`` rows leave a task, and 10,000 gains
reach the driver and the tasks.  Scores are whole numbers, so how many documents
lie above each is one row per distinct score; documents are ranked within one score
only, and only those that can be drawn.  No text is shuffled and no row sampled away.

Edge cases: a null or empty text has no features (weight 0) and can't be drawn; a
null id draws its noise as an empty id and comes last among equals; repeated ids share
their noise and are drawn each; equal scores go by smaller id, then fewer features;
an empty target gives every bucket its share of a corpus of no target; an empty
corpus gives no rows; extra columns never clash.  Very long texts are cut at breaks
between words into pieces, whose border windows are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import bounded_broadcast, run_folder

#: Fixed values of the contract: the words' characters, features, buckets, seed and share.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_N = 1
BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10

#: Characters that are pre-tokenized at once, and words whose bucket a task remembers.
PIECE = 1 << 18
REMEMBERED = 500_000


class _Buckets(dict):
    """Bucket of a feature; forgets when it holds REMEMBERED of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = b = zlib.crc32(feature.encode()) % self.buckets
        return b


def splitter():
    from tokenizers import Regex, pre_tokenizers
    return pre_tokenizers.Split(Regex(BREAKS), "removed")


def _pieces(low: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at breaks."""
    at, brk = 0, re.compile(BREAKS)
    while len(low) - at > size:
        m = brk.search(low, at + size)
        end = m.end() if m else len(low)
        yield low[at:end]
        at = end
    yield low[at:]


def windows(text: str | None, split, max_n: int = MAX_N, piece: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """(words, features) of each piece of a text: the features are its windows of 1 to
    ``max_n`` words, those over the border to the piece before among them."""
    low = (text or "").encode().lower().decode()  # bytes.lower: A-Z only
    before: list[str] = []
    for part in _pieces(low, piece):
        pairs = split.pre_tokenize_str(part)
        words = [w for w, _ in pairs]
        found = list(words)
        if max_n > 1:
            run, k = before + words, len(before)
            for n in range(2, max_n + 1):
                # a window is the pair (first word's start, last word's end): it must end in this piece
                found += [" ".join(run[e - n + 1: e + 1]) for e in range(max(k, n - 1), len(run))]
            before = run[-(max_n - 1):]
        yield len(words), found


def histograms(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_features, its buckets (little-endian u32, ascending)
    and how often each occurs (u32)."""

    def run(batches):
        split, bucket = splitter(), _Buckets(buckets)
        for batch in batches:
            out = [], [], [], []
            for s in batch.column(1):
                n_words, counts = 0, np.zeros(0, np.int64)
                for n, found in windows(s.as_py(), split, max_n):
                    n_words += n
                    more = np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=len(counts))
                    more[: len(counts)] += counts
                    counts = more
                at = np.flatnonzero(counts)
                for column, value in zip(out, (n_words, int(counts.sum()), at.astype("<u4").tobytes(), counts[at].astype("<u4").tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                names=["doc_id", "n_words", "n_features", "buckets", "counts"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary, counts binary"))


def _numbers(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<u4").astype(np.int64)


def bucket_counts(hist: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all documents; a task sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0), batch.column(1)):
                total[_numbers(at)] += _numbers(n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return hist.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): ``buckets`` rows, from (bucket, n) of both sides."""
    both = (corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
            .unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
            .unionByName(corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))))
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = each.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (F.col("all_s") + buckets)) / ((s + 1) * (F.col("all_t") + buckets))
    return each.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))  # totals: one row


def weights(hist: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document: ``buckets`` gains go to the tasks."""
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # as many rows as buckets
        table[r["bucket"]] = r["gain"]

    def run(batches):
        for batch in batches:
            n = np.asarray(batch.column(2))
            total = [int(table[_numbers(at)] @ _numbers(k)) for at, k in zip(batch.column(3), batch.column(4))]
            weight = np.array(total, np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return (hist.select("doc_id", "n_words", "n_features", "buckets", "counts")
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digits, F.lit(8)), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296)) * -1000)


def scores(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document, from a table in the
    shared folder."""
    spark = docs.sparkSession
    folder = run_folder(spark, "resampling")
    histograms(docs, max_n, buckets).write.parquet(f"{folder}/histograms")
    hist = spark.read.parquet(f"{folder}/histograms")
    # the target has ids of its own, or none that matter
    aim = histograms(target.withColumn("doc_id", F.lit(None).cast("long")), max_n, buckets)
    gain = gains(bucket_counts(hist, buckets), bucket_counts(aim, buckets), buckets)
    (weights(hist, gain, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
     .write.parquet(f"{folder}/scores"))
    return spark.read.parquet(f"{folder}/scores")


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row with ``rank`` 1, 2, ... of the ``percent`` of documents of ``min_words`` words
    or more that have the highest scores; null for the others."""
    fit = scored.where(F.col("n_words") >= min_words)
    # One row per distinct score: whole thousandths of a bounded logarithm, so few however many documents.
    each = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.floor(F.sum("n").over(Window.partitionBy(F.lit(1))) * percent / 100)
    stairs = bounded_broadcast(each.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"), drawn.alias("drawn"))
                               .where("above < drawn"))
    found = fit.join(stairs, "score")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    columns = scored.columns
    found = found.withColumn("rank", place.cast("long")).select(*columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    rest = scored.join(stairs.select("score", F.lit(True).alias("in_reach")), "score", "left").where(
        (F.col("n_words") < min_words) | F.col("in_reach").isNull())
    return found.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are drawn (its columns), joined by id: an id that is drawn
    brings its row, equal ids all of theirs; a null id is drawn but names no row."""
    chosen = ranked(scores(docs, target), percent).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(chosen, docs["doc_id"] == chosen["drawn_id"], "left_semi")
