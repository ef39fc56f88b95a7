"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every text is a bag of its words and word pairs, each hashed by CRC-32 into
``BUCKETS`` buckets.  Two multinomials are counted over whole tables: the raw
corpus (all documents) and the trusted target (documents named by the caller).
A bucket's weight is ``ln((t + K) / (r * f + K))`` with its counts ``t`` and
``r``, the target's share ``f`` of all n-grams and the pseudo-count ``K``; it is
kept as an integer (millionths), so sums do not depend on their order.  A
document's score is the sum of its n-grams' weights over their number, and
every document with a score of ``THRESHOLD`` or more passes: one fixed line, no
sampling.  Four base counts (symbols, repeated lines and windows) come with it.

Plan: one pass counts (explode, map-side partial counts of at most ``BUCKETS``
keys a task, one small shuffle); one pass scores each row on its own against
the weights, a scalar subquery of ``BUCKETS`` integers.  No text is shuffled, no
Python runs.  The trusted ids are broadcast when a count shows few of them,
else joined by a shuffle.

Edge cases: a null, empty or blank text has no words, so ``base_failed``; a
one-word text has one n-gram.  No trusted document: all weights are 0 and the
base rules alone decide.  Null ids are kept and never trusted; repeated rows
are scored each and count each.  Columns of the input cannot clash with
those computed here.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import WORD_BREAKS, bounded_broadcast, packed, spaced, words

BUCKETS = 65536
PSEUDO_COUNT = 16
THRESHOLD = -0.08  # mean log-likelihood ratio of an n-gram, in nats
UNIT = 1_000_000  # weights are whole millionths of a nat
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PLACE_BITS = 23


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def _with_next(items: Column) -> Column:
    """Each item with the one after it (null after the last), as structs x, y."""
    return F.arrays_zip(items.alias("x"), F.slice(items, F.lit(2), F.size(items)).alias("y"))


def _word_bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def _pair_bucket(x: Column, y: Column) -> Column:
    """A pair of neighbours goes by 31 times the first CRC-32 plus the second."""
    return F.pmod(x * 31 + y, F.lit(BUCKETS)).cast("int")


def fit_weights(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row, one column ``weights``: an array of ``BUCKETS`` integers.
    ``trusted_ids``: the ids of the target's documents, in its first column."""
    ids = bounded_broadcast(trusted_ids.select(F.col(trusted_ids.columns[0]).alias("id"))
                            .where("id IS NOT NULL").distinct().withColumn("trusted", F.lit(1)))
    texts = docs.select(F.col(doc_id).alias("id"), words(F.col(text)).alias("w"))
    pairs = (texts.join(ids, "id", "left").select("trusted", _hashes(F.col("w")).alias("h"))
             .select("trusted", F.inline(F.arrays_zip(F.col("h").alias("x"), F.slice("h", F.lit(2), F.size("h")).alias("y")))))
    grams = pairs.select("trusted", F.explode(F.array(
        _word_bucket(F.col("x")), _pair_bucket(F.col("x"), F.col("y")))).alias("bucket")).where("bucket IS NOT NULL")
    counts = grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("r"), F.count("trusted").alias("t"))
    spark = docs.sparkSession
    # All buckets side by side: at most BUCKETS rows, whatever the corpus.
    dense = spark.range(BUCKETS, numPartitions=1).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("r"), F.lit(0).alias("t"))
    every = counts.unionByName(dense).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("c"),
                    F.sum("r").alias("raw"), F.sum("t").alias("target"))
    share = F.col("target") / F.greatest(F.col("raw"), F.lit(1))
    return row.select("c", share.alias("f")).select(F.transform("c", lambda c: F.round(
        F.log((c["t"] + PSEUDO_COUNT) / (c["r"] * F.col("f") + PSEUDO_COUNT)) * UNIT).cast("int")).alias("weights"))


def _same_window(w: Column, a: Column, b: Column) -> Column:
    return ((F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2)))


def _triples(w: Column) -> Column:
    """The 3-word windows as structs x, y, z. (No lambda here reads a column of the row:
    were its expression written into the lambda, it would run for every element.)"""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    return F.arrays_zip(*[F.slice(w, F.lit(k), n).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])


def _windows(w: Column) -> Column:
    """One sorted long per 3-word window: 41 bits of its hash, then 23 of its place."""
    return F.sort_array(F.transform(_triples(w), lambda t, i: F.shiftleft(
        F.xxhash64(t["x"], t["y"], t["z"]), PLACE_BITS).bitwiseOR(i.cast("long"))))


def _equal_neighbours(keys: Column) -> Column:
    """The windows that stand side by side with equal hashes, as structs x, y."""
    return F.filter(_with_next(keys), lambda p: F.shiftright(p["x"], PLACE_BITS) == F.shiftright(p["y"], PLACE_BITS))


def _places(keys: Column) -> Column:
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return F.transform(keys, lambda p: F.struct(place(p["x"]).alias("a"), place(p["y"]).alias("b")))


def _covered(pairs: Column) -> Column:
    places = lambda p: F.array(*[p[s] + k for s in "ab" for k in range(3)])
    return F.size(F.array_distinct(F.flatten(F.transform(pairs, places))))


def _covered_by_text(w: Column) -> Column:
    """The same from the windows' own words, for texts in which hashes meet or
    which are too long for PLACE_BITS."""
    at = F.sort_array(F.transform(_triples(w), lambda t, i: F.struct(
        t["x"].alias("x"), t["y"].alias("y"), t["z"].alias("z"), i.alias("i"))))
    pairs = F.zip_with(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(2), F.size(at)),
                       lambda p, q: F.when((p["x"] == q["x"]) & (p["y"] == q["y"]) & (p["z"] == q["z"]),
                                           F.struct(p["i"].alias("a"), q["i"].alias("b"))))
    return _covered(F.filter(pairs, lambda p: p.isNotNull()))


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_verdict(docs: DataFrame, weights: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (the input row) and ``verdict``: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(WORD_BREAKS))) > 0)
    d = packed(docs).select("row", words(body).alias("w"),
                            F.length(F.replace(spaced(body), F.lit(" "), F.lit(""))).alias("word_chars"),
                            (F.length(body) - F.length(_without(body, SYMBOLS))).alias("n_symbols"),
                            lines.alias("lines"))
    d = d.select("row", "w", "word_chars", "n_symbols", F.size("w").alias("n_words"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                 _windows(F.col("w")).alias("windows"), _hashes(F.col("w")).alias("h"))
    d = d.select("row", "w", "word_chars", "n_symbols", "n_words", "n_dup_lines",
                 _with_next(F.col("h")).alias("hh"), _equal_neighbours(F.col("windows")).alias("equal"))
    # The subquery's array is bound once for the row, not for each n-gram; used
    # once, its column is folded into that expression and no row carries a copy.
    d = d.select("*", weights.scalar().alias("weights"))
    total = F.transform(F.array("weights"), lambda t: F.aggregate(
        F.col("hh"), F.lit(0).cast("long"), lambda s, p: s + F.get(t, _word_bucket(p["x"])).cast("long")
        + F.coalesce(F.get(t, _pair_bucket(p["x"], p["y"])), F.lit(0)).cast("long")))[0]
    d = d.select("row", "w", "word_chars", "n_symbols", "n_words", "n_dup_lines",
                 _places(F.col("equal")).alias("pairs"), total.alias("total"),
                 F.greatest(2 * F.col("n_words") - 1, F.lit(0)).alias("n_grams"))
    by_hash = (F.col("n_words") < (1 << PLACE_BITS)) & F.transform(F.array("w"), lambda w: F.forall(
        F.col("pairs"), lambda p: _same_window(w, p["a"], p["b"])))[0]
    repeats = F.when(F.size("pairs") == 0, F.lit(0)).when(by_hash, _covered(F.col("pairs"))).otherwise(_covered_by_text(F.col("w")))
    d = d.select("row", "word_chars", "n_symbols", "n_words", "n_dup_lines", "n_grams", "total",
                 repeats.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    likely = F.col("total") >= F.lit(round(THRESHOLD * UNIT)).cast("long") * F.col("n_grams")
    counts = [F.col(c).cast("long").alias(c) for c in
              ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select("row", F.struct(*counts, failed.alias("base_failed"),
                                    (F.col("total") / F.greatest(F.col("n_grams"), F.lit(1)) / UNIT).alias("llr"),
                                    (~failed & likely).alias("kept")).alias("verdict"))


def quality_verdicts(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its id and the verdict's columns."""
    judged = with_verdict(docs, fit_weights(docs, trusted_ids, text, doc_id), text)
    return judged.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "verdict.*")


def keep_likely(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input rows that pass, with the input's columns.

    The verdict is computed below a column that is not deterministic: else the optimiser
    would move the filter down, writing the verdict's expressions into one another,
    and split the text again for each of its words.
    """
    judged = with_verdict(docs, fit_weights(docs, trusted_ids, text, doc_id), text)
    place = F.monotonically_increasing_id().alias("place")
    return judged.select("row", "verdict", place).where("verdict.kept AND place >= 0").select("row.*")


def trusted_from_labels(labels: DataFrame) -> DataFrame:
    """The trusted target: documents with a label row of quality 1."""
    return labels.where("quality = 1").select("doc_id")
