"""A bounded labelled sample for fitting a classifier, and the folds of its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: int, max_words: int,
                   text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Columns id, lang, text, y: at most ``per_class`` documents of each class.

    The ids are chosen from the labels alone, by the order of a hash of the id, so
    the choice does not depend on how rows are spread; they are few (a bound given
    by the caller), so they are broadcast and no text is shuffled.  Labelled texts
    of more than ``max_words`` spaces and line breaks are not learnt from (all
    texts are scored).  Several label rows of one document: the larger counts;
    null ids and null labels are left out."""
    y = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
         .where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).where(may_learn))
    chosen = None
    for value in (0, 1):
        part = y.where(F.col("y") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                    (F.col(lang) if lang in docs.columns else F.lit(None).cast("string")).alias("lang"))
    breaks = F.length("text") - F.length(F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    # At most one row of a repeated id is learnt from.
    return (d.join(F.broadcast(chosen), "id").where(breaks < max_words)
            .groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("d")).select("id", "y", "d.*"))
