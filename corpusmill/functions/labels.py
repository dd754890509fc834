"""Labels and bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusmill import fixed_values as fixed


def first_words(words: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(words, 1, n), ", ")


def auto_label(topic_id: Column, words: Column, n: int = 3) -> Column:
    return F.concat(F.lit("Topic "), topic_id.cast("string"), F.lit(": "), first_words(words, n))


def display_name(topic_id: Column, label: Column) -> Column:
    """`Topik i: label`, or just `Topik i` without a label."""
    plain = F.concat(F.lit("Topik "), topic_id.cast("string"))
    return F.when(label.isNull(), plain).otherwise(F.concat(plain, F.lit(": "), label))


def similarity_band(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def coherence_band(score: Column) -> Column:
    band = F.lit(None).cast("string")
    for upper, name in reversed(fixed.COHERENCE_BANDS):
        # the last band takes its upper bound in, the others do not
        inside = score <= upper if upper == fixed.COHERENCE_BANDS[-1][0] else score < upper
        band = F.when(inside, name).otherwise(band)
    return F.when(score > fixed.COHERENCE_BANDS[-1][0], fixed.COHERENCE_TOP_BAND).otherwise(band)


def severity_band(missing_pct: Column) -> Column:
    return F.when(missing_pct > 50, "high").when(missing_pct > 20, "medium").otherwise("low")
