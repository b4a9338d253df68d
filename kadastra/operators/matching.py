"""Which labels stand in which texts, as an equality join: texts are listed by their parts of the labels' lengths.

A label stands in a text if and only if it is one of the text's parts of its own length.  So both sides meet on (keys, part),
exactly and with nothing to check behind the join; no label is paired with a text that lacks it, and a crowded part is an
ordinary skewed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stands_in(labels: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label_id, text_id of every label (keys, label_id, label) that stands in a text (keys, text_id, text), once each.

    Letters are compared as they are; empty and null labels stand nowhere.  The lengths of a key's labels, one short row a
    key, go to its texts."""
    named = labels.filter(F.length("label") > 0).select(*keys, "label_id", F.col("label").alias("part"))
    lengths = named.groupBy(*keys).agg(F.collect_set(F.length("part")).alias("lengths"))
    fits = F.filter("lengths", lambda n: n <= F.length("text"))
    parts = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring("text", i, n))))
    listed = texts.filter(F.length("text") > 0).join(lengths, keys).select(*keys, "text_id", F.explode(F.array_distinct(parts)).alias("part"))
    return named.join(listed, [*keys, "part"]).select(*keys, "label_id", "text_id").distinct()


def either_holds(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, left_id, right_id of labels (keys, id, label) of which one holds the other, letter case aside."""
    a = left.select(*keys, F.col("id").alias("i"), F.lower("label").alias("l"))
    b = right.select(*keys, F.col("id").alias("i"), F.lower("label").alias("l"))

    def names(df: DataFrame, what: str) -> DataFrame:
        return df.select(*keys, F.col("i").alias(f"{what}_id"), F.col("l").alias(what))

    one = stands_in(names(a, "label"), names(b, "text"), keys).select(*keys, F.col("label_id").alias("left_id"), F.col("text_id").alias("right_id"))
    two = stands_in(names(b, "label"), names(a, "text"), keys).select(*keys, F.col("text_id").alias("left_id"), F.col("label_id").alias("right_id"))
    return one.unionByName(two).distinct()
