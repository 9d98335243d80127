"""Joins of names with the texts that contain them anywhere, without comparing all with all.

Different texts are indexed by their runs of up to GRAM characters. A name can only be in a text that has
the name's rarest run, so each name looks at the texts of that one run, and then at the name itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.shared import Tables
from tallyweave.skew import salted_join

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The different runs of n characters; none of a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda k: F.substring(text, k, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def contained(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, text) of the different names and texts, whatever their case, where the text contains the
    name. names: name; texts: text. Null or empty names are in no text."""
    tables = Tables(names.sparkSession)
    asked = names.select("name", F.lower("name").alias("_low")).where(F.char_length("name") > 0).distinct()
    asked = tables.write(asked.withColumn("_n", F.least(F.char_length("_low"), F.lit(GRAM))), "names")
    known = tables.write(texts.select("text").where(F.col("text").isNotNull()).distinct().withColumn("_key", F.monotonically_increasing_id()), "texts")
    low = F.lower("text")
    index = known.select("_key", F.explode(F.flatten(F.array(*[_grams(low, n) for n in range(1, GRAM + 1)]))).alias("gram"))
    parts = asked.select("_low", "_n", F.explode(F.when(F.col("_n") == GRAM, _grams(F.col("_low"), GRAM)).otherwise(F.array("_low"))).alias("gram")).distinct()
    wanted = parts.select("gram").distinct()
    index = tables.write(salted_join(index, wanted, ["gram"], ["_key"]), "grams")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "gram", "left").groupBy("_low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = rarest.where("r.n > 0").select("_low", F.col("r.gram").alias("gram"))  # a run that no text has: no text has the name
    pairs = salted_join(index, rarest, ["gram"], ["_key"]).select("_low", "_key")
    found = pairs.join(known, "_key").where(F.contains(low, F.col("_low"))).select("_low", "text")
    return found.join(asked, "_low").select("name", "text")
