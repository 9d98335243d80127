"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of all rows; so there are fewer hot keys than that.
SHARES = 1000
#: No key with fewer rows is hot.
LEAST_ROWS = 200


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> list[tuple]:
    """(key columns, parts) of the hot keys of a table of counted keys; at most SHARES rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(LEAST_ROWS, total // SHARES)
    rows = counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int"))
    return [tuple(r) for r in rows.collect()]


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], counts: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The inner join of `many` with `one` on `keys`, whose names both have.

    The rows of a hot key are spread over as many parts as its share asks for, by the hash of the
    columns `spread`; the rows of `one` with that key are repeated for each part. counts: `keys`
    and n, the rows of `many` for each key, where they are known already. parts: partitions of the
    join, for work on its rows that takes much longer than their size tells."""
    counts = many.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = hot_keys(counts, keys)
    dealt = lambda df, by: df.repartition(parts, *by) if parts else df
    if not hot:
        return dealt(many, keys).join(dealt(one, keys), keys)
    kinds = ", ".join(f"{k} {many.schema[k].dataType.simpleString()}" for k in keys)
    spots = F.broadcast(many.sparkSession.createDataFrame(hot, f"{kinds}, _parts int"))
    left = many.join(spots, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = one.join(spots, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt(left, [*keys, "_part"]).join(dealt(right, [*keys, "_part"]), [*keys, "_part"]).drop("_part")


#: Bits of the sieve for each id, and most bits (a 64-bit word is a row of a broadcast table).
BITS_FOR_EACH, MOST_BITS = 16, 1 << 26


def sieve(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose long `key` is in `ids` (one long column), and a few others: a filter inside
    the scan, before the rows are shuffled for the join that decides. The ids are marked in one
    bitmap of bounded size, so with very many ids it lets more rows through and loses none."""
    name = ids.columns[0]
    n = ids.count()
    bits = 64
    while bits < min(MOST_BITS, n * BITS_FOR_EACH):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place(F.col(name))
    words = ids.select(F.shiftright(at, 6).alias("_word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(`%s`), 64L) as int))" % name).alias("_bit"))
    words = F.broadcast(words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    kept = rows.withColumn("_word", F.shiftright(place(F.col(key).cast("long")), 6)).join(words, "_word")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(cast(`%s` as long)), 64L) as int))" % key)
    return kept.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
