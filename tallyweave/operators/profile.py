"""Profiles of a dossier: counts, quantiles, completeness, shapes, scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.ranks import ranked
from tallyweave.shared import written

QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
MONEY = "decimal(18,2)"


def money_sum(column: str) -> Column:
    """Sum of two-decimal amounts without the order's effect on the last digits."""
    return F.sum(F.col(column).cast(MONEY)).cast("double")


def type_counts(records: DataFrame) -> DataFrame:
    """Records, different periods and their first and last for each record type."""
    month = F.nullif(F.substring("date", 1, 7), F.lit(""))
    return records.groupBy("record_type").agg(
        F.count("*").alias("n_records"), F.count_distinct(month).alias("n_periods"), F.min(month).alias("first_period"), F.max(month).alias("last_period")
    )


def quantiles(rows: DataFrame, value: str, points: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(p, value) at the rank bround(p * (n - 1)) of the sorted values, without interpolation.

    Equal values are counted before they are ranked."""
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    counted = ranked(values.groupBy("v").agg(F.count("*").alias("n")), [F.col("v")], "hi", weight="n")
    total = values.agg(F.count("*").alias("n"))
    wanted = total.select("n", F.explode(F.array(*map(F.lit, points))).alias("p")).where(F.col("n") > 0)
    wanted = wanted.select("p", (F.bround(F.col("p") * (F.col("n") - 1)) + 1).cast("long").alias("at"))
    held = F.col("at").between(F.col("hi") - F.col("n") + 1, F.col("hi"))
    return counted.join(F.broadcast(wanted), held).select("p", F.col("v").alias("value"))  # a row for each point


def entity_profile(links: DataFrame, kinds: list[str]) -> DataFrame:
    """Profile of each entity. links: entity_id, edge_type, record_id, date, amount. Records
    count once for an entity; edge types that it lacks count 0. Links are summed for each record first,
    then for each entity."""
    counts = [F.count_if(F.col("edge_type") == k).alias(k) for k in kinds]
    once = links.groupBy("entity_id", "record_id").agg(F.min(F.struct("date", "amount")).alias("r"), *counts)
    return once.select("entity_id", "r.*", *kinds).groupBy("entity_id").agg(
        F.count("*").alias("n_records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        money_sum("amount").alias("sum_amount"), F.round(money_sum("amount") / F.count("amount"), 4).alias("mean_amount"),
        *[F.sum(k).alias(k) for k in kinds],
    )


def completeness(entries: DataFrame) -> DataFrame:
    """For each graph_id: whether any record has a date, an amount, a counterparty, a document
    reference. entries: graph_id, record_id, date, amount, vendor_id, customer_id, doc_id."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return entries.groupBy("graph_id").agg(
        F.count("*").alias("n_records"),
        some(full("date")).alias("has_date"),
        some(F.col("amount").isNotNull()).alias("has_amount"),
        some(full("vendor_id") | full("customer_id")).alias("has_counterparty"),
        some(full("doc_id")).alias("has_document"),
    )


def fill_rates(entries: DataFrame, fields: list[str], by: str = "graph_id") -> DataFrame:
    """(by, field, filled, applicable) of each field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    rows = entries.select(by, F.explode(pairs).alias("x")).select(by, "x.field", "x.v")
    return rows.groupBy(by, "field").agg(F.count_if(F.coalesce(F.trim("v") != "", F.lit(False))).alias("filled"), F.count("*").alias("applicable"))


def entry_facts(entries: DataFrame) -> DataFrame:
    """graph_id, shape, n_records, score and the dimensions of completeness of each entry: entries are
    summed for each record type first, then put together, in one pass over them."""
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    kinds = entries.groupBy("graph_id", "record_type").agg(
        F.count("*").alias("n"), F.max(F.abs("amount")).alias("score"), F.max(full("date")).alias("has_date"), F.max(F.col("amount").isNotNull()).alias("has_amount"),
        F.max(full("vendor_id") | full("customer_id")).alias("has_counterparty"), F.max(full("doc_id")).alias("has_document"),
    )
    return kinds.groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("x", "record_type", "n"))), "|").alias("shape"), F.sum("n").alias("n_records"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), *[F.max(c).alias(c) for c in DIMENSIONS],
    )


DIMENSIONS = ["has_date", "has_amount", "has_counterparty", "has_document"]


def shapes(entries: DataFrame) -> DataFrame:
    """(graph_id, shape): the sorted multiset of an entry's record types, as counted pairs."""
    counts = entries.groupBy("graph_id", "record_type").agg(F.count("*").alias("n"))
    pair = F.concat_ws("x", "record_type", "n")
    return counts.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), "|").alias("shape"))


def of_shapes(facts: DataFrame) -> DataFrame:
    """Entries of each shape, and how many have each completeness dimension. facts: as entry_facts gives them."""
    return facts.groupBy("shape").agg(F.count("*").alias("n_entries"), *(F.count_if(F.col(d)).alias(f"with_{d[4:]}") for d in DIMENSIONS))


def shape_profile(entries: DataFrame) -> DataFrame:
    """Entries of each shape, and how many have each completeness dimension."""
    return of_shapes(entry_facts(entries))


def scores(entries: DataFrame) -> DataFrame:
    """(graph_id, score): the largest absolute amount, 0 without amounts."""
    return entries.groupBy("graph_id").agg(F.coalesce(F.max(F.abs("amount")), F.lit(0.0)).alias("score"))


def subtotals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by keys and sign; zero is positive, nulls are left out."""
    sign = F.when(F.col("amount") < 0, "negative").otherwise("positive").alias("sign")
    return rows.where(F.col("amount").isNotNull()).groupBy(*keys, sign).agg(F.count("*").alias("n"), money_sum("amount").alias("total"))


def ranked_entries(entries: DataFrame, most: int | None = None) -> DataFrame:
    """Entries by materiality: more quantile points of all amounts reached, rarer shape, more
    of what others of the shape have missing, graph_id. `rank` counts from 1."""
    points = quantiles(entries, "amount").select("value")
    facts = written(entry_facts(entries), "entry-facts")  # read for the shapes' sums too
    reached = facts.join(F.broadcast(points.agg(F.collect_list("value").alias("points"))))  # one row of seven points
    reached = reached.withColumn("amount_rank", F.size(F.filter("points", lambda p: F.col("score") >= p)).cast("long"))
    dims = ["date", "amount", "counterparty", "document"]
    lacking = sum(((~F.col(f"has_{d}")) & (F.col(f"with_{d}") > 0)).cast("int") for d in dims)
    rows = reached.join(of_shapes(facts), "shape").select("graph_id", "score", "amount_rank", "n_entries", lacking.alias("absences"))
    order = [F.desc("amount_rank"), F.asc("n_entries"), F.desc("absences"), F.asc("graph_id")]
    columns = ["graph_id", "score", "amount_rank", "n_entries", "absences"]
    if most is not None:  # a report: Spark keeps the first rows of each task and merges them
        top = rows.orderBy(*order).limit(most)
        return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *columns)
    return ranked(rows.select(*columns), order).select("rank", *columns)


def nearest_supersets(profile: DataFrame) -> DataFrame:
    """For each set of types: the strict superset with the fewest extra types, then by name.
    profile: shape, types (array). A table of shapes; supersets share their least type, so the
    rows are joined on it and not all with all."""
    small = profile.select("shape", "types", F.array_min("types").alias("t"))
    large = profile.select(F.col("shape").alias("superset"), F.col("types").alias("more"), F.explode("types").alias("t"))
    fits = (F.size(F.array_except("types", "more")) == 0) & (F.size(F.array_except("more", "types")) > 0)
    extra = F.size(F.array_except("more", "types"))
    best = F.min(F.struct(extra.alias("n_extra"), "superset"))
    return small.join(large, "t").where(fits).groupBy("shape").agg(best.alias("b")).select("shape", "b.superset", "b.n_extra")


def first_records(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, k, record_id): the first `most` different records of each key. The limit on the rank
    works in each task before the shuffle, so a hot key stays small."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("record_id"))
    return rows.select(key, "record_id").distinct().withColumn("k", rank).where(F.col("k") <= most).select(key, "k", "record_id")


def cap_report(entries: DataFrame, cap: int) -> DataFrame:
    """n_entries, n_analysed, n_left, cap_reached: what a limit on model calls leaves out."""
    n = entries.agg(F.count_distinct("graph_id").alias("n_entries"))
    left = F.greatest(F.col("n_entries") - cap, F.lit(0))
    return n.select("n_entries", F.least("n_entries", F.lit(cap)).alias("n_analysed"), left.alias("n_left"), (F.col("n_entries") > cap).alias("cap_reached"))
