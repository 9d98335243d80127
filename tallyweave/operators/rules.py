"""Review rules with their thresholds, keywords and entities as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.substrings import contained

MONEY = "decimal(18,2)"


def contains_any(text: Column, words: list[str]) -> Column:
    """Any of the words, whatever their case."""
    low = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w.lower()))
    return found


def amount_at_risk(column: str = "amount") -> Column:
    """Sum of absolute amounts; null instead of 0."""
    return F.nullif(F.sum(F.abs(column).cast(MONEY)).cast("double"), F.lit(0.0))


def shell_vendors(postings: DataFrame, receipts: DataFrame, round_to: int = 10) -> DataFrame:
    """Every vendor's postings, those of round amounts, the amount at risk, and whether any
    receipt names it; only vendors without receipts, or all of whose amounts are round."""
    round_amount = (F.col("amount") != 0) & (F.pmod(F.round("amount", 2).cast(MONEY), F.lit(round_to).cast(MONEY)) == 0)
    sums = postings.groupBy("vendor_id").agg(
        F.count("*").alias("n_postings"), F.count_if(round_amount).alias("n_round"), amount_at_risk().alias("amount_at_risk")
    )
    lacking = sums.join(receipts.select("vendor_id").distinct(), "vendor_id", "left_anti").select("vendor_id", F.lit(True).alias("without_receipt"))
    rows = sums.join(lacking, "vendor_id", "left").withColumn("without_receipt", F.coalesce("without_receipt", F.lit(False)))
    return rows.where(F.col("without_receipt") | (F.col("n_round") == F.col("n_postings")))


def repairs_capitalised(assets: DataFrame, postings: DataFrame, keywords: list[str]) -> DataFrame:
    """Assets whose name sounds like a repair and that have postings, with their amounts.
    assets: asset_id, name; postings: asset_id, amount."""
    named = assets.where(contains_any(F.col("name"), keywords))
    return named.join(postings, "asset_id").groupBy("asset_id", "name").agg(F.count("*").alias("n_postings"), amount_at_risk().alias("amount_at_risk"))


def wrong_period(bookings: DataFrame) -> DataFrame:
    """Bookings whose service belongs to an earlier month. bookings: record_id, booked, served
    (ISO dates), amount."""
    month = lambda c: F.substring(c, 1, 7)
    return bookings.where(month("served") < month("booked")).select(
        "record_id", month("booked").alias("booked_period"), month("served").alias("served_period"), "amount"
    )


def split_payments(postings: DataFrame, low: float, high: float, keys: list[str], combined: float) -> DataFrame:
    """Groups of two payments and more just below a limit (low <= |amount| < high) that
    together reach `combined`."""
    near = postings.where((F.abs("amount") >= low) & (F.abs("amount") < high))
    sums = near.groupBy(*keys).agg(F.count("*").alias("n_payments"), F.sum(F.abs("amount").cast(MONEY)).cast("double").alias("combined"))
    return sums.where((F.col("n_payments") >= 2) & (F.col("combined") >= combined))


def permissions_of(users: DataFrame, permissions: DataFrame) -> DataFrame:
    """Permission rows that name a user anywhere in their text, inside of longer words too, or nobody.
    users: user; permissions: perm_id, text."""
    named = contained(users.select(F.col("user").alias("name")), permissions).withColumnRenamed("name", "user")
    blank = permissions.where(F.coalesce(F.trim("text"), F.lit("")) == "").select("perm_id", F.lit(None).cast("string").alias("user"), "text")
    return permissions.join(named, "text").select("perm_id", "user", "text").unionByName(blank).distinct()
