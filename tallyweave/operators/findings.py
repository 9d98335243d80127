"""Review findings with the evidence behind them.

Every check gives rows (case, evidence_id, choice, record_id, place, amount): the records that speak for
a case, by the choice that found them. Of the choices of one piece of evidence, the first that has rows
counts; evidence is its number of records, the first record by place and the sum of absolute
amounts. One grouped plan picks this for all checks and cases; no branch waits for another's count.

Records: record_id, place (any ordered struct, as path, row and id) and the columns each rule names.
Nulls in a column make its test fail and drop no other evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.rules import MONEY, amount_at_risk, contains_any
from tallyweave.operators.substrings import contained

# Words of the rules, and how many records a fallback takes.
PAYMENT_WORDS = ["Zahlung", "Überweisung", "Ueberweisung"]
PAYMENT_CODE = "ZA"
REPAIR_WORDS = ["Reparatur", "Instandsetzung", "Austausch", "Generalueberholung", "Generalüberholung"]
REPAIR_ACCOUNT = "670"
ACCRUAL_WORDS = ["Rückstellung", "Rueckstellung", "Abgrenzung", "ARAP", "PRAP"]
LIMIT_WORDS = ["10.000", "10000", "Wesentlichkeit", "Schwellenwert"]
PLANNING_PATHS = ["Pruefungsplanung", "Prüfungsplanung"]
FIRST = {"E1-5": 3, "E3-1": 5, "E4-1": 3}


def rows_of(records: DataFrame, evidence_id: str, choice: int = 1, case: str | Column = "case", amount: str = "amount") -> DataFrame:
    """The rows of a check."""
    own = F.col(amount).cast("double") if amount in records.columns else F.lit(None).cast("double")
    return records.select((F.col(case) if isinstance(case, str) else case).alias("case"), F.lit(evidence_id).alias("evidence_id"), F.lit(choice).alias("choice"), "record_id", "place", own.alias("amount"))


def picked(rows: list[DataFrame]) -> DataFrame:
    """(case, evidence_id, n_records, record_id, amount): of each piece of evidence the first choice with rows."""
    every = reduce(lambda a, b: a.unionByName(b), rows)
    sums = every.groupBy("case", "evidence_id", "choice").agg(
        F.count("*").alias("n_records"), F.min_by("record_id", "place").alias("record_id"), amount_at_risk().alias("amount")
    )
    best = sums.groupBy("case", "evidence_id").agg(F.min_by(F.struct("n_records", "record_id", "amount"), "choice").alias("b"))
    return best.select("case", "evidence_id", "b.*")


def findings(evidence: DataFrame, at_risk: DataFrame, high: Column) -> DataFrame:
    """(case, evidence_count, evidence_ids, confidence, amount_at_risk). at_risk: case, amount_at_risk; high: over
    evidence_count and evidence_ids."""
    sums = evidence.groupBy("case").agg(F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return sums.withColumn("confidence", F.when(high, "high").otherwise("medium")).join(at_risk, "case", "left")


def _first_rows(records: DataFrame, most: int, case: str = "case", order: list | None = None) -> DataFrame:
    """The first rows of each case; the limit works in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(case).orderBy(*(order or ["place"])))
    return records.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def shell_vendor_evidence(postings: DataFrame, changes: DataFrame, receipts: DataFrame, permissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence and findings of each vendor: E1-1 round amounts, E1-2 master data changed and approved by
    one user, E1-3 postings without receipts, E1-4 the first permission that names this user or
    nobody, E1-5 payments, else the first postings, if there is such a user.
    postings: case (the vendor), amount, kind; changes: case, changed_by, approved_by; receipts: case;
    permissions: user_field."""
    postings = postings.where(F.col("case").isNotNull())
    round_amount = (F.col("amount") != 0) & (F.pmod(F.col("amount").cast(MONEY), F.lit(10).cast(MONEY)) == 0)
    own = changes.where((F.trim("changed_by") != "") & (F.col("changed_by") == F.col("approved_by")))
    suspects = own.groupBy("case").agg(F.min_by("changed_by", "place").alias("user"))
    lacking = postings.join(receipts.select("case").distinct(), "case", "left_anti")
    fields = contained(suspects.select(F.col("user").alias("name")), permissions.select(F.col("user_field").alias("text")))
    first = permissions.groupBy(F.col("user_field").alias("text")).agg(F.min(F.struct("place", "record_id")).alias("p"))
    named = fields.join(first, "text").groupBy(F.col("name").alias("user")).agg(F.min("p").alias("p"))
    blank = permissions.where(F.coalesce(F.trim("user_field"), F.lit("")) == "").agg(F.min(F.struct("place", "record_id")).alias("b"))
    allowed = suspects.join(named, "user", "left").crossJoin(F.broadcast(blank)).select("case", F.least("p", "b").alias("p")).where("p IS NOT NULL")  # blank is one row
    theirs = postings.join(suspects.select("case"), "case", "left_semi")
    paid = F.contains("kind", F.lit("Zahlung")) | F.contains(F.upper("kind"), F.lit(PAYMENT_CODE))
    evidence = picked([
        rows_of(postings.where(round_amount), "E1-1"), rows_of(own, "E1-2"), rows_of(lacking, "E1-3"),
        rows_of(allowed.select("case", "p.record_id", "p.place"), "E1-4"),
        rows_of(theirs.where(paid), "E1-5"), rows_of(_first_rows(theirs, FIRST["E1-5"]), "E1-5", 2),
    ])
    at_risk = postings.groupBy("case").agg(amount_at_risk().alias("amount_at_risk"))
    return evidence, findings(evidence, at_risk, F.col("evidence_count") >= 3)


def repair_evidence(assets: DataFrame, postings: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E2-1 assets that are called repairs, E2-2 their postings, E2-3 the first such asset, beside the number
    of journal entries on repair accounts (n_records). assets: case, asset_id, name; postings: case, asset_id,
    amount; journal: case, account."""
    repairs = assets.where(contains_any(F.col("name"), REPAIR_WORDS))
    booked = postings.join(repairs.select("case", "asset_id").where("asset_id IS NOT NULL").distinct(), ["case", "asset_id"], "left_semi")
    evidence = picked([rows_of(repairs, "E2-1"), rows_of(booked, "E2-2"), rows_of(repairs, "E2-3")])
    spent = journal.where(F.startswith("account", F.lit(REPAIR_ACCOUNT))).groupBy("case").agg(F.count("*").alias("_spent"))
    n = F.when(F.col("evidence_id") == "E2-3", F.coalesce("_spent", F.lit(0))).otherwise(F.col("n_records"))
    evidence = evidence.join(spent, "case", "left").withColumn("n_records", n).drop("_spent")
    at_risk = booked.groupBy("case").agg(amount_at_risk().alias("amount_at_risk"))
    return evidence, findings(evidence, at_risk, F.col("evidence_count") >= 2)


def cut_off_evidence(invoices: DataFrame, receipts: DataFrame, journal: DataFrame, month: str, before: str) -> tuple[DataFrame, DataFrame]:
    """E3-1 invoices of the month for services of the month before (by both dates, else by whichever date
    there is, else the first ones), E3-2 receipts of the month before, E3-3 the first such invoice beside
    the number of accruals made in time (n_records), E3-4 other accruals. invoices: case, booked, served, date,
    amount (of the month's file); receipts: case, date; journal: case, text, date. month, before: yyyy-mm."""
    german = lambda m: f"{m[5:]}.{m[:4]}"
    within = lambda c, m: F.coalesce(F.contains(c, F.lit(m)) | F.contains(c, F.lit(german(m))), F.lit(False))
    any_date = F.coalesce(F.nullif("booked", F.lit("")), F.nullif("served", F.lit("")), F.col("date"))
    in_month = within(F.col("booked"), month)
    late = invoices.where((in_month & within(F.col("served"), before)) | (~in_month & within(any_date, before)))
    accruals = journal.where(contains_any(F.coalesce("text", F.lit("")), ACCRUAL_WORDS)).withColumn("_own", within(F.col("date"), before))
    first = _first_rows(invoices, FIRST["E3-1"])
    evidence = picked([
        rows_of(late, "E3-1"), rows_of(first, "E3-1", 2), rows_of(receipts.where(within(F.col("date"), before)), "E3-2"),
        rows_of(late, "E3-3"), rows_of(first, "E3-3", 2), rows_of(accruals.where("NOT _own"), "E3-4"),
    ])
    made = accruals.where("_own").groupBy("case").agg(F.count("*").alias("_made"))
    n = F.when(F.col("evidence_id") == "E3-3", F.coalesce("_made", F.lit(0))).otherwise(F.col("n_records"))
    evidence = evidence.join(made, "case", "left").withColumn("n_records", n).drop("_made")
    at_risk = evidence.where("evidence_id = 'E3-1'").select("case", F.col("amount").alias("amount_at_risk"))
    return evidence, findings(evidence, at_risk, F.col("evidence_count") >= 3)


def split_payment_evidence(journal: DataFrame, documents: DataFrame, limit: float = 10_000.0, low: float = 9_000.0) -> tuple[DataFrame, DataFrame]:
    """E4-1 the group of two payments and more of one date and counter account, each below the limit, with the
    highest sum, else the highest payments, E4-3 that group if it reaches the limit together, E4-2 the
    first document about the limit. journal: case, text, amount, date, counter; documents: case, path, text."""
    words = F.split(F.upper(F.coalesce("text", F.lit(""))), r"\s+")
    paid = reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in PAYMENT_WORDS]) | F.array_contains(words, PAYMENT_CODE)
    near = journal.where(paid & (F.abs("amount") >= low) & (F.abs("amount") < limit))
    keys = ["case", "date", "counter"]
    near = near.withColumns({c: F.coalesce(c, F.lit("")) for c in keys[1:]})
    groups = near.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.abs("amount").cast(MONEY)).alias("combined")).where("n >= 2")
    best = groups.groupBy("case").agg(F.min(F.struct((-F.col("combined")).alias("less"), "date", "counter")).alias("b"))
    best = best.select("case", "b.date", "b.counter", (-F.col("b.less")).alias("combined"))
    own = near.join(best, keys)
    top = _first_rows(near, FIRST["E4-1"], order=[F.desc(F.abs("amount")), "place"])
    high = Window.partitionBy("case").orderBy(F.desc(F.abs("amount")), "place")
    top = top.withColumn("place", F.struct(F.row_number().over(high).alias("k")))  # the highest one is the first
    about = documents.where(contains_any(F.coalesce("path", F.lit("")), PLANNING_PATHS) | reduce(lambda a, b: a | b, [F.coalesce(F.contains("text", F.lit(w)), F.lit(False)) for w in LIMIT_WORDS]))
    about = _first_rows(about, 1)
    evidence = picked([rows_of(own, "E4-1"), rows_of(own.where(F.col("combined") >= limit), "E4-3"), rows_of(about, "E4-2")])
    fallback = picked([rows_of(top, "E4-1", 2)])
    evidence = evidence.unionByName(fallback.join(evidence.where("evidence_id = 'E4-1'").select("case"), "case", "left_anti"))
    at_risk = groups.groupBy("case").agg(F.sum("combined").cast("double").alias("amount_at_risk"))
    return evidence, _split_findings(evidence, at_risk)


def _split_findings(evidence: DataFrame, at_risk: DataFrame) -> DataFrame:
    """A finding about split payments is sure if there is any group of them."""
    found = findings(evidence, at_risk, F.lit(False))
    return found.withColumn("confidence", F.when(F.col("amount_at_risk").isNotNull(), "high").otherwise("medium"))
