"""Tables of records, findings and graphs as Parquet: upserts, pages, versions, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.snapshots import Snapshots


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: each key's row with the greatest `order`. A grouped maximum, so many
    writes of one key are folded before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with rows of `changes` put in place of those with the same keys."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def page(rows: DataFrame, order: list, limit: int | None = None, offset: int = 0, default: int = 50, most: int = 200) -> DataFrame:
    """A page of an ordered table: limits are kept within 1 and `most`, offsets at 0 and more."""
    n = default if limit is None else max(1, min(limit, most))
    return rows.orderBy(*order).offset(max(0, offset)).limit(n)


def of(rows: DataFrame, **scope) -> DataFrame:
    """Rows of a scope (dossier, file, type, ...): equal in all the named columns."""
    for name, value in scope.items():
        rows = rows.where(F.col(name) == value)
    return rows


def updated(table: DataFrame, keys: DataFrame, key: str, values: dict) -> DataFrame:
    """`table` with `values` (column expressions) set in the rows whose key is among `keys`."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    rows = table.join(hit, key, "left")
    kinds = dict(table.dtypes)
    return rows.select(*[F.when(F.col("_hit"), values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def by_basename(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """`rows` (with path) and the least `key` of the files (path, key) of the same base name."""
    base = F.substring_index("path", "/", -1).alias("_base")
    first = files.select(base, key).groupBy("_base").agg(F.min(key).alias(key))
    return rows.select("*", base).join(first, "_base", "left").drop("_base")


def save_version(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Publishes all tables of a snapshot under its version, the one after the newest; raises
    snapshots.Conflict if another writer has published that version."""
    Snapshots(next(iter(tables.values())).sparkSession, folder).commit(tables, version - 1)


def load_version(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the newest published snapshot."""
    snapshots = Snapshots(spark, folder)
    version = snapshots.current()
    return {n: snapshots.read(n, version) for n in names}


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
