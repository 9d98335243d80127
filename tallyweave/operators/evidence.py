"""Evidence of proposed findings: only what resolves to records counts."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.session import ship
from tallyweave.shared import written


def rehydrated(cited: DataFrame, records: DataFrame) -> DataFrame:
    """(proposal_id, position, record_id, ...) of cited ids that exist; the first citing of an
    id keeps its place. cited: proposal_id, record_ids."""
    ids = cited.select("proposal_id", F.posexplode(F.array_distinct("record_ids")).alias("position", "record_id"))
    return ids.join(records, "record_id")


def valid_proposals(cited: DataFrame, records: DataFrame) -> DataFrame:
    """Proposals all of whose different cited ids exist; one unknown id drops the whole, and
    so does citing nothing."""
    ids = cited.select("proposal_id", F.explode(F.array_distinct("record_ids")).alias("record_id"))
    known = records.select("record_id").distinct().withColumn("_known", F.lit(1))
    told = ids.join(known, "record_id", "left").groupBy("proposal_id").agg(F.count("*").alias("n_cited"), F.count("_known").alias("n_known"))
    return told.where(F.col("n_cited") == F.col("n_known")).select("proposal_id", "n_cited")


class StopRun(Exception):
    """Raised by a scorer that can't work at all (no access, wrong settings)."""


class RunStopped(Exception):
    """A run of a scorer that gave no usable result."""


STOPPED = "stopped: "


def scored(entries: DataFrame, scorer: Callable[[dict], list[dict]], schema: str, tries: int = 1) -> DataFrame:
    """Proposals of an external scorer for each entry (a row), with `error` where it failed `tries`
    times: one entry's failure doesn't stop the others. StopRun isn't tried again: its task asks the
    scorer no more and marks its other entries too, so such a run makes a call in each task at most;
    `checked` then ends it."""
    ship(entries.sparkSession)
    columns = [c.split()[0] for c in schema.split(",")]

    def asked(row: dict) -> list[dict]:
        for k in range(tries):
            try:
                return [{**p, "error": None} for p in scorer(row)]
            except StopRun:
                raise
            except Exception as e:  # an outside model may fail in any way
                if k == tries - 1:
                    return [{"error": str(e)}]
        return []

    def run(frames):
        stopped = None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                entry = json.dumps(row, default=str, sort_keys=True)
                if stopped is None:
                    try:
                        out += [{**p, "entry": entry} for p in asked(row)]
                        continue
                    except StopRun as e:
                        stopped = f"{STOPPED}{e}"
                out.append({"entry": entry, "error": stopped})
            rows = pd.DataFrame(out, columns=[*columns, "entry", "error"]).astype(object)
            yield rows.where(rows.notna(), None)

    return entries.mapInPandas(run, f"{schema}, entry string, error string")


def checked(proposals: DataFrame) -> DataFrame:
    """The proposals without errors, written once (the scorer isn't asked again). Raises RunStopped if the
    scorer stopped, or if it failed for all entries that it answered."""
    own = written(proposals, "proposals")
    n = own.agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.max(F.when(F.startswith("error", F.lit(STOPPED)), F.col("error"))).alias("stop")).first()
    if n.stop is not None or (n.n > 0 and n.n == n.bad):
        raise RunStopped(n.stop or f"all {n.n} entries failed")
    return own.where("error IS NULL").drop("error")


def findings(proposals: DataFrame, records: DataFrame, dossier: str) -> tuple[DataFrame, DataFrame]:
    """Findings (finding_id, evidence_count, and the proposals' other columns) of proposals (record_ids, ...) all of whose
    records exist, and their evidence (finding_id, evidence_id, position, and the records' columns), numbered from 1
    in the order they are cited. The id is made of the dossier and the cited ids, whatever their order."""
    key = F.concat(F.lit(f"{dossier}|"), F.array_join(F.array_sort("record_ids"), "|"))
    name = F.concat(F.lit("AI-"), F.left(F.replace(exprs.uuid5(key), F.lit("-"), F.lit("")), F.lit(12)))
    own = proposals.withColumn("proposal_id", name)
    records = records.repartition("record_id").distinct()
    cited = own.select("proposal_id", "record_ids").dropDuplicates(["proposal_id"])
    found = own.join(valid_proposals(cited, records), "proposal_id").withColumnsRenamed({"proposal_id": "finding_id", "n_cited": "evidence_count"})
    ids = cited.select("proposal_id", F.posexplode(F.array_distinct("record_ids")).alias("position", "record_id"))
    rows = ids.join(records.withColumn("_known", F.lit(True)), "record_id", "left")
    whole = F.min(F.coalesce("_known", F.lit(False))).over(Window.partitionBy("proposal_id"))  # the check of valid_proposals, where the rows are numbered
    place = F.row_number().over(Window.partitionBy("proposal_id").orderBy("position"))
    rows = rows.withColumn("_whole", whole).withColumn("position", place).where("_whole").drop("_whole", "_known")
    rows = rows.withColumn("evidence_id", F.concat_ws("-", "proposal_id", F.concat(F.lit("E"), F.col("position").cast("string"))))
    return found.drop("record_ids"), rows.withColumnRenamed("proposal_id", "finding_id")
