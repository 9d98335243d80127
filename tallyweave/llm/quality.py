"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier on a few figures of a text, trained on all labelled documents, gives the
evidence of a document alone. The evidence of all documents is summed by host and by path
(the host's language sections). A host's share of good documents is a Beta posterior whose
prior is fitted to the spread between hosts by moments; a path's share is shrunk in the same
way towards its host's. So a site with few documents takes the global share, and one with
many its own. A document's posterior odds are its own odds, moved from the global share to
that of its path, which is taken without the document itself.

Edge cases: null and empty texts have figures of zero; a null host or path is a site of its
own; rows without doc_id are scored like all others; labels that are null or have no
document don't count; if no label of one kind is left, the evidence is the labelled share
(1.0 without labels) for all. Repeated rows each count. Texts of any length are read whole, one
at a time; columns of any other name may stand beside.
"""

from __future__ import annotations

from collections import Counter
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.ragged import tidy
from tallyweave.session import ship
from tallyweave.shared import written

# Characters that prose has few of.
SYMBOLS = "*#%&$<>{}[]\\^~=_@/+"
FIGURES = (
    "words word_length distinct repeated commonest capitals symbols bars exclamations digits stops lines repeated_lines".split()
)
KEEP = 0.5
#: Site tables of up to so many rows are sent to every executor; larger ones are joined.
SITES = 200_000


def figures(text: str) -> list[float]:
    """The FIGURES of a text."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    often = Counter(words)
    lines = text.split("\n")
    return [
        log1p(len(words)),
        sum(map(len, words)) / n,
        len(often) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(often.values(), default=0) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, SYMBOLS)) / chars,
        text.count("|") / chars,
        text.count("!") / chars,
        sum(map(text.count, "0123456789")) / chars,
        sum(map(text.count, ".,;:?")) / chars,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
    ]


def with_figures(rows: DataFrame) -> DataFrame:
    """Rows of (row, text) as (row, figures array<double>)."""
    ship(rows.sparkSession)
    schema = T.StructType([rows.schema["row"], T.StructField("figures", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            made = [figures(b.column(1)[k].as_py() or "") for k in range(b.num_rows)]  # a text at a time
            flat = pa.array(np.array(made, np.float64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(FIGURES)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["row", "figures"])

    return rows.select("row", "text").mapInArrow(tidy(run), schema)


def train(figured: DataFrame, labels: DataFrame) -> list[float]:
    """Intercept and weights of the classifier, from every labelled document of `figured`
    (doc_id, figures); labels: doc_id, quality (1 good, 0 bad)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = written(figured.join(known, "doc_id").select("label", array_to_vector("figures").alias("features")), "quality-labelled")
    told = rows.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    if not told.n or told.good in (0, told.n):
        share = min(1 - 1e-6, max(1e-6, (told.good or 0) / told.n)) if told.n else 1 - 1e-6
        return [float(np.log(share / (1 - share))), *[0.0] * len(FIGURES)]
    model = LogisticRegression(maxIter=40, regParam=1e-3).fit(rows)
    return [float(model.intercept), *map(float, model.coefficients)]


def evidence(figured: Column, model: list[float]) -> Column:
    """The classifier's probability that a document is good, within 1e-6 of 0 and 1."""
    logit = F.lit(model[0])
    for k, w in enumerate(model[1:]):
        logit = logit + F.lit(w) * F.get(figured, k)
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 / (1 + F.exp(-logit))))


def _strength(between: float | None, within: float | None) -> float:
    """Weight of the prior, in documents, by moments: the larger the spread between sites is
    against that inside of them, the less their shares are shrunk."""
    if not between or not within or between <= 0:
        return 1e6
    return float(min(1e6, max(1.0, within / between)))


def site_shares(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """(host, path, n, good, towards, strength) of each path, where `towards` is its host's
    posterior share and `strength` the weight of it; and the global share.
    scored: host, path and p, the evidence."""
    paths = written(scored.groupBy(host, path).agg(F.count("*").alias("n"), F.sum("p").alias("good")), "quality-paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    if not total.n:
        return paths.select(host, path, "n", "good", F.lit(0.5).alias("towards"), F.lit(1.0).alias("strength")), 0.5
    share = min(1 - 1e-6, max(1e-6, total.good / total.n))

    def strength(rows: DataFrame, n: str, good: str, mean: Column) -> float:
        # Var(site share) = spread + share (1 - share) / n: the second part is what chance alone adds.
        w = rows.select(F.col(n).alias("n"), (F.col(good) / F.col(n)).alias("s"), mean.alias("m"))
        got = w.agg(
            (F.sum(F.col("n") * (F.col("s") - F.col("m")) ** 2) / F.sum("n")).alias("seen"),
            (F.sum(F.col("m") * (1 - F.col("m"))) / F.sum("n")).alias("chance"),
            (F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))) / F.sum("n")).alias("within"),
        ).first()
        return _strength((got.seen or 0) - (got.chance or 0), got.within)

    a = strength(hosts, "host_n", "host_good", F.lit(share))
    hosts = hosts.withColumn("host_share", (F.col("host_good") + F.lit(a * share)) / (F.col("host_n") + F.lit(a)))
    joined = paths.join(hosts.withColumnRenamed(host, "_host"), F.col(host).eqNullSafe(F.col("_host")))
    b = strength(joined, "n", "good", F.col("host_share"))
    return joined.select(host, path, "n", "good", F.col("host_share").alias("towards"), F.lit(b).alias("strength")), share


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """`docs` with _evidence, _host_share, _path_share, _posterior (all double); none of its columns
    may have one of these four names."""
    scored = posteriors(docs, labels, host, path)
    return scored.select("row.*", *(F.col(c).alias(f"_{c}") for c in ("evidence", "host_share", "path_share", "posterior")))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(row, evidence, host_share, path_share, posterior): `row` is a struct of a document's columns,
    so none of their names can clash.

    The figures are computed twice: rows have no key of their own to join them by, and writing all
    texts with them would cost more than reading them again."""
    key = F.struct(F.col("doc_id").alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"))
    figured = written(with_figures(docs.select(key.alias("row"), "text")).select("row.*", "figures"), "quality-figures")
    model = train(figured, labels)
    sites, share = site_shares(figured.select("host", "path", evidence(F.col("figures"), model).alias("p")), "host", "path")
    sites = written(sites, "quality-sites").select(
        F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", F.col("towards").alias("host_share"), F.col("strength").alias("k")
    )
    sites = F.broadcast(sites) if sites.count() <= SITES else sites
    rows = with_figures(docs.select(F.struct(*docs.columns).alias("row"), "text")).select("row", evidence(F.col("figures"), model).alias("evidence"))
    rows = rows.join(sites, F.col("row")[host].eqNullSafe(F.col("h")) & F.col("row")[path].eqNullSafe(F.col("p")), "left")
    own = (F.col("good") - F.col("evidence") + F.col("k") * F.col("host_share")) / (F.col("n") - 1 + F.col("k"))
    rows = rows.withColumn("path_share", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), own)))
    odds = F.col("evidence") / (1 - F.col("evidence")) * F.col("path_share") / (1 - F.col("path_share")) * F.lit((1 - share) / share)
    return rows.select("row", "evidence", "host_share", "path_share", (odds / (1 + odds)).alias("posterior"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of `docs` whose posterior is at least `least`."""
    return posteriors(docs, labels).where(F.col("posterior") >= least).select("row.*")
