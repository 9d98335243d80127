"""Personal data: fixed patterns, and more of it by bootstrapped contextual extraction.

The fixed patterns find e-mail addresses, IPv4 addresses, card and phone numbers; what they find
stays. It is also the seed of a bootstrap: the one to three words before a seed are a pattern.
Other tokens that look like an identifier (numbers of 7 digits or more, IPv6 addresses,
addresses with `(at)` or without a dot) are its instances too, and so are, as counter-evidence, all
other words that follow the same words anywhere in the corpus. On the graph of patterns and
instances, Spark scores in turn: a pattern of a kind by the share of its instances that are of the
kind, weighted by their scores, and an instance by its best pattern; seeds have a score of 1 for
their own kind and 0 for others. Patterns with LEAST different seeds, SEEDED of their instances seeds and a
score of KEEP or more then mark the instances after them that their kind may have.

Places are code points, ends exclusive. Null and empty texts have no spans. Rows with one doc_id, or
none, are documents of their own. Other columns are ignored. Tables of any size: texts aren't
shuffled, and are read twice if any pattern has enough seeds. A document is worked on by itself, so
its spans are bounded by its text; words that very many documents have are counted by grouped sums.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.ragged import groups
from tallyweave.session import ship
from tallyweave.shared import Tables
from tallyweave.skew import salted_join

KINDS = ["email", "ip", "card", "phone"]
#: Different seeds that a pattern needs, and the share of its instances that must be of the kind.
LEAST, KEEP = 3, 0.8
#: The share of a pattern's instances that must be seeds, so that patterns can't raise each other from little.
SEEDED = 0.6
ROUNDS = 4
#: Words of a pattern at most.
CONTEXT = 3
#: Patterns that are counted over the corpus at a time.
BLOCK = 200_000

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![\w@.+/:-])\(?[0-9][0-9 ()./-]*[0-9](?![\w@])")
_SIX = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::|[0-9A-Fa-f]{1,4}|(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])")
_HIDDEN = re.compile(r"(?:@| ?[(\[]at[)\]] ?)([A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]{1,63})*)")


def _before(text: str, at: int, least: int) -> int:
    """Where the run of characters of a local part that ends at `at` begins."""
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start. Every scan is linear in the text: an address is found
    from its `@`, and dotted numbers inside runs of digits and dots."""
    out, end = [], 0
    for m in _AT.finditer(text):
        start = _before(text, m.start(), end)
        if start < m.start():
            end = m.end()
            out.append(("email", start, end))
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                    out.append(("ip", *m.span()))
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _others(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[list[str], int, int]]:
    """(kinds that it may have, start, end) of further tokens that look like identifiers."""
    found = []
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0])) if 7 <= m.end() - m.start() <= 60 else 0
        if kinds := ["card"] * (12 <= n <= 19) + ["phone"] * (7 <= n <= 15):
            found.append((kinds, *m.span()))
    if ":" in text:
        found += [(["ip"], *m.span()) for m in _SIX.finditer(text)]
    end = 0
    for m in _HIDDEN.finditer(text):
        start = _before(text, m.start(), end)
        if start < m.start():
            end = m.end()
            found.append((["email"], start, end))
    spans = sorted((s, e) for _, s, e in taken)
    out, k = [], 0
    for kinds, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if (k == len(spans) or spans[k][0] >= end) and (not out or out[-1][2] <= start):
            out.append((kinds, start, end))
    return out


def contexts(text: str, start: int) -> list[str]:
    """The patterns of a token: the last one, two and three words before it, in lower case."""
    at = start
    while at and text[at - 1] in "([{<\"'":
        at -= 1
    if at and not text[at - 1].isspace():
        return []
    left = text[max(0, at - 200) : at]
    own = left.lower().split()
    if len(left) == 200 and not left[0].isspace():
        own = own[1:]  # may be cut
    own = own[-CONTEXT:]
    return [" ".join(own[-k:]) for k in range(1, len(own) + 1)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("kinds", pa.list_(pa.string())), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])
_FOUND = "base array<struct<kind string, start long, end long>>, mentions array<struct<kinds array<string>, seed boolean, start long, end long, value string, contexts array<string>>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, stop, texts in groups(b.column(1)):
            base, mentions = [], []
            for text in texts:
                own = base_spans(text)
                every = [([k], s, e, True) for k, s, e in own] + [(*x, False) for x in _others(text, own)]
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                mentions.append([{"kinds": k, "seed": seed, "start": s, "end": e, "value": text[s:e].lower(), "contexts": c} for k, s, e, seed in every if (c := contexts(text, s))])
            columns = [b.column(0).slice(start, stop - start), pa.array(base, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "mentions"])


def _counted(batches: Iterator[pa.RecordBatch], asked: dict[str, set[str]]) -> Iterator[pa.RecordBatch]:
    """How often each of the asked patterns stands before some word; asked: by its last word."""
    counts: Counter[str] = Counter()
    for b in batches:
        for _, _, texts in groups(b.column(0)):
            for text in texts:
                own = text.lower().split()
                for k, word in enumerate(own[:-1]):
                    if (some := asked.get(word)) is not None:
                        for n in range(min(CONTEXT, k + 1)):
                            if (pattern := " ".join(own[k - n : k + 1])) in some:
                                counts[pattern] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["context", "total"])


def _totals(texts: DataFrame, patterns: DataFrame, tables: Tables) -> DataFrame:
    """(context, total): how often words follow each pattern, whatever they are."""
    blocks = math.ceil(patterns.count() / BLOCK)
    out = None
    for block in range(blocks):
        asked: dict[str, set[str]] = {}
        for (context,) in patterns.where(F.pmod(F.xxhash64("context"), F.lit(blocks)) == block).select("context").collect():
            asked.setdefault(context.rpartition(" ")[2], set()).add(context)
        sent = texts.sparkSession.sparkContext.broadcast(asked)  # BLOCK patterns, about
        part = texts.mapInArrow(lambda x, sent=sent: _counted(x, sent.value), "context string, total long")
        out = part if out is None else out.unionByName(part)
    return tables.write(out.groupBy("context").agg(F.sum("total").alias("total")), "totals")


def patterns(mentions: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(context, kind, score) of the patterns that are to be trusted. mentions: kinds, seed, value,
    contexts of each token."""
    spread = mentions.select("seed", "value", "contexts", F.posexplode("kinds").alias("at", "kind"))
    each = spread.select("seed", "value", "kind", "at", F.explode("contexts").alias("context"))
    # One row for each pattern, instance and kind; n: how often, counted once for a token of several kinds.
    edges = each.groupBy("context", "value", "kind").agg(F.bool_or("seed").alias("seed"), F.count_if(F.col("at") == 0).alias("n"))
    edges = tables.write(edges, "edges")
    instances = edges.groupBy("context", "value").agg(F.sum("n").alias("n")).groupBy("context").agg(F.count("*").alias("instances"), F.sum("n").alias("n"))
    kinds = edges.groupBy("context", "kind").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("possible"))
    likely = tables.write(kinds.where(F.col("seeds") >= LEAST).join(instances, "context").where(F.col("possible") >= KEEP * F.col("instances")), "likely")
    totals = _totals(texts, likely.select("context").distinct(), tables) if not likely.isEmpty() else None
    if totals is None:
        return likely.select("context", "kind", F.lit(0.0).alias("score"))
    # No score can pass the part of all words after a pattern that may be of the kind.
    all_words = F.col("instances") + F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - F.col("n"))
    judged = likely.join(totals, "context", "left").withColumn("words", all_words.cast("double"))
    judged = judged.where((F.col("possible") >= KEEP * F.col("words")) & (F.col("seeds") >= SEEDED * F.col("words")))
    judged = tables.write(judged.select("context", "kind", "words"), "judged")
    graph = tables.write(salted_join(edges.select("context", "kind", "value", "seed"), judged, ["context", "kind"], ["value"]), "graph")
    scores = graph.groupBy("context", "kind", "words").agg((F.count_if("seed") / F.first("words")).alias("score"))
    for k in range(ROUNDS):
        scores = tables.write(scores.select("context", "kind", "score"), f"scores-{k}")
        told = salted_join(graph, scores, ["context", "kind"], ["value"])
        best = told.groupBy("value", "kind").agg(F.max("score").alias("own"))
        told = salted_join(told.drop("score"), best, ["value", "kind"], ["context"])
        worth = F.when(F.col("seed"), 1.0).otherwise(F.col("own"))
        scores = told.groupBy("context", "kind").agg((F.sum(worth) / F.first("words")).alias("score"))
    return tables.write(scores.where(F.col("score") >= KEEP - 1e-9), "patterns")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end, in the order of KINDS, then start) of each
    document. added: what trusted patterns mark; it doesn't overlap base."""
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    text = F.coalesce("text", F.lit("")).alias("text")
    found = docs.select("doc_id", text).mapInArrow(_found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FOUND}")
    found = tables.write(found.withColumn("row", F.monotonically_increasing_id()), "found")
    mentions = found.select("row", F.inline("mentions"))
    trusted = patterns(mentions, docs.select(text), tables)
    each = mentions.where(~F.col("seed")).select("row", "start", "end", "kinds", F.explode("contexts").alias("context"))
    marked = salted_join(each, trusted, ["context"], ["row", "start"]).where(F.array_contains("kinds", F.col("kind")))
    order = Window.partitionBy("row", "start", "end").orderBy(F.desc("score"), place("kind"))
    marked = marked.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    spans = marked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return found.join(spans, "row", "left").select("doc_id", "base", in_order(F.coalesce("added", none)).alias("added"))


def place(kind: str | Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind) if isinstance(kind, str) else kind)


def in_order(spans: Column) -> Column:
    """Spans by kind, then start."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(place(x["kind"]).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
