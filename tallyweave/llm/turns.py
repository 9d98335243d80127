"""Repair of the structure of conversations: the cheapest edits that leave turns in order.

A repaired conversation has the role initials `(s?(ua)+)?`: perhaps a system turn, then user and
assistant in turn. Each turn is kept (K), given the role user or assistant (R), or deleted (D), and
empty turns can be inserted (I) anywhere. Blank turns and turns whose role and text came before
must go; a truncated turn that stays has a price.

Method: rank-compressed dynamic programming. A layer is a turn, a state what the last initial was
(nothing, s, u, a). Edits of a layer are macros: a run of zero to two insertions and one edit of the
turn. The macros are a prefix-free code, so audit strings of one layer compare as (rank of the
string before, code), and a state carries its cost and its string's rank among the four states
instead of the string; parent pointers give the strings back afterwards. All conversations of a
batch move through their layers together. Long conversations are cut into chunks, for which all four
first states are tried at once, and into runs, the rows of one conversation in one range partition;
chunks and runs are put together by their 4 x 4 tables of costs and ranks, so no conversation
must fit into one task.

Rows: conv_id, turn, role, text; other columns are ignored. Order: turn (nulls first), role, the text's hash.
Null roles and texts count as one space; rows with a null conv_id are one conversation. A role
without a first character has no initial, so its turn can't stay as it is. An empty table gives an
empty result. Texts are shuffled once. The SHA-256 of a conversation is a chain over its whole text,
so one task reads a conversation's turns in order at the end, a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import Tables

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Layers that are worked on one after another; longer conversations are cut.
CHUNK = 256
#: Turns of one batch.
BATCH = 60_000
#: No way.
NEVER = 1 << 40
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MACROS = sorted(i * "I" + e for i in range(3) for e in "DKR")
#: The insertions that end a conversation in each state, or None.
ENDINGS = ["", "II", "I", ""]
#: Elements of a layer: 0 must be deleted; others have an initial and may be truncated.
INITIALS = " sua"
BLANKS = " \t\n\x0b\x0c\r"
MUST_GO = 0


def _step(state: int, edit: str, initial: str) -> int | None:
    """The state after one edit."""
    if edit == "D":
        return state
    if edit in "IR":
        return ASSISTANT if state == USER else USER
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _element(initial: str, truncated: bool) -> int:
    return 1 + 2 * max(0, INITIALS.find(initial)) + truncated


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and code of the best macro for (element, state before, state after)."""
    n = 1 + 2 * len(INITIALS)
    cost, code = np.full((n, 4, 4), NEVER, np.int64), np.zeros((n, 4, 4), np.int64)
    for element in range(n):
        initial, truncated = INITIALS[(element - 1) // 2], (element - 1) % 2
        for before in range(4):
            for k, macro in enumerate(MACROS):
                if element == MUST_GO and macro[-1] != "D":
                    continue
                state: int | None = before
                for edit in macro:
                    state = None if state is None else _step(state, edit, initial)
                if state is None:
                    continue
                price = INSERT * (len(macro) - 1) + {"K": KEEP, "R": REROLE, "D": DELETE}[macro[-1]]
                price += TRUNCATED * (element != MUST_GO and truncated and macro[-1] != "D")
                if price < cost[element, before, state]:  # macros come in order, so the first of a price is the least
                    cost[element, before, state], code[element, before, state] = price, k
    return cost, code


COST, CODE = _tables()
END_COST = np.array([INSERT * len(x) for x in ENDINGS], np.int64)


def _ranks(keys: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Ranks of the strings of the states, the last axis; states that can't be reached come last."""
    return np.argsort(np.argsort(np.where(costs < NEVER, keys, NEVER), axis=-1), axis=-1)


def _forward(elements: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Costs and ranks (chunk, first state, last state), and for each layer the parents and codes.
    Chunks are ordered by falling length."""
    b = len(starts)
    cost = np.full((b, 4, 4), NEVER, np.int64)
    cost[:, range(4), range(4)] = 0
    rank = np.tile(np.arange(4), (b, 4, 1)).astype(np.int64)
    parents, codes = [], []
    for t in range(int(lengths[0]) if b else 0):
        live = int(np.searchsorted(-lengths, -t, "left"))  # chunks with more than t layers
        e = elements[starts[:live] + t]
        total = np.minimum(cost[:live, :, :, None] + COST[e][:, None], NEVER)
        parent = np.argmin(total * 8 + rank[:live, :, :, None], axis=2)
        code = CODE[e[:, None, None], parent, np.arange(4)]
        cost[:live] = np.take_along_axis(total, parent[:, :, None, :], 2)[:, :, 0]
        rank[:live] = _ranks(np.take_along_axis(rank[:live], parent, 2) * 16 + code, cost[:live])
        parents.append(parent.astype(np.uint8))
        codes.append(code.astype(np.uint8))
    return cost, rank, parents, codes


def _join(cost: np.ndarray, rank: np.ndarray, next_cost: np.ndarray, next_rank: np.ndarray):
    """Puts two tables (first state, last state) together; also the state between, for each pair."""
    total = np.minimum(cost[:, :, None] + next_cost[None], NEVER)
    between = np.argmin(total * 8 + rank[:, :, None], axis=1)
    cost = np.take_along_axis(total, between[:, None, :], 1)[:, 0]
    keys = np.take_along_axis(rank, between, 1) * 8 + next_rank[between, np.arange(4)]
    return cost, _ranks(keys, cost), between


class Runs:
    """The dynamic programming of many runs. elements: one for each turn; starts: of each run."""

    def __init__(self, elements: np.ndarray, starts: np.ndarray):
        ends = np.append(starts[1:], len(elements))
        at = [np.arange(s, e, CHUNK) for s, e in zip(starts, ends, strict=True)]
        self.n = np.array([len(x) for x in at], np.int64)  # chunks of each run
        chunk_starts = np.concatenate([np.zeros(0, np.int64), *at])
        lengths = np.minimum(CHUNK, np.repeat(ends, self.n) - chunk_starts)
        self.order = np.argsort(-lengths, kind="stable")
        self.place = np.argsort(self.order)  # of each chunk in the order of work
        self.starts, self.lengths, self.total = chunk_starts[self.order], lengths[self.order], len(elements)
        self.cost, self.rank, self.parents, self.codes = _forward(elements, self.starts, self.lengths)
        self.first = np.cumsum(self.n) - self.n

    def tables(self) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Costs, ranks and states between chunks of each run."""
        out = []
        for first, n in zip(self.first.tolist(), self.n.tolist(), strict=True):
            k = self.place[first]
            cost, rank, between = self.cost[k], self.rank[k], []
            for k in self.place[first + 1 : first + n]:
                cost, rank, mid = _join(cost, rank, self.cost[k], self.rank[k])
                between.append(mid)
            out.append((cost, rank, between))
        return out

    def edits(self, enter: np.ndarray, leave: np.ndarray, tables: list) -> np.ndarray:
        """The code of each turn, for the states in which each run begins and ends."""
        first, last = np.zeros(len(self.place), np.int64), np.zeros(len(self.place), np.int64)
        for run, (start, n) in enumerate(zip(self.first.tolist(), self.n.tolist(), strict=True)):
            state = int(leave[run])
            for k in range(n - 1, 0, -1):
                last[start + k] = state
                state = first[start + k] = int(tables[run][2][k - 1][enter[run], state])
            last[start], first[start] = state, enter[run]
        first, state = first[self.order], last[self.order]
        out = np.zeros(self.total, np.uint8)
        for t in range(len(self.codes) - 1, -1, -1):
            live = len(self.codes[t])
            rows = np.arange(live)
            out[self.starts[:live] + t] = self.codes[t][rows, first[:live], state[:live]]
            state[:live] = self.parents[t][rows, first[:live], state[:live]]
        return out


def _end(cost: np.ndarray, rank: np.ndarray) -> int:
    """The state in which a conversation ends best: cheapest, then least audit."""
    return int(np.argmin((cost + END_COST) * 8 + rank))


def _elements(role: list[str], n, blank, cut, new) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all turns, copies included, and the first one of each row."""
    n = np.asarray(n, np.int64)
    initial = np.fromiter((max(0, INITIALS.find(x[0])) if x else 0 for x in role), np.int64, len(role))
    own = np.where(np.asarray(blank, bool) | ~np.asarray(new, bool), MUST_GO, 1 + 2 * initial + np.asarray(cut, bool))
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)  # further copies of a row are duplicates
    out[at] = own
    return out, at


FACTS = ["role", "n", "blank", "cut", "new"]


def _facts(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _elements(*[rows.column(c).to_pylist() for c in FACTS])


def _strings(codes: np.ndarray, at: np.ndarray) -> list[str]:
    return ["".join([MACROS[c] for c in part]) for part in np.split(codes, at[1:])]


def _cut(ids: pa.Array) -> np.ndarray:
    """The first rows of the runs of equal ids."""
    if not len(ids):
        return np.zeros(0, np.int64)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
    return np.concatenate([[0], 1 + np.flatnonzero(other.to_numpy(zero_copy_only=False))])


def _solved(rows: pa.RecordBatch, runs: np.ndarray, open_runs: np.ndarray) -> pa.RecordBatch:
    """Edits of all rows of the given runs (their first rows); none for the runs that other
    partitions may go on with."""
    elements, at = _facts(rows)
    work = Runs(elements, at[runs])
    tables = work.tables()
    leave = np.array([_end(cost[NOTHING], rank[NOTHING]) for cost, rank, _ in tables], np.int64)
    strings: list = _strings(work.edits(np.zeros(len(runs), np.int64), leave, tables), at)
    ends = np.append(runs[1:], rows.num_rows)
    for row, state in zip(ends.tolist(), leave.tolist(), strict=True):
        strings[row - 1] += ENDINGS[state]
    names = np.full(rows.num_rows, -1, np.int64)
    for k in np.flatnonzero(open_runs >= 0):
        names[runs[k] : ends[k]] = open_runs[k]
        strings[runs[k] : ends[k]] = [None] * int(ends[k] - runs[k])
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(names), pa.array(strings, pa.string())], [*rows.schema.names, "run", "edits"])


def _by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves the conversations inside a partition; its first and last run stay open."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    size, first = 0, True

    def solve(rows: pa.RecordBatch, runs: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal first
        names = np.full(len(runs), -1, np.int64)
        if last:
            names[-1] = 2 * part + 1
        if first:
            names[0], first = 2 * part, False
        return _solved(rows, runs, names)

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= BATCH:
            rows = pa.concat_batches(held)
            runs = _cut(rows.column(0))
            last = int(runs[-1])
            held, size = [rows.slice(last)], rows.num_rows - last
            if last:
                yield solve(rows.slice(0, last), runs[:-1], False)
    if size:
        rows = pa.concat_batches(held)
        yield solve(rows, _cut(rows.column(0)), True)


def _table_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The 4 x 4 tables of one open run."""
    rows = rows.sort_values("place")
    elements, _ = _elements(*[rows[c].tolist() for c in FACTS])
    cost, rank, _ = Runs(elements, np.zeros(1, np.int64)).tables()[0]
    return pd.DataFrame({"run": [key[0]], "cost": [cost.ravel().tolist()], "ranks": [rank.ravel().tolist()]})


def _put_together(runs: pd.DataFrame) -> pd.DataFrame:
    """The states in which each run of one conversation begins and ends."""
    runs = runs.sort_values("run")
    parts = [tuple(np.array(list(x), np.int64).reshape(4, 4) for x in one) for one in zip(runs["cost"], runs["ranks"], strict=True)]
    (cost, rank), between = parts[0], []
    for one in parts[1:]:
        cost, rank, mid = _join(cost, rank, *one)
        between.append(mid)
    states = [_end(cost[NOTHING], rank[NOTHING])]
    for mid in reversed(between):
        states.append(int(mid[NOTHING, states[-1]]))
    states = states[::-1]  # where each run ends; the next one begins there
    tails = [""] * len(between) + [ENDINGS[states[-1]]]
    return pd.DataFrame({"run": runs["run"].to_numpy(), "enter": [NOTHING, *states[:-1]], "leave": states, "tail": tails})


def _edits_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place").reset_index(drop=True)
    elements, at = _elements(*[rows[c].tolist() for c in FACTS])
    work = Runs(elements, np.zeros(1, np.int64))
    first = rows.iloc[0]
    strings = _strings(work.edits(np.array([first["enter"]]), np.array([first["leave"]]), work.tables()), at)
    strings[-1] += first["tail"]
    return pd.DataFrame({"run": key[0], "place": rows["place"], "edits": strings})


KEY = ["conv_id", "turn", "role", "text_id"]


def turns(conversations: DataFrame) -> DataFrame:
    """The columns that count, with nulls as one space, and the text's id."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.withColumn("text_id", F.unhex(F.sha2("text", 256)))


def edits(conversations: DataFrame, tables: Tables) -> DataFrame:
    """One row for each different turn of a conversation: KEY, n (copies), blank, cut (truncated),
    new (role and text didn't come before), and edits: the letters for all its copies, in order."""
    ship(conversations.sparkSession)
    rows = turns(conversations)
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    marked = rows.select(*KEY, (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"))
    once = tables.write(marked.groupBy(*KEY).agg(F.count("*").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut")), "turns")
    # The first turn of a role and text is marked by a row of its own, so no key is joined.
    firsts = once.groupBy("conv_id", "role", "text_id").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))).alias("first"))
    firsts = firsts.select("conv_id", F.col("first.turn").alias("turn"), "role", "text_id", F.lit(0).cast("long").alias("n"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("new"))
    both = once.withColumn("new", F.lit(False)).unionByName(firsts).groupBy(*KEY)
    marks = tables.write(both.agg(F.sum("n").alias("n"), *[F.bool_or(c).alias(c) for c in ("blank", "cut", "new")]), "marks")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marks.schema)
    ordered = marks.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    solved = tables.write(ordered.mapInArrow(_by_partition, f"{kinds}, run long, edits string"), "edits")
    tables.drop("turns", "marks")

    # Runs at the borders of partitions: two for each partition at most, each no larger than a partition.
    order = Window.partitionBy("run").orderBy("turn", "role", "text_id")
    border = solved.where(F.col("run") >= 0).drop("edits").withColumn("place", F.row_number().over(order).cast("long"))
    border = tables.write(border, "border")
    light = border.select("run", "place", *FACTS)
    parts = light.groupBy("run").applyInPandas(_table_of, "run long, cost array<long>, ranks array<long>")
    parts = parts.join(border.select("run", "conv_id").distinct(), "run")
    states = tables.write(parts.groupBy("conv_id").applyInPandas(_put_together, "run long, enter long, leave long, tail string"), "states")
    told = light.join(states, "run").groupBy("run").applyInPandas(_edits_of, "run long, place long, edits string")
    told = border.join(told, ["run", "place"]).drop("place")
    return solved.where(F.col("run") < 0).unionByName(told).drop("run")


class _Report:
    """What is told of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.counts = conv_id, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit, self.hash, self.state = [], hashlib.sha256(), NOTHING
        self.before, self.distinct, self.least, self.most, self.places = None, 0, None, None, 0

    def turn(self, turn, role: str, n: int, blank: bool, cut: bool, new: bool, edits: str) -> None:
        if turn is not None and turn != self.most:
            self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        if n > 1 and initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += n - 1
        self.counts["blank"] += n * blank
        self.counts["duplicate"] += 0 if blank else n - new
        self.counts["truncated"] += bool(not blank and new and cut)
        self.audit.append(edits)
        stays = len(edits) - edits.count("D") - edits.count("I")
        self.counts["cost"] += INSERT * edits.count("I") + DELETE * edits.count("D") + REROLE * edits.count("R") + TRUNCATED * (cut and stays > 0)

    def repaired(self, role: str, text: str, edits: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that a row becomes."""
        for edit in edits:
            state = _step(self.state, edit, role[:1])
            if edit != "D":
                name = role if edit == "K" else "assistant" if state == ASSISTANT else "user"
                yield edit, name, "" if edit == "I" else text
            self.state = state

    def row(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _walk(batches: Iterator[pa.RecordBatch], report: bool) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation, one after another: its own mark, then for each turn the row with
    the edits and those with the text."""
    schema = None
    now: _Report | None = None
    edit, places = None, 0
    out: list[dict] = []
    size = 0

    def told(role: str, text: str, letters: str) -> None:
        nonlocal places, size
        for how, name, words in now.repaired(role, text, letters):
            if report:
                now.hash.update((("\n" if places else "") + f"{name}:{words}").encode("utf-8", "surrogatepass"))
            else:
                out.append({"conv_id": now.conv_id, "place": places, "edit": how, "role": name, "text": words})
                size += len(words)
            places += 1

    for b in batches:
        kind = b.schema.field("conv_id").type
        schema = _arrow(kind, report)
        cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "cut", "new", "edits", "text", "tag")]
        for conv, turn, role, n, blank, cut, new, letters, text, tag in zip(*cols, strict=True):
            if tag == 0:
                if now is not None and report:
                    out.append(now.row())
                    size += len(out[-1]["audit"])
                now, places = _Report(conv), 0
            elif tag == 1:
                now.turn(turn, role, n, blank, cut, new, letters)
                edit = letters
                if not letters.strip("DI"):  # no text is needed
                    told(role, "", letters)
                    edit = None
            elif edit is not None:  # the text, once however many copies there are
                told(role, text, edit)
                edit = None
            if len(out) >= 5000 or size > 8_000_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if now is not None and report:
        out.append(now.row())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(conv: pa.DataType, report: bool) -> pa.Schema:
    if report:
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return pa.schema([("conv_id", conv), *[(x, pa.int64()) for x in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return pa.schema([("conv_id", conv), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _walked(conversations: DataFrame, report: bool, ids: DataFrame | None) -> DataFrame:
    tables = Tables(conversations.sparkSession)
    done = edits(conversations, tables)
    texts = turns(conversations)
    empty = lambda *names: [F.lit(None).alias(n) for n in names]
    facts = ("n", "blank", "cut", "new", "edits")
    every = (conversations if ids is None else ids).select("conv_id").distinct()
    rows = (
        done.select(*KEY, *facts, F.lit(None).cast("string").alias("text"), F.lit(1).alias("tag"))
        .unionByName(texts.select(*KEY, *empty(*facts), "text", F.lit(2).alias("tag")))
        .unionByName(every.select("conv_id", *empty(*KEY[1:], *facts, "text"), F.lit(0).alias("tag")))
    )
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("tag") > 0, "turn", "role", "text_id", "tag")
    return ordered.mapInArrow(lambda x: _walk(x, report), schema if report else f"conv_id {conv}, place long, edit string, role string, text string")


def report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation (also those that only `ids` has): conv_id; gaps in the numbers
    of its turns; counts of blank, duplicate, truncated turns and of illegal neighbours; cost and audit
    (letters in order) of the edits; repaired_sha256 of `role:text` of the repaired turns, joined by line breaks."""
    return _walked(conversations, True, ids)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role, text."""
    return _walked(conversations, False, None)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, dealt by crc32 of `conv_id:turn` (nulls: one space) modulo 20: 0 the
    turn is missing, 1 its text is empty, 2 its text has no `[.!?]`, 3 it comes twice, 4 its role is user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumn("_how", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).where("_how <> 0")
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_how") == 3, 2).otherwise(1))
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
