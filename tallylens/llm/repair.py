"""Repair of the structure of conversations by Hirschberg's divide and conquer.

A conversation is repaired when it is empty, or has at most one system turn,
first, and then pairs of a user's and an assistant's turn. Rows can be kept,
get another role or be deleted, and empty turns can be inserted; the cheapest
edits are wanted, of equally cheap ones the least as a text of their initials
(``D`` < ``I`` < ``K`` < ``R``).

What may come next depends on four states only: nothing yet, or after a system,
user or assistant turn. A forward vector holds the least costs of leading from
a given state to each of the four by the rows up to a place, and how the four
best edit texts are ordered. They are ordered by their first difference: each
ends with the edit of a row, so none is the beginning of another. A backward
vector holds the least costs from each state to the end. Both meet in the middle
of the rows; of the cheapest crossings that with the least edit text is taken,
and the two halves are solved on their own. Nothing but vectors of four is kept
for a row.

The same holds for runs of rows: a run is known by its costs from each state to
each, 4 x 4 numbers. Rows are sorted by range partitions and cut into runs of at
most ``RUN_ROWS``, so a conversation may have any number of rows: its runs are
summed up on their own, the crossings between runs are found from the sums, and
the runs are solved side by side. Most conversations lie in one run. Repeated
equal rows are counted and merged before they are moved.

Defined results: null roles and texts are one space; rows go by turn (nulls
first), then role and text; rows with a null conv_id are one conversation. The
initial of a role is its first character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylens.llm.tables import pick
from tallylens.sources.files import staged

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5  # costs; keeping a row is free
RUN_BITS = 16
RUN_ROWS = 1 << RUN_BITS
WORD, FULL_STOP = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

# the states: nothing, after a system turn, after a user's, after an assistant's; the role that must follow, and its state
NEXT_ROLE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
NEVER = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)  # the inserts that a state needs at the end
FORCED = 8  # kind of a row that must be deleted; others: 2 * initial (3: another) + cut off

Move = tuple[int, int, int, object]  # from state, to state, cost, what orders the edits of one state


def moves(kind: int) -> list[Move]:
    """What can be done about a row: some inserts, then one edit of the row."""
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def add(s: int, t: int, cost: int, edits: str) -> None:
        found[s, t] = min(found.get((s, t), (NEVER, "")), (cost, edits))

    for s in range(4):
        at = s
        for n in range(3):  # a third insert leads back to a state that fewer reach
            cost, edits = n * INSERT, "I" * n
            add(s, at, cost + DELETE, edits + "D")
            if kind != FORCED:
                initial, cut = INITIALS[kind // 2 : kind // 2 + 1], CUT_OFF * (kind % 2)
                add(s, NEXT[at], cost + REROLE + cut, edits + "R")
                if initial == NEXT_ROLE[at][0]:
                    add(s, NEXT[at], cost + cut, edits + "K")
                elif initial == "s" and at == 0:
                    add(s, 1, cost + cut, edits + "K")
            at = NEXT[at]
    return [(s, t, *rest) for (s, t), rest in found.items()]


MOVES = [moves(kind) for kind in range(FORCED + 1)]


def fixed(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in range(4))


def forward(steps: list[list[Move]], state: int) -> tuple[list[int], list[int]]:
    """From a state: the least cost of reaching each state, and the places of the four best edit texts in their order."""
    cost, place = list(fixed(state)), [0] * 4
    for step in steps:
        best = [(NEVER, 4, "")] * 4
        for s, t, c, edits in step:
            if cost[s] < NEVER:
                best[t] = min(best[t], (cost[s] + c, place[s], edits)) if best[t][0] < NEVER else (cost[s] + c, place[s], edits)
        reached = sorted((t for t in range(4) if best[t][0] < NEVER), key=lambda t: best[t][1:])
        cost = [b[0] for b in best]
        place = [reached.index(t) if t in reached else 4 for t in range(4)]
    return cost, place


def backward(steps: list[list[Move]], end: tuple[int, ...]) -> list[int]:
    """The least cost from each state through all steps, with what the states behind them cost."""
    cost = list(end)
    for step in reversed(steps):
        least = [NEVER] * 4
        for s, t, c, _ in step:
            least[s] = min(least[s], c + cost[t])
        cost = least
    return cost


def cheapest(steps: list[list[Move]], state: int, end: tuple[int, ...]) -> list[Move]:
    """The moves of the cheapest way, of equal ones the least edit text: forward and backward vectors meet in the middle."""
    if not steps:
        return []
    if len(steps) == 1:
        return [min((m for m in steps[0] if m[0] == state), key=lambda m: (min(m[2] + end[m[1]], NEVER), m[3]))]
    middle = len(steps) // 2
    ahead, place = forward(steps[:middle], state)
    behind = backward(steps[middle:], end)
    least = min(a + b for a, b in zip(ahead, behind, strict=True))
    met = min((s for s in range(4) if ahead[s] + behind[s] == least), key=lambda s: place[s])
    return cheapest(steps[:middle], state, fixed(met)) + cheapest(steps[middle:], met, end)


@lru_cache(maxsize=1 << 16)
def _short(kinds: bytes, state: int, end: tuple[int, ...]) -> list[Move]:
    return cheapest([MOVES[k] for k in kinds], state, end)


def solved(kinds: bytes, state: int, end: tuple[int, ...]) -> list[Move]:
    """The moves of a run of rows; short runs of the same kinds have the same ones."""
    return _short(kinds, state, end) if len(kinds) <= 32 else cheapest([MOVES[k] for k in kinds], state, end)


# ---------------------------------------------------------------- runs of sorted rows

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole runs: rows of one conversation and part. A run is at most ``RUN_ROWS`` long."""
    held: list[pa.RecordBatch] = []

    def last(batch: pa.RecordBatch, at: int) -> tuple:
        return batch["conv_id"][at].as_py(), batch["part"][at].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and last(held[-1], held[-1].num_rows - 1) != last(batch, 0):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        edges = _edges(batch)
        if len(edges) > 2:  # all but the last run are complete
            yield pa.Table.from_batches([*held, batch.slice(0, edges[-2])]).combine_chunks()
            held, batch = [], batch.slice(edges[-2])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(rows: pa.RecordBatch | pa.Table) -> list[int]:
    """Where the runs begin, and the end."""
    column = rows["conv_id"]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    code = column.dictionary_encode().indices.fill_null(-1).to_numpy()
    part = rows["part"].to_numpy()
    return [0, *(np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), rows.num_rows]


def _kinds(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each row, and the place of its role's initial."""
    initial = rows["initial"].to_numpy().astype(np.uint8)
    forced = rows["blank"].to_numpy() | rows["duplicate"].to_numpy()
    return np.where(forced, FORCED, 2 * initial + rows["truncated"].to_numpy()).astype(np.uint8), initial


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and places from each state to each, for every run, and its last initial."""
    for rows in _runs(batches):
        kinds, initial = _kinds(rows)
        edges = _edges(rows)
        at = pa.array(edges[:-1])
        ways = [[forward([MOVES[k] for k in kinds[a:b]], s) for s in range(4)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.record_batch({
            "conv_id": rows["conv_id"].take(at).combine_chunks(), "part": rows["part"].take(at).combine_chunks(),
            "costs": pa.array([[c for cost, _ in way for c in cost] for way in ways], pa.list_(pa.int64())),
            "places": pa.array([[p for _, place in way for p in place] for way in ways], pa.list_(pa.int64())),
            "initial": pa.array(initial[np.array(edges[1:]) - 1], pa.int32())})


def _crossed(table: pa.Table) -> pa.Table:
    """The states between the runs of one conversation, found from the runs' sums alone."""
    table = table.sort_by("part")
    steps = [
        [(i // 4, i % 4, c, p) for i, (c, p) in enumerate(zip(costs, places, strict=True)) if c < NEVER]
        for costs, places in zip(table["costs"].to_pylist(), table["places"].to_pylist(), strict=True)]
    way = cheapest(steps, 0, END)
    return pa.table({
        "conv_id": table["conv_id"], "part": table["part"], "state": pa.array([m[0] for m in way], pa.int32()),
        "goal": pa.array([m[1] for m in way[:-1]] + [None], pa.int32()),
        "before": pa.array([None, *table["initial"].to_pylist()[:-1]], pa.int32())})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit; the first of a run has the run's edit text, costs and illegal neighbours."""
    for rows in _runs(batches):
        kinds, initial = _kinds(rows)
        times = rows["copies"].to_numpy()
        edges = _edges(rows)
        states, goals, before = (rows[c].to_pylist() for c in ("state", "goal", "before"))
        source, edits, role, many, step, runs = [], [], [], [], [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first, last = len(source), goals[a] is None
            own = [kinds[a + i : a + i + 1].tobytes() for i in range(b - a)]
            way = solved(b"".join(own), states[a] or 0, END if last else fixed(goals[a]))
            cost, said = 0, []
            for i, (s, t, c, text) in zip(range(a, b), way, strict=True):
                at = s
                for n, edit in enumerate(text):
                    source.append(i)
                    edits.append(edit)
                    role.append(NEXT_ROLE[at] if edit in "IR" else None)
                    many.append(1)
                    step.append(n)
                    at = NEXT[at]
                more = int(times[i]) - 1  # copies of a row are repetitions of it
                if more:
                    source.append(i)
                    edits.append("D")
                    role.append(None)
                    many.append(more)
                    step.append(len(text))
                cost += c + DELETE * more
                said.append(text + "D" * more)
            if last:
                at = way[-1][1]
                for n in range(END[at] // INSERT):
                    source.append(b - 1)
                    edits.append("I")
                    role.append(NEXT_ROLE[at])
                    many.append(1)
                    step.append(8 + n)
                    at = NEXT[at]
                cost += END[way[-1][1]]
                said.append("I" * (END[way[-1][1]] // INSERT))
            pairs = list(zip(initial[a : b - 1].tolist(), initial[a + 1 : b].tolist(), strict=True))
            if before[a] is not None:
                pairs.append((before[a], int(initial[a])))
            illegal = sum(p not in LEGAL for p in pairs) + int(times[a:b].sum()) - (b - a)
            runs += [("".join(said), cost, illegal)] + [(None, None, None)] * (len(source) - first - 1)
        at = pa.array(source, pa.int64())
        inserted = pa.array([e == "I" for e in edits], pa.bool_())
        yield pa.record_batch({
            "conv_id": rows["conv_id"].take(at).combine_chunks(), "id": rows["id"].take(at).combine_chunks(),
            "step": pa.array(step, pa.int32()), "edit": pa.array(edits, pa.string()), "times": pa.array(many, pa.int64()),
            "role": pc.coalesce(pa.array(role, pa.string()), rows["role"].take(at).combine_chunks().cast(pa.string())),
            "text": pc.if_else(inserted, "", rows["text"].take(at).combine_chunks().cast(pa.string())),
            **{name: pa.array([r[i] for r in runs], kind) for i, (name, kind) in enumerate(
                (("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())))}})


# ---------------------------------------------------------------- the operator

@dataclass(frozen=True)
class Repaired:
    """``edits``: conv_id, id, step (their order), edit, times, role, text, one row per edit; ``reports``: one row per
    conversation with gaps, the rows by first fault, illegal neighbours, cost and audit."""

    edits: DataFrame
    reports: DataFrame

    def rows(self) -> DataFrame:
        """The repaired conversations: conv_id, id, step, role, text."""
        return self.edits.where("edit <> 'D'").select("conv_id", "id", "step", "role", "text")


def same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return found


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, blank, duplicate, truncated (the first fault of a row), initial. Equal rows are one."""
    fill = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    turns = staged(
        pick(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", fill("role"), fill("text"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "turns")
    keyed = turns.select("*", F.md5(F.col("text").cast("binary")).alias("key"), (~F.col("text").rlike(WORD)).alias("blank"))
    # only texts that a role has in several turns need their first turn; these rows are few and hold no texts
    first = (
        keyed.where("not blank").groupBy("conv_id", "role", "key")
        .agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.isnull("turn")).alias("unnumbered")).where("n > 1"))
    later = F.col("n").isNotNull() & F.col("a.turn").isNotNull() & (F.col("unnumbered") | (F.col("a.turn") > F.col("first")))
    initial = F.when(F.substring("role", 1, 1).isin(*INITIALS), F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1).otherwise(3)
    return (
        keyed.alias("a").join(first.alias("b"), same(keyed, first, "conv_id", "role", "key"), "left")
        .select("a.conv_id", "a.turn", "a.role", "a.text", "a.copies", "a.blank", (~F.col("a.blank") & later).alias("duplicate"))
        .select("*", (~F.col("blank") & ~F.col("duplicate") & ~F.col("text").rlike(FULL_STOP)).alias("truncated"),
                initial.cast("int").alias("initial")))


def repair(rows: DataFrame) -> Repaired:
    """Repair all conversations of ``rows`` (conv_id, turn, role, text)."""
    up = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    ordered = staged(
        faults(rows).repartitionByRange(*up, F.substring("text", 1, 16)).sortWithinPartitions(*up, "text")
        .withColumn("id", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("id", RUN_BITS))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("copies")).otherwise(0))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    # a repeated row that has another fault first still repeats the one in front of it
    repeats = F.sum(F.when(~F.col("blank") & ~F.col("duplicate"), F.col("copies") - 1).otherwise(0))
    truncated = F.count_if("truncated")
    known = staged(ordered.groupBy("conv_id").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), gaps.alias("gaps"), counted("blank").alias("blank"),
        (counted("duplicate") + repeats).alias("duplicate"), truncated.alias("truncated")), "counts")
    # fewer than there are runs: a run ends in the middle of one conversation at most
    wide = F.broadcast(known.where("low < high").select("conv_id"))
    parted = ordered.alias("a").join(wide.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left_semi")
    kind = dict(ordered.dtypes)["conv_id"]
    sums = _sorted(parted.select("conv_id", "id", "part", "initial", "blank", "duplicate", "truncated")).mapInArrow(
        _summed, f"conv_id {kind}, part bigint, costs array<bigint>, places array<bigint>, initial int")
    crossed = staged(sums.groupBy("conv_id").applyInArrow(_crossed, f"conv_id {kind}, part bigint, state int, goal int, before int"), "crossed")
    put = ordered.alias("a").join(F.broadcast(crossed.alias("b")), same(ordered, crossed, "conv_id", "part"), "left").select(
        "a.*", "b.state", "b.goal", "b.before")
    edits = staged(_sorted(put).mapInArrow(_edited, (
        f"conv_id {kind}, id bigint, step int, edit string, times bigint, role string, text string, audit string, cost bigint, illegal bigint")),
        "edits")
    runs = edits.where("audit is not null").groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "audit"))), lambda r: r["audit"]), "").alias("audit"))
    reports = known.alias("a").join(runs.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select(
        "a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repaired(edits.drop("audit", "cost", "illegal"), reports)


def _sorted(rows: DataFrame) -> DataFrame:
    """Whole runs in their order."""
    return rows.repartition("part").sortWithinPartitions("id")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults that follow from conv_id and turn."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = pick(rows, "conv_id", "turn", "role", "text")
    chance = F.pmod(F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn")).cast("binary")), F.lit(20))
    return rows.select(
        "conv_id", "turn", F.when(chance == 4, "user").otherwise(fill("role")).alias("role"),
        F.when(chance == 1, "").when(chance == 2, F.regexp_replace(fill("text"), "[.!?]", "")).otherwise(fill("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(chance == 0, 0).when(chance == 3, 2).otherwise(1))).alias("n")).drop("n")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines; rows come sorted, and only a digest's state is kept."""
    now, digest, begun = None, hashlib.sha256(), False
    done: list[tuple] = []
    schema = None
    for batch in batches:
        schema = batch.schema.field("conv_id").type
        for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
            if begun and conv == now:
                digest.update(b"\n")
            else:
                if begun:
                    done.append((now, digest.hexdigest()))
                now, digest, begun = conv, hashlib.sha256(), True
            digest.update(line.encode())
        if done:
            yield pa.record_batch({"conv_id": pa.array([c for c, _ in done], schema), "sha": pa.array([d for _, d in done])})
            done = []
    if begun:
        yield pa.record_batch({"conv_id": pa.array([now], schema), "sha": pa.array([digest.hexdigest()])})


def digests(conversations: DataFrame, repaired: Repaired) -> DataFrame:
    """The reports of all conversations, and the digest of each one's repaired lines."""
    lines = repaired.rows().select("conv_id", "id", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    kind = dict(lines.dtypes)["conv_id"]
    # a digest needs the lines of a conversation one after another
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "id", "step").select("conv_id", "line").mapInArrow(
        _hashed, f"conv_id {kind}, sha string")
    every = pick(conversations, "conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c)
    return (
        every.alias("i").join(repaired.reports.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
        .join(hashed.alias("h"), F.col("i.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
        .select("i.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                F.coalesce("r.audit", F.lit("")).alias("audit"),
                F.coalesce("h.sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))


# CRC-32 bit by bit; then, row by row, the cheapest way to each state
SQL = r"""
WITH RECURSIVE
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars FROM conversations),
chance AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(chars, lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, e: xor(xor(c, e) >> 1, 3988292384::BIGINT * (xor(c, e) & 1))), 4294967295::BIGINT) % 20 AS r FROM keyed),
rows AS (
  SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role,
         CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE r WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n FROM chance),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM numbered),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM told),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
states(s, needed, following) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
inserted AS (
  SELECT s, s AS at, 0 AS n, []::VARCHAR[] AS lines FROM states
  UNION ALL SELECT s, following, 1, [needed || ':'] FROM states
  UNION ALL SELECT a.s, b.following, 2, [a.needed || ':', b.needed || ':'] FROM states a JOIN states b ON a.following = b.s),
ways AS (
  SELECT i.s, i.at, i.n, i.lines, t.needed, t.following, e.edit FROM inserted i JOIN states t ON i.at = t.s, (VALUES ('D'), ('K'), ('R')) e(edit)),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM counts
  UNION ALL
  SELECT b.conv_id, f.i, CASE w.edit WHEN 'D' THEN w.at WHEN 'R' THEN w.following ELSE if(f.initial = 's', 1, w.following) END AS s,
         min({'cost': b.b.cost + 5 * w.n + CASE w.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
                      + CASE WHEN w.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
              'audit': b.b.audit || repeat('I', w.n) || w.edit,
              'lines': list_concat(list_concat(b.b.lines, w.lines), CASE w.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [w.needed || ':' || f.text]
                                   ELSE [f.role || ':' || f.text] END)}) AS b
  FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN ways w ON w.s = b.s
  WHERE w.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (
    w.edit = 'R' OR f.initial = left(w.needed, 1) OR f.initial = 's' AND w.at = 0)
  GROUP BY ALL),
ended AS (
  SELECT b.conv_id, min({'cost': b.b.cost + 5 * CASE b.s WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END,
                         'audit': b.b.audit || CASE b.s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                         'lines': list_concat(b.b.lines, CASE b.s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END)}) AS b
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.b.cost, 0) AS cost,
       coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
