"""Conversation structure repair: the cheapest edits that give a conversation the shape (system? (user assistant)+)?, by Hirschberg's method.

A message's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation) or truncated (the
last other character is none of `.!?`). Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant
message) 5; a truncated message that isn't deleted adds 5, blanks and duplicates are deleted. Of the cheapest edits those whose initials in order are
ASCII-least are taken.

The shape has four states: nothing yet, after a system, a user or an assistant message; a sequence may end in the first and the last. Which role an
insertion or a reroling gives follows from the state, so edits are known by their initials. An insertion right before a deletion is never
least (the two could be swapped), so a message's step is some insertions and then Keep or Rerole, or Delete alone. No step's initials begin another's, so
of two paths to different states the lesser one is known before their ends: with each of the four costs goes the rank of its least path.

Reconstruction: a forward vector (costs and ranks from the state before) and a backward vector (costs to the state after) meet in the middle; the
crossing with the least sum, among equals with the least rank, is on the path; both halves recur. Vectors are four numbers, so space is linear. The method runs at three
heights: within a chunk of messages; over the chunks of a conversation in one Spark partition, where a chunk is a matrix of 4 by 4 costs and ranks; and over
those parts of a conversation that several partitions hold. Differences of the costs in a vector are bounded, so vectors are few and their steps are remembered.

On Spark: equal messages of one turn are counted together before the shuffle; what several turns repeat is found by an aggregate of hashes,
hot ones joined by broadcast (common.by_key); messages are range-sorted by (conv_id, turn, role, text), so a conversation with a large share of
all rows spreads over partitions. At most one conversation goes over a partition's edge, so the driver sees two small rows a partition. For the report, chunks are
brought together by conversation and streamed: SHA-256 is sequential, so its bytes pass one task, a chunk at a time; the audit, a
character an edit, is a value of the result.

Nulls: a null conv_id is a conversation of its own; null turns come first; a null role or text is one blank. Messages of one turn are
ordered by role, then text. Roles count by their first character; an empty role is none of the three. Repeated rows are duplicates. A conversation
without rows has zeros and empty results; an empty table gives none. A very long message is a chunk of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Bytes of a chunk's messages.
CHUNK_BYTES = 1 << 16
NONE = 1 << 60
_SPACE = "\x09\x0a\x0b\x0c\x0d\x20"

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_INSERTED = (2, 2, 3, 2)
_NAMES = {1: "system", 2: "user", 3: "assistant"}
#: Insertions that end a sequence from each state.
_TAIL = (0, 2, 1, 0)


def _kept(state: int, kind: int) -> int:
    """The state after keeping a message of a kind (1 system, 2 user, 3 assistant, 0 other), -1 where it can't follow."""
    return {1: 1 if state == 0 else -1, 2: 2 if state != 2 else -1, 3: 3 if state == 2 else -1}.get(kind, -1)


# ---- steps and vectors ----------------------------------------------------------------------------------------------

#: A matrix holds costs[s][t], ranks[s][t] (of the least path to t among those from s); a vector one row of each.


def _ranked(keys: list) -> tuple[int, ...]:
    order = sorted(range(4), key=lambda t: keys[t])
    return tuple(order.index(t) for t in range(4))


def _message(kind: int, truncated: bool) -> tuple[list[list[int]], list[tuple[int, ...]], list[list[str]]]:
    costs, ranks, names = [], [], []
    for s in range(4):
        best: list[tuple[int, str]] = [(NONE, "~")] * 4
        best[s] = (DELETE, "D")
        at = s
        for k in range(4):
            more = k * INSERT + (TRUNCATED if truncated else 0)
            for to, cost, name in ((_kept(at, kind), KEEP, "K"), (_INSERTED[at], REROLE, "R")):
                if to >= 0:
                    best[to] = min(best[to], (more + cost, "I" * k + name))
            at = _INSERTED[at]
        costs.append([c for c, _ in best])
        names.append([n for _, n in best])
        ranks.append(_ranked([(n, t) for t, (_, n) in enumerate(best)]))
    return costs, ranks, names


#: By code: kind, and 4 more if truncated.
MESSAGES = [_message(code % 4, code >= 4) for code in range(8)]


def _unit(s: int) -> tuple:
    return tuple(0 if t == s else NONE for t in range(4)), (0, 1, 2, 3)


def _on(vector: tuple, matrix: tuple) -> tuple:
    """A forward vector after one more step."""
    (cost, rank), (costs, ranks) = vector, matrix[:2]
    out, keys = [], []
    for t in range(4):
        c, r, s = min((min(cost[s] + costs[s][t], NONE), rank[s], s) for s in range(4))
        out.append(c)
        keys.append((c >= NONE, r, ranks[s][t], t))
    return tuple(out), _ranked(keys)


def _back(cost: tuple, matrix: tuple) -> tuple:
    """A backward vector before one more step."""
    return tuple(min(min(matrix[0][s][t] + cost[t], NONE) for t in range(4)) for s in range(4))


def _less(cost: tuple) -> tuple[tuple, int]:
    low = min(cost)
    return tuple(c - low if c < NONE else NONE for c in cost), low


@lru_cache(1 << 16)
def _on_message(vector: tuple, code: int) -> tuple[tuple, int]:
    cost, rank = _on(vector, MESSAGES[code])
    cost, low = _less(cost)
    return (cost, rank), low


@lru_cache(1 << 16)
def _back_message(cost: tuple, code: int) -> tuple[tuple, int]:
    return _less(_back(cost, MESSAGES[code]))


def forward(steps, vector: tuple) -> tuple:
    """A forward vector after steps, which are codes of messages or matrices."""
    total = 0
    for x in steps:
        if isinstance(x, int):
            vector, low = _on_message(vector, x)
            total += low
        else:
            vector = _on(vector, x)
    return tuple(min(c + total, NONE) for c in vector[0]), vector[1]


def backward(steps, cost: tuple) -> tuple:
    total = 0
    for x in reversed(steps):
        if isinstance(x, int):
            cost, low = _back_message(cost, x)
            total += low
        else:
            cost = _back(cost, x)
    return tuple(min(c + total, NONE) for c in cost)


def matrix_of(codes: list[int]) -> tuple:
    """The matrix of a run of messages."""
    rows = [forward(codes, _unit(s)) for s in range(4)]
    return [r[0] for r in rows], [r[1] for r in rows]


def crossings(steps: list, first: int, last: int) -> list[int]:
    """The state after each step, on the least of the cheapest paths from state first to state last."""
    if len(steps) <= 1:
        return [last] * len(steps)
    mid = len(steps) // 2
    cost, rank = forward(steps[:mid], _unit(first))
    after = backward(steps[mid:], _unit(last)[0])
    meet = min(range(4), key=lambda t: (cost[t] + after[t], rank[t]))
    return crossings(steps[:mid], first, meet) + crossings(steps[mid:], meet, last)


def last_state(vector: tuple) -> int:
    return min(range(4), key=lambda t: (vector[0][t] + _TAIL[t] * INSERT, vector[1][t]))


# ---- faults ---------------------------------------------------------------------------------------------------------


def prepared(messages: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, m (how often), code, blank and repeated of different messages, from messages with blanks for nulls.

    copies: how often each row counts; a row of 0 only keeps its conversation in the result.
    """
    gone = F.lit(False) if copies is None else copies == 0
    rows = messages.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(gone, "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("m"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("m").alias("m"))
    bare = F.rtrim("text", F.lit(_SPACE))
    # of conv_id, the text or the null; the key is of the three and has no two readings
    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull().cast("string"), F.octet_length("role"), F.col("role"), F.col("text")).cast("binary"), 256))
    kind = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    rows = rows.withColumn("key", key).withColumn("blank", bare == "").withColumn("code", (kind + F.when(cut, 4).otherwise(0)).cast("int"))
    rows = common.stored(rows, "repair-messages")
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = rows.where("m > 0 and not blank").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = common.by_key(rows, common.stored(again, "repair-repeats"), "key", max(1, rows.count()), "left")
    return rows.select("conv_id", "turn", "role", "text", "m", "code", "blank", F.coalesce(place != F.col("first"), F.lit(False)).alias("repeated"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _described(turns: list, roles: list, m: list, code: list, blank: list, repeated: list) -> tuple[list, list[int]]:
    """Of one conversation's messages in order: the values of a chunk, and which of the messages may stay."""
    n = dict.fromkeys(_COUNTS, 0)
    moves: list[int] = []
    stay: list[int] = []
    held = [t for t, k in zip(turns, m, strict=True) if k and t is not None]
    first = last = None
    for i, times in enumerate(m):
        if not times:
            continue
        role = roles[i][:1]
        n["illegal"] += times - 1
        if first is None:
            first = role
        elif last + role not in ("su", "ua", "au"):
            n["illegal"] += 1
        last = role
        if blank[i] or repeated[i]:
            n["blank" if blank[i] else "duplicate"] += times
            moves.append(-times)
            continue
        n["truncated"] += code[i] >= 4
        n["duplicate"] += times - 1
        stay.append(i)
        moves.append(code[i])
        if times > 1:
            moves.append(1 - times)
    n["turns"] = len(set(held))
    costs, ranks = matrix_of([x for x in moves if x >= 0])
    return [held[0] if held else None, held[-1] if held else None, first, last, *n.values(), moves, [c for r in costs for c in r], [c for r in ranks for c in r]], stay


def _chunks(rows: DataFrame) -> DataFrame:
    """prepared rows, range-sorted, as chunks of one conversation each; part and nr order them.

    moves: the code of a message that may stay, or, less than 0, how many deletions are forced. lines: the messages that may stay.
    """
    common.small_batches(rows.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    names = ["first_turn", "last_turn", "first_role", "last_role", *_COUNTS, "moves", "costs", "ranks"]
    kinds = [turn, turn, "string", "string", *["long"] * 5, "array<long>", "array<long>", "array<int>"]
    schema = f"conv_id {conv}, part int, nr int, {', '.join(f'{c} {k}' for c, k in zip(names, kinds, strict=True))}, lines array<struct<role:string,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nr = TaskContext.get().partitionId(), 0
        for batch in common.slices(batches, limit=CHUNK_BYTES):
            of = common.col(batch, "conv_id").dictionary_encode("encode").indices.to_numpy()
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
            columns = [common.col(batch, c).to_pylist() for c in ("turn", "role", "m", "code", "blank", "repeated")]
            values, stay, ends = [], [], [0]
            for a, b in zip(heads, [*heads[1:], batch.num_rows], strict=True):
                row, some = _described(*(c[a:b] for c in columns))
                values.append(row)
                stay += [a + i for i in some]
                ends.append(len(stay))
            at = common.col(batch, "turn").type
            types = [at, at, pa.string(), pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32())]
            take = pa.array(stay, pa.int64())
            lines = pa.StructArray.from_arrays([common.col(batch, c).take(take).cast(pa.string()) for c in ("role", "text")], names=["role", "text"])
            out = [common.col(batch, "conv_id").take(pa.array(heads)), pa.array([part] * len(heads), pa.int32()), pa.array(range(nr, nr + len(heads)), pa.int32())]
            out += [pa.array(c, t) for c, t in zip(zip(*values, strict=True), types, strict=True)]
            nr += len(heads)
            yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)], names=["conv_id", "part", "nr", *names, "lines"])

    return rows.mapInArrow(run, schema)


# ---- crossings of chunks --------------------------------------------------------------------------------------------


def _matrices(t: pa.Table) -> tuple[list, list[tuple]]:
    """Conversations and matrices of a partition's chunks in order."""
    t = t.sort_by("nr")
    made = []
    for c, r in zip(t.column("costs").to_pylist(), t.column("ranks").to_pylist(), strict=True):
        made.append(([tuple(c[4 * s : 4 * s + 4]) for s in range(4)], [tuple(r[4 * s : 4 * s + 4]) for s in range(4)]))
    return t.column("conv_id").to_pylist(), made


def _runs(convs: list) -> list[tuple[int, int]]:
    heads = [i for i, c in enumerate(convs) if not i or c != convs[i - 1]]
    return list(zip(heads, [*heads[1:], len(convs)][: len(heads)], strict=True))


def _states(chunks: DataFrame) -> DataFrame:
    """part, nr, before and after: the states that the least of the cheapest paths has around each chunk."""
    spark = chunks.sparkSession
    narrow = chunks.select("conv_id", "part", "nr", "costs", "ranks")
    conv = chunks.schema["conv_id"].dataType.simpleString()

    def ends(t: pa.Table) -> pa.Table:
        """The first and the last conversation of a partition as one matrix each."""
        convs, made = _matrices(t)
        runs = _runs(convs)
        rows = []
        for k in sorted({0, len(runs) - 1}):
            a, b = runs[k]
            vectors = [forward(made[a:b], _unit(s)) for s in range(4)]
            rows.append((convs[a], t.column("part")[0].as_py(), k, [c for v in vectors for c in v[0]], [c for v in vectors for c in v[1]]))
        columns = list(zip(*rows, strict=True))
        return pa.table({"conv_id": pa.array(columns[0], t.schema.field("conv_id").type), "part": pa.array(columns[1], pa.int32()), "run": pa.array(columns[2], pa.int32()), "costs": pa.array(columns[3], pa.list_(pa.int64())), "ranks": pa.array(columns[4], pa.list_(pa.int32()))})

    # at most two rows a partition of the range sort
    edge = narrow.groupBy("part").applyInArrow(ends, f"conv_id {conv}, part int, run int, costs array<long>, ranks array<int>").collect()
    edge.sort(key=lambda r: (r.part, r.run))
    given: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b in _runs([(r.conv_id,) for r in edge]):
        if b - a > 1:
            steps = [([tuple(r.costs[4 * s : 4 * s + 4]) for s in range(4)], [tuple(r.ranks[4 * s : 4 * s + 4]) for s in range(4)]) for r in edge[a:b]]
            states = [0, *crossings(steps, 0, last_state(forward(steps, _unit(0))))]
            given |= {(r.part, r.run): (states[i], states[i + 1]) for i, r in enumerate(edge[a:b])}
    shared = spark.sparkContext.broadcast(given)

    def inside(t: pa.Table) -> pa.Table:
        convs, made = _matrices(t)
        part = t.column("part")[0].as_py()
        states = []
        for k, (a, b) in enumerate(_runs(convs)):
            first, last = shared.value.get((part, k)) or (0, last_state(forward(made[a:b], _unit(0))))
            at = [first, *crossings(made[a:b], first, last)]
            states += zip(at, at[1:])
        before, after = zip(*states, strict=True)
        return pa.table({"part": pa.array([part] * len(states), pa.int32()), "nr": pa.array(sorted(t.column("nr").to_pylist()), pa.int32()), "before": pa.array(before, pa.int32()), "after": pa.array(after, pa.int32())})

    return narrow.groupBy("part").applyInArrow(inside, "part int, nr int, before int, after int")


# ---- edits ----------------------------------------------------------------------------------------------------------


def _edits(moves: list[int], before: int, after: int) -> Iterator[tuple[str, int]]:
    """Initial and role (0: the message's own, -1: deleted) of each edit, by moves."""
    codes = [x for x in moves if x >= 0]
    states = iter([before, *crossings(codes, before, after)])
    at = next(states)
    for x in moves:
        if x < 0:
            yield from [("D", -1)] * -x
            continue
        to = next(states)
        for name in MESSAGES[x][2][at][to]:
            if name == "D":
                yield name, -1
            elif name == "K":
                yield name, 0
            else:
                yield name, _INSERTED[at]
            at = _INSERTED[at] if name == "I" else at
        at = to


def repaired(messages: DataFrame, copies: Column | None = None) -> DataFrame:
    """The chunks of each conversation, with cost, audit (the edits' initials) and result (role, text of the messages after repair).

    A conversation's chunks are ordered by part and nr; ending insertions are those of the last chunk.
    """
    chunks = common.stored(_chunks(prepared(messages, copies)), "repair-chunks")
    states = common.stored(_states(chunks), "repair-states")
    last = chunks.groupBy("conv_id").agg(F.max(F.struct("part", "nr")).alias("p")).select("p.part", "p.nr", F.lit(True).alias("ends"))
    rows = chunks.drop("costs", "ranks").join(states.join(last, ["part", "nr"], "left"), ["part", "nr"])
    kept = ["conv_id", "part", "nr", "first_turn", "last_turn", "first_role", "last_role", *_COUNTS]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, results = [], [], []
            columns = (common.col(batch, c).to_pylist() for c in ("moves", "before", "after", "ends", "lines"))
            for moves, before, after, ends, lines in zip(*columns, strict=True):
                audit, out, cost = [], [], 0
                own = iter(lines)
                codes = (x for x in moves if x >= 0)
                line = code = None
                forced = iter([f for x in moves for f in ([True] * -x if x < 0 else [False])])
                must = next(forced, None)
                for name, role in _edits(moves, before, after):
                    audit.append(name)
                    if name == "I":
                        cost += INSERT
                        out.append({"role": _NAMES[role], "text": ""})
                        continue
                    if not must:
                        line, code = next(own), next(codes)
                        if name != "D":
                            cost += (REROLE if name == "R" else KEEP) + (TRUNCATED if code >= 4 else 0)
                            out.append({"role": _NAMES[role] if name == "R" else line["role"], "text": line["text"]})
                    cost += DELETE if name == "D" else 0
                    must = next(forced, None)
                for _ in range(_TAIL[after] if ends else 0):
                    audit.append("I")
                    cost += INSERT
                    out.append({"role": _NAMES[_INSERTED[after]], "text": ""})
                    after = _INSERTED[after]
                costs.append(cost)
                audits.append("".join(audit))
                results.append(out)
            made = [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(results, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*(common.col(batch, c) for c in kept), *made], names=[*kept, "cost", "audit", "result"])

    return rows.mapInArrow(run, f"{fields}, cost long, audit string, result array<struct<role:string,text:string>>")


def report(chunks: DataFrame) -> DataFrame:
    """A row a conversation of repaired chunks: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    rows = chunks.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "nr")
    conv = chunks.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def closed(kind: pa.DataType) -> pa.RecordBatch:
            gaps = held["last"] - held["first"] + 1 - held["turns"] if held["first"] is not None else 0
            values = [gaps, *(held[c] for c in names[1:6]), "".join(held["audit"]), held["hash"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([held["conv_id"]], kind), *(pa.array([v]) for v in values)], names=["conv_id", *names])

        kind, done = None, []
        for batch in batches:
            kind = common.col(batch, "conv_id").type
            for row in zip(*(common.col(batch, c).to_pylist() for c in batch.schema.names), strict=True):
                r = dict(zip(batch.schema.names, row, strict=True))
                if held is None or r["conv_id"] != held["conv_id"]:
                    if held is not None:
                        done.append(closed(kind))
                    held = dict.fromkeys([*names[1:6], "turns"], 0) | {"conv_id": r["conv_id"], "first": None, "last": None, "role": None, "audit": [], "hash": hashlib.sha256(), "some": False}
                if r["first_turn"] is not None:
                    held["turns"] -= held["last"] == r["first_turn"]
                    held["first"] = r["first_turn"] if held["first"] is None else held["first"]
                    held["last"] = r["last_turn"]
                if r["first_role"] is not None:
                    held["illegal"] += held["role"] is not None and held["role"] + r["first_role"] not in ("su", "ua", "au")
                    held["role"] = r["last_role"]
                for c in (*_COUNTS, "cost"):
                    held[c] += r[c]
                held["audit"].append(r["audit"])
                if r["result"]:
                    held["hash"].update(("\n" if held["some"] else "").encode() + "\n".join(f"{x['role']}:{x['text']}" for x in r["result"]).encode())
                    held["some"] = True
            if len(done) > 256:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if held is not None:
            done.append(closed(kind))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    schema = f"conv_id {conv}, {', '.join(c + ' long' for c in names[:6])}, audit string, repaired_sha256 string"
    return rows.select("conv_id", "part", "nr", "first_turn", "last_turn", "first_role", "last_role", *_COUNTS, "cost", "audit", "result").mapInArrow(run, schema)


# ---- the query ------------------------------------------------------------------------------------------------------


def damaged(messages: DataFrame) -> tuple[DataFrame, Column]:
    """messages with planted faults, by the checksum of each `conv_id:turn` modulo 20, and the copies of each row.

    0 drops the row, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(F.coalesce("text", F.lit(" ")), "[.!?]", "")).otherwise(F.col("text"))
    rows = messages.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repaired(*damaged(common.table(spark, sf_dir, "conversations"))))


def _oracle() -> str:
    """The same as plain dynamic programming: four structs of cost, audit and messages a conversation, message by message."""

    def least(*some: str) -> str:
        return f"list_sort(list_filter([{', '.join(some)}], lambda x: x is not null))[1]"

    def moved(state: str, cost: str, name: str, line: str | None, when: str = "true") -> str:
        lines = f"list_append({state}.r, {line})" if line else f"{state}.r"
        return f"case when {state} is not null and {when} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{name}', 'r': {lines}}} end"

    more, own = "case when cut then 5 else 0 end", "role || ':' || text"
    inserted = {"u": ["s0", "s1", "s3"], "a": ["s2"]}
    text = {"u": "'user:'", "a": "'assistant:'"}
    rounds = "select w.conv_id, m.i, s0, s1, s2, s3, role, text, kind, cut, forced from walk w join marked m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1"
    for k in (1, 2, 3):
        before = inserted if k == 1 else {"u": [f"a{k - 1}"], "a": [f"u{k - 1}"]}
        u, a = (least(*[moved(x, "5", "I", text[t]) for x in before[t]]) for t in "ua")
        rounds = f"select *, {u} as u{k}, {a} as a{k} from ({rounds})"
    users = ["s0", "s1", "s3", "a1", "a2", "a3"]  # what a user message may follow
    others = ["s2", "u1", "u2", "u3"]
    to2 = [moved(x, more, "K", own, "kind = 'u'") for x in users] + [moved(x, f"1 + {more}", "R", "'user:' || text") for x in users]
    to3 = [moved(x, more, "K", own, "kind = 'a'") for x in others] + [moved(x, f"1 + {more}", "R", "'assistant:' || text") for x in others]
    gone = [moved(f"s{k}", "2", "D", None) for k in range(4)]
    kept = [[], [moved("s0", more, "K", own, "kind = 's'")], to2, to3]
    steps = ", ".join(f"case when forced then {gone[k]} else {least(gone[k], *kept[k])} end as s{k}" for k in range(4))
    one, two = moved("s2", "5", "I", text["a"]), "case when s1 is not null then {'c': s1.c + 10, 'a': s1.a || 'II', 'r': list_append(list_append(s1.r, 'user:'), 'assistant:')} end"
    none = "null::struct(c bigint, a varchar, r varchar[])"
    return f"""
with recursive tab as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i)) as t),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations),
faults as (
  select *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::bigint),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295), 4294967295) % 20 as fault from named, tab),
after as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) from faults)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from after),
ordered as (
  select *, row_number() over (partition by conv_id, role, text order by i) as seen, rtrim(text, e' \\t\\n\\x0B\\x0C\\r') as bare, role[1] as kind from placed),
marked as (
  select *, bare = '' or seen > 1 as forced, bare[-1] not in ('.', '!', '?') as cut,
    lag(kind) over (partition by conv_id order by i) || kind not in ('su', 'ua', 'au') as illegal from ordered),
walk as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 'r': []::varchar[]}} as s0, {none} as s1, {none} as s2, {none} as s3 from (select distinct conv_id from conversations)
  union all
  select conv_id, i, {steps} from ({rounds})),
ended as (select conv_id, {least('s0', 's3', one, two)} as e from walk qualify row_number() over (partition by conv_id order by i desc) = 1),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(bare = '') as blank, count_if(bare <> '' and seen > 1) as duplicate,
    count_if(not forced and cut) as truncated, count_if(illegal) as illegal from marked group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, e.c::bigint as cost, e.a as audit, sha256(array_to_string(e.r, e'\\n')) as repaired_sha256
from ended e left join counts c on c.conv_id is not distinct from e.conv_id"""


OP11_SQL = _oracle()
