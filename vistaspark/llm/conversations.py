"""Conversation structure repair by weighted finite-state composition.

Three machines are composed: the input acceptor (a conversation's rows in order),
the edit transducer (Keep, Rerole, Delete, Insert, with their costs) and the
acceptor of the role grammar ``(s?(ua)+)?``.  The composition is lazy: its states
are made row by row, in topological order, and a row's step is made once for each
state of affairs that occurs.  Weights are (cost, label string), compared in that
order; the shortest path's labels are the audit, its output the repaired rows.

Rows are range-sorted once.  A conversation that lies within a part is repaired
where it lies.  One that is cut by parts' ends, or longer than a piece, becomes
pieces: each piece gives its weights from every grammar state to every other, a
conversation's pieces are multiplied as four by four matrices, and each piece is
told its ends.  No conversation is held as rows in one task; only a digest over
one whole conversation has to pass its rows in order.

Two facts keep the steps small.  Among paths that have just consumed row i no
label string is a prefix of another, so an order among (at most four) states
stands for the strings.  And a state whose cost is over 10 above the best is never
on a shortest path: two insertions at most (or a deletion and one insertion) lead
from any state to where any other's continuation works.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaspark.sources.workspace import Workspace

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The grammar's states: 0 nothing yet, 1 after the system row, 2 after user, 3 after assistant.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that Rerole and Insert give in a state, and the state after it.
_GIVEN, _AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Insertions that end a conversation from a state.
_TAIL = ("", "II", "I", "")
_SLACK = 10
_LEGAL = {"su", "ua", "au"}


@lru_cache(maxsize=1 << 16)
def _step(states: tuple, kind: tuple) -> tuple:
    """One row's layer of the composition.

    ``states``: (state, cost above the least, place in the order of label strings);
    ``kind``: (role initial, must go, truncated).  Gives the new states, what the
    least cost grew by, and for each new state (state before, labels).
    """
    initial, gone, cut = kind
    best: dict[int, tuple] = {}
    for state, cost, order in states:
        at, labels = state, ""
        for _ in range(3):
            options = [("D", DELETE, at)]
            if not gone:
                kept = TRUNCATED * cut
                options.append(("R", REROLE + kept, _AFTER[at]))
                if (at, initial) in _NEXT:
                    options.append(("K", kept, _NEXT[at, initial]))
            for label, more, to in options:
                found = (cost + more, order, labels + label, state)
                if to not in best or found < best[to]:
                    best[to] = found
            at, labels, cost = _AFTER[at], labels + "I", cost + INSERT
    least = min(f[0] for f in best.values())
    alive = sorted((f[1], f[2], to) for to, f in best.items() if f[0] <= least + _SLACK)
    new = tuple(sorted((to, best[to][0] - least, place) for place, (_, _, to) in enumerate(alive)))
    return new, least, {to: (best[to][3], best[to][2]) for to, _, _ in new}


def weights(kinds: list[tuple], start: int) -> dict[int, tuple[int, str, int]]:
    """Grammar state reached -> (cost, labels, place in the order of label strings) from a start state over rows of these kinds."""
    states, total, steps = ((start, 0, 0),), 0, []
    for kind in kinds:
        states, more, back = _step(states, kind)
        total += more
        steps.append(back)
    out = {}
    for state, cost, order in states:
        at, labels = state, []
        for back in reversed(steps):
            at, label = back[at]
            labels.append(label)
        out[state] = (total + cost, "".join(reversed(labels)), order)
    return out


def _ended(reached: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(cost, state) of the best end among states reached with (cost, order of labels)."""
    cost, _, state = min((c + INSERT * len(_TAIL[s]), order, s) for s, (c, order) in reached.items())
    return cost, state


def cheapest(kinds: list[tuple]) -> tuple[int, str]:
    """Cost and labels of the cheapest repair, the ASCII-least of equals."""
    found = weights(kinds, 0)
    cost, state = _ended({s: (c, o) for s, (c, _, o) in found.items()})
    return cost, found[state][1] + _TAIL[state]


def edited(labels: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(label, role, text) of the rows that labels leave, from a grammar state on."""
    row = 0
    for label in labels:
        if label != "D":
            role = roles[row] if label == "K" else _GIVEN[state]
            state = _NEXT[state, role[:1]] if label == "K" else _AFTER[state]
            yield label, role, "" if label == "I" else texts[row]
        row += label != "I"


@dataclass
class _Faults:
    """What is counted over consecutive rows; pieces add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def join(self, after: _Faults) -> None:
        self.blank += after.blank
        self.duplicate += after.duplicate
        self.truncated += after.truncated
        self.illegal += after.illegal + (self.last is not None and self.last + after.first not in _LEGAL)
        if after.low is not None:
            self.turns += after.turns - (self.high == after.low)
            self.low, self.high = after.low if self.low is None else self.low, after.high
        self.first, self.last = after.first if self.first is None else self.first, after.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def inspect(turns: list, roles: list[str], texts: list[str], seen: list[bool]) -> tuple[_Faults, list[tuple]]:
    """Counts and row kinds of consecutive rows (by turn, nulls first); ``seen``: role and text came before."""
    f, kinds = _Faults(), []
    for turn, role, text, again in zip(turns, roles, texts, seen):
        bare = text.rstrip(BLANKS)
        initial = role[:1]
        cut = bool(bare) and not again and bare[-1] not in ENDS
        f.blank += not bare
        f.duplicate += bool(bare) and again
        f.truncated += cut
        kinds.append((initial if initial in "sua" else "", not bare or again, cut))
        if f.last is not None:
            f.illegal += f.last + initial not in _LEGAL
        else:
            f.first = initial
        f.last = initial
        if turn is not None:
            f.turns += turn != f.high
            f.low, f.high = turn if f.low is None else f.low, turn
    return f, kinds


def _seen(roles: list[str], texts: list[str]) -> list[bool]:
    met: set = set()
    out = []
    for key in zip(roles, texts):
        out.append(key in met)
        met.add(key)
    return out


_REPORT = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType())]
_COUNTS = [n for n, _ in _REPORT]
_FACTS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last"]
_FACT_TYPES = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"


def _arrow(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


def _cut(batches: Iterator[pa.RecordBatch], like: pa.Schema, piece_rows: int, piece_chars: int, keep_turns: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one part: repaired conversations, and pieces of those that may go on elsewhere or are long."""
    from pyspark import TaskContext

    part, number, first = TaskContext.get().partitionId(), 0, True
    who = object()
    turns, roles, texts, size, cut_up = [], [], [], 0, False

    def piece() -> dict:
        nonlocal number
        number += 1
        return {"conv_id": who, "done": False, "piece": (part << 32) + number, "turn": turns, "role": roles, "text": texts}

    def finished(last: bool) -> dict:
        if first or last or cut_up:
            return piece()
        f, kinds = inspect(turns, roles, texts, _seen(roles, texts))
        cost, audit = cheapest(kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in edited(audit, 0, roles, texts)).encode("utf-8", "surrogatepass")).hexdigest()
        held = {"piece": (part << 32) + number, "turn": turns, "role": roles, "text": texts} if keep_turns else {}
        return held | {"conv_id": who, "done": True, "gaps": f.gaps(), "cost": cost, "audit": audit, "repaired_sha256": digest, **{c: getattr(f, c) for c in ("blank", "duplicate", "truncated", "illegal")}}

    out, weight = [], 0
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            if conv != who or len(turns) >= piece_rows or size >= piece_chars:
                if turns:
                    if conv == who:
                        cut_up = True
                    out.append(finished(False))
                    weight += size if not out[-1]["done"] or keep_turns else 200
                    if conv != who:
                        first = cut_up = False
                who, turns, roles, texts, size = conv, [], [], [], 0
                if weight > 1 << 22:
                    yield _arrow(out, like)
                    out, weight = [], 0
            turns.append(turn)
            roles.append(role)
            texts.append(text)
            size += len(text) + len(role) + 16
    if turns:
        out.append(finished(True))
    yield _arrow(out, like)


def _weigh(batches: Iterator[pa.RecordBatch], like: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each piece's counts, and its cost, label order and labels from every grammar state to every other (by 4 * from + to; -1: none)."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            again = set(r["later"] or ())
            f, kinds = inspect(r["turn"], r["role"], r["text"], [k in again for k in range(len(r["turn"]))])
            costs, orders, labels = [-1] * 16, [-1] * 16, [None] * 16
            for g in range(4):
                for to, (cost, text, order) in weights(kinds, g).items():
                    costs[4 * g + to], labels[4 * g + to], orders[4 * g + to] = cost, text, order
            out.append({"conv_id": r["conv_id"], "ck": r["ck"], "piece": r["piece"], "costs": costs, "orders": orders, "labels": labels, **{c: getattr(f, c) for c in _FACTS}})
        yield _arrow(out, like)


def _multiply(table: pa.Table, like: pa.Schema) -> pa.Table:
    """A conversation's pieces in order: grammar states at each one's ends; the last one has the counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    total, reached, steps = _Faults(), {0: (0, 0)}, []
    for r in rows:
        total.join(_Faults(**{c: r[c] for c in _FACTS}))
        best: dict[int, tuple] = {}
        for g, (cost, order) in reached.items():
            for to in range(4):
                if r["costs"][4 * g + to] >= 0:
                    found = (cost + r["costs"][4 * g + to], order, r["orders"][4 * g + to], g)
                    if to not in best or found < best[to]:
                        best[to] = found
        alive = sorted((f[1], f[2], to) for to, f in best.items())
        reached = {to: (best[to][0], place) for place, (_, _, to) in enumerate(alive)}
        steps.append({to: f[3] for to, f in best.items()})
    cost, state = _ended(reached)
    out = []
    for k in range(len(rows) - 1, -1, -1):
        before = steps[k][state]
        last = k == len(rows) - 1
        told = {"conv_id": rows[k]["conv_id"], "ck": rows[k]["ck"], "piece": rows[k]["piece"], "begin": before, "end": state, "tail": _TAIL[state] if last else ""}
        if last:
            told |= {"gaps": total.gaps(), "cost": cost, "blank": total.blank, "duplicate": total.duplicate, "truncated": total.truncated, "illegal": total.illegal}
        out.append(told)
        state = before
    return pa.Table.from_pylist(out, schema=like)


def _digest(batches: Iterator[pa.RecordBatch], like: pa.Schema) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired rows, its pieces coming in order; no more than a batch is held."""
    who, state, any_row = None, hashlib.sha256(), False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["ck"] != who:
                if who is not None:
                    out.append({"ck": who, "repaired_sha256": state.hexdigest()})
                who, state, any_row = r["ck"], hashlib.sha256(), False
            for _, role, text in edited(r["edits"], r["begin"], r["role"], r["text"]):
                state.update((("\n" if any_row else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                any_row = True
        yield _arrow(out, like)
    if who is not None:
        yield _arrow([{"ck": who, "repaired_sha256": state.hexdigest()}], like)


def _turns(batches: Iterator[pa.RecordBatch], like: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rows = [{"conv_id": r["conv_id"], "piece": r["piece"], "place": k, "edit": e, "role": role, "text": text} for k, (e, role, text) in enumerate(edited(r["edits"], r["begin"], r["role"], r["text"]))]
            yield _arrow(rows, like)


def conv_key(conv: Column) -> Column:
    """A text for each id; null has its own."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


@dataclass
class Repaired:
    """``report``: one row a conversation; ``turns``: the repaired rows (None unless asked for), in order of ``piece`` and ``place``."""

    report: DataFrame
    turns: DataFrame | None


def repair(rows: DataFrame, keep_turns: bool = False, piece_rows: int = 4096, piece_chars: int = 1 << 22) -> Repaired:
    """Faults and the cheapest repair of every conversation of (conv_id, turn, role, text).

    ``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost (long),
    audit, repaired_sha256.  Rows are taken by turn, nulls first; rows of one turn
    by role, then by the text's hash; equal rows are adjacent and all but the first
    are duplicates.  A row's first fault counts: blank (nothing but U+0020, U+0009
    to U+000D), duplicate (role and text came before in the conversation), truncated
    (the last other character is none of ``.!?``).  Null role and text are one
    space.  A null conv_id is a conversation like any other; gaps leave null turns
    out.  Roles that start with none of s, u, a can be reroled or deleted.  Texts
    count whole, conversations may be of any length (an audit is one value, so its
    length is bounded by what a value may hold).  Other columns, whatever their
    names, are not looked at.  An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    work = Workspace(spark, "conversations")
    kind = rows.schema["conv_id"].dataType
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    laid = plain.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("hash")

    arrays = [T.StructField("turn", T.ArrayType(T.LongType())), T.StructField("role", T.ArrayType(T.StringType())), T.StructField("text", T.ArrayType(T.StringType()))]
    told = [T.StructField(n, t) for n, t in _REPORT] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    cut_schema = T.StructType([T.StructField("conv_id", kind), T.StructField("done", T.BooleanType()), T.StructField("piece", T.LongType()), *arrays, *told])
    cut_like = to_arrow_schema(cut_schema)
    cut = work.put(laid.mapInArrow(lambda b: _cut(b, cut_like, piece_rows, piece_chars, keep_turns), cut_schema), "cut")
    done = cut.where("done")

    # Conversations in pieces.  Rows that came before, by the hash of role and text.
    pieces = cut.where("not done").select(conv_key(F.col("conv_id")).alias("ck"), "conv_id", "piece", "turn", "role", "text")
    each = pieces.select("ck", "piece", F.posexplode(F.arrays_zip("role", "text")).alias("pos", "row")).select(
        "ck", "piece", "pos", F.xxhash64("row.role", "row.text").alias("h1"), F.xxhash64(F.lit("second"), "row.text", "row.role").alias("h2"))
    met = work.put(each, "met")
    first = met.groupBy("ck", "h1", "h2").agg(F.min(F.struct("piece", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = met.join(first, ["ck", "h1", "h2"]).where(F.struct("piece", "pos") > F.col("first")).groupBy("piece").agg(F.collect_list("pos").alias("later"))

    weighed_schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(f"ck string, piece long, costs array<long>, orders array<int>, labels array<string>, {_FACT_TYPES}").fields])
    weighed_like = to_arrow_schema(weighed_schema)
    weighed = work.put(pieces.join(later, "piece", "left").select("conv_id", "ck", "piece", "turn", "role", "text", "later").mapInArrow(lambda b: _weigh(b, weighed_like), weighed_schema), "weighed")
    ends_schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("ck string, piece long, begin int, end int, tail string").fields, *[T.StructField(n, t) for n, t in _REPORT]])
    ends_like = to_arrow_schema(ends_schema)

    def multiply(table: pa.Table) -> pa.Table:
        return _multiply(table, ends_like)

    ends = work.put(weighed.select("conv_id", "ck", "piece", "costs", "orders", *_FACTS).groupBy("ck").applyInArrow(multiply, ends_schema), "ends")
    edits = weighed.select("piece", "labels").join(ends, "piece").select(
        "ck", "piece", "begin", F.concat(F.get("labels", 4 * F.col("begin") + F.col("end")), "tail").alias("edits"))
    edits = work.put(edits, "edits")
    audits = edits.groupBy("ck").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    digest_like = pa.schema([("ck", pa.string()), ("repaired_sha256", pa.string())])
    digests = (
        pieces.select("piece", "role", "text").join(edits, "piece").select("ck", "piece", "begin", "edits", "role", "text")
        .repartition("ck").sortWithinPartitions("ck", "piece").mapInArrow(lambda b: _digest(b, digest_like), "ck string, repaired_sha256 string")
    )
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    opened = ends.where(F.col("cost").isNotNull()).join(audits, "ck").join(digests, "ck").select(*names)
    report = done.select(*names).unionByName(opened)
    if not keep_turns:
        return Repaired(report, None)
    turn_schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("piece long, place int, edit string, role string, text string").fields])
    turn_like = to_arrow_schema(turn_schema)
    whole = done.select("conv_id", "piece", F.lit(0).alias("begin"), F.col("audit").alias("edits"), "role", "text")
    parts = pieces.select("conv_id", "piece", "role", "text").join(edits.select("piece", "begin", "edits"), "piece").select(*whole.columns)
    return Repaired(report, whole.unionByName(parts).mapInArrow(lambda b: _turns(b, turn_like), turn_schema))


#: Digest of nothing: of a conversation without rows.
NOTHING = hashlib.sha256(b"").hexdigest()


def report_for(ids: DataFrame, report: DataFrame) -> DataFrame:
    """A row for every distinct conv_id of ``ids``; those without rows have zeros, no audit and the digest of nothing."""
    every = ids.select("conv_id").distinct().withColumn("ck", conv_key(F.col("conv_id")))
    found = report.withColumn("ck", conv_key(F.col("conv_id"))).drop("conv_id")
    zero = {**{c: F.lit(0).cast("long") for c in _COUNTS}, "audit": F.lit(""), "repaired_sha256": F.lit(NOTHING)}
    return every.join(found, "ck", "left").select("conv_id", *[F.coalesce(F.col(c), z).alias(c) for c, z in zero.items()])
