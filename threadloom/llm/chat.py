"""Chat formatting by minimum-cost repair of the sequence of roles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import frugal, quoted
from threadloom.plans.scratch import cut

#: States of the automaton: nothing yet, or the role of the turn that is open.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
#: Other spellings of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "model": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT}
UNKNOWN = 0
NEVER = 1 << 40
#: Turns and characters of a segment, the unit that one row holds.
SEGMENT_TURNS, SEGMENT_CHARS = 512, 1 << 20

#: Inserted empty turns that make a role legal in a state; where none is listed no insertion does.
_INSERTS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Inserted empty turns that end a conversation in a state. One without turns stays empty.
_ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


@dataclass(frozen=True)
class Costs:
    """What each repair costs. A turn of an unknown role has to be given one."""

    merge: int = 1
    insert: int = 2
    relabel: int = 3
    name_unknown: int = 1

    def moves(self) -> dict[int, list[list[tuple[int, int, str, tuple[int, ...]]]]]:
        """For each role of a turn and each state the choices (cost, next state, action, insertions), the preferred
        first among equal costs: keep, merge, relabel, each without insertions before with."""
        out = {}
        for role in (UNKNOWN, SYSTEM, USER, ASSISTANT):
            other = self.name_unknown if role == UNKNOWN else self.relabel
            out[role] = []
            for state in range(4):
                found = []
                for target in (SYSTEM, USER, ASSISTANT):
                    if (state, target) in _INSERTS:
                        before = _INSERTS[state, target]
                        action = "keep" if target == role else "relabel"
                        found.append((len(before) * self.insert + (0 if target == role else other), target, action, before))
                if state != START:
                    found.append((self.merge + (0 if state == role else other), state, "merge", ()))
                order = {"keep": 0, "merge": 1, "relabel": 2}
                out[role].append(sorted(found, key=lambda x: (bool(x[3]), order[x[2]], x[1])))
        return out

    def ending(self) -> list[int]:
        return [len(_ENDING[s]) * self.insert for s in range(4)]


def role_of(name: str | None) -> int:
    return ALIASES.get((name or "").strip().lower(), UNKNOWN)


Table = tuple[list[list[int]], list[list[int]]]  # cost, and rank of the preferred path, from each state to each


def one() -> Table:
    return [[0 if a == b else NEVER for b in range(4)] for a in range(4)], [[0] * 4 for _ in range(4)]


def after(first: Table, second: Table) -> Table:
    """Both in a row. Of equally cheap ways the one that ranks first in the first table, then in the second, is kept."""
    cost, rank = [], []
    for a in range(4):
        best = [min((first[0][a][m] + second[0][m][b], first[1][a][m], second[1][m][b], m) for m in range(4)) for b in range(4)]
        keys = sorted({x[1:3] for x in best})
        cost.append([min(x[0], NEVER) for x in best])
        rank.append([keys.index(x[1:3]) for x in best])
    return cost, rank


def turn_table(moves: list[list[tuple]]) -> Table:
    cost, rank = [[NEVER] * 4 for _ in range(4)], [[9] * 4 for _ in range(4)]
    for state in range(4):
        for k, (c, to, *_) in enumerate(moves[state]):
            if c < cost[state][to]:
                cost[state][to], rank[state][to] = c, k
    return cost, rank


def best_exit(table: Table, state: int, to_go: list[int]) -> int:
    return min(range(4), key=lambda x: (min(table[0][state][x] + to_go[x], NEVER), table[1][state][x]))


def before(table: Table, to_go: list[int]) -> list[int]:
    """Cost to go at the entry, from that at the exit."""
    return [min(min(c + v for c, v in zip(row, to_go)), NEVER) for row in table[0]]


def walk(roles: list[int], moves: dict, state: int, to_go: list[int]) -> list[tuple]:
    """The choice for each turn: cheapest in all, and at each turn the preferred one of those that still allow it."""
    left = [to_go]
    for role in reversed(roles):
        left.append([min((min(c + left[-1][to], NEVER) for c, to, *_ in moves[role][s]), default=NEVER) for s in range(4)])
    left.reverse()
    out = []
    for k, role in enumerate(roles):
        choice = next(m for m in moves[role][state] if m[0] + left[k + 1][m[1]] == left[k][state])
        out.append(choice)
        state = choice[1]
    return out


def piece(choice: tuple, state: int, text: str, last: bool) -> str:
    """What a turn adds to the rendered conversation: closes, opens, its text, and at the end what completes it."""
    _, to, action, inserted = choice
    out = []
    if action == "merge":
        out.append("\n" + text)
    else:
        for role in inserted:
            out.append(_open(state, role))
            state = role
        out.append(_open(state, to) + text)
    if last:
        state = to
        for role in _ENDING[to]:
            out.append(_open(state, role))
            state = role
        out.append("<|im_end|>\n")
    return "".join(out)


def _open(state: int, role: int) -> str:
    return ("<|im_end|>\n" if state != START else "") + f"<|im_start|>{ROLES[role]}\n"


_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _segments(ordered: DataFrame, moves: dict) -> DataFrame:
    """One row for each run of consecutive turns of a conversation within a partition, of bounded size, with its table."""

    tables = {r: turn_table(m) for r, m in moves.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, held, chars = 0, None, [], 0
        done: list[tuple] = []

        def close():
            nonlocal number, held, chars
            if held:
                table = one()
                for t in held:
                    table = after(table, tables[role_of(t["role"])])
                done.append((part, number, conv, held, [x for r in table[0] for x in r], [x for r in table[1] for x in r]))
                number, held, chars = number + 1, [], 0

        def flush():
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(_TURN), pa.list_(pa.int64()), pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], ["part", "no", "conv", "turns", "cost", "rank"])
            done.clear()
            return out

        for b in batches:
            for p, c, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and (c != conv or len(held) >= SEGMENT_TURNS or chars >= SEGMENT_CHARS):
                    close()
                part, conv = p, c
                held.append({"turn": turn, "role": role, "text": text})
                chars += len(text or "")
            if len(done) > 200:
                yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(frugal(run), "part int, no long, conv long, turns array<struct<turn:bigint,role:string,text:string>>, cost array<long>, rank array<long>")


def _table(cost: list[int], rank: list[int]) -> Table:
    return tuple([x[4 * k : 4 * k + 4] for k in range(4)] for x in (cost, rank))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs | None = None) -> DataFrame:
    """One row for each turn: ``conv_id``, ``turn``, ``role``, ``action``, ``new_role``, ``inserted``, ``cost``, ``last``, ``piece``.

    A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. Each turn is
    kept, merged into the one before, or given another role, and empty turns are inserted before it or at the end, at the
    least total cost; among equally cheap repairs the first turn at which they differ decides, for keep, then merge,
    then relabel, without insertions before with. ``inserted`` and ``cost`` of the last turn count what the end
    needs. The pieces of a conversation in order are its rendered form.

    Turns stand in the order of ``turn`` (null last), then role, then MD5 of the text (nulls first), so content settles ties. A null
    conversation id is a conversation of its own. A null or unknown role has to be given one; a null text is empty. Repeated turns
    are turns each; a very long text is one turn and has to fit a task's memory. Other columns, of any name, are not carried; an
    empty table gives an empty result.

    Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over partitions. Each
    partition turns its runs into 4 x 4 tables of costs, which compose; what crosses a partition's edge is at most two
    conversations a partition, and only their tables (32 numbers) reach the driver.
    """
    spark = turns.sparkSession
    costs = costs or Costs()
    moves, ending = costs.moves(), costs.ending()
    rows = turns.select(
        F.col(quoted(conv_col)).cast("long").alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"), F.col(quoted(role_col)).cast("string").alias("role"), F.col(quoted(text_col)).cast("string").alias("text")
    )
    # Equal turns may stand in any order, so where they came from deals them to several ranges.
    rows = rows.withColumn("origin", F.spark_partition_id())
    keys = (F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.md5("text"), F.col("origin"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    segments = cut(_segments(ordered.select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text"), moves), "segments")
    runs = segments.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("no", "cost", "rank"))).alias("tables"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for tables in b.column(2).to_pylist():
                total = one()
                for t in tables:
                    total = after(total, _table(t["cost"], t["rank"]))
                found.append(total)
            flat = [pa.array([[x for r in t[k] for x in r] for t in found], pa.list_(pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *flat], ["conv", "part", "cost", "rank"])

    edges = segments.groupBy("part").agg(F.min_by("conv", "no").alias("a"), F.max_by("conv", "no").alias("b"))
    near = edges.select(F.explode(F.array("a", "b")).alias("conv"), "part").distinct().groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")
    shared = runs.join(near.select(F.col("conv").alias("c")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    crossing: dict[int | None, list] = {}
    for r in shared.mapInArrow(multiply, "conv long, part int, cost array<long>, rank array<long>").collect():
        crossing.setdefault(r.conv, []).append((r.part, _table(r.cost, r.rank)))
    known: dict[tuple[int | None, int], tuple[int, list[int], bool]] = {}
    for conv, parts in crossing.items():
        parts.sort()
        to_go = [ending]
        for _, t in reversed(parts):
            to_go.append(before(t, to_go[-1]))
        state = START
        for k, (part, t) in enumerate(parts):
            known[conv, part] = (state, to_go[len(parts) - 1 - k], k == len(parts) - 1)
            state = best_exit(t, state, to_go[len(parts) - 1 - k])
    held = spark.sparkContext.broadcast(known)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, part, tables in zip(*(b.column(k).to_pylist() for k in range(3))):
                state, to_go, final = held.value.get((conv, part), (START, ending, True))
                tables = [(t["no"], _table(t["cost"], t["rank"])) for t in tables]
                left = [to_go]
                for _, t in reversed(tables):
                    left.append(before(t, left[-1]))
                for k, (no, t) in enumerate(tables):
                    at_end = left[len(tables) - 1 - k]
                    out.append((part, no, state, at_end, final and k == len(tables) - 1))
                    state = best_exit(t, state, at_end)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["part", "no", "state", "to_go", "final"])

    entries = runs.mapInArrow(enter, "part int, no long, state int, to_go array<long>, final boolean")
    placed = segments.join(entries, ["part", "no"]).select("conv", "turns", "state", "to_go", "final")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "action", "new_role", "inserted", "cost", "last", "piece"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
        for b in batches:
            for conv, said, state, to_go, final in zip(*(b.column(k).to_pylist() for k in range(5))):
                out = []
                choices = walk([role_of(t["role"]) for t in said], moves, state, to_go)
                for k, (t, c) in enumerate(zip(said, choices)):
                    last = final and k == len(said) - 1
                    more = len(_ENDING[c[1]]) if last else 0
                    out.append((conv, t["turn"], t["role"], c[2], ROLES[c[1]], len(c[3]) + more, c[0] + (ending[c[1]] if last else 0), last, piece(c, state, t["text"] or "", last)))
                    state = c[1]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return placed.mapInArrow(
        frugal(decide), "conv_id long, turn long, role string, action string, new_role string, inserted int, cost long, last boolean, piece string"
    )
