import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat
from threadloom.llm.chat import ASSISTANT, START, SYSTEM, USER, Costs, repair, role_of

COSTS = Costs()
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def every_repair(roles):
    """All repairs of a short conversation by enumeration: (cost, preference, choices)."""
    out = []
    options = [("keep", None), ("merge", None), *(("relabel", r) for r in (SYSTEM, USER, ASSISTANT))]
    inserts = [(), (USER,), (ASSISTANT,), (USER, ASSISTANT), (ASSISTANT, USER)]
    for plan in product(product(inserts, options), repeat=len(roles)):
        for tail in inserts:
            state, cost, chosen, prefer, fine = START, 0, [], [], True
            for role, (before, (action, target)) in zip(roles, plan):
                to = {"keep": role, "merge": state, "relabel": target}[action]
                if (action == "merge" and (before or state == START)) or (action == "keep" and role == 0) or (action == "relabel" and to == role):
                    fine = False
                    break
                for x in (*before, *([] if action == "merge" else [to])):
                    fine &= (state, x) in LEGAL
                    state = x
                if not fine:
                    break
                cost += len(before) * COSTS.insert + COSTS.merge * (action == "merge") + (0 if to == role else COSTS.name_unknown if role == 0 else COSTS.relabel)
                chosen.append((action, chat.ROLES[to], len(before)))
                prefer.append((bool(before), {"keep": 0, "merge": 1, "relabel": 2}[action], to))
            if not fine:
                continue
            for x in tail:
                fine &= (state, x) in LEGAL
                state = x
            if fine and state in ((ASSISTANT,) if roles else (START,)):
                out.append((cost + len(tail) * COSTS.insert, prefer, chosen, len(tail)))
    return min(out, key=lambda x: x[:2])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, action string, cost int")


def test_cheapest_repair_by_enumeration(spark):
    names = {0: "tool", SYSTEM: "System", USER: "human", ASSISTANT: "gpt"}
    every = [p for n in (1, 2) for p in product(range(4), repeat=n)] + random.Random(1).sample(list(product(range(4), repeat=3)), 12)
    rows = [(c, t, names[r], f"{c}.{t}") for c, p in enumerate(every) for t, r in enumerate(p)]
    got = {}
    for r in repair(frame(spark, rows)).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append(r)
    for c, p in enumerate(every):
        cost, _, chosen, tail = every_repair(p)
        found = got[c]
        assert sum(r.cost for r in found) == cost
        assert [(r.action, r.new_role, r.inserted - tail * r.last) for r in found] == chosen
        assert [r.last for r in found] == [False] * (len(p) - 1) + [True]


def rendered(df):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return {r.conv_id: "".join(x.piece for x in r.p) for r in df.groupBy("conv_id").agg(ordered.alias("p")).collect()}


def test_rendering(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "assistant", "yes"), (2, 5, "assistant", "hello"), (3, 0, "system", "be kind"), (None, 1, None, "?")]
    say = lambda *turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    assert rendered(repair(frame(spark, rows))) == {
        1: say(("user", "hi\n"), ("assistant", "yes")),
        2: say(("user", ""), ("assistant", "hello")),
        3: say(("system", "be kind"), ("user", ""), ("assistant", "")),
        None: say(("user", "?"), ("assistant", "")),
    }


@pytest.mark.parametrize("turns", [7, 512])
def test_long_conversations_over_segments_and_partitions(spark, monkeypatch, turns):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", turns)
    rng = random.Random(turns)
    rows = [(1, t, rng.choice(["user", "assistant", "system", None, "assistant"]), str(t)) for t in range(700)]
    rows += [(c, t, rng.choice(["user", "assistant"]), "") for c in range(2, 40) for t in range(rng.randrange(1, 9))] + [(None, t, "user", "") for t in range(30)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    moves, by, found = COSTS.moves(), {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for r in got:
        found.setdefault(r.conv_id, []).append(r)
    assert set(by) == set(found)
    for c, said in by.items():
        said.sort(key=lambda r: r[1])
        want = chat.walk([role_of(r[2]) for r in said], moves, START, COSTS.ending())
        have = sorted(found[c], key=lambda r: r.turn)
        assert [(r.action, r.new_role) for r in have] == [(w[2], chat.ROLES[w[1]]) for w in want]
        assert [r.last for r in have] == [False] * (len(have) - 1) + [True]


def test_ties_repeats_and_no_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "b"), (1, None, "assistant", "z")]
    got = repair(frame(spark, rows)).collect()
    assert sorted((str(r.turn), r.role, r.action, r.new_role, r.inserted) for r in got) == [
        ("0", "assistant", "keep", "assistant", 1), ("0", "user", "keep", "user", 0), ("0", "user", "merge", "user", 0), ("None", "assistant", "keep", "assistant", 0),
    ]
    assert repair(frame(spark, [])).count() == 0
