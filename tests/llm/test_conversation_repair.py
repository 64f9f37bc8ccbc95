import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioscope.llm import conversation_repair, queries

TURNS = "conv_id long, turn long, role string, text string"
FULL = re.compile(r"[^\x20\x09-\x0D]")


def brute_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out += [(conv, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def brute_one(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = FULL.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]

    def solve():
        table = {(len(rows), g): (0, "", ()) if g in ("", "a") else (1 << 30, "", ()) for g in ("", "s", "u", "a")}
        for i in range(len(rows), -1, -1):
            for g in ("", "s", "u", "a"):
                if i < len(rows):
                    want = "a" if g == "u" else "u"
                    full = {"u": "user", "a": "assistant"}[want]
                    _, role, text = rows[i]
                    ways = [(table[i + 1, g][0] + 4, "D" + table[i + 1, g][1], table[i + 1, g][2])]
                    if faults[i] not in ("blank", "duplicate"):
                        worse = 3 if faults[i] == "truncated" else 0
                        if role[:1] == want or (role[:1] == "s" and g == ""):
                            c, a, t = table[i + 1, role[:1]]
                            ways.append((c + worse, "K" + a, (f"{role}:{text}", *t)))
                        c, a, t = table[i + 1, want]
                        ways.append((c + 3 + worse, "R" + a, (f"{full}:{text}", *t)))
                    table[i, g] = min(ways)
            for _ in range(4):
                for g in ("", "s", "u", "a"):
                    want = "a" if g == "u" else "u"
                    c, a, t = table[i, want]
                    table[i, g] = min(table[i, g], (c + 3, "I" + a, ({"u": "user:", "a": "assistant:"}[want], *t)))
        return table[0, ""]

    cost, audit, lines = solve()
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(rows, conversations):
    return sorted(((c, *brute_one([r[1:] for r in rows if r[0] == c])) for c in set(conversations)), key=str)


def some_turns(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "use"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "no", "", " \t", None, "Why?\n", "é!", "Yes.", f"line {rng.random()}.\n"])))
    return rows + [(None, 1, "user", "hm."), (None, None, "user", "hm."), (n, 0, "assistant", "long. " * 20000)] + rows[:3] * 2


def test_query_matches_brute_force(spark, tmp_path):
    rows = some_turns(150, 1)
    spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("clash") for n in ("conv", "idx", "size", "same", "_fate", "block")}).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(brute_damaged(rows), [r[0] for r in rows])


@pytest.mark.parametrize("block", [2, 7])
def test_conversations_of_many_blocks(spark, block):
    rows = some_turns(12, 3, longest=60) + [(77, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t}.") for t in range(300)]
    got = conversation_repair.repaired(spark.createDataFrame(rows, TURNS), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, [r[0] for r in rows])


def test_one_long_conversation_of_equal_rows(spark):
    rows = [(1, 5, "user", "Same.")] * 500
    got = conversation_repair.repaired(spark.createDataFrame(rows, TURNS), block=16).collect()
    assert [tuple(r) for r in got] == brute(rows, [1])


def test_few_states_are_made():
    automaton, rng = conversation_repair.Automaton(), random.Random(4)
    signs = "".join(conversation_repair.symbol(rng.randrange(4), rng.randrange(4)) for _ in range(50000))
    automaton.scanned(signs, automaton.end()[0])
    assert len(automaton.vectors) < 100


def test_empty(spark):
    assert conversation_repair.repaired(spark.createDataFrame([], TURNS)).count() == 0
    got = conversation_repair.repaired(spark.createDataFrame([], TURNS), spark.createDataFrame([(4, 1, "user", "x")], TURNS)).collect()
    assert [tuple(r) for r in got] == brute([], [4])
