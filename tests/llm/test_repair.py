"""Repair of conversations against an exhaustive search, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from tracemill.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, POSITION int"


def search(rows):
    """(cost, audit, turns) of the best of all edit sequences; rows: (initial, fault) in order."""

    @cache
    def best(i, state):
        """Cheapest (cost, audit) of rows from i on after output state '', 's', 'u' or 'a' (with 'e' for the end of nothing)."""
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        follows = {"": "sua", "s": "u", "u": "a", "a": "u"}[state]
        for new in follows:
            if i < len(rows):
                initial, fault = rows[i]
                if fault not in ("blank", "duplicate"):
                    extra = 3 * (fault == "truncated")
                    if initial == new and (new != "a" or state == "u"):
                        found.append(join(extra, "K", best(i + 1, new)))
                    if new in "ua" and (new != "a" or state == "u"):
                        found.append(join(3 + extra, "R", best(i + 1, new)))
        if i < len(rows):
            found.append(join(4, "D", best(i + 1, state)))
        return min(found + inserted(i, state), default=(10**9, ""))

    def join(cost, edit, rest):
        return cost + rest[0], edit + rest[1]

    def inserted(i, state):
        new = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        out, got = [], ""
        for n in (1, 2, 3):  # more never pays
            got += new
            out.append((n, got[-1]))
            new = "a" if new == "u" else "u"
        return [join(3 * n, "I" * n, step(i, s)) for n, s in out]

    @cache
    def step(i, state):
        """As best, but the next edit is no insertion."""
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            initial, fault = rows[i]
            found.append(join(4, "D", best(i + 1, state)))
            if fault not in ("blank", "duplicate"):
                for new in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    extra = 3 * (fault == "truncated")
                    if initial == new:
                        found.append(join(extra, "K", best(i + 1, new)))
                    if new in "ua":
                        found.append(join(3 + extra, "R", best(i + 1, new)))
        return min(found, default=(10**9, ""))

    return best(0, "")


def damaged(table):
    rows = []
    for conv, turn, role, text, *_ in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return rows


def brute(rows, ids):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv in ids:
        turns = sorted(talks[conv])
        faults, seen = [], set()
        for *_, role, _, text in turns:
            rest = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for known, t, *_ in turns if known}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:])]
        cost, audit = search(tuple((t[2][:1], f) for t, f in zip(turns, faults)))
        lines, todo = [], iter(turns)
        for e in audit:
            if e == "I":
                lines.append((None, ""))
            else:
                t = next(todo)
                if e != "D":
                    lines.append((t[2] if e == "K" else None, t[4]))
        names = ["system"] * (len(lines) % 2) + ["user", "assistant"] * (len(lines) // 2)
        text = "\n".join(f"{n if r is None else r}:{t}" for (r, t), n in zip(lines, names))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_program_finds_what_a_search_finds():
    pick = random.Random(5)
    for _ in range(1500):
        rows = [(pick.choice("ssuuuaaaxS") if pick.random() < 0.97 else "", pick.choice(["", "", "", "truncated", "truncated", "blank", "duplicate"])) for _ in range(pick.randint(0, 9))]
        own = repair.Repairer()
        for initial, fault in rows:
            own.feed(initial, fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit = own.finish()
        assert (cost, audit) == search(tuple(rows)), rows
        mender = repair.Mender(audit)
        roles = [role for initial, _ in rows for _, role, _ in mender.feed(initial, "t")]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles))


def test_long_conversations_take_linear_time():
    own = repair.Repairer()
    for i in range(100_000):
        own.feed("u", i % 7 == 0, i % 3 == 0)
    cost, audit = own.finish()
    assert len(audit) - audit.count("I") == 100_000 and cost > 0


def table(seed):
    pick = random.Random(seed)
    texts = ["Yes.", "No?", "Why!", "cut", "cut. ", " ", "", "\x85", "a. b", None, "Yes.", "x" * 30_000 + "."]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(pick.randint(1, 9)):
            rows.append((conv, None if pick.random() < 0.05 else turn * pick.choice([1, 1, 1, 2]), pick.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), pick.choice(texts), "x", 1))
    rows += rows[:9]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_search(spark, tmp_path, seed):
    from tracemill.llm import queries

    rows = table(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    out = queries.op11_repair(spark, f"file://{tmp_path}")
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    want = brute(damaged(rows), {r[0] for r in rows})
    assert got == want and any(w[0] for w in want.values())


def test_repaired_turns_and_conversations_without_turns(spark):
    rows = [(1, 0, "user", "Hi.", "x", 1), (1, 1, "user", "Again?", "x", 1), (2, 5, "system", " ", "x", 1), (None, None, "assistant", "So.", "x", 1)]
    turns = spark.createDataFrame(rows, SCHEMA)
    ids = turns.select("conv_id").unionByName(spark.createDataFrame([(9,)], "conv_id long"))
    repairs, left = repair.repair_conversations(turns, ids)
    found = {r["conv_id"]: (r["cost"], r["audit"]) for r in repairs.collect()}
    assert found == {1: (3, "KR"), 2: (4, "D"), None: (3, "IK"), 9: (0, "")}
    got = sorted((tuple(r) for r in left.collect()), key=str)
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Again?"), (None, 0, "I", "user", ""), (None, 1, "K", "assistant", "So.")]
    assert [r["audit"] for r in repairs.where("conv_id = 9").collect()] == [""]


def test_extreme_turn_numbers(spark):
    rows = [(1, -(1 << 63), "user", "A.", "x", 1), (1, (1 << 63) - 1, "assistant", "B.", "x", 1)]
    row = repair.find_repairs(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row["gaps"], row["audit"]) == ((1 << 63) - 1, "KK")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    repairs, left = repair.repair_conversations(repair.damage(empty), empty.select("conv_id"))
    assert repairs.count() == left.count() == repair.turns_sha256(left).count() == 0
