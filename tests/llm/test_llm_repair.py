"""Conversation repair against brute force: every edit sequence, long conversations in blocks, odd rows."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from cosecha.llm import repair
from cosecha.llm.common import table

CONV = "conv_id long, turn long, role string, text string, at long, rows string, cost int, piece string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.strip("\x20\t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen
                   else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """The least (cost, audit) over all edit sequences, by the rest that follows each row and written role."""

    @functools.lru_cache(None)
    def rest(i, last, inserts):
        found = []

        def go(to, cost, letter, j, ins):
            if to in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
                more = rest(j, to, ins)
                if more:
                    found.append((cost + more[0], letter + more[1]))

        if i == len(rows):
            if last in ("", "a"):
                found.append((0, ""))
        else:
            more = rest(i + 1, last, 0)
            if more:
                found.append((4 + more[0], "D" + more[1]))
            if marks[i] not in ("blank", "duplicate"):
                extra = 3 if marks[i] == "truncated" else 0
                if rows[i][2][:1] in ("s", "u", "a"):
                    go(rows[i][2][:1], extra, "K", i + 1, 0)
                go("u", 3 + extra, "R", i + 1, 0)
                go("a", 3 + extra, "R", i + 1, 0)
        if inserts < 3:
            go("u", 3, "I", i, inserts + 1)
            go("a", 3, "I", i, inserts + 1)
        return min(found, default=None)

    return rest(0, "", 0)


def repaired(rows, audit):
    out, source = [], iter(rows)
    for step in audit:
        row = ("", "", "", "") if step == "I" else next(source)
        if step != "D":
            out.append((step, row[2], row[3], row[1] if step != "I" else None))
    system = len(out) % 2
    return [(row[3], row[1] if row[0] == "K" else "user" if (k - system) % 2 == 0 else "assistant", row[2])
            for k, row in enumerate(out)]


def truth(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows) of undamaged input rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = ordered([r for r in rows if r[0] == conv])
        marks = faults(mine)
        cost, audit = cheapest(mine, marks)
        turns = [r[1] for r in mine if r[1] is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *[marks.count(k) for k in ("blank", "duplicate", "truncated")],
                     sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(mine, mine[1:])),
                     cost, audit, repaired(mine, audit))
    return out


def digests(rows):
    found = truth(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", [])
    return sorted(((conv, *(x := found.get(conv, empty))[:7],
                    hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in x[7]).encode()).hexdigest())
                   for conv in {r[0] for r in rows}), key=str)


def conversations(n, seed, longest=7):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(0, longest)):
            turn += rng.choice([0, 1, 1, 1, 2])
            text = rng.choice([None, "", " \n", "Yes.", "no", "Ha! well", "So?\n\t", "Señor.", "x. y"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(
                ["user", "user", "assistant", "assistant", "system", None, "", "tool"]), text))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "r", 2, "p") for r in rows], CONV).repartition(parts)


def test_lightest_derivation_of_every_small_conversation():
    """All role sequences of up to four rows with some faults: the agenda finds the least (cost, audit)."""
    texts = {repair.FINE: "", repair.BLANK: "blank", repair.TRUNCATED: "truncated"}
    for n in range(5):
        for roles in itertools.product("sua", repeat=n):
            for marks in itertools.product(texts, repeat=n) if n < 3 else [(0,) * n, (1, 0, 0, 3)[:n], (0, 3, 1, 0)[:n]]:
                ways = repair.transfers(list(zip(roles, marks)), [repair.NOTHING])
                got = min((c, a) for _, x, c, a in ways if x in (repair.NOTHING, repair.ASSISTANT))
                assert got == cheapest([(0, 0, r, "") for r in roles], [texts[m] for m in marks])


def test_blocks_joined_equal_the_whole():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randint(1, 9))]
        whole = {(x, c, a) for _, x, c, a in repair.transfers(rows, [repair.NOTHING])}
        cut = rng.randint(0, len(rows))
        reached = {repair.NOTHING: (0, "")}
        for part in (rows[:cut], rows[cut:]):
            reached = repair._onward(reached, repair.transfers(part, range(4)))
        assert {(x, *w) for x, w in reached.items()} == whole
        cost, audit = min(reached[x] for x in (repair.NOTHING, repair.ASSISTANT) if x in reached)
        assert "".join(p for p, _ in repair._dealt(audit, [cut, len(rows) - cut])) == audit


def test_report_equals_brute_force(spark):
    rows = conversations(150, 8)
    rows += [(None, 1, "user", "Nobody's."), (None, None, "assistant", None), (7, 3, "user", "Yes."), (7, 3, "user", "Yes.")]
    got = sorted(map(tuple, repair.report(frame(spark, rows)).collect()), key=str)
    assert got == digests(rows)


def test_rows_and_summary_equal_brute_force(spark):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations(60, 9)]
    summary, out = repair.repair(frame(spark, rows))
    expected = truth(rows)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.conv_id, r.seq)):
        assert r.seq == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append((r.turn, r.role, r.text))
    assert got == {c: x[7] for c, x in expected.items() if x[7]}
    assert {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in summary.collect()} == {
        c: x[1:7] for c, x in expected.items()}


@pytest.mark.parametrize("block_bytes", [1, repair.BLOCK_BYTES])
def test_one_conversation_of_most_rows_goes_in_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 5)
    monkeypatch.setattr(repair, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"Turn {t}.", "cut", ""]))
            for t in range(300)] + conversations(12, 10)
    rows = [r for r in rows if r[0] != 1 or r[1] is not None]
    df = frame(spark, rows, 6)
    assert repair.blocks(df).where("conv_id = 1").select(repair.F.spark_partition_id()).count() > 50
    got = sorted(map(tuple, repair.report(df).collect()), key=str)
    assert got == digests(rows)


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], CONV)
    assert repair.report(none).count() == 0
    summary, rows = repair.repair(none)
    assert summary.count() == rows.count() == 0
    rows = [(1, 1, "user", "long " * 400_000 + "."), (1, 2, "assistant", "." * 100_000 + " " * 100_000)]
    assert sorted(map(tuple, repair.report(frame(spark, rows)).collect()), key=str) == digests(rows)


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.report(df).collect()), key=str) == digests(rows)
