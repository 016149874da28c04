"""Conversation repair against a search over all edits, whole and in pieces."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from driftmesh.llm import automaton, catalogue, conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
FORM = re.compile("(s?(ua)+)?")


def slow_damage(table):
    made = []
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        made += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return made


def faults(rows):
    seen, made = set(), []
    for _, role, text in rows:
        body = text.strip(BLANK)
        made.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return made


def slow_repair(rows):
    """Cheapest (cost, audit, lines) by trying every edit at every row."""
    bad = faults(rows)

    @cache
    def best(k, last, more):
        found = []
        if k == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        added = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[added]
        tries = [("I", 2, added, f"{name}:", 0)] if more else []
        if k < len(rows):
            _, role, text = rows[k]
            tries.append(("D", 3, last, None, 1))
            if bad[k] not in ("blank", "duplicate"):
                extra = bad[k] == "truncated"
                tries.append(("R", 2 + extra, added, f"{name}:{text}", 1))
                if role[:1] == added or (role[:1], last) == ("s", ""):
                    tries.append(("K", 0 + extra, role[:1], f"{role}:{text}", 1))
        for letter, cost, state, line, step in tries:
            rest = best(k + step, state, more - 1 if letter == "I" else 3)
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(found) if found else None

    return best(0, "", 3)


def slow_reports(table):
    kept = slow_damage(table)
    made = []
    for conv in {r[0] for r in table}:
        rows = sorted([r[1:] for r in kept if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in rows} - {None}
        bad = faults(rows)
        initials = [r[1][:1] for r in rows]
        cost, audit, lines = slow_repair(rows)
        assert FORM.fullmatch("".join(line[:1] for line in lines))
        made.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[bad.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(map(str, made))


def table(seed=2, conversations=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "Well", " \t", "", "é 😀.\n", "a\nb", None, "Go on. ", "x" * 500]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"]
    made = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, 9)):
            made.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles[: rng.choice([3, 5, 9])]), rng.choice(texts)))
    made += [(None, t, "user", "Yes.") for t in (None, 0, 0, 1, 2)] + [(777, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(150)]
    return made + [(9000 + c, 0, "user", "Same!") for c in range(40)]


@pytest.mark.parametrize("long_rows", [1 << 15, 3, 0])
def test_against_all_edits(spark, long_rows):
    rows = table()
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, audit string, piece int").repartition(3)
    got = conversations.repair(conversations.damage(given), long_rows).collect()
    assert sorted(str(tuple(r)) for r in got) == slow_reports(rows)
    assert any(r["audit"] == "" and r["cost"] == 0 for r in got) and {c for r in got for c in r["audit"]} == set("KRDI")


def test_repaired_rows_are_what_the_report_hashes(spark):
    given = conversations.damage(spark.createDataFrame(table(5, 20), SCHEMA))
    for long_rows in (1 << 15, 2):
        named = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair(given, long_rows).collect()}
        lines = {}
        for r in conversations.repaired_rows(given, long_rows).orderBy("place").collect():
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert named == {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in named}


def test_intact_rows_and_empty_table(spark):
    good = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello.")]
    got = conversations.repair(conversations.intact(spark.createDataFrame(good, SCHEMA))).first()
    assert (got["cost"], got["audit"], got["illegal"]) == (0, "KKK", 0)
    assert conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_every_short_sequence():
    """The least audit of every sequence of up to three symbols, by trying all edits."""
    kinds = [("user", "")] + [(role, text) for role in ("system", "user", "assistant", "tool") for text in ("Yes", "No.")]
    costs = automaton.Costs()
    for n in range(4):
        for chosen in itertools.product(kinds, repeat=n):
            rows = [(k, role, text + text[-1:] * k) for k, (role, text) in enumerate(chosen)]
            cost, path = costs.cheapest(conversations.judge(rows)[0])
            expected = slow_repair(rows)
            assert (cost, "".join(p for p, _ in path)) == expected[:2]
    assert len(costs.vectors) < 60 and len(costs.moves) < 400


def test_pieces_add_up():
    """Costs of a long sequence from the matrices of its parts."""
    rng = random.Random(8)
    rows = [rng.randrange(9) for _ in range(400)]
    after = list(automaton.END)
    for begin in range(390, -1, -10):
        part = automaton.span(rows[begin : begin + 10])
        after = [min(part[q][to] + after[to] for to in automaton.STATES) for q in automaton.STATES]
    assert after[automaton.START] == automaton.Costs().cheapest(rows)[0]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = catalogue.op12_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == slow_reports(rows)
