"""The search against dynamic programming, the operator against SQL and against a plain loop."""

import hashlib
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from pricelens.llm import conversations as C

sys.path.append("/opt/oracle")
SCHEMA = "conv_id long, turn long, role string, text string"


def by_rows(code, start, ends, open_end):
    """(cost, audit) row after row."""

    def adding(cur):
        for _ in range(2):
            for q, (c, a) in list(cur.items()):
                p = C.NEXT[q][1]
                cur[p] = min(cur.get(p, (1 << 30, "")), (c + C.INSERT, a + "I"))
        return cur

    cur = {start: (0, "")}
    for ch in code:
        new = {}
        for q, (c, a) in adding(cur).items():
            ways = [(q, C.DELETE, "D")]
            if ch != "D":
                more = C.TRUNCATED if ch.isupper() else 0
                ways.append((C.NEXT[q][1], C.RENAME + more, "R"))
                if (q, ch.lower()) in C.STEP:
                    ways.append((C.STEP[q, ch.lower()], more, "K"))
            for p, w, e in ways:
                new[p] = min(new.get(p, (1 << 30, "")), (c + w, a + e))
        cur = new
    if open_end:
        cur = adding(cur)
    return min((cur[e] for e in ends if e in cur), default=None)


def test_search_equals_dynamic_programming():
    r = random.Random(0)
    for _ in range(3000):
        code = "".join(r.choice("suaxSUAXDuaua") for _ in range(r.randint(0, 14)))
        start, end = r.randrange(4), r.randrange(4)
        assert C.cheapest(code, start, C.ENDS, True) == by_rows(code, start, C.ENDS, True)
        assert C.cheapest(code, start, (end,), False) == by_rows(code, start, (end,), False)


def loop(rows):
    """The operator's result for rows of (conv_id, turn, role, text)."""
    out = {}
    sp = " \t\n\x0b\f\r"
    by: dict = {}
    for c, t, role, text in rows:
        text = " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = by.setdefault(c, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        role = "user" if kind == 4 else " " if role is None else role
        mine += [] if kind == 0 else [(t, role, text)] * (2 if kind == 3 else 1)
    for c, mine in by.items():
        key = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest())
        mine.sort(key=key)
        seen, code, count = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in mine:
            bare = text.strip(sp)
            fault = "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            code += "D" if fault in ("b", "d") else letter.upper() if fault == "t" else letter
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit = by_rows(code, 0, C.ENDS, True)
        rest, state, done = iter(mine), 0, []
        for e in audit:
            row = next(rest) if e != "I" else None
            if e in "IR":
                role, state = C.NEXT[state]
                done.append(f"{role}:{row[2] if row else ''}")
            elif e == "K":
                state = C.STEP[state, row[1][:1]]
                done.append(f"{row[1]}:{row[2]}")
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["b"], count["d"], count["t"],
            sum(x[1][:1] + y[1][:1] not in C.LEGAL for x, y in zip(mine, mine[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest(),
        )
    return out


def messy(r, n_conv, n_turn):
    rows = []
    texts = ["Yes.", "no", "", " \t", None, "Why?", "Fine!\n", "odd end. ", "\u0085", "x. y", "Ω."]
    for c in range(n_conv):
        for t in range(r.randint(1, n_turn)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ultra"])
            text = r.choice(texts) if r.random() < 0.5 else f"say {r.randint(0, 99)}."
            rows.append((c if r.random() < 0.97 else None, t if r.random() < 0.95 else None, role, text))
    return rows


@pytest.mark.parametrize("block", [512, 2, 3])
def test_summary_equals_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    r = random.Random(block)
    rows = messy(r, 40, 9) + [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(60)] + [(98, 5, "user", "Same.")] * 9 + messy(r, 3, 9)
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("n", "part", "place", "digest", "fault", "audit", "kind", "id", "none")})
    d = d.repartition(3)
    got = C.summary(d)
    assert got.dtypes == [("conv_id", "bigint"), *[(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string"), ("repaired_sha256", "string")]
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == loop(rows)


def test_repaired_rows_have_the_roles_asked_for(spark):
    import re

    rows = messy(random.Random(9), 60, 9)
    out: dict = {}
    for x in C.repair(C.damage(spark.createDataFrame(rows, SCHEMA))).collect():
        out.setdefault(x.conv_id, []).append((x.place, x.role))
    for found in out.values():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role in sorted(found)))


def test_dropped_rows_and_empty_tables(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = spark.createDataFrame([(c, 0, "user", "x.") for c in gone], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(x) for x in C.summary(rows).collect()} == {(c, 0, 0, 0, 0, 0, 0, "", empty) for c in gone}
    assert C.summary(rows.limit(0)).count() == 0


def test_summary_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [x for x in {(x[0], x[1]): x for x in messy(random.Random(4), 60, 9)}.values() if x[1] is not None]
    conversations = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations.astype({"conv_id": "Int64"}))
    want = {tuple(x) for x in con.execute(C.SQL).fetchall()}
    assert {tuple(x) for x in C.summary(spark.createDataFrame(rows, SCHEMA)).collect()} == want
