"""I-Match fingerprints: SQL, edits and likeness."""

import hashlib
import random
import sys

import pytest
from pyspark.sql import functions as F

from pricelens.llm import imatch as I

sys.path.append("/opt/oracle")


def prose(r, n, names=6000):
    return " ".join(f"w{int(r.random() ** 1.5 * names)}" for _ in range(n))


def texts_of(r):
    return [None, "", "...", "Ein Wort", "Ünïcode 𝒳 wörter \U0001f600 x", *(prose(r, r.choice([1, 3, 8, 60, 300])) for _ in range(60))]


def test_equals_sql(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    texts = texts_of(random.Random(1))
    texts += texts[20:24]
    d = docs(texts, ids=[3 * i - 20 for i in range(len(texts))])
    documents = d.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    got = I.compare(d.repartition(5))
    want = con.execute(I.SQL)
    assert got.columns == [x[0] for x in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_edits_copies_and_likeness(spark, docs):
    r = random.Random(2)
    texts = texts_of(r) + [prose(r, 400) for _ in range(40)]
    again = [5, 30, 64, 70, 80]
    every = texts + [texts[i] for i in again]
    got = {x.doc_id: x for x in I.compare(docs(every)).collect()}
    assert len(got) == len(every)
    for i, t in enumerate(every):
        t, follows = t or "", every[(i + 1) % len(every)] or ""
        n = len(t)
        edited = t[: n - n // 2] + follows[: n // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_edited == 1) == (got[i].fingerprint == got[i].edited_fingerprint)
    for k, i in enumerate(again):
        assert got[len(texts) + k].fingerprint == got[i].fingerprint
    assert got[1].fingerprint == got[0].fingerprint and got[0].near_next == 1.0 and got[1].near_next == 0.0
    long = [x for x in got.values() if x.n_chars > 1000]
    assert sum(x.near_edited > x.near_next for x in long) >= 0.9 * len(long)
    assert len({x.fingerprint for x in got.values()}) == len({t or "" for t in every})


def test_likeness_falls_with_the_edits(spark):
    r = random.Random(3)
    base = [prose(r, 300, 5000) for _ in range(30)]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        for share in (0, 5, 20, 50, 100):
            rows.append((i * 10 + [0, 5, 20, 50, 100].index(share), " ".join(x if r.randrange(100) >= share else f"w{r.randrange(5000)}" for x in w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    fps = I.signatures(d, I.lexicon(d), ["doc_id"])
    pairs = fps.alias("a").join(fps.alias("b"), F.expr("b.doc_id div 10 = a.doc_id div 10 and a.doc_id % 10 = 0"))
    mean = {x.k: x.m for x in pairs.groupBy(F.expr("b.doc_id % 10").alias("k")).agg(F.avg(I.likeness(F.col("a.fingerprint"), F.col("b.fingerprint"))).alias("m")).collect()}
    assert mean[0] == 1 and 1 > mean[1] > mean[2] > mean[3] > mean[4] and mean[1] > 0.7 and mean[4] < 0.2


def test_beyond_the_broadcast_and_odd_rows(spark, docs, monkeypatch):
    d = docs(texts_of(random.Random(4)))
    want = sorted(map(tuple, I.compare(d).collect()))
    monkeypatch.setattr(I, "BROADCAST", 0)
    assert sorted(map(tuple, I.compare(d).collect())) == want
    rows = [(None, "no id"), (None, "no id"), (None, "other"), (7, "same"), (7, "same"), (7, "another"), (9, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "id", "none", "n", "form", "first", "kept")})
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_chars, x.edited_sha256) for x in I.compare(odd).collect())
    assert [g[:3] for g in got] == [(False, 0, 5), (False, 0, 5), (False, 0, 5), (True, 7, 4), (True, 7, 4), (True, 7, 7), (True, 9, 0)]
    assert len({g[3] for g in got}) == 5
    assert I.compare(docs([])).count() == 0
    one = I.compare(docs(["alone here"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"alonealone").hexdigest() and one.near_next == 1.0


def test_plan_is_native(spark, docs):
    plan = I.compare(docs(["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
