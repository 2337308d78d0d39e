import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import licenses as L
from pricelens.llm import token_files as K
from pricelens.llm import vectors as V
from pricelens.llm.common import connected_components


def test_license_scan_equals_brute_force(spark, docs):
    r = random.Random(1)
    noise = lambda n: " ".join(f"w{r.randint(0, 500)}" for _ in range(n))
    texts = [None, "", "a b", "Released under the MIT License.", "released under the GPL License", noise(300)]
    for name, t in L.TEMPLATES:
        texts.append(noise(r.randint(0, 200)) + " " + t.upper().replace(" ", "\n ") + " " + noise(r.randint(0, 200)))
        w = t.split()
        texts.append(noise(30) + " " + " ".join(w[: len(w) // 2]) + " " + noise(30))
    import re

    sh = lambda t: [tuple(x[i : i + 5]) for x in [[y for y in re.split(r"[\W_]+", (t or "").lower()) if y]] for i in range(len(x) - 4)]

    def brute(t):
        s, out = sh(t), set()
        for name, tpl in L.TEMPLATES:
            own = set(sh(tpl))
            w = 1 << (len(own) - 1).bit_length()
            if own and any(len(own & set(s[a : a + 2 * w])) >= L.CONTAINMENT * len(own) for a in range(0, max(1, len(s)), w)):
                out.add(name)
        return out

    got: dict = {}
    for x in L.scan(docs(texts)).collect():
        got.setdefault(x.doc_id, set()).add(x.license)
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t))}
    assert L.scan(docs([])).count() == 0


def test_program_notices_give_their_own_license(spark, docs):
    gnu = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} {4}"
    later, plain = "either version {} of the License, or (at your option) any later version.", "General Public License"
    heads = {
        "GPL-2.0": gnu.format("program", ";", plain, ";", later.format("2")),
        "GPL-3.0": gnu.format("program", ":", plain, ",", later.format("3")),
        "LGPL-2.1": gnu.format("library", ";", "Lesser " + plain, ";", later.format("2.1")),
        "LGPL-3.0": gnu.format("program", ":", "Lesser " + plain, ",", later.format("3")),
        "AGPL-3.0": gnu.format("program", ":", "Affero " + plain, ",", later.format("3")),
    }
    names = [*heads, "GPL-2.0"]
    only = gnu.format("program", ";", plain, ";", "version 2 of the License.")
    texts = [f"# some code\n# {t}\n# This is distributed in the hope that it will be useful" for t in [*heads.values(), only]]
    got: dict = {}
    for x in L.scan(docs(texts)).collect():
        got.setdefault(x.doc_id, {})[x.license] = x.containment
    for i, name in enumerate(names):
        assert got[i][name] == 1.0 and all(c < 1.0 for k, c in got[i].items() if k != name), (name, got[i])


def test_full_texts_of_licenses(spark, docs):
    import os

    folder = "/usr/share/common-licenses"
    full = {n: f for n, f in {"GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}.items() if os.path.exists(f"{folder}/{f}")}
    if not full:
        pytest.skip("no license texts")
    got = {(x.doc_id, x.license) for x in L.scan(docs([open(f"{folder}/{f}").read() for f in full.values()])).collect()}
    assert {(i, n) for i, n in enumerate(full)} <= got


def test_license_plan_is_native(spark, docs):
    plan = L.scan(docs(["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


RANKS = {bytes([i]): i for i in range(256)}


def test_token_files_that_differ_from_the_table_are_an_error(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string")
    rows.repartition(2).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(K, "write", lambda docs, ranks, path, write=K.write: write(docs.where("doc_id <> 7"), ranks, path))
    with pytest.raises(Exception, match="token files and table differ"):
        K.count(d, RANKS).collect()


def test_files_of_a_task_are_taken_in_order(spark):
    rows = [(0, f"part-00000-u-c{k:03d}.txt", 0, 2, [k % 2]) for k in range(1100)]
    found = spark.createDataFrame(rows, "part long, file string, block long, n_tokens long, ends array<int>")
    got = {x.place: x.n_tokens for x in K.document_lengths(found).collect()}
    assert got == {k: 0 if k == 0 else 2 if k % 2 else 0 for k in range(1100)}


def test_token_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "ROW", 50)
    monkeypatch.setattr(K, "BLOCK", 7)
    monkeypatch.setattr(K, "ROWS_PER_FILE", 2)
    r = random.Random(2)
    texts = [None, "", "a", "é" * 40, "", "x y\n" * 30, *("z" * r.randint(0, 30) for _ in range(60)), "q" * 500]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(3).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    got = {x.doc_id: x.n_tokens for x in K.count(d, RANKS).collect()}
    assert got == {i: len((t or "").encode()) for i, t, _ in rows}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    assert K.count(spark.read.parquet(str(tmp_path / "e")), RANKS).count() == 0


def brute_links(x, threshold=0.9):
    """(links, component) of each row, ids being places; links counts the rows of equal length with a cosine of threshold or more."""
    ok = [i for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    u = {i: (w := np.array(x[i], float) / np.abs(x[i]).max()) / np.linalg.norm(w) for i in ok}
    near = {i: {j for j in ok if j != i and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold} for i in ok}
    lab = {i: i for i in range(len(x))}
    for _ in range(len(x)):
        old = dict(lab)
        for i in ok:
            lab[i] = min([lab[i], *(lab[j] for j in near[i])])
        if old == lab:
            break
    return {i: (len(near.get(i, ())), lab[i]) for i in range(len(x))}


def links_of(df):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.link(df).collect()}
    assert all(k == (i == c) for i, (_, c, k) in got.items())
    return {i: (n, c) for i, (n, c, _) in got.items()}


def table_of(spark, x):
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    return rows.withColumns({"v": F.lit("clash"), "n": F.lit(1), "id": F.lit(2), "node": F.lit(3), "r": F.lit(4), "w": F.lit(5)})


@pytest.mark.parametrize("depth", [5, 10, 14, 18, 24])
def test_recall_of_the_trees_at_the_threshold(depth):
    rng = np.random.default_rng(depth)
    t = V.Trees(64, depth, 0.9)
    a = V._unit(rng.standard_normal((4000, 64)))
    b = rng.standard_normal((4000, 64))
    b = 0.9 * a + np.sqrt(1 - 0.81) * V._unit(b - np.einsum("nd,nd->n", a, b)[:, None] * a)
    met = np.zeros(4000, bool)
    for tree in range(t.n):
        x, y = t.codes(a, tree), t.codes(b, tree)
        met |= V.meets(x, y) | V.meets(y, x)
    assert met.mean() >= 0.98
    enough = (np.abs(a @ t.lines - b @ t.lines) <= V.WIDTH).sum(1) >= V.calibrated(np.sqrt(0.2))
    assert (met & enough).mean() >= 0.95


def test_blocks_of_a_tile(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((30, 16)), 8, 0) + 0.1 * rng.standard_normal((240, 16))
    side = V.Side([(i, 1, 0.0, v.tobytes()) for i, v in enumerate(x)], False)
    pairs = lambda: {(int(a), int(b)) for i, j in V._single_pairs(V.Trees(16, 0, 0.9), 0, side, side, 0.9) for a, b in zip(i, j, strict=True)}
    whole = pairs()
    monkeypatch.setattr(V, "BLOCK", 17)
    monkeypatch.setattr(V, "PAIRS", 5)
    assert pairs() == whole and len(whole) > 400 and all(a < b for a, b in whole)


def test_vector_links_in_deep_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    x = [list(map(float, b + 0.12 * rng.standard_normal(8))) for b in base for _ in range(12)]
    monkeypatch.setattr(V, "CELL", 12)
    monkeypatch.setattr(V, "TILE", 32)
    want, got = brute_links(x), links_of(table_of(spark, x))
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.98 * total and total > 2000


def test_vectors_of_any_kind(spark):
    rng = np.random.default_rng(4)
    x = [list(map(float, v)) for v in rng.standard_normal((30, 8))]
    x += [x[0], x[0], [2 * c for c in x[0]], None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [1e300] * 8, [1e-300] * 8]
    x += [[1.0, 2.0], [1.0, 2.01], [1.0], [3.0], [-3.0]]
    assert links_of(table_of(spark, x)) == brute_links(x)


@pytest.mark.parametrize("tile", [16, 4096])
def test_crowds_of_near_copies(spark, monkeypatch, tile):
    """Balls that touch wholly, in part and not at all, gathered in two rounds, beside single vectors."""
    rng = np.random.default_rng(5)
    crowd = lambda b, n, s: [list(map(float, b + s * rng.standard_normal(16))) for _ in range(n)]
    base = rng.standard_normal((5, 16))
    x = crowd(base[0], 150, 0.02) + crowd(base[0] + 0.5 * base[1], 90, 0.05) + crowd(base[1], 80, 0.1) + crowd(base[2], 60, 0.3) + crowd(base[3], 20, 0.01) + crowd(base[4], 1, 0)
    x += [x[0], x[0], x[160], *crowd(base[0], 30, 0.15)]
    order = rng.permutation(len(x))
    x = [x[k] for k in order]
    monkeypatch.setattr(V, "TILE", tile)
    monkeypatch.setattr(V, "BALL", 6)
    want = brute_links(x)
    assert links_of(table_of(spark, x)) == want and sum(n for n, _ in want.values()) > 20000


def test_repeated_vec_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (3, [0.0, 2.0]), (9, [1.0, 0.01]), (None, [1.0, 0.0])]
    got = V.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 1, 5, True), (5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (9, 1, 5, False), (None, 0, None, True)], key=str)


def test_vectors_empty(spark):
    assert V.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = V.link(spark.createDataFrame([(7, None), (8, [1.0])], "vec_id long, embedding array<float>"))
    assert sorted(tuple(r) for r in one.collect()) == [(7, 0, 7, True), (8, 0, 8, True)]


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(r.randint(0, 99), r.randint(0, 99)) for _ in range(60)] + [(7, 7), (None, 3)]
    lab = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(100):
        for a, b in edges:
            if a in lab and b in lab:
                lab[a] = lab[b] = min(lab[a], lab[b])
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == lab
