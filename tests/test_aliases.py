import random

from pricelens.operators.history import history_keys


def walk(key, edges):
    """(related key, rank) by plain walks."""
    out = {}
    for o, n, u in edges:
        if u and o != n:
            out.setdefault(o, set()).add(n)
    follow = {o: next(iter(n)) for o, n in out.items() if len(n) == 1}
    seen, at = {key}, key
    while at in follow and follow[at] not in seen:
        at = follow[at]
        seen.add(at)
    found, layer, rank = {at: 0}, [at], 0
    while layer:
        rank += 1
        layer = [o for o, n in follow.items() if n in layer and o not in found]
        found |= dict.fromkeys(layer, rank)
    return set(found.items())


def check(spark, edges, keys):
    e = spark.createDataFrame(edges, "old_match_key string, new_match_key string, is_unique_successor boolean")
    k = spark.createDataFrame([(x,) for x in keys], "match_key string")
    got: dict = {}
    for x in history_keys(k, e).collect():
        assert (x.related_key, x["rank"]) not in got.setdefault(x.match_key, set())
        got[x.match_key].add((x.related_key, x["rank"]))
    assert got == {x: walk(x, edges) for x in keys}


def test_long_chains_cycles_and_tails(spark):
    chain = [(f"c{i}", f"c{i + 1}", True) for i in range(20)]
    ring = [(f"r{i}", f"r{(i + 1) % 5}", True) for i in range(5)]
    tail = [("t0", "t1", True), ("t1", "t2", True), ("t2", "r3", True), ("s", "r3", True), ("c9b", "c9", True)]
    odd = [("x", "x", True), ("y", "z", False), ("m", "c1", True), ("m", "c2", True), ("p", "q", True), ("p", "q", True), ("q", "p", True)]
    keys = sorted({a for e in chain + ring + tail + odd for a in e[:2]} | {"nowhere"})
    check(spark, chain + ring + tail + odd, keys)


def test_random_graphs(spark):
    r = random.Random(3)
    edges = [(f"k{i}", f"k{r.randint(0, 39)}", r.random() < 0.9) for i in range(40) if r.random() < 0.9]
    check(spark, edges, [f"k{i}" for i in range(40)])
    check(spark, [], ["a"])
