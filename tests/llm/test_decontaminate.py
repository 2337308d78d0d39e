import random
from itertools import combinations

from pyspark.sql import functions as F

from pricelens.llm import decontaminate as M


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def words(r, n):
    return [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randint(0, 40)}" for _ in range(n)]


def brute(texts, items):
    """Pairs with a stretch of aligned words that agree in the needed share, over all alignments."""
    out = set()
    norm = lambda t: "".join(f" {c} " if "\u4e00" <= c <= "\u9fff" else c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    for d, t in enumerate(texts):
        for i, b in enumerate(items):
            w, x = norm(b), norm(t)
            n = min(M.STRETCH, len(w))
            if w and any(sum(x[p + k] == w[q + k] for k in range(n)) >= M.SIMILARITY * n for p in range(len(x) - n + 1) for q in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_exact_and_substituted_passages(spark, docs):
    r = random.Random(4)
    items = [" ".join(words(r, n)) for n in (5, 9, 15, 30, 60)] + ["too short here", None, ""]
    texts = [None, "", " ".join(words(r, 300))]
    for k in range(5):
        w = items[k].split()
        texts.append(" ".join(words(r, 40) + w + words(r, 40)))
        texts.append((" ".join(words(r, 10)) + " " + ", ".join(w) + "!").upper())
        if k > 2:
            for at in range(3, len(w), 8):
                w[at] = "changed"
            texts.append(" ".join(words(r, 20) + w + words(r, 20)))
    got = {(x.doc_id, x.item_id) for x in M.overlaps(docs(texts), bench(spark, items)).collect()}
    assert got == brute(texts, items) and len(got) == 12


def test_parts_give_the_same(spark, docs, monkeypatch):
    r = random.Random(5)
    items = [" ".join(words(r, 20)) for _ in range(12)]
    texts = [" ".join(words(r, 30) + i.split()) for i in items]
    whole = {(x.doc_id, x.item_id) for x in M.overlaps(docs(texts), bench(spark, items)).collect()}
    monkeypatch.setattr(M, "PART_WORDS", 100)
    assert whole == {(x.doc_id, x.item_id) for x in M.overlaps(docs(texts), bench(spark, items)).collect()} == {(k, k) for k in range(12)}


def test_removal_keeps_clean_rows_and_columns(spark, docs):
    r = random.Random(6)
    item = " ".join(words(r, 25))
    d = docs([item, " ".join(words(r, 25)), None])
    kept = M.remove_overlapping(d, bench(spark, [item]))
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2]
    assert M.remove_overlapping(d, bench(spark, []).limit(0)).count() == 3


def replaced(r, item, at):
    w = item.split()
    for k in at:
        w[k] = f"changed{k}"
    return " ".join(words(r, 15) + w + words(r, 15))


def test_every_placement_of_the_allowed_substitutions(spark, docs):
    r = random.Random(7)
    items, texts, want = [], [], set()
    for i, n in enumerate(range(1, M.STRETCH + 1)):
        items.append(" ".join(f"own{i}w{k}" for k in range(n)))
        allowed = max(k for k in range(n + 1) if n - k >= M.SIMILARITY * n)
        for k in range(allowed + 2):  # one more than the rule allows, too
            for at in combinations(range(n), k):
                want |= {(len(texts), i)} if k <= allowed else set()
                texts.append(replaced(r, items[i], at))
    got = {(x.doc_id, x.item_id) for x in M.overlaps(docs(texts), bench(spark, items)).collect()}
    assert got == want


def test_substitutions_at_every_period_and_random_places(spark, docs):
    r = random.Random(8)
    items = [" ".join(words(r, n)) for n in (15, 30, 60, 200)]
    texts = [replaced(r, i, range(at, len(i.split()), period)) for i in items for period in range(2, 15) for at in range(period)]
    for i in items:
        n = len(i.split())
        texts += [replaced(r, i, r.sample(range(n), int(n * share))) for share in (0.15, 0.2, 0.3, 0.4) for _ in range(6)]
    got = {(x.doc_id, x.item_id) for x in M.overlaps(docs(texts), bench(spark, items)).collect()}
    assert got == brute(texts, items) and len(got) > 200


def test_scripts_without_spaces_and_short_items(spark, docs):
    r = random.Random(9)
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x4E80)) for _ in range(n))
    items = [han(180), han(12), "two words", "一", "Ünïcode wörds, ganz ohne Eile und mit Weile"]
    at = list(items[0])
    at[7] = at[99] = "好"
    texts = [han(40) + items[0] + han(40), "".join(at), items[1][:6] + "x" + items[1][7:], "then two  words here", "two other words", han(50) + "一", items[4].upper()]
    got = {(x.doc_id, x.item_id) for x in M.overlaps(docs(texts), bench(spark, items)).collect()}
    assert got == brute(texts, items) and {(0, 0), (1, 0), (3, 2), (5, 3), (6, 4)} <= got and (4, 2) not in got
    kept = {x.doc_id for x in M.remove_overlapping(docs(texts), bench(spark, items)).collect()}
    assert {3, 4} <= kept and kept.isdisjoint({0, 1, 6})


def test_seeds_that_are_frequent_on_both_sides(spark, docs, monkeypatch):
    items, texts = ["a " * 60, "a b " * 30], ["a " * 3000, "b a " * 500, "c " * 40 + "a " * 12]
    got = {x.doc_id * 10 + x.item_id: (x.start_word, x.n_words, x.n_same) for x in M.overlaps(docs(texts), bench(spark, items)).collect()}
    assert {(k // 10, k % 10) for k in got} == brute(texts, items) and got[0] == (0, 60, 60)
    index, words_of = M.Index(list(enumerate(items))), M._Words()
    whole = [sorted(index.search(M._hashes(t, words_of))) for t in texts]
    monkeypatch.setattr(M, "HITS", 500)
    assert whole == [sorted(index.search(M._hashes(t, words_of))) for t in texts]


def test_ties_repeats_and_rows_without_ids(spark, docs):
    r = random.Random(10)
    item = " ".join(words(r, 20))
    d = docs([f"{item} . x . {item}", f"{item} . x . {item}", "x"], ids=[4, 4, 5]).unionByName(docs([item], ids=[6]).withColumn("doc_id", F.lit(None).cast("long")))
    b = bench(spark, [item, item, None])
    got = sorted((str(x.doc_id), x.item_id, x.start_word, x.n_words) for x in M.overlaps(d, b).collect())
    assert got == sorted([("4", i, 0, 20) for i in (0, 1) for _ in range(2)] + [("None", i, 0, 20) for i in (0, 1)])
    assert [x.doc_id for x in M.remove_overlapping(d, b).collect()] == [5]
