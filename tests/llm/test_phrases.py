"""Collocations against counting everything."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricelens.llm import phrases as P


def brute(rows):
    """rows: (lang, text). Rows (lang, rank, phrase, a, l, r, n, score)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang, c = lang or "und", f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= P.LEAST}
        found = []
        for p, a in cand.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(100 * b >= P.SHARE * a for q, b in cand.items() if inside(q)):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[: P.RANKS], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("cut_after", [4096, 3, 1])
def test_collocations_equal_brute_force(spark, docs, monkeypatch, cut_after):
    monkeypatch.setattr(P, "LONGEST_CHUNK", cut_after)
    monkeypatch.setattr(P, "HELD", 50)
    monkeypatch.setattr(P, "LEAST", 4)
    monkeypatch.setattr(P, "RANKS", 60)
    r = random.Random(cut_after)
    words = ["the", "of", "New", "york", "a", "É", "é", "w w", "x'y", "-", "zz", "in", "to"]
    texts = [None, "", " \t", "...", "\n\r\x0b\x0c"] + ["".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += ["new york city hall"] * 8 + ["new york city hall " * 40] + ["a " * 300]
    langs = {i: r.choice(["en", "de", None]) for i in range(len(texts))}
    got = sorted(tuple(x) for x in P.collocations(docs(texts, langs=langs)).collect())
    assert got == brute([(langs[i], t) for i, t in enumerate(texts)]) and len(got) > 60


def test_chunks_hold_every_phrase_once():
    r = random.Random(3)
    for _ in range(200):
        words = [str(r.randint(0, 30)).encode() for _ in range(r.randint(1, 80))]
        found = []
        for part, own in P.chunks(words, P._Triggers()):
            found += [tuple(part[i : i + k]) for i in range(own) for k in range(1, 5) if i + k <= len(part)]
        assert sorted(found) == sorted(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_007
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 4), ("en", "a b", big - 9), ("en", "b a", 77)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 5)], "lang string, n long")
    got = {x.phrase: (x.score, x.l, x.r) for x in P.rank(counts, totals).collect()}
    both = big + big - 4
    assert got == {"a b": (2000000 * (big - 9) // both, big, big - 4), "b a": (2000000 * 77 // both, big - 4, big)}


def test_ties_repeats_and_empty_tables(spark, docs):
    got = [(x.rank, x.phrase) for x in P.collocations(docs(["b c. a d. Ä ö"] * 30)).orderBy("rank").collect()]
    assert got == [(1, "a d"), (2, "b c"), (3, "Ä ö")]
    assert P.collocations(docs([])).count() == 0
    assert P.collocations(docs(["x y"]).withColumn("text", F.lit(None).cast("string"))).count() == 0
