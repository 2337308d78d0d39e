import hashlib
import random

import numpy as np
import pytest

from pricelens.llm import repeats as M


def brute(rows):
    """By row, in the order of rows: what starts at a smaller (doc_id, place) elsewhere goes."""
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - M.LENGTH + 1):
            w = raw[i : i + M.LENGTH]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - M.LENGTH + 1):
            if first[raw[i : i + M.LENGTH]] < (d, i):
                mark[i : i + M.LENGTH] = b"\1" * M.LENGTH
        kept = bytes(b for b, k in zip(raw, mark, strict=True) if not k)
        spans = sum(1 for i, k in enumerate(mark) if k and (i == 0 or not mark[i - 1]))
        out.append((d, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(r.randint(10, 60)) for _ in range(5)]
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 350, "ab" * 300, "ab" * 300]
    for _ in range(n):
        parts = [text(r.randint(0, 40)) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, 3), r.choice(shared)[r.randint(0, 30) :])
        out.append(" ".join(parts))
    return out + out[10:14]


def result(df):
    return sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    texts = corpus(seed)
    want = brute(list(enumerate(texts)))
    assert sum(x[2] for x in want) > 1000
    assert result(M.dedup(docs(texts))) == sorted(want)


def test_frequent_anchors_and_small_pieces(docs, monkeypatch):
    """The window route, buckets over the bound, and texts read in many pieces give the same."""
    monkeypatch.setattr(M, "BUCKET", 2)
    monkeypatch.setattr(M, "LOCAL", 1)
    monkeypatch.setattr(M, "HELD", 200)
    monkeypatch.setattr(M, "BLOCK", 2000)
    monkeypatch.setattr(M, "PIECE", 300)
    M._powers.clear()
    texts = corpus(7)
    assert result(M.dedup(docs(texts))) == sorted(brute(list(enumerate(texts))))
    M._powers.clear()


def test_repeated_rows_no_ids_and_empty_table(docs):
    assert M.dedup(docs([])).count() == 0
    t = "".join(random.Random(1).choices("abcdef ", k=300))
    got = [(x.doc_id, x.n_removed) for x in M.dedup(docs([t, t, t, t], ids=[5, 5, 9, None])).collect()]
    assert sorted(got, key=str) == sorted([(5, 0), (5, 0), (9, 300), (None, 0)], key=str)


@pytest.mark.parametrize("bucket", [2, 4096])
def test_rows_that_repeat_an_id_with_other_texts(docs, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    monkeypatch.setattr(M, "LOCAL", 1)
    r = random.Random(3)
    one, other = ("".join(r.choices("abcdef ", k=400)) for _ in range(2))
    got = [(x.doc_id, x.n_bytes, x.n_removed) for x in M.dedup(docs([one, other, one[:200]], ids=[1, 5, 5])).collect()]
    assert sorted(got) == [(1, 400, 0), (5, 200, 200), (5, 400, 0)]
    texts = [t for t in corpus(11, 30) if t]
    ids = [r.randint(0, 12) for _ in texts]
    assert result(M.dedup(docs(texts, ids=ids))) == sorted(brute(list(zip(ids, texts, strict=True))))


def test_frequent_anchors_are_counted_over_all_documents(docs, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 20)
    r = random.Random(4)
    line = "".join(r.choices("abcdef ", k=120))
    texts = ["".join(r.choices("ghijkl ", k=300)) for _ in range(300)]
    texts = [t + line if k % 6 == 0 else t for k, t in enumerate(texts)]
    monkeypatch.setattr(M, "LOCAL", 1)
    many = {x.g for x in M.frequent_anchors(docs(texts)).collect()}
    assert many & {int(x) for x in M._i64(M.contexts(line.encode())[0])} and len(many) < 10


def test_kept_text_and_carried_columns(docs):
    t = "".join(random.Random(2).choices("abcdef", k=200))
    d = M.dedup(docs([t + " first", "second " + t]), ["lang", "n"])
    assert {x.doc_id: (x.kept, x.lang, x.n) for x in d.collect()} == {0: (t + " first", "en", "clash"), 1: ("second ", "en", "clash")}


def test_cover_takes_any_two_residues_to_samples():
    r = np.arange(M.PERIOD)
    for i in r:
        for j in r:
            s = M.SHIFT[i, j]
            assert (i + s) % M.PERIOD in M.COVER and (j + s) % M.PERIOD in M.COVER and s < M.PERIOD
