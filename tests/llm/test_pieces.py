import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import pieces as M

PIECES = ["▁", "a", "b", "c", "é", "ab", "abc", "bc", "▁a", "▁ab", "▁▁", "ca", "cab", "éa"]
SCORES = [-float(i % 5) - 1.5 - 0.01 * i for i in range(len(PIECES))]
V = M.Vocabulary(PIECES + [""] * 256, SCORES + [-99.0] * 256, list(range(len(PIECES), len(PIECES) + 256)))


def brute(text):
    """Best score over all paths, by trying every piece at every place."""
    s = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-math.inf] * len(s)
    for i in range(len(s)):
        best[i + 1] = max(best[i + 1], best[i] + V.unknown)
        for p, x in zip(PIECES, SCORES, strict=True):
            if s.startswith(p, i):
                best[i + len(p)] = max(best[i + len(p)], best[i] + x)
    return best[-1]


def score(ids):
    out, run = 0.0, b""
    for i in ids:
        if i < len(PIECES):
            out += SCORES[i]
        else:
            run += bytes([i - len(PIECES)])
    return out + len(run.decode()) * V.unknown


TEXTS = st.text(alphabet="abcé \nz好", max_size=30)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_paths_are_best_and_round_trip(text):
    ids = V.encode([text])[0]
    assert V.decode(ids) == text
    if text:
        assert abs(score(ids) - brute(text)) < 1e-6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé z▁", max_size=12), max_size=5))
def test_batched_and_single_solver_agree(texts):
    raws = [t.replace(" ", "▁").encode() for t in texts if t]
    if raws:
        assert V.many(raws) == [V.one(r) for r in raws]
    assert [V.decode(i) for i in V.encode(texts)] == texts


def test_double_array_holds_all_keys():
    keys = {p.encode(): i for i, p in enumerate(PIECES)}
    t = M.DoubleArray(keys)
    for k, i in keys.items():
        s = 0
        for c in k:
            n = t.base[s] + c + 1
            assert t.check[n] == s
            s = n
        assert t.value[s] == i


def test_table(docs):
    d = docs([None, "", "ab cab", "a▁b", "abc" * 2000, "ab cab"])
    rows = {x.doc_id: x for x in M.round_trip(d, V).collect()}
    assert all(x.round_trip for x in rows.values()) and rows[0].n_tokens == rows[1].n_tokens == 0
    assert rows[2].ids_hash == rows[5].ids_hash and M.round_trip(docs([]), V).count() == 0


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no vocabulary file")
def test_vocabulary_file():
    v = M.load("/opt/tokenizers/piece_bpe_32k.model")
    t = ["Hello  world\nñ 好 ▁ \t", "x" * 300]
    assert [v.decode(i) for i in v.encode(t)] == t and len(v.encode(["the"])[0]) == 1
