import random
import zlib

import pytest

from pricelens.llm import langid as M

TEXT = {"en": "the of and ing tion ther here with that", "de": "der und ung heit lich schön über nicht die", "fr": "le la des eau eux ment tion être où qui"}


def text(r, lang, n):
    return " ".join("".join(r.choice(TEXT[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))


def brute_phrases(text, samples):
    """Greedy parse by substring search."""
    norm = lambda t: " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in t).split())
    joined, s, n, i = "\0".join(map(norm, samples)), norm(text), 0, 0
    while i < len(s):
        j = i + 1
        while j <= len(s) and s[i:j] in joined:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n


@pytest.mark.parametrize("segment", [1024, 50, 7, 1])
@pytest.mark.parametrize("dense", [1 << 24, 0])
@pytest.mark.parametrize("few", [24, 0])
def test_phrases_equal_brute_force(monkeypatch, segment, dense, few):
    """Whatever the segments, a phrase may cross their ends; texts that repeat a sample are one long phrase."""
    monkeypatch.setattr(M, "SEGMENT", segment)
    monkeypatch.setattr(M, "DENSE", dense)
    monkeypatch.setattr(M, "FEW", few)
    r = random.Random(1)
    samples = {k: [text(r, k, 30) for _ in range(3)] for k in TEXT} | {"zh": ["".join(chr(r.randint(0x4E00, 0x4F00)) for _ in range(300))]}
    m = M.Model(samples)
    texts = [text(r, k, 40) for k in TEXT] + ["zzz ñ qqq", "a", "ñ", "", samples["de"][0], samples["de"][0] + " ñ " + samples["fr"][1] * 2, samples["zh"][0][50:200] + "好 der"]
    got = m.phrases([m.encode(t) for t in texts])
    assert [[int(x) for x in row] for row in got] == [[brute_phrases(t, samples[lang]) for t in texts] for lang in m.langs]


def test_held_out_accuracy(docs):
    r = random.Random(2)
    langs = {i: list(TEXT)[i % 3] for i in range(120)}
    texts = [text(r, langs[i], 20) for i in range(120)]
    d = docs(texts + [None, "", "12 34 !!"], langs={i: langs.get(i) for i in range(123)})
    rows = {x.doc_id: x for x in M.identify(d).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in rows.items())
    held = [i for i in range(120) if rows[i].held_out]
    assert sum(rows[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held) and len(held) > 15
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (120, 121, 122))
    assert all(0 <= x.score <= 1 for x in rows.values())


def test_labels_of_held_out_rows_are_not_learned(docs):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    d = docs(["alpha beta", "gamma delta", "x"], ids=ids, langs=dict.fromkeys(ids, "xx"))
    assert {x.lang_pred for x in M.identify(d).collect()} == {"und"}
    assert M.recognised(d).count() == 0


def test_long_text_crosses_segments_and_recognised_keeps_columns(docs):
    r = random.Random(3)
    d = docs([text(r, "en", 900), text(r, "de", 900), "!!", text(r, "en", 9), text(r, "de", 9), text(r, "en", 9), text(r, "de", 9)], langs={0: "en", 1: "de", 3: "en", 4: "de", 5: "en", 6: "de"})
    kept = M.recognised(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert M.identify(docs([])).count() == 0


def test_ties_repeats_and_long_labelled_texts(docs):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    same = docs(["abc abc"] * 6, ids=ids[:6], langs={ids[k]: "ba"[k % 2] for k in range(6)})
    assert {(x.lang_pred, x.score) for x in M.identify(same).collect()} == {("a", 0.0)}
    r = random.Random(5)
    long = docs([text(r, "en", 3000), text(r, "de", 3000), text(r, "en", 30), text(r, "de", 30)], ids=ids[:4], langs={ids[0]: "en", ids[1]: "de", ids[2]: None, ids[3]: None})
    assert {x.doc_id: x.lang_pred for x in M.identify(long.union(long)).collect()} == {ids[0]: "en", ids[1]: "de", ids[2]: "en", ids[3]: "de"}


def learned(n):
    """The first n ids that are learned from."""
    return [i for i in range(10 * n + 10) if zlib.crc32(str(i).encode()) % 4 != 2][:n]


def accuracy(d, langs):
    rows = [x for x in M.identify(d).collect() if x.held_out and langs.get(x.doc_id)]
    return sum(x.lang_pred == langs[x.doc_id] for x in rows) / len(rows)


def test_one_short_row_does_not_replace_a_sample(docs):
    r = random.Random(6)
    langs = {i: list(TEXT)[i % 3] for i in range(90)}
    texts = [text(r, langs[i], 400 if langs[i] == "de" else 20) for i in range(90)]
    assert accuracy(docs(texts, langs=langs), langs) == 1
    short = next(i for i in range(90, 200) if zlib.crc32(str(i).encode()) % 4 != 2)
    more = langs | {short: "de"}
    d = docs([*texts, "und"], ids=[*range(90), short], langs=more)
    assert accuracy(d, langs) == 1
    m = M.fit(d)
    assert max(m.bits) - min(m.bits) < 1


def test_a_language_of_a_few_letters_takes_nothing(docs):
    r = random.Random(7)
    langs = {i: list(TEXT)[i % 3] for i in range(90)}
    texts = [text(r, langs[i], 30) for i in range(90)]
    odd = next(i for i in range(90, 200) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert accuracy(docs([*texts, "zz"], ids=[*range(90), odd], langs=langs | {odd: "xx"}), langs) >= 0.95


def test_only_very_long_rows_bound_the_sample(docs, monkeypatch):
    monkeypatch.setattr(M, "TARGET", 3000)
    r = random.Random(8)
    ids = learned(4)
    langs = dict(zip(ids, ["en", "de", "en", "de"], strict=True))
    d = docs([text(r, langs[i], 2000) for i in ids], ids=ids, langs=langs)
    m = M.fit(d.union(d))
    assert all(2 ** b <= 3100 for b in m.bits)
    assert {x.doc_id: x.lang_pred for x in M.identify(d).collect()} == langs


def test_rows_that_repeat_a_chosen_id_are_not_learned(docs):
    i = learned(1)[0]
    d = docs(["aaaa bbbb", "zz" * 2000], ids=[i, i], langs={i: "en"})
    assert M.fit(d).bits[0] < 5


def test_what_fits_no_language_is_rejected(docs):
    r = random.Random(9)
    langs = {i: list(TEXT)[i % 3] for i in range(60)}
    texts = [text(r, langs[i], 60) for i in range(60)]
    other = ["".join(chr(r.randint(0x4E00, 0x8FFF)) for _ in range(200)), " ".join("".join(r.choice("bcdfghjklmnpqrstvwxyzåøæłžšđ") for _ in range(9)) for _ in range(60)), "The", "12", None]
    kept = {x.doc_id for x in M.recognised(docs(texts + other, langs=langs | dict.fromkeys(range(60, 65)))).collect()}
    assert kept == {*range(60), 62}
    assert {x.doc_id for x in docs(texts + other).where("text rlike '\\\\p{L}'").collect()} == {*range(60), 60, 61, 62}
