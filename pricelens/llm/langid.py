"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text. A text is then parsed greedily
into the longest substrings that occur in that sample; the number of phrases, normalised by the text's length and the
sample's size (phrases * log2(sample) / letters), estimates its cross entropy, and the lowest one wins.

Texts are parsed in segments of SEGMENT letters, so that thousands of them advance together through a transition table. What a
segment's parse would have been with the phrase that is open at its start is worked out afterwards: it is run again from that
phrase until both runs stand in the same state, which they soon do. So the number of phrases is that of the uncut text.
Letters are compared without case; what stands between letters counts as one space.

Fitting uses at most SAMPLE_DOCS documents a language, those of at most LETTERS characters first and then the shortest of the others,
until they have TARGET characters (the last one only as far as needed); that is its documented bound. Samples are of like size: all are cut to that of the smallest
language that has an ENOUGH share of the largest, and a phrase of a language with less costs as many bits as one of that size. Prediction reads every character of every text. A null text, an empty one and one without a letter
give ``und`` and score 0; equal costs go to the language that sorts first; repeated rows are predicted alike; where no
labelled row can be learned from, all rows give ``und``. A language that few labelled characters tell of can be learned, but takes no texts from the
others. recognised() rejects what fits no language: ``und``, and texts whose phrases need as many bits as letters drawn at
random from the winning language's would (GRACE phrases aside, as a short text begins and ends one). Only doc_id, text and lang are read, whatever other columns exist.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_batches

SAMPLE_DOCS = 64
LETTERS = 1024
TARGET = 1 << 16
ENOUGH = 1 / 8
GRACE = 2
SEGMENT = 1024
CHUNK = 1 << 21
#: Parses that are run one by one, not together.
FEW = 24
#: Entries of a transition table up to which it is kept dense.
DENSE = 1 << 24
UNKNOWN, PAD, SPACE = 0, 1, 2
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state (0: the root) of the automaton of all substrings of codes."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in codes:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = cur
    return step


class Table:
    """Steps of a greedy parse: state and letter give the next state and the phrases that end. State 0 is the root.

    A letter that the sample lacks is a phrase of its own, and ends the one before it.
    """

    def __init__(self, step: list[dict[int, int]], width: int, dense: bool):
        self.width = width if dense else 1
        self.root = np.full(width, 2, np.int64)  # from any state without a transition
        for c, q in step[0].items():
            self.root[c] = q * self.width * 4 + 1
        if dense:
            table = np.tile(self.root.astype(np.int32), (len(step), 1))
            table[0][self.root == 2] = 1
            for s, row in enumerate(step):
                for c, q in row.items():
                    table[s, c] = q * width * 4
            table[:, PAD] = np.arange(len(step), dtype=np.int32) * width * 4
            self.table, self.keys = table.ravel(), None
        else:
            keys = sorted((s * width + c, q * 4) for s, row in enumerate(step) for c, q in row.items())
            self.keys, self.table = np.array([k for k, _ in keys], np.int64), np.array([v for _, v in keys], np.int64)
            self.letters = width

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, phrases that end)."""
        if self.keys is None:
            v = self.table[state + code]
        else:
            key = state.astype(np.int64) * self.letters + code
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            v = np.where(self.keys[at] == key, self.table[at], self.root[code])
            v = np.where((state == 0) & (v == 2), 1, v)
            v = np.where(code == PAD, state.astype(np.int64) * 4, v)
        return (v >> 2).astype(np.int32), v & 3


    def alone(self, state: int, codes: list[int], until: list[int]) -> tuple[int, int, int | None]:
        """One parse: (phrases that end, last state, the place at which it first stands in the state that until has there)."""
        ended, table, dense = 0, memoryview(self.table), self.keys is None
        for i, (code, other) in enumerate(zip(codes, until, strict=True)):
            if dense:
                v = table[state + code]
            else:
                after, more = self.step(np.array([state]), np.array([code]))
                v = int(after[0]) << 2 | int(more[0])
            ended += v & 3
            state = v >> 2
            if state == other:
                return ended, state, i
        return ended, state, None


class Model:
    """Automata by language."""

    def __init__(self, samples: dict[str, list[str]], least: int = 2):
        """samples: texts by language; least: the size from which a sample's phrases cost more bits."""
        letters = sorted({ch.lower()[0] for texts in samples.values() for t in texts for ch in t if ch.isalpha()})
        self.codes = {c: i + 3 for i, c in enumerate(letters)}
        self.langs = sorted(samples)
        self._lookup = None
        self.tables: list[Table] = []
        self.own: list[np.ndarray] = []  # codes of a language's own letters by code
        self.bits: list[float] = []
        self.uniform: list[float] = []  # bits of a letter drawn at random, spaces included
        for lang in self.langs:
            train: list[int] = []
            for t in samples[lang]:
                train += [*self.encode(t).tolist(), PAD]
            used = sorted(set(train) - {UNKNOWN, PAD, SPACE})
            own = np.full(len(letters) + 3, UNKNOWN, np.uint16)
            own[[PAD, SPACE, *used]] = [PAD, SPACE, *range(3, len(used) + 3)]
            step = suffix_automaton(own[train].tolist())
            width = len(used) + 3
            self.own.append(own)
            self.tables.append(Table(step, width, len(step) * width <= DENSE))
            self.bits.append(np.log2(max(2, least, len(train))))
            self.uniform.append(np.log2(len(used) + 1))

    def __getstate__(self):
        return self.__dict__ | {"_lookup": None}

    @property
    def lookup(self) -> np.ndarray:
        if self._lookup is None:
            self._lookup = np.full(0x110000, SPACE, np.uint16)
            for i in range(0x110000):
                ch = chr(i)
                if ch.isalpha():
                    self._lookup[i] = self.codes.get(ch.lower()[0], UNKNOWN)
        return self._lookup

    def encode(self, text: str | None) -> np.ndarray:
        """Codes of the letters, one SPACE for whatever stands between two of them."""
        c = self.lookup[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = c == SPACE
        if len(c):
            c = c[~(gap & np.concatenate(([True], gap[:-1])))]
        return c[:-1] if len(c) and c[-1] == SPACE else c

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrase counts by language and text."""
        n_seg = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), n_seg)
        lanes = np.full((len(owner), SEGMENT), PAD, np.uint16)
        ends, at = np.empty(len(owner), np.int64), 0
        for t in texts:
            for i in range(0, len(t), SEGMENT):
                part = t[i : i + SEGMENT]
                lanes[at, : len(part)] = part
                ends[at] = len(part)
                at += 1
        order = np.argsort(-ends, kind="stable")
        place = np.empty(len(order), np.int64)  # the lane of each segment
        place[order] = np.arange(len(order))
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # segments that go on with a text
        lanes, ends = np.ascontiguousarray(lanes[order].T), ends[order]
        live = np.searchsorted(-ends, -np.arange(SEGMENT), "left")  # lanes longer than i
        states, counts = np.zeros((SEGMENT, len(owner)), np.int32), np.zeros((SEGMENT, len(owner)), np.int32)
        out = np.zeros((len(self.langs), len(texts)))
        for k, (table, own) in enumerate(zip(self.tables, self.own, strict=True)):
            codes = own[lanes]
            state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for i in range(SEGMENT):
                if not (n := live[i]):
                    break
                state[:n], more = table.step(state[:n], codes[i, :n])
                count[:n] += more
                states[i, :n], counts[i, :n] = state[:n], count[:n]
            whole = self._joined(table, codes, ends, place, follows, state, count, states, counts)
            open_at_end = np.zeros(len(texts), bool)
            last = np.cumsum(n_seg) - 1
            some = n_seg > 0
            open_at_end[some] = state[place[last[some]]] != 0
            out[k] = np.bincount(owner, whole[place], minlength=len(texts)) + open_at_end
        return out

    @staticmethod
    def _joined(table, codes, ends, place, follows, state, count, states, counts) -> np.ndarray:
        """The counts of all lanes if segments that go on with a text start in the state in which the one before ends.

        state becomes the state at the end of each lane then.
        """
        whole, recorded, next_ones = count.copy(), state.copy(), set(follows.tolist())
        todo = follows
        while len(todo):
            lane, now = place[todo], state[place[todo - 1]].copy()
            seen, end = np.zeros(len(todo), np.int64), recorded[lane]
            whole[lane] = count[lane]
            active = np.flatnonzero(now != 0)  # from the root there is nothing to mend
            for i in range(SEGMENT + 1):
                if len(active) <= FEW:
                    break
                if i:
                    met = now[active] == states[i - 1, lane[active]]
                    done = active[met]
                    whole[lane[done]] += seen[done] - counts[i - 1, lane[done]]
                    active = active[~met]
                over = active[ends[lane[active]] <= i]  # another phrase up to the segment's end
                whole[lane[over]], end[over] = seen[over], now[over]
                active = active[ends[lane[active]] > i]
                if not len(active):
                    break
                now[active], more = table.step(now[active], codes[i, lane[active]])
                seen[active] += more
            for j in active.tolist():  # the last ones go on alone
                k = lane[j]
                n, at, begun = int(ends[k]), int(now[j]), max(0, i - 1)
                met = begun if i and at == states[begun, k] else None
                if met is None:
                    more, at, met = table.alone(at, codes[i:n, k].tolist(), states[i:n, k].tolist())
                    seen[j] += more
                    met = None if met is None else i + met
                if met is None:
                    whole[k], end[j] = seen[j], at
                else:
                    whole[k] += seen[j] - counts[met, k]
            changed = end != state[lane]
            state[lane] = end
            todo = np.array(sorted(next_ones & set((todo[changed] + 1).tolist())), np.int64)
        return whole

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether the text fits the language) of each text."""
        out: list[tuple[str, float, bool]] = []
        part: list[np.ndarray] = []
        size = 0
        for t in texts:
            part.append(self.encode(t))
            size += len(part[-1])
            if size >= CHUNK:
                out += self._predict(part)
                part, size = [], 0
        return out + self._predict(part)

    def _predict(self, texts: list[np.ndarray]) -> list[tuple[str, float, bool]]:
        if not texts:
            return []
        phrases, bits = self.phrases(texts), np.array(self.bits)
        cost = phrases * bits[:, None]
        best = cost.argmin(0)
        low = cost.min(0)
        second = np.partition(cost, 1, axis=0)[1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = 1 - low / np.where(second > 0, second, 1)
        fits = low - GRACE * bits[best] < np.array([len(t) for t in texts]) * np.array(self.uniform)[best]
        return [
            (self.langs[best[i]], float(min(1.0, max(0.0, score[i]))), bool(fits[i])) if len(t) else ("und", 0.0, False)
            for i, t in enumerate(texts)
        ]


def held_out():
    """True for the documents whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """A model of the labelled documents outside the held-out fold; None if there are none.

    The sample has, of each language and each of SAMPLE_DOCS slots that a hash of doc_id gives, the document with the
    lowest hash among those of at most LETTERS characters, or else the shortest: one pass over ids and lengths, then the chosen rows' texts.
    """
    h = F.xxhash64("doc_id")
    size = F.length("text")
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t")]
    pick = (
        learned.select("lang", *key, F.greatest(size - LETTERS, F.lit(0)).alias("long"), size.alias("size"), h.alias("h"), F.pmod(h, F.lit(SAMPLE_DOCS)).alias("slot"))
        .groupBy("lang", "slot")
        .agg(F.min(F.struct("long", "h", "doc_id", "t", "size")).alias("m"))
        .select("lang", "m.*")
    )
    by_lang: dict[str, list] = {}
    for r in sorted(pick.collect(), key=lambda r: (r.lang, r.long, r.h, r.t)):  # SAMPLE_DOCS a language at most
        by_lang.setdefault(r.lang, []).append(r)
    if not by_lang:
        return None
    have = {lang: min(TARGET, sum(r.size for r in rows)) for lang, rows in by_lang.items()}
    most = max(have.values())
    like = min(n for n in have.values() if n >= ENOUGH * most)
    wanted: dict[tuple, int] = {}  # how many characters of each chosen row
    for lang, rows in by_lang.items():
        left = like
        for r in rows:
            if left > 0:
                wanted[lang, r.doc_id, r.t] = min(left, r.size)
                left -= r.size
    ids, hashes = ({k[i] for k in wanted} - {None} for i in (1, 2))
    chosen = F.col("doc_id").isin(list(ids)) | F.col("doc_id").isNull() if any(k[1] is None for k in wanted) else F.col("doc_id").isin(list(ids))
    rows = learned.select("lang", *key, F.substring("text", 1, TARGET).alias("text")).where(chosen & F.col("t").isin(list(hashes))).distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id is not None, r.doc_id or 0, r.t)):
        if n := wanted.get((r.lang, r.doc_id, r.t)):
            samples.setdefault(r.lang, []).append(r.text[:n])
    return Model(samples, like)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs."""
    spark = docs.sparkSession
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(it):
        for batch in it:
            said = shared.value.predict(t.as_py() for t in batch.column(1))
            ids = batch.column(0).to_pylist()
            yield from batches({"doc_id": ids, "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]}, _OUT)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs."""
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame) -> DataFrame:
    """The documents that a language is found for and that fit it, with all their columns."""
    model = fit(docs)
    if model is None:
        return docs.where("false")
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(it):
        for batch in it:
            said = shared.value.predict(t.as_py() for t in batch.column("text"))
            yield batch.filter(pa.array([fits for _, _, fits in said], pa.bool_()))

    return map_batches(docs, run, schema)
