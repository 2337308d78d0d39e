"""Benchmark decontamination by spaced-seed hashing, without loss.

A stretch of STRETCH words (a shorter item: all of it) is cut into blocks. The rule allows at most k of its words to differ, and
k words lie in k blocks at most: masks leave out every choice of k blocks, so that a stretch which meets the rule shares
the hash of what some mask reads, wherever the differing words stand. No pair is missed. Hashes of the documents are
joined with those of the items; at every hit the two word sequences are aligned and a document is reported where a stretch
of aligned words has a share of SIMILARITY or more in common.

The benchmark side is broadcast in parts of at most PART_WORDS words (plus one item), one pass over the documents for
each part; with more than one part, a pass is written to the shared folder before the next part is fetched, so that neither what
is broadcast nor the driver's memory grows with the benchmark.

Words are runs of letters and digits; in scripts that write without spaces each letter is a word. An item of fewer than five
words must occur whole. overlaps() reports items of any length; remove_overlapping() drops no document for an item
of fewer than EVIDENCE words, as clean texts hold such phrases too. Null and empty texts and items have no words and give
no rows. Repeated documents and items are each reported, rows without an id too; hits of one pair of rows give one row, the stretch
with the most equal words, the first one of equals. Texts of any length are searched whole. Other columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, map_batches

STRETCH = 13
SIMILARITY = 0.8
#: Words of an item, at least, for which a document goes.
EVIDENCE = 5
#: Hits that are looked at at once.
HITS = 1 << 20
PART_WORDS = 1_000_000
FILTER_BITS = 24
#: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
_NO_SPACES = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_BREAK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("n_same", pa.int64())])


class _Words(dict):
    """Hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def _hashes(text: str | None, words: _Words) -> np.ndarray:
    low = (text or "").lower()
    if not low.isascii() and _NO_SPACES.search(low):
        low = _NO_SPACES.sub(r" \1 ", low)
    got = low.encode("utf-8", "surrogatepass").translate(_BREAK).split()
    return np.fromiter(map(words.__getitem__, got), np.uint64, len(got))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _enough(n: int) -> int:
    """How many of n aligned words must be equal."""
    return next(k for k in range(n + 1) if k >= SIMILARITY * n)


def masks(n: int) -> list[tuple[tuple[int, int], ...]]:
    """For stretches of n words: masks of (first word, words) of what is read. Any allowed choice of differing words spares all of some mask."""
    k = n - _enough(n)
    parts = n if n < 7 else k + 2  # shorter blocks would be too common
    ends = [n * i // parts for i in range(parts + 1)]
    blocks = [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    return [tuple(x) for x in combinations(blocks, parts - k)]


class _Seeds(dict):
    """Hashes of the runs of so many words, by number of words, made when asked for."""

    def __init__(self, h: np.ndarray):
        self[1] = h

    def __missing__(self, n: int) -> np.ndarray:
        less = self[n - 1]
        out = less[:-1] * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        self[n] = out = out + self[1][n - 1 :]
        return out

    def of(self, mask: tuple[tuple[int, int], ...], span: int, salt: int) -> np.ndarray:
        """A hash for each position at which mask fits in."""
        n = len(self[1]) - span + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.full(n, salt, np.uint64)
        for at, size in mask:
            out = (out + self[size][at : at + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return _mix(out)


class Index:
    """Seeds of a part of the benchmark, sorted, behind a bit table that drops most other hashes."""

    def __init__(self, items: list[tuple[int, str | None]], least_words: int = 1):
        words = _Words()
        self.items = [(i, h) for i, t in items if len(h := _hashes(t, words)) >= least_words]
        #: (mask, words that it spans, salt), for each length of stretch that the items ask for.
        spans = sorted({min(len(h), STRETCH) for _, h in self.items})
        self.masks = [(m, n, 100 * n + k) for n in spans for k, m in enumerate(masks(n))]
        seeds, owner, place = [], [], []
        for k, (_, h) in enumerate(self.items):
            runs = _Seeds(h)
            for mask, span, salt in self.masks:
                if span == min(len(h), STRETCH):
                    s = runs.of(mask, span, salt)
                    seeds.append(s)
                    owner.append(np.full(len(s), k, np.int32))
                    place.append(np.arange(len(s), dtype=np.int32))
        seed = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int32))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int32))[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.seed & np.uint64((1 << FILTER_BITS) - 1)] = True

    def search(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, first word, words, equal words) of the best stretch for each item that the word hashes h overlap."""
        found: list[np.ndarray] = []
        runs = _Seeds(h)
        for mask, span, salt in self.masks:
            s = runs.of(mask, span, salt)
            at = np.flatnonzero(self.filter[s & np.uint64((1 << FILTER_BITS) - 1)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.seed, s[at], "left"), np.searchsorted(self.seed, s[at], "right")
            hit = np.flatnonzero(hi > lo)
            at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
            ends = np.cumsum(n)
            first = 0
            while first < len(n):  # positions that make HITS pairs, or one
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, "right")))
                own = n[first:last]
                which = np.repeat(lo[first:last] - np.cumsum(own) + own, own) + np.arange(own.sum())
                shift = np.repeat(at[first:last], own) - self.place[which]
                found.append(np.unique(self.owner[which].astype(np.int64) << 40 | (shift + (1 << 39))))
                first = last
        diagonals = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        best: dict[int, tuple[int, int, int]] = {}
        for code in diagonals.tolist():
            k, shift = code >> 40, (code & ((1 << 40) - 1)) - (1 << 39)
            w = self.items[k][1]
            lo, hi = max(0, shift), min(len(h), shift + len(w))
            need = min(STRETCH, len(w))
            if hi - lo < need:
                continue
            run = np.concatenate(([0], np.cumsum(h[lo:hi] == w[lo - shift : hi - shift])))
            got = run[need:] - run[:-need]
            if got.max() >= SIMILARITY * need:
                good = np.flatnonzero(got >= SIMILARITY * need)
                first, last = int(good[0]), int(good[-1]) + need
                one = (lo + first, last - first, int(run[last] - run[first]))
                if k not in best or (one[2], -one[0]) > (best[k][2], -best[k][0]):
                    best[k] = one
        return [(self.items[k][0], *x) for k, x in best.items()]


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    total = benchmark.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # words, at most
    n = int(total // PART_WORDS) + 1
    return [benchmark] if n == 1 else [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _indexes(benchmark: DataFrame, least_words: int):
    """Broadcast indexes of the parts, one at a time, and whether another one follows."""
    parts = _parts(benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null"))
    for k, part in enumerate(parts):
        index = Index([(r.item_id, r.text) for r in part.collect()], least_words)
        yield benchmark.sparkSession.sparkContext.broadcast(index), k + 1 < len(parts)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_same) of every document and benchmark item that overlap."""
    out, several = None, False
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for shared, more in _indexes(benchmark, 1):

        def run(it, shared=shared):
            words = _Words()
            for batch in it:
                found = [
                    (i.as_py(), *x) for i, t in zip(batch.column(0), batch.column(1), strict=True) for x in shared.value.search(_hashes(t.as_py(), words))
                ]
                yield from batches({f.name: [x[k] for x in found] for k, f in enumerate(_OUT)}, _OUT)

        got = map_batches(rows, run, "doc_id long, item_id long, start_word long, n_words long, n_same long")
        several |= more
        if several:
            got = cut(got, "overlaps")
            shared.destroy()
        out = got if out is None else out.union(got)
    return out


def remove_overlapping(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item of EVIDENCE words or more."""
    several = False
    for shared, more in _indexes(benchmark, EVIDENCE):

        def run(it, shared=shared):
            words = _Words()
            for batch in it:
                yield batch.filter(pa.array([not shared.value.search(_hashes(t.as_py(), words)) for t in batch.column("text")], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
        several |= more
        if several:
            docs = cut(docs, "overlaps")
            shared.destroy()
    return docs
