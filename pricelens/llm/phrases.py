"""Phrase collocations by prefix-free parsing.

Texts are split at punctuation and line breaks into pieces, and these into words. A piece is parsed into chunks: a word whose hash
is a multiple of TRIGGER begins one, and a chunk also takes the first LONGEST_PHRASE - 1 words of what follows it in the piece. So every phrase lies
whole in the chunk in which it begins, and is counted there alone. Equal chunks are counted once: the distinct ones form a
dictionary with frequencies, in which words and phrases are counted, weighted by frequency.

A phrase is as frequent as its parts at most: phrases of more than two words are counted where all pairs in them are frequent
enough. Which pairs are is told by bits of a fixed number (FILTER_BITS); a false hit costs a count that is dropped later, so the counts are exact
at every size.

A null text is empty, a null lang ``und``. Repeated rows count each time. Texts of any length are read whole; a stretch
of LONGEST_CHUNK words without a trigger is cut there. Equal scores are settled by the rule of rank(), which is total. An empty table gives no rows.
Only text and lang are read, whatever other columns exist.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, map_batches

TRIGGER = 64
LONGEST_PHRASE = 4
LONGEST_CHUNK = 4096
LEAST = 30
#: A longer candidate with this share (%) of a phrase's occurrences stands for it.
SHARE = 80
RANKS = 2000
#: Bits of a filter: 4 MB, broadcast.
FILTER_BITS = 1 << 25
#: Bytes of chunks that a task looks through together.
BLOCK = 1 << 20
#: Entries that a task counts up before it hands them on.
HELD = 200_000
_SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)
_CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("own", pa.int32()), ("freq", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


class _Triggers(dict):
    """By word: whether it begins a chunk. Starts anew when it is full."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= HELD:
            self.clear()
        self[word] = said = zlib.crc32(word) % TRIGGER == 0
        return said


def pieces(text: bytes) -> list[list[bytes]]:
    """The pieces of a text (UTF-8), as words; A-Z become lower case."""
    return [w for p in text.lower().translate(_SEPARATORS).split(b"\n") if (w := p.split())]


def chunks(words: list[bytes], begins: dict[bytes, bool]):
    """(words of a chunk, how many of them are its own) of a piece."""
    n, last = len(words), 0
    if n > LONGEST_CHUNK or True in map(begins.__getitem__, words):
        for i in range(1, n):
            if begins[words[i]] or i - last >= LONGEST_CHUNK:
                yield words[last : i + LONGEST_PHRASE - 1], i - last
                last = i
    yield words[last:], n - last


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, own, freq): the distinct chunks; own: how many of the words, from the first, are not those of the next chunk."""

    def run(it):
        begins, held = _Triggers(), Counter()

        def out():
            keys = list(held)
            yield from batches({"lang": [k[0] for k in keys], "chunk": [k[1] for k in keys], "own": [k[2] for k in keys], "freq": list(held.values())}, _CHUNKS)
            held.clear()

        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                for words in pieces(text.as_buffer().to_pybytes()):
                    for part, own in chunks(words, begins):
                        held[lang, b" ".join(part), own] += 1
                    if len(held) >= HELD:
                        yield from out()
        if held:
            yield from out()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = map_batches(rows, run, "lang string, chunk string, own int, freq long")
    return found.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


def word_counts(parsed: DataFrame) -> DataFrame:
    """(lang, phrase, f) of the single words."""
    own = F.explode(F.slice(F.split("chunk", " "), 1, F.col("own")))
    return parsed.select("lang", own.alias("phrase"), "freq").groupBy("lang", "phrase").agg(F.sum("freq").alias("f"))


def pair_counts(parsed: DataFrame) -> DataFrame:
    """(lang, phrase, f) of the phrases of two words."""
    words, own = F.split("chunk", " "), F.col("own")
    both = F.explode(F.arrays_zip(F.slice(words, 1, own).alias("x"), F.slice(words, 2, own).alias("y"))).alias("p")
    rows = parsed.where("instr(chunk, ' ') > 0").select("lang", both, "freq").select("lang", "p.x", "p.y", "freq").where("y is not null")
    found = rows.groupBy("lang", "x", "y").agg(F.sum("freq").alias("f"))
    return found.where(F.col("f") >= LEAST).select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "f")


class _Hashes(dict):
    """Hashes of words, none of them 0 but that of a chunk's end. Starts anew when it is full."""

    def __init__(self):
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
            self[b"\n"] = 0
        self[word] = h = xxhash.xxh64_intdigest(word) or 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _pair_bits(lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bit of a filter that stands for two words of a language that follow each other; all by their hashes."""
    x = (a + lang) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) % np.uint64(FILTER_BITS)


def bits(pairs: DataFrame) -> np.ndarray:
    """A filter of the rows of pairs (lang, phrase): FILTER_BITS bits, whatever their number."""

    def run(it):
        known, langs = _Hashes(), _Hashes()
        for batch in it:
            if not batch.num_rows:
                continue
            h = known.of(b" ".join(batch.column(1).cast(pa.binary()).to_pylist()).split(b" "))
            at = _pair_bits(langs.of(batch.column(0).cast(pa.binary()).to_pylist()), h[::2], h[1::2]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["at", "bit"])

    found = map_batches(pairs.select("lang", "phrase"), run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["bit"].to_numpy(np.int64)
    return out


def longer_counts(parsed: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(lang, phrase, f) of the phrases of three words and more all pairs of which may be frequent."""
    shared = parsed.sparkSession.sparkContext.broadcast(frequent)

    def run(it):
        table, known, lang_known = shared.value.view(np.uint64), _Hashes(), _Hashes()
        held: dict[tuple[bytes, bytes], int] = {}
        langs: list[bytes] = []
        parts: list[bytes] = []
        owns: list[np.ndarray] = []
        freqs: list[np.ndarray] = []
        size = 0

        def out():
            yield from batches({"lang": [k[0] for k in held], "phrase": [k[1] for k in held], "f": list(held.values())}, _COUNTS)
            held.clear()

        def count() -> None:
            words = b" \n ".join(parts).split(b" ")
            h = known.of(words)
            ends = np.append(np.flatnonzero(h == 0), len(h))
            starts = np.concatenate(([0], ends[:-1] + 1))
            row = np.repeat(np.arange(len(parts)), ends - starts + 1)[: len(h)]
            at = _pair_bits(lang_known.of(langs)[row[:-1]], h[:-1], h[1:])
            may = (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool) & (h[:-1] != 0) & (h[1:] != 0)
            begins = (np.arange(len(h) - 1) < (starts + np.concatenate(owns))[row[:-1]]) & may
            freq = np.concatenate(freqs)
            for n in range(3, LONGEST_PHRASE + 1):
                begins = begins[:-1] & may[n - 2 :]
                first = np.flatnonzero(begins)
                rows = row[first]
                for i, k, f in zip(first.tolist(), rows.tolist(), freq[rows].tolist(), strict=True):
                    key = (langs[k], b" ".join(words[i : i + n]))
                    held[key] = held.get(key, 0) + f

        for batch in it:
            langs += batch.column(0).cast(pa.binary()).to_pylist()
            parts += batch.column(1).cast(pa.binary()).to_pylist()
            owns.append(batch.column(2).to_numpy(zero_copy_only=False))
            freqs.append(batch.column(3).to_numpy(zero_copy_only=False))
            size += batch.column(1).nbytes
            if size >= BLOCK:
                count()
                langs, parts, owns, freqs, size = [], [], [], [], 0
                if len(held) >= HELD:
                    yield from out()
        if parts:
            count()
        if held:
            yield from out()

    longer = parsed.where("locate(' ', chunk, locate(' ', chunk) + 1) > 0").select("lang", "chunk", "own", "freq")  # three words or more
    found = map_batches(longer, run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words and phrases of up to LONGEST_PHRASE words that occur LEAST times or more, and (lang, n): all words."""
    parsed = cut(dictionary(docs), "chunks")
    words = cut(word_counts(parsed), "words")
    often = words.where(F.col("f") >= LEAST)
    pairs = cut(pair_counts(parsed), "pairs")
    longer = longer_counts(parsed, bits(pairs)).where(F.col("f") >= LEAST)
    return often.unionByName(pairs).unionByName(longer), words.groupBy("lang").agg(F.sum("f").alias("n"))


def rank(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first RANKS phrases by score, occurrences, and phrase.

    A phrase's score is that of its worst cut in two. Phrases inside a longer candidate with SHARE % of their occurrences are left out.
    counts: (lang, phrase, f) of all frequent words and phrases; totals: (lang, n).
    """
    words = F.split("phrase", " ")
    found = counts.where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    ways = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    side = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    ways = ways.select("lang", "phrase", "a", "k", side(1, F.col("k")).alias("first"), side(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    part = lambda c, f: counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    scored = ways.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = "CAST(CAST(a AS DECIMAL(20,0)) * 2000000 AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"  # products may pass 64 bits
    scored = scored.withColumn("score", F.expr(exact))
    worst = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    inner = found.where(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = worst.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * SHARE))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.select("lang", "phrase", "a", "w.l", "w.r", "w.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs, see rank()."""
    counts, totals = frequent_phrases(docs)
    return rank(cut(counts, "phrases"), totals)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\n\\x0b\\f\\r]')) AS piece FROM documents)
), g AS (
  SELECT lang, len, array_to_string(w[i : i + len - 1], ' ') AS phrase
  FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS len))
), c AS (SELECT lang, phrase, len, count(*) AS f FROM g GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE len = 1 GROUP BY lang
), cand AS (SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS w FROM c WHERE len > 1 AND f >= {LEAST}
), cuts AS (
  SELECT x.lang, x.phrase, x.a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM cand) x
  JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:k], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k + 1:], ' ')
), worst AS (SELECT DISTINCT ON (lang, phrase) * FROM cuts ORDER BY lang, phrase, score, k
), inside AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS sub FROM (
      SELECT lang, a, w, m, unnest(range(1, len - m + 2)) AS i FROM (SELECT *, unnest(range(2, len)) AS m FROM cand WHERE len > 2)))
  GROUP BY ALL
), ranked AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst t
  LEFT JOIN inside s ON s.lang = t.lang AND s.sub = t.phrase WHERE s.longer IS NULL OR 100 * s.longer < {SHARE} * t.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {RANKS}
"""
