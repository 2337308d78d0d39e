"""Removal of byte strings that repeat across a corpus, by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a LENGTH-byte string that also starts earlier: in a document of smaller doc_id, or earlier in the
same one. Suffixes are only compared over their first LENGTH bytes, within a document.

1. Every LENGTH-byte window has an anchor, its least GRAM-byte hash, which windows of equal content share. Consecutive
   windows with one anchor form a context (anchor hash g, content hash c). Equal contexts have equal windows throughout, so all
   but the first of them go as a whole. Only contexts that share an anchor but not all content need sorting.
2. Those contexts form the suffix buckets (one for each anchor). A task sorts one block of buckets at a time: by the first
   PERIOD bytes of each suffix, then ties by a three-way partition that compares ranks of cover samples. The cover gives any
   two positions a shift below PERIOD that takes both to a sampled position, so one comparison of precomputed ranks settles
   a tie of any length. Neighbours that agree in LENGTH bytes form a class; all but its first suffix go.
3. An anchor with very many contexts would make one unbounded bucket. Its windows are keyed by their 128-bit content hash
   instead, each key reduced per task before the shuffle; the result is the same.

Which anchors have so many is counted beforehand, over all documents: a task reports the anchors that it meets LOCAL times or more, so
none with LOCAL contexts a task is missed; the counts only route rows, no result depends on them. At most 1/SHARE anchors are
routed so, a list that is broadcast; any other has at most SHARE of all contexts, or BUCKET.

A null text counts as empty. Rows that repeat a doc_id are one document: a string goes if it also starts at a smaller place in
any of them, and stays in all of them at equal places; each row (told apart by a hash of its text) loses its own bytes. A row without
doc_id neither matches nor loses anything. Texts of any length are read in pieces of PIECE bytes; what is gathered for one document
is in proportion to its text. An empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, cut, map_batches, slices

LENGTH = 100
GRAM = 32
#: A perfect difference set: every residue modulo PERIOD is the difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
PIECE = 1 << 17
#: Anchors gathered in a task before equal contexts are reduced; bytes of contexts sorted as one block.
HELD, BLOCK = 1 << 18, 1 << 21
#: Contexts of one anchor that are sorted as a bucket.
BUCKET = 4096
LOCAL, SHARE = 8, 1e-6

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_ANCHORS = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])
_RANGES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_CONTEXTS = pa.schema([("g", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("what", pa.int32()), ("bytes", pa.binary())])
_WINDOWS = pa.schema([("kind", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_COUNTS = pa.schema([("g", pa.int64()), ("n", pa.int64())])
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int) -> np.ndarray:
    if name not in _powers:
        p = np.full(PIECE + LENGTH + 1, base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name]


def contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each context of a byte string."""
    g_all, lo_all, n_all = [], [], []
    up, down = _power("up", int(_BASE)), _power("down", pow(int(_BASE), -1, 1 << 64))
    for at in range(0, len(raw) - LENGTH + 1, PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE + LENGTH - 1, len(raw) - at), at).astype(np.uint64) + _U(1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * up[: len(b)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        low = (h & _U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        step, wide = 1, LENGTH - GRAM + 1
        while step * 2 <= wide:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if wide > step:
            low = np.minimum(low[: step - wide], low[wide - step :])
        anchor = (low & _U(0xFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        g_all.append(h[anchor[first]])
        lo_all.append(first + at)
        n_all.append(np.diff(np.append(first, len(anchor))))
    if not g_all:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(g_all), np.concatenate(lo_all), np.concatenate(n_all)


def _merged(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Ranges by document and row, those that touch made one."""
    order = np.lexsort((start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order], end[order]
    if not len(doc):
        return {"doc_id": doc, "row": row, "start": start, "end": end}
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
    group = np.cumsum(new) - 1
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return {"doc_id": doc[first], "row": row[first], "start": start[first], "end": np.append(reach[first[1:] - 1], reach[-1])}


def _not_first(keys: list[np.ndarray], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that start where the first of their key does, rows that start after it)."""
    order = np.lexsort((lo, doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (doc[order] != doc[head]) | (lo[order] != lo[head])
    return order[~later], order[later]


def _i64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _with_rows(docs: DataFrame, carry: list[str] = []) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text", *carry)


def frequent_anchors(docs: DataFrame) -> DataFrame:
    """(g) of the anchors with more than SHARE of all contexts and more than BUCKET."""

    def run(it):
        held, size, total = [], 0, 0

        def done():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL
            return batches({"g": _i64(g[often]), "n": n[often]}, _COUNTS)

        for batch in it:
            for t in batch.column(0):
                if t.is_valid and len(t.as_buffer()) >= LENGTH:
                    held.append(contexts(t.as_buffer().to_pybytes())[0])
                    size += len(held[-1])
                    total += len(held[-1])
                    if size >= 8 * HELD:
                        yield from done()
                        held, size = [], 0
        if held:
            yield from done()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], schema=_COUNTS)  # all of the task's

    counts = cut(map_batches(docs.select("text"), run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "repeats")
    total = counts.where("g is null").agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("g").isNotNull() & (F.col("n") > max(BUCKET, int(total * SHARE)))).select("g")


def anchors(docs: DataFrame) -> DataFrame:
    """Contexts (kind 1) and, from equal ones met in one task, ranges that go (kind 0: n bytes from lo)."""

    def flush(held):
        g, c, doc, row, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
        first, later = _not_first([c, g], doc, lo)
        gone = _merged(doc[later], row[later], lo[later], lo[later] + n[later] + LENGTH - 1)
        rows = {"kind": np.repeat(np.array([1, 0], np.int32), [len(first), len(gone["doc_id"])])}
        for name, x, y in (("g", _i64(g[first]), gone["doc_id"]), ("c", _i64(c[first]), gone["start"]), ("doc_id", doc[first], gone["doc_id"]), ("row", row[first], gone["row"]), ("lo", lo[first], gone["start"]), ("n", n[first], gone["end"] - gone["start"])):
            rows[name] = np.concatenate((x, y))
        yield from batches(rows, _ANCHORS)

    def run(it):
        held, size = [], 0
        for batch in it:
            for i, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if i is None or not t.is_valid or len(t.as_buffer()) < LENGTH:
                    continue
                raw = t.as_buffer().to_pybytes()
                g, lo, n = contexts(raw)
                spans = zip(lo.tolist(), (lo + n + LENGTH - 1).tolist(), strict=True)
                c = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans], np.uint64)
                held.append((g, c, np.full(len(g), i, np.int64), np.full(len(g), r, np.int64), lo, n))
                size += len(g)
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return map_batches(_with_rows(docs), run, "kind int, g long, c long, doc_id long, row long, lo long, n int")


def _shifts() -> np.ndarray:
    """[i, j]: the least shift that takes residues i and j both into the cover."""
    r = np.arange(PERIOD)
    in_cover = np.isin(r, COVER)
    hits = in_cover[(r[:, None, None] + r) % PERIOD] & in_cover[(r[None, :, None] + r) % PERIOD]
    assert hits.any(2).all()
    return hits.argmax(2)


SHIFT = _shifts()


def suffix_classes(bucket, doc, row, lo, n, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Ranges of the windows that start after an equal window of their bucket. Arguments: one entry for each context."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    buf = np.concatenate((np.frombuffer(b"".join(texts), np.uint8), np.zeros(LENGTH + PERIOD + 16, np.uint8)))
    word = np.zeros(len(buf) - 7, np.uint64)  # eight bytes from each position, the first one highest
    for k in range(8):
        word = (word << _U(8)) | buf[k : len(buf) - 7 + k]
    ctx = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(ctx))
    phase = (lo[ctx] + at - begin[ctx]) % PERIOD
    offset = at - begin[ctx]
    # ranks of the cover samples
    sample = at[np.isin(phase, COVER) & (offset < n[ctx] + PERIOD)]
    cols = [word[sample + k] for k in range(0, LENGTH + 4, 8)]
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    for x in cols:
        new[1:] |= x[order][1:] != x[order][:-1]
    rank = np.full(len(at), -1, np.int64)
    rank[sample[order]] = np.cumsum(new)
    # suffixes of each bucket by their first PERIOD bytes
    s = at[offset < n[ctx]]
    own = np.unique(bucket, return_inverse=True)[1][ctx[s]]
    keys = [own, word[s], word[s + 8], word[s + 16], word[s + 24] >> _U(8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    s = s[order]
    tied = ~new
    # three-way partition of the ties around a pivot of each run
    run = np.cumsum(new) - 1
    count = np.bincount(run, minlength=1)
    live = np.flatnonzero(count[run] > 1)
    run = run[live]
    while len(live):
        heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        length = np.diff(np.append(heads, len(run)))
        pivot = s[live[np.repeat(heads + length // 2, length)]]
        x = s[live]
        d = SHIFT[phase[x], phase[pivot]]
        side = np.sign(rank[x + d] - rank[pivot + d])
        key = run * 3 + side + 1
        turn = np.argsort(key, kind="stable")
        s[live] = x[turn]
        key = key[turn]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.repeat(np.diff(np.append(heads, len(key))), np.diff(np.append(heads, len(key))))
        keep = (length > 1) & (side[turn] != 0)
        live, run = live[keep], key[keep]
        if len(run):
            run = np.cumsum(np.concatenate(([0], run[1:] != run[:-1])))
    # neighbours that agree in LENGTH bytes
    same = np.flatnonzero(tied)
    for k in [*range(24, LENGTH - 8, 8), LENGTH - 8]:
        same = same[word[s[same] + k] == word[s[same - 1] + k]]
    head = np.ones(len(s), bool)
    head[same] = False
    k = ctx[s]
    pos = lo[k] + s - begin[k]
    place = np.unique(doc, return_inverse=True)[1][k].astype(np.int64) << 40 | pos
    starts = np.flatnonzero(head)
    least = np.minimum.reduceat(place, starts) if len(starts) else place
    later = place > np.repeat(least, np.diff(np.append(starts, len(s))))
    return _merged(doc[k[later]], row[k[later]], pos[later], pos[later] + LENGTH)


def _sort_blocks(rows: DataFrame) -> DataFrame:
    """Ranges that go, from contexts (g, doc_id, lo, n, bytes) of which each g has a bounded number."""

    def run(it):
        held: list[list] = [[], [], [], [], [], []]
        size, last = 0, None

        def done():
            g, doc, who, lo, n = (np.array(x, np.int64) for x in held[:5])
            return batches(suffix_classes(g, doc, who, lo, n, held[5]), _RANGES)

        for batch in it:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size >= BLOCK and row[0] != last:
                    yield from done()
                    held, size = [[], [], [], [], [], []], 0
                for x, y in zip(held, row, strict=True):
                    x.append(y)
                size, last = size + len(row[5]), row[0]
        if size:
            yield from done()

    spread = rows.select("g", "doc_id", "row", "lo", "n", "bytes").repartition("g")
    return map_batches(spread.sortWithinPartitions("g"), run, "doc_id long, row long, start long, end long")


def _hash_windows(rows: DataFrame) -> DataFrame:
    """The same for contexts of frequent anchors: each window is keyed by its content."""

    def flush(held):
        w1, w2, doc, row, lo = (np.concatenate(x) for x in zip(*held, strict=True))
        first, later = _not_first([w2, w1], doc, lo)
        gone = _merged(doc[later], row[later], lo[later], lo[later] + LENGTH)
        k = len(gone["doc_id"])
        out = {"kind": np.repeat(np.array([1, 0], np.int32), [len(first), k])}
        for name, x, y in (("w1", _i64(w1[first]), gone["start"]), ("w2", _i64(w2[first]), gone["doc_id"]), ("doc_id", doc[first], gone["doc_id"]), ("row", row[first], gone["row"]), ("lo", lo[first], gone["start"]), ("hi", lo[first] + LENGTH, gone["end"])):
            out[name] = np.concatenate((x, y))
        yield from batches(out, _WINDOWS)

    def run(it):
        held, size = [], 0
        for batch in it:
            for doc, row, lo, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                digests = b"".join(xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in range(n))
                w = np.frombuffer(digests, np.uint64).reshape(n, 2)
                held.append((w[:, 0], w[:, 1], np.full(n, doc, np.int64), np.full(n, row, np.int64), lo + np.arange(n)))
                size += n
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    found = map_batches(rows.select("doc_id", "row", "lo", "n", "bytes"), run, "kind int, w1 long, w2 long, doc_id long, row long, lo long, hi long")
    first = F.first(F.struct("doc_id", "lo")).over(Window.partitionBy("kind", "w1", "w2").orderBy("doc_id", "lo"))
    gone = found.withColumn("f", first).where("kind = 0 or f.doc_id <> doc_id or f.lo <> lo")
    return gone.select("doc_id", "row", F.col("lo").alias("start"), F.col("hi").alias("end"))


def _find(docs: DataFrame) -> DataFrame:
    """what 0: bytes lo to lo + n of doc_id go; 1, 2: contexts to sort, in a bucket or by window hash."""
    often = frequent_anchors(docs).withColumn("hot", F.lit(True))  # 1/SHARE rows at most
    rows = anchors(docs).join(F.broadcast(often), "g", "left").withColumn("hot", F.col("hot").isNotNull() & (F.col("kind") == 1))
    rows = rows.withColumn("route", F.xxhash64("g", F.when(F.col("hot"), F.col("c"))))
    group = Window.partitionBy("kind", "route", "g")
    first = F.first(F.struct("doc_id", "lo")).over(Window.partitionBy("kind", "route", "g", "c").orderBy("doc_id", "lo"))
    place = F.rank().over(Window.partitionBy("kind", "route", "g", "c").orderBy("doc_id", "lo"))
    rows = rows.repartition("route").select(
        "*", first.alias("f"), place.alias("place"), (F.min("c").over(group) != F.max("c").over(group)).alias("mixed"), F.count("*").over(group).alias("rows")
    )
    later = (F.col("f.doc_id") != F.col("doc_id")) | (F.col("f.lo") != F.col("lo"))
    what = (
        F.when((F.col("kind") == 0) | later, 0)
        .when((F.col("place") == 1) & F.col("hot"), 2)
        .when((F.col("place") == 1) & F.col("mixed"), F.when(F.col("rows") > BUCKET, 2).otherwise(1))
    )
    found = rows.select(
        "doc_id", "row", "g", "lo", F.when((F.col("kind") == 1) & later, F.col("n") + LENGTH - 1).otherwise(F.col("n")).alias("n"), what.alias("what")
    )
    return cut(found.where("what is not null"), "repeats")


def _contexts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found with what 1 and 2, and their bytes."""

    def run(it):
        for batch in (x for whole in it for x in slices(whole, "text", BLOCK)):
            rows = []
            for doc, row, t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = t.as_buffer()
                rows += [(c["g"], doc, row, c["lo"], c["n"], c["what"], raw[c["lo"] : c["lo"] + c["n"] + LENGTH - 1].to_pybytes()) for c in own]
            yield from batches({f.name: [r[k] for r in rows] for k, f in enumerate(_CONTEXTS)}, _CONTEXTS)

    own = found.where("what > 0").distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("g", "lo", "n", "what")).alias("own"))
    asked = texts.join(own, ["doc_id", "row"], "left").where("own is not null").select("doc_id", "row", "text", "own")
    return map_batches(asked, run, "g long, doc_id long, row long, lo long, n int, what int, bytes binary")


def dedup(docs: DataFrame, carry: list[str] = []) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256, *carry) of every row; kept is the text without what repeats.

    carry names further columns of docs to return.
    """
    found = _find(docs)
    texts = _with_rows(docs, carry).repartition("doc_id", "row")
    places = cut(_contexts(texts, found), "repeats")
    gone = (
        found.where("what = 0")
        .select("doc_id", "row", F.col("lo").alias("start"), (F.col("lo") + F.col("n")).alias("end"))
        .union(_sort_blocks(places.where("what = 1")))
        .union(_hash_windows(places.where("what = 2")))
        .groupBy("doc_id", "row")
        .agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    )

    def run(it):
        for batch in (x for whole in it for x in slices(whole, "text", BLOCK)):
            rows = []
            for doc, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                spans: list[list[int]] = []
                for r in sorted((x["start"], x["end"]) for x in own or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                cuts = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                text = kept.decode("utf-8", "ignore") if t.is_valid else None
                rows.append((doc, text, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            own = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RESULT)]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns[3:]], names=[*_RESULT.names, *carry])

    whole = texts.join(gone, ["doc_id", "row"], "left").select("doc_id", "text", "gone", *carry)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_batches(whole, run, "doc_id long, kept string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)
