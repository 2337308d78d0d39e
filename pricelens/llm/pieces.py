"""SentencePiece unigram encoding and decoding.

A text is encoded by the Viterbi path of highest total log score through its pieces, which a double-array trie over UTF-8
bytes finds from every position. A character that no piece covers costs the lowest score less UNKNOWN_COST and becomes
its bytes' pieces. A space is the marker U+2581, and one is put before the text; decoding turns markers into spaces and
drops the first. A marker that stands in the text itself is written in byte pieces, so every text decodes to itself.

No piece has a marker after another character, and none holds a line feed where the vocabulary has none; so paths
decompose at those places, and each distinct word is solved once per chunk, thousands of words advancing together. Where a
vocabulary has such pieces, whole texts are solved instead.

A null text stays null (no ids), an empty one has no ids; repeated rows are encoded alike; texts of any length are
read whole, CHUNK characters of texts at a time. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

MARK = "▁"
UNKNOWN_COST = 10.0
CHUNK = 1 << 20
CACHED_WORDS = 250_000
#: Longer words (bytes) are solved one by one.
LONG = 96


class DoubleArray:
    """Double-array trie of byte strings: from state s, byte c leads to base[s] + c + 1 if check[base[s] + c + 1] == s."""

    def __init__(self, keys: dict[bytes, int]):
        size = 1 << 16
        self.base, self.check, self.value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        self.check[0] = 0
        free = np.ones(size, bool)
        free[0] = False
        top = 1  # slots from here on are free; branching nodes are placed near it, others in the first gap
        gap = 1
        todo: list[tuple[int, list[tuple[bytes, int]], int]] = [(0, sorted(keys.items()), 0)]
        while todo:
            state, own, depth = todo.pop()
            if own and len(own[0][0]) == depth:
                self.value[state] = own[0][1]
                own = own[1:]
            if not own:
                continue
            groups: dict[int, list[tuple[bytes, int]]] = {}
            for k in own:
                groups.setdefault(k[0][depth], []).append(k)
            need = np.fromiter(groups, np.int64) + 1
            if top + 2048 >= len(free):
                grow = len(free)
                free = np.concatenate((free, np.ones(grow, bool)))
                self.base, self.check, self.value = (
                    np.concatenate((a, np.full(grow, x, np.int32))) for a, x in ((self.base, 0), (self.check, -1), (self.value, -1))
                )
            if len(need) == 1:
                while not free[gap] or gap < need[0]:
                    gap += 1
                at = gap - int(need[0])
            else:
                tries = np.arange(max(0, top - 1024), top + 1)
                at = int(tries[np.argmax(free[tries[:, None] + need].all(1))])
            self.base[state] = at
            free[at + need] = False
            self.check[at + need] = state
            top = max(top, at + int(need.max()) + 1)
            todo += [(at + c + 1, g, depth + 1) for c, g in groups.items()]
        for name in ("base", "check", "value"):  # a step from any state stays inside
            setattr(self, name, getattr(self, name)[: top + 258].copy())


class Vocabulary:
    """Pieces with log scores, ready to encode and decode; travels to tasks as it is."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        """pieces[i] is "" for an id that text never becomes (controls, bytes); byte_ids: the id of each byte's piece."""
        self.scores = np.array(scores, np.float64)
        self.byte_ids = list(byte_ids)
        self.trie = DoubleArray({p.encode(): i for i, p in enumerate(pieces) if p})
        known = [self.scores[i] for i, p in enumerate(pieces) if p]
        self.unknown = (min(known) if known else 0.0) - UNKNOWN_COST
        self.out = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.out[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in pieces):
            self.split = None
        elif any("\n" in p for p in pieces):
            self.split = re.compile(" *[^ ]+| +")
        else:
            self.split = re.compile(" *[^ \n]+|\n| +")
        self.cache: dict[str, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _spell(self, raw: bytes, steps: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path; steps: begin, end, piece (-1: a character without one)."""
        out: list[int] = []
        for i, j, p in steps:
            out += [p] if p >= 0 else [self.byte_ids[b] for b in raw[i:j]]
        return out

    def one(self, raw: bytes) -> list[int]:
        """Viterbi path of one byte string."""
        base, check, value, scores, n = self.trie.base, self.trie.check, self.trie.value, self.scores, len(raw)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for i in range(n):
            if (here := best[i]) is None:
                continue
            state = 0
            for j in range(i, n):
                nxt = int(base[state]) + raw[j] + 1
                if nxt >= len(check) or check[nxt] != state:
                    break
                state = nxt
                if (p := int(value[state])) >= 0:
                    s = here + float(scores[p])
                    if best[j + 1] is None or s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, p)
            j = i + 1
            while j < n and raw[j] & 0xC0 == 0x80:
                j += 1
            if best[j] is None or here + self.unknown > best[j]:
                best[j], back[j] = here + self.unknown, (i, -1)
        steps, j = [], n
        while j:
            i, p = back[j]
            steps.append((i, j, p))
            j = i
        return self._spell(raw, steps[::-1])

    def many(self, raws: list[bytes]) -> list[list[int]]:
        """Viterbi paths of byte strings of at most LONG bytes, all at once."""
        n, width = len(raws), max(map(len, raws))
        size = np.fromiter(map(len, raws), np.int64, n)
        text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(n, width).astype(np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        back, piece = np.zeros((n, width + 1), np.int16), np.full((n, width + 1), -1, np.int32)
        start = (text & 0xC0) != 0x80
        after = np.full((n, width + 1), width, np.int64)  # the next place at which a character begins or the text ends
        nxt = size.copy()
        for i in range(width - 1, -1, -1):
            after[:, i] = np.where(i < size, nxt, 0)
            nxt = np.where(start[:, i] & (i < size), i, nxt)
        for i in range(width):
            row = np.flatnonzero((i < size) & start[:, i])
            if not len(row):
                continue
            here = best[row, i]
            r, h, state = row, here, np.zeros(len(row), np.int32)
            for j in range(i, width):
                to = np.minimum(base[state] + text[r, j] + 1, len(check) - 1)
                ok = (check[to] == state) & (j < size[r])
                if not ok.any():
                    break
                r, h, state = r[ok], h[ok], to[ok]
                p = value[state]
                end = p >= 0
                if end.any():
                    rr, pp = r[end], p[end]
                    s = h[end] + self.scores[pp]
                    up = s > best[rr, j + 1]
                    rr = rr[up]
                    best[rr, j + 1], back[rr, j + 1], piece[rr, j + 1] = s[up], i, pp[up]
            to = after[row, i]
            up = here + self.unknown > best[row, to]
            rr, to = row[up], to[up]
            best[rr, to], back[rr, to], piece[rr, to] = here[up] + self.unknown, i, -1
        # all paths from their ends: column k holds the k-th piece from the end, -2 before the path's start
        at, rows, columns = size.copy(), np.arange(n), []
        while at.any():
            columns.append(np.where(at > 0, piece[rows, at], -2))
            at = np.where(at > 0, back[rows, at], 0)
        path = np.stack(columns[::-1], 1)
        skip, plain = (path == -2).sum(1).tolist(), (path != -1).all(1).tolist()
        out = [x[k:] for x, k in zip(path.tolist(), skip, strict=True)]
        for i in np.flatnonzero(~np.array(plain)).tolist():
            steps, j = [], int(size[i])
            while j:
                steps.append((int(back[i, j]), j, int(piece[i, j])))
                j = steps[-1][0]
            out[i] = self._spell(raws[i], steps[::-1])
        return out

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = list(words)
        new.sort(key=len)  # words of like length share a batch
        raws = [w.replace(" ", MARK).encode("utf-8", "surrogatepass") for w in new]
        for at in range(0, len(new), 8192):
            short = [k for k in range(at, min(at + 8192, len(new))) if len(raws[k]) <= LONG]
            if short:
                self.cache.update(zip([new[k] for k in short], self.many([raws[k] for k in short]), strict=True))
            for k in range(at, min(at + 8192, len(new))):
                if len(raws[k]) > LONG:
                    self.cache[new[k]] = self.one(raws[k])

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each text."""
        parts: list[list[list[str]] | None] = []
        for t in texts:
            if not t:
                parts.append([] if t is not None else None)
                continue
            own = (" " + t).split(MARK)
            parts.append([(self.split.findall(x) if self.split else [x]) if x else [] for x in own])
        if self.split is None:
            solve = lambda ws: list(chain.from_iterable(self.one(w.replace(" ", MARK).encode("utf-8", "surrogatepass")) for w in ws))
        else:
            self._learn({w for p in parts if p for ws in p for w in ws})
            solve = lambda ws: list(chain.from_iterable(map(self.cache.__getitem__, ws)))
        mark = [self.byte_ids[b] for b in MARK.encode()]
        out: list[list[int] | None] = []
        for p in parts:
            if p is None:
                out.append(None)
                continue
            ids: list[int] = []
            for k, ws in enumerate(p):
                ids += (mark if k else []) + solve(ws)
            out.append(ids)
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        raw = b"".join(map(self.out.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file that has byte pieces.

    Scores of a unigram model are its log probabilities. A merge-order model has merge ranks instead (whole numbers from
    0 down); these become the log probabilities of a Zipf law over the ranks.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    bytes_at = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
    byte_ids = [bytes_at[f"<0x{b:02X}>"] for b in range(256)]
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    own = scores[plain]
    if len(own) and (own == np.round(own)).all():
        rank = np.maximum(-scores, 0) + 1
        scores = -np.log(rank) - np.log(np.sum(1 / rank[plain]))
    return Vocabulary([sp.id_to_piece(i) if plain[i] else "" for i in range(n)], scores.tolist(), byte_ids)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text and ids (array of int) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        for whole in it:
            for batch in slices(whole, "text", CHUNK):
                ids = shared.value.encode(batch.column("text").to_pylist())
                flat = np.fromiter(chain.from_iterable(x or () for x in ids), np.int32)
                ends = pa.array(np.cumsum([0, *(len(x or ()) for x in ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array([x is None for x in ids], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["doc_id", "text", "ids"])
        shared.value.cache.clear()  # the worker may wait for other tasks

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded (doc_id, text, ids) with the column decoded: the text that ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        for batch in it:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
            own = zip(ids.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True)
            texts = [shared.value.decode(flat[a:b].tolist()) if ok else None for ok, a, b in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "text", "ids"), run, "doc_id long, text string, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text, n_tokens, ids_hash and whether decoding gives the text again."""
    back = decode(encode(docs, vocabulary), vocabulary)
    return back.select(
        "doc_id",
        "text",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
