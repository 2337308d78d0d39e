"""Near-duplicate vectors by collision counting over one-dimensional projections.

Random trees cut the unit sphere: each of a tree's levels splits at a projection's middle. A vector is stored in one cell of
each tree and asks in every cell within MARGIN of a split of its own projections, a window centred on the asking vector.
Within a cell, PROJECTIONS further projections are sorted; for each, the asking vector's window of WIDTH either way
holds the vectors that collide with it. Pairs that collide at least calibrated() times are verified by their cosine in
double precision. Depth follows the number of vectors, and the number of trees follows the depth (trees()), so that a
pair at the threshold meets with a probability of RECALL and is counted often enough with the same probability, at any table size.

Cells are compared in tiles of TILE vectors and blocks of BLOCK rows; only sums and spanning edges leave a tile, never its pairs. A
pair that meets in several trees or in both directions counts once: it belongs to the first meeting.

Crowds of near copies are not compared pair by pair: a ball holds vectors within half the threshold's angle of its
centre, so all of them link. In the trees a ball is one row, stored wherever a member would be. Of two balls the angle between
the centres, plus or minus the radii, tells that all members link or none; only where it doesn't are the members compared, in
tiles of their own. Equal vectors are compared once and counted by their number; they always link.

Vectors are compared with those of their own length. Vectors that are null, empty, zero, or that hold a null or non-finite number
link with nothing; rows that repeat a vec_id are separate rows with equal ids, a row without vec_id stays without
links. An empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, connected_components, cut

MARGIN, PROJECTIONS, WIDTH, RECALL = 0.1, 24, 0.75, 0.995
#: Vectors of a cell to aim at, rows of a tile's side, and of a block that is compared at once; pairs that are looked at at once.
CELL, TILE, BLOCK, PAIRS = 512, 2048, 256, 1 << 15
#: Vectors within a ball, at least, and rounds of gathering: each makes a crowd smaller by up to TILE.
BALL, ROUNDS, SLACK = 32, 2, 1e-6
_CELLS = pa.schema([("dim", pa.int32()), ("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("home", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
_BALLS = pa.schema([("id", pa.int64()), ("ball", pa.int64()), ("r", pa.float64()), ("v", pa.binary())])
#: Kinds of found rows: links of a, an edge, balls of which all members link, balls whose members must be compared.
SUM, EDGE, ALL, SOME = range(4)


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


@lru_cache(maxsize=64)
def trees(depth: int, threshold: float) -> int:
    """Trees of a depth in which a pair of unit vectors at the threshold meets with probability RECALL."""
    if not depth:
        return 1
    x = np.linspace(0, 6, 6001)
    weight = 2 * np.exp(-(x**2) / 2) / math.sqrt(2 * math.pi) * (x[1] - x[0])
    weight[0] /= 2
    spread = math.sqrt(max(1e-12, 1 - threshold**2))
    same = _phi(threshold * x / spread)  # the other's projection has the same sign
    one = float((weight * np.where(x <= MARGIN, 1.0, same)).sum())
    close = _phi((MARGIN + threshold * x) / spread) - _phi(threshold * x / spread)  # another sign, within the margin
    both = float((weight * (same + np.where(x <= MARGIN, close, 0.0))).sum())
    meets = min(1 - 1e-9, 2 * one**depth - both**depth)
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meets)))


def calibrated(distance: float) -> int:
    """Collisions that a pair of vectors at a distance reaches with probability RECALL."""
    p = math.erf(WIDTH / distance / math.sqrt(2)) if distance else 1.0
    left = 1.0
    for k in range(PROJECTIONS + 1):
        left -= math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if left < RECALL:
            return k
    return 0


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares of very large or small numbers are finite."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


class Trees:
    """The trees for vectors of one length, the same in every task."""

    def __init__(self, dim: int, depth: int, threshold: float, seed: int = 11):
        self.dim, self.depth, self.n = dim, depth, trees(depth, threshold)
        rng = np.random.default_rng([seed, dim])
        self.lines = rng.standard_normal((dim, PROJECTIONS))
        self.splits = rng.standard_normal((self.n, depth, dim))
        self.bits = 1 << np.arange(depth, dtype=np.int64)

    def codes(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(home cell, bits of the splits that a vector is far from) of each vector."""
        sides = np.einsum("nd,kd->nk", x, self.splits[tree])
        return (sides > 0) @ self.bits, (np.abs(sides) > MARGIN) @ self.bits

    def asks(self, home: int, far: int) -> list[int]:
        """The cells in which a vector asks."""
        cells = [home]
        for bit in self.bits.tolist():
            if not far & bit:
                cells += [c ^ bit for c in cells]
        return cells


def meets(asking: tuple[np.ndarray, np.ndarray], stored: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether row i's asking vector looks into row i's stored one's cell."""
    return ((asking[0] ^ stored[0]) & asking[1]) == 0


@lru_cache(maxsize=8)
def _trees(dim: int, depth: int, threshold: float) -> Trees:
    return Trees(dim, depth, threshold)


class Side:
    """Rows of one side of a tile: ids, how many rows of the table each stands for, radii, unit vectors."""

    def __init__(self, rows: list[tuple], narrow: bool):
        self.ids, self.n, self.r = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
        raw = [np.frombuffer(r[3], np.float32 if narrow and not r[2] else np.float64).astype(np.float64) for r in rows]
        self.x = _unit(np.array(raw)) if raw else np.empty((0, 0))

    def part(self, rows) -> Side:
        out = object.__new__(Side)
        out.ids, out.n, out.r, out.x = self.ids[rows], self.n[rows], self.r[rows], self.x[rows]
        return out


def _collisions(t: Trees, ask: Side, have: Side):
    """(rows of ask, their collision counts with each row of have), block by block."""
    p_q, p_s = ask.x @ t.lines, have.x @ t.lines
    lo, hi, place = [], [], []
    for k in range(PROJECTIONS):
        order = np.argsort(p_s[:, k], kind="stable")
        line = p_s[order, k]
        lo.append(np.searchsorted(line, p_q[:, k] - WIDTH, "left").astype(np.int32))
        hi.append(np.searchsorted(line, p_q[:, k] + WIDTH, "right").astype(np.int32))
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        place.append(at)
    for at in range(0, len(ask.ids), BLOCK):
        rows = slice(at, min(at + BLOCK, len(ask.ids)))
        count = np.zeros((rows.stop - at, len(have.ids)), np.uint8)
        for k in range(PROJECTIONS):
            count += (place[k] >= lo[k][rows, None]) & (place[k] < hi[k][rows, None])
        yield rows, count


def _cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs of rows i of x and j of y, in double precision."""
    return np.einsum("nd,nd->n", x[i], y[j])


def _single_pairs(t: Trees, tree: int | None, ask: Side, have: Side, threshold: float):
    """Verified pairs (i, j) of a tile that belong to it, at most PAIRS at a time. tree None: all of them do."""
    least = calibrated(math.sqrt(2 - 2 * threshold))
    codes = [] if tree is None else [(t.codes(ask.x, k), t.codes(have.x, k)) for k in range(tree + 1)]
    for rows, count in _collisions(t, ask, have):
        for i, j in _some_at_a_time(np.nonzero(count >= least)):  # only these are verified
            i = i + rows.start
            keep = (ask.ids[i] != have.ids[j]) & (_cosines(ask.x, i, have.x, j) >= threshold)
            i, j = i[keep], j[keep]
            # the first meeting: trees in order, the smaller id asking before the larger one
            taken = np.zeros(len(i), bool)
            for k, (q, s) in enumerate(codes):
                a, b = (q[0][i], q[1][i]), (s[0][j], s[1][j])
                taken |= meets(a, b) | meets(b, a) if k < tree else (ask.ids[i] > have.ids[j]) & meets(b, a)
            yield i[~taken], j[~taken]


def _some_at_a_time(pairs):
    for at in range(0, len(pairs[0]), PAIRS):
        yield pairs[0][at : at + PAIRS], pairs[1][at : at + PAIRS]


def _ball_pairs(t: Trees, ask: Side, have: Side, threshold: float):
    """(kind, smaller id, larger id) of pairs of which one is a ball and members may link."""
    theta = math.acos(threshold)
    # collisions to ask for, by the radii's sum in sixteenths of the threshold's angle
    least = np.array([calibrated(2 * math.sin(min(math.pi, theta * (1 + k / 16)) / 2)) for k in range(17)], np.uint8)
    for rows, count in _collisions(t, ask, have):
        reach = ask.r[rows, None] + have.r[None, :]
        level = np.minimum(16, np.ceil(reach / theta * 16)).astype(np.int64)
        for i, j in _some_at_a_time(np.nonzero((reach > 0) & (count >= least[level]))):
            wide = reach[i, j]
            i = i + rows.start
            angle = np.arccos(np.clip(_cosines(ask.x, i, have.x, j), -1, 1))
            a, b = ask.ids[i], have.ids[j]
            near = (angle <= theta + wide + SLACK) & (a != b)
            both = angle + wide <= theta - SLACK
            yield np.unique(np.stack((np.where(both, ALL, SOME), np.minimum(a, b), np.maximum(a, b)), 1)[near], axis=0)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least one of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    own = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[own], nodes[low[own]]


def _compared(t: Trees, tree: int | None, ask: Side, have: Side, threshold: float):
    """Found rows (arrays kind, a, b, links) of a tile."""
    q, s = np.flatnonzero(ask.r == 0), np.flatnonzero(have.r == 0)
    ask_one, have_one = ask.part(q), have.part(s)
    links_q, links_s, edges = np.zeros(len(q), np.int64), np.zeros(len(s), np.int64), []
    if len(q) and len(s):
        for i, j in _single_pairs(t, tree, ask_one, have_one, threshold):
            if len(i):
                links_q += np.bincount(i, have_one.n[j], len(q)).astype(np.int64)
                links_s += np.bincount(j, ask_one.n[i], len(s)).astype(np.int64)
                edges.append(_spanning(ask_one.ids[i], have_one.ids[j]))
    for ids, links in ((ask_one.ids, links_q), (have_one.ids, links_s)):
        some = np.flatnonzero(links)
        yield np.full(len(some), SUM), ids[some], np.zeros(len(some), np.int64), links[some]
    if edges:
        a, b = _spanning(*(np.concatenate(x) for x in zip(*edges, strict=True)))
        yield np.full(len(a), EDGE), a, b, np.zeros(len(a), np.int64)
    balls_q, balls_s = np.flatnonzero(ask.r > 0), np.flatnonzero(have.r > 0)
    for x, y in ((ask.part(balls_q), have), (ask_one, have.part(balls_s))):
        if len(x.ids) and len(y.ids):
            for f in _ball_pairs(t, x, y, threshold):
                yield f[:, 0], f[:, 1], f[:, 2], np.zeros(len(f), np.int64)


def _balls(x: np.ndarray, r: np.ndarray, reach: float, least: int):
    """(members, centre, radius) of balls of radius reach at most with so many members at least; no member is in two."""
    left = r < reach
    for seed in range(len(x)):
        if not left[seed]:
            continue
        near = np.flatnonzero(left & (x @ x[seed] >= math.cos(reach)))
        left[seed] = False  # of no further seed's ball, unless of its own
        if len(near) < least:
            continue
        centre = _unit(x[near].mean(0, keepdims=True))[0]
        angle = np.arccos(np.clip(x[near] @ centre, -1, 1)) + r[near] + SLACK
        kept = np.flatnonzero(angle <= reach)
        if len(kept) >= least:
            left[near[kept]] = False
            yield near[kept], centre, float(angle[kept].max())


def _grid(rows: DataFrame, keys: list[str], own: Column, other: Column) -> DataFrame:
    """rows (keys, asks, id, ...) once for each tile that they take part in: own, other are the tiles that each side is cut into."""
    part = lambda n: F.pmod(F.xxhash64("id"), n)
    whole = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    asked = rows.where("asks").withColumn("own", part(own)).withColumn("other", F.explode(whole(other)))
    stored = rows.where("not asks").withColumn("other", part(other)).withColumn("own", F.explode(whole(own)))
    columns = [*keys, "own", "other", "asks", "id", "n", "r", "v"]
    return asked.select(*columns).unionByName(stored.select(*columns))


def _compare(tiles: DataFrame, threshold: float, narrow: bool, in_trees: bool) -> DataFrame:
    """Found rows of all tiles (dim, depth, k1, k2, own, other, asks, id, n, r, v)."""

    def run(it):
        held, key = [], None

        def done():
            ask, have = (Side([r[1:] for r in held if r[0] == which], narrow) for which in (True, False))
            if len(ask.ids) and len(have.ids):
                t = _trees(key[0], key[1], threshold)
                for found in _compared(t, key[2] if in_trees else None, ask, have, threshold):
                    yield from batches(dict(zip(_FOUND.names, found, strict=True)), _FOUND)

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:6] != key and held:
                    yield from done()
                    held = []
                key = row[:6]
                held.append(row[6:])
        if held:
            yield from done()

    keys = ["dim", "depth", "k1", "k2", "own", "other"]
    spread = tiles.select(*keys, "asks", "id", "n", "r", "v").repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, "kind int, a long, b long, links long")


def _dealt(rows: DataFrame, threshold: float, narrow: bool, first_only: bool = False, with_vectors: bool = True) -> DataFrame:
    """rows (dim, depth, id, n, r, v) by tree (k1) and cell (k2); first_only: the home cells of the first tree."""

    def run(it):
        for batch in it:
            dims, depths, ids, ns, rs, vs = (c.to_pylist() for c in batch.columns)
            groups: dict[tuple[int, int], list[int]] = {}
            for k, kind in enumerate(zip(dims, depths, strict=True)):
                groups.setdefault(kind, []).append(k)
            for (dim, depth), own in groups.items():
                t, side = _trees(dim, depth, threshold), Side([(ids[k], ns[k], rs[k], vs[k]) for k in own], narrow)
                for tree in range(1 if first_only else t.n):
                    home, far = (x.tolist() for x in t.codes(side.x, tree))
                    out = [
                        (dim, depth, tree, c, c == h, ids[k], ns[k], vs[k] if with_vectors else None)
                        for k, h, f in zip(own, home, far, strict=True)
                        for c in ([h] if first_only else t.asks(h, f))
                    ]
                    yield from batches({f.name: [r[m] for r in out] for m, f in enumerate(_CELLS)}, _CELLS)

    return rows.select("dim", "depth", "id", "n", "r", "v").mapInArrow(run, "dim int, depth int, k1 long, k2 long, home boolean, id long, n long, v binary")


def _gathered(rows: DataFrame, threshold: float, narrow: bool, least: int) -> DataFrame:
    """(id, ball, r, v) of the rows (dim, depth, id, n, r, v) that lie in balls; r and v, radius and centre, only at one row of each ball."""
    reach = math.acos(threshold) / 2 - SLACK
    cells = ["dim", "k2"]
    crowded = _dealt(rows, threshold, narrow, first_only=True, with_vectors=False).groupBy(*cells).count().where(F.col("count") > TILE)
    across = F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1))
    homes = _dealt(rows, threshold, narrow, first_only=True).join(rows.select("id", "r"), "id").join(crowded, cells, "left")
    placed = homes.withColumn("part", F.pmod(F.xxhash64("id"), across))

    def run(it):
        held, key = [], None

        def done():
            side = Side(held, narrow)
            for own, centre, radius in _balls(side.x, side.r, reach, least):
                ids = side.ids[own].tolist()
                ball = min(ids)
                head = [i == ball for i in ids]
                yield from batches(
                    {"id": ids, "ball": [ball] * len(ids), "r": [radius if h else None for h in head], "v": [centre.tobytes() if h else None for h in head]}, _BALLS
                )

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key and held:
                    yield from done()
                    held = []
                key = row[:3]
                held.append(row[3:])
        if held:
            yield from done()

    spread = placed.select("dim", "k2", "part", "id", "n", "r", "v").repartition("dim", "k2", "part").sortWithinPartitions("dim", "k2", "part", "id")
    return cut(spread.mapInArrow(run, "id long, ball long, r double, v binary"), "vectors")


def _distinct(vectors: DataFrame) -> DataFrame:
    """(vec_id, w): w the vector as doubles, null where it links with nothing."""
    e = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("vec_id").isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.when(fine, F.transform(e, lambda x: x + F.lit(0.0))).alias("w"))


def _packed(rows: DataFrame, narrow: bool) -> DataFrame:
    """(dim, depth, id, n, r, v) of the distinct vectors: v their bytes in the type that holds the table's numbers exactly."""
    schema = pa.schema([("dim", pa.int32()), ("depth", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("r", pa.float64()), ("v", pa.binary())])

    def run(it):
        for batch in it:
            columns = {f.name: batch.column(k).to_pylist() for k, f in enumerate(schema)}
            columns["v"] = [np.array(v, np.float32 if narrow else np.float64).tobytes() for v in columns["v"]]
            yield from batches(columns, schema)

    sizes = rows.groupBy(F.size("w").alias("dim")).count()
    depth = F.greatest(F.ceil(F.log2(F.col("count") / CELL)), F.lit(0)).cast("int").alias("depth")
    sized = rows.withColumn("dim", F.size("w")).join(sizes.select("dim", depth), "dim")
    return sized.select("dim", "depth", "id", "n", F.lit(0.0).alias("r"), "w").mapInArrow(run, "dim int, depth int, id long, n long, r double, v binary")


def _in_cells(singles: DataFrame, members: DataFrame, balls: DataFrame, threshold: float, narrow: bool) -> DataFrame:
    """The tiles of all cells. A ball is in every cell that one of its members is in."""
    cells = ["dim", "depth", "k1", "k2"]

    def dealt(vectors: bool) -> DataFrame:
        own = _dealt(singles, threshold, narrow, with_vectors=vectors).withColumn("r", F.lit(0.0))
        each = _dealt(members, threshold, narrow, with_vectors=False).select(*cells, "home", "id")
        of_ball = each.join(members.select("id", "node"), "id").groupBy(*cells, F.col("node").alias("id")).agg(F.max("home").alias("home"))
        return own.unionByName(of_ball.join(balls.select("id", "n", "r", "v"), "id"))

    size = dealt(False).groupBy(*cells).agg(F.count("*").alias("rows"), F.count_if("home").alias("stored"))
    size = size.where("stored > 0 and rows > 1").select(*cells, F.ceil(F.col("rows") / TILE).alias("across"))
    placed = dealt(True).join(size, cells)
    sides = F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    return _grid(placed.withColumn("asks", sides), cells, F.col("across"), F.col("across"))


def _in_pairs(pairs: DataFrame, nodes: DataFrame, held: DataFrame) -> DataFrame:
    """The tiles of pairs (a, b) of nodes whose members must be compared."""
    sizes = [nodes.select(F.col("id").alias(c), F.ceil(F.col("members") / TILE).alias(f"tiles_{c}")) for c in "ab"]
    sized = pairs.join(sizes[0], "a").join(sizes[1], "b")
    asking = sized.join(held, sized.a == held.node).withColumn("asks", F.lit(True))
    stored = sized.join(held, sized.b == held.node).withColumn("asks", F.lit(False))
    both = asking.unionByName(stored).withColumn("k1", F.col("a")).withColumn("k2", F.col("b"))
    return _grid(both, ["dim", "depth", "k1", "k2"], F.col("tiles_a"), F.col("tiles_b"))


def link(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    narrow = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    rows = cut(_distinct(vectors), "vectors")
    one = rows.where("w is not null").groupBy("w").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    one = cut(one.withColumn("id", F.monotonically_increasing_id()), "vectors")
    packed = cut(_packed(one, narrow), "vectors")

    # vectors (id) in balls (node)
    gathered = _gathered(packed, threshold, narrow, BALL)
    member = gathered.select("id", F.col("ball").alias("node"))
    for _ in range(ROUNDS - 1):
        centres = gathered.where("v is not null").select("ball", "r", "v").withColumnRenamed("ball", "id")
        centres = cut(centres.join(packed.select("id", "dim", "depth", "n"), "id").select("dim", "depth", "id", "n", "r", "v"), "vectors")
        wider = _gathered(centres, threshold, narrow, 2)
        member = member.join(wider.select(F.col("id").alias("node"), "ball"), "node", "left").select("id", F.coalesce("ball", "node").alias("node"))
        stay = centres.join(wider.select("id"), "id", "left_anti").select("id", F.col("id").alias("ball"), "r", "v")
        gathered = cut(wider.unionByName(stay), "vectors")
    held = cut(packed.join(member, "id", "left").withColumn("node", F.coalesce("node", "id")), "vectors")
    centres = gathered.where("v is not null").select(F.col("ball").alias("id"), "r", "v")
    sums = held.groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("n"), F.count("*").alias("members"))
    nodes = cut(sums.join(centres, "id", "left"), "vectors")
    balls = nodes.where("v is not null")
    in_ball = held.join(balls.select(F.col("id").alias("node")), "node", "left_semi")
    singles = held.join(balls.select(F.col("id").alias("node")), "node", "left_anti")

    found = cut(_compare(_in_cells(singles, in_ball, balls, threshold, narrow), threshold, narrow, True), "vectors")
    pairs = cut(found.where(F.col("kind") >= ALL).select("kind", "a", "b").distinct(), "vectors")
    some = _in_pairs(pairs.where(F.col("kind") == SOME).select("a", "b"), nodes, held)
    found = found.where(F.col("kind") < ALL).unionByName(cut(_compare(some, threshold, narrow, False), "vectors"))

    # links by vector and by ball; components of balls and single vectors
    own = found.where(F.col("kind") == SUM).groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("own"))
    whole = pairs.where(F.col("kind") == ALL).select("a", "b")
    other = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(nodes.select(F.col("id").alias("b"), "n"), "b")
    other = other.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("other"))
    edges = found.where(F.col("kind") == EDGE).select("a", "b")
    for c in "ab":
        edges = edges.withColumnRenamed(c, "id").join(held.select("id", "node"), "id").withColumnRenamed("node", c).drop("id")
    groups = connected_components(edges.select("a", "b").union(whole)).withColumnRenamed("node", "at")
    labelled = held.select("id", "node").join(one.select("id", "first"), "id").join(groups, F.col("node") == F.col("at"), "left")
    labelled = cut(labelled.select("id", "node", "first", F.coalesce("component", "node").alias("component")), "vectors")
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    links = F.coalesce("own", F.lit(0)) + F.coalesce("other", F.lit(0)) + F.col("n") - 1
    label = labelled.join(least, "component").join(own, "id", "left").join(other, "node", "left")
    label = label.join(nodes.select(F.col("id").alias("node"), "n"), "node").select("id", "component_id", links.alias("links"))
    label = one.select("id", F.col("w").alias("x")).join(label, "id")
    out = rows.join(label, rows.w == label.x, "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same by DuckDB, comparing all pairs; for small tables.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept FROM v LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY 1) ON a = v.vec_id
JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) USING (vec_id)
"""
