"""Repair of the structure of conversations, by bidirectional Dijkstra over the edit lattice.

Rows of a conversation are kept, given another role, deleted or added, so that the roles read ``(s?(ua)+)?`` at the least cost. The lattice's nodes
are (rows done, state of that expression). From both ends heaps settle nodes by cost; when the sum of their least costs passes the best
crossing, every crossing of that cost is known, and the least concatenated audit (one letter an edit: D, I, K, R) is taken.

A conversation of any size is worked on in blocks of BLOCK rows of a partition that is sorted by conversation and turn: a block's cheapest edits are worked out for
every state at its begin and its end, and blocks are joined by these costs and by the audits' order alone. An audit ends with a row's edit in every block but for the
last, so that none is the beginning of another and the least whole audit is made of least parts. The SHA-256 of a repaired conversation depends on all its bytes in turn; one
task reads a conversation's sorted rows as a stream for it and holds a batch of them, and the audit.

Null roles and texts, and null ids and turns in the key of the damage, are one space. Rows with null conv_id are one conversation. Rows that share a
turn are taken by role, then by the SHA-256 of role and text; repeated rows follow each other. Rows without turn come first. A conversation of
which all rows are dropped has zeros, an empty audit and the hash of an empty string. An empty table gives no rows. Only conv_id, turn, role and text are read,
whatever other columns exist.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, map_batches, partitions_for

#: Rows of a block.
BLOCK = 512
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. A repaired conversation ends in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a state asks for of a row that is added or gets another role, and what comes then.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: What is left to add at a conversation's end, by state.
CLOSING = ("", "II", "I", "")
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Texts without anything but white space, and texts that end in a full stop or the like.
BLANK = r"^[\x20\x09-\x0D]*\z"
COMPLETE = r"[.!?][\x20\x09-\x0D]*\z"
#: Repaired conversations' searches that a task remembers.
REMEMBERED = 20_000


def _edges(code: str, i: int, q: int, n: int, open_end: bool):
    """(edit, cost, rows done, state) of what can follow a node."""
    if i < n or open_end:
        yield "I", INSERT, i, NEXT[q][1]
    if i < n:
        yield "D", DELETE, i + 1, q
        c = code[i]
        if c != "D":
            extra = TRUNCATED if c.isupper() else 0
            yield "R", RENAME + extra, i + 1, NEXT[q][1]
            if (q, c.lower()) in STEP:
                yield "K", extra, i + 1, STEP[q, c.lower()]


def _edges_back(code: str, i: int, q: int, n: int, open_end: bool):
    """(edit, cost, rows done, state) of what can come before a node."""
    if i < n or open_end:
        for p in range(4):
            if NEXT[p][1] == q:
                yield "I", INSERT, i, p
    if i > 0:
        yield "D", DELETE, i - 1, q
        c = code[i - 1]
        if c != "D":
            extra = TRUNCATED if c.isupper() else 0
            for p in range(4):
                if NEXT[p][1] == q:
                    yield "R", RENAME + extra, i - 1, p
                if STEP.get((p, c.lower())) == q:
                    yield "K", extra, i - 1, p


@lru_cache(REMEMBERED)
def cheapest(code: str, start: int, ends: tuple[int, ...], open_end: bool) -> tuple[int, str] | None:
    """(cost, least audit) from state start before the rows of code to one of the states ends after them; None if there is no way.

    code has a letter a row: D if it must go, else its role's initial (x: no role that a state takes), upper case if truncated. open_end: rows may
    be added after the last one.
    """
    n = len(code)
    # settled by a side: node -> (cost, audit of that side); nodes leave a heap by cost, and at equal cost in the order of rows, so that an audit is final then
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, q): (0, "") for q in ends}
    done: tuple[set, set] = (set(), set())
    heaps: tuple[list, list] = ([(0, 0, start)], [(0, -n, q) for q in ends])
    heapq.heapify(heaps[1])
    best: tuple[int, str] | None = None

    def meet(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    least = lambda side: heaps[side][0][0] if heaps[side] else 0
    while (heaps[0] or heaps[1]) and (best is None or least(0) + least(1) <= best[0]):
        side = 0 if heaps[0] and (not heaps[1] or least(0) <= least(1)) else 1
        known, edges, sign = ((ahead, _edges, 1), (back, _edges_back, -1))[side]
        cost, i, q = heapq.heappop(heaps[side])
        node = (sign * i, q)
        if node in done[side]:
            continue
        done[side].add(node)
        cost, audit = known[node]
        other = (back, ahead)[side]
        if node in done[1 - side]:
            meet(cost + other[node][0], audit + other[node][1] if side == 0 else other[node][1] + audit)
        for edit, more, j, p in edges(code, *node, n, open_end):
            new = (cost + more, audit + edit if side == 0 else edit + audit)
            if (j, p) in done[1 - side]:
                meet(new[0] + other[j, p][0], new[1] + other[j, p][1] if side == 0 else other[j, p][1] + new[1])
            if (j, p) not in done[side] and ((j, p) not in known or new < known[j, p]):
                known[j, p] = new
                heapq.heappush(heaps[side], (new[0], sign * j, p))
    return best


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with every fifth or so of its rows damaged, by the CRC-32 of conv_id:turn; column gone: the row is dropped. Other columns are left out."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_PIECE = pa.schema([(c, pa.int64()) for c in ("conv_id", "part", "place", "blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high")] + [("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))])
_PIECE_SQL = "conv_id long, part long, place long, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, whole boolean, first string, last string, costs array<int>, ranks array<int>, audits array<string>"
LEGAL = {"su", "ua", "au"}


class _Run:
    """Rows of one conversation that follow each other in a partition, at most BLOCK of them."""

    def __init__(self, conv_id):
        self.conv_id, self.code, self.counts, self.illegal = conv_id, [], dict.fromkeys("bdt", 0), 0
        self.first = self.last = None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn, initial, fault) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if fault:
            self.counts[fault] += 1
        letter = initial if initial in "sua" and initial else "x"
        self.code.append("D" if fault in ("b", "d") else letter.upper() if fault == "t" else letter)

    def row(self, place: int, whole: bool) -> tuple:
        code = "".join(self.code)
        if whole:
            found = [cheapest(code, START, ENDS, True)]
            costs, audits, ranks = [found[0][0]], [found[0][1]], [0]
        else:
            found = [cheapest(code, s, (e,), False) for s in range(4) for e in range(4)]
            costs, audits = [x[0] if x else -1 for x in found], [x[1] if x else "" for x in found]
            ranks = [sorted(audits).index(a) for a in audits]
        return (self.conv_id, None, place, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.turns, self.low, self.high, whole, self.first, self.last, costs, ranks, audits)


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the conversations of damage()'s rows, in the order of (part, place): counts, and the cheapest edits.

    whole: the block is all of its conversation; costs and audits hold one way then. Otherwise they hold 16, from each state to each state (cost -1: none), and ranks their order.
    """
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    fault = F.when(F.col("text").rlike(BLANK), "b").when(~F.col("text").rlike(COMPLETE), "t").otherwise("")
    rows = rows.select("conv_id", "turn", "role", digest.alias("digest"), fault.alias("fault"), (~F.col("gone")).cast("int").alias("n"))
    distinct = rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    here = distinct.withColumns({"none": F.col("conv_id").isNull(), "id": F.coalesce("conv_id", F.lit(0))})
    earliest = here.where("n > 0").groupBy("none", "id", "digest").agg(F.min(place).alias("earliest"))
    marked = here.join(earliest, ["none", "id", "digest"], "left").withColumn("again", ~F.col("earliest").eqNullSafe(place))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = marked.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "fault", "again", "n")
    dealt = dealt.repartitionByRange(partitions_for(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(it):
        at, out, state = 0, [], None  # state: the conversation's open block, and whether it is its first block and not the partition's
        first_run, begun = True, False

        def flush():
            columns = {f.name: [r[k] for r in out] for k, f in enumerate(_PIECE)}
            out.clear()
            yield from batches(columns, _PIECE)

        def close(whole: bool) -> None:
            nonlocal at
            out.append(state.row(at, whole))
            at += 1

        for batch in it:
            for conv_id, turn, initial, fault, again, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6, 7)), strict=True):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        close(not first_run and not begun)
                        first_run = False
                    state, begun = _Run(conv_id), False
                for copy in range(n):
                    if len(state.code) == BLOCK:
                        close(False)
                        state, begun = _Run(conv_id), True
                    state.add(turn, initial, "b" if fault == "b" else "d" if again or copy else fault)
            if len(out) >= 1000:
                yield from flush()
        if state is not None:  # the partition's last conversation may go on in the next one
            close(False)
        yield from flush()

    found = map_batches(dealt, run, _PIECE_SQL)
    return found.withColumn("part", F.spark_partition_id().cast("long"))


def join_blocks(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, place, way, cost, closing): of each block of a split conversation, which of its 16 ways is taken.

    What meets in a task is a block's 16 costs and ranks, for BLOCK rows of a conversation.
    """

    def settle(key, found):
        rows = found.sort_values(["part", "place"])
        costs, ranks = [list(x) for x in rows["costs"]], [list(x) for x in rows["ranks"]]
        n = len(costs)
        rest = [[0, 0, 0, 0] for _ in range(n + 1)]
        rest[n] = [len(x) * INSERT for x in CLOSING]
        for i in range(n - 1, -1, -1):
            rest[i] = [min(costs[i][4 * s + e] + rest[i + 1][e] for e in range(4) if costs[i][4 * s + e] >= 0) for s in range(4)]
        state, ways = START, []
        for i in range(n):
            # of the states that a cheapest way may have next, that with the least audit of this block; none of these audits begins another
            e = min((e for e in range(4) if costs[i][4 * state + e] >= 0), key=lambda e: (costs[i][4 * state + e] + rest[i + 1][e], ranks[i][4 * state + e]))
            ways.append(4 * state + e)
            state = e
        closing = [""] * (n - 1) + [CLOSING[state]]
        return rows.assign(way=ways, cost=rest[0][START], closing=closing)[["conv_id", "part", "place", "way", "cost", "closing"]]

    small = pieces.select(F.col("conv_id").isNull().alias("none"), "conv_id", "part", "place", "costs", "ranks")
    return small.groupBy("none", "conv_id").applyInPandas(settle, "conv_id long, part long, place long, way int, cost long, closing string")


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of damage()'s rows."""
    pieces = cut(blocks(rows), "blocks")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    done = pieces.where("whole").select("conv_id", "n_turns", "low", "high", *counts, F.col("costs")[0].cast("long").alias("cost"), F.col("audits")[0].alias("audit"))
    some = pieces.where("not whole").withColumns({"none": F.col("conv_id").isNull(), "id": F.coalesce("conv_id", F.lit(0))})
    ways = join_blocks(some).select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id"), "part", "place", "way", "cost", "closing")
    turn = Window.partitionBy("none", "id").orderBy("part", "place")  # a row for each block, without its audits
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    seen = some.select("none", "id", "conv_id", "part", "place", "n_turns", "low", "high", "first", "last", *counts)
    seen = seen.withColumns({"last_turn": F.last("high", ignorenulls=True).over(before), "last_role": F.last("last", ignorenulls=True).over(before)})
    across = F.when(F.concat("last_role", "first").isin(*LEGAL), 0).when(F.col("last_role").isNotNull() & F.col("first").isNotNull(), 1).otherwise(0)
    joined = seen.withColumns({"illegal": F.col("illegal") + across, "n_turns": F.col("n_turns") - F.coalesce((F.col("last_turn") == F.col("low")).cast("long"), F.lit(0))})
    taken = joined.join(ways, ["none", "id", "part", "place"]).join(some.select("none", "id", "part", "place", "audits"), ["none", "id", "part", "place"])
    part = F.struct("part", "place", F.concat(F.get("audits", "way"), F.col("closing")).alias("audit"))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["audit"]), "")
    split = taken.groupBy("none", "id").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n_turns").alias("n_turns"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(c).alias(c) for c in counts], F.max("cost").alias("cost"), audit.alias("audit"),
    ).drop("none", "id")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    return done.unionByName(split).select("conv_id", gaps.alias("gaps"), *counts, "cost", "audit")


_HASH = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


class _Repair:
    """Applies an audit to rows as they come, and hands what is left on."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role, self.state = NEXT[self.state]
            yield role, ""

    def row(self, role: str, text: str):
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state, role[:1]]
            yield role, text
        elif edit == "R":
            role, self.state = NEXT[self.state]
            yield role, text


def _streamed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, kind, audit, turn, role, text): of every conversation one row of kind 0 with the audit, then its rows in order."""
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    none = lambda t: F.lit(None).cast(t)
    texts = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), none("string").alias("audit"), "turn", "role", digest.alias("digest"), "text")
    heads = plan.select("conv_id", F.lit(0).alias("kind"), "audit", none("long").alias("turn"), F.lit("").alias("role"), none("binary").alias("digest"), none("string").alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    return texts.unionByName(heads).repartition(partitions_for(rows.sparkSession), "conv_id").sortWithinPartitions(*order).drop("digest", "turn")


def _repaired(it, begin, take, end):
    """Walks through batches of _streamed(): begin(conv_id), take(role, text) for each repaired row, end()."""
    open_one = None
    for batch in it:
        for conv_id, kind, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "audit", "role", "text")), strict=True):
            if kind == 0:
                if open_one is not None:
                    for x in open_one.inserts():
                        take(*x)
                    end()
                open_one = _Repair(audit)
                begin(conv_id)
            else:
                for x in open_one.row(role, text):
                    take(*x)
        yield
    if open_one is not None:
        for x in open_one.inserts():
            take(*x)
        end()
    yield


def hashes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of the repaired rows ``role:text``, joined by line feeds."""

    def run(it):
        out, hasher, empty = [], None, True

        def begin(conv_id):
            nonlocal hasher, empty
            hasher, empty = hashlib.sha256(), True
            out.append([conv_id, None])

        def take(role, text):
            nonlocal empty
            hasher.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
            empty = False

        def end():
            out[-1][1] = hasher.hexdigest()

        for _ in _repaired(it, begin, take, end):
            ready = [x for x in out if x[1]]
            del out[: len(ready)]
            if ready:
                yield from batches({"conv_id": [x[0] for x in ready], "repaired_sha256": [x[1] for x in ready]}, _HASH)

    return map_batches(_streamed(rows, plan), run, "conv_id long, repaired_sha256 string")


_ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations of damage()'s rows (or of rows with those columns)."""

    def run(it):
        out, now, place = [], None, 0

        def begin(conv_id):
            nonlocal now, place
            now, place = conv_id, 0

        def take(role, text):
            nonlocal place
            out.append((now, place, role, text))
            place += 1

        for _ in _repaired(it, begin, take, lambda: None):
            if out:
                yield from batches({f.name: [x[k] for x in out] for k, f in enumerate(_ROWS)}, _ROWS)
                out.clear()

    return map_batches(_streamed(rows, cut(plans(rows), "plans").select("conv_id", "audit")), run, "conv_id long, place long, role string, text string")


def summary(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged and repaired."""
    rows = damage(conversations)
    plan = cut(plans(rows), "plans")
    keyed = lambda d: d.withColumns({"none": F.col("conv_id").isNull(), "id": F.coalesce("conv_id", F.lit(0))})
    ends = keyed(hashes(rows, plan.select("conv_id", "audit"))).drop("conv_id")
    return keyed(plan).join(ends, ["none", "id"]).drop("none", "id")


def _sql() -> str:
    """The same in SQL: one cheapest label (cost and audit, repaired text) a state, row after row, for tables in which conv_id and turn tell rows apart."""

    def add(label: str, cost: str, edit: str, item: str | None = None) -> str:
        out = f"{label}[2]" if item is None else f"CASE WHEN {label}[2] = '' THEN {item} ELSE {label}[2] || chr(10) || {item} END"
        return f"CASE WHEN {label} IS NOT NULL THEN [lpad((left({label}[1], 9)::INT + {cost})::VARCHAR, 9, '0') || substr({label}[1], 10) || '{edit}', {out}] END"

    least = lambda *labels: f"list_sort([{', '.join(labels)}])[1]"
    only = lambda when, label: f"CASE WHEN {when} THEN {label} END"
    added = f"""SELECT * EXCLUDE (u, a), {least('u', *[add(x, str(INSERT), 'I', "'user:'") for x in ('b', 's', 'a')])} AS u, a FROM {{}}"""
    closed = f"""SELECT * EXCLUDE (a), {least('a', add('u', str(INSERT), 'I', "'assistant:'"))} AS a FROM ({added})"""
    item = "role || ':' || text"
    to_user = [x for f in ("b", "s", "a") for x in (only("NOT gone", add(f, f"{RENAME} + more", "R", "'user:' || text")), only("NOT gone AND initial = 'u'", add(f, "more", "K", item)))]
    to_assistant = [only("NOT gone", add("u", f"{RENAME} + more", "R", "'assistant:' || text")), only("NOT gone AND initial = 'a'", add("u", "more", "K", item))]
    dropped = lambda x: add(x, str(DELETE), "D")
    return f"""
WITH RECURSIVE bytes AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT FOR k IN range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(substr(k, i, 1))::UBIGINT FOR i IN range(1, length(k) + 1)]),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256)::INT + 1])), 4294967295::UBIGINT) % 20 AS kind FROM keyed, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), told AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged
), rows AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS duplicate, bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM told
), codes AS (SELECT conv_id, i, role, text, initial, blank OR duplicate AS gone, CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END AS more FROM rows
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, ['000000000', ''] AS b, NULL::VARCHAR[] AS s, NULL::VARCHAR[] AS u, NULL::VARCHAR[] AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {dropped('b')}, {least(dropped('s'), only("NOT gone AND initial = 's'", add('b', 'more', 'K', item)))},
    {least(dropped('u'), *to_user)}, {least(dropped('a'), *to_assistant)}
  FROM ({closed.format("(SELECT p.conv_id, c.i, p.b, p.s, p.u, p.a, c.role, c.text, c.initial, c.gone, c.more FROM paths p JOIN codes c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1)")})
), ends AS (SELECT conv_id, {least('b', 'a')} AS best FROM ({closed.format("(SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)")})
), counted AS (
  SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM rows GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, left(best[1], 9)::BIGINT AS cost, substr(best[1], 10) AS audit, sha256(best[2]) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL = _sql()
