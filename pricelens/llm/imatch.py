"""Document fingerprints by I-Match over randomised lexicons, in built-in functions only.

A text's terms are its distinct runs of letters, marks and digits, without case. The lexicon holds the terms in a band of inverse
document frequency: in one of MOST documents or fewer, and in one of LEAST or more, at least two. Of a text, the terms in a
randomised subset of the lexicon are kept, sorted and hashed, for several subsets. The subsets of level k are the first SLOTS of the 2^k parts
into which a term's SHA-256 deals the lexicon; a text has hashes of LEVELS levels, of which the first one follows from its number of terms, so that
long texts as well as short ones have subsets of which only a few of their terms, and few changes, are in. The fingerprint is a hash of all terms, the first
level (two hex digits) and the subsets' hashes (DIGITS hex digits each, zeros where a text has no term of a subset). The likeness of
two is the share of equal hashes among the subsets, of levels that both have, that either has a term of.

The lexicon's size doesn't follow the number of documents: it is at most LEAST times the mean number of terms of a document. It is
counted, and broadcast up to BROADCAST terms; beyond, it is joined by a shuffle.

Null and empty texts, and others without a term, are one term as a whole; where no subset holds a term of a text, its hash of all terms
is left. So equal texts have equal fingerprints, and different ones of these kinds have likeness 0. Repeated rows give repeated results: the next document is that
of the next distinct (doc_id, text); rows without doc_id come first. One document alone follows itself. An empty table gives no
rows. Texts of any length are read whole. Only doc_id and text are read, whatever other columns exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions_for

#: One document in so many: the band's ends.
LEAST, MOST = 2000, 10
SLOTS = 16
LEVELS = 5
#: The last level that a text's first one can be: beyond 2^22 distinct terms.
DEEPEST = 20
DIGITS = 5
#: Hex digits of the hash of all terms and of the level.
HEAD = 8 + 2
#: Terms of a lexicon (some 60 bytes each) up to which it is broadcast.
BROADCAST = 1 << 19
EMPTY = "0" * DIGITS
WORD = r"[^\p{L}\p{M}\p{N}]+"
KEY = ["none", "id", "h"]


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), WORD)), "")


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, parts) of the terms within the band; parts[k] is the term's part of level k, -1 if it is none of the first SLOTS."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = df.where((F.col("df") >= 2) & (F.col("df") * LEAST >= n) & ((F.col("df") * MOST <= n) | (F.col("df") == 2)))

    def part(k: int) -> Column:
        v = F.shiftright(F.conv(F.substring("digest", 1 + 3 * k % 57, 6), 16, 10).cast("int"), 24 - k)
        return F.when(v < SLOTS, v).otherwise(-1).cast("tinyint")

    digest = kept.select("term", F.sha2("term", 256).alias("digest"))
    return digest.select("term", F.array(*[part(k) for k in range(DEEPEST + LEVELS)]).alias("parts"))


def _slots(found: Column) -> Column:
    """The hashes of all slots of a text, one string; found: (slot, term) sorted, with a slot of -1 first."""
    done = lambda s: F.when(s["slot"] < 0, F.lit("")).otherwise(F.substring(F.md5(s["terms"]), 1, DIGITS))

    def add(s: Column, x: Column) -> Column:
        on = s["slot"] == x["slot"]
        gap = F.repeat(F.lit(EMPTY), F.greatest(x["slot"] - s["slot"] - 1, F.lit(0)))
        return F.struct(
            x["slot"].alias("slot"),
            F.when(on, F.concat(s["terms"], F.lit(" "), x["term"])).otherwise(x["term"]).alias("terms"),
            F.when(on, s["out"]).otherwise(F.concat(s["out"], done(s), gap)).alias("out"),
        )

    start = F.struct(F.lit(-1).alias("slot"), F.lit("").alias("terms"), F.lit("").alias("out"))
    return F.rpad(F.aggregate(found, start, add, lambda s: F.concat(s["out"], done(s))), LEVELS * SLOTS * DIGITS, "0")


def signatures(texts: DataFrame, words: DataFrame, keys: list[str], facts: list[str] | None = None) -> DataFrame:
    """(keys, facts, fingerprint) of every distinct key; rows that share a key must share their text. words: a lexicon(). facts: columns to keep."""
    facts = facts or []
    own = texts.select(*keys, *facts, "text", terms(F.col("text")).alias("terms"))
    first = F.least(F.greatest(F.length(F.bin(F.size("terms").cast("long"))) - 3, F.lit(0)), F.lit(DEEPEST))
    whole = F.when(F.size("terms") > 0, F.array_join(F.sort_array("terms"), " ")).otherwise(F.col("text"))
    head = F.concat(F.substring(F.md5(whole), 1, HEAD - 2), F.lpad(F.lower(F.hex(first)), 2, "0"))
    # one row of each text, with an empty term, keeps what belongs to the text as a whole
    each = own.select(*keys, first.alias("first"), F.named_struct(F.lit("head"), head, *[x for c in facts for x in (F.lit(c), F.col(c))]).alias("kept"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    kept = F.when(F.col("term") == "", F.col("kept"))
    rows = each.select(*keys, "first", "term", kept.alias("kept")).join(words, "term", "left").where("parts is not null or kept is not null")
    slot = lambda i: F.when(F.get("parts", F.col("first") + i) >= 0, F.get("parts", F.col("first") + i) + i * SLOTS)
    slots = F.when(F.col("kept").isNotNull(), F.array(F.lit(-1))).otherwise(F.array(*[slot(i).cast("int") for i in range(LEVELS)]))
    held = rows.select(*keys, "kept", "term", F.explode(slots).alias("slot")).where("slot is not null")
    found = held.groupBy(*keys).agg(F.max("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("slot", "term"))).alias("found"))
    return found.select(*keys, *[F.col(f"kept.{c}") for c in facts], F.concat("kept.head", _slots(F.col("found"))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints, 0 to 1; 1 for equal ones."""
    first = lambda x: F.conv(F.substring(x, HEAD - 1, 2), 16, 10).cast("int")
    ahead = first(b) - first(a)
    common = F.greatest(LEVELS - F.abs(ahead), F.lit(0)) * SLOTS

    def hashes(x: Column, skipped: Column) -> Column:
        at = HEAD + 1 + F.greatest(skipped, F.lit(0)) * SLOTS * DIGITS
        return F.transform(F.sequence(F.lit(0), common - 1), lambda i: F.substr(x, at + i * DIGITS, F.lit(DIGITS)))

    sides = F.arrays_zip(hashes(a, ahead).alias("x"), hashes(b, -ahead).alias("y"))
    any_of = F.size(F.filter(sides, lambda z: (z["x"] != EMPTY) | (z["y"] != EMPTY)))
    same = F.size(F.filter(sides, lambda z: (z["x"] == z["y"]) & (z["x"] != EMPTY)))
    return F.when(a == b, F.lit(1.0)).when(common > 0, F.coalesce(F.try_divide(same, any_of), F.lit(0.0))).otherwise(0.0)


def in_turn(keys: DataFrame) -> DataFrame:
    """Each distinct key (none, id, h) with the one that follows it (next_none, next_id, next_h), the last one with the first.

    Keys are dealt out by ranges; what follows a range's last key is the first one of the next range, of which there is one row a range.
    """
    order = [F.col("none").desc(), F.col("id"), F.col("h")]
    ranged = keys.distinct().repartitionByRange(partitions_for(keys.sparkSession), *order)
    ranged = cut(ranged.withColumn("range", F.spark_partition_id()), "order")
    key = F.struct(*KEY)
    begin = F.struct((~F.col("none")).alias("some"), "id", "h")
    firsts = ranged.groupBy("range").agg(F.min_by(key, begin).alias("first"))
    every = Window.orderBy("range")
    ends = firsts.select("range", F.lead("first").over(every).alias("after"), F.first("first").over(every).alias("start"))
    follows = F.lead(key).over(Window.partitionBy("range").orderBy(*order))
    linked = ranged.withColumn("follows", follows).join(ends, "range")
    after = F.coalesce("follows", "after", "start")
    return linked.select(*KEY, "n", *[after[c].alias(f"next_{c}") for c in KEY])


def edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(none, id, h, text, edited) of every row, and in_turn()'s rows. id is doc_id (0 and none where null), h tells texts of one id apart.

    edited: the last half of the code points replaced by the first as many of the next document's.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    turn = cut(in_turn(base.select(*KEY, F.length("text").alias("n"))), "turn")
    asked = turn.select(*[F.col(c).alias(f"to_{c}") for c in KEY], "n", *[F.col(f"next_{c}").alias(c) for c in KEY])
    half = F.floor(F.col("n") / 2).cast("int")
    given = base.join(asked, KEY).select(*[F.col(f"to_{c}").alias(c) for c in KEY], F.substr("text", F.lit(1), half).alias("tail"), "n")
    given = given.dropDuplicates(KEY)
    cut_text = F.concat(F.substr("text", F.lit(1), F.col("n") - half), "tail")
    return base.join(given, KEY).select(*KEY, "text", cut_text.alias("edited")), turn


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs."""
    words = cut(lexicon(docs), "lexicon")
    if words.count() <= BROADCAST:
        words = F.broadcast(words)
    pairs, turn = edited(docs)
    one = pairs.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("edited").alias("edited"))
    one = one.select(*KEY, "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("text"))))
    facts = ["copies", "n_chars", "edited_sha256"]
    signed = signatures(one.select(*KEY, *facts, forms.alias("f")).select(*KEY, *facts, "f.form", "f.text"), words, [*KEY, "form"], facts)
    form = lambda i: F.max(F.when(F.col("form") == i, F.col("fingerprint")))
    each = signed.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in facts], form(0).alias("fingerprint"), form(1).alias("edited_fingerprint"))
    each = cut(each, "fingerprints")
    following = each.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("fingerprint").alias("next_fingerprint"))
    out = each.join(turn.select(*KEY, *[f"next_{c}" for c in KEY]), KEY).join(following, [f"next_{c}" for c in KEY])
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return out.withColumn("copy", copies).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"),
    )


#: The same in SQL, for tables of distinct doc_ids.
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT doc_id, n, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d
), forms AS (
  SELECT doc_id, 0 AS form, text FROM e UNION ALL
  SELECT doc_id, 1, left(text, n - n // 2) || left(following, n // 2) FROM e
), words AS (
  SELECT *, least(greatest(length(bin(len(terms))) - 3, 0), {DEEPEST}) AS first FROM (
    SELECT doc_id, form, text, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '{WORD}'), lambda t: t <> ''))) AS terms FROM forms)
), each AS (SELECT doc_id, form, first, unnest(terms) AS term FROM words
), lexicon AS (
  SELECT term, [('0x' || substr(sha256(term), 1 + 3 * k % 57, 6))::INT >> (24 - k) FOR k IN range({DEEPEST + LEVELS})] AS parts
  FROM (SELECT term, count(*) AS df FROM each WHERE form = 0 GROUP BY term), (SELECT count(*) AS n FROM d)
  WHERE df >= 2 AND df * {LEAST} >= n AND (df * {MOST} <= n OR df = 2)
), slots AS (
  SELECT doc_id, form, i * {SLOTS} + parts[first + i + 1] AS slot, left(md5(string_agg(term, ' ' ORDER BY term)), {DIGITS}) AS hash
  FROM each JOIN lexicon USING (term), (SELECT unnest(range({LEVELS})) AS i) WHERE parts[first + i + 1] < {SLOTS} GROUP BY ALL
), signed AS (
  SELECT w.doc_id, w.form, w.first, left(md5(CASE WHEN len(w.terms) > 0 THEN array_to_string(w.terms, ' ') ELSE w.text END), {HEAD - 2})
    || lpad(lower(hex(w.first)), 2, '0') || string_agg(coalesce(s.hash, '{EMPTY}'), '' ORDER BY g.slot) AS fp
  FROM words w CROSS JOIN (SELECT unnest(range({LEVELS * SLOTS})) AS slot) g
  LEFT JOIN slots s ON s.doc_id = w.doc_id AND s.form = w.form AND s.slot = g.slot GROUP BY w.doc_id, w.form, w.first, w.terms, w.text
), pairs AS (
  SELECT e.doc_id, e.n, f.text, a.fp, b.fp AS edited, c.fp AS following, b.first - a.first AS dy, c.first - a.first AS dz
  FROM e JOIN signed a ON a.doc_id = e.doc_id AND a.form = 0 JOIN signed b ON b.doc_id = e.doc_id AND b.form = 1
  JOIN signed c ON c.doc_id = e.next_id AND c.form = 0 JOIN forms f ON f.doc_id = e.doc_id AND f.form = 1
), sides AS (
  SELECT *, [[substr(fp, {HEAD + 1} + (greatest(dy, 0) * {SLOTS} + i) * {DIGITS}, {DIGITS}), substr(edited, {HEAD + 1} + (greatest(-dy, 0) * {SLOTS} + i) * {DIGITS}, {DIGITS})]
      FOR i IN range(greatest({LEVELS} - abs(dy), 0) * {SLOTS})] AS ys,
    [[substr(fp, {HEAD + 1} + (greatest(dz, 0) * {SLOTS} + i) * {DIGITS}, {DIGITS}), substr(following, {HEAD + 1} + (greatest(-dz, 0) * {SLOTS} + i) * {DIGITS}, {DIGITS})]
      FOR i IN range(greatest({LEVELS} - abs(dz), 0) * {SLOTS})] AS zs FROM pairs
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(text) AS edited_sha256, fp AS fingerprint, edited AS edited_fingerprint,
  CASE WHEN fp = edited THEN 1.0::DOUBLE ELSE coalesce(len([y FOR y IN ys IF y[1] = y[2] AND y[1] <> '{EMPTY}'])::DOUBLE
    / nullif(len([y FOR y IN ys IF y[1] <> '{EMPTY}' OR y[2] <> '{EMPTY}']), 0), 0) END AS near_edited,
  CASE WHEN fp = following THEN 1.0::DOUBLE ELSE coalesce(len([z FOR z IN zs IF z[1] = z[2] AND z[1] <> '{EMPTY}'])::DOUBLE
    / nullif(len([z FOR z IN zs IF z[1] <> '{EMPTY}' OR z[2] <> '{EMPTY}']), 0), 0) END AS near_next FROM sides
"""
