"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests,
DataFrame functions only.

A text's paragraphs are its stretches between line ends and sentence ends; its
set holds their distinct 64-bit digests. A sketch has three subtables of cells;
a digest enters one cell of each: the cell counts it and takes the exclusive or
of digests and of their check values. Two sketches of one size subtract cell by
cell; what is left holds only the digests in which the sets differ. Peeling
takes digests out of pure cells (count one, check value right), subtable by
subtable, all documents at once, until no cell is left. If cells remain, both
sketches are built anew four times as large and the pair is tried again. A
pair's first size is the fingerprint's, or a larger one where the sets' sizes
alone tell that the fingerprint's could not hold the difference.

The fingerprint is the smallest sketch, cell by cell, as text. Likeness is the
sets' Jaccard similarity, from their sizes (the counts of a subtable's cells add
up to it) and the number of digests peeled; a difference without a cell left is
empty, whatever the texts' order of paragraphs, and two empty sets are alike (1).

Documents stand in descending order of doc_id (nulls last; equal ids by hash of
the text); after the last comes the first. A null text is the empty text. Rows
that repeat both id and text give one row. A single document is its own next.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells of a subtable in the fingerprint itself; growth on failure; peeling
#: passes over the subtables before a pair counts as failed.
CELLS, GROWTH, PASSES = 8, 4, 12
_KEY = ["k1", "k2"]


def digests(text):
    """The distinct digests of a text's paragraphs, sorted: equal sets are equal arrays."""
    parts = F.filter(F.split(text, "[\n.!?]+"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x))))


def _keyed(docs: DataFrame) -> DataFrame:
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return out.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k2"), "doc_id", "text")


def _next(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """Written table: each document's key, size and the key of the document that
    it is next to (p1, p2) with the characters that one takes; and whether rows
    repeat. Only keys and sizes are sorted, in ranges across the cluster."""
    counted = keyed.groupBy(*_KEY).agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).alias("n"), F.count("*").alias("times"))
    order = [F.desc_nulls_last("doc_id"), F.desc("k2")]
    rows = common.written(counted.orderBy(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)), "order")
    repeated = not rows.where("times > 1").isEmpty()
    me = F.struct(*_KEY, F.floor(F.col("n") / 2).alias("take"))
    inner = F.lag(me).over(Window.partitionBy("run").orderBy("at"))
    heads = rows.groupBy("run").agg(F.max_by(me, "at").alias("last"))  # one row a range
    ends = Window.orderBy("run")
    heads = heads.select("run", F.coalesce(F.lag("last").over(ends), F.last("last").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    linked = rows.withColumn("inner", inner).join(heads, "run").withColumn("p", F.coalesce("inner", "before"))
    return common.written(linked.select(*_KEY, F.col("p.k1").alias("p1"), F.col("p.k2").alias("p2"), F.col("p.take").alias("take")), "next"), repeated


def _compared(docs: DataFrame) -> DataFrame:
    """Written table: each document with its edited text's hash and the digests of
    its text (own), its edited text (edited) and the next document's (next)."""
    keyed = _keyed(docs)
    following, repeated = _next(keyed)
    if repeated:
        keyed = keyed.dropDuplicates(_KEY)
    given = keyed.join(following.hint("merge"), _KEY).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("doc_id").alias("next_doc_id"), F.left("text", "take").alias("given"), digests(F.col("text")).alias("next"))
    both = keyed.join(given.hint("merge"), _KEY).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.left("text", F.col("n_chars") - F.floor(F.col("n_chars") / 2)), "given")
    both = both.withColumn("edited_text", edited)
    out = both.select(*_KEY, "doc_id", "next_doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited_text")).alias("edited"), "next")
    return common.written(out, "compared")


def _cell(t: int, cells: str, key: str = "d") -> str:
    return f"CAST({t} * {cells} + (xxhash64({key}, {t + 1}) & ({cells} - 1)) AS INT)"


def _cells_of(cells: str, key: str = "d") -> str:
    """SQL for the array of (cell, cnt, key, chk) entries of one digest."""
    one = lambda t: f"named_struct('cell', {_cell(t, cells, key)}, 'cnt', 1L, 'key', {key}, 'chk', xxhash64({key}, 0))"
    return f"array({one(0)}, {one(1)}, {one(2)})"


def _sketches(rows: DataFrame, by: list[str], column: str, cells: int) -> DataFrame:
    """Cells of the sketches of ``column``'s digests."""
    each = rows.select(*by, F.explode(column).alias("d")).select(*by, F.expr(f"inline({_cells_of(str(cells))})"))
    return each.groupBy(*by, "cell").agg(F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))


def _as_text(sketches: DataFrame, name: str) -> DataFrame:
    cell = F.concat_ws(":", F.col("cell").cast("string"), F.col("cnt").cast("string"), F.lower(F.hex("key")), F.lower(F.hex("chk")))
    size = F.sum(F.when(F.col("cell") < CELLS, F.col("cnt")))  # every digest is counted once a subtable
    entries = sketches.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("cell", cell.alias("s")))).alias("x"), size.alias(f"{name}_size"))
    return entries.select(*_KEY, F.array_join(F.transform("x", lambda e: e["s"]), " ").alias(name), f"{name}_size")


def _peeled(pairs: DataFrame) -> DataFrame:
    """pairs: key, pair, cells (of a subtable), a, b (digest arrays). The cells of
    a's sketch less b's, peeled: key, pair, cells, whether nothing is left,
    digests found. A pair whose cells all cancel has no row."""
    by = [*_KEY, "pair", "cells"]
    # the two sketches subtract within one aggregation: b enters with the sign reversed
    signed = pairs.select(*by, F.expr("explode(concat(transform(a, x -> named_struct('d', x, 's', 1L)), transform(b, x -> named_struct('d', x, 's', -1L)))) AS e")).select(*by, "e.d", "e.s")
    rows = signed.select(*by, "s", F.expr(f"inline({_cells_of('cells')})")).select(*by, "cell", (F.col("s") * F.col("cnt")).alias("cnt"), "key", "chk")
    summed = lambda x: x.groupBy(*by, "cell").agg(F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")).where("cnt != 0 OR key != 0 OR chk != 0")
    rows = summed(rows)
    for r in range(PASSES):
        t = r % 3
        pure = f"cell >= {t} * cells AND cell < {t + 1} * cells AND abs(cnt) = 1 AND chk = xxhash64(key, 0) AND cell = {_cell(t, 'cells', 'key')}"
        others = [f"named_struct('cell', {_cell(u, 'cells', 'key')}, 'cnt', -cnt, 'key', key, 'chk', chk)" for u in range(3) if u != t]
        tally = "named_struct('cell', 3 * cells, 'cnt', 1L, 'key', 0L, 'chk', 0L)"
        stays = "named_struct('cell', cell, 'cnt', cnt, 'key', key, 'chk', chk)"
        rows = summed(rows.select(*by, F.expr(f"inline(CASE WHEN {pure} THEN array({', '.join(others)}, {tally}) ELSE array({stays}) END)")))
    found = F.col("cell") == 3 * F.col("cells")
    return rows.groupBy(*by).agg((F.count_if(~found) == 0).alias("whole"), F.coalesce(F.sum(F.when(found, F.col("cnt"))), F.lit(0)).alias("differ"))


def _first_cells(a: str, b: str) -> str:
    """SQL for a pair's first size of a subtable: CELLS, grown until three
    subtables could hold as many digests as the sets' sizes differ by."""
    short = f"abs(size({a}) - size({b})) / {3 * CELLS}"
    return f"CAST({CELLS} * pow({GROWTH}, greatest(0, ceil(log({GROWTH}, greatest(1, {short}))))) AS INT)"


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, next_doc_id."""
    rows = _compared(docs).repartition(*_KEY)  # one shuffle of digests a pass: all that follows is grouped by key
    sides = F.array(*(F.struct(F.lit(p).alias("pair"), F.col("own").alias("a"), F.col(c).alias("b")) for p, c in ((0, "edited"), (1, "next"))))
    pairs = rows.select(*_KEY, F.explode(sides).alias("p")).select(*_KEY, "p.*")
    results, pending = None, None
    while True:
        now = pairs.withColumn("cells", F.expr(_first_cells("a", "b"))) if pending is None else pairs.join(pending, [*_KEY, "pair"])
        done = common.written(_peeled(now), "peeled")
        good = done.where("whole").select(*_KEY, "pair", "differ")
        results = good if results is None else results.unionByName(good)
        pending = done.where("NOT whole").select(*_KEY, "pair", (F.col("cells") * GROWTH).alias("cells"))
        if pending.isEmpty():
            break
    differ = lambda p: F.coalesce(F.max(F.when(F.col("pair") == p, F.col("differ"))), F.lit(0)).alias(f"d{p}")
    out = rows.drop("own", "edited", "next").join(results.groupBy(*_KEY).agg(differ(0), differ(1)), _KEY, "left").na.fill(0, ["d0", "d1"])
    for column, name in (("own", "fingerprint"), ("edited", "edited_fingerprint")):
        out = out.join(_as_text(_sketches(rows, _KEY, column, CELLS), name), _KEY, "left").withColumn(name, F.coalesce(name, F.lit("")))
    sizes = rows.select(*_KEY, F.size("next").alias("n_next"))
    out = out.join(sizes, _KEY)

    def likeness(size, d):
        total = F.coalesce("fingerprint_size", F.lit(0)) + F.coalesce(size, F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - F.col(d)) / (total + F.col(d)))

    out = out.withColumns({"near_edited": likeness(F.col("edited_fingerprint_size"), "d0"), "near_next": likeness(F.col("n_next"), "d1")})
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_doc_id")


#: What SQL can tell of it, in DuckDB: all but the sketches themselves, whose
#: hashes it lacks; the likeness by comparing the sets of paragraphs.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), o AS (
  SELECT doc_id, t, len(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS f, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_doc_id
  FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (SELECT *, left(t, n - n // 2) || left(f, n // 2) AS x FROM o), s AS (
  SELECT doc_id, next_doc_id, n, x, list_distinct(list_filter(string_split_regex(t, '[\n.!?]+'), lambda p: trim(p, ' ') <> '')) AS own,
    list_distinct(list_filter(string_split_regex(x, '[\n.!?]+'), lambda p: trim(p, ' ') <> '')) AS edited,
    list_distinct(list_filter(string_split_regex(f, '[\n.!?]+'), lambda p: trim(p, ' ') <> '')) AS next
  FROM e
), j AS (SELECT *, len(list_intersect(own, edited)) AS be, len(list_intersect(own, next)) AS bn FROM s)
SELECT doc_id, n::BIGINT AS n_chars, sha256(x) AS edited_sha256, next_doc_id,
  CASE WHEN len(own) + len(edited) = 0 THEN 1.0 ELSE be::DOUBLE / (len(own) + len(edited) - be) END AS near_edited,
  CASE WHEN len(own) + len(next) = 0 THEN 1.0 ELSE bn::DOUBLE / (len(own) + len(next) - bn) END AS near_next
FROM j
"""
