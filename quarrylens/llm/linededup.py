"""Line dedup by a suffix array over line ids, DataFrame functions only.

A document is the sequence of its lines that hold a word; equal lines have one
id (128 hash bits). Lines that occur once end every run and are left out at
once. The suffix array is built by distributed prefix doubling: a block of
2^k lines is ranked by sorting the distinct pairs (rank of its first half, rank
of its second half) across the cluster; ranks are places in that order, so
equal blocks share a rank and ranks order suffixes by their first 2^k lines. A
block that stands once has no rank, since no repeated run holds it: its suffixes
are told apart at that depth, and the array's order among them says nothing more.

An interval of the array with longest common prefix of n lines or more is the set
of places whose first n lines are equal. For 2^k <= n < 2^(k+1) these are the
places with one pair of ranks, of the block of 2^k lines at the place and of the
block that ends n lines on: the two cover the run, so the pair names the interval
without the array being read in order. A run counts from ``MIN_WORDS`` words. The
intervals taken are those of the shortest such run from each line forwards, and up
to each line backwards. A maximal repeated run of that many words, whatever its
length, is the union of the shortest runs that begin and end in it, and each of
those has a copy wherever the whole run has one; so the lines in later places of
these intervals are the lines of later copies of all maximal runs. A shortest run
has no more than ``MIN_WORDS`` lines, since each has a word: doubling need not go
beyond that depth, however long the copies are.

Of an interval's places the first (by doc_id, hash of the text, line) stays; the
lines of all later ones are deleted, but never those of the first copy itself
where a text repeats within itself.

Null texts are empty texts. A null id comes before all others. Rows that repeat
both id and text are one document: they do not delete each other's lines, and
each keeps the same remaining text. Blank lines go with a deleted run if they
stand inside it. An empty table gives an empty result. Other columns pass
through untouched whatever their names (``stage``); ``dedup`` adds columns that
begin with ``_ld_`` and takes none of such names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from . import common

MIN_WORDS = 50
_BLANKS = " \t\n\x0b\f\r"
_WORD = "[^ \\t-\\r]+"
_DOC = ["_ld_id", "_ld_tie"]


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: document, ordinal, line number, line id, words."""
    pieces = F.transform(F.split("_ld_text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    solid = F.filter(pieces, lambda s: F.trim(s["x"], F.lit(_BLANKS)) != "")
    out = docs.select(*_DOC, F.posexplode(solid).alias("seq", "s"))
    return out.select(
        *_DOC, "seq", F.col("s.i").alias("line"), F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(7), "s.x").alias("h2"), F.regexp_count("s.x", F.lit(_WORD)).alias("w")
    )


def _ranked(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Written table: each row's place in the order of ``keys`` (across the
    cluster: ranges of keys, sorted within), as ``rank``."""
    return common.written(distinct.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """Written table of the repeated lines with their ranks, and the lengths of
    the shortest runs of ``min_words`` words from (lf) and up to (lb) each."""
    lines = common.written(_lines(docs), "lines")
    ids = _ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), ["h1", "h2"])
    rows = join_unique(lines, ids.drop("n"), ["h1", "h2"], counts=ids.drop("rank")).select(*_DOC, "seq", "line", "w", F.col("rank").alias("r"))
    rows = rows.repartition(*_DOC).dropDuplicates([*_DOC, "seq"])
    doc = Window.partitionBy(*_DOC)
    rows = rows.withColumn("ce", F.sum("w").over(doc.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).withColumn("cs", F.col("ce") - F.col("w"))
    ahead, back = doc.orderBy("cs").rangeBetween(0, min_words - 1), doc.orderBy("ce").rangeBetween(1 - min_words, 0)
    rows = rows.withColumns({"nf": F.count("*").over(ahead), "sf": F.max("seq").over(ahead), "cf": F.max("ce").over(ahead)})
    rows = rows.withColumns({"nb": F.count("*").over(back), "sb": F.min("seq").over(back), "cb": F.min("cs").over(back)})
    whole_f = (F.col("sf") == F.col("seq") + F.col("nf") - 1) & (F.col("cf") - F.col("cs") >= min_words)
    whole_b = (F.col("sb") == F.col("seq") - F.col("nb") + 1) & (F.col("ce") - F.col("cb") >= min_words)
    return common.written(rows.select(*_DOC, "seq", "line", "r", F.when(whole_f, F.col("nf")).alias("lf"), F.when(whole_b, F.col("nb")).alias("lb")), "repeated")


def _near(by: int):
    """The rank ``by`` lines on (or back), if no line lies between that is left out."""
    line = Window.partitionBy(*_DOC).orderBy("seq")
    move = (lambda c: F.lead(c, by)) if by >= 0 else (lambda c: F.lag(c, -by))
    return F.col("r") if by == 0 else F.when(move("seq").over(line) == F.col("seq") + by, move("r").over(line))


def _runs(rows: DataFrame, k: int) -> DataFrame:
    """Runs of 2^k to 2^(k+1)-1 lines: direction, length, ranks of the first and
    the last block of 2^k lines, document, first and last ordinal."""
    block, sizes = 1 << k, range(1 << k, 2 << k)
    pick = lambda length, of: F.coalesce(*(F.when(F.col(length) == n, _near(of(n))) for n in sizes))
    seen = rows.select(
        *_DOC, "seq", "lf", "lb", F.col("r").alias("fa"), pick("lf", lambda n: n - block).alias("fb"), pick("lb", lambda n: 1 - n).alias("ba"), pick("lb", lambda n: 1 - block).alias("bb")
    )
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).alias("way"), F.col("lf").alias("len"), F.col("fa").alias("a"), F.col("fb").alias("b"), F.col("seq").alias("first")),
            F.struct(F.lit(1).alias("way"), F.col("lb").alias("len"), F.col("ba").alias("a"), F.col("bb").alias("b"), (F.col("seq") - F.col("lb") + 1).alias("first")),
        )
    )
    out = seen.select(*_DOC, ends.alias("x")).select(*_DOC, "x.*")
    return out.where(F.col("len").between(block, 2 * block - 1) & F.col("a").isNotNull() & F.col("b").isNotNull())


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Written table: document (_ld_id, _ld_tie) and its deleted stretches of
    lines, an array of (first, last) line numbers in ascending order."""
    with common.scratch(docs.sparkSession):
        return _later_copies(docs, min_words)


def _later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    rows = _repeated(docs, min_words)
    longest = rows.agg(F.max(F.greatest("lf", "lb"))).first()[0] or 0
    runs, k = None, 0
    while 1 << k <= longest:
        if k:  # blocks of 2^k lines from blocks of 2^(k-1)
            two = common.written(rows.withColumn("nx", _near(1 << (k - 1))), "pairs")
            pairs = two.where("r is not null and nx is not null")
            ranks = _ranked(pairs.groupBy("r", "nx").agg(F.count("*").alias("n")).where("n > 1"), ["r", "nx"])
            known = join_unique(pairs, ranks.drop("n"), ["r", "nx"], "left", ranks.drop("rank")).select(*_DOC, "seq", "line", F.col("rank").alias("r"), "lf", "lb")
            rest = two.where("r is null or nx is null").select(*_DOC, "seq", "line", F.lit(None).cast("long").alias("r"), "lf", "lb")
            rows = common.written(known.unionByName(rest), "blocks")
        found = _runs(rows, k)
        runs = found if runs is None else runs.unionByName(found)
        k += 1
    if runs is None:
        runs = _runs(rows, 0)
    runs = common.written(runs, "runs")
    place = F.struct(*_DOC, "first")
    name = ["way", "len", "a", "b"]
    firsts = common.written(runs.groupBy(*name).agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1"), "firsts")
    later = join_unique(runs, firsts.drop("n"), name, counts=firsts.drop("f")).where(place > F.col("f"))
    same = F.col("_ld_id").eqNullSafe(F.col("f._ld_id")) & (F.col("_ld_tie") == F.col("f._ld_tie"))
    start = F.when(same, F.greatest(F.col("first"), F.col("f.first") + F.col("len"))).otherwise(F.col("first"))
    gone = later.select(*_DOC, F.explode(F.sequence(start, F.col("first") + F.col("len") - 1)).alias("seq")).distinct()
    numbered = rows.select(F.col("_ld_id").alias("i"), F.col("_ld_tie").alias("t"), F.col("seq").alias("s"), "line")
    gone = gone.join(numbered, F.col("_ld_id").eqNullSafe(F.col("i")) & (F.col("_ld_tie") == F.col("t")) & (F.col("seq") == F.col("s"))).select(*_DOC, "seq", "line")
    island = F.col("seq") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("seq"))
    stretches = gone.withColumn("island", island).groupBy(*_DOC, "island").agg(F.struct(F.min("line").alias("first"), F.max("line").alias("last")).alias("x"))
    return common.written(stretches.groupBy(*_DOC).agg(F.sort_array(F.collect_list("x")).alias("_ld_gone")), "gone", keep=True)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the remaining text, and _ld_lines, _ld_removed (numbers of
    lines before, and deleted)."""
    keyed = docs.withColumns({"_ld_id": F.col("doc_id"), "_ld_text": common.text_of()}).withColumn("_ld_tie", F.xxhash64("_ld_text"))
    gone = later_copies(keyed.select("_ld_id", "_ld_tie", "_ld_text"), min_words).select(F.col("_ld_id").alias("_ld_i"), F.col("_ld_tie").alias("_ld_t"), "_ld_gone")
    # always by sort and merge: the plan, and what it needs, stay the same at any size
    both = keyed.join(gone.hint("merge"), F.col("_ld_id").eqNullSafe(F.col("_ld_i")) & (F.col("_ld_tie") == F.col("_ld_t")), "left")
    lines, cut = F.split("_ld_text", "\n"), F.col("_ld_gone")

    def kept(i):
        after = F.when(i == 0, F.lit(-1)).otherwise(F.get(cut, i - 1)["last"])
        before = F.when(i == F.size(cut), F.size(lines)).otherwise(F.get(cut, i)["first"])
        return F.slice(lines, after + 2, before - after - 1)

    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), kept)), "\n")
    removed = F.aggregate(cut, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return both.select(
        *(F.when(cut.isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.size(lines).cast("long").alias("_ld_lines"), F.coalesce(removed, F.lit(0).cast("long")).alias("_ld_removed"),
    )


def stage(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their remaining texts, and all their columns whatever
    their names; those that lost all their words go."""
    given, back = common.plain(docs, "doc_id", "text")
    out = dedup(given, min_words)
    return back(out.where((F.col("_ld_removed") == 0) | F.col("text").rlike(_WORD)))


#: The same result in DuckDB: runs are compared as whole strings.
SQL = f"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, i - 1 AS line, parts[i] AS x, len(regexp_extract_all(parts[i], '[^ \\t-\\r]+')) AS w
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM raw)
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS ce FROM lines WHERE w > 0
), fwd AS (
  SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + {MIN_WORDS}
  WHERE b.ce - (a.ce - a.w) >= {MIN_WORDS} GROUP BY 1, 2
), bwd AS (
  SELECT b.doc_id, max(a.seq) AS s, b.seq AS e FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND a.seq BETWEEN b.seq - {MIN_WORDS} AND b.seq
  WHERE b.ce - (a.ce - a.w) >= {MIN_WORDS} GROUP BY 1, 3
), spans AS (SELECT 0 AS way, * FROM fwd UNION ALL SELECT 1, * FROM bwd),
runs AS (
  SELECT r.way, r.doc_id, r.s, r.e, string_agg(l.x, chr(10) ORDER BY l.seq) AS body
  FROM spans r JOIN solid l ON l.doc_id = r.doc_id AND l.seq BETWEEN r.s AND r.e GROUP BY 1, 2, 3, 4
), firsts AS (SELECT way, body, min({{'d': doc_id, 's': s}}) AS f FROM runs GROUP BY 1, 2),
later AS (
  SELECT r.doc_id, CASE WHEN r.doc_id = f.f.d THEN greatest(r.s, f.f.s + r.e - r.s + 1) ELSE r.s END AS s, r.e
  FROM runs r JOIN firsts f ON r.way = f.way AND r.body = f.body WHERE (r.doc_id, r.s) > (f.f.d, f.f.s)
), gone AS (SELECT DISTINCT l.doc_id, l.seq, l.line FROM later r JOIN solid l ON l.doc_id = r.doc_id AND l.seq BETWEEN r.s AND r.e),
stretch AS (
  SELECT doc_id, min(line) AS a, max(line) AS b FROM (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM gone) GROUP BY doc_id, g
), cut AS (
  SELECT l.doc_id, l.line, l.x, s.doc_id IS NOT NULL AS del FROM lines l LEFT JOIN stretch s ON s.doc_id = l.doc_id AND l.line BETWEEN s.a AND s.b
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (del)::BIGINT AS n_removed,
  coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT del), '') AS text FROM cut GROUP BY doc_id
"""
