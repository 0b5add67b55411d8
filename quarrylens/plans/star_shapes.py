"""Graphs, similarity, cascades and rules on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import joins as J
from ..operators import lookups as L
from ..operators import rules as R
from ..operators import similarity as C
from ..sources.tables import Tables
from . import views
from .registry import query
from .star_basic import _trade, cents

_NATIONS = """WITH RECURSIVE top AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_RESALE = """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_linenumber = 1 UNION SELECT DISTINCT 1000000 + l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2)"""


def _top_trade(t: Tables) -> DataFrame:
    """Nations that buy from nations, over all line items."""
    return _trade(t).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()


def _resale(t: Tables) -> DataFrame:
    """First items as edges from supplier to part, second items back, all of them."""
    part = F.col("l_partkey") + 1000000
    forth = t.lineitem.where("l_linenumber = 1").select(F.col("l_suppkey").alias("a"), part.alias("b"))
    return forth.union(t.lineitem.where("l_linenumber = 2").select(part, "l_suppkey")).distinct()


@query(_RESALE + """, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a WHERE r.depth < 4)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY 1""")
def dependency_graph_depth(t: Tables) -> DataFrame:
    """G1, G2."""
    return G.reachable(_resale(t), t.supplier.where("s_suppkey = 1").select("s_suppkey"), "a", "b", 4)


@query(_RESALE + ", r AS (SELECT 1::BIGINT AS node UNION SELECT e.b FROM r JOIN e ON r.node = e.a) SELECT node FROM r")
def reachability(t: Tables) -> DataFrame:
    """G3."""
    return G.reachable(_resale(t), t.supplier.where("s_suppkey = 1").select("s_suppkey"), "a", "b").select("node")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS x, 1000000000 + p_size * 100000 + CAST(substr(p_brand, 7) AS BIGINT) * 1000 + len(p_name) AS y FROM part),
d AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e), r AS (SELECT a AS node, a AS top FROM d UNION SELECT d.b, r.top FROM r JOIN d ON r.node = d.a)
SELECT node, min(top)::BIGINT AS component FROM r GROUP BY 1""")
def components(t: Tables) -> DataFrame:
    """Parts and what they share as nodes of one graph."""
    shared = 1000000000 + F.col("p_size").cast("long") * 100000 + F.substring("p_brand", 7, 9).cast("long") * 1000 + F.length("p_name")
    return G.components(t.part.select("p_partkey", shared.alias("y")), "p_partkey", "y")


@query(_NATIONS + """, p AS (SELECT a AS head, b AS last, [a, b] AS path FROM top WHERE b > a UNION ALL SELECT head, top.b, list_append(path, top.b) FROM p JOIN top ON p.last = top.a
WHERE top.b > head AND NOT list_contains(path, top.b) AND len(path) < 3)
SELECT array_to_string(path, ',') AS path FROM p JOIN top ON p.last = top.a AND top.b = p.head UNION ALL SELECT a::VARCHAR FROM top WHERE a = b""")
def cycles(t: Tables) -> DataFrame:
    """All cycles of at most three nations."""
    return G.cycles(_top_trade(t), "a", "b", 3).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS a, p_size + 1 + p_partkey % 3 AS b FROM part), r AS (SELECT a AS node, 1 AS d FROM e UNION SELECT e.b, r.d + 1 FROM r JOIN e ON r.node = e.a) SELECT max(d)::BIGINT AS depth FROM r""")
def call_depth(t: Tables) -> DataFrame:
    """G10."""
    edges = t.part.select(F.col("p_size").alias("a"), (F.col("p_size") + 1 + F.col("p_partkey") % 3).alias("b"))
    return t.spark.createDataFrame([(G.longest_path(edges, "a", "b"),)], "depth long")


@query("""WITH m AS (SELECT p_partkey AS k, p_brand AS g FROM part) SELECT DISTINCT a.g AS from_group, b.g AS to_group FROM lineitem JOIN m a ON a.k = l_partkey JOIN m b ON b.k = l_suppkey WHERE a.g <> b.g""")
def condensed_groups(t: Tables) -> DataFrame:
    """G12."""
    return G.condensed(t.lineitem, t.part, "p_partkey", "p_brand", "l_partkey", "l_suppkey")


@query("""WITH o AS (SELECT l_suppkey AS node, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS calls FROM lineitem GROUP BY 1), i AS (SELECT l_linenumber::BIGINT AS node, string_agg(DISTINCT l_suppkey::VARCHAR, ',') AS c, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(calls, '') AS calls, coalesce(n, 0)::BIGINT AS n_callers FROM o FULL JOIN i ON o.node = i.node""")
def callers_and_callees(t: Tables) -> DataFrame:
    """G13, P29."""
    out = G.calls_of(t.lineitem.select("l_suppkey", F.col("l_linenumber").cast("long").alias("n")), "l_suppkey", "n")
    return out.select("node", F.array_join("calls", ",").alias("calls"), F.size("called_by").cast("long").alias("n_callers"))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS k, p_brand AS m, p_name AS n, p_brand || '.' || p_name AS qn FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT DISTINCT k, m, n, qn FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY m, n) = 1),
q AS (SELECT p_brand || '.' || p_name AS qn, min(p_partkey) AS t FROM part GROUP BY 1 HAVING count(*) = 1), l AS (SELECT p_type, p_name, min(p_partkey) AS t FROM part WHERE p_size > 40 GROUP BY 1, 2 HAVING count(*) = 1), a AS (SELECT p_name, min(p_partkey) AS t FROM part WHERE p_size > 48 GROUP BY 1 HAVING count(*) = 1)
SELECT k, CASE WHEN q.t IS NOT NULL THEN 'qualified_name' WHEN l.t IS NOT NULL THEN 'same_file' WHEN a.t IS NOT NULL THEN 'unique_name' END AS rule, coalesce(q.t, l.t, a.t) AS target FROM d LEFT JOIN q USING (qn) LEFT JOIN l ON l.p_type = 'PROMO' AND l.p_name = n LEFT JOIN a ON a.p_name = n""")
def resolution_cascade(t: Tables) -> DataFrame:
    """Names of parts, by qualified name, by name in one file, by name anywhere."""
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.struct("p_brand", "p_name").alias("x"))
    calls = named.groupBy("k").agg(F.min("x").alias("x")).select("k", F.concat_ws(".", "x.p_brand", "x.p_name").alias("qn"), F.col("x.p_name").alias("n"))
    full = J.unique_names(t.part.select(F.concat_ws(".", "p_brand", "p_name").alias("qn"), "p_partkey"), ["qn"], "p_partkey").select("qn", F.col("p_partkey").alias("target"))
    local = J.unique_names(t.part.where("p_size > 40"), ["p_type", "p_name"], "p_partkey").where("p_type = 'PROMO'").select(F.col("p_name").alias("n"), F.col("p_partkey").alias("target"))
    anywhere = J.unique_names(t.part.where("p_size > 48"), ["p_name"], "p_partkey").select(F.col("p_name").alias("n"), F.col("p_partkey").alias("target"))
    rules = [("qualified_name", calls.join(full, "qn")), ("same_file", calls.join(local, "n")), ("unique_name", calls.join(anywhere, "n"))]
    return J.cascade(calls.select("k"), "k", rules, "target").select("k", "rule", "target")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity >= 48), o AS (SELECT a, count(*) AS n FROM e GROUP BY 1), i AS (SELECT b, count(*) AS n FROM e GROUP BY 1)
SELECT coalesce(o.a, i.b)::BIGINT AS node, coalesce(o.n, 0)::BIGINT AS fan_out, coalesce(i.n, 0)::BIGINT AS fan_in FROM o FULL JOIN i ON o.a = i.b""")
def fan_in_out(t: Tables) -> DataFrame:
    """A23."""
    return G.degrees(t.lineitem.where("l_quantity >= 48"), "l_suppkey", "l_partkey")


@query("""WITH a AS (SELECT DISTINCT l_returnflag || l_linestatus || '/' || s_nationkey AS scope, l_suppkey AS m, l_partkey % 50 AS attr FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
n AS (SELECT scope, count(DISTINCT m) AS n FROM a GROUP BY 1), s AS (SELECT x.scope, count(DISTINCT (x.m, y.m)) AS shared FROM a x JOIN a y ON x.scope = y.scope AND x.attr = y.attr AND x.m < y.m GROUP BY 1)
SELECT scope, n::BIGINT AS n, coalesce(shared, 0)::BIGINT AS shared, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE coalesce(shared, 0)::DOUBLE / (n * (n - 1) / 2)::DOUBLE END AS cohesion FROM n LEFT JOIN s USING (scope)""")
def cohesion(t: Tables) -> DataFrame:
    """M8, E5."""
    lines = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    access = lines.select(F.concat("l_returnflag", "l_linestatus", F.lit("/"), F.col("s_nationkey").cast("string")).alias("scope"), F.col("l_suppkey").alias("m"), (F.col("l_partkey") % 50).alias("attr"))
    return R.cohesion(access, "scope", "m", "attr")


def _words():
    """The words of a document's text."""
    return F.filter(F.split(F.lower(F.regexp_replace("text", "[^a-zA-Z ]+", " ")), " +"), lambda x: F.length(x) > 0)


@query("""WITH tok AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z ]+', ' ', 'g')), ' +'), lambda x: len(x) > 0))) AS w FROM documents),
g AS (SELECT w, min(doc_id) AS k, len(w) AS n FROM tok WHERE len(w) > 0 GROUP BY 1), s AS (SELECT g.k AS a, doc_id AS b, 1.0::DOUBLE AS similarity FROM tok JOIN g ON tok.w = g.w WHERE doc_id > g.k),
p AS (SELECT x.k AS a, y.k AS b, x.n + y.n AS t, len(list_intersect(x.w, y.w)) AS c FROM g x JOIN g y ON x.k < y.k AND 10 * least(x.n, y.n) >= 7 * greatest(x.n, y.n))
SELECT a, b, c::DOUBLE / (t - c) AS similarity FROM p WHERE 10 * c >= 7 * (t - c) UNION ALL SELECT * FROM s""")
def near_dup_jaccard(t: Tables) -> DataFrame:
    """All pairs of word sets from 0.7 on, over whole texts of any length,
    however many documents hold a word; equal sets by their first."""
    return J.similar_sets(t.documents, "doc_id", _words(), 7)


@query("""WITH e AS (SELECT p_partkey AS k, p_name || '|' || p_brand AS b FROM part UNION ALL SELECT p_partkey, p_brand || '|' || p_size FROM part UNION ALL SELECT p_partkey, p_type FROM part), s AS (SELECT b FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), k AS (SELECT e.* FROM e SEMI JOIN s USING (b))
SELECT DISTINCT x.k AS a, y.k AS b FROM k x JOIN k y ON x.b = y.b AND x.k < y.k""")
def blocked_candidates(t: Tables) -> DataFrame:
    """Candidates share a block of at most 20; larger blocks say nothing, by definition."""
    blocks = F.array(F.concat_ws("|", "p_name", "p_brand"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")), F.col("p_type"))
    return J.blocked_pairs(t.part, "p_partkey", blocks, 20)


@query("""WITH tok AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size || ' of part ' || p_partkey, ' ') AS t FROM part),
g AS (SELECT p_partkey, [md5(array_to_string(t[i:i + 2], ' ')) FOR i IN generate_series(1, len(t) - 2)] AS h FROM tok),
w AS (SELECT p_partkey, CASE WHEN len(h) <= 4 THEN h ELSE [list_min(h[i:i + 3]) FOR i IN generate_series(1, len(h) - 3)] END AS m FROM g)
SELECT p_partkey, array_to_string(list_sort(list_distinct(m)), ',') AS fingerprint FROM w""")
def winnow_fingerprint(t: Tables) -> DataFrame:
    """W4, C8."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("of part"), F.col("p_partkey").cast("string"))
    hashes = F.transform(C.kgrams(F.split(text, " "), 3), F.md5)
    return t.part.select("p_partkey", hashes.alias("h")).select("p_partkey", F.array_join(C.winnowed(F.col("h")), ",").alias("fingerprint"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(l) - 2)) AS i, l FROM l WHERE len(l) >= 3)
SELECT md5(array_to_string(l[i:i + 2], chr(10))) AS digest, count(*)::BIGINT AS times, min(doc_id)::BIGINT AS first_doc FROM w GROUP BY 1 HAVING count(*) > 1""")
def line_windows(t: Tables) -> DataFrame:
    """W5, C28."""
    return C.line_windows(t.documents, "doc_id", "text", 3).select("digest", "times", F.col("first_place.doc_id").alias("first_doc"))


@query("""WITH known AS (SELECT prefix, min(id) AS id FROM (SELECT 'example.net/en' AS prefix, 1 AS id UNION ALL SELECT 'example.net', 2 UNION ALL SELECT 'example.com/de', 3 UNION ALL SELECT 'example.org', 4) GROUP BY 1),
u AS (SELECT page_id, regexp_extract(url, '(example[.](net|com|org)/[^?#]*)', 1) AS name FROM pages)
SELECT page_id, (SELECT arg_max(id, len(prefix)) FROM known WHERE u.name = prefix OR starts_with(u.name, prefix || '/'))::INT AS owner FROM u""")
def longest_prefix(t: Tables) -> DataFrame:
    """The trims are as many as an address can have parts here."""
    known = t.spark.createDataFrame([("example.net/en", 1), ("example.net", 2), ("example.com/de", 3), ("example.org", 4)], "prefix string, owner int")
    names = t.pages.select("page_id", F.regexp_extract("url", r"(example[.](net|com|org)/[^?#]*)", 1).alias("name"))
    return J.longest_prefix(names, "name", known, "prefix", "owner", "/", 12).select("page_id", "owner")


_BLOCKS = """WITH RECURSIVE b AS (SELECT p_partkey AS k, p_name || '|' || p_brand || '|' || p_type AS tok, p_name || '|' || p_brand AS ast, p_brand || '|' || p_size AS nrm, p_size AS loc, p_size % 12 AS st, p_partkey % 6 AS nest,
CASE p_partkey % 3 WHEN 0 THEN 'function_body' WHEN 1 THEN 'if' ELSE 'class_body' END AS bt, p_partkey % 7 AS f FROM part WHERE p_size >= 3),
g1 AS (SELECT 'exact' AS t, 'exact' AS ch, tok AS fp, list(k ORDER BY k) AS m FROM b GROUP BY 3 HAVING count(*) >= 2), b1 AS (SELECT * FROM b WHERE k NOT IN (SELECT unnest(m) FROM g1)),
g2 AS (SELECT 'hybrid' AS t, 'normalized,structural' AS ch, ast || '|' || nrm AS fp, list(k ORDER BY k) AS m FROM b1 GROUP BY 3 HAVING count(*) >= 2), b2 AS (SELECT * FROM b1 WHERE k NOT IN (SELECT unnest(m) FROM g2)),
g3 AS (SELECT 'structural' AS t, 'structural' AS ch, ast AS fp, list(k ORDER BY k) AS m FROM b2 GROUP BY 3 HAVING count(*) >= 2), b3 AS (SELECT * FROM b2 WHERE k NOT IN (SELECT unnest(m) FROM g3)),
g4 AS (SELECT 'semantic' AS t, 'normalized' AS ch, nrm AS fp, list(k ORDER BY k) AS m FROM b3 GROUP BY 3 HAVING count(*) >= 2),
g AS (SELECT *, len(m) AS n, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE t WHEN 'exact' THEN 1.0 WHEN 'hybrid' THEN 0.95 WHEN 'structural' THEN 0.9 ELSE 0.85 END::DOUBLE + least(0.03::DOUBLE, (len(m) - 2) * 0.01::DOUBLE))) AS sim
FROM (FROM g1 UNION ALL FROM g2 UNION ALL FROM g3 UNION ALL FROM g4)),
x AS (SELECT g.t, g.fp, g.k, g.n, g.sim, b.loc, b.st, b.f, greatest(0, least(20, 10 + CASE WHEN loc >= 10 THEN 4 WHEN loc >= 5 THEN 2 ELSE 0 END + CASE WHEN st >= 5 THEN 4 WHEN st >= 3 THEN 2 ELSE 0 END
+ CASE WHEN nest <= 2 THEN 2 WHEN nest >= 4 THEN -2 ELSE 0 END + CASE bt WHEN 'function_body' THEN 2 WHEN 'if' THEN 1 ELSE 0 END)) AS fe FROM (SELECT *, unnest(m) AS k FROM g) g JOIN b ON g.k = b.k),
y AS (SELECT t, fp, n, sim, sum(loc)::BIGINT AS total_lines, sum(loc)::DOUBLE / n AS ml, sum(st)::DOUBLE / n AS ms, sum(fe)::DOUBLE / (20 * n) AS feasible, count(DISTINCT f)::BIGINT AS n_files, arg_min(k, {'f': -fe, 'k': k}) AS representative FROM x GROUP BY 1, 2, 3, 4),
z AS (SELECT *, CASE WHEN t = 'exact' AND ml >= 10 AND ms >= 5 THEN 'extract_method' WHEN t = 'exact' AND ml >= 5 THEN 'extract_function' WHEN t = 'structural' AND ml >= 15 AND ms >= 8 THEN 'parameterize' WHEN t = 'structural' AND ml >= 8 THEN 'extract_method'
WHEN t = 'semantic' AND ml >= 20 AND ms >= 10 THEN 'template_method' WHEN t = 'semantic' AND ml >= 10 THEN 'parameterize' WHEN t = 'hybrid' AND ml >= 12 AND ms >= 6 THEN 'extract_method' ELSE 'no_extraction' END AS strategy FROM y),
c AS (SELECT *, CASE WHEN strategy = 'no_extraction' THEN 0.0::DOUBLE WHEN t = 'exact' AND strategy = 'extract_method' THEN least(0.95::DOUBLE, feasible + 0.15::DOUBLE) WHEN t = 'exact' THEN least(0.85::DOUBLE, feasible + 0.05::DOUBLE)
WHEN t = 'structural' AND strategy = 'parameterize' THEN least(0.85::DOUBLE, feasible) WHEN t = 'structural' THEN least(0.8::DOUBLE, feasible) WHEN t = 'semantic' AND strategy = 'template_method' THEN least(0.75::DOUBLE, feasible)
WHEN t = 'semantic' THEN least(0.7::DOUBLE, feasible) ELSE least(0.9::DOUBLE, feasible + 0.05::DOUBLE) END AS conf FROM z),
r AS (SELECT *, least(1.0::DOUBLE, (sim * 0.3::DOUBLE + least(1.0::DOUBLE, n / 10.0::DOUBLE) * 0.2::DOUBLE + least(1.0::DOUBLE, ml / 20.0::DOUBLE) * 0.2::DOUBLE + conf * 0.2::DOUBLE + CASE WHEN n_files > 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
* CASE t WHEN 'exact' THEN 1.0 WHEN 'hybrid' THEN 0.95 WHEN 'structural' THEN 0.9 ELSE 0.8 END::DOUBLE) AS ranking FROM c)
"""


def _blocks(t: Tables) -> DataFrame:
    """Parts in the role of blocks of code."""
    return t.part.selectExpr(
        "p_partkey AS block_uid", "p_name || '|' || p_brand || '|' || p_type AS token_fingerprint", "p_name || '|' || p_brand AS ast_fingerprint", "p_brand || '|' || p_size AS normalized_fingerprint", "p_size AS lines_of_code",
        "p_size % 12 AS statement_count", "p_partkey % 6 AS nesting_level", "CASE p_partkey % 3 WHEN 0 THEN 'function_body' WHEN 1 THEN 'if' ELSE 'class_body' END AS block_type", "p_partkey % 7 AS file_path",
        "p_partkey AS line_start", "p_partkey + p_size AS line_end",
    )


@query(_BLOCKS + """SELECT t AS clone_type, fp AS fingerprint, n::BIGINT AS group_size, sim AS similarity, total_lines, ml AS mean_lines, feasible, n_files, representative, strategy, conf AS extraction_confidence, ranking FROM r WHERE ranking > 0.35""")
def clone_ranking(t: Tables) -> DataFrame:
    """Passes, coverage, strategy, ranking."""
    out = C.ranked_clones(C.clone_groups(_blocks(t)), _blocks(t))
    return out.select("clone_type", "fingerprint", "group_size", "similarity", "total_lines", "mean_lines", "feasible", "n_files", "representative", "strategy", "extraction_confidence", "ranking")


@query(_BLOCKS + """SELECT t AS clone_type, count(*)::BIGINT AS n_groups, sum(n)::BIGINT AS n_members, max(n)::BIGINT AS largest, round(avg(sim), 6) AS mean_similarity FROM g GROUP BY 1""")
def clone_statistics(t: Tables) -> DataFrame:
    """A16."""
    return views.clone_statistics(C.clone_groups(_blocks(t))).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(_BLOCKS + """, top AS (SELECT * FROM r WHERE ranking > 0.35), p AS (SELECT top.t, top.fp, b.f || ':' || b.k || '-' || (b.k + b.loc) AS s, row_number() OVER (PARTITION BY top.t, top.fp ORDER BY b.k) AS i FROM top JOIN g USING (t, fp) JOIN b ON list_contains(g.m, b.k))
SELECT top.t AS clone_type, top.n::BIGINT AS group_size, top.total_lines, (SELECT string_agg(s, ' ' ORDER BY i) FROM p WHERE p.t = top.t AND p.fp = top.fp AND i <= 5) AS preview FROM top""")
def clone_summary(t: Tables) -> DataFrame:
    """All groups, five places of each shown."""
    out = C.clone_summary(C.ranked_clones(C.clone_groups(_blocks(t)), _blocks(t)), _blocks(t), most=None)
    return out.select("clone_type", "group_size", "total_lines", F.array_join("preview", " ").alias("preview"))


_DECISIONS = """WITH d AS (SELECT user_id, event_type, count(*) AS n, max(round(value * 100)::BIGINT) AS v FROM events GROUP BY 1, 2),
g AS (SELECT p_name || '|' || p_brand AS target, count(*) AS n, sum(p_size) AS s FROM part GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT target, n, 0.9::DOUBLE AS sim, CASE WHEN s % 4 = 0 THEN 'extract_function' WHEN s % 4 = 1 THEN 'parameterize' WHEN s % 4 = 2 THEN 'template_method' ELSE 'no_extraction' END AS st, s % 100 / 100.0::DOUBLE AS conf, CASE WHEN s % 2 = 0 THEN 'exact' ELSE 'semantic' END AS t FROM g),
f AS (SELECT CASE st WHEN 'extract_function' THEN 'extract_method' WHEN 'parameterize' THEN 'parameterize_duplicates' WHEN 'template_method' THEN 'template_method_pattern' ELSE 'eliminate_duplicates' END AS decision_type, target, greatest(sim, conf, 0.5::DOUBLE) AS confidence,
least(1.0::DOUBLE, 0.3::DOUBLE + n * 0.1::DOUBLE) AS impact, least(1.0::DOUBLE, 0.2::DOUBLE + n * 0.1::DOUBLE) AS effort, CASE t WHEN 'exact' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS risk, greatest(0.5::DOUBLE, n * 0.5::DOUBLE) AS hours FROM c WHERE NOT (st = 'no_extraction' AND conf < 0.5)
UNION ALL SELECT CASE event_type WHEN 'error' THEN 'decompose_god_class' WHEN 'purchase' THEN 'extract_method' WHEN 'signup' THEN 'reduce_method_complexity' WHEN 'view' THEN 'reduce_coupling' ELSE 'improve_cohesion' END, user_id || event_type, least(1.0::DOUBLE, n * 0.05::DOUBLE),
CASE v // 5000 WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 0.9 END::DOUBLE, CASE v // 5000 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.8 END::DOUBLE, CASE WHEN v // 5000 >= 2 THEN 0.5 ELSE 0.3 END::DOUBLE,
CASE v // 5000 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.8 END::DOUBLE * 8 FROM d
UNION ALL SELECT 'remove_unused_code', 'part ' || p_partkey, p_size / 50.0::DOUBLE, 0.6::DOUBLE, 0.2::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE FROM part WHERE p_size / 50.0::DOUBLE >= 0.8),
s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (impact * 0.3::DOUBLE + 0.0::DOUBLE * 0.2::DOUBLE + 0.0::DOUBLE * 0.25::DOUBLE + (1.0::DOUBLE - risk) * 0.15::DOUBLE + (1.0::DOUBLE - effort) * 0.1::DOUBLE) * confidence)) AS score, impact * confidence * (1.0::DOUBLE - risk * 0.3::DOUBLE) AS rank_score FROM f)
"""


@query(_DECISIONS + """SELECT decision_type, target, confidence, impact, effort, risk, hours, score, CASE WHEN confidence < 0.5 AND impact > 0.6 THEN 'deferred' WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS priority, rank_score
FROM s WHERE confidence >= 0.7 AND impact >= 0.5 AND effort <= 0.8""")
def decisions_ranked(t: Tables) -> DataFrame:
    """Groups of parts as clones, users' events as smells, parts as unused symbols."""
    g = t.part.groupBy(F.concat_ws("|", "p_name", "p_brand").alias("group_id")).agg(F.count("*").alias("group_size"), F.sum("p_size").alias("s")).where("group_size >= 2")
    clones = g.selectExpr(
        "group_id", "group_size", "CAST(0.9 AS DOUBLE) AS similarity", "CASE s % 4 WHEN 0 THEN 'extract_function' WHEN 1 THEN 'parameterize' WHEN 2 THEN 'template_method' ELSE 'no_extraction' END AS strategy",
        "s % 100 / 100D AS extraction_confidence", "CASE WHEN s % 2 = 0 THEN 'exact' ELSE 'semantic' END AS clone_type",
    )
    d = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(cents("value")).alias("v"))
    smells = d.selectExpr(
        "user_id || event_type AS target", "CASE event_type WHEN 'error' THEN 'god_class' WHEN 'purchase' THEN 'long_method' WHEN 'signup' THEN 'high_complexity' WHEN 'view' THEN 'feature_envy' ELSE 'other' END AS smell_type",
        "CASE v DIV 5000 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity", "n * 0.05D AS confidence",
    )
    unused = t.part.selectExpr("'part ' || p_partkey AS target", "p_size / 50D AS confidence")
    return R.decisions(clones, smells, unused)


@query("""SELECT page_id, CASE WHEN url LIKE '%.example.net/%' THEN 'network' WHEN url LIKE '%/de/%' THEN 'german' WHEN regexp_matches(url, '[?]utm_') THEN 'tracked' ELSE 'uncategorised' END AS category FROM pages""")
def categorize_rules(t: Tables) -> DataFrame:
    """The rules are a table."""
    rules = t.spark.createDataFrame([(1, "url", r"\.example\.net/", "network"), (2, "url", "/de/", "german"), (3, "url", "[?]utm_", "tracked")], "priority int, field string, pattern string, category string")
    return R.categorised(t.pages, "page_id", rules).select("page_id", "category")


@query("""WITH m AS (SELECT o_custkey AS k, count(*) AS methods, count(DISTINCT o_orderpriority) AS resp, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS cohesion, sum(round(o_totalprice)::BIGINT) // 20000 AS lines FROM orders GROUP BY 1),
p AS (SELECT *, CASE WHEN methods > 30 THEN 2 WHEN methods > 15 THEN 1 ELSE 0 END + CASE WHEN resp > 6 THEN 2 WHEN resp > 3 THEN 1 ELSE 0 END + CASE WHEN cohesion < 0.25 THEN 2 WHEN cohesion < 0.5 THEN 1 ELSE 0 END AS points
FROM m WHERE methods > 15 OR resp > 3 OR cohesion < 0.5 OR lines > 200)
SELECT k, points::INT AS points, CASE WHEN points >= 4 THEN 'critical' WHEN points >= 3 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS severity, least(1.0::DOUBLE, points::DOUBLE / 6 + 0.3::DOUBLE) AS confidence FROM p""")
def smells(t: Tables) -> DataFrame:
    """M1, M2: customers in the role of classes."""
    m = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("method_count"), F.count_distinct("o_orderpriority").alias("responsibility_count"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("cohesion"),
        F.expr("sum(CAST(round(o_totalprice) AS BIGINT)) DIV 20000").alias("lines"),
    )
    return R.god_class(m).select("k", "points", "severity", "confidence")


@query("""WITH u AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS one FROM lineitem WHERE l_quantity >= 47 GROUP BY 1)
SELECT p_partkey, (CASE WHEN p_size > 25 THEN 70 ELSE 80 END * CASE p_type WHEN 'SMALL' THEN 40 WHEN 'PROMO' THEN 60 ELSE 100 END)::BIGINT AS confidence FROM part LEFT JOIN u ON l_partkey = p_partkey WHERE n IS NULL OR n = 1 AND one = p_partkey % 100""")
def unused_symbols(t: Tables) -> DataFrame:
    """A use from the own scope does not count."""
    symbols = t.part.select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 100).alias("file_id"), (F.col("p_size") > 25).alias("is_public"), (F.col("p_type") == "SMALL").alias("dynamic_import"), F.col("p_type").isin("PROMO", "SMALL").alias("dynamic"))
    uses = t.lineitem.where("l_quantity >= 47").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file_id"))
    out = R.unused_symbols(symbols, uses, 0.0)
    return out.select(F.col("name").alias("p_partkey"), F.round(F.col("confidence") * 10000).cast("long").alias("confidence"))


@query("""WITH o AS (SELECT o_orderkey AS k, round(o_totalprice)::BIGINT // 8000 AS lines, count(*) AS n, sum(l_linenumber)::BIGINT AS st, count(*) FILTER (l_returnflag <> 'N') AS ext, max(l_linenumber) AS nest, o_custkey % 2 = 0 AS ic
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, o_custkey),
p AS (SELECT *, CASE WHEN lines > 60 THEN 2 WHEN lines > 30 THEN 1 ELSE 0 END + CASE WHEN st > 40 THEN 2 WHEN st > 20 THEN 1 ELSE 0 END AS lp, CASE WHEN st > 20 THEN 2 WHEN st > 10 THEN 1 ELSE 0 END + CASE WHEN nest > 6 THEN 2 WHEN nest > 4 THEN 1 ELSE 0 END AS cp, ext::DOUBLE / n AS ratio FROM o)
SELECT k, 'long_method' AS smell_type, CASE WHEN lp >= 3 THEN 'high' WHEN lp >= 2 THEN 'medium' ELSE 'low' END AS severity, least(1.0::DOUBLE, lp::DOUBLE / 4 + 0.4::DOUBLE) AS confidence FROM p WHERE lines > 30 OR st > 20
UNION ALL SELECT k, 'high_complexity', CASE WHEN cp >= 3 THEN 'high' WHEN cp >= 2 THEN 'medium' ELSE 'low' END, least(1.0::DOUBLE, cp::DOUBLE / 4 + 0.5::DOUBLE) FROM p WHERE st > 10 OR nest > 4
UNION ALL SELECT k, 'feature_envy', CASE WHEN ratio > 0.9 THEN 'high' WHEN ratio > 0.8 THEN 'medium' ELSE 'low' END, least(1.0::DOUBLE, ratio + 0.2::DOUBLE) FROM p WHERE ratio > 0.7 AND n >= 3 AND ic""")
def method_smells(t: Tables) -> DataFrame:
    """M3, M4, M6: orders in the role of methods."""
    o = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("k"), F.expr("CAST(round(o_totalprice) AS BIGINT) DIV 8000").alias("lines"), "o_custkey")
    n = F.count("*")
    m = o.agg(n.alias("accesses"), F.sum("l_linenumber").alias("statements"), F.sum("l_linenumber").alias("complexity"), F.max("l_linenumber").alias("nesting"), F.count_if(F.col("l_returnflag") != "N").alias("external_accesses"))
    return R.method_smells(m.withColumn("in_class", F.col("o_custkey") % 2 == 0)).select("k", "smell_type", "severity", "confidence")


@query("""WITH s AS (SELECT l_partkey AS k, count(*) AS n, count(DISTINCT l_suppkey) AS ext, count(DISTINCT l_linenumber) AS duties, count(*) FILTER (l_tax > 0.04) AS priv FROM lineitem GROUP BY 1)
SELECT k, 'srp_violation' AS smell_type, CASE WHEN duties > 6 THEN 'high' WHEN duties > 3 THEN 'medium' ELSE 'low' END AS severity, least(1.0::DOUBLE, duties::DOUBLE / 10 + 0.4::DOUBLE) AS confidence FROM s WHERE duties > 3 OR ext > 5
UNION ALL SELECT k, 'inappropriate_intimacy', CASE WHEN priv > 6 THEN 'high' WHEN priv > 4.5 THEN 'medium' ELSE 'low' END, least(1.0::DOUBLE, priv::DOUBLE / 10 + 0.3::DOUBLE) FROM s WHERE priv > 3 AND (priv::DOUBLE / n > 0.8 OR priv >= 6)""")
def access_smells(t: Tables) -> DataFrame:
    """M5, M7: parts in the role of classes."""
    s = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(
        F.count("*").alias("foreign_accesses"), F.count_distinct("l_suppkey").alias("external_dependencies"), F.count_distinct("l_linenumber").alias("responsibility_count"), F.count_if(F.col("l_tax") > 0.04).alias("private_accesses")
    )
    return R.class_smells(s).select("k", "smell_type", "severity", "confidence")


@query("""WITH q AS (SELECT v.vec_id AS q, v.embedding AS e FROM embeddings v WHERE v.vec_id % 20 = 0),
s AS (SELECT q, vec_id, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS c FROM q, embeddings WHERE vec_id <> q)
SELECT q, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, vec_id) = 1""")
def embedding_neighbors(t: Tables) -> DataFrame:
    """J25 extension: nearest vector of each twentieth, against all rows. The
    queries travel as one block of a size checked before it is broadcast."""
    from ..operators.vectors import nearest

    return nearest(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 1).select("q", "vec_id")
