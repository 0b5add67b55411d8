"""Lookups, joins, aggregations and windows on the star tables.

Money is summed in whole cents, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import lookups as L
from ..sources.tables import Tables
from .registry import query


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query("""SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def lookup_join_topk(t: Tables) -> DataFrame:
    """F8, F10, J1, T1."""
    joined = t.orders.join(L.lookup(t.customer, c_mktsegment="BUILDING"), F.col("o_custkey") == F.col("c_custkey"))
    return L.top_k(joined, 100, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' ORDER BY o_orderkey")
def point_lookup(t: Tables) -> DataFrame:
    """F1-F7."""
    return L.lookup(t.orders, ["o_orderkey"], o_custkey=7, o_orderstatus="F").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%rand#1%'")
def search_ilike(t: Tables) -> DataFrame:
    """F9, H6."""
    red = F.col("p_name").ilike("%RED%") | F.col("p_brand").ilike("%rand#1%")
    return t.part.where(red).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')")
def ids_semi(t: Tables) -> DataFrame:
    """F11, J5."""
    ids = t.lineitem.where("l_quantity >= 49 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return L.by_ids(t.part, ids, "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#2')")
def knowledge_search(t: Tables) -> DataFrame:
    """F17."""
    return L.concat_search(t.part, "ring BRAND#2", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_type")


@query("""SELECT md5(text) AS fingerprint, count(*)::BIGINT AS group_size, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members
FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) >= 2""")
def exact_duplicates(t: Tables) -> DataFrame:
    """A1, C2."""
    hashed = t.documents.where("text != ''").select("doc_id", F.md5("text").alias("fingerprint"))
    groups = A.repeated_groups(hashed, "fingerprint", "doc_id")
    return groups.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("""SELECT md5(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'))) AS fingerprint, count(*)::BIGINT AS group_size, 0.9::DOUBLE AS similarity
FROM documents GROUP BY 1 HAVING count(*) >= 2""")
def structural_duplicates(t: Tables) -> DataFrame:
    """The score is the parameter."""
    shape = F.md5(F.lower(F.regexp_replace("text", "[^a-zA-Z]+", " ")))
    groups = A.repeated_groups(t.documents.select("doc_id", shape.alias("fingerprint")), "fingerprint", "doc_id")
    return groups.drop("members").withColumn("similarity", F.lit(0.9))


@query("""SELECT md5(lower(trim(text))) AS fingerprint, count(*)::BIGINT AS group_size, min(doc_id)::BIGINT AS first_doc FROM documents
WHERE n_chars >= 500 GROUP BY 1 HAVING count(*) >= 2""")
def block_clones_min_size(t: Tables) -> DataFrame:
    """A3."""
    blocks = t.documents.where("n_chars >= 500").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("fingerprint"))
    return A.repeated_groups(blocks, "fingerprint", "doc_id").withColumn("first_doc", F.element_at("members", 1)).drop("members")


@query("""SELECT g.f AS first_member, d.doc_id, g.n::BIGINT AS group_size FROM documents d
JOIN (SELECT md5(text) AS h, min(doc_id) AS f, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) g ON md5(d.text) = g.h WHERE d.doc_id > g.f""")
def clone_pairs(t: Tables) -> DataFrame:
    """J11, as each member with its group's first."""
    out = J.representative_pairs(t.documents.select("doc_id", F.md5("text").alias("h")), "h", "doc_id")
    return out.select("first_member", "doc_id", "group_size")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 30)")
def duplicates_semi(t: Tables) -> DataFrame:
    """J10."""
    return J.in_repeated(t.part, "p_name", 30).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 48)")
def unused_anti(t: Tables) -> DataFrame:
    """J8, U1."""
    return J.without(t.part, t.lineitem.where("l_returnflag = 'R' AND l_quantity >= 48"), "p_partkey", "l_partkey").select("p_partkey", "p_name")


@query("""SELECT 'lineitem_without_big_order' AS check_name, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)
UNION ALL SELECT 'orders_without_building_customer', count(*)::BIGINT FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def orphan_counts(t: Tables) -> DataFrame:
    """J9."""
    a = J.without(t.lineitem, t.orders.where("o_totalprice > 400000"), "l_orderkey", "o_orderkey")
    b = J.without(t.orders, t.customer.where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    return one(a, "lineitem_without_big_order").unionByName(one(b, "orders_without_building_customer"))


@query("""SELECT count(*)::BIGINT AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) FILTER (o_totalprice > 400000)::BIGINT AS n_above,
count(*) FILTER (o_totalprice > 400000)::DOUBLE / count(*) AS share_above, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents FROM orders""")
def complexity_distribution(t: Tables) -> DataFrame:
    """A4."""
    out = t.orders.agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count_if(F.col("o_totalprice") > 400000).alias("n_above"), F.sum(cents("o_totalprice")).alias("total_cents"))
    return out.withColumn("share_above", F.col("n_above") / F.col("n"))


@query("""SELECT count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest FROM documents""")
def file_statistics(t: Tables) -> DataFrame:
    """A5."""
    return t.documents.agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("""SELECT 'customer' AS name, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'orders', count(*)::BIGINT FROM orders
UNION ALL SELECT 'lineitem', count(*)::BIGINT FROM lineitem UNION ALL SELECT 'events', count(*)::BIGINT FROM events""")
def table_counts(t: Tables) -> DataFrame:
    """A6, D5."""
    out = None
    for name in ("customer", "orders", "lineitem", "events"):
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1")
def kind_breakdown(t: Tables) -> DataFrame:
    """A7, A8."""
    return A.breakdown(t.events, ["event_type"], users=F.count_distinct("user_id"), cents=F.sum(cents("value")))


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def category_grouping_sets(t: Tables) -> DataFrame:
    """A7 by rollup."""
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END)::BIGINT AS returned_parts
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def file_summary_distinct(t: Tables) -> DataFrame:
    """Each side is aggregated before it is joined."""
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderkey").alias("n_orders"))
    back = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    back = back.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("l_partkey").alias("returned_parts"))
    return t.customer.select("c_custkey").join(orders, "c_custkey", "left").join(back, "c_custkey", "left").na.fill(0, ["n_orders", "returned_parts"])


@query("""SELECT p_partkey, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = p_partkey)::BIGINT AS n_orders,
(SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')::BIGINT AS n_suppliers_returned,
(SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)::BIGINT AS n_large FROM part""")
def symbol_relationships(t: Tables) -> DataFrame:
    """One pass with three conditional aggregates."""
    rel = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("n_suppliers_returned"), F.count_if(F.col("l_quantity") > 45).alias("n_large")
    )
    return t.part.select("p_partkey").join(rel, "p_partkey", "left").na.fill(0)


@query("""WITH fanin AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS fan_in FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_nationkey, sum(CASE WHEN l_returnflag = 'A' THEN round(l_quantity)::BIGINT ELSE 0 END)::BIGINT AS internal_uses, count(DISTINCT nullif(l_partkey, 0))::BIGINT AS parts,
(SELECT sum(f.fan_in) FROM fanin f JOIN supplier s2 ON f.l_suppkey = s2.s_suppkey WHERE s2.s_nationkey = s.s_nationkey)::BIGINT AS fan_in
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s_nationkey""")
def dependency_hubs(t: Tables) -> DataFrame:
    """The correlated fan-in is aggregated by itself and joined."""
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    uses = t.lineitem.join(supplier, "l_suppkey").groupBy("s_nationkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "A", F.round("l_quantity").cast("long")).otherwise(0)).alias("internal_uses"), F.count_distinct(F.nullif(F.col("l_partkey"), F.lit(0))).alias("parts")
    )
    into = J.fan_in(t.lineitem.where("l_returnflag = 'R'"), "l_suppkey", "l_orderkey").join(supplier, "l_suppkey").groupBy("s_nationkey").agg(F.sum("fan_in").alias("fan_in"))
    return uses.join(into, "s_nationkey", "left")


@query("SELECT l_partkey, l_returnflag, sum(round(l_quantity)::BIGINT)::BIGINT AS uses FROM lineitem GROUP BY 1, 2 ORDER BY uses DESC, l_partkey, l_returnflag LIMIT 50")
def top_external_targets(t: Tables) -> DataFrame:
    """A10."""
    uses = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(F.sum(F.round("l_quantity").cast("long")).alias("uses"))
    return L.top_k(uses, 50, F.desc("uses"), "l_partkey", "l_returnflag")


def _trade(t: Tables) -> DataFrame:
    """Lines as edges from the customer's to the supplier's nation."""
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    lines = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"), "l_returnflag", "l_quantity", "l_discount")
    out = lines.join(orders, "l_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    return out.join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")


@query("""SELECT c_nationkey, s_nationkey, l_returnflag, sum(round(l_quantity)::BIGINT)::BIGINT AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3""")
def file_edges(t: Tables) -> DataFrame:
    """J16, G11."""
    out = _trade(t).where("c_nationkey != s_nationkey").groupBy("c_nationkey", "s_nationkey", "l_returnflag")
    return out.agg(F.sum(F.round("l_quantity").cast("long")).alias("weight"))


@query("""WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b, round((1 - l_discount) * 100)::BIGINT AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND c_nationkey <> s_nationkey),
n AS (SELECT a AS node, b AS neighbor, 'imports' AS relation, conf FROM e UNION ALL SELECT b, a, 'imported_by', conf FROM e)
SELECT neighbor, relation, count(*)::BIGINT AS edge_count, sum(conf)::DOUBLE / count(*) AS mean_confidence FROM n WHERE node = 3 GROUP BY 1, 2 ORDER BY edge_count DESC, neighbor, relation LIMIT 30""")
def neighbors(t: Tables) -> DataFrame:
    """J7, U4, T2."""
    edges = _trade(t).where("l_returnflag = 'R'").select("c_nationkey", "s_nationkey", F.round((1 - F.col("l_discount")) * 100).cast("long").alias("conf"))
    both = J.edge_neighbors(edges, "c_nationkey", "s_nationkey", "imports", "imported_by").where("node = 3")
    out = both.groupBy("neighbor", "relation").agg(F.count("*").alias("edge_count"), (F.sum("conf").cast("double") / F.count("*")).alias("mean_confidence"))
    return L.top_k(out, 30, F.desc("edge_count"), "neighbor", "relation")


@query("""SELECT l_suppkey, count(*)::BIGINT AS uses, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_name = 'red' OR p_name LIKE 'red %' GROUP BY 1""")
def importers(t: Tables) -> DataFrame:
    """J6."""
    named = t.part.where((F.col("p_name") == "red") | F.col("p_name").startswith("red ")).select(F.col("p_partkey").alias("l_partkey"))
    out = t.lineitem.join(named, "l_partkey").groupBy("l_suppkey")
    return out.agg(F.count("*").alias("uses"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("kinds"))


_SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END"


@query(f"""WITH s AS (SELECT *, {_SEVERITY} AS severity FROM events), w AS (SELECT *, CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 0.25 END::DOUBLE AS weight,
row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM s)
SELECT user_id, sum(weight * round(value * 100)) AS score, count(*)::BIGINT AS n, string_agg(CASE WHEN r <= 5 THEN event_id::VARCHAR END, ',' ORDER BY r) AS examples FROM w GROUP BY 1""")
def hotspots(t: Tables) -> DataFrame:
    """Users in the role of files, whole hundredths as confidence."""
    found = t.events.withColumn("severity", F.expr(_SEVERITY))
    out = A.weighted_hotspots(found, "user_id", "severity", cents("value").cast("double"), "event_id", [F.desc("value"), F.col("event_id")])
    return out.select("user_id", "score", "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query(f"""WITH s AS (SELECT sum(CASE {_SEVERITY} WHEN 'critical' THEN 250 WHEN 'high' THEN 100 WHEN 'medium' THEN 40 WHEN 'low' THEN 15 ELSE 0 END
+ CASE event_type WHEN 'error' THEN 8 WHEN 'view' THEN 4 WHEN 'click' THEN 3 ELSE 0 END) / 10.0::DOUBLE AS penalty, count(DISTINCT user_id)::BIGINT AS files FROM events)
SELECT penalty, files, 100.0::DOUBLE / (1.0::DOUBLE + penalty / greatest(files * 15.0::DOUBLE, 1.0::DOUBLE)) AS score FROM s""")
def health_score(t: Tables) -> DataFrame:
    """A14."""
    kind = F.expr("CASE event_type WHEN 'error' THEN 'duplicate_block' WHEN 'view' THEN 'unused_code' WHEN 'click' THEN 'quality_issue' ELSE 'other' END")
    found = t.events.withColumns({"severity": F.expr(_SEVERITY), "kind": kind})
    out = A.health_penalty(found, "severity", "kind").crossJoin(t.events.agg(F.count_distinct("user_id").alias("files")))  # one row each
    return out.withColumn("score", A.health_score(F.col("penalty"), F.col("files")))


@query("""SELECT event_type, CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS band, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1, 2""")
def audit_stats(t: Tables) -> DataFrame:
    """A15, A17, A18."""
    return t.events.withColumn("band", A.band(F.col("value"), 80, 50)).groupBy("event_type", "band").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT a.user_id, a.event_id AS a, b.event_id AS b, (epoch_us(b.ts) - epoch_us(a.ts))::BIGINT AS micros FROM events a JOIN events b ON a.user_id = b.user_id
WHERE (b.ts > a.ts OR b.ts = a.ts AND b.event_id > a.event_id) AND epoch_us(b.ts) - epoch_us(a.ts) <= 600000000""")
def overlap_findings(t: Tables) -> DataFrame:
    """J24."""
    return J.near_in_time(t.events, "user_id", "ts", "event_id", 600)


@query("SELECT p_type, p_brand AS owner, n::BIGINT AS n FROM (SELECT p_type, p_brand, sum(count(*)) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2) WHERE r = 1 AND n >= 2")
def capability_owner(t: Tables) -> DataFrame:
    """A20."""
    return A.owner(t.part, ["p_type"], "p_brand")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS position FROM orders QUALIFY position <= 3")
def first_per_group(t: Tables) -> DataFrame:
    """W2, W3."""
    return A.first_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "position")


@query("SELECT p_partkey, p_name, (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1)::INT AS occurrence FROM part")
def occurrence_index(t: Tables) -> DataFrame:
    """W1."""
    return J.occurrence(t.part, ["p_name"], ["p_partkey"]).select("p_partkey", "p_name", "occurrence")


@query("SELECT event_id, ntile(10) OVER (PARTITION BY event_type ORDER BY value, event_id)::INT AS decile FROM events")
def slow_deciles(t: Tables) -> DataFrame:
    """W8, A31."""
    return A.deciles(t.events, "value", "event_id", ["event_type"]).select("event_id", "decile")


@query("""WITH d AS (SELECT user_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM events)
SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_files, string_agg(DISTINCT CASE WHEN r <= 5 THEN user_id END::VARCHAR, ',' ORDER BY CASE WHEN r <= 5 THEN user_id END::VARCHAR) AS files FROM d GROUP BY 1""")
def usage_by_name(t: Tables) -> DataFrame:
    """A19."""
    out = A.usage_by_name(t.events, "event_type", "user_id")
    return out.withColumn("files", F.array_join(F.sort_array(F.col("files").cast("array<string>")), ","))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_partkey AS a, b.l_partkey AS b, count(*)::BIGINT AS times FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) > 1""")
def co_change(t: Tables) -> DataFrame:
    """A25, H13."""
    return A.co_occurring(t.lineitem, "l_orderkey", "l_partkey")


@query("""WITH f AS (SELECT l_partkey, count(DISTINCT l_orderkey)::BIGINT AS fan_out, max(round(l_discount * 100)::BIGINT)::BIGINT AS hot FROM lineitem GROUP BY 1 ORDER BY fan_out DESC, l_partkey LIMIT 40)
SELECT l_partkey, fan_out, fan_out * (100 + hot) AS rescored FROM f""")
def keystones(t: Tables) -> DataFrame:
    """T4: the limit comes before the second score."""
    out = t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("fan_out"), F.max(cents("l_discount")).alias("hot"))
    return L.two_stage_top(out, "fan_out", 40, F.col("fan_out") * (100 + F.col("hot")), "l_partkey").drop("hot")


@query("""WITH h AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY sum(round(l_quantity)::BIGINT) DESC, l_suppkey LIMIT 20)
SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM h) GROUP BY 1, 2""")
def external_node_cap(t: Tables) -> DataFrame:
    """A capped report of the heaviest nodes."""
    edges = t.lineitem.select("l_suppkey", "l_returnflag", F.round("l_quantity").cast("long").alias("w"))
    return L.capped_nodes(edges, "l_suppkey", "w", 20).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("""SELECT 'price_positive' AS rule, count(*)::BIGINT AS checked, count(*) FILTER (NOT l_extendedprice > 0)::BIGINT AS broken FROM lineitem
UNION ALL SELECT 'discount_in_range', count(*)::BIGINT, count(*) FILTER (NOT l_discount BETWEEN 0.0 AND 0.05)::BIGINT FROM lineitem
UNION ALL SELECT 'flag_known', count(*)::BIGINT, count(*) FILTER (NOT l_returnflag IN ('A', 'N'))::BIGINT FROM lineitem
UNION ALL SELECT 'quantity_whole', count(*)::BIGINT, count(*) FILTER (NOT l_quantity = floor(l_quantity))::BIGINT FROM lineitem""")
def dq_rules(t: Tables) -> DataFrame:
    """F20, D7."""
    rules = {"price_positive": F.col("l_extendedprice") > 0, "discount_in_range": F.col("l_discount").between(0.0, 0.05), "flag_known": F.col("l_returnflag").isin("A", "N"), "quantity_whole": F.col("l_quantity") == F.floor("l_quantity")}
    return L.violations(t.lineitem, rules)


@query("""SELECT user_id, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(*) FILTER ((props->>'$.k')::BIGINT > 50)::BIGINT AS k_large FROM events GROUP BY 1""")
def json_props(t: Tables) -> DataFrame:
    """The JSON family."""
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("user_id").agg(F.sum(k).alias("k_sum"), F.count_if(k > 50).alias("k_large"))


@query("""WITH old AS (SELECT p_partkey, md5(p_brand) AS h FROM part), new AS (SELECT p_partkey + 5 AS p_partkey, md5(p_brand) AS h FROM part)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new n FULL JOIN old o ON n.p_partkey = o.p_partkey WHERE n.h IS DISTINCT FROM o.h""")
def changed_files(t: Tables) -> DataFrame:
    """The whole table, and the same rows five keys on, compared by hash."""
    from ..sources.code import changes

    old = t.part.select("p_partkey", F.md5("p_brand").alias("h"))
    return changes(old, old.withColumn("p_partkey", F.col("p_partkey") + 5), "p_partkey", "h")


@query("""WITH old AS (SELECT p_name, p_brand, min(p_size) AS sig FROM part GROUP BY 1, 2), new AS (SELECT p_name, 'Brand#' || CAST(substr(p_brand, 7) AS INT) % 25 + 1 AS p_brand, min(p_size) AS sig FROM part GROUP BY 1, 2)
SELECT p_name, p_brand, 'removed' AS change FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.p_name = o.p_name AND n.p_brand = o.p_brand)
UNION ALL SELECT o.p_name, o.p_brand, 'signature' FROM old o JOIN new n ON n.p_name = o.p_name AND n.p_brand = o.p_brand WHERE n.sig <> o.sig""")
def api_diff(t: Tables) -> DataFrame:
    """All parts, and all of them under the next brand."""
    old = t.part.groupBy("p_name", "p_brand").agg(F.min("p_size").alias("sig"))
    new = old.withColumn("p_brand", F.concat(F.lit("Brand#"), (F.substring("p_brand", 7, 9).cast("int") % 25 + 1).cast("string")))
    gone = old.join(new, ["p_name", "p_brand"], "left_anti").select("p_name", "p_brand", F.lit("removed").alias("change"))
    moved = old.join(new.withColumnRenamed("sig", "new_sig"), ["p_name", "p_brand"]).where("sig != new_sig")
    return gone.unionByName(moved.select("p_name", "p_brand", F.lit("signature").alias("change")))


@query("""SELECT p_partkey, p_name FROM part WHERE p_size > 45 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 40) l WHERE l.l_partkey = part.p_partkey)""")
def missing_tests(t: Tables) -> DataFrame:
    """U3."""
    return J.without(t.part.where("p_size > 45"), t.lineitem.where("l_quantity > 40"), "p_partkey", "l_partkey").select("p_partkey", "p_name")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, list_sort(list(DISTINCT o_orderstatus)) AS st FROM orders GROUP BY 1, 2),
p AS (SELECT a.o_custkey, a.st AS x, b.st AS y FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW')
SELECT o_custkey, array_to_string(list_sort(list_intersect(x, y)), ',') AS common, array_to_string(list_sort(list_filter(x, lambda e: NOT list_contains(y, e))), ',') AS only_a,
array_to_string(list_sort(list_filter(y, lambda e: NOT list_contains(x, e))), ',') AS only_b FROM p""")
def operations_compared(t: Tables) -> DataFrame:
    """U5."""
    from ..operators.similarity import operations_compared as compared

    sets = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.collect_set("o_orderstatus").alias("st"))
    a = sets.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("st").alias("x"))
    b = sets.where("o_orderpriority = '5-LOW'").select("o_custkey", F.col("st").alias("y"))
    out = compared(a.join(b, "o_custkey"), "x", "y")
    return out.select("o_custkey", *(F.array_join(c, ",").alias(c) for c in ("common", "only_a", "only_b")))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) = 1 AS f, substr('c' || lpad(p_partkey::VARCHAR, 9, '0'), 1, 8) AS short FROM part), b AS (SELECT *, NOT f AND p_size % 2 = 0 AS s FROM a),
c AS (SELECT *, s AND row_number() OVER (PARTITION BY p_type, p_name, p_brand, s ORDER BY p_partkey) = 1 AS h FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_name, NOT f AND NOT h, short ORDER BY p_partkey) AS r FROM c)
SELECT p_partkey, CASE WHEN f THEN p_name WHEN h THEN p_name || '__' || p_brand WHEN r = 1 THEN p_name || '__' || short ELSE p_name || '__' || short || '__' || r END AS target FROM d""")
def unique_target_names(t: Tables) -> DataFrame:
    """W9."""
    rows = t.part.select("p_partkey", "p_type", "p_name", F.expr("CASE WHEN p_size % 2 = 0 THEN p_brand END AS holder"), F.expr("'c' || lpad(CAST(p_partkey AS STRING), 9, '0') AS k"))
    return A.unique_targets(rows, ["p_type"], "p_name", "holder", "k").select("p_partkey", "target")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1, 2")
def event_windows(t: Tables) -> DataFrame:
    """2.14: tumbling windows in batch form."""
    out = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "users")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def event_sessions(t: Tables) -> DataFrame:
    """2.14: sessions with gaps over 30 minutes."""
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(user) <= F.expr("INTERVAL '30' MINUTE"), 0).otherwise(1)
    out = t.events.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(user))
    return out.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("k")
