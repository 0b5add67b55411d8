"""Graph operators (G1-G13, A23, T10). Loops write their state to the shared
folder each round, so that lineage stays short and a lost executor costs one
round only."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch, written
from .skew import join_unique


#: Rounds after which what has been reached is written as one table.
ROUNDS = 8


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return written(df, "graph")


def _tidy(f):
    """The tables of a loop go once its result is written."""

    @wraps(f)
    def run(edges: DataFrame, *args, **kwargs):
        with scratch(edges.sparkSession):
            out = f(edges, *args, **kwargs)
            return written(out, "graph", keep=True) if isinstance(out, DataFrame) else out

    return run




@_tidy
def reachable(edges: DataFrame, start: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """node, depth (fewest steps) of every node within ``most`` steps of the
    start nodes, or of all that can be reached (G1-G3). ``start`` has one column."""
    pairs = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_s is not null and _t is not null").distinct()
    if most is None:
        pairs = kept(pairs)
    seen = kept(start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = front.join(pairs, F.col("node") == F.col("_s")).select(F.col("_t").alias("node")).distinct()
        front = kept(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % ROUNDS == 0:
            seen = kept(seen)
    return seen


@_tidy
def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node), by least-label passing with jumps."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = kept(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    ends = kept(both.groupBy("y").agg(F.count("*").alias("n")))
    labels = kept(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("component")))
    while True:
        near = join_unique(both, labels.withColumnRenamed("node", "y"), ["y"], counts=ends).groupBy("x").agg(F.min("component").alias("near"))
        step = kept(labels.join(near, F.col("node") == F.col("x")).select("node", "component", F.least("component", "near").alias("next")))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("top"))
        step = kept(join_unique(step, jump, ["next"], "left").select("node", F.least("next", F.coalesce("top", "next")).alias("label"), "component"))
        labels = step.select("node", F.col("label").alias("component"))
        if step.where("label != component").isEmpty():
            return labels


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, fan_out, fan_in over distinct edges."""
    one = edges.select(source, target).distinct()
    out = one.groupBy(F.col(source).alias("node")).agg(F.count("*").alias("fan_out"))
    into = one.groupBy(F.col(target).alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(into, "node", "full").na.fill(0, ["fan_out", "fan_in"])


@_tidy
def cycles(edges: DataFrame, source: str, target: str, longest: int = 6) -> DataFrame:
    """Simple cycles of at most ``longest`` nodes (G8, G9), each once, from its
    least node: path (array of nodes)."""
    pairs = kept(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_s is not null and _t is not null").distinct())
    loops = pairs.where("_s = _t").select(F.array("_s").alias("path"))
    found, paths = [loops], kept(pairs.where("_t > _s").select(F.array("_s", "_t").alias("path")))
    back = pairs.select(F.col("_s").alias("_end"), F.col("_t").alias("_head"))
    for size in range(2, longest + 1):
        found.append(paths.join(back, (F.element_at("path", -1) == F.col("_end")) & (F.element_at("path", 1) == F.col("_head"))).select("path"))
        if size == longest:
            break
        more = paths.join(pairs, F.element_at("path", -1) == F.col("_s")).where((F.col("_t") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("_t")))
        paths = kept(more.select(F.concat("path", F.array("_t")).alias("path")))
        if paths.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@_tidy
def longest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> int:
    """Nodes on the longest chain of calls, as the depth of a search that turns
    back at a node it stands on already, which counts once more (G10).

    Without cycles each round moves on the nodes whose longest chain has grown:
    as many rounds as the depth. Nodes on or before cycles have exponentially many
    simple paths; ``most`` bounds their length where the graph has cycles, by
    default nothing does."""
    pairs = kept(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_s is not null and _t is not null").distinct())
    if pairs.isEmpty():
        return 0
    left, level = pairs, 1
    while True:  # take off what nothing is called from, level by level
        ends = left.select(F.col("_t").alias("_n")).distinct().join(left.select(F.col("_s").alias("_n")).distinct(), "_n", "left_anti")
        rest = kept(left.join(ends.withColumnRenamed("_n", "_t"), "_t", "left_anti"))
        if rest.count() == left.count():
            break
        left, level = rest, level + 1
        if left.isEmpty():
            return level
    paths, depth = kept(pairs.where("_s != _t").select(F.array("_s", "_t").alias("path"))), 2
    again = not pairs.where("_s = _t").isEmpty()
    if paths.isEmpty():
        return 1 + again
    while not paths.isEmpty():
        step = paths.join(pairs, F.element_at("path", -1) == F.col("_s"))
        again = not step.where(F.array_contains("path", F.col("_t"))).isEmpty()
        more = kept(step.where(~F.array_contains("path", F.col("_t"))).select(F.concat("path", F.array("_t")).alias("path")))
        if more.isEmpty() or (most is not None and depth >= most):
            break
        paths, depth = more, depth + 1
    return depth + again


def condensed(edges: DataFrame, membership: DataFrame, node: str, group: str, source: str, target: str) -> DataFrame:
    """Distinct edges between groups."""
    m = membership.select(F.col(node).alias("_n"), F.col(group).alias("_g"))
    a, b = m.toDF("_s", "from_group"), m.toDF("_t", "to_group")
    out = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).join(a, "_s").join(b, "_t")
    return out.where("from_group != to_group").select("from_group", "to_group").distinct()


def calls_of(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Callees and callers of each node as sorted arrays."""
    out = edges.groupBy(F.col(source).alias("node")).agg(F.sort_array(F.collect_set(target)).alias("calls"))
    into = edges.groupBy(F.col(target).alias("node")).agg(F.sort_array(F.collect_set(source)).alias("called_by"))
    none = F.array().cast("array<string>")
    joined = out.join(into, "node", "full")
    return joined.select("node", F.coalesce(F.col("calls").cast("array<string>"), none).alias("calls"), F.coalesce(F.col("called_by").cast("array<string>"), none).alias("called_by"))
