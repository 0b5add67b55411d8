"""Every star query against DuckDB on the smallest tables, and on empty ones."""

import math

import duckdb
import pandas as pd
import pytest

from quarrylens.plans import code_fixture, star_basic, star_code, star_shapes  # noqa: F401
from quarrylens.plans.registry import ORACLE_SQL, QUERIES
from quarrylens.sources.tables import NAMES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(frame):
    def plain(x):
        if isinstance(x, bool):
            return str(x)
        if x is None or pd.api.types.is_scalar(x) and pd.isna(x):
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not math.isnan(x) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_every_query_is_named_in_the_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_empty_tables(spark, tmp_path):
    for t in NAMES:
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("exact_duplicates", "co_change", "overlap_findings", "hotspots", "components", "cycles", "embedding_neighbors", "resolution_cascade", "reachability", "clone_ranking", "decisions_ranked", "file_stats", "cluster_advice"):
        assert QUERIES[name](spark, str(tmp_path)).count() <= 1, name
