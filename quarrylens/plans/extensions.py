"""Extension points (V1-V6), caching and progress (D8, R6): operators, hooks and
decision rules by name."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..values import HOOK_POINTS as POINTS  # custom ones may be added by name

KINDS = ("analysis", "refactoring", "knowledge", "validation", "reporting", "orchestration")


class Registry:
    def __init__(self):
        self.plugins: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {k: {} for k in KINDS}
        self.hooks: dict[str, list[tuple[int, str, Callable[[DataFrame], DataFrame]]]] = defaultdict(list)
        self.rules: dict[str, Callable[..., DataFrame]] = {}
        self.failed: dict[str, str] = {}

    def plugin(self, kind: str, name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
        """A named transform of one of the kinds (V1)."""
        if kind not in self.plugins:
            raise ValueError(f"unknown kind: {kind}")
        self.plugins[kind][name] = transform

    def discover(self, group: str = "quarrylens.plugins") -> list[str]:
        """Plugins of installed packages (V2): an entry point names a function
        that takes the registry. One that fails is noted and left out."""
        found = []
        for point in entry_points(group=group):
            try:
                point.load()(self)
                found.append(point.name)
            except Exception as e:  # a plugin is foreign code
                self.failed[point.name] = str(e)
        return found

    def hook(self, point: str, name: str, transform: Callable[[DataFrame], DataFrame], priority: int = 100) -> None:
        """A transform at a point, in order of priority, then name (V3)."""
        self.hooks[point].append((priority, name, transform))
        self.hooks[point].sort(key=lambda h: h[:2])

    def apply(self, point: str, df: DataFrame, stop_on_error: bool = False) -> DataFrame:
        """``df`` through all hooks of a point; one that fails is skipped and noted."""
        for _, name, transform in self.hooks[point]:
            try:
                df = df.transform(transform)
            except Exception as e:
                if stop_on_error:
                    raise
                self.failed[name] = str(e)
        return df

    def rule(self, name: str, f: Callable[..., DataFrame]) -> None:
        """A custom decision rule (V4): its rows are added to the decisions."""
        self.rules[name] = f

    def decisions(self, base: DataFrame, **frames: DataFrame) -> DataFrame:
        for f in self.rules.values():
            base = base.unionByName(f(**frames), allowMissingColumns=True)
        return base


def map_reduce(df: DataFrame, step: Callable, schema: str, keys: list[str], *aggregates) -> DataFrame:
    """Batches through a function, then aggregated."""
    return df.mapInPandas(step, schema).groupBy(*keys).agg(*aggregates)


def steps_of(steps: Iterable[tuple[int, str, Callable[[], DataFrame]]], least: int = 0) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Steps of at least a priority, highest first; what fails is noted and the
    rest goes on (E16): results, errors."""
    results, errors = {}, {}
    for priority, name, f in sorted(steps, key=lambda s: (-s[0], s[1])):
        if priority >= least:
            try:
                results[name] = f()
            except Exception as e:
                errors[name] = f"{type(e).__name__}: {e}"
    return results, errors


def parallel_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """A function of Arrow batches (pandas frames) over all rows (V6)."""
    return df.mapInPandas(lambda batches: map(f, batches), schema)


def parallel_filter(df: DataFrame, f: Callable) -> DataFrame:
    """Rows for which a function of a pandas frame gives true (V6)."""
    return df.mapInPandas(lambda batches: (b[f(b)] for b in batches), df.schema)


def parallel_reduce(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Batches reduced to a frame each in the tasks, then all of those to one (V6):
    ``f`` must give a few rows whatever it is given."""
    part = df.mapInPandas(lambda batches: map(f, batches), schema)
    return part.repartition(1).mapInPandas(lambda batches: iter([f(pd.concat(list(batches)))]), schema)


@contextmanager
def cached(*frames: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Frames kept on the executors while the block runs."""
    held = [df.persist() for df in frames]
    try:
        yield tuple(held)
    finally:
        for df in held:
            df.unpersist()


class Progress(StreamingQueryListener):
    """Keeps what streaming queries report of each batch (R6): query, batch, rows, milliseconds."""

    def __init__(self):
        self.rows: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
