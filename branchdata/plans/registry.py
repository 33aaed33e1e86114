"""Registry of named queries: a Spark builder and, where SQL can say the
same thing, the DuckDB oracle text next to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources import history as H
from ..sources.tables import Source


@dataclass
class Entry:
    name: str
    build: Callable[["Ctx"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


class Ctx:
    """Per-call access to the tables and the derived history frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.src = Source(spark, sf_dir)
        self._memo: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        return self.src.table(name)

    def tables(self) -> dict[str, DataFrame]:
        """Every table of the folder."""
        return {n: self.src.table(n) for n in self.src.names()}

    def _get(self, key, fn):
        if key not in self._memo:
            self._memo[key] = fn()
        return self._memo[key]

    @property
    def branches(self) -> DataFrame:
        return self._get("branches", lambda: H.branches(self.src))

    @property
    def hot_branches(self):
        """Hot branch keys (or None), found once per query on the raw key column."""
        if "hot" not in self._memo:
            self._memo["hot"] = H.hot_branches(self.src)
        return self._memo["hot"]

    @property
    def changes(self) -> DataFrame:
        return self._get("changes", lambda: H.changes(self.src, hot=self.hot_branches))

    @property
    def recorded(self) -> DataFrame:
        """Changes with type, description and checksum."""
        from ..operators.history import classify
        return self._get("recorded", lambda: classify(self.changes))

    @property
    def snapshots(self) -> DataFrame:
        return self._get("snapshots", lambda: H.snapshots(self.src))

    @property
    def stashes(self) -> DataFrame:
        return self._get("stashes", lambda: H.stashes(self.changes))

    def scratch(self) -> str:
        import uuid
        from ..sources.fs import join
        return join(ensure_checkpoint_dir(self.spark), "branchdata", uuid.uuid4().hex[:10])


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries  # noqa: F401  (registers)

    def wrap(e: Entry):
        return lambda spark, sf_dir: e.build(Ctx(spark, sf_dir))
    return {n: wrap(e) for n, e in REGISTRY.items()}


def oracles() -> dict[str, str]:
    from . import queries  # noqa: F401
    return {n: e.sql for n, e in REGISTRY.items() if e.sql}
