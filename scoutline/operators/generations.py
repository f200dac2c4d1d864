"""Several tables that change together: versioned folders, one manifest for each version, and the persistence of scores on top.

A version is written to folders of its own and counts only when its manifest is there, which appears by one rename.  A writer that dies
half-way leaves the version before readable; a reader keeps the version that it began with; of two writers from the same version one
is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


class Generations:
    """Versions of a set of tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._place(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """Number of the newest version; 0 before the first one."""
        if not self.fs.exists(self._place(f"{self.path}/versions")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._place(f"{self.path}/versions"))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table of a version."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._place(f"{self.path}/versions/{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)[name])

    def write(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Make a version of these tables and the others of the one before; its number.  after: the version that they were made from."""
        after = self.version() if after is None else after
        folders = self.manifest(after)
        for name, df in tables.items():
            folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            folders[name] = folder
        return self.publish(folders, after)

    def publish(self, folders: dict[str, str], after: int) -> int:
        """Make these folders the version that follows ``after``; its number."""
        made = self._place(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self.fs.create(made, False)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        goal = self._place(f"{self.path}/versions/{after + 1:010d}.json")
        if self.fs.exists(goal) or not self.fs.rename(made, goal):
            self.fs.delete(made, False)
            raise Conflict(f"version {after + 1} is there already")
        return after + 1

    def forget(self, keep: int = 2) -> int:
        """Delete versions but the newest ones, and folders that no version names (also those of writers that died); the number of folders."""
        newest = self.version()
        kept = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.manifest(v).values()}
        for v in range(1, newest - keep + 1):
            self.fs.delete(self._place(f"{self.path}/versions/{v:010d}.json"), False)
        gone = 0
        for s in self.fs.listStatus(self._place(f"{self.path}/data")):
            if not any(f.endswith("/" + s.getPath().getName()) for f in kept):
                gone += bool(self.fs.delete(s.getPath(), True))
        return gone


def persist(store: Generations, judged: DataFrame, components: DataFrame, rescored: DataFrame, generation: str, key: str = "entity") -> int:
    """Scores and their components of the entities that were judged again, in one version; the others keep theirs.

    judged: key, fund and the score columns, rows of qualified entities only; components: key, fund and their columns; rescored: the
    keys that were judged.  An entity that no longer qualifies loses its rows, and so do rows of other configuration generations.
    """
    after = store.version()
    new = {"score": judged.withColumn("generation", F.lit(generation)), "component": components.withColumn("generation", F.lit(generation))}
    if after:
        keys = rescored.select(key).distinct()
        for name, df in new.items():
            old = store.read(name, after).where(F.col("generation") == generation).join(keys, key, "left_anti")
            new[name] = old.unionByName(df.select(old.columns))
    return store.write(new, after)


def marked(inputs: DataFrame, configuration: str) -> DataFrame:
    """inputs with ``mark``: a hash of the whole row and of the configuration that judges it."""
    return inputs.withColumn("mark", F.sha2(F.concat(F.to_json(F.struct(*sorted(inputs.columns)), {"ignoreNullFields": "false"}), F.lit("|" + configuration)), 256))


def refreshed(inputs: DataFrame, before: DataFrame, derived: DataFrame, key: str, configuration: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(derived rows, marks, changed inputs): only rows whose hash is new are computed, the others' results are taken over.

    inputs: one row of a key; before: (key, mark) of the last time, also of rows that gave no result; derived: the results then, with
    the key.  Results of keys that are gone go.
    """
    now = marked(inputs, configuration)
    same = now.select(key, "mark").join(before.select(key, "mark"), [key, "mark"], "left_semi")
    changed = now.join(same, [key, "mark"], "left_anti").drop("mark")
    kept = derived.join(same.select(key), key, "left_semi")
    return kept.unionByName(compute(changed).select(derived.columns)), now.select(key, "mark"), changed
