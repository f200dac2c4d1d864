"""A table in folders by one column, of which an upsert replaces only those that its rows change.

Every partition is an entry of a version's manifest (``generations``), so partitions change together by one rename: a writer that dies
leaves the version before, and a partition without changes keeps its folder and files as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions.frames import stored
from scoutline.operators.generations import Generations


class Partitions(Generations):
    """A table that holds the newest row of each key, by partition.

    part: the column of the partitions, a function of the key (a row of the same key in another partition is another row).
    order: what makes a row newer; rows that are equal in it are taken by their JSON text, so any order and any overlap of
    batches gives the same table.  Null keys are equal to one another; rows whose partition is null have one of their own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, part: str, keys: list[str], order: list[str]) -> None:
        super().__init__(spark, path)
        self.schema, self.part, self.keys, self.order = spark.createDataFrame([], schema).schema, part, keys, order

    def _folders(self, path: str) -> dict[str, str]:
        """Partition folders below a written folder, by name."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._place(path)) if s.isDirectory()]
        return {n: f"{path}/{n}" for n in names if n.startswith("_part=")}

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def table(self, version: int | None = None) -> DataFrame:
        return self._read(sorted(self.manifest(version).values()))

    def _cut(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", F.col(self.part).cast("string"))

    def upsert(self, new: DataFrame) -> list[str]:
        """Take rows in; the names of the partitions that changed (none if all rows are known or older)."""
        after = self.version()
        held = self.manifest(after)
        taken = f"{self.path}/data/taken-{uuid.uuid4().hex}"
        self._cut(new.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))).write.partitionBy("_part").parquet(taken)
        came = self._folders(taken)
        if not came:
            return []
        both = self._read(list(came.values())).withColumn("_new", F.lit(1))
        before = [held[n] for n in came if n in held]
        both = both.unionByName(self._read(before).withColumn("_new", F.lit(0)))
        # A row that is there already wins against its copy, so only real changes are marked as new.
        rank = F.struct(*self.order, F.to_json(F.struct(*self.schema.names)), -F.col("_new"))
        best = both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*self.keys, self.part]))).agg(F.max_by(F.struct(*self.schema.names, "_new"), rank).alias("best"))
        best = stored(self._cut(best.select("best.*")))
        changed = best.where("_new = 1").select(F.coalesce("_part", F.lit("")).alias("_p"), F.col("_part").isNull().alias("_none")).distinct()
        rows = best.withColumns({"_p": F.coalesce("_part", F.lit("")), "_none": F.col("_part").isNull()}).join(changed, ["_p", "_none"], "left_semi").drop("_p", "_none", "_new")
        made = f"{self.path}/data/made-{uuid.uuid4().hex}"
        # Small partitions get one file each, large ones are split.
        rows.hint("rebalance", "_part").write.partitionBy("_part").parquet(made)
        fresh = self._folders(made)
        if fresh:
            self.publish(held | fresh, after)
        self.fs.delete(self._place(taken), True)
        return sorted(fresh)

    def forget(self, keep: int = 2) -> int:
        """Delete all versions but the newest ones and partition folders that none of them names; the number of those."""
        newest = self.version()
        kept = {f.rsplit("/data/", 1)[1] for v in range(max(1, newest - keep + 1), newest + 1) for f in self.manifest(v).values()}
        for v in range(1, newest - keep + 1):
            self.fs.delete(self._place(f"{self.path}/versions/{v:010d}.json"), False)
        gone = 0
        for s in self.fs.listStatus(self._place(f"{self.path}/data")):
            batch = s.getPath().getName()
            parts = self._folders(f"{self.path}/data/{batch}")
            old = [n for n in parts if f"{batch}/{n}" not in kept]
            gone += len(old)
            for path in [parts[n] for n in old] if len(old) < len(parts) else [f"{self.path}/data/{batch}"]:
                self.fs.delete(self._place(path), True)
        return gone


def swept(stream: DataFrame, table: Partitions, folder: str) -> DataFrame:
    """Take a stream into the table up to the stream's present end; the table.

    A batch that is run again after a loss changes nothing that it has changed before.  folder: the stream's own state.
    """
    query = stream.writeStream.foreachBatch(lambda batch, _: table.upsert(batch) and None).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.table()
