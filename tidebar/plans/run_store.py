"""A table of runs on shared storage: committed batches, merged when read."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

COMMIT = "batch string, number long, replaces array<string>"
OWN = ("__number", "__batch", "__gone")


class RunStore:
    """Rows by key under ``root``; every write is a batch of files and then a commit, a folder of one row.

    A batch counts once its commit is there, so a write that fails or is lost half-way leaves the table as it was, and a reader
    never sees a part of it. Writers need no lock: batches that commit at the same time are all kept, and for a key the batch with the
    larger number counts, then the larger batch id. A number is one more than what the writer had seen, so later
    writes win. A deleted key is a row of its own that says so. :meth:`compact` writes the merged rows as one batch, with their numbers,
    in place of those that it has read; what is committed meanwhile stays beside it. Old files are left to :meth:`leftovers`.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "experiment_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def commits(self) -> DataFrame:
        """Commits that no later one replaces."""
        try:
            every = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits/*")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)
        gone = every.select(F.explode("replaces").alias("batch")).distinct()
        return every.join(gone, "batch", "left_anti")

    def _write(self, rows: DataFrame) -> str:
        batch = uuid.uuid4().hex
        rows.write.mode("error").parquet(f"{self.root}/batches/{batch}")
        return batch

    def _commit(self, batch: str, number: int, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(batch, number, replaces)], COMMIT).coalesce(1)
        row.write.mode("error").parquet(f"{self.root}/commits/{batch}")

    def _add(self, rows: DataFrame, gone: bool) -> str:
        number = (self.commits().agg(F.max("number")).first()[0] or 0) + 1
        marks = {"__number": F.lit(number).cast("long"), "__gone": F.lit(gone)}
        batch = self._write(rows.drop(*OWN).withColumns(marks))
        self._commit(batch, number, [])
        return batch

    def upsert(self, updates: DataFrame) -> str:
        """Rows replace or extend the table; of several rows of one key within ``updates`` any one counts."""
        return self._add(updates, False)

    def delete(self, ids: DataFrame) -> str:
        """Runs whose key is in ``ids`` go; unknown keys do no harm."""
        return self._add(ids.select(self.key), True)

    def _merged(self, commits: list) -> DataFrame | None:
        """The row that counts for each key, gone ones too, with its number."""
        if not commits:
            return None
        parts = []
        for r in commits:
            rows = self.spark.read.parquet(f"{self.root}/batches/{r['batch']}")
            parts.append(rows if "__batch" in rows.columns else rows.withColumn("__batch", F.lit(r["batch"])))
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        others = [x for x in both.columns if x != self.key]
        last = F.max_by(F.struct(*others), F.struct("__number", "__batch"))
        return both.groupBy(self.key).agg(last.alias("r")).select(self.key, "r.*")

    def read(self) -> DataFrame | None:
        """The table; None while nothing is committed. The list of batches is short: compact() makes it one."""
        merged = self._merged(self.commits().collect())
        return None if merged is None else merged.filter(~c("__gone")).drop(*OWN)

    def archive(self, ids: DataFrame, store: RunStore) -> None:
        """Runs go to another table, and only then from this one; done again after a failure, it ends the same."""
        table = self.read()
        if table is not None:
            store.upsert(table.join(ids.select(self.key).distinct(), self.key, "left_semi"))
            self.delete(ids)

    def compact(self) -> str | None:
        """All batches as one. Rows keep their numbers, gone ones too, so it may run beside other writers."""
        commits = self.commits().collect()
        if len(commits) < 2:
            return None
        batch = self._write(self._merged(commits))
        self._commit(batch, max(r["number"] for r in commits), [r["batch"] for r in commits])
        return batch

    def leftovers(self) -> list[str]:
        """Folders of batches that compact() has replaced, for whoever cleans up once no reader is on them."""
        try:
            every = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits/*")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        gone = every.select(F.explode("replaces").alias("batch")).distinct().orderBy("batch").collect()
        return [f"{self.root}/batches/{r['batch']}" for r in gone]
