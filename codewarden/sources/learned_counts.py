"""Learned counts kept up while files change, so that a corpus is not read again to learn from it.

Learning only adds up what each file has, so a change adds the new file's counts and takes the old one's away.
Every update is a version of such differences (section, field, key, n) in a folder of its own; a
version written twice replaces itself. The counts are the sums over all versions, and :func:`compact` puts those into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.operators import learn
from codewarden.sources import storage
from codewarden.sources.file_table import FileTable

_COUNTS = "section string, field string, key string, n long"


@dataclass(frozen=True)
class LearnedCounts:
    root: str

    def add(self, after: DataFrame, version: int, before: DataFrame | None = None) -> None:
        """Count the files ``after`` (path, content) in, and what they were ``before`` out."""
        rows = learn.pattern_counts(after)
        if before is not None:
            rows = rows.unionByName(learn.pattern_counts(before).withColumn("n", -F.col("n")))
        changed = rows.groupBy("section", "field", "key").agg(F.sum("n").alias("n")).where("n <> 0")
        changed.write.mode("overwrite").parquet(f"{self.root}/version={version}")

    def follow(self, table: FileTable, changed: DataFrame, version: int) -> None:
        """Put ``changed`` files into ``table`` as ``version`` and count the difference.

        Files without content are removed. Reads the changed files' buckets only. May be repeated: what the
        files were is looked up among the versions before this one.
        """
        before = table.select(changed, before=version)
        self.add(changed.where("content IS NOT NULL"), version, before)
        table.put(changed, version)

    def _versions(self, spark: SparkSession) -> list[str]:
        names = storage.children(spark, self.root)
        upto = max((int(x.split("=")[1]) for x in names if x.startswith("upto=")), default=-1)
        return [x for x in names if x == f"upto={upto}" or x.startswith("version=") and int(x.split("=")[1]) > upto]

    def counts(self, spark: SparkSession) -> DataFrame:
        """The corpus' counts, as :func:`codewarden.operators.learn.pattern_counts` gives them."""
        wanted = self._versions(spark)
        if not wanted:
            return spark.createDataFrame([], _COUNTS)
        rows = spark.read.schema(_COUNTS).parquet(*[f"{self.root}/{x}" for x in wanted])
        return rows.groupBy("section", "field", "key").agg(F.sum("n").alias("n")).where("n > 0")

    def profile(self, spark: SparkSession) -> DataFrame:
        return learn.profile(self.counts(spark))

    def compact(self, spark: SparkSession) -> None:
        """Sum all versions up; those covered are ignored from then on, and deleted."""
        names = storage.children(spark, self.root)
        versions = [int(x.split("=")[1]) for x in names if x.startswith("version=")]
        if not versions:
            return
        self.counts(spark).write.mode("overwrite").parquet(f"{self.root}/upto={max(versions)}")
        for x in names:
            storage.delete(spark, f"{self.root}/{x}")
