"""Source files kept by path, so that a few changed ones are read without scanning the corpus.

Files lie in buckets by a hash of their path, a folder each, and every write adds a version to
the buckets it touches: ``bucket=17/version=3``. Reading named files opens the folders of their buckets and
nothing else; not even the other folders are listed. Of a path the newest version counts; a version without
content says that the file is gone. Writing a version again replaces it, so a repeated write changes nothing.
Choose the number of buckets so that one holds some 64 MB: 1,000 changed files of a corpus of 100 TB
are then read from at most 1,000 of 1.6 million folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewarden.sources import storage

#: Beside the buckets, hidden from readers: how many there are, and the columns.
_ABOUT = "_about"
_ABOUT_SCHEMA = "buckets long, columns string"


@dataclass(frozen=True)
class FileTable:
    root: str
    buckets: int
    #: Columns of the files, as DDL: path, content and what else was given.
    columns: str

    @staticmethod
    def create(files: DataFrame, root: str, buckets: int) -> FileTable:
        """A new table of ``files`` (path, content, ...) at ``root``, as version 0."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
        table = FileTable(root.rstrip("/"), buckets, columns)
        table.put(files, 0)
        about = files.sparkSession.createDataFrame([(buckets, columns)], _ABOUT_SCHEMA)
        about.coalesce(1).write.mode("overwrite").json(f"{table.root}/{_ABOUT}")
        return table

    @staticmethod
    def open(spark: SparkSession, root: str) -> FileTable:
        root = root.rstrip("/")
        about = spark.read.schema(_ABOUT_SCHEMA).json(f"{root}/{_ABOUT}").first()
        return FileTable(root, about["buckets"], about["columns"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).alias("bucket")

    def put(self, files: DataFrame, version: int) -> None:
        """Add ``files`` as a version; those without content are gone from then on."""
        rows = files.select(*_names(self.columns), self._bucket(), F.lit(version).cast("long").alias("version"))
        # a task holds whole buckets, sorted, so each gets one file a task and paths find their row groups
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "path")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.root)

    def remove(self, paths: DataFrame, version: int) -> None:
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in _struct(self.columns) if f.name != "path"]
        self.put(paths.select("path", *missing), version)

    def _read(self, spark: SparkSession, folders: list[str] | None) -> DataFrame:
        schema = _struct(self.columns).add("bucket", T.LongType()).add("version", T.LongType())
        reader = spark.read.schema(schema).option("basePath", self.root)
        if folders is None:
            return reader.parquet(self.root)
        return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)

    def select(self, paths: DataFrame, before: int | None = None) -> DataFrame:
        """The files named in ``paths`` (column path) that exist; reads their buckets' folders only.

        With ``before`` as they were before that version.
        """
        spark = paths.sparkSession
        wanted = paths.select("path").distinct().select("path", self._bucket())
        # at most as many numbers as there are buckets
        numbers = sorted(r["bucket"] for r in wanted.select("bucket").distinct().collect())
        folders = [f for f in (f"{self.root}/bucket={n}" for n in numbers) if storage.exists(spark, f)]
        rows = self._read(spark, folders)
        if before is not None:
            rows = rows.where(F.col("version") < before)
        found = rows.join(wanted, ["bucket", "path"], "left_semi")
        newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version")))
        return found.withColumn("__newest", newest).where("__newest = 1 AND content IS NOT NULL").select(*_names(self.columns))

    def all(self, spark: SparkSession) -> DataFrame:
        """Every file's newest version. Contents are not shuffled: only the outdated versions are looked up."""
        rows = self._read(spark, None)
        versions = rows.select("path", "version").groupBy("path").agg(F.max("version").alias("last"), F.collect_list("version").alias("v"))
        old = versions.where("size(v) > 1").select("path", F.explode("v").alias("version"), "last").where("version < last")
        return rows.join(old, ["path", "version"], "left_anti").where("content IS NOT NULL").select(*_names(self.columns))

    def compact(self, spark: SparkSession, version: int) -> None:
        """Rewrite buckets of several versions as one, ``version``, which has to be the newest.

        Readers see the same files at every moment: the new version holds what the old ones amount to, and
        those go oldest first, so that no removed file comes back.
        """
        held = {b: [v for v in storage.children(spark, f"{self.root}/{b}") if v.startswith("version=")]
                for b in storage.children(spark, self.root) if b.startswith("bucket=")}
        many = {b: vs for b, vs in held.items() if len(vs) > 1}
        if not many:
            return
        rows = self._read(spark, [f"{self.root}/{b}" for b in many])
        newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version")))
        self.put(rows.withColumn("__newest", newest).where("__newest = 1 AND content IS NOT NULL"), version)
        for b, vs in many.items():
            for v in sorted(vs, key=lambda x: int(x.split("=")[1])):
                if v != f"version={version}":
                    storage.delete(spark, f"{self.root}/{b}/{v}")


def _struct(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


def _names(columns: str) -> list[str]:
    return _struct(columns).names
