"""Source-file scans: directories or tables of (path, content), with the ignore policies."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.functions.regex import matches
from codewarden.functions.sql import q
from codewarden.sources.storage import checkpointed

# Scanned extensions and ignored folder names.
EXTENSIONS = [".js", ".ts", ".jsx", ".tsx"]
IGNORED_PARTS = ["node_modules", ".git", "dist", "build"]
IGNORED_NAMES = ["node_modules", ".git", "dist", "build", ".next", ".nuxt", "coverage"]

#: Tasks that list folders, for each core.
TASKS_A_CORE = 4

POLICIES = ("none", "learn", "compliance", "drift", "watch")


def is_ignored(path: str, policy: str, root: str = "") -> str:
    """SQL text: whether a file (path relative to the scanned root) lies in an ignored folder.

    learn       the folder's full path contains an ignored part
    compliance  a folder name contains an ignored part
    drift       a folder name equals an ignored name (also the AI scans)
    watch       like drift, and any folder starting with a dot
    """
    either = lambda names: "|".join(re.escape(n) for n in names)
    if policy == "none":
        return "false"
    if policy in ("learn", "compliance"):
        folder = text.dirname(path)
        in_root = any(p in root.rstrip("/") + "/" for p in IGNORED_PARTS)
        if policy == "learn" and in_root:
            return f"{folder} <> ''"
        return matches(folder, either(IGNORED_PARTS))
    if policy == "drift":
        return matches(path, f"(?:^|/)(?:{either(IGNORED_NAMES)})/")
    if policy == "watch":
        return matches(path, rf"(?:^|/)(?:{either(IGNORED_NAMES)}|\.[^/]*)/")
    raise ValueError(f"unknown ignore policy {policy!r}, expected one of {POLICIES}")


def select_code_files(
    files: DataFrame,
    policy: str = "drift",
    extensions=EXTENSIONS,
    root: str = "",
    max_files: int | None = None,
) -> DataFrame:
    """Files with a code extension outside ignored folders. Both tests read ``path`` only.

    ``max_files`` keeps the first so many paths in order, as the learning command does. Which these are is
    found among the paths; contents are read for the chosen files only, and not sorted.
    """
    wanted = ", ".join(q(e) for e in extensions)
    kept = files.where(
        f"{text.extname('path')} IN ({wanted}) AND NOT ({is_ignored('path', policy, root)})"
    )
    if max_files is None:
        return kept
    # at most max_files rows, a number that the caller states
    first = kept.select("path").orderBy("path").limit(max_files)
    return first if kept.columns == ["path"] else kept.join(F.broadcast(first.distinct()), "path", "left_semi")


def watched_folders(files: DataFrame) -> DataFrame:
    """The folders that hold ``files``, each once; '' is the root."""
    return files.selectExpr(f"{text.dirname('path')} AS folder").distinct()


def _file_system(directory: str) -> tuple[FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", directory) is None:
        return LocalFileSystem(), os.path.abspath(directory)
    # Hadoop's names of the store that others call s3
    return FileSystem.from_uri(re.sub("^s3[an]:", "s3:", directory))


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: 134217728, 134217728b, 128m, 128MB."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def _listed(spark: SparkSession, system: FileSystem, root: str, policy: str, directory: str) -> DataFrame:
    """All files below ``root``, hidden ones too: path (relative), size, mtime.

    The tree is walked once, level by level: a level's folders are dealt out to tasks, and what they hold is kept by
    a checkpoint. Folders that the policy ignores are not opened. One folder is listed by one task.
    """

    def list_folders(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = system.get_file_info(FileSelector(f"{root}/{folder}" if folder else root))
                found = [x for x in found if x.type in (FileType.File, FileType.Directory)]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([x.path[len(root):].lstrip("/") for x in found], pa.string()),
                    "folder": pa.array([x.type == FileType.Directory for x in found], pa.bool_()),
                    "size": pa.array([x.size for x in found], pa.int64()),
                    "micros": pa.array([x.mtime_ns // 1000 if x.is_file else None for x in found], pa.int64()),
                })

    entry = "path string, folder boolean, size long, micros long"
    opened = f"folder AND NOT ({is_ignored("concat(path, '/')", policy, directory)})"
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    levels, folders, n = [], spark.createDataFrame([("",)], "path string"), 1
    while n:
        level = folders.repartition(min(n, tasks)).mapInArrow(list_folders, entry)
        levels.append(level := checkpointed(level))
        folders = level.where(opened).select("path")
        n = folders.count()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("NOT folder").selectExpr("path", "size", "timestamp_micros(micros) AS mtime")


def scan_code_files(
    spark: SparkSession,
    directory: str,
    policy: str = "drift",
    extensions=EXTENSIONS,
    max_files: int | None = None,
) -> DataFrame:
    """Read a directory tree, one row per file: path (relative to the directory), content, mtime.

    Spark's own file sources hide names that begin with ``_`` or ``.``; here only the policy decides. Files
    are listed and chosen by path, and their paths dealt out, by as many bytes as Spark gives to a task that reads
    files, before tasks read the contents.
    """
    system, root = _file_system(directory)
    chosen = select_code_files(
        _listed(spark, system, root, policy, directory), policy, extensions, root=directory, max_files=max_files)

    def read(batches):
        for batch in batches:
            for path, mtime in zip(batch.column("path"), batch.column("mtime"), strict=True):
                with system.open_input_stream(f"{root}/{path.as_py()}", compression=None) as file:
                    content = file.read()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()]), pa.array([content], pa.binary()), pa.array([mtime.as_py()], mtime.type)],
                    ["path", "content", "mtime"])

    size = chosen.agg(F.sum("size")).first()[0] or 0
    part = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // part))
    files = chosen.select("path", "mtime").repartition(tasks).mapInArrow(read, "path string, content binary, mtime timestamp")
    return files.selectExpr("path", "make_valid_utf8(cast(content AS string)) AS content", "mtime")


def scan_js_files(files: DataFrame) -> DataFrame:
    """The review scan: names ending in .js, nothing ignored."""
    return files.where(F.endswith(F.col("path"), F.lit(".js")))
