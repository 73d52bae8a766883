"""Trees of files on a shared file system: written from rows, listed level by level, and read whole.

Folders are given as URIs. The tasks list and write through Arrow's file systems, so the driver holds neither names nor
contents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetledger.functions.paths import ALWAYS_IGNORED_DIRS

_LISTED = "path string, size_bytes long, is_dir boolean"
#: Tasks that list one level, at most.
MOST_TASKS = 1024
#: Files and bytes that one task reads, about; bytes of texts that it holds before it hands them on.
READ_FILES, READ_BYTES, HELD_BYTES = 2_000, 64 << 20, 4 << 20


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``path, text`` rows as files under a folder and return their number. A null text is an empty file; of rows
    with one path the last written stays. A task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(root)
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                target = f"{base}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return files.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _children(folders: DataFrame, root: str, ignored: Sequence[str]) -> DataFrame:
    """The files and folders directly in each of ``folders`` (``path``, relative), ignored names left out."""
    left_out = frozenset(ignored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _file_system(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{path}".rstrip("/"), allow_not_found=True))
                found = [f for f in found if f.base_name not in left_out or f.type != fs.FileType.Directory]
                prefix = f"{path}/" if path else ""
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([prefix + f.base_name for f in found], pa.string()),
                        pa.array([f.size for f in found], pa.int64()),
                        pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                    ],
                    names=["path", "size_bytes", "is_dir"],
                )

    return folders.mapInArrow(run, _LISTED)


def list_tree(
    spark: SparkSession, root: str, work: str, ignored: Sequence[str] = ALWAYS_IGNORED_DIRS, max_depth: int | None = None
) -> DataFrame:
    """``path, size_bytes`` of the files under a folder, paths relative to it.

    Each level of folders is one job over all its folders, and an ignored folder is never entered. Levels are written
    below ``work``, so that no level is listed twice. A file's depth counts its folders and itself; files deeper than
    ``max_depth`` are left out and folders beyond it not entered. Contents are never read.
    """
    folders = spark.createDataFrame([("",)], "path string")
    level = 0
    while max_depth is None or level < max_depth:
        level += 1
        _children(folders, root, ignored).write.parquet(f"{work}/level={level}")
        found = spark.read.schema(_LISTED).parquet(f"{work}/level={level}")
        folders = found.where("is_dir").select("path")
        number = folders.count()
        if not number:
            break
        # few bytes and much work: a stated number of partitions, which adaptive execution leaves as they are
        folders = folders.repartition(min(number, MOST_TASKS), "path")
    listed = spark.read.schema(_LISTED).parquet(*(f"{work}/level={n}" for n in range(1, level + 1)))
    return listed.where("NOT is_dir").select("path", "size_bytes")


def relative(path: Column, root: str) -> Column:
    """A listed file's path below a folder; Spark writes paths in more than one form of URI."""
    return F.regexp_extract(path, rf"\Q{urlparse(root).path.rstrip('/')}\E/(.*)$", 1)


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_bytes`` of the files under a folder, listed by Spark, which leaves out empty files and names that begin
    with a dot or an underscore; contents are never read. For trees of some thousand files: the driver holds their names
    and makes a task of every 32 small ones. :func:`list_tree` has no such bounds."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size_bytes"))


def read_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, text`` of the whole files under a folder whose names match, of those that :func:`read_inventory` lists, and
    for trees of that size; :func:`read_listed` reads what :func:`list_tree` lists."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    found = read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return found.select(relative(decoded, root).alias("path"), "text")


def read_listed(listed: DataFrame, root: str) -> DataFrame:
    """``path, text`` of the whole files that :func:`list_tree` lists under a folder, empty ones included. Tasks open the
    files, dealt by their number and bytes; a task holds a few megabytes of texts, or one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(root)

        def handed(paths: list[str], texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "content"])

        for batch in batches:
            paths, texts, held = [], [], 0
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{base}/{path}") as file:
                    texts.append(file.read())
                paths.append(path)
                held += len(texts[-1])
                if held > HELD_BYTES:
                    yield handed(paths, texts)
                    paths, texts, held = [], [], 0
            yield handed(paths, texts)

    whole = listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
    # few bytes and much work: a stated number of partitions, which adaptive execution leaves as they are
    dealt = listed.select("path").repartition(1 + whole.files // READ_FILES + whole.bytes // READ_BYTES, "path")
    return dealt.mapInArrow(run, "path string, content binary").select("path", F.col("content").cast("string").alias("text"))
