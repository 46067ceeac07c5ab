"""File trees, sidecars and JSON snapshots."""

from __future__ import annotations

import os
import re
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.text import basename, extension
from opsloom.session import cut

ERROR_STATS = ("total_operations LONG, total_errors LONG, error_types MAP<STRING,LONG>, "
               "processor_errors MAP<STRING,STRUCT<operations:LONG,errors:LONG,"
               "error_types:MAP<STRING,LONG>>>")
PERFORMANCE_STATS = (
    "average_processing_time DOUBLE, max_processing_time DOUBLE, min_processing_time DOUBLE, "
    "processors MAP<STRING,STRUCT<average_time:DOUBLE,max_time:DOUBLE,min_time:DOUBLE,"
    "file_types:MAP<STRING,STRUCT<average_time:DOUBLE>>>>, "
    "resource_utilization STRUCT<cpu_usage:DOUBLE,memory_usage:DOUBLE,disk_io:DOUBLE>")
SIDECAR = ".metadata"
# Tasks a core that list a tree, and that look at its files; files and folders a task lists before it hands on the rest.
SCAN_TASKS = 16
WALK = 100_000
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Folder names as ``partitionBy`` makes them: for no value, and characters that a name does not hold.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def scan_files(spark: SparkSession, path: str, glob: str | None = None,
               content: bool = False) -> DataFrame:
    """Path, size, time, name and extension; content is only read when asked for.

    Spark keeps all files of a tree on the driver, lists up to 10,000 folders by a task each and gives a
    task a few small files. In a folder that the machines mount, tasks list the tree themselves and
    nothing of it reaches the driver; in other stores and for content the number of tasks goes by the cores.
    """
    most = SCAN_TASKS * spark.sparkContext.defaultParallelism
    root = None if content else mounted(spark, path)
    if root and os.path.isdir(root):
        found = walked(spark, root, most)
    else:
        found = listed(spark, path, glob, most)
        found = found if content else found.drop("content").coalesce(most)
    name = basename("path")
    rows = found.select("path", name.alias("file_name"), extension(name).alias("extension"),
                        F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"),
                        *(["content"] if content else []))
    if glob and "content" not in found.columns:
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        rows = rows.filter(F.col("file_name").rlike(rf"(?s)\A(?:{pattern})\z"))
    return rows


def listed(spark: SparkSession, path: str, glob: str | None, most: int) -> DataFrame:
    """The files of a tree as Spark lists them, by ``most`` tasks at most."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, str(min(most, int(before))))
    try:
        return reader.load(path)
    finally:
        spark.conf.set(LISTERS, before)


def walked(spark: SparkSession, root: str, most: int) -> DataFrame:
    """The files that Spark would list under a mounted folder, without names that it hides and empty files."""
    folders, rounds = spark.range(1).select(F.lit(root).cast("binary").alias("path")), []
    while not rounds or not folders.isEmpty():
        seen = cut(folders.mapInArrow(walk(WALK), "path binary, size long, modified long"), "scan")
        rounds.append(seen.filter("size > 0"))
        folders = seen.filter("size IS NULL").select("path").repartition(most)
    return reduce(DataFrame.unionAll, rounds).select(
        F.concat(F.lit("file:"), F.col("path").cast("string")).alias("path"), F.col("size").alias("length"),
        F.timestamp_millis("modified").alias("modificationTime"))


def walk(limit: int):
    """For ``mapInArrow`` over folders: files with size and time, and without them the folders left after ``limit`` names."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.binary()), ("size", pa.int64()), ("modified", pa.int64())])
        known = 0
        for todo in (b.columns[0].to_pylist() for b in batches):
            rows = []
            while todo and known < limit:
                try:
                    for at in os.scandir(todo.pop()):
                        folder = at.is_dir()
                        if hidden(at.name, folder):
                            continue
                        known += 1
                        if folder:
                            todo.append(at.path)
                        elif os.path.exists(at.path):  # else a link to nothing
                            status = at.stat()
                            rows.append((at.path, status.st_size, status.st_mtime_ns // 1_000_000))
                except FileNotFoundError:  # gone meanwhile
                    pass
            rows += [(folder, None, None) for folder in todo]
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                    zip(*rows[k:k + 10_000]), schema)], schema=schema)
    return run


def hidden(name: bytes, folder: bool) -> bool:
    """Whether Spark passes over a file or folder of this name."""
    if folder and name.startswith((b"_common_metadata", b"_metadata")):
        return False
    return name.startswith(b".") or name.endswith(b"._COPYING_") or name.startswith(b"_") and b"=" not in name


def write_texts(df: DataFrame, path: str, by: list[str]) -> None:
    """The column ``value`` as text files in the folders and with the lines of ``partitionBy(*by).text(path)``.

    Hadoop's local file system starts a process for each file it makes, and one for its checksum. In a
    folder that the machines mount, tasks therefore make the files themselves, a file a folder and task.
    """
    root = mounted(df.sparkSession, path)
    if root is None:
        # Tasks put their files in place themselves; else the driver moves them one by one at the end.
        (df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy(*by).text(path))
        return
    os.makedirs(root)
    named = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NO_VALUE)).alias(c) for c in by]
    (df.select(*named, F.col("value").cast("binary")).sortWithinPartitions(*by)
     .mapInArrow(text_files(root, by), "files long").agg(F.sum("files")).collect())


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as a folder of the local or a mounted file system, None in another store."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(sc._jsc.hadoopConfiguration())
    return store.makeQualified(place).toUri().getPath() if store.getUri().getScheme() == "file" else None


def text_files(root: str, by: list[str]):
    """For ``mapInArrow`` over ``*by, value``, sorted by ``by``: writes the files, returns their number."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get(), 0
        name = f"part-{task.partitionId():05d}.txt"
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for keys, group in groupby(rows, lambda row: row[:-1]):
            folder = os.path.join(root, *(
                f"{c}=" + ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", k) for c, k in zip(by, keys)))
            os.makedirs(folder, exist_ok=True)
            # A task that is run again, or twice, puts the same whole file in place.
            begun = f"{folder}/.{name}.{task.taskAttemptId()}"
            with open(begun, "wb") as out:
                for *_, value in group:
                    out.write((value or b"") + b"\n")
            os.replace(begun, f"{folder}/{name}")
            made += 1
        yield pa.RecordBatch.from_pydict({"files": [made]})
    return run


def read_stats_json(spark: SparkSession, path: str, schema: str = ERROR_STATS,
                    multiline: bool = True) -> DataFrame:
    """Nested snapshots with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)


def read_sidecars(spark: SparkSession, path: str, schema: str, glob: str = f"*{SIDECAR}",
                  key: str = r"^(.*)\.metadata$", multiline: bool = True) -> DataFrame:
    """Sidecar JSON keyed by the path it describes (group 1 of ``key`` on its own path)."""
    raw = (spark.read.schema(schema).option("multiLine", str(multiline).lower())
           .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path))
    described = F.regexp_extract(F.col("_metadata.file_path"), key, 1)
    return raw.select(described.alias("path"), *raw.columns)
