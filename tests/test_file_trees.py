"""Trees of many small files: what is written, and how many tasks a scan takes."""

import os

import pytest
from pyspark.sql import functions as F

from opsloom.session import fresh_dir
from opsloom.sources import files

ODD = [(1, "html", "a"), (1, "html", None), (2, "", "b\nc"), (2, None, "d"), (None, "txt", "é"), (3, "a/b=%c:d e", ""),
       (3, "{x}[y]^'\"#*?\\", "f"), (3, "\t\x7f~", "g"), (4, "", "h")]


def odd(spark):
    return spark.createDataFrame(ODD, "page_id long, suffix string, value string").repartition(1)


def texts(root):
    return {(os.path.relpath(at, root), os.path.splitext(name)[1]): sorted(open(os.path.join(at, name), "rb").read().split(b"\n"))
            for at, _, names in os.walk(root) for name in names if not name.startswith((".", "_"))}


def test_tree_is_that_of_partition_by(spark, tmp_path):
    odd(spark).write.partitionBy("page_id", "suffix").text(str(tmp_path / "spark"))
    files.write_texts(odd(spark), str(tmp_path / "ours"), ["page_id", "suffix"])
    ours = texts(tmp_path / "ours")
    assert ours == texts(tmp_path / "spark") and len(ours) == 7
    assert not [n for _, _, names in os.walk(tmp_path / "ours") for n in names if n.startswith(".")]


def test_tree_in_another_store(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./in", f"file://{tmp_path}")
    path = "viewfs://trees/in/tree"
    assert files.mounted(spark, path) is None
    files.write_texts(odd(spark), path, ["page_id", "suffix"])
    files.write_texts(odd(spark), str(tmp_path / "ours"), ["page_id", "suffix"])
    assert texts(tmp_path / "tree") == texts(tmp_path / "ours")
    sizes = [sorted(r["file_size"] for r in files.scan_files(spark, p, "*.txt").collect())
             for p in (path, str(tmp_path / "ours"))]
    assert sizes[0] == sizes[1] and len(sizes[0]) == 7


def test_task_that_runs_again_leaves_the_same_files(spark, tmp_path):
    rows = odd(spark).select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("page_id", "suffix")],
                             F.col("value").cast("binary")).sortWithinPartitions("page_id", "suffix")
    for _ in range(2):
        made = rows.mapInArrow(files.text_files(str(tmp_path), ["page_id", "suffix"]), "files long").collect()
        found = texts(tmp_path)
        assert sum(r["files"] for r in made) == len(found) == 8
    assert sum(len(names) for _, _, names in os.walk(tmp_path)) == 8


def test_empty_tree(spark):
    path = fresh_dir(spark, "tree")
    files.write_texts(odd(spark).filter("false"), path, ["page_id", "suffix"])
    assert files.scan_files(spark, path, "*.txt").count() == 0


@pytest.mark.parametrize("glob, limit, n", [(None, 3, 10), ("*.txt", 100_000, 5), ("[ab]?.{txt,md}", 100_000, 3)])
def test_scan_finds_what_spark_lists(spark, tmp_path, monkeypatch, glob, limit, n):
    for at in ("a/b/c/aa.txt", "a/b/bb.md", "a/_k=1/ab.txt", "a/_hidden/x.txt", "a/.dot/x.txt", "a/.x.txt", "a/_x.txt", "_metadata.txt", "_metadata_1/y",
               "ba.txt._COPYING_", "a/UP.TXT", "a/none", "a/two words%20#.txt", "d/e/f/g/h/ca.txt", "d/ac.tar.gz"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(at)
    (tmp_path / "a/empty.txt").touch()
    (tmp_path / "empty").mkdir()
    (tmp_path / "link.txt").symlink_to(tmp_path / "a/UP.TXT")
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nothing")
    monkeypatch.setattr(files, "WALK", limit)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    listed = reader.load(str(tmp_path)).select("path", "length", "modificationTime").collect()
    for path in (str(tmp_path), f"file://{tmp_path}/")[:1 if limit == 3 else 2]:
        found = files.scan_files(spark, path, glob)
        assert sorted(map(tuple, found.select("path", "file_size", "modified_at").collect())) == sorted(map(tuple, listed))
        with_content = files.scan_files(spark, path, glob, content=True)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, with_content.drop("content").collect()))
        assert found.schema == with_content.drop("content").schema
    assert len(listed) == n


def test_scan_keeps_the_tree_off_the_driver(spark, tmp_path, monkeypatch):
    """No file index of the tree: its files were all held by the driver."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("c")
    found = files.scan_files(spark, str(tmp_path), "*.txt")
    assert [r["path"] for r in found.collect()] == [f"file:{tmp_path}/a/b.txt"]
    assert not any(f.startswith(f"file://{tmp_path}/") for f in found.inputFiles())
    assert files.scan_files(spark, str(tmp_path / "a" / "b.txt")).count() == 1
    assert files.scan_files(spark, f"{tmp_path}/*/*.txt").count() == 1


def test_scan_takes_tasks_by_cores(spark, tmp_path):
    """By default a task each lists 300 folders, and reads a file each if partitions are small."""
    for n in range(300):
        (tmp_path / f"f{n}").mkdir()
        (tmp_path / f"f{n}" / f"{n}.txt").write_text("x" * (n + 1))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.cores.link./in", f"file://{tmp_path}")
    sc, most = spark.sparkContext, 16 * spark.sparkContext.defaultParallelism
    lists, size = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(lists), spark.conf.get(size)
    sc.setJobGroup("listed", "scan of a tree")
    try:
        spark.conf.set(size, "4m")
        found = files.scan_files(spark, "viewfs://cores/in", "*.txt")
        tracker = sc.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("listed") for s in tracker.getJobInfo(j).stageIds]
        assert 0 < sum(tracker.getStageInfo(s).numTasks for s in stages) <= most
        assert found.rdd.getNumPartitions() <= most
        assert sorted(r["file_size"] for r in found.select("file_size").collect()) == [*range(1, 301)]
        assert found.filter("file_size > 290").count() == 10
        assert files.scan_files(spark, "viewfs://cores/in", "*.txt", content=True).filter("length(content) = file_size").count() == 300
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        spark.conf.set(size, before[1])
    assert spark.conf.get(lists) == before[0]
