"""Files of one project each, documents of rows that tie, and a log that is not written over."""

import csv
import glob
import hashlib
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from tandem.plans import sinks
from tandem.streaming import results


def compare_rows(spark, projects=2, n=30):
    rows = [(f"p{p}", i, f'say "{p}"\nline {i}', "1:1", 0.5, None, f"jp {i}, {p}", "cn ") for p in range(projects) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "project string, index int, chapter string, relation string, score double, jp_align_score double, jp string, cn string")


def content(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_one_document_of_rows_that_tie(spark, tmp_path):
    rows = compare_rows(spark).repartition(5)
    every = rows.unionByName(rows.where("index = 1 and project = 'p0'"))
    sinks.write_document(every, str(tmp_path / "d"), {"project": "p"})
    got = json.loads(content(tmp_path / "d"))
    assert len(got["rows"]) == 61 and [r["index"] for r in got["rows"]] == sorted(r["index"] for r in got["rows"]) and got["project"] == "p"
    sinks.write_document(rows.limit(0), str(tmp_path / "e"), {})
    assert json.loads(content(tmp_path / "e"))["rows"] == []


def test_each_project_gets_one_json_and_one_csv_file(spark, tmp_path):
    rows = compare_rows(spark).repartition(5)
    about = spark.createDataFrame([("p0", sinks.document_head({"project": "first", "counts": {"jp": 3}}))], "project string, head string")
    sinks.write_documents(rows, str(tmp_path / "json"), ("project",), about)
    sinks.write_csv(rows, str(tmp_path / "csv"), "bilingual", ("project",))
    for p in range(2):
        (file,) = glob.glob(f"{tmp_path}/json/project=p{p}/part-*")
        found = json.loads(open(file).read())
        assert [r["index"] for r in found["rows"]] == list(range(1, 31)) and found["project"] == ("first" if p == 0 else None)
        assert found["rows"][4] == {"index": 5, "chapter": f'say "{p}"\nline 5', "relation": "1:1", "score": 0.5, "jp_align_score": None, "jp": f"jp 5, {p}", "cn": "cn "}
        (file,) = glob.glob(f"{tmp_path}/csv/project=p{p}/part-*")
        table = list(csv.reader(io.StringIO(open(file, newline="").read())))
        assert table[0] == sinks.CSV_COLUMNS["bilingual"] and len(table) == 31 and table[5][:3] == ["5", f'say "{p}"\nline 5', "1:1"]
    assert sinks.read_files(spark, str(tmp_path / "json"), ("project",)).count() == 2


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    bad = compare_rows(spark).withColumn("cn", F.when((F.col("index") == 29) & (F.col("project") == "p1"), F.raise_error(F.lit("no"))).otherwise(F.col("cn")))
    with pytest.raises(Exception, match="no"):
        sinks.write_csv(bad, str(tmp_path / "csv"), "bilingual", ("project",))
    assert not glob.glob(f"{tmp_path}/csv/**/part-*", recursive=True)


def test_a_log_is_not_written_over_by_a_new_checkpoint(spark, tmp_path):
    spark.createDataFrame([("r", i) for i in range(150)], "run string, event_id long").write.parquet(str(tmp_path / "in"))
    events = lambda: spark.readStream.schema("run string, event_id long").parquet(str(tmp_path / "in"))
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    results.start_log(events(), log, checkpoint).awaitTermination()
    with pytest.raises(ValueError):
        results.start_log(events(), log, str(tmp_path / "other"))
    results.start_log(events(), log, checkpoint).awaitTermination()
    found = spark.read.schema("run string, event_id long, revision long").parquet(f"{log}/batch=*")
    assert [r.n for r in results.pages(found, "run").groupBy("page").agg(F.count("*").alias("n")).orderBy("page").collect()] == [64, 64, 22]


def test_large_projects_are_cut_into_parts_that_are_one_file_together(spark, tmp_path, monkeypatch):
    rows = compare_rows(spark, 2, 400).unionByName(compare_rows(spark, 1, 5).withColumn("project", F.lit("s"))).repartition(5)
    sinks.write_csv(rows, str(tmp_path / "whole"), "bilingual", ("project",))
    monkeypatch.setattr(sinks, "PART", 4000)
    sinks.write_csv(rows, str(tmp_path / "cut"), "bilingual", ("project",))
    want = {}
    for p in ("p0", "p1", "s"):
        (whole,) = glob.glob(f"{tmp_path}/whole/project={p}/part-*")
        parts = glob.glob(f"{tmp_path}/cut/project={p}/part-*")
        assert len(parts) == 1 if p == "s" else len(parts) > 5 and max(len(open(f, newline="").read()) for f in parts) < 8000
        assert content(f"{tmp_path}/cut/project={p}") == open(whole).read()
        want[p] = hashlib.md5(open(whole, "rb").read()).hexdigest()
    for name in ("whole", "cut"):
        assert {r.project: r.md5 for r in sinks.digests(spark, str(tmp_path / name), ("project",)).collect()} == want


def laid_out(path):
    """Content of each folder's files, by its place under path."""
    found = {}
    for f in glob.glob(f"{glob.escape(str(path))}/**/part-*", recursive=True):
        found.setdefault(os.path.relpath(os.path.dirname(f), path), []).append(open(f, newline="").read())
    return {k: sorted(v) for k, v in found.items()}


def odd_projects(spark):
    keys = [None, "", "a", "a/b", 'q"#%\'*:=?\\{}[]^', "x y", "ü語", "tab\t\x7f", "7"]
    rows = [(k, n, i, f"line {i}\rof {k}") for k in keys for n in (None, 1, 2) for i in range(3)]
    return spark.createDataFrame(rows, "name string, n int, index long, line string").repartition(5)


def test_files_of_many_small_projects_are_written_and_listed_without_a_start_for_each(spark, tmp_path):
    n = 150
    rows = spark.range(3 * n).select((F.col("id") % n).alias("conv"), F.col("id").alias("index"), F.lit("x").alias("text"))
    sc = spark.sparkContext
    sc.setJobGroup("many", "many")
    sinks.write_documents(rows, path := str(tmp_path / "d"), ("conv",))
    read = sinks.read_files(spark, path, ("conv",), {"conv": "long"})
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("many") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    sc.setJobGroup("", "")
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 10000
    # Hadoop's local file system would leave a checksum file beside each
    assert len(glob.glob(f"{path}/conv=*/*")) == len(glob.glob(f"{path}/conv=*/*") + glob.glob(f"{path}/conv=*/.*")) == n
    assert {r.conv: [x["index"] for x in json.loads(r.content)["rows"]] for r in read.collect()} == {k: [k, k + n, k + 2 * n] for k in range(n)}


def test_files_lie_as_those_of_sparks_writer(spark, tmp_path):
    rows = odd_projects(spark)
    lines = sinks.in_files(rows, ("name", "n"), F.col("line"), F.concat(F.lit(","), "line"), "!").drop("_row")
    lines.write.partitionBy("name", "n").text(str(tmp_path / "spark"))
    # null and an empty name share a folder, and Spark's writer may put both into one file of it
    parted = lambda found: {k: sorted(x for f in v for x in f.splitlines(True)) if "name=__" in k else v for k, v in found.items()}
    for _ in range(2):  # the second time in place of the first
        sinks.write_files(rows, str(tmp_path / "own"), ("name", "n"), F.col("line"), F.concat(F.lit(","), "line"), "!")
        own = laid_out(tmp_path / "own")
        assert parted(own) == parted(laid_out(tmp_path / "spark"))
        assert {k: len(v) for k, v in own.items()} == {k: 2 if "name=__" in k else 1 for k in own}
    read = sinks.read_files(spark, str(tmp_path / "own"), ("name", "n"))
    assert read.count() == 27 and read.where("name is null and n is null").count() == 2
    assert sorted(os.listdir(tmp_path)) == ["own", "spark"]


def test_a_failing_task_leaves_what_was_there(spark, tmp_path):
    rows = compare_rows(spark)
    sinks.write_documents(rows, str(tmp_path / "d"), ("project",))
    before = laid_out(tmp_path / "d")
    with pytest.raises(Exception, match="no"):
        sinks.write_documents(rows.withColumn("cn", F.when(F.col("index") == 29, F.raise_error(F.lit("no"))).otherwise("")), str(tmp_path / "d"), ("project",))
    assert laid_out(tmp_path / "d") == before and os.listdir(tmp_path) == ["d"]


def test_what_is_no_local_file_system_is_written_by_spark(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./x", f"file://{tmp_path}")
    sinks.write_documents(compare_rows(spark), "viewfs://far/x/d", ("project",))
    assert glob.glob(f"{tmp_path}/d/project=p0/.*.crc")
    assert [len(json.loads(r.content)["rows"]) for r in sinks.read_files(spark, "viewfs://far/x/d", ("project",)).collect()] == [30, 30]
