"""Links by name: names that many rows share are dealt over cells."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenant.operators import joins as J


def some(spark):
    name = F.when(F.col("id") % 3 > 0, "x").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), F.col("id") % 40))
    rows = spark.range(300).withColumn("name", name)
    observed = rows.select(F.when(F.col("id") % 50 != 7, F.col("id") % 290).alias("observation_id"), F.concat(F.lit("a/"), "name").alias("value"))
    return observed, rows.filter("id % 4 <> 1").select(F.col("id").alias("file_id"), "name")


def plain(observed, files):
    links = observed.withColumn("name", F.element_at(F.split("value", "/"), -1)).join(files, "name")
    return links.withColumn("ambiguous", F.count("*").over(Window.partitionBy("observation_id")) > 1)


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_cells_make_all_links_once_over_many_tasks(spark, monkeypatch):
    observed, files = some(spark)
    monkeypatch.setattr(J, "CELL", 20)
    monkeypatch.setattr(J, "TASK_PAIRS", 500)
    found = J.candidate_links(observed, files)
    assert rows(found, "observation_id", "file_id", "ambiguous") == rows(plain(observed, files), "observation_id", "file_id", "ambiguous")
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < sum(tasks) / 5  # one name has nine tenths of the links
    recordings = observed.select(F.col("observation_id").alias("recording_id"), F.element_at(F.split("value", "/"), -1).alias("recording_name"))
    named = files.withColumnRenamed("file_id", "uri")
    want = recordings.join(named, F.col("recording_name") == F.col("name"))
    assert rows(J.recording_candidates(recordings, named), "recording_id", "uri", "file_name") == rows(want, "recording_id", "uri", "name")
    assert rows(J.selected_candidates(recordings, named), "uri") == rows(want.select("uri").distinct(), "uri")


def test_first_links_need_few_observations_and_files(spark):
    observed, files = some(spark)
    for limit in (1, 7, 200, 100_000):
        assert rows(J.first_links(observed, files, limit), "observation_id", "file_id", "ambiguous", "limited") == rows(J.capped_links(plain(observed, files), limit), "observation_id", "file_id", "ambiguous", "limited")


def test_cells_grow_where_tasks_do_not(spark, monkeypatch):
    observed, files = some(spark)
    for name, value in (("CELL", 5), ("TASK_PAIRS", 100), ("TASKS", 6), ("RUN", 7), ("SOME", 3)):
        monkeypatch.setattr(J, name, value)
    found = J.candidate_links(observed, files)
    assert found.rdd.getNumPartitions() <= 6
    assert rows(found, "observation_id", "file_id", "ambiguous") == rows(plain(observed, files), "observation_id", "file_id", "ambiguous")


def test_a_file_of_links_takes_few_bytes_a_link(spark, tmp_path):
    recordings = spark.range(1_501).select(F.col("id").alias("recording_id"), F.lit("x").alias("recording_name"))
    files = spark.range(1_501).select((F.col("id") * 3).alias("uri"), F.lit("x").alias("name"))
    J.recording_candidates(recordings, files).select("recording_id", "uri").write.parquet(str(tmp_path / "links"))
    found = spark.read.parquet(str(tmp_path / "links"))
    assert (found.count(), found.distinct().count()) == (1_501 * 1_501, 1_501 * 1_501)
    assert sum(f.stat().st_size for f in (tmp_path / "links").glob("*.parquet")) < 0.3 * 1_501 * 1_501  # it was more than a byte
