from pyspark.sql import functions as F

from provenant.functions import scalars as S


def test_a_text_is_taken_apart_once(spark):
    rows = spark.createDataFrame([("3/4/2024", "1:05", "p.m.")], "d string, t string, a string").repartition(2)
    found = rows.select(F.explode(F.array(S.chat_ts(F.col("d"), F.col("t"), F.col("a")))).alias("c")).select("c.*")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 7  # each group of a date or time once, and the year's length
    assert [(str(r.ts), r.status, r.ambiguous) for r in found.collect()] == [("2024-04-03 13:05:00", "parsed_local_time", True)]
