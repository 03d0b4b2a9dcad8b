"""Stored transcript JSON as rows of segments and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string,probability:double>>>>"


def parsed_segments(json_text: Column) -> Column:
    """The typed array; null where the JSON isn't valid or has a key twice. Numbers that aren't finite are allowed in fields nobody uses."""
    strict = F.try_parse_json(F.regexp_replace(json_text, r"(?<=[:\[,\s])-?(NaN|Infinity)(?=[,\]}\s])", "null")).isNotNull()
    return F.when(strict, F.from_json(json_text, SEGMENTS))


def explode_segments(derived: DataFrame, key: str = "id", column: str = "segments_json") -> DataFrame:
    found = derived.select(F.col(key).alias("derived_text_id"), parsed_segments(F.col(column)).alias("segments"))
    return found.select("derived_text_id", F.posexplode_outer("segments").alias("segment_index", "s")).select("derived_text_id", "segment_index", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.col("s.text").alias("text"), F.col("s.words").alias("words"))


def explode_words(derived: DataFrame, key: str = "id", column: str = "segments_json") -> DataFrame:
    rows = explode_segments(derived, key, column).select("derived_text_id", "segment_index", F.posexplode("words").alias("word_index", "w"))
    return rows.select("derived_text_id", "segment_index", "word_index", F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), F.col("w.word").alias("word"))


def nest_segments(segments: DataFrame) -> DataFrame:
    """derived_text_id, segments (array in order) from rows (derived_text_id, segment_index, start_s, end_s, text), one word a segment's token with its leading space."""
    # exploded, not projected: the lambda below would otherwise split the text anew for every word
    cut = segments.withColumn("_tokens", F.explode(F.array(F.filter(F.split("text", r"(?= )"), lambda w: w != ""))))
    step = (F.col("end_s") - F.col("start_s")) / F.greatest(F.lit(1), F.size("_tokens"))
    words = F.transform("_tokens", lambda w, i: F.struct((F.col("start_s") + step * i).alias("start"), F.least(F.col("end_s"), F.col("start_s") + step * (i + 1)).alias("end"), w.alias("word")))
    rows = cut.select("derived_text_id", F.struct("segment_index", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", words.alias("words")).alias("s"))
    return rows.groupBy("derived_text_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("derived_text_id", F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["words"].alias("words"))).alias("segments"))
