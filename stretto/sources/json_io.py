"""Interchange files: scores, pitch tracks, note events, labels, maps, templates; in and out."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import SCHEMA_VERSION, note_violations, strict, track_violations

NOTE = "struct<pitch:string,measure:int,beat:double,onset:double,duration:double,interval_id:int,pitch_midi:double,note_index_in_measure:int,is_rest:boolean>"
INTERVAL = "struct<id:int,start_measure:int,end_measure:int,note_count:int>"
SCORE = f"schema string, schema_version string, score_id string, title string, tempo double, time_signature string, key string, total_measures int, interval_measures int, source_path string, source_sha256 string, created_at string, intervals array<{INTERVAL}>, notes array<{NOTE}>"
TRACK = "schema string, schema_version string, sample_rate int, frame_size int, window_duration_sec double, frames array<struct<time_sec:double,frequency_hz:double,pitch_midi:double,pitch:string,voiced:boolean>>"
EVENTS = "note_id string, measure int, beat double, pitch_midi int, start_sec double, end_sec double, duration_sec double, part_id string, voice string"


def _json(spark: SparkSession, paths: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths, multiLine=True, mode="FAILFAST").withColumn("path", F.col("_metadata.file_path"))


def read_scores(spark: SparkSession, paths: str, strict_schema: bool = True) -> tuple[DataFrame, DataFrame]:
    """(headers, notes) of score files. A wrong schema tag or a bad note is an error in strict mode."""
    raw = _json(spark, paths, SCORE)
    ok = (F.col("schema") == "score_data") & (F.col("schema_version") == SCHEMA_VERSION)
    raw = raw.withColumn("schema", F.when(ok, F.col("schema")).otherwise(F.raise_error(F.lit("not score data of this version")).cast("string")) if strict_schema else F.coalesce("schema", F.lit("score_data")))
    notes = raw.where("schema is not null").select("score_id", "tempo", F.posexplode("notes").alias("pos", "n")).select("score_id", "tempo", F.col("pos").cast("long").alias("ord"), "n.*").withColumn("is_rest", F.coalesce("is_rest", F.lit(False)))
    return raw.drop("notes"), strict(note_violations(notes), "score data") if strict_schema else notes


def read_tracks(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """(headers, frames) of pitch-track files."""
    raw = strict(track_violations(_json(spark, paths, TRACK)), "pitch track")
    ok = (F.col("schema") == "pitch_track_data") & (F.col("schema_version") == SCHEMA_VERSION)
    raw = raw.withColumn("schema", F.when(ok, F.col("schema")).otherwise(F.raise_error(F.lit("not pitch-track data of this version")).cast("string"))).where("schema is not null")
    frames = raw.select(F.col("path").alias("perf_id"), F.posexplode("frames").alias("frame_idx", "f"))
    return raw.drop("frames"), frames.select("perf_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("f.time_sec").alias("t"), F.col("f.frequency_hz").alias("frequency_hz"), F.col("f.pitch_midi").alias("midi"), F.col("f.pitch").alias("pitch"), F.col("f.voiced").alias("voiced"))


def read_note_events(spark: SparkSession, paths: str) -> DataFrame:
    return _json(spark, paths, EVENTS)


def read_labels(spark: SparkSession, paths: str) -> DataFrame:
    """Expected notes of label files, one per row."""
    raw = _json(spark, paths, "piece_id string, tempo_bpm double, expected_notes array<struct<onset_sec:double,duration_sec:double,pitch_midi:double,measure:int,note_index_in_measure:int,note_id:string>>")
    return raw.select(F.col("piece_id").alias("perf_id"), F.col("tempo_bpm").alias("tempo"), F.posexplode("expected_notes").alias("ord", "n")).select("perf_id", "tempo", F.col("ord").cast("long").alias("ord"), F.col("n.onset_sec").alias("onset"), F.col("n.duration_sec").alias("dur"), F.col("n.pitch_midi").alias("midi"), F.col("n.measure").alias("measure"), F.col("n.note_index_in_measure").alias("idx"))


def read_template_map(spark: SparkSession, path: str) -> DataFrame:
    """score_id, template_id; values may be names or records, with or without a wrapper. Anything else is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.entries"), F.col("value")).alias("v"))
    pairs = raw.select(F.explode(F.from_json("v", "map<string,string>")).alias("score_id", "value"))
    named = F.when(F.col("value").startswith("{"), F.get_json_object("value", "$.template_id")).when(~F.col("value").startswith("["), F.trim(F.col("value"), F.lit('"')))
    return pairs.select("score_id", F.coalesce(named, F.raise_error(F.concat(F.lit("no template for "), F.col("score_id"))).cast("string")).alias("template_id"))


def read_template_arrays(spark: SparkSession, paths: str) -> DataFrame:
    """path, idx, vec of matrices stored as .npy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
                x = x.reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], names=["path", "idx", "vec"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, idx long, vec array<double>")

