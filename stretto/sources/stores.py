"""Folders of scores and templates: what is saved is read back, and files of one folder per score or template are read as well.

A store is a few tables under one root, partitioned by what they are keyed by, so thousands of scores are one job either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import SCHEMA_VERSION, note_violations, strict, track_violations
from ..operators.timeline import catalogue, notes_per_interval
from . import json_io

# Where stores are looked for when no root is given, relative to the working folder.
SCORES, TEMPLATES, TEMPLATE_MAP = "data/scores", "templates", "data/score_template_map.json"
META = f"schema_version string, score_id string, title string, tempo double, time_signature string, key string, total_measures int, interval_measures int, interval_count int, note_count long, source_path string, source_sha256 string, created_at string, intervals array<{json_io.INTERVAL}>"
NOTES = f"schema_version string, score_id string, notes array<{json_io.NOTE}>"
TEMPLATE = "template_id string, feature_kind string, source_wav string, sample_rate int, hop_length int, frame_sec double, num_frames long, duration_sec double, created_at string, params_hash string"


def found(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or pattern stands for anything, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    hits = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return hits is not None and len(hits) > 0


def _documents(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """JSON documents of both layouts: root/table/score_id=.../, a document a line, and root/*/table.json, a document a file."""
    out = spark.createDataFrame([], schema)
    if found(spark, f"{root}/{table}/*/*.json"):
        out = out.unionByName(spark.read.schema(schema).json(f"{root}/{table}/*/*.json", mode="FAILFAST"))
    if found(spark, f"{root}/*/{table}.json"):
        out = out.unionByName(spark.read.schema(schema).json(f"{root}/*/{table}.json", multiLine=True, mode="FAILFAST"))
    return out


def _write(documents: DataFrame, path: str, key: str, overwrite: bool) -> None:
    rows = documents.withColumn("_key", F.col(key))
    rows.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy("_key").json(path)


def _refuse_known(spark: SparkSession, rows: DataFrame, known: DataFrame, key: str) -> None:
    again = rows.select(key).join(known.select(key), key, "left_semi").limit(1).collect()
    if again:
        raise FileExistsError(f"already there: {again[0][0]}")


def save_scores(headers: DataFrame, notes: DataFrame, root: str = SCORES, overwrite: bool = False) -> None:
    """Scores as two tables of JSON documents, headers and notes, by score. One that is there is an error unless overwrite, and then
    it is replaced; other scores stay."""
    spark = headers.sparkSession
    size = 4
    counts = notes_per_interval(headers, notes, size).groupBy("score_id").agg(F.sort_array(F.collect_list(F.struct("id", "start_measure", "end_measure", F.col("note_count").cast("int").alias("note_count")))).alias("intervals"))
    totals = catalogue(headers, notes, size).select("score_id", "interval_count", "note_count")
    wanted = [c.split()[0] for c in META.split(", intervals")[0].split(", ")]
    whole = headers.drop("intervals", "note_count", "interval_count", "interval_measures", "schema_version").join(totals, "score_id").join(counts, "score_id", "left")
    whole = whole.withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("interval_measures", F.lit(size))
    meta = whole.select(*[F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in wanted], "intervals")
    fields = [f.split(":")[0] for f in json_io.NOTE.removeprefix("struct<").removesuffix(">").split(",")]
    kinds = dict(f.split(":") for f in json_io.NOTE.removeprefix("struct<").removesuffix(">").split(","))
    own = F.struct(*[(F.col(c) if c in notes.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in fields])
    nested = notes.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", own.alias("n")))), lambda x: x["n"]).alias("notes"))
    nested = headers.select("score_id").join(nested, "score_id", "left").select(F.lit(SCHEMA_VERSION).alias("schema_version"), "score_id", F.coalesce("notes", F.array().cast(f"array<{json_io.NOTE}>")).alias("notes"))
    if not overwrite:
        _refuse_known(spark, meta, _documents(spark, root, "meta", META), "score_id")
    _write(nested, f"{root}/notes", "score_id", overwrite)
    _write(meta, f"{root}/meta", "score_id", overwrite)


def load_scores(spark: SparkSession, root: str = SCORES, score_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, notes) of stored scores, of all or of those named. A score without its header or notes is an error, as is a name
    that is not there."""
    meta, notes = _documents(spark, root, "meta", META), _documents(spark, root, "notes", NOTES)
    if score_ids is not None:
        meta, notes = (t.where(F.col("score_id").isin(score_ids)) for t in (meta, notes))
        there = {r[0] for r in meta.select("score_id").collect()}  # as many as are asked for by name
        if missing := sorted(set(score_ids) - there):
            raise FileNotFoundError(f"no such score: {missing[0]}")
    both = meta.join(notes.select("score_id", "notes"), "score_id", "full")
    whole = F.when(F.col("title").isNotNull() | F.col("total_measures").isNotNull(), F.lit(True)) & F.col("notes").isNotNull()
    named = F.concat(F.lit("a score without header or notes: "), F.col("score_id"))
    both = both.withColumn("score_id", F.when(F.coalesce(whole, F.lit(False)), F.col("score_id")).otherwise(F.raise_error(named).cast("string")))
    rows = both.select("score_id", "tempo", F.posexplode("notes").alias("pos", "n")).select("score_id", "tempo", F.col("pos").cast("long").alias("ord"), "n.*")
    return both.drop("notes").withColumn("interval_measures", F.coalesce("interval_measures", F.lit(4))), rows.withColumn("is_rest", F.coalesce("is_rest", F.lit(False)))


def list_scores(spark: SparkSession, root: str = SCORES) -> DataFrame:
    """score_id, title, total_measures, interval_count, note_count, created_at of all stored scores, by id; none without a store."""
    return _documents(spark, root, "meta", META).select("score_id", "title", "total_measures", "interval_count", "note_count", "created_at").orderBy("score_id")


def dump_scores(headers: DataFrame, notes: DataFrame, root: str) -> None:
    """Score files, a document each, that json_io.read_scores(root + "/*/*") reads back; checked first."""
    checked = strict(note_violations(notes if "tempo" in notes.columns else notes.join(headers.select("score_id", "tempo"), "score_id")), "score data")
    kinds = dict(f.split(":") for f in json_io.NOTE.removeprefix("struct<").removesuffix(">").split(","))
    own = F.struct(*[(F.col(c) if c in checked.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    nested = checked.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", own.alias("n")))), lambda x: x["n"]).alias("notes"))
    whole = headers.drop("schema", "schema_version", "violations", "path").join(nested, "score_id", "left").select(F.lit("score_data").alias("schema"), F.lit(SCHEMA_VERSION).alias("schema_version"), "*")
    whole.select(F.col("score_id").alias("_key"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").partitionBy("_key").text(root)


def dump_tracks(headers: DataFrame, frames: DataFrame, root: str) -> None:
    """Pitch-track files of headers and frames (both by perf_id), a document each, that json_io.read_tracks(root + "/*/*") reads
    back; checked first."""
    own = F.struct(F.col("t").alias("time_sec"), "frequency_hz", F.col("midi").alias("pitch_midi"), "pitch", "voiced")
    nested = frames.groupBy("perf_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", own.alias("f")))), lambda x: x["f"]).alias("frames"))
    whole = strict(track_violations(headers), "pitch track").drop("schema", "schema_version", "path").join(nested, "perf_id", "left")
    whole = whole.withColumn("frames", F.coalesce("frames", F.expr("cast(array() as array<struct<time_sec:double,frequency_hz:double,pitch_midi:double,pitch:string,voiced:boolean>>)")))
    body = F.struct(F.lit("pitch_track_data").alias("schema"), F.lit(SCHEMA_VERSION).alias("schema_version"), *[c for c in whole.columns if c != "perf_id"])
    whole.select(F.base64(F.encode("perf_id", "utf-8")).alias("_key"), F.to_json(body, {"pretty": "true"}).alias("value")).write.mode("overwrite").partitionBy("_key").text(root)


def dump_note_events(events: DataFrame, root: str) -> None:
    """Note events (template_id, ...), a document a line, that load_templates and json_io.read_note_events(root + "/*/*") read back."""
    events.withColumn("_key", F.col("template_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_key").json(root)


def write_report(measures: DataFrame, totals: DataFrame, root: str) -> None:
    """A report of evaluation: the totals as JSON, the measures (perf_id, measure, hits, notes, line) as CSV and as Markdown."""
    totals.write.mode("overwrite").json(f"{root}/summary")
    measures.write.mode("overwrite").csv(f"{root}/measures", header=True)
    row = F.concat_ws(" | ", F.lit("").alias("a"), F.col("measure").cast("string"), F.concat_ws("/", F.col("hits").cast("string"), F.col("notes").cast("string")), F.col("line"), F.lit(""))
    lines = measures.groupBy("perf_id").agg(F.array_sort(F.collect_list(F.struct("measure", F.trim(row).alias("row")))).alias("rows"))
    head = F.concat(F.lit("# "), F.col("perf_id").cast("string"), F.lit("\n\n| Measure | Hits | Notes |\n|---|---|---|\n"))
    lines.select(F.concat(head, F.array_join(F.transform("rows", lambda x: x["row"]), "\n")).alias("value"), F.col("perf_id").alias("_key")).write.mode("overwrite").partitionBy("_key").text(f"{root}/markdown")


def save_templates(meta: DataFrame, frames: DataFrame, events: DataFrame | None = None, root: str = TEMPLATES, overwrite: bool = False) -> None:
    """Templates as three tables: meta (template_id, ...; calibration among it, if any), frames (template_id, kind, idx, vec) and note
    events. One that is there is an error unless overwrite, and then it is replaced."""
    spark = meta.sparkSession
    if not overwrite and found(spark, f"{root}/meta/*"):
        _refuse_known(spark, meta, spark.read.parquet(f"{root}/meta"), "template_id")
    mode = "overwrite" if overwrite else "append"
    save = lambda rows, name, *by: rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")
    save(frames.repartition("template_id", "kind").sortWithinPartitions("template_id", "kind", "idx"), "frames", "template_id", "kind")
    if events is not None:
        save(events, "events", "template_id")
    save(meta, "meta", "template_id")


def load_templates(spark: SparkSession, root: str = TEMPLATES, template_ids: list[str] | None = None, fallback_events: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, frames, note events) of stored templates, of all or of those named; a name that is not there is an error.

    Folders of one template each (meta.json, mel.npy, pitch.npy and their coarse forms, note_events.json) are read as well.
    fallback_events (template_id, ...) stand in for templates that bring none.
    """
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    metas, frames, events = [], [], []
    if found(spark, f"{root}/meta/*"):
        metas.append(spark.read.parquet(f"{root}/meta").withColumn("template_id", F.col("template_id").cast("string")))
        frames.append(spark.read.parquet(f"{root}/frames").select(F.col("template_id").cast("string").alias("template_id"), "kind", "idx", "vec"))
        if found(spark, f"{root}/events/*"):
            events.append(spark.read.parquet(f"{root}/events").withColumn("template_id", F.col("template_id").cast("string")))
    if found(spark, f"{root}/*/meta.json"):
        metas.append(spark.read.schema(TEMPLATE).json(f"{root}/*/meta.json", multiLine=True, mode="FAILFAST"))
        for kind in ("mel", "mel_coarse", "pitch", "pitch_coarse"):
            if found(spark, f"{root}/*/{kind}.npy"):
                frames.append(json_io.read_template_arrays(spark, f"{root}/*/{kind}.npy").select(name.alias("template_id"), F.lit("coarse" if kind.endswith("coarse") else "fine").alias("kind"), "idx", "vec"))
        if found(spark, f"{root}/*/note_events.json"):
            events.append(json_io.read_note_events(spark, f"{root}/*/note_events.json").withColumn("template_id", name).drop("path"))
    together = lambda tables, schema: spark.createDataFrame([], schema) if not tables else tables[0] if len(tables) == 1 else tables[0].unionByName(together(tables[1:], schema), allowMissingColumns=True)
    meta, frame, event = together(metas, TEMPLATE), together(frames, "template_id string, kind string, idx long, vec array<double>"), together(events, f"{json_io.EVENTS}, template_id string")
    if fallback_events is not None:
        event = event.unionByName(fallback_events.join(event.select("template_id").distinct(), "template_id", "left_anti"), allowMissingColumns=True)
    if template_ids is not None:
        meta, frame, event = (t.where(F.col("template_id").isin(template_ids)) for t in (meta, frame, event))
        there = {r[0] for r in meta.select("template_id").collect()}  # as many as are asked for by name
        if missing := sorted(set(template_ids) - there):
            raise FileNotFoundError(f"no such template: {missing[0]}")
    return meta, frame, event
