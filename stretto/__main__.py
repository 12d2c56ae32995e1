"""Command line: python -m stretto import SCORES OUT | recognize NOTES ONSETS FRAMES OUT | build WAVS | match TEMPLATE WAVS |
locate TEMPLATE WAVS | scores ROOT | query NAME TABLES [OUT]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import api
from .functions.config import JudgeSettings
from .operators.recognize import recognize, summarize
from .plans import catalogue
from .sources import musicxml, stores


def _told(rows: DataFrame) -> None:
    """Rows as JSON records, one a line."""
    for r in rows.toJSON().toLocalIterator():
        print(r)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stretto", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    take = commands.add_parser("import", help="notation files to tables of headers and notes")
    take.add_argument("files")
    take.add_argument("out")
    take.add_argument("--part")
    judge = commands.add_parser("recognize", help="verdicts and summaries of performances given as Parquet tables")
    for name in ("expected", "onsets", "frames", "out"):
        judge.add_argument(name)
    judge.add_argument("--mode", default="anchored_grid")
    judge.add_argument("--hop", type=float, default=512 / 22050)
    build = commands.add_parser("build", help="templates of recordings, by their files' names")
    build.add_argument("recordings")
    build.add_argument("--scores", help="notation files of the same names")
    build.add_argument("--overwrite", action="store_true")
    build.add_argument("--allow-short-template", action="store_true")
    match = commands.add_parser("match", help="where recordings lie in a template")
    match.add_argument("--top-k", type=int, default=3)
    match.add_argument("--search-mode", choices=("global", "coarse_local"), default="global")
    locate = commands.add_parser("locate", help="the note at which recordings begin in a template")
    for c in (match, locate):
        c.add_argument("template")
        c.add_argument("recordings")
    for c in (build, match, locate):
        c.add_argument("--root", default=stores.TEMPLATES)
    listed = commands.add_parser("scores", help="the stored scores")
    listed.add_argument("root", nargs="?", default=stores.SCORES)
    query = commands.add_parser("query", help="a registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("tables")
    query.add_argument("out", nargs="?")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("stretto").getOrCreate()
    if given.command == "import":
        items = musicxml.scan(spark, given.files)
        musicxml.score_headers(items, part_id=given.part).withColumn("created_at", api.now()).write.mode("errorifexists").parquet(f"{given.out}/scores")
        musicxml.practice_notes(items, part_id=given.part).write.mode("errorifexists").parquet(f"{given.out}/notes")
    elif given.command == "recognize":
        tables = [spark.read.parquet(p) for p in (given.expected, given.onsets, given.frames)]
        recognize(*tables, JudgeSettings(mode=given.mode), given.hop).write.mode("errorifexists").parquet(f"{given.out}/verdicts")
        summarize(spark.read.parquet(f"{given.out}/verdicts")).write.mode("errorifexists").parquet(f"{given.out}/summaries")
    elif given.command == "build":
        _told(api.build_template(spark, given.recordings, given.scores, given.root, guard=not given.allow_short_template, overwrite=given.overwrite))
    elif given.command == "match":
        _told(api.match_query(spark, given.template, given.recordings, given.root, given.search_mode, given.top_k))
    elif given.command == "locate":
        _told(api.locate_query(spark, given.template, given.recordings, given.root))
    elif given.command == "scores":
        _told(stores.list_scores(spark, given.root))
    else:
        rows = catalogue.queries()[given.name](spark, given.tables)
        rows.write.mode("errorifexists").parquet(given.out) if given.out else rows.show(50, False)


if __name__ == "__main__":
    main()
