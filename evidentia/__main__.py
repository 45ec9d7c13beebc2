"""python -m evidentia --corpus FOLDER [--corpus FOLDER ...] [--brands FILE] --output FOLDER

Replays corpora and writes a JSON and a Markdown report for each mission. Exit code 0 for every business status, 1 for a
corpus that isn't sound."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evidentia", description=__doc__)
    parser.add_argument("--corpus", action="append", required=True)
    parser.add_argument("--brands")
    parser.add_argument("--output", required=True)
    asked = parser.parse_args(argv)

    from evidentia.plans import report
    from evidentia.plans.replay import checked_replay
    from evidentia.sources.corpus import load
    from evidentia.sources.tables import read_brands

    spark = SparkSession.builder.appName("evidentia").getOrCreate()
    try:
        corpus = load(spark, asked.corpus)
        made = report.reports(checked_replay(corpus, read_brands(asked.brands)), corpus.requirements).persist()
    except ValueError as error:
        print(json.dumps(report.failure("invalid_input", str(error))))
        return 1
    out = Path(asked.output)
    out.mkdir(parents=True, exist_ok=True)
    # a report a mission that was named on the command line
    for r in report.as_json(made).join(report.as_markdown(made).withColumnRenamed("report", "markdown"), "mission_id").toLocalIterator():
        (out / f"{r['mission_id']}.json").write_text(r["report"], encoding="utf-8")
        (out / f"{r['mission_id']}.md").write_text(r["markdown"], encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
