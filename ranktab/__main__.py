"""``spark-submit``-able entry: ``python -m ranktab --mode stacking …``."""

from __future__ import annotations

import argparse

from ranktab.operators.results import head, result_summary
from ranktab.plans import jobs
from ranktab.plans.learners import FULL, QUICK
from ranktab.schema import SNAKE, TITLE
from ranktab.session import build_session
from ranktab.sources.sinks import save_results
from ranktab.sources.staging import staged_scope
from ranktab.sources.tables import load_dataset

#: ``competitive`` is the stacking job under its usual name.
CHOICES = ("competitive", "ranking", "meta-stacking", "snapshot", "single", "final", "evaluate", "search")
ALIASES = {"competitive": "stacking", "meta-stacking": "stacking"}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ranktab")
    parser.add_argument("--mode", choices=CHOICES, default="competitive")
    parser.add_argument("--train", required=True)
    parser.add_argument("--test", required=True)
    parser.add_argument("--original")
    parser.add_argument("--out", required=True)
    parser.add_argument("--columns", choices=("title", "snake"), default="title")
    parser.add_argument("--size", choices=("quick", "full"), default="full")
    parser.add_argument("--folds", type=int, default=15)
    parser.add_argument("--top", type=int, default=3)
    parser.add_argument("--calibrate", action="store_true")
    args = parser.parse_args(argv)

    spark = build_session()
    columns = TITLE if args.columns == "title" else SNAKE
    config = jobs.JobConfig(
        columns=columns,
        size=FULL if args.size == "full" else QUICK,
        folds=args.folds,
        top=args.top,
        calibrate=args.calibrate,
    )
    with staged_scope(spark):
        _run(spark, args, columns, config)


def _run(spark, args: argparse.Namespace, columns, config: jobs.JobConfig) -> None:
    data = load_dataset(spark, args.train, args.test, args.original, columns)
    if args.mode == "evaluate":
        jobs.evaluate_job(data.train, config).show(truncate=False)
    elif args.mode == "search":
        found = jobs.run_search(
            data.train, config, test=data.test, original=data.original, path=args.out
        )
        found.experiments(spark).show(truncate=False)
    else:
        mode = ALIASES.get(args.mode, args.mode)
        save_results(jobs.run_job(data.train, data.test, mode, config), args.out)
        written = spark.read.option("header", True).csv(f"{args.out}/submission.csv")
        result_summary(written, columns.label).show()
        head(written, 10, columns.id).show(truncate=False)


if __name__ == "__main__":
    main()
