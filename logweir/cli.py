"""Command line: python -m logweir.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from logweir.plans import stages
from logweir.sources import demo, raw, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("logweir").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logweir")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str):
        one = commands.add_parser(name, help=text)
        for a in arguments:
            one.add_argument(a)
        return one

    get = command("download", "copy a file, going on where an earlier copy stopped, and verify its checksum", "source", "target")
    get.add_argument("--sha256")
    convert = command("to-parquet", "raw text log to typed Parquet by day", "source", "out")
    convert.add_argument("--days", help="first-last")
    convert.add_argument("--overwrite", action="store_true")
    convert.add_argument("--expect-rows", type=int)
    plan = command("preflight", "disk and memory that a log needs")
    plan.add_argument("--events", type=int, required=True)
    plan.add_argument("--largest-day", type=int, required=True)
    plan.add_argument("--path", help="refuse where this has too little space")
    make = command("generate-demo", "write a made-up log and its list of intrusions", "out")
    make.add_argument("--days", type=int, default=12)
    make.add_argument("--seed", type=int, default=0)
    for name, text, arguments in (("build-features", "feature store of a converted log", ("interim", "redteam", "out")), ("train-eval", "fit and evaluate models on a feature store", ("store", "out")), ("demo", "all stages on a made-up log", ("out",))):
        one = command(name, text, *arguments)
        one.add_argument("--config", default="{}", help="settings as JSON")
        one.add_argument("--models", help="comma-separated")
    return top


def config_of(text: str) -> stages.Config:
    return stages.Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}).check()


def run_demo(spark: SparkSession, out: str, config: stages.Config, models: list[str] | None) -> None:
    log = demo.demo_log(spark, days=config.test[1] + 1, seed=config.seed)
    log.orderBy("event_id").drop("event_id").write.mode("overwrite").csv(f"{out}/auth")
    demo.demo_redteam(log).write.mode("overwrite").csv(f"{out}/redteam")
    report = stages.to_parquet(spark, f"{out}/auth", f"{out}/interim", overwrite=True)
    raw.verify_row_count(report, report.rows_in)
    store = stages.build_features(spark, f"{out}/interim", f"{out}/redteam", f"{out}/features", config)
    stages.train_eval(spark, store, f"{out}/results", config, models)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(arguments)
    if asked.command == "preflight":
        disk, memory = raw.total_disk(asked.events), raw.peak_memory(asked.largest_day)
        print(json.dumps({"disk_bytes": disk, "memory_bytes": memory}))
        if asked.path:
            raw.require_free_space(asked.path, disk)
        return 0
    if asked.command == "download":
        raw.copy_with_resume(asked.source, asked.target, asked.sha256)
        return 0
    spark = spark or session()
    if asked.command == "to-parquet":
        days = tuple(int(x) for x in asked.days.split("-")) if asked.days else None
        report = stages.to_parquet(spark, asked.source, asked.out, days, asked.overwrite)
        if asked.expect_rows is not None:
            raw.verify_row_count(report, asked.expect_rows)
        print(json.dumps(vars(report)))
    elif asked.command == "generate-demo":
        log = demo.demo_log(spark, days=asked.days, seed=asked.seed)
        sinks.write_csv(log, f"{asked.out}/auth")
        sinks.write_csv(demo.demo_redteam(log), f"{asked.out}/redteam")
    else:
        config, models = config_of(asked.config), asked.models.split(",") if asked.models else None
        if asked.command == "build-features":
            print(stages.build_features(spark, asked.interim, asked.redteam, asked.out, config))
        elif asked.command == "train-eval":
            stages.train_eval(spark, asked.store, asked.out, config, models).orderBy("model", "metric", "budget").show(1000, False)
        else:
            run_demo(spark, asked.out, config, models)
    return 0


if __name__ == "__main__":
    sys.exit(main())
