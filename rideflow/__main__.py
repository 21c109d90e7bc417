"""Job launcher, one command for each link of the chain.

    python -m rideflow publish-rides  --from rides.csv   --to topic
    python -m rideflow clean-rides    --from topic       --to topic      --checkpoint dir
    python -m rideflow load-rides     --from topic       --to ride-table --checkpoint dir
    python -m rideflow dedup-rides    --from topic       --to rides      --checkpoint dir
    python -m rideflow hourly         --from topic       --to hours      --checkpoint dir
    python -m rideflow publish-weather --from weather.csv --to topic
    python -m rideflow load-weather   --from topic       --to weather-table --checkpoint dir
    python -m rideflow prepare        --rides rides.csv  --weather weather.csv --to dir
    python -m rideflow report         --rides ride-table --weather weather-table
                                      --training dir/pastdata --to dir

A topic is a folder, or ``kafka:<servers>/<topic>``. Streaming jobs handle what has arrived and
stop, or run on with ``--every "10 seconds"``. On Kafka raw and cleaned rides are two topics, each
spread over all its partitions; with ``--fixed-partition`` they share one, on partitions 0 and 1.
Days and hours are those of UTC.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from rideflow.plans import workflows
from rideflow.sources import files, ordered, tables, topics
from rideflow.streaming import jobs

STREAMS = {
    "clean-rides": jobs.clean_stream,
    "load-rides": jobs.load_rides_stream,
    "load-weather": jobs.load_weather_stream,
    "dedup-rides": jobs.dedup_stream,
    "hourly": jobs.hourly_stream,
}
_READ_PARTITION = {
    "clean-rides": topics.RAW_PARTITION,
    "load-rides": topics.CLEAN_PARTITION,
    "load-weather": None,
    "dedup-rides": topics.RAW_PARTITION,
    "hourly": topics.CLEAN_PARTITION,
}


def _kafka(text: str) -> tuple[str, str] | None:
    if not text.startswith("kafka:"):
        return None
    servers, _, topic = text.removeprefix("kafka:").partition("/")
    return servers, topic


def source(
    text: str,
    partition: int | None,
    starting: str = "latest",
    max_per_trigger: int | None = None,
    min_tasks: int | None = None,
) -> str | dict[str, str]:
    """A folder, or Kafka options that read one partition or the whole topic."""
    kafka = _kafka(text)
    if kafka is None:
        return text
    partitions = None if partition is None else [partition]
    return topics.kafka_read_options(
        *kafka,
        partitions=partitions,
        starting=starting,
        max_per_trigger=max_per_trigger,
        min_tasks=min_tasks,
    )


def target(text: str) -> str | dict[str, str]:
    kafka = _kafka(text)
    return text if kafka is None else topics.kafka_write_options(*kafka)


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="rideflow")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("publish-rides", "publish-weather", *STREAMS):
        command = commands.add_parser(name)
        command.add_argument("--from", dest="source", required=True)
        command.add_argument("--to", required=True)
        if name in STREAMS:
            command.add_argument("--checkpoint", required=True)
            command.add_argument("--every")
            command.add_argument("--files-per-trigger", type=int)
            command.add_argument("--max-per-trigger", type=int)
            command.add_argument("--min-tasks", type=int)
            if name == "load-rides":
                command.add_argument("--resent-unchanged", action="store_true")
            if name in ("dedup-rides", "hourly"):
                command.add_argument("--delay")
            if name == "dedup-rides":
                command.add_argument("--salts", type=int)
        else:
            command.add_argument("--batch")
            if name == "publish-rides":
                command.add_argument("--in-order", action="store_true")
        if "weather" not in name:
            command.add_argument("--fixed-partition", action="store_true")
    for name in ("prepare", "report"):
        command = commands.add_parser(name)
        command.add_argument("--rides", required=True)
        command.add_argument("--weather", required=True)
        command.add_argument("--to", required=True)
        if name == "report":
            command.add_argument("--training", required=True)
            command.add_argument("--start")
            command.add_argument("--model")
        else:
            command.add_argument("--cut-off", default=workflows.CUT_OFF)
            command.add_argument("--past-after", default=workflows.PAST_AFTER)
            command.add_argument("--single-file", action="store_true")
    args = parser.parse_args(argv)
    _refuse(parser, args)
    return args


def _refuse(parser: argparse.ArgumentParser, args: argparse.Namespace) -> None:
    """Flags that would be ignored are errors."""
    if args.command in STREAMS:
        if _kafka(args.source):
            if args.files_per_trigger is not None:
                parser.error("--files-per-trigger is for folders; use --max-per-trigger on Kafka")
        elif args.max_per_trigger is not None or args.min_tasks is not None:
            parser.error("--max-per-trigger and --min-tasks are for Kafka")
        if args.command != "clean-rides" and _kafka(args.to):
            parser.error(f"{args.command} writes to a folder")
    elif args.command.startswith("publish") and _kafka(args.to) and args.batch is not None:
        parser.error("--batch is for folders")


def _partition(args: argparse.Namespace, text: str, partition: int | None) -> int | None:
    """The fixed partition on folders and where it is asked for, else all of the topic."""
    fixed = not _kafka(text) or getattr(args, "fixed_partition", False)
    return partition if fixed else None


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments(argv)
    if spark is None:
        spark = SparkSession.builder.appName(f"rideflow {args.command}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if args.command == "publish-rides":
        rides = files.read_ride_file(spark, args.source)
        send = topics.publish
        if args.in_order:
            rides = ordered.sorted_rows(rides, ["started_at", "ride_id"])
            # To Kafka every task sends a range in order; the ranges interleave as tasks run.
            send = topics.publish if _kafka(args.to) else ordered.publish
        send(
            topics.ride_messages(rides),
            target(args.to),
            _partition(args, args.to, topics.RAW_PARTITION),
            args.batch,
        )
    elif args.command == "publish-weather":
        messages = topics.weather_messages(files.read_weather_file(spark, args.source))
        topics.publish(messages, target(args.to), None, args.batch)
    elif args.command in STREAMS:
        options = ("resent_unchanged", "delay", "salts")
        extra = {k: v for k, v in vars(args).items() if k in options and v is not None}
        if args.command == "clean-rides":
            extra["to_partition"] = _partition(args, args.to, topics.CLEAN_PARTITION)
        STREAMS[args.command](
            spark,
            # A running job starts with what is new, a draining one with what is there.
            source(
                args.source,
                _partition(args, args.source, _READ_PARTITION[args.command]),
                "latest" if args.every else "earliest",
                args.max_per_trigger,
                args.min_tasks,
            ),
            target(args.to),
            args.checkpoint,
            args.every,
            args.files_per_trigger,
            **extra,
        ).awaitTermination()
    elif args.command == "prepare":
        workflows.prepare(
            spark,
            args.rides,
            args.weather,
            args.to,
            cut_off=args.cut_off,
            past_after=args.past_after,
            single_file=args.single_file,
        )
    else:
        fit = workflows.report(
            tables.read_ride_table(spark, args.rides),
            tables.read_weather_table(spark, args.weather),
            files.read_training(spark, args.training),
            args.to,
            args.start,
            args.model,
        )
        print(f"{fit} % model fit")


if __name__ == "__main__":
    main()
