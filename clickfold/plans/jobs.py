"""Command-line entry points: ``spark-submit run_job.py <job> …``."""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clickfold.functions.clock import parse_day, utc_now
from clickfold.operators.audit import FAILED, SUCCESS
from clickfold.operators.products import batch_summary, batch_top
from clickfold.operators.quality import check_not_null, check_unique
from clickfold.operators.retention import RETENTION_DAYS, default_cutoff
from clickfold.plans.marts import build_marts
from clickfold.schemas import METRIC_KEYS
from clickfold.session import build_session
from clickfold.sources.kafka import kafka_options, read_event_stream, resume_offsets
from clickfold.sources.tables import require_table, table_exists
from clickfold.streaming.live import (
    EVERY,
    RENEW_AFTER,
    clean_landing,
    refuse_drops,
    start_landing,
    start_renewed,
    start_throughput,
)
from clickfold.streaming.store import EventStore
from clickfold.streaming.windows import WindowTable

CLEAN_EVERY_SECONDS = 600

log = logging.getLogger("clickfold")


def run_daily(store: EventStore, day: dt.date, now: dt.datetime) -> int:
    """Recompute a day's product metrics and log the summary; returns the event count."""
    oldest = default_cutoff(now).date()
    if not store.replace_day(day, oldest):
        log.warning("no events on %s", day)
        return 0
    metrics = store.product_metrics([day]).persist()
    try:
        summary = batch_summary(metrics).first()
        top = batch_top(metrics).collect()
    finally:
        metrics.unpersist()
    log.info(
        "%s: %d events, %d views, %d purchases, revenue %.2f, conversion %.2f%%",
        day,
        summary.records_processed,
        summary.total_views,
        summary.total_purchases,
        summary.total_revenue,
        summary.conversion_pct,
    )
    for place, row in enumerate(top, 1):
        log.info("%d. %s (%s) %s", place, row.product_name, row.category, row.total_revenue)
    return summary.records_processed


def run_checks(store: EventStore, day: dt.date | None = None, full: bool = False) -> int:
    """Ids must be present and unique, and (date, product) unique in the metrics; returns the
    number of failures.

    Without a day, only days that changed since the last such check that found nothing are read;
    ``full`` reads all days, and so also finds an id repeated on different days.
    """
    batch, run = store.last_committed(), store.last_run()
    since = None if full or day is not None else store.checked_up_to()
    days = None if day is None else [str(day)]
    if since is not None:
        days = store.changed_days(**since)
    raw = store.raw_events(days=days)
    nulls = check_not_null(raw, ["event_id"]).agg(F.sum("null_rows")).first()[0]
    copies = check_unique(raw, ["event_id"]).count()
    dates = None if days is None else [dt.date.fromisoformat(d) for d in days]
    keys = check_unique(store.product_metrics(dates), METRIC_KEYS).count()
    log.info("event_id: %d null, %d repeated; metric keys: %d repeated", nulls, copies, keys)
    failures = nulls + copies + keys
    if day is None and not failures and batch is not None:
        store.mark_checked(batch, run)
    return failures


def recorded(store: EventStore, job: str, now: dt.datetime, work: Callable[[], int | None]):
    """Run ``work`` and leave a job-run row, also when it fails."""
    run_id = str(uuid.uuid4())
    try:
        records = work()
    except Exception as error:
        store.record_run(
            run_id=run_id,
            dag_id=job,
            status=FAILED,
            started_at=now,
            finished_at=utc_now(),
            records_processed=0,
            error_message=str(error),
        )
        raise
    store.record_run(
        run_id=run_id,
        dag_id=job,
        status=SUCCESS,
        started_at=now,
        finished_at=utc_now(),
        records_processed=records,
    )
    return records


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="clickfold")
    parser.add_argument("--root", required=True, help="folder of the event store")
    jobs = parser.add_subparsers(dest="job", required=True)

    stream = jobs.add_parser("stream", help="land and publish events from Kafka")
    stream.add_argument("--servers", required=True)
    stream.add_argument("--checkpoint", required=True)
    stream.add_argument("--every", default=EVERY)
    stream.add_argument("--max-offsets", type=int, help="messages per landing batch at most")
    stream.add_argument("--min-partitions", type=int, help="split hot topic partitions")
    stream.add_argument("--max-bytes", default=str(64 * 1024**3), help="per published batch")
    stream.add_argument(
        "--starting-offsets",
        help="of a new checkpoint: earliest, latest or JSON; after a lost checkpoint, by default "
        "the offsets after the stored messages",
    )
    stream.add_argument("--first-landing", type=int, help="after a lost checkpoint")
    stream.add_argument("--first-batch", type=int, help="after a lost checkpoint")
    stream.add_argument(
        "--recheck-stored", action="store_true", help="drop copies of events stored before --first-batch"
    )
    stream.add_argument(
        "--state-partitions",
        type=int,
        required=True,
        help="fixed at the first start: about one per 8 GB of events to remember",
    )
    stream.add_argument(
        "--horizon-days", type=int, help="bound the state: older events are merged from storage"
    )

    stream.add_argument(
        "--renew-after", type=int, default=RENEW_AFTER, help="batches of a publishing checkpoint"
    )

    for name in ("daily", "funnel"):
        job = jobs.add_parser(name)
        job.add_argument("--date", help="YYYY-MM-DD, yesterday (UTC) by default")

    marts = jobs.add_parser("marts")
    marts.add_argument("--out", required=True)
    marts.add_argument("--date", action="append", help="rebuild only this day; repeatable")

    prune = jobs.add_parser("prune")
    prune.add_argument("--days", type=int, default=RETENTION_DAYS)
    check = jobs.add_parser("check")
    check.add_argument("--date", help="YYYY-MM-DD, all days by default")
    check.add_argument("--full", action="store_true", help="also days checked before")
    replay = jobs.add_parser("replay", help="land rejected messages again")
    replay.add_argument("--date", action="append", help="rejected on this day; repeatable")
    replay.add_argument("--horizon-days", type=int, help="as the stream has it")
    jobs.add_parser("rollup", help="bring month and all-time totals up to date")
    throughput = jobs.add_parser("throughput", help="count arrivals per window from Kafka")
    throughput.add_argument("--servers", required=True)
    throughput.add_argument("--checkpoint", required=True)
    throughput.add_argument("--every", default=EVERY)
    throughput.add_argument("--seconds", type=int, default=10)
    throughput.add_argument("--first-batch", type=int, help="after a lost checkpoint")
    jobs.add_parser("topics")
    jobs.add_parser("vacuum")
    compact = jobs.add_parser("compact", help="merge the files of days before a date")
    compact.add_argument("--date", help="YYYY-MM-DD, yesterday (UTC) by default")
    return parser


def run(spark: SparkSession, args: argparse.Namespace, now: dt.datetime) -> int | None:
    store = EventStore(spark, args.root)
    if args.job == "stream":
        land_at, publish_at = f"{args.checkpoint}/land", f"{args.checkpoint}/publish"
        starting = resume_offsets(
            args.starting_offsets, store.next_offsets(), table_exists(spark, f"{land_at}/offsets")
        )
        options = kafka_options(
            args.servers,
            starting,
            max_offsets_per_trigger=args.max_offsets,
            min_partitions=args.min_partitions,
        )
        messages = read_event_stream(spark, options)
        horizon = None if args.horizon_days is None else dt.timedelta(days=args.horizon_days)
        start_landing(messages, store, land_at, args.every, args.first_landing, horizon)

        def publish(first_batch: int | None = None, recheck_stored: bool = False):
            return start_renewed(
                store,
                publish_at,
                args.every,
                horizon,
                args.renew_after,
                first_batch=first_batch,
                recheck_stored=recheck_stored,
                source_options={"maxBytesPerTrigger": args.max_bytes},
                state_partitions=args.state_partitions,
            )

        publishing = publish(args.first_batch, args.recheck_stored)
        while not spark.streams.awaitAnyTermination(CLEAN_EVERY_SECONDS):
            refuse_drops(publishing)
            clean_landing(store, publishing)
            progress = publishing.lastProgress
            if progress is not None and progress.batchId + 1 >= args.renew_after:
                publishing.stop()
                spark.streams.resetTerminated()
                publishing = publish()
        return None

    if args.job == "throughput":
        messages = read_event_stream(spark, kafka_options(args.servers, "earliest"))
        start_throughput(
            messages,
            WindowTable(spark, f"{args.root}/windows"),
            args.checkpoint,
            args.every,
            args.seconds,
            args.first_batch,
        ).awaitTermination()
        return None

    def work() -> int | None:
        if args.job == "replay":
            horizon = None if args.horizon_days is None else dt.timedelta(days=args.horizon_days)
            taken, still = store.replay_rejected(None, args.day, horizon, now)
            log.info("%d messages replayed, %d of them rejected again", taken, still)
            return taken - still
        require_table(spark, store.raw_path)
        if args.job == "daily":
            return run_daily(store, args.day, now)
        if args.job == "funnel":
            store.upsert_funnel_day(args.day, now, default_cutoff(now).date())
        elif args.job == "marts":
            build_marts(spark, store.raw_events(days=args.day), args.out, args.day)
        elif args.job == "prune":
            oldest = default_cutoff(now, args.days).date()
            return store.prune(oldest) + store.prune_rejected(oldest)
        elif args.job == "check":
            return run_checks(store, args.day, args.full)
        elif args.job == "rollup":
            return store.roll_up()
        elif args.job == "topics":
            store.record_topic_stats(now)
        elif args.job == "vacuum":
            return store.vacuum()
        elif args.job == "compact":
            return store.compact_files(args.day)
        return None

    return recorded(store, args.job, now, work)


def main(argv: Sequence[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    parser = _parser()
    args = parser.parse_args(argv)
    now = utc_now()
    # A bad date ends the job before a session starts.
    try:
        if args.job in ("daily", "funnel", "compact"):
            args.day = parse_day(args.date, now)
        elif args.job == "check":
            args.day = parse_day(args.date) if args.date else None
        elif args.job in ("marts", "replay"):
            args.day = [parse_day(d) for d in args.date] if args.date else None
    except ValueError as error:
        parser.error(str(error))
    failures = run(build_session(f"clickfold-{args.job}"), args, now)
    return 1 if args.job == "check" and failures else 0
