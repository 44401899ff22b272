import datetime as dt
from decimal import Decimal

import pytest

from clickfold.functions.clock import parse_day
from clickfold.operators.audit import run_summary
from clickfold.operators.products import product_metrics_daily
from clickfold.operators.funnels import funnel_analysis
from clickfold.operators.staging import stage
from clickfold.plans import jobs
from clickfold.plans.marts import FUNNEL_MART, PRODUCT_MART, build_marts, read_mart
from clickfold.schemas import JOB_RUNS, RAW_EVENTS
from clickfold.streaming.store import EventStore
from tests.rows import T0, event, events_df, many

NOW = T0 + dt.timedelta(days=1)
DAY = T0.date()


@pytest.fixture
def store(spark, root):
    store = EventStore(spark, root)
    rows = [*many("v", "VIEW", 8), event("p", "PURCHASE", price="7.25"), event("x", "OTHER")]
    rows += many("w", "VIEW", 2, at=T0 + dt.timedelta(days=1), product="p2")
    store.publish_batch(events_df(spark, rows), 0)
    return store


def run(spark, store, *argv, now=NOW):
    args = jobs._parser().parse_args(["--root", store.root, *argv])
    dated = args.job in ("daily", "funnel") or getattr(args, "date", None)
    args.day = parse_day(args.date, now) if dated else None
    return jobs.run(spark, args, now)


def last_run(store):
    return store.job_runs().filter("dag_id <> 'publish'").orderBy("finished_at").collect()[-1]


def test_daily_job(spark, store):
    before = store.product_metrics().collect()
    # Yesterday by default.
    assert run(spark, store, "daily") == 10
    assert sorted(store.product_metrics().collect()) == sorted(before)
    row = last_run(store)
    assert (row.dag_id, row.status, row.records_processed) == ("daily", "success", 10)
    assert run(spark, store, "daily", "--date", "2026-02-20") == 0


def test_failed_job_is_recorded(spark, store):
    with pytest.raises(ValueError):
        run(spark, store, "daily", "--date", "2020-01-01")
    row = last_run(store)
    assert row.status == "failed" and "oldest day" in row.error_message
    empty = EventStore(spark, store.root + "-none")
    with pytest.raises(FileNotFoundError):
        run(spark, empty, "check")


def test_funnel_prune_check_topics(spark, store):
    run(spark, store, "funnel", "--date", str(DAY))
    row = store.funnel_metrics().first()
    assert (row.metric_date, row.total_views, row.total_purchases) == (DAY, 8, 1)
    assert row.overall_conversion_pct == Decimal("12.50") and row.updated_at == NOW
    assert run(spark, store, "check") == 0
    # Events were published here without any message having landed.
    run(spark, store, "topics")
    assert store.topic_history().isEmpty()
    # A day goes when it is more than the kept number of days ago.
    assert run(spark, store, "prune", now=NOW + dt.timedelta(days=89)) == 0
    assert run(spark, store, "prune", now=NOW + dt.timedelta(days=90)) == 10
    assert store.raw_events().count() == 2


def test_check_job_counts_copies(spark, store):
    store.publish_batch(events_df(spark, [event("v0")]), 1)
    assert run(spark, store, "check") == 1
    assert run(spark, store, "check", "--date", str(DAY)) == 1
    assert run(spark, store, "check", "--date", str(NOW.date())) == 0


def test_marts(spark, store, tmp_path):
    out = str(tmp_path / "marts")
    run(spark, store, "marts", "--out", out)
    staged = stage(store.raw_events())
    for name, expected in (
        (PRODUCT_MART, product_metrics_daily(staged)),
        (FUNNEL_MART, funnel_analysis(staged)),
    ):
        mart = read_mart(spark, out, name).select(expected.columns)
        assert sorted(mart.collect()) == sorted(expected.collect())
    assert spark.table("stg_events").count() == 12


def test_marts_of_one_day_leave_other_days(spark, store, tmp_path):
    out = str(tmp_path / "marts")
    build_marts(spark, store.raw_events(), out)
    more = events_df(spark, many("z", "VIEW", 5, at=T0 + dt.timedelta(days=1), product="p2"))
    raw = store.raw_events().select(RAW_EVENTS.names)
    build_marts(spark, more.unionByName(raw), out, [DAY + dt.timedelta(days=1)])
    views = {r.event_date: r.total_views for r in read_mart(spark, out, FUNNEL_MART).collect()}
    assert views == {DAY: 8, DAY + dt.timedelta(days=1): 7}


def test_vacuum_job(spark, store):
    assert run(spark, store, "vacuum") == 0
    run(spark, store, "daily")
    before = sorted(store.product_metrics().collect())
    assert run(spark, store, "vacuum") == 1
    assert sorted(store.product_metrics().collect()) == before


def test_bad_date_ends_the_job_before_a_session(monkeypatch, capsys):
    monkeypatch.setattr(jobs, "build_session", lambda name: pytest.fail("session started"))
    with pytest.raises(SystemExit):
        jobs.main(["--root", "/none", "daily", "--date", "01.03.2026"])
    assert "YYYY-MM-DD" in capsys.readouterr().err


def test_parse_day():
    assert parse_day("2026-07-01") == dt.date(2026, 7, 1)
    assert parse_day(None, dt.datetime(2026, 3, 1, 0, 30)) == dt.date(2026, 2, 28)
    for text in ("2026-13-01", "2026/01/01", ""):
        with pytest.raises(ValueError):
            parse_day(text)


def test_run_summary(spark):
    at = dt.datetime(2026, 3, 1)
    # Fixed sample: (job, status, seconds, records, error)
    sample = [
        ("ingest", "success", 252, 82450, None),
        ("ingest", "success", 238, 91200, None),
        ("ingest", "failed", 65, 0, "no broker"),
        ("transform", "success", 813, 82450, None),
        ("transform", "success", None, None, None),
    ]
    rows = [
        (str(i), job, status, at, at + dt.timedelta(seconds=s) if s else None, n, error, None)
        for i, (job, status, s, n, error) in enumerate(sample)
    ]
    summary = run_summary(spark.createDataFrame(rows, JOB_RUNS)).collect()
    assert {(r.dag_id, r.status): tuple(r)[2:] for r in summary} == {
        ("ingest", "success"): (2, 173650, 490, 252, 0),
        ("ingest", "failed"): (1, 0, 65, 65, 1),
        ("transform", "success"): (2, 82450, 813, 813, 0),
    }
