import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from clickfold.operators import funnels, products, serving
from clickfold.operators.measures import measure
from clickfold.operators.staging import of_type, on_day, stage
from tests.rows import T0, event, events_df, many, repeat

DAY = T0.date()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_stage_drops_unidentified_and_flags_types(spark):
    rows = [event("a"), event(None), event("b", "PURCHASE"), event("c", "SIGNUP")]
    staged = {r.event_id: r for r in stage(events_df(spark, rows)).collect()}
    assert set(staged) == {"a", "b", "c"}
    assert staged["b"].is_purchase == 1 and staged["b"].is_view == 0
    assert staged["c"].is_view + staged["c"].is_click + staged["c"].is_purchase == 0
    assert staged["a"].event_date == DAY and staged["a"].event_hour == 10


def test_midnight_belongs_to_the_day_it_starts(spark):
    midnight = dt.datetime.combine(DAY, dt.time())
    rows = [
        event("a", at=midnight),
        event("b", at=midnight - dt.timedelta(microseconds=1)),
        event("c", at=midnight + dt.timedelta(days=1)),
    ]
    assert [r.event_id for r in on_day(events_df(spark, rows), DAY).collect()] == ["a"]


def test_type_filter_all_means_none(spark):
    df = events_df(spark, [event("a"), event("b", "CLICK")])
    assert of_type(df).count() == 2
    assert of_type(df, "CLICK").count() == 1


def test_null_prices(spark):
    rows = [
        event("a", "PURCHASE", price=None, product="p1"),
        event("b", "PURCHASE", price=None, product="p2"),
        event("c", "PURCHASE", price="2.50", product="p2"),
        event("d", "VIEW", price="9.00", product="p3"),
    ]
    df = events_df(spark, rows)
    revenue = {r.product_id: r.total_revenue for r in measure(df, "product_id").collect()}
    assert revenue == {"p1": None, "p2": Decimal("2.50"), "p3": Decimal("0.00")}
    only_null = events_df(spark, rows[:1])
    assert one(serving.kpi_totals(only_null)).total_revenue == Decimal("0.00")


def test_renamed_product_takes_newest_name(spark):
    later = T0 + dt.timedelta(hours=1)
    rows = [
        event("a", product_name="old"),
        event("b", "CLICK", at=later, product_name="new"),
        event("c", "CLICK", product_name="old"),
    ]
    df = events_df(spark, rows)
    row = one(products.product_metrics(df))
    assert (row.product_name, row.total_views, row.total_clicks) == ("new", 1, 2)
    assert row.click_through_rate == Decimal("2.0000")
    assert row.updated_at == later
    # The mart keeps one row per name.
    assert products.product_metrics_daily(stage(df)).count() == 2


def test_null_product_is_one_key(spark):
    rows = [event("a", product=None), event("b", product=None), event("c")]
    metrics = products.product_metrics(events_df(spark, rows))
    assert {r.product_id: r.total_views for r in metrics.collect()} == {None: 2, "p1": 1}


def test_metrics_without_date(spark):
    rows = [event("a"), event("b", at=T0 + dt.timedelta(days=3))]
    row = one(products.product_metrics(events_df(spark, rows), by_date=False))
    assert row.total_views == 2 and "metric_date" not in row.asDict()


def test_funnel_counts_other_types_only_in_total(spark):
    rows = [*many("v", "VIEW", 160), *many("c", "CLICK", 23), event("x", "ERROR")]
    row = one(funnels.funnel_analysis(stage(events_df(spark, rows))))
    assert (row.total_events, row.total_views, row.total_clicks) == (184, 160, 23)
    assert row.view_to_click_rate == Decimal("14.38")
    assert row.click_to_purchase_rate == Decimal("0.00")


def test_very_large_rates_fit(spark):
    rows = [event("v"), event("c", "CLICK"), *many("p", "PURCHASE", 50)]
    row = one(funnels.funnel_analysis(stage(events_df(spark, rows))))
    assert row.click_to_purchase_rate == Decimal("5000.00")


def test_empty_day(spark):
    df = events_df(spark, [event("a")])
    other = DAY + dt.timedelta(days=1)
    row = one(funnels.funnel_day(df, other))
    assert (row.metric_date, row.total_views, row.overall_conversion_pct) == (other, 0, Decimal(0))
    assert products.product_metrics(on_day(df, other)).isEmpty()
    assert funnels.funnel_analysis(stage(on_day(df, other))).isEmpty()


def test_empty_table_serves_zeros_and_one_view(spark):
    empty = events_df(spark, [])
    assert tuple(one(serving.kpi_totals(empty))) == (0, 0, 0, 0, Decimal("0.00"))
    row = one(funnels.funnel_overall(empty))
    assert (row.views, row.clicks, row.view_to_click_rate) == (1, 0, Decimal("0.00"))
    assert one(serving.top_products_revenue(empty)).top_products_revenue == Decimal("0.00")


def test_serving_rates_without_views_or_clicks(spark):
    rows = [event("c", "CLICK"), event("d", "CLICK"), event("p", "PURCHASE", price="3")]
    df = events_df(spark, rows)
    assert one(serving.top_products(df)).ctr == Decimal("200.00")
    row = one(funnels.funnel_overall(events_df(spark, rows[2:])))
    assert row.click_to_purchase_rate == Decimal("100.00")


def test_top_products_rank_missing_revenue_first_as_zero(spark):
    rows = [
        event("a", "PURCHASE", price=None, product="p1"),
        event("b", "PURCHASE", price="5.00", product="p2"),
        event("c", product="p3"),
    ]
    df = events_df(spark, rows)
    top = serving.top_products(df).collect()
    assert [(r.name, r.revenue) for r in top] == [
        ("name p1", Decimal("0.00")),
        ("name p2", Decimal("5.00")),
        ("name p3", Decimal("0.00")),
    ]
    # The run log ranks them last.
    best = products.batch_top(products.product_metrics(df)).collect()
    assert [r.product_id for r in best] == ["p2", "p3", "p1"]


def test_rankings_merge_products_of_one_name(spark):
    rows = [
        event("a", "PURCHASE", product="p1", product_name="same", price="1.00"),
        event("b", "PURCHASE", product="p2", product_name="same", price="2.00"),
        event("c", "PURCHASE", product="p3", product_name="same", product_category="other"),
    ]
    top = serving.top_products(events_df(spark, rows)).collect()
    assert [(r.category, r.revenue) for r in top] == [
        ("other", Decimal("10.00")),
        ("cat", Decimal("3.00")),
    ]


def test_reports_agree_on_events_and_on_measures(spark):
    rows = [
        event(f"{t}{i}", t, product=f"p{i % 4}", at=T0 + dt.timedelta(hours=9 * i))
        for i in range(20)
        for t in ("VIEW", "CLICK", "PURCHASE", "OTHER")
        if (i + len(t)) % 3
    ]
    df = events_df(spark, rows)
    fine = measure(stage(df), "event_date", "product_id", "product_name", "product_category")
    for report in (
        serving.kpi_totals,
        serving.top_products,
        serving.top_products_revenue,
        serving.category_breakdown,
        funnels.funnel_overall,
    ):
        assert sorted(report(df).collect()) == sorted(report(fine).collect())
    assert sorted(funnels.funnel_analysis(stage(df)).collect()) == sorted(
        funnels.funnel_analysis(fine).collect()
    )


def test_events_per_sec_truncates(spark):
    as_of = T0 + dt.timedelta(seconds=10)
    rows = many("a", "VIEW", 29, at=T0) + many(
        "b", "VIEW", 5, at=T0 - dt.timedelta(microseconds=1)
    )
    assert one(serving.events_per_sec(events_df(spark, rows), as_of)).events_per_sec == 2


def test_latest_events(spark):
    rows = [event(f"e{i}", at=T0 + dt.timedelta(seconds=i // 2)) for i in range(8)]
    rows.append(event("free", "PURCHASE", price=None, at=T0 + dt.timedelta(days=1)))
    latest = serving.latest_events(events_df(spark, rows), 3).collect()
    assert [r.event_id for r in latest] == ["free", "e7", "e6"]
    assert latest[0].product_price == Decimal("0.00")
    assert latest[0].timestamp == "2026-03-02T10:00:00.000000Z"
    assert serving.latest_events(events_df(spark, rows), 3, "CLICK").isEmpty()


def test_report_orders(spark):
    rows = [
        event("a", "PURCHASE", price=None, product="p1"),
        event("b", "PURCHASE", price="5.00", product="p2"),
        event("c", at=T0 + dt.timedelta(days=1), product="p3"),
    ]
    staged = stage(events_df(spark, rows))
    mart = products.daily_report_order(products.product_metrics_daily(staged)).collect()
    assert [r.product_id for r in mart] == ["p3", "p1", "p2"]
    days = funnels.funnel_report_order(funnels.funnel_analysis(staged)).collect()
    assert [r.event_date for r in days] == [DAY + dt.timedelta(days=1), DAY]


def test_throughput_windows(spark):
    rows = [event("a"), event("b", "CLICK", at=T0 + dt.timedelta(seconds=9.999999))]
    rows.append(event("c", at=T0 + dt.timedelta(seconds=10)))
    windows = serving.throughput(events_df(spark, rows)).orderBy("window_start").collect()
    assert [(r.window_start, r.total_events, r.events_per_sec) for r in windows] == [
        (T0, 2, 0.2),
        (T0 + dt.timedelta(seconds=10), 1, 0.1),
    ]


def test_batch_summary(spark):
    rows = [*many("v", "VIEW", 8), event("p", "PURCHASE", price="7.25"), event("x", "ERROR")]
    row = one(products.batch_summary(products.product_metrics(events_df(spark, rows))))
    assert tuple(row) == (10, 8, 1, Decimal("7.25"), Decimal("12.50"))
    empty = products.batch_summary(products.product_metrics(events_df(spark, [])))
    assert tuple(one(empty)) == (0, 0, 0, Decimal("0.00"), Decimal("0.00"))


def test_revenue_is_exact_over_many_cents(spark):
    df = repeat(events_df(spark, [event("a", "PURCHASE", price="0.10")]), 30_000)
    assert one(measure(df)).total_revenue == Decimal("3000.00")
    assert one(df.select(F.sum("product_price").alias("s"))).s == Decimal("3000.00")
