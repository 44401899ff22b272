import datetime as dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from clickfold.operators.funnels import funnel_day
from clickfold.operators.merging import merge_add, merge_replace, upsert_funnel
from clickfold.operators.products import product_metrics
from clickfold.schemas import PRODUCT_METRICS
from tests.rows import T0, event, events_df

TYPES = ("VIEW", "CLICK", "PURCHASE", "OTHER")


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


rows_strategy = st.lists(
    st.tuples(
        st.sampled_from(TYPES),
        st.sampled_from(["p1", "p2", None]),
        st.integers(0, 2),
        st.sampled_from(["1.10", "2.25", None]),
        st.booleans(),
    ),
    max_size=30,
)


@settings(max_examples=6, deadline=None)
@given(rows_strategy)
def test_adding_parts_equals_the_whole(spark, drawn):
    rows, halves = [], ([], [])
    for i, (kind, product, day, price, second) in enumerate(drawn):
        row = event(str(i), kind, at=T0 + dt.timedelta(days=day), product=product, price=price)
        rows.append(row)
        halves[second].append(row)
    whole = product_metrics(events_df(spark, rows))
    first, second = (product_metrics(events_df(spark, half)) for half in halves)
    assert ordered(merge_add(first, second)) == ordered(whole)
    assert ordered(merge_add(second, first)) == ordered(whole)


def test_replace_is_idempotent_and_keeps_other_keys(spark):
    day2 = T0 + dt.timedelta(days=1)
    stale = product_metrics(
        events_df(spark, [event("a", product=None), event("b"), event("c", at=day2)])
    )
    fresh = product_metrics(
        events_df(spark, [event("a", product=None), event("d", "CLICK", product=None)])
    )
    once = merge_replace(stale, fresh)
    assert once.columns == PRODUCT_METRICS.names
    found = {(r.metric_date, r.product_id): (r.total_views, r.total_clicks) for r in once.collect()}
    assert found == {
        (T0.date(), None): (1, 1),
        (T0.date(), "p1"): (1, 0),
        (day2.date(), "p1"): (1, 0),
    }
    assert ordered(merge_replace(once, fresh)) == ordered(once)


def test_add_recomputes_rates_from_sums(spark):
    views = product_metrics(events_df(spark, [event(str(i)) for i in range(3)]))
    click = product_metrics(events_df(spark, [event("c", "CLICK")]))
    row = merge_add(views, click).first()
    assert row.click_through_rate == Decimal("0.3333")


def test_add_takes_the_newest_name(spark):
    later = T0 + dt.timedelta(hours=2)
    new = product_metrics(events_df(spark, [event("a", product_name="new", at=later)]))
    old = product_metrics(events_df(spark, [event("b", product_name="old")]))
    for merged in (merge_add(old, new), merge_add(new, old)):
        assert merged.first().product_name == "new" and merged.count() == 1


def test_upsert_funnel(spark):
    day, other = T0.date(), T0.date() + dt.timedelta(days=1)
    stale = funnel_day(events_df(spark, [event("a")]), day, T0)
    events = events_df(spark, [event("a"), event("b", "CLICK")])
    table = upsert_funnel(stale, funnel_day(events, other, T0))
    assert table.count() == 2
    table = upsert_funnel(table, funnel_day(events, day, T0))
    found = {r.metric_date: (r.total_views, r.total_clicks) for r in table.collect()}
    assert found == {day: (1, 1), other: (0, 0)}
