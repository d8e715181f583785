"""The indicators over every bar, against plain loops over a small table of orders."""

import datetime as dt
import random

import pytest

from marlstone.plans import market

@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Two symbols of 300 days; only the events' nations are taken from the given table."""
    rng = random.Random(3)
    rows = [(2 * d + s, name, dt.datetime(1997, 12, 1) + dt.timedelta(days=d), round(rng.uniform(900, 1100), 2)) for d in range(300) for s, name in enumerate(("1-URGENT", "5-LOW"))]
    at = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").coalesce(1).write.parquet(f"{at}/nation.parquet")
    return at, rows


def test_averages_begin_at_the_first_bar(spark, orders):
    at, rows = orders
    for symbol in ("1-URGENT", "5-LOW"):
        close = [p for _, s, _, p in rows if s == symbol]
        fast = slow = close[0]
        dea = None
        want = []
        for x in close:
            fast, slow = fast * 11 / 13 + x * 2 / 13, slow * 25 / 27 + x * 2 / 27
            dea = fast - slow if dea is None else dea * 0.8 + (fast - slow) * 0.2
            want.append((fast - slow, dea))
        got = market.macd(spark, at).where(f"symbol = '{symbol}'").orderBy("date").collect()
        assert len(got) == 300
        assert all(abs(r.dif - f) < 1e-3 and abs(r.dea - d) < 1e-3 for r, (f, d) in zip(got, want, strict=True))


def test_events_have_bars_before_them(spark, orders):
    at, _ = orders
    got = {r.event_id: r for r in market.event_windows(spark, at).collect()}
    assert got[0].n_bars == 21 and got[0].before_pct is not None
