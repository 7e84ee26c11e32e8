"""Moving averages of groups that lie in many ranges."""

import random

import pytest

from orthomill.functions import series
from orthomill.plans import catalogue


def test_ema_of_a_large_user_equals_the_fold(spark):
    rng = random.Random(4)
    rows = [(None if i % 50 == 0 else 1 if i % 3 else i % 7, rng.randrange(500), i, rng.uniform(-9, 9)) for i in range(4000)] + [(90, 5, 1, 2.5), (91, 1, 1, 3.0), (91, 2, 2, None), (91, 3, 3, 4.0), (92, None, 1, 1.0), (92, 3, 2, 5.0)]
    rng.shuffle(rows)
    want = {}
    for u, _, _, x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        n, a = want.get(u, (0, x))
        want[u] = (n + 1, None if a is None or x is None else x if n == 0 else 0.6 * a + 0.4 * x)
    events = spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double")
    got = {r.user_id: (r.n, r.last) for r in series.ema_last(events, "user_id", ["ts", "event_id"], "value", 0.6).collect()}
    assert got.keys() == want.keys()
    for u, (n, last) in want.items():
        assert got[u] == (n, None if last is None else pytest.approx(last, abs=1e-9))


def test_ema_gathers_no_group_in_one_row(spark, sf):
    plan = catalogue.QUERIES["ema_smooth"](spark, sf)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "RepartitionByExpression" in plan
