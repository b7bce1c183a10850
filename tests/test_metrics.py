"""PromQL and MetricsQL over a few series whose answers can be seen by eye."""

import math

import pytest

from tellurion.errors import LimitError, QueryError, UnsupportedError
from tellurion.metrics import Metrics


@pytest.fixture(scope="module")
def metrics(spark):
    rows = []

    def add(name, labels, values, every=10_000):
        rows.extend((name, labels, i * every, float(v)) for i, v in enumerate(values) if v is not None)

    add("load", {"host": "a", "zone": "e"}, [1, 2, 3, 4, 5, 6, 7])
    add("load", {"host": "b", "zone": "w"}, [8, None, 10, 10, 9, 9, 12])
    add("limit", {"host": "a"}, [10] * 7)
    add("limit", {"host": "b"}, [20] * 7)
    add("hits_total", {"host": "a"}, [0, 10, 20, 5, 15, 25, 35])
    add("lat_bucket", {"le": "1"}, [2] * 7)
    add("lat_bucket", {"le": "2"}, [6] * 7)
    add("lat_bucket", {"le": "+Inf"}, [8] * 7)
    add("big", {"i": "1"}, [1e16]), add("big", {"i": "2"}, [1]), add("big", {"i": "3"}, [-1e16])
    return Metrics(spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double"), compensated=True)


A, B = (("host", "a"),), (("host", "b"),)
CASES = [
    ("load", {(("__name__", "load"), ("host", "a"), ("zone", "e")): 7, (("__name__", "load"), ("host", "b"), ("zone", "w")): 12}),
    ('sum by (zone) (load{host=~"a|b"})', {(("zone", "e"),): 7, (("zone", "w"),): 12}),
    ("load / on(host) limit", {A: 0.7, B: 0.6}),
    ("load * on(host) group_left limit > 100", {(("host", "b"), ("zone", "w")): 240}),
    ("increase(hits_total[60s])", {A: 45 * 60 / 50}),
    ("irate(hits_total[60s])", {A: 1}),
    ("resets(hits_total[60s])", {A: 1}),
    ("changes(load{host='a'}[30s])", {(("host", "a"), ("zone", "e")): 2}),
    ("deriv(load{host='a'}[60s])", {(("host", "a"), ("zone", "e")): 0.1}),
    ("predict_linear(load{host='a'}[60s], 10)", {(("host", "a"), ("zone", "e")): 8}),
    ("quantile_over_time(0.5, load{host='a'}[30s])", {(("host", "a"), ("zone", "e")): 6}),
    ("max_over_time(load{host='a'}[60s:20s] offset 10s)", {(("host", "a"), ("zone", "e")): 5}),
    ("histogram_quantile(0.5, lat_bucket)", {(): 1.5}),
    ("histogram_fraction(1, 2, lat_bucket)", {(): 0.5}),
    ("topk(1, load)", {(("__name__", "load"), ("host", "b"), ("zone", "w")): 12}),
    ("avg(big)", {(): 1 / 3}),
    ("absent(nothing{a='b'})", {(("a", "b"),): 1}),
    ("1 / 0 > bool 5", {(): 1}),
    ("vector(-1) % 0", {(): math.nan}),
    ("clamp_max(load{host='b'}, 11)", {(("host", "b"), ("zone", "w")): 11}),
    ("day_of_week(vector(0)) + year(vector(0))", {(): 1974}),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0] for c in CASES])
def test_at_one_time(metrics, text, want):
    found = {tuple(sorted(r.labels.items())): r.v for r in metrics.query(text, 60_000).collect()}
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, nan_ok=True), k


def test_a_range_by_both_kernels(metrics):
    """A window of many steps goes through the frame kernel, one of few through the exploding one."""
    for width, step in ((30, 10), (60, 5)):
        text = f"sum_over_time(load{{host='a'}}[{width}s])"
        found = {r.t: r.v for r in metrics.query_range(text, 0, 60_000, step * 1000).collect()}
        assert found == {t: sum(x for i, x in enumerate(range(1, 8)) if t - width * 1000 < i * 10_000 <= t) for t in range(0, 60_001, step * 1000)}


def test_metricsql(metrics):
    run = lambda text: {(tuple(sorted(r.labels.items())), r.t): r.v for r in metrics.metricsql_range(text, 0, 60_000, 20_000).collect()}
    assert run("(load{host='a'} > 4) default 0")[(("__name__", "load"), *A, ("zone", "e")), 0] == 0
    assert set(run("running_sum(sum(limit))").values()) == {30, 60, 90, 120}
    assert set(run("range_max(load{host='a'})").values()) == {7}
    assert run("rate(hits_total)")[A, 60_000] == pytest.approx(1.0)


@pytest.mark.parametrize("text", ["first_over_time(load[1m])", "limitk(1, load)", "start()", "load[5i]", "sort_by_label(load)", "info(load)"])
def test_what_is_rejected(metrics, text):
    with pytest.raises(UnsupportedError):
        metrics.query(text, 0)


@pytest.mark.parametrize("text", ["", "load{", "{a=''}", "sum(load[5m])", "rate(load)", "load == load2 ==", "1 > 2", "nope(load)", "load[5m][5m]"])
def test_what_is_malformed(metrics, text):
    with pytest.raises(QueryError):
        metrics.query(text, 0)


def test_limits_and_annotations(metrics):
    with pytest.raises(LimitError):
        metrics.query_range("load", 0, 10**9, 1)
    metrics.query("rate(load[1m])", 60_000)
    assert "counter" in metrics.annotations[0]
    with pytest.raises(Exception, match="many-to-many|many-to-one|duplicate"):
        metrics.query("limit / ignoring(host) limit", 60_000).collect()
