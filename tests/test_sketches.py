"""Stored sketches against exact quantiles: the rank error stays below the stated bound, however days are merged."""

from __future__ import annotations

import numpy as np
import pytest

from siftwell.operators import sketches

SHARES = {"low": 0.0, "p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(4)
    n = 60_000
    values = np.concatenate([rng.lognormal(5, 1, n // 2), np.sort(rng.integers(0, 50, n // 2)).astype(float)])
    rows = [(int(k % 10), "hot" if k % 10 else "cold", float(v)) for k, v in enumerate(values)] + [(3, "hot", None), (3, "hot", float("nan")), (4, None, 7.0)]
    df = spark.createDataFrame(rows, "d int, kind string, ms double")
    return df.selectExpr("timestamp_ntz'2024-03-01 05:00:00' + make_interval(0, 0, 0, d) AS ts", "kind", "ms").repartition(7).cache()


@pytest.mark.parametrize(("since", "until"), [(None, None), ("2024-03-03", "2024-03-07"), ("2024-03-05", "2024-03-05")])
@pytest.mark.parametrize("k", [200, 1000])
def test_rank_error_is_below_the_bound(spark, log, tmp_path, k, since, until):
    path = f"file://{tmp_path}/sketches"
    half = "pmod(hash(ms), 2) = "
    for part in (0, 1):  # a day's rows arrive in two parts
        sketches.append(sketches.daily(log.filter(half + str(part)), "ms", "kind", k=k), path)
    got = {r["by"]: r for r in sketches.quantiles(sketches.read(spark, path), SHARES, since, until).collect()}
    rows = log.filter("ms is not null and not isnan(ms)").selectExpr("cast(ts as date) AS day", "kind", "ms")
    rows = rows.filter(f"day >= '{since or '2000-01-01'}' and day <= '{until or '2100-01-01'}'").toPandas()
    assert set(got) == set(rows["kind"].unique())
    for kind, own in rows.groupby("kind", dropna=False)["ms"]:
        values, found = np.sort(own.to_numpy()), got[None if kind != kind else kind]
        assert found["n"] == len(values) and found["low"] == values[0] and found["high"] == values[-1]
        for name, p in SHARES.items():
            low, high = (np.searchsorted(values, found[name], side) / len(values) for side in ("left", "right"))
            assert low - sketches.rank_error(k) <= p <= high + sketches.rank_error(k) and found[name] in values
    whole = sketches.quantiles(sketches.read(spark, path), {"median": 0.5}, since, until, grouped=False).collect()
    assert len(whole) == 1 and whole[0]["n"] == len(rows)


def test_no_rows(log):
    none = sketches.daily(log.limit(0), "ms")
    assert sketches.quantiles(none, SHARES).count() == 0
