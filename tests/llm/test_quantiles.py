import math

import numpy as np
import pytest

from kvlake.llm import quantiles as q


@pytest.mark.parametrize(("k", "fan", "n"), [(16, 4, 20_000), (64, 8, 60_000), (4096, 8, 200_000), (8, 2, 1000)])
def test_rank_errors_stay_below_the_stated_bound(k, fan, n):
    r = np.random.default_rng(k)
    x = np.round(r.lognormal(size=n), 1)
    parts = [q.Sketch(k, fan) for _ in range(5)]
    for i, p in enumerate(np.array_split(x, 37)):
        parts[i % 5].add(p)
    total = q.Sketch(k, fan)
    for p in parts:
        total.merge(q.Sketch.of(*p.state().values(), k=k, fan=fan))
    s = np.sort(x)
    assert total.n == n
    for share in (0.001, 0.5, 0.95, 0.99, 1.0):
        v, rank = total.quantiles([share])[0], math.ceil(round(share * n, 6))
        assert np.searchsorted(s, v, "left") + 1 - rank <= total.err and rank - np.searchsorted(s, v, "right") <= total.err


def test_rows(spark):
    nan = float("nan")
    rows = [(1, "a", [3.0, None, 1.0], [nan]), (1, "a", [3.0, None, 1.0], [nan]), (2, "a", [], None), (3, None, [2.0], [5.0, 5.0]), (None, "a", [9.0], []), (None, "a", [9.0], [])]
    df = spark.createDataFrame(rows, "id int, g string, x array<double>, y array<double>")
    s = q.sketch_columns(q.first_delivery(df, "id", ["g"]), ["g"], ["x", "y"])
    got = {(r.g, r.metric): (r.n, r.p50, r.max_rank_error) for r in q.read_quantiles(q.merge_sketches(s, ["g", "metric"]), ["g", "metric"], {"p50": 0.5}).collect()}
    assert got == {("a", "x"): (4, 3.0, 0.0), (None, "x"): (1, 2.0, 0.0), (None, "y"): (2, 5.0, 0.0)}
    assert q.merge_sketches(q.sketch_columns(df.limit(0), ["g"], ["x"]), ["g", "metric"]).count() == 0


def test_first_delivery_keeps_one_row_of_each_id(spark):
    rows = [(i % 700 if i % 3 else 7, i % 11, [float(i)]) for i in range(3000)] + [(None, 1, [0.5]), (None, 1, [0.5])]
    got = q.first_delivery(spark.createDataFrame(rows, "id int, at int, x array<double>").repartition(5), "id", ["at", "x"]).collect()
    want = {}
    for i, at, x in rows[:-2]:
        want[i] = min(want.get(i, (at, x)), (at, x))
    assert {r.id: (r.at, r.x) for r in got if r.id is not None} == want and len(got) == len(want) + 2


def test_merging_over_many_branches(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=40_000)
    df = spark.createDataFrame([("a" if i % 3 else None, x[i : i + 100].tolist()) for i in range(0, len(x), 100)], "g string, x array<double>").repartition(40)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")  # two rounds of branches, then one
        s = q.merge_sketches(q.sketch_columns(df, ["g"], ["x"], 32, 4), ["g", "metric"], 32, 4, fan_in=4)
        got = {row.g: row for row in q.read_quantiles(s, ["g", "metric"], {"p50": 0.5}, 32, 4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for g, own in (("a", [i for i in range(0, len(x), 100) if i % 3]), (None, [i for i in range(0, len(x), 100) if not i % 3])):
        v = np.sort(np.concatenate([x[i : i + 100] for i in own]))
        rank = -(-len(v) // 2)
        assert got[g].n == len(v) and 0 < got[g].max_rank_error < 0.2
        assert abs(np.searchsorted(v, got[g].p50) + 1 - rank) <= got[g].max_rank_error * len(v)
