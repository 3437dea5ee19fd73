import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kvlake.operators import paging


def test_running_total_over_a_million_rows_with_a_carried_column(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select((F.xxhash64("id") % 1_000_003 * 1_000_003 + F.col("id")).alias("at"), (F.col("id") % 7).alias("n"), F.concat(F.lit("x"), "id").alias("carried"))
    got = paging.running_total(rows, "n", ["at"], "before")
    pdf = got.select("at", "n", "before", F.length("carried").alias("len")).toPandas().sort_values("at")
    assert len(pdf) == n and pdf["at"].is_unique
    assert np.array_equal(pdf["before"].to_numpy(), np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())[:-1]]))


def test_running_total_with_nulls_ties_and_several_keys(spark):
    rows = [(None, None, 5)] * 2 + [("a", float(i % 50), i % 3) for i in range(3000)] + [("b", None, None), ("b", float("nan"), 4), ("c", -1.5, 2)]
    df = spark.createDataFrame(rows, "k string, at double, n long").withColumn("extra", F.create_map(F.lit("x"), "n"))
    got = paging.running_total(df, "n", ["k", "at"], "before", parts=8).drop("extra").toPandas().sort_values("before")
    total = sum(r[2] or 0 for r in rows)
    assert len(got) == len(rows) and (got["before"] + got["n"].fillna(0)).max() == total
    for (k, at), own in got.groupby(["k", "at"], dropna=False):
        if k == "a":
            earlier = sum((r[2] or 0) for r in rows if r[0] is None or r[0] == "a" and r[1] < at)
            assert own["before"].min() == earlier
    assert paging.running_total(df.limit(0), "n", ["k"], "before").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_are_handed_out_once(spark, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"seq_id": rng.integers(0, 300, 60_000) * (rng.random(60_000) > 0.33), "order": rng.permutation(60_000), "n": rng.integers(0, 40, 60_000)})
    table = paging.block_table(spark.createDataFrame(pdf))
    blocks = paging.physical_blocks(table, ["order"])
    got = blocks.toPandas()
    assert sorted(got["physical"]) == list(range(len(got)))
    left, taken, want = {}, 0, {}
    for seq, n in pdf.sort_values("order")[["seq_id", "n"]].itertuples(index=False):
        length, held = left.get(seq, (0, 0))
        while held * paging.BLOCK < length + n:
            want[seq, held] = taken
            held, taken = held + 1, taken + 1
        left[seq] = (length + n, held)
    assert want == {(s, b): p for s, b, p in got[["seq_id", "logical", "physical"]].itertuples(index=False)}


def test_running_totals_of_groups_with_a_hot_one(spark):
    rng = np.random.default_rng(7)
    n = 40_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 500, n).astype(str)), "at": rng.permutation(n), "n": rng.integers(0, 9, n)})
    pdf.loc[:99, "g"] = None
    df = spark.createDataFrame([(None if g is None else str(g), int(a), int(v)) for g, a, v in pdf.itertuples(index=False)], "g string, at long, n long")
    got = paging.running_total(df, "n", ["at"], "before", parts=50, within=("g",)).toPandas().sort_values("at")
    want = pdf.sort_values("at").assign(k=lambda x: x["g"].fillna("null"))
    want["before"] = want.groupby("k")["n"].cumsum() - want["n"]
    assert len(got) == n and np.array_equal(got["before"].to_numpy(), want["before"].to_numpy())
