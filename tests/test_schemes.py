import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.functions import vectors as V
from kvlake.operators import attention, schemes

SCHEMA = "doc_id string, layer int, head int, token int, k array<float>, v array<float>"


def table(spark, dim=64, tokens=20, heads=2, seed=0, docs=2):
    r = np.random.default_rng(seed)
    rows = [(f"d{d}", 0, h, t, r.normal(size=dim).astype("float32").tolist(), r.normal(size=dim).astype("float32").tolist()) for d in range(docs) for h in range(heads) for t in range(tokens)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rotation_keeps_products_and_comes_back():
    r = np.random.default_rng(1)
    x, y, heads = r.normal(size=(30, 128)), r.normal(size=(30, 128)), np.arange(30)
    assert np.allclose((schemes.rotate(x, heads) * schemes.rotate(y, heads)).sum(1), (x * y).sum(1))
    assert np.allclose(schemes.unrotate(schemes.rotate(x, heads), heads), x)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_packed_bits_come_back(bits):
    codes = np.random.default_rng(2).integers(0, 1 << bits, (50, 64)).astype(np.uint8)
    assert (schemes.unpack_bits(schemes.pack_bits(codes, bits), bits, 64) == codes).all()


def test_zero_and_one_vectors():
    zero, head = np.zeros((1, 64)), np.zeros(1, np.int64)
    want = {"prod4": 0xBB, "mse4": 0x77, "sign1": 0xFF, "absmax4": 0x00}
    for name, byte in want.items():
        s = schemes.SCHEMES[name]
        p = s.pack(zero, zero, head)
        assert set(p["k_codes"].ravel().tolist()) == {byte} and p["k_scale"][0] == 0
        assert not s.turn_back(s.keys(p, 64), head).any() and not s.turn_back(s.values(p, 64), head).any()
    ones = np.ones((1, 64))
    n = schemes.unpack_bits(schemes.SCHEMES["prod4"].pack(ones, ones, head)["k_codes"], 4, 64)[0] & 7
    assert n[1] == 7 and set(np.delete(n, 1)) == {3}
    c = schemes.unpack_bits(schemes.SCHEMES["mse4"].pack(ones, ones, head)["k_codes"], 4, 64)[0]
    assert c[1] == 15 and set(np.delete(c, 1)) == {7}


@pytest.mark.parametrize(("name", "most"), [("dense16", 1e-6), ("absmax4", 0.021), ("mse4", 0.015), ("prod4", 0.019), ("sign1", 0.62)])
def test_relative_error_of_normal_vectors(spark, name, most):
    from kvlake.plans.pipeline import roundtrip

    got = {r["part"]: r["rel_mse"] for r in roundtrip(table(spark, 128, 40), name, 128).collect()}
    assert got["k"] < most and got["v"] < 0.021


@pytest.mark.parametrize("name", list(schemes.SCHEMES))
def test_attention_on_codes_is_attention_on_restored_vectors(spark, name):
    cache = table(spark, 32, 18, seed=3)
    queries = cache.filter("token = 1").select(F.concat("doc_id", F.lit("q")).alias("q_id"), "doc_id", "layer", "head", F.col("v").alias("q"))
    packed = schemes.pack(cache, name, 32)
    got = {(r.doc_id, r.head): np.array(r.out) for r in attention.packed_attention(queries, packed, name, 32).collect()}
    rows = schemes.restore(packed, name, 32).toPandas()
    for q in queries.collect():
        own = rows[(rows.doc_id == q.doc_id) & (rows["head"] == q.head)]
        k, v = np.stack(own.k), np.stack(own.v)
        s = k @ np.array(q.q, np.float16).astype(float) / (1 if name == "sign1" else 32**0.5)
        w = np.exp(s - s.max())
        assert np.abs(got[q.doc_id, q.head] - (w[:, None] * v).sum(0) / w.sum()).max() < 5e-3
    assert len(got) == 4


def test_odd_inputs(spark):
    with pytest.raises(ValueError):
        schemes.pack(table(spark), "unheard", 64)
    with pytest.raises(ValueError):
        schemes.pack(table(spark), "mse4", 96)
    rows = spark.createDataFrame([("a", 0, 0, 0, None, [1.0] * 64), ("b", 0, 0, 0, [1.0] * 64, [0.5] * 64)], SCHEMA)
    assert [r.doc_id for r in schemes.pack(rows, "mse4", 64).collect()] == ["b"]
    assert schemes.pack(rows.limit(0), "prod4", 64).count() == 0
    with pytest.raises(Exception, match="must have"):
        schemes.pack(spark.createDataFrame([("a", 0, 0, 0, [1.0], [1.0])], SCHEMA), "mse4", 64).collect()
    extra = rows.withColumn("k_codes", F.lit("mine")).withColumn("note", F.lit(1))
    assert schemes.restore(schemes.pack(extra, "mse4", 64), "mse4", 64).columns == ["doc_id", "layer", "head", "token", "note", "k", "v"]


def test_half_precision_column(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=3000) * np.exp(r.uniform(-20, 8, 3000)), [65519.0, 65520.0, -1e9, 0.0, 6e-8, 2.9e-8]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", V.f16(F.col("x")).alias("y")).collect()
    with np.errstate(over="ignore"):
        assert all(g.y == float(np.float16(g.x)) for g in got)


def test_group_heads(spark):
    q = spark.createDataFrame([(h,) for h in range(8)], "head int")
    assert sorted(r.head for r in attention.select_group_heads(q, 8, 2).collect()) == [0, 1]
    with pytest.raises(ValueError):
        attention.select_group_heads(q, 8, 3)


def test_attention_over_many_small_batches(spark):
    rng = np.random.default_rng(5)
    vec = lambda: rng.normal(size=8).astype("float32").tolist()
    docs = ["hot"] * 90 + [f"d{i}" for i in range(40)]
    rows = [(d, 0, 0, i, vec(), vec(), i) for i, d in enumerate(docs)] + [("hot", 0, 0, 999, None, vec(), 1), ("d1", 0, 0, 999, vec(), None, 1)]
    cache = spark.createDataFrame(rows, "doc_id string, layer int, head int, token int, k array<float>, v array<float>, q int").repartition(5)
    asked = [(f"q{i}", d, 0, 0, vec()) for i, d in enumerate([*sorted(set(docs)), "hot", "none"])] + [("null", "hot", 0, 0, None)]
    queries = spark.createDataFrame(asked, "q_id string, doc_id string, layer int, head int, q array<float>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        plain = {r.q_id: np.array(r.out) for r in attention.plain_attention(queries, cache, 8).collect()}
        dense = {r.q_id: np.array(r.out) for r in attention.packed_attention(queries, schemes.pack(cache, "dense16", 8), "dense16", 8).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    half = lambda x: np.array(x, np.float16).astype(float)
    for q_id, doc, _, _, q in asked[:-2]:
        own = [r for r in rows if r[0] == doc and r[4] and r[5]]
        s = np.stack([half(r[4]) for r in own]) @ half(q) / 8**0.5
        w = np.exp(s - s.max())
        want = (w[:, None] * np.stack([half(r[5]) for r in own])).sum(0) / w.sum()
        assert np.abs(plain[q_id] - want).max() < 1e-9 and np.abs(dense[q_id] - want).max() < 2e-3
    assert set(plain) == set(dense) == {a[0] for a in asked[:-2]}
    assert attention.plain_attention(queries.limit(0), cache, 8).count() == 0 == attention.packed_attention(queries, schemes.pack(cache.limit(0), "mse4", 8), "mse4", 8).count()
    errors = attention.attention_error(queries, cache, {"dense16": schemes.pack(cache, "dense16", 8)}, 8, ("doc_id",))
    assert errors.count() == 41 and errors.filter("mse > 1e-6").count() == 0
