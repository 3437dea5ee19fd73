import importlib


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_streamed_slots(spark, tmp_path):
    from kvlake.operators import paging
    from kvlake.streaming import slots

    rows = [(i % 3, i, i * 5 % 23) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id int, order long, n long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = slots.slot_stream(stream).writeStream.format("memory").queryName("slots").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, paging.block_table(df).collect()))
    assert sorted(map(tuple, spark.table("slots").collect())) == want


def test_core_does_not_need_the_optional_subpackage():
    for name in ("kvlake.plans.catalogue", "kvlake.plans.pipeline", "kvlake.sources.store", "kvlake.streaming.slots"):
        source = importlib.import_module(name).__file__
        assert "kvlake.llm" not in open(source).read()
