import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.plans import pipeline
from kvlake.sources import files, migrate
from kvlake.sources import store as st

SCHEMA = "doc_id string, layer int, head int, token int, k array<float>, v array<float>"


def test_scan_and_build(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    put = lambda name, raw: (tmp_path / "in" / name).write_bytes(raw)
    put("a.txt", "één tekst".encode())
    put("bad.TXT", b"caf\xe9 text")
    put("blank.txt", b"  \n")
    put("sub/note.md", b"# note")
    put("rows.jsonl", b'{"id": "r1", "text": "one"}\n\nnot json\n{"doc_id": 7, "content": "two"}\n{"id": 0, "text": "three"}\n{"id": "e", "text": ""}\n')
    put("broken.jsonl", b'[1, 2]\n{"id": "lost", "text": "lost"}\n')
    put("t.csv", 'id,text\n1,"first\nline"\n,second\n'.encode())
    put("x.exe", b"no")
    got = {r.base_id: r.text for r in files.scan(spark, str(tmp_path / "in"), ["txt", ".MD", "jsonl", "csv", "exe"]).collect()}
    assert got == {"a": "één tekst", "bad": "caf� text", "note": "# note", "r1": "one", "7": "two", "rows_4": "three", "1": "first\nline", "t_1": "second"}
    pipeline.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["txt", "csv"], size=1, overlap=0)
    rows = {r.id: r.text for r in files.read_corpus(spark, str(tmp_path / "out/corpus")).collect()}
    assert rows == {"a_c000": "één", "a_c001": "tekst", "bad_c000": "caf�", "bad_c001": "text", "1_c000": "first", "1_c001": "line", "t_1": "second"}
    assert spark.read.json(str(tmp_path / "out/build_manifest")).first()["num_docs"] == 7
    assert files.scan(spark, str(tmp_path / "in"), ["exe"]).count() == 0


def test_strict_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id": "a", "text": "1"}\n{"id": "a", "text": "2"}\n')
    assert [(r.id, r.text) for r in files.read_corpus(spark, str(tmp_path / "c.json")).collect()] == [("a", "2")]
    (tmp_path / "d.json").write_text('{"id": "a"}\n')
    with pytest.raises(Exception, match="no id or no text"):
        files.read_corpus(spark, str(tmp_path / "d.json")).collect()


def cache(spark, docs=("a", "b"), layers=2, tokens=5):
    r = np.random.default_rng(0)
    vec = lambda: r.normal(size=64).astype("float32").tolist()
    return spark.createDataFrame([(d, lay, h, t, vec(), vec()) for d in docs for lay in range(layers) for h in range(2) for t in range(tokens)], SCHEMA)


def test_store(spark, tmp_path):
    own = st.Store(spark, str(tmp_path / "s"), 64)
    assert not own.exists("a", 0, "mse4") and own.manifest().count() == 0
    with pytest.raises(FileNotFoundError):
        own.load("a", 0, "mse4")
    assert own.pack(cache(spark), "mse4") == 4 and own.pack(cache(spark), "mse4") == 0
    assert own.pack(cache(spark, ("a", "c"), 1), "mse4") == 1
    assert own.exists("c", 0, "mse4") and not own.exists("c", 1, "mse4")
    before = own.entries("mse4").count()
    assert own.pack(cache(spark, ("a",), 1, 9), "mse4", overwrite=True) == 1
    assert own.entries("mse4").count() == before + 8 and own.load("a", 0, "mse4").count() == 18
    assert own.manifest().filter("doc_id = 'a' AND layer = 0").first()["num_tokens"] == 9
    assert own.restore("b", 1, "mse4").count() == 10
    heads = own.dynamic_cache("a", 5, "mse4").collect()
    assert sorted((h.layer, h.head, len(h["keys"])) for h in heads) == [(0, 0, 9), (0, 1, 9), (1, 0, 5), (1, 1, 5)]
    assert own.verify(strict=True).filter("status = 'ok'").count() == 5
    assert own.sizes(2).filter("doc_id = 'b'").first()["kv_mb"] == 2 * 2560 / 2**20
    with pytest.raises(ValueError):
        own.entries("unheard")
    spark.createDataFrame([("b", "a" * 64, 0, "mse4", "k", 5, 9e9)], st.MANIFEST).write.mode("append").parquet(str(tmp_path / "s/manifest"))
    with pytest.raises(st.StoreError):
        own.load("b", 0, "mse4")
    with pytest.raises(st.StoreError):
        own.verify(strict=True)


def test_manifest_json(spark):
    good = json.dumps({"v": 1, "entries": {"d": {"sha256": "x", "layers": {"3::mse4": {"key": "k", "num_tokens": None, "stored_at": 1.5}}}}})
    rows = spark.createDataFrame([(good,), ("{broken",), (None,)], "j string").select(st.manifest_from_json(F.col("j")).alias("m"))
    assert [r.m["v"] for r in rows.collect()] == [1, 1, 1]
    flat = st.manifest_rows(rows.select("m.entries")).collect()
    assert [(r.doc_id, r.layer, r.scheme, r.num_tokens) for r in flat] == [("d", 3, "mse4", None)]


def test_migration(spark, tmp_path):
    old = lambda d: hashlib.md5(d.encode()).hexdigest()[:12]
    new = lambda d: hashlib.sha256(d.encode()).hexdigest()[:16]
    names = [f"{old('a')}_L00_two_parts.bin", f"{old('a')}_L00_two_parts.meta", f"{old('b')}_L01_x.bin", f"{new('b')}_L01_x.bin", f"{new('a')}_L02_y.bin", "odd.bin", f"{old('zz')}_L00_x.bin"]
    for n in names:
        (tmp_path / n).write_bytes(b"\0")
    (tmp_path / "ids").write_text('a\n\n{"doc_id": "b"}\n')
    ids = migrate.read_ids(spark, str(tmp_path / "ids"))
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    planned = migrate.plan(listing, ids, spark.createDataFrame([("b", 1, "x")], "doc_id string, layer int, scheme string")).cache()
    assert {r.action: r.n for r in migrate.counts(planned).collect()} == {"rename": 2, "skip": 1, "adopt": 1}
    assert migrate.apply(planned, str(tmp_path)) == {"rename": 2, "skip": 1, "adopt": 1, "error": 0} and (tmp_path / names[0]).exists()
    migrate.apply(planned, str(tmp_path), dry_run=False)
    assert (tmp_path / f"{new('a')}_L00_two_parts.meta").exists() and not (tmp_path / names[0]).exists() and (tmp_path / names[2]).exists()


def test_missing_layers(spark):
    registry = spark.createDataFrame([("0::a", 0, "a"), ("0::a", 0, "a"), ("1::a", 1, "a"), ("1::b", 1, "b")], "layer_key string, layer int, scheme string")
    layer = "struct<key:string,num_tokens:int,stored_at:double>"
    rows = [
        ("s", {"x": ("h", {"0::a": ("k", 1, 1.0)}), "y": ("h", {"0::a": ("k", 1, 1.0), "1::a": ("k", 1, 1.0), "1::b": ("k", 1, 1.0)}), "e": ("h", {}), "n": ("h", None), "gone": ("h", {})}),
        ("s", {"x": ("h", {"1::b ": ("k", 1, 1.0), "1::a": ("k", 1, 1.0)})}), ("t", {"x": ("h", {"1::b": ("k", 1, 1.0)})}), ("u", None), ("v", {}),
    ]
    manifest = spark.createDataFrame(rows, f"store_name string, entries map<string,struct<sha256:string,layers:map<string,{layer}>>>")
    docs = spark.createDataFrame([("x",), ("y",), ("e",), ("n",), ("new",)], "doc_id string")
    got = sorted(map(tuple, st.missing_layers(docs, registry, manifest).collect()), key=str)
    all_ = [(0, "a"), (1, "a"), (1, "b")]
    want = [("s", "x", 1, "b"), ("t", "x", 0, "a"), ("t", "x", 1, "a"), *((s, d, *k) for s, d in (("s", "e"), ("s", "n"), (None, "new")) for k in all_)]
    assert got == sorted(want, key=str)


def test_precompute_missing_takes_all_layers(spark):
    from kvlake.plans import catalogue

    got = catalogue.precompute_missing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["store_name", "doc_id", "layer", "scheme"]
    assert got.select("layer").distinct().count() == 36 and got.select("scheme").distinct().count() == 5


def test_whole_store_is_read_again(spark):
    from kvlake.operators import schemes
    from kvlake.plans import catalogue

    root = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.layer, r.head): (r.tokens, r.k_sum, r.v_sum) for r in catalogue.dynamic_cache(spark, root).collect()}
    plain = schemes.restore(schemes.pack(catalogue.cache(spark, root), "dense16", catalogue.DIM), "dense16", catalogue.DIM)
    heads = plain.groupBy("doc_id", "layer", "head").agg(F.sort_array(F.collect_list(F.struct("token", "k", "v"))).alias("x"))
    sums = heads.select("doc_id", "layer", "head", F.size("x"), F.xxhash64("x.k"), F.xxhash64("x.v")).collect()
    assert len(sums) == 20 and got == {tuple(r[:3]): tuple(r[3:]) for r in sums}
    errors = {tuple(r) for r in catalogue.store_roundtrip(spark, root).collect()}
    assert errors == {tuple(r) for r in catalogue.roundtrip_error(spark, root).collect()} and {r[0] for r in errors} == {*schemes.SCHEMES}


def test_interrupted_and_replaced_versions_do_not_count(spark, tmp_path):
    own = st.Store(spark, str(tmp_path / "s"), 64)
    assert own.pack(cache(spark, ("a", "b"), 1), "mse4") == 2
    stray = spark.read.parquet(str(tmp_path / "s/entries")).filter("doc_id = 'a'").withColumn("doc_id", F.lit("c")).withColumn("version", F.lit("lost"))
    stray.write.mode("append").partitionBy("scheme", "layer", "version").parquet(str(tmp_path / "s/entries"))  # rows without a manifest row
    assert not own.exists("c", 0, "mse4") and own.entries().count() == 20
    assert own.pack(cache(spark, ("c",), 1), "mse4") == 1 and own.exists("c", 0, "mse4") and own.load("c", 0, "mse4").count() == 10
    for tokens in (7, 3):
        own.pack(cache(spark, ("a",), 1, tokens), "mse4", overwrite=True)
        assert own.load("a", 0, "mse4").count() == 2 * tokens and own.load("b", 0, "mse4").count() == 10
    assert own.pack(cache(spark, ("a",), 1), "sign1") == 1 and own.entries("sign1", 0).count() == 10 and own.entries("sign1", 1).count() == 0
    queries = cache(spark, ("a", "b"), 1).filter("token = 1").select(F.lit("q").alias("q_id"), "doc_id", "layer", "head", F.col("v").alias("q"))
    assert own.attend(queries, "mse4").count() == 4
    with pytest.raises(ValueError):
        own.attend(queries, "unheard")


def test_migration_writes_the_manifest(spark, tmp_path):
    old = lambda d: hashlib.md5(d.encode()).hexdigest()[:12]
    new = lambda d: hashlib.sha256(d.encode()).hexdigest()[:16]
    for n, raw in ((f"{old('a')}_L00_x_y.bin", b"0"), (f"{old('a')}_L00_x_y.meta", b'{"num_tokens": 40}'), (f"{new('b')}_L01_x.bin", b"0"), (f"{new('b')}_L01_x.meta", b"\xff"), (f"{old('b')}_L01_x.bin", b"0")):
        (tmp_path / n).write_bytes(raw)
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "doc_id string")
    assert migrate.migrate(spark, str(tmp_path), ids) == {"rename": 2, "skip": 1, "adopt": 1, "error": 0} and not (tmp_path / "manifest").exists()
    assert migrate.migrate(spark, str(tmp_path), ids, dry_run=False) == {"rename": 2, "skip": 1, "adopt": 1, "error": 0}
    own = st.Store(spark, str(tmp_path), 64)
    rows = {(r.doc_id, r.layer, r.scheme, r.key, r.num_tokens) for r in own.manifest().collect()}
    assert rows == {("a", 0, "x_y", f"{new('a')}_L00_x_y", 40), ("b", 1, "x", f"{new('b')}_L01_x", None)}
    assert own.verify(strict=True).count() == 2
    assert migrate.migrate(spark, str(tmp_path), ids, dry_run=False) == {"rename": 0, "skip": 1, "adopt": 0, "error": 0} and own.manifest().count() == 2


def test_evaluation_sets_counts_and_failed_documents(spark, tmp_path):
    lines = [{"context": "one two three four", "input": "What?\nSo", "answers": ["a"]}, {"context": "", "input": "five six"}, {"context": "seven", "input": None, "answers": None}, {"context": "left out", "input": ""}]
    (tmp_path / "set.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = [tuple(r) for r in pipeline.read_eval_set(spark, str(tmp_path / "set.jsonl"), "other", 3, 3).orderBy("doc_id").collect()]
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [("other_0000", "one two three", ["a"], 3), ("other_0001", "five six", [], 2), ("other_0002", "seven", [], 1)]
    padded = pipeline.read_eval_set(spark, str(tmp_path / "set.jsonl"), "other", 3, 3, pad_to=5).orderBy("doc_id").collect()
    assert [(r.context_text, r.context_tokens) for r in padded] == [("one two three five six", 5), ("five six seven one two", 5), ("seven one two three five", 5)]
    manifest = spark.createDataFrame([("a", 0, "fp16", 7, 1.0), ("a", 0, "fp16", 9, 2.0), ("b", 0, "fp16", None, 1.0), ("c", 1, "fp16", 3, 1.0)], "doc_id string, layer int, scheme string, num_tokens int, stored_at double")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "doc_id string")
    assert {tuple(r) for r in pipeline.token_counts(docs, manifest).collect()} == {("a", 9), ("b", 512), ("c", 512)}
    both = cache(spark, ("a",), 1, 9).unionByName(cache(spark, ("b",), 1, 4))
    assert [tuple(r) for r in pipeline.too_long(both, 5).collect()] == [("a", 9)]
    assert pipeline.precompute(st.Store(spark, str(tmp_path / "s"), 64), both, ["mse4", "sign1"], max_tokens=5) == {"mse4": 1, "sign1": 1}
    report = {r.scheme: r for r in pipeline.evaluate(*pipeline.demo_runs(spark), "fp16").collect()}
    assert set(report) == {"fp16", "turbo_prod", "turbo_mse"} and report["fp16"].accuracy == 1.0 and round(report["turbo_prod"].size_ratio, 2) == 3.82


def test_json_lines_by_splits(spark, tmp_path):
    lines = [json.dumps({"text": f"line {i} é" * (i % 5)} if i % 3 else {"id": f"x{i}", "content": "own"}, ensure_ascii=False) if i % 7 else "" for i in range(4000)]
    (tmp_path / "big file.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "bad.jsonl").write_bytes(b'{"text": "lost"}\n"a string"\n')
    (tmp_path / "bytes.JSONL").write_bytes(b'{"text": "lost"}\n{"text": "\xff"}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        found = files.scan(spark, str(tmp_path), ["jsonl"])
        assert found.rdd.getNumPartitions() > 4
        got = [(r.base_id, r.text) for r in found.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = [(i, json.loads(x)) for i, x in enumerate(lines) if x]
    assert got == [(r.get("id", f"big file_{i}"), r.get("text") or r.get("content")) for i, r in rows if r.get("text") or r.get("content")]


def test_csv_by_splits_and_whole(spark, tmp_path):
    import csv
    import io

    def write(name, rows, end="\r\n"):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows(rows)
        (tmp_path / name).write_text(out.getvalue(), encoding="utf-8", newline="")

    plain = [["n", "text", "id"], *([str(i), f'say "{i}", é', f"p{i}" if i % 2 else ""] for i in range(900))]
    write("plain.csv", plain)
    write("other.CSV", [["content", "doc_id"], ["x", "o1"], [], ["y"], ["z" * 300_000, "o3"]], "\n")
    write("lines.csv", [["id", "text"], ["l1", "two\nlines"], ["", "one"]])
    (tmp_path / "old.csv").write_bytes(b"id,text\rm1,mac\rm2,lines\r")
    (tmp_path / "bytes.csv").write_bytes(b"id,text\nb1,\xff\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        got = [(r.base_id, r.text) for r in files.scan(spark, str(tmp_path), ["csv"]).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [("l1", "two\nlines"), ("lines_1", "one"), ("m1", "mac"), ("m2", "lines"), ("o1", "x"), ("other_1", "y"), ("o3", "z" * 300_000), *((r[2] or f"plain_{i}", r[1]) for i, r in enumerate(plain[1:]))]
    assert got == want
