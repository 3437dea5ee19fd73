import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlake.functions import text as T
from kvlake.operators import corpus, metrics, paging, references


def brute_fixed(text, size, overlap):
    words, out, step = text.split(), [], max(1, size - overlap)
    for at in range(0, len(words), step):
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            break
    return out


def test_fixed_chunks(spark):
    texts = [" ".join(map(str, range(n))) for n in range(0, 40)] + ["", "  　 ", "a\x1cb\x85c d  e\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size, overlap in ((4, 1), (5, 5), (3, 7), (1, 0), (10, 2)):
        got = {r.i: r.c for r in df.select("i", T.fixed_chunks(F.col("t"), size, overlap).alias("c")).collect()}
        assert all(got[i] == brute_fixed(t, size, overlap) for i, t in enumerate(texts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.integers(1, 20), st.integers(0, 25))
def test_filled_chunks_hold_all_pieces_in_order(counts, size, overlap):
    pieces = [" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate(counts)]
    got = corpus.fill(pieces, size, overlap, "|")
    assert list(dict.fromkeys(p for c in got for p in c.split("|"))) == pieces
    # against the sequential definition
    out, buf, held = [], [], 0
    for p, n in zip(pieces, counts):
        if buf and held + n > size:
            out.append("|".join(buf))
            kept, words = [], 0
            for q in reversed(buf):
                if words + len(q.split()) > overlap:
                    break
                kept.insert(0, q)
                words += len(q.split())
            buf, held = kept, words
        buf.append(p)
        held += n
    assert got == [*out, "|".join(buf)]


def test_ids(spark):
    rows = [(1, 0, "x", "a"), (2, 0, "x", "b"), (3, 0, "x", "a"), (4, 0, "y", "a"), (5, 0, "x", "b"), (6, 0, "z", "")]
    df = spark.createDataFrame(rows, "seq int, chunk int, id string, text string")
    want, seen = {}, set()
    import hashlib

    for _, _, i, t in rows:
        name = f"{i}_{hashlib.sha256(t.encode()).hexdigest()[:16]}" if i in seen else i
        seen.add(name)
        want[name] = t
    assert {r.id: r.text for r in corpus.unique_ids(df).collect()} == want
    assert corpus.unique_ids(df.limit(0)).count() == 0


def test_padding(spark):
    r = random.Random(3)
    for target in (7, 30, 200):
        rows = [(f"k{i:02d}", " ".join(f"{i}.{j}" for j in range(r.choice([0, 1, 3, 9])))) for i in range(9)]
        ids = [t.split() for _, t in rows]
        want = {}
        for i, (k, _) in enumerate(rows):
            own, j, seen = list(ids[i]), (i + 1) % len(rows), 0
            while len(own) < target:
                own += ids[j]
                j, seen = (j + 1) % len(rows), seen + 1
                if seen >= len(rows):
                    own = (own * 4)[: target * 2]
                    break
            want[k] = own[:target]
        got = corpus.padded_contexts(spark.createDataFrame(rows, "doc_id string, context_text string"), target).collect()
        assert {g.doc_id: g.context_text.split() for g in got} == want


def test_word_overlap():
    assert metrics.overlap("", "") == 1.0 and metrics.overlap("a", "x") == 0.0 and metrics.overlap("the cat", "a cat") == 1.0
    assert metrics.overlap("x x y", "x y y") == pytest.approx(2 / 3)


def test_positional_percentiles(spark):
    r = random.Random(1)
    rows = [(g, None if r.random() < 0.05 else float(r.choice([r.randint(0, 30), r.gauss(0, 9)]))) for g in ("a", "b", None) for _ in range({"a": 25000, "b": 4, None: 333}[g])]
    rows += [("tie", 5.0)] * 2000 + [("none", None)]
    got = {x.g: x for x in metrics.latency_report(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in {g for g, _ in rows}:
        xs = sorted(v for h, v in rows if h == g and v is not None)
        n = len(xs)
        assert got[g].n == n
        assert (got[g].p50, got[g].p95) == ((xs[n // 2], xs[int(n * 0.95)]) if n else (0, 0))
    assert metrics.positional_percentiles(spark.createDataFrame([("q", float(x)) for x in (1, 2, 3, 4)], "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()[2:] == (3.0, 4.0)


def test_slots_as_the_sequential_table_gives_them(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 5), i, r.randint(0, 40)) for i in range(200)]
    pool = paging.BlockTable(paging.BlockPool(1000))
    want = {i: pool.append(s, n) for s, i, n in rows}
    table = paging.block_table(spark.createDataFrame(rows, "seq_id int, order int, n int"))
    got = {}
    for x in paging.slot_map(table, paging.physical_blocks(table, ["order"])).collect():
        got.setdefault(x.order, []).append((x.token, x.slot))
    assert {i: [s for _, s in sorted(v)] for i, v in got.items()} == {i: v for i, v in want.items() if v}


def test_block_pool():
    t = paging.BlockTable(paging.BlockPool(3))
    assert t.append("a", 17) == list(range(17)) and t.state("a") == ([0, 1], 17)
    with pytest.raises(paging.OutOfBlocks):
        t.append("b", 40)
    assert t.append("b", 1) == [32]
    t.release("a")
    assert t.append("c", 16) == list(range(16))
    with pytest.raises(KeyError):
        t.state("a")


def test_references(spark):
    entry = lambda layers: {"sha256": "s", "layers": layers}
    layer = lambda key, at: {"key": key, "num_tokens": 1, "stored_at": at}
    rows = [
        (1, {"d1": entry({"0::a": layer("f1", 100.0), "1::a": layer(None, 50.0)}), "gone": entry({}), "ended": entry({"9::x": layer("f2", None)})}, 7),
        (2, None, 7), (3, {}, 7), (4, {"late": entry({"0::a": layer("f3", 100.0)}), "d1": None}, 7),
    ]
    schema = "manifest_id long, entries map<string,struct<sha256:string,layers:map<string,struct<key:string,num_tokens:int,stored_at:double>>>>, ref_key int"
    manifest = spark.createDataFrame(rows, schema)
    ts = lambda s: F.timestamp_seconds(F.lit(s))
    parent = spark.createDataFrame([("d1", 1, None), ("d1", 500, None), ("ended", 1, 2), ("late", 101, None), ("late", 1, 3), (None, 1, None)], "k string, s int, e int")
    parent = parent.select("k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    files = spark.createDataFrame([("f1", 100), ("f2", 900)], "k string, s int").select("k", F.timestamp_seconds("s").alias("s"), F.lit(None).cast("timestamp").alias("e"))
    layers = spark.createDataFrame([("0::a",)], "k string").select("k", ts(0).alias("s"), F.lit(None).cast("timestamp").alias("e"))
    parents = references.parent_keys(parent, "corpus", "k", "s", "e").unionByName(references.parent_keys(files, "store_files", "k", "s", "e")).unionByName(references.parent_keys(layers, "layer_registry", "k", "s", "e"))
    got = Counter((r.manifest_id, r.doc_id, r.layer_key, r.ref_table, r.status) for r in references.orphans(references.references(manifest), parents).collect())
    assert got == Counter({
        (1, "gone", "", "corpus", "missing"): 1, (1, "ended", "", "corpus", "deleted"): 1, (4, "late", "", "corpus", "late"): 1, (4, "late", "0::a", "store_files", "missing"): 1,
        (1, "d1", "1::a", "layer_registry", "missing"): 1, (1, "ended", "9::x", "layer_registry", "missing"): 1,
    })
    everything = references.orphans(references.references(manifest), parents.limit(0))
    assert {r.status for r in everything.collect()} == {"missing"} and everything.count() == 5 + 4 + 3  # documents, layers, files named
    assert references.orphan_report(references.orphans(references.references(manifest.limit(0)), parents)).count() == 0


def test_names_and_lists_of_schemes():
    assert T.parse_schemes(" a, b ,,c,") == ["a", "b", "c"] and T.parse_schemes("") == []
    assert T.resolve_alias("PHI3-mini", T.MODEL_ALIASES) == "microsoft/Phi-3-mini-4k-instruct" and T.resolve_alias("x/Y", T.MODEL_ALIASES) == "x/Y"


def test_states_of_a_block_table():
    table = paging.BlockTable(paging.BlockPool(4), 16)
    assert table.append("a", 17) == [*range(17)] and table.append("b", 1) == [32] and table.append("a", 1) == [17]
    assert table.state("a") == ([0, 1], 18) and table.state("b") == ([2], 1)
    with pytest.raises(paging.OutOfBlocks):
        table.append("b", 40)
    assert table.state("b") == ([2], 1)
    table.release("a")
    with pytest.raises(KeyError):
        table.state("a")
    assert table.append("c", 1) == [0] and table.append("c", 20)[-1] == 1 * 16 + 4
