"""The named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import codebook, layouts
from kvlake.functions import text as T
from kvlake.functions import vectors as V
from kvlake.operators import attention, corpus, metrics, paging, references, schemes
from kvlake.plans import pipeline
from kvlake.session import own_folder, read_table, written_once
from kvlake.sources import files, migrate
from kvlake.sources import store as st
from kvlake.streaming import slots

Query = Callable[[SparkSession, str], DataFrame]

DIM, HEADS, TOKENS = 64, 2, 25
#: Half precision values over a transform of 64 are whole multiples of 2**-27; scales are multiples of 2**-24.
FIXED = 1 << 27


# ---------------------------------------------------------------- vectors


def cache(spark: SparkSession, root: str) -> DataFrame:
    """The vectors as a cache: 25 tokens of 2 heads a document; values are the keys backwards."""
    at = F.col("vec_id") % (HEADS * TOKENS)
    return read_table(spark, root, "embeddings").select(
        F.floor(F.col("vec_id") / (HEADS * TOKENS)).cast("string").alias("doc_id"), F.lit(0).alias("layer"), (F.col("vec_id") % HEADS).cast("int").alias("head"),
        F.floor(at / HEADS).cast("int").alias("token"), F.col("embedding").alias("k"), F.reverse("embedding").alias("v"),
    )


def cache_queries(spark: SparkSession, root: str) -> DataFrame:
    """For every document and head the first key of the next document."""
    first = cache(spark, root).filter("token = 0")
    docs = read_table(spark, root, "embeddings").agg((F.floor(F.max("vec_id") / (HEADS * TOKENS)) + 1).alias("n"))
    n = docs.first()["n"]
    return first.select(F.pmod(F.col("doc_id").cast("long") - 1, F.lit(n)).cast("string").alias("doc_id"), "layer", "head", F.concat(F.lit("q"), "doc_id").alias("q_id"), F.col("k").alias("q"))


def _parts(spark: SparkSession, root: str) -> DataFrame:
    parts = F.array(F.struct(F.lit("k").alias("part"), V.halves(F.col("k")).alias("x")), F.struct(F.lit("v").alias("part"), V.halves(F.col("v")).alias("x")))
    return cache(spark, root).select("doc_id", "head", "token", F.inline(parts))


def wht_rotate(spark: SparkSession, root: str) -> DataFrame:
    """Rotated keys and values, value by value, in fixed point."""
    turned = V.rotate(_parts(spark, root), "x", "head", DIM, "y")
    return turned.select("doc_id", "head", "token", "part", F.posexplode("y").alias("j", "y")).withColumn("y", (F.col("y") * FIXED).cast("long"))


def wht_unrotate(spark: SparkSession, root: str) -> DataFrame:
    """Rotated and turned back: the vectors again, in fixed point."""
    turned = V.rotate(_parts(spark, root), "x", "head", DIM, "y")
    back = V.unrotate(turned, "y", "head", DIM, "z")
    return back.select("doc_id", "head", "token", "part", F.posexplode("z").alias("j", "z")).withColumn("z", (F.col("z") * FIXED).cast("long"))


def rms_scale(spark: SparkSession, root: str) -> DataFrame:
    """The stored scale of every rotated vector, and the scale by largest magnitude of every plain one, in fixed point."""
    turned = V.rotate(_parts(spark, root), "x", "head", DIM, "y")
    fixed = lambda c: (V.f16(c) * FIXED).cast("long")
    return turned.select("doc_id", "head", "token", "part", fixed(V.rms(F.col("y"))).alias("rms"), fixed(V.absmax_scale(F.col("x"))).alias("absmax"))


def _codes(name: str) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        packed = schemes.pack(cache(spark, root), name, DIM)
        return packed.select(
            "doc_id", "head", "token", F.lower(F.hex("k_codes")).alias("k_hex"), F.lower(F.hex("v_codes")).alias("v_hex"),
            *[F.coalesce((F.col(c) * FIXED).cast("long"), F.lit(-1)).alias(c) for c in ("k_scale", "k_residual", "v_scale")],
        )

    query.__doc__ = f"Packed codes and scales of {name}."
    return query


def pack_bits_hex(spark: SparkSession, root: str) -> DataFrame:
    """Signs of the values packed at one, two and four bits (as columns), and read back."""
    x = _parts(spark, root).filter("part = 'k'")
    ones = F.transform("x", lambda v: (v >= 0).cast("int"))
    twos = F.transform("x", lambda v, i: (v >= 0).cast("int") + 2 * F.pmod(i, F.lit(2)).cast("int"))
    fours = V.absmax_codes(F.col("x"))
    coded = x.select("doc_id", "head", "token", ones.alias("b1"), twos.alias("b2"), fours.alias("b4"))
    hexed = coded.select(*coded.columns, *[V.pack(F.col(f"b{b}"), b).alias(f"p{b}") for b in (1, 2, 4)])
    same = [(V.unpack(F.col(f"p{b}"), b, F.lit(DIM)) == F.col(f"b{b}")).alias(f"same{b}") for b in (1, 2, 4)]
    total = F.aggregate(F.transform("b4", V.signed4), F.lit(0), lambda s, v: s + v).alias("sum4")
    return hexed.select("doc_id", "head", "token", *[F.lower(F.hex(f"p{b}")).alias(f"hex{b}") for b in (1, 2, 4)], *same, total)


def roundtrip_error(spark: SparkSession, root: str) -> DataFrame:
    """Errors of packing and restoring, by scheme and part."""
    return pipeline.roundtrips(cache(spark, root), list(schemes.SCHEMES), DIM).select("scheme", "part", *[F.round(c, 6).alias(c) for c in ("mse", "max_abs", "rel_mse")])


def _outs(df: DataFrame) -> DataFrame:
    return df.select("q_id", "doc_id", "head", F.posexplode("out").alias("j", "out")).withColumn("out", F.round(F.col("out").cast("double"), 5))


def attn_sdpa(spark: SparkSession, root: str) -> DataFrame:
    """Attention on plain vectors."""
    return _outs(attention.plain_attention(cache_queries(spark, root), cache(spark, root), DIM))


def attn_logits_plain(spark: SparkSession, root: str) -> DataFrame:
    """Logits on plain vectors."""
    return attention.plain_logits(cache_queries(spark, root), cache(spark, root), DIM).select("q_id", "doc_id", "head", "token", F.round("logit", 6).alias("logit"))


def attn_logits_prod4(spark: SparkSession, root: str) -> DataFrame:
    """Logits on the codes of prod4."""
    packed = schemes.pack(cache(spark, root), "prod4", DIM)
    return attention.packed_logits(cache_queries(spark, root), packed, "prod4", DIM).select("q_id", "doc_id", "head", "token", F.round("logit", 6).alias("logit"))


def _fused(name: str) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        packed = schemes.pack(cache(spark, root), name, DIM)
        return _outs(attention.packed_attention(cache_queries(spark, root), packed, name, DIM))

    query.__doc__ = f"Attention on the codes of {name}."
    return query


def attn_mse_by_scheme(spark: SparkSession, root: str) -> DataFrame:
    """What attention on codes differs by from attention on plain vectors."""
    packed = {n: schemes.pack(cache(spark, root), n, DIM) for n in schemes.SCHEMES}
    return attention.attention_error(cache_queries(spark, root), cache(spark, root), packed, DIM).select("scheme", F.round("mse", 8).alias("mse"))


def attn_mse_by_layer(spark: SparkSession, root: str) -> DataFrame:
    """The same by layer, with the documents spread over three."""
    spread = lambda df: df.withColumn("layer", (F.col("doc_id").cast("int") % 3))
    packed = {n: spread(schemes.pack(cache(spark, root), n, DIM)) for n in schemes.SCHEMES}
    return attention.attention_error(spread(cache_queries(spark, root)), spread(cache(spark, root)), packed, DIM, ("layer",)).select("scheme", "layer", F.round("mse", 8).alias("mse"))


def gqa_head_select(spark: SparkSession, root: str) -> DataFrame:
    """Of 8 query heads the ones that stand for 2 heads of a cache."""
    heads = read_table(spark, root, "embeddings").select((F.col("vec_id") % 8).cast("int").alias("head"), "vec_id")
    return attention.select_group_heads(heads, 8, 2)


def codebook_lloyd_max(spark: SparkSession, root: str) -> DataFrame:
    """The levels in use and those designed anew."""
    rows = [(n, i, float(a), round(float(b), 6)) for n, table, rounds in ((8, codebook.LEVELS8, 50), (16, codebook.LEVELS16, 5000)) for i, (a, b) in enumerate(zip(table, codebook.lloyd_max(n, rounds), strict=True))]
    return spark.createDataFrame(rows, "n int, code int, used double, designed double")


_SHAPES = [(16, 8, 128), (16, 2, 128), (16, 2, 64), (32, 4, 64)]


def layout_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Regions of a page, by scheme and shape."""
    rows = [(s, b, h, d, r, at, size) for b, h, d in _SHAPES for s in schemes.SCHEMES for r, (at, size) in layouts.page_regions(s, layouts.Config(block=b).with_shape(h, d)).items()]
    return spark.createDataFrame(rows, "scheme string, block int, heads int, dim int, region string, at long, size long").filter("region = 'page'").select("scheme", "block", "heads", "dim", F.col("size").alias("page_bytes"))


def compression_summary(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of 32,768 tokens by scheme, and their ratio to dense ones."""
    rows = [(s, int(x["bytes"]), float(x["ratio"])) for s, x in layouts.summary(32768, layouts.Config().with_shape(2, 128)).items()]
    return spark.createDataFrame(rows, "scheme string, bytes long, ratio double")


def kv_mb_by_doc_scheme(spark: SparkSession, root: str) -> DataFrame:
    """MB of every document by scheme, over 36 layers."""
    tokens = cache(spark, root).groupBy("doc_id").agg((F.max("token") + 1).alias("tokens"))
    c = layouts.Config().with_shape(HEADS, DIM)
    per = F.create_map(*[F.lit(x) for s in schemes.SCHEMES for x in (s, layouts.page_bytes(s, c))])
    each = tokens.select("doc_id", "tokens", F.explode(F.array(*map(F.lit, schemes.SCHEMES))).alias("scheme"))
    whole = F.when(F.col("scheme") == "dense16", F.col("tokens") * HEADS * DIM * 4).otherwise(F.ceil(F.col("tokens") / c.block) * F.element_at(per, F.col("scheme")))
    return each.select("doc_id", "scheme", (36 * whole / 2**20).cast("double").alias("kv_mb"))


# ---------------------------------------------------------------- texts


def _records(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").select(F.col("doc_id").alias("seq"), F.concat_ws("/", "source", "doc_id").alias("base_id"), "text")


def _chunks(how: str) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        return corpus.chunked(_records(spark, root), how, 96, 16).select("seq", "chunk", "id", "text")

    query.__doc__ = f"Documents in chunks, by {how}."
    return query


def doc_key(spark: SparkSession, root: str) -> DataFrame:
    """Stored names of documents, by layer and scheme."""
    ids = read_table(spark, root, "corpus").select("id").distinct()
    at = ids.select("id", F.explode(F.array(F.lit(0), F.lit(7), F.lit(123))).alias("layer"))
    return at.select("id", "layer", T.store_key(F.col("id"), F.col("layer"), F.lit("mse4")).alias("key"))


def content_hash(spark: SparkSession, root: str) -> DataFrame:
    """Hashes of the records' texts."""
    return read_table(spark, root, "corpus").select("seq", T.content_hash(F.col("text")).alias("hash"))


def safe_stem(spark: SparkSession, root: str) -> DataFrame:
    """Ids made of the records' paths."""
    return read_table(spark, root, "corpus").select("seq", T.safe_stem(F.col("file_path")).alias("stem"))


def dedupe_ids(spark: SparkSession, root: str) -> DataFrame:
    """The corpus with unique ids."""
    rows = read_table(spark, root, "corpus").filter(corpus.not_blank(F.col("text"))).select("seq", F.lit(0).alias("chunk"), "id", "text")
    return corpus.unique_ids(rows).select("id", "text")


def limited_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Its first 100 rows, as a limit on documents gives them."""
    rows = read_table(spark, root, "corpus").filter(corpus.not_blank(F.col("text"))).select("seq", F.lit(0).alias("chunk"), "id", "text")
    return corpus.limited(corpus.unique_ids(rows), 100).select("id", "text")


def token_f1(spark: SparkSession, root: str) -> DataFrame:
    """Word overlap of answers with their best reference, by run."""
    runs = read_table(spark, root, "run_result").select("run_id", "doc_id", "answer").distinct()
    samples = read_table(spark, root, "eval_samples").select("doc_id", "answers")
    return runs.join(samples, "doc_id", "left").select("run_id", F.round(metrics.best_f1(F.col("answer"), F.col("answers")), 6).alias("f1"))


def substring_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """The share of answers that hold a reference, by scheme."""
    runs = read_table(spark, root, "run_result").select("run_id", "doc_id", "scheme", "answer").distinct()
    samples = read_table(spark, root, "eval_samples").select("doc_id", "answers")
    hit = F.exists("answers", lambda r: T.holds_answer(F.coalesce("answer", F.lit("")), r))
    return runs.join(samples, "doc_id").groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("hits"))


def normalise_answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers as they are compared."""
    runs = read_table(spark, root, "run_result").select("run_id", "answer").distinct()
    return runs.select("run_id", T.normalise_answer(F.col("answer")).alias("normal"))


def extract_query(spark: SparkSession, root: str) -> DataFrame:
    """What prompts ask, for three kinds of sets."""
    samples = read_table(spark, root, "eval_samples").select("doc_id", "context_text", "query_prompt")
    prompt = F.concat("context_text", F.lit("\nQuestion: "), "query_prompt", F.lit("\nAnswer:"))
    kinds = F.array(*[F.struct(F.lit(d).alias("dataset"), p.alias("prompt")) for d, p in (("qasper", prompt), ("hotpotqa", F.col("context_text")), ("gov_report", prompt), ("other", F.col("context_text")))])
    return samples.select("doc_id", F.inline(kinds)).select("doc_id", "dataset", T.extract_query(F.col("prompt"), F.col("dataset")).alias("asked"))


def pad_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Contexts filled up to 512 words."""
    return corpus.padded_contexts(read_table(spark, root, "eval_samples"), 512)


def model_alias(spark: SparkSession, root: str) -> DataFrame:
    """What the short names of models stand for, whatever their case, and names that are none."""
    asked = [*T.MODEL_ALIASES, *(x.upper() for x in T.MODEL_ALIASES), "own/Model-1", ""]
    return spark.createDataFrame([(x, T.resolve_alias(x, T.MODEL_ALIASES)) for x in asked], "name string, model string")


def eval_loader(spark: SparkSession, root: str) -> DataFrame:
    """Samples as a loader makes them: the first 100, the input where there is no context, 60 words of the context."""
    blank = F.when(F.col("context_tokens") % 5 == 0, F.lit("")).otherwise(F.col("context_text"))
    items = read_table(spark, root, "eval_samples").select(F.col("doc_id").alias("seq"), blank.alias("context"), F.col("query_prompt").alias("input"), "answers")
    return pipeline.eval_set(items, "other", 100, 60).drop("answers")


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """The records in force, written as JSON lines and read again: ids and the hashes of their texts."""
    rows = read_table(spark, root, "corpus").filter("removed_at IS NULL AND text IS NOT NULL").select(F.concat(F.lit("r"), "seq").alias("id"), "text")
    folder = own_folder(spark, "corpus")
    files.write_corpus(rows, folder)
    return files.read_jsonl(spark, folder, "json").select(F.col("base_id").alias("id"), F.md5("text").alias("hash"))


def corpus_csv(spark: SparkSession, root: str) -> DataFrame:
    """The same through CSV files, in which some texts hold line ends and quotes."""
    rows = read_table(spark, root, "corpus").filter("removed_at IS NULL AND text IS NOT NULL").select(F.concat(F.lit("r"), "seq").alias("id"), "text")
    folder = own_folder(spark, "csv")
    single = ~F.col("text").rlike("[\r\n]")
    for kind, part in (("single", rows.filter(single)), ("several", rows.filter(~single))):
        part.write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{folder}/{kind}")
    return files.read_csv(spark, folder).select(F.col("base_id").alias("id"), F.md5("text").alias("hash"))


def truncate_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Contexts cut to 50 words, and the prompt for them."""
    s = read_table(spark, root, "eval_samples")
    return s.select("doc_id", T.truncated(F.col("context_text"), 50).alias("context"), T.build_prompt(F.col("query_prompt")).alias("prompt"))


# ---------------------------------------------------------------- measures


def latency_stats(spark: SparkSession, root: str) -> DataFrame:
    """Mean and positional percentiles of the events' values, by type."""
    return metrics.latency_report(read_table(spark, root, "events"), ["event_type"], "value").withColumn("avg", F.round("avg", 6))


def run_latency_stats(spark: SparkSession, root: str) -> DataFrame:
    """The same of first-token times, by scheme."""
    runs = read_table(spark, root, "run_result").select("run_id", "scheme", "ttft_ms").distinct()
    return metrics.latency_report(runs, ["scheme"], "ttft_ms").withColumn("avg", F.round("avg", 6))


def scheme_report(spark: SparkSession, root: str) -> DataFrame:
    """Times, sizes and their ratios to dense runs, with overlap and accuracy, by scheme."""
    runs = read_table(spark, root, "run_result").select("run_id", "doc_id", "scheme", "answer", "ttft_ms", "kv_mb").distinct()
    report = pipeline.evaluate(runs, read_table(spark, root, "eval_samples"), "fp16")
    return report.select("scheme", "n", *[F.round(c, 6).alias(c) for c in ("ttft_ms", "kv_mb", "speedup", "size_ratio", "f1", "accuracy")])


def windowed_latency(spark: SparkSession, root: str) -> DataFrame:
    """The events' values by hour and type, as the stream reports them."""
    found = slots.windowed_latency(read_table(spark, root, "events"), "1 hour", "1 hour")
    return found.withColumn("avg", F.round("avg", 9))  # no ties at so many digits


def oom_by_scheme(spark: SparkSession, root: str) -> DataFrame:
    """Samples that ran out of memory, by scheme and dataset, each delivery once."""
    once = read_table(spark, root, "lb_scheme_stats").groupBy("stats_id").agg(F.min(F.struct("dataset", "scheme", "oom")).alias("s"))
    return once.groupBy(F.col("s.scheme").alias("scheme"), F.col("s.dataset").alias("dataset")).agg(F.coalesce(F.sum("s.oom"), F.lit(0)).alias("oom"))


# ---------------------------------------------------------------- slots


def slots_default(spark: SparkSession, root: str) -> DataFrame:
    """Slot, page and offset of every token."""
    return paging.default_slots(cache(spark, root)).select("doc_id", "head", "token", "slot", "page", "offset")


def _appends(spark: SparkSession, root: str) -> DataFrame:
    """Events as appends: each adds 1 to 40 tokens to its user's sequence, in the order of its id."""
    return read_table(spark, root, "events").select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("order"), (F.col("event_id") * 7 % 40 + 1).cast("long").alias("n"))


def slots_block_table(spark: SparkSession, root: str) -> DataFrame:
    """Start and new blocks of every append."""
    return paging.block_table(_appends(spark, root))


def slots_physical(spark: SparkSession, root: str) -> DataFrame:
    """The physical block of every block of every sequence."""
    return paging.physical_blocks(written_once(paging.block_table(_appends(spark, root))), ["order"])


def slot_map(spark: SparkSession, root: str) -> DataFrame:
    """Per append the first and last slot, the number and the sum of its tokens' slots."""
    table = written_once(paging.block_table(_appends(spark, root)))  # five numbers a row, read four times
    slots = paging.slot_map(table, paging.physical_blocks(table, ["order"]))
    return slots.groupBy("seq_id", "order").agg(F.min_by("slot", "token").alias("first"), F.max_by("slot", "token").alias("last"), F.count("slot").alias("n"), F.sum("slot").alias("total"))


def page_export(spark: SparkSession, root: str) -> DataFrame:
    """Pages of prod4 as bytes: their hash and length."""
    packed = schemes.pack(paging.default_slots(cache(spark, root)), "prod4", DIM)
    out = paging.pages(packed, "prod4", layouts.Config().with_shape(HEADS, DIM))
    return out.select("doc_id", "layer", "page", F.sha2("bytes", 256).alias("sha256"), F.length("bytes").alias("n_bytes"))


# ---------------------------------------------------------------- store


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return st.manifest_rows(read_table(spark, root, "manifest"), keys=("store_name",))


def manifest_latest(spark: SparkSession, root: str) -> DataFrame:
    """The row that stands of every document, layer and scheme of a store."""
    return st.latest(_manifest(spark, root), ["store_name", *st.ID])


def manifest_verify(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the manifests by whether hash and key are right."""
    checked = st.status(_manifest(spark, root))
    return checked.groupBy("store_name", "status").agg(F.count(F.lit(1)).alias("n"))


def precompute_missing(spark: SparkSession, root: str) -> DataFrame:
    """What stores lack of the documents in force, by all layers and schemes in force."""
    docs = read_table(spark, root, "corpus").filter("removed_at IS NULL AND id IS NOT NULL").select(F.col("id").alias("doc_id"))
    registry = read_table(spark, root, "layer_registry").filter("retired_at IS NULL").select("layer_key", "layer", "scheme")
    return st.missing_layers(docs, registry, read_table(spark, root, "manifest"))


def doc_token_count(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of every document in force, by the manifests; 512 where they do not say."""
    docs = read_table(spark, root, "corpus").filter("removed_at IS NULL AND id IS NOT NULL").select(F.col("id").alias("doc_id"))
    return pipeline.token_counts(docs, _manifest(spark, root))


def migrate_counts(spark: SparkSession, root: str) -> DataFrame:
    """Files by what would be done to them."""
    return migrate.counts(migrate_plan(spark, root))


def migrate_apply(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows of files renamed and adopted, with the tokens that files beside them state."""
    ids = read_table(spark, root, "corpus").filter("id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    tokens = ids.filter(F.length("doc_id") % 5 == 0).select(T.store_key(F.col("doc_id"), F.lit(3), F.lit("two_parts")).alias("stem"), F.length("doc_id").alias("num_tokens"))
    return migrate.entries(migrate_plan(spark, root), tokens)


def migrate_plan(spark: SparkSession, root: str) -> DataFrame:
    """What would be done to files under old and new names."""
    ids = read_table(spark, root, "corpus").filter("id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    old = ids.select(F.concat(F.left(F.md5("doc_id"), F.lit(12)), F.lit("_L03_"), F.lit("two_parts.bin")).alias("name"))
    odd = ids.filter(F.length("doc_id") % 2 == 0).select(F.concat(T.store_key(F.col("doc_id"), F.lit(3), F.lit("two_parts")), F.lit(".bin")).alias("name"))
    new = ids.filter(F.length("doc_id") % 3 == 0).select(F.concat(T.store_key(F.col("doc_id"), F.lit(4), F.lit("mse4")), F.lit(".bin")).alias("name"))
    known = ids.filter(F.length("doc_id") % 2 == 0).select("doc_id", F.lit(3).alias("layer"), F.lit("two_parts").alias("scheme"))
    return migrate.plan(old.unionByName(odd).unionByName(new), ids, known)


def store_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Stored, verified and read again: errors by scheme and part."""
    own = st.Store(spark, own_folder(spark, "store"), DIM)
    vectors = cache(spark, root)
    for name in schemes.SCHEMES:
        own.pack(vectors, name)
    own.verify(strict=True)
    out = []
    for name in schemes.SCHEMES:
        back = schemes.restore(own.entries(name), name, DIM).select("doc_id", "layer", "head", "token", F.col("k").alias("k1"), F.col("v").alias("v1"))
        both = vectors.join(back, ["doc_id", "layer", "head", "token"])
        sides = F.array(F.struct(F.lit("k").alias("part"), F.col("k").alias("a"), F.col("k1").alias("b")), F.struct(F.lit("v").alias("part"), F.col("v").alias("a"), F.col("v1").alias("b")))
        out.append(metrics.errors(both.select(F.inline(sides)).withColumn("scheme", F.lit(name)), "a", "b", ["scheme", "part"]))
    return reduce(DataFrame.unionByName, out).select("scheme", "part", *[F.round(c, 6).alias(c) for c in ("mse", "max_abs", "rel_mse")])


def dynamic_values(spark: SparkSession, root: str) -> DataFrame:
    """The same as sums, in fixed point, of the values times their places."""
    own = st.Store(spark, own_folder(spark, "dynamic"), DIM)
    own.pack(cache(spark, root), "dense16")
    heads = own.dynamic_caches(4, "dense16")
    placed = heads.select("doc_id", "layer", "head", F.size("keys").alias("tokens"), F.posexplode(F.arrays_zip("keys", "values")).alias("t", "x"))
    total = lambda c: F.aggregate(F.transform(c, lambda v, j: (v.cast("double") * FIXED).cast("long") * (j + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    sums = [F.sum((F.col("t") + 1) * total(f"x.{c}")).alias(name) for c, name in (("keys", "k_total"), ("values", "v_total"))]
    return placed.groupBy("doc_id", "layer", "head", "tokens").agg(*sums)


def dynamic_cache(spark: SparkSession, root: str) -> DataFrame:
    """Every document's heads as arrays in token order, from a store: their length and checksums over all values."""
    own = st.Store(spark, own_folder(spark, "dynamic"), DIM)
    own.pack(cache(spark, root), "dense16")
    return own.dynamic_caches(4, "dense16").select("doc_id", "layer", "head", F.size("keys").alias("tokens"), F.xxhash64("keys").alias("k_sum"), F.xxhash64("values").alias("v_sum"))


# ---------------------------------------------------------------- references


def p2_references(spark: SparkSession, root: str) -> DataFrame:
    """Every reference that does not hold, with its time."""
    parents = [
        references.parent_keys(read_table(spark, root, t), t, k, start, end)
        for t, k, start, end in (("corpus", "id", "loaded_at", "removed_at"), ("layer_registry", "layer_key", "added_at", "retired_at"), ("store_files", "file_key", "created_at", "deleted_at"))
    ]
    return references.orphans(references.references(read_table(spark, root, "manifest")), reduce(DataFrame.unionByName, parents))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every reference that does not hold."""
    return p2_references(spark, root).drop("stored_at")


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Their counts per table, month and status."""
    return references.orphan_report(p2_references(spark, root))


def queries() -> dict[str, Query]:
    named = {f"codes_{n}": _codes(n) for n in schemes.SCHEMES} | {f"attn_fused_{n}": _fused(n) for n in schemes.SCHEMES} | {f"chunk_{n}": _chunks(n) for n in ("fixed", "sentence", "paragraph")}
    plain = (
        wht_rotate, wht_unrotate, rms_scale, pack_bits_hex, roundtrip_error, attn_sdpa, attn_logits_plain, attn_logits_prod4, attn_mse_by_scheme, gqa_head_select,
        codebook_lloyd_max, layout_bytes, compression_summary, kv_mb_by_doc_scheme, doc_key, content_hash, safe_stem, dedupe_ids, limited_corpus, token_f1,
        attn_mse_by_layer, model_alias, eval_loader, corpus_files, corpus_csv, windowed_latency, doc_token_count, migrate_counts, migrate_apply, dynamic_values,
        substring_accuracy, normalise_answers, extract_query, pad_contexts, truncate_tokens, latency_stats, run_latency_stats, scheme_report, oom_by_scheme,
        slots_default, slots_block_table, slots_physical, slot_map, page_export, manifest_latest, manifest_verify, precompute_missing, migrate_plan,
        store_roundtrip, dynamic_cache, p2_found, p2_report,
    )
    return named | {f.__name__: f for f in plain}


def oracle_sql() -> dict[str, str]:
    from kvlake.plans.oracle import SQL

    return SQL
