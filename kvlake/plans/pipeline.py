"""From a folder of files to a corpus, from a corpus to a store, and the comparison of schemes; `python -m kvlake` runs them."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvlake.functions import text
from kvlake.functions.layouts import Config, cache_mb
from kvlake.operators import attention, corpus, metrics, schemes
from kvlake.sources import files
from kvlake.sources.store import Store, latest


def build_corpus(spark: SparkSession, root: str, formats: list[str], chunking: str = "fixed", size: int = 512, overlap: int = 64, most: int | None = None) -> DataFrame:
    """id, text of all chunks below a folder, ids made unique; with `most`, the first so many."""
    found = corpus.unique_ids(corpus.chunked(files.scan(spark, root, formats), chunking, size, overlap))
    return (corpus.limited(found, most) if most else found).select("id", "text")


def build(spark: SparkSession, root: str, out: str, formats: list[str], schemes_: list[str] | None = None, **how) -> None:
    """Writes `<out>/corpus` and `<out>/build_manifest`."""
    began = time.perf_counter()
    files.write_corpus(build_corpus(spark, root, formats, **how), f"{out}/corpus")
    files.write_build_manifest(files.read_corpus(spark, f"{out}/corpus"), f"{out}/build_manifest", schemes_ or [], time.perf_counter() - began)


def too_long(cache: DataFrame, most: int) -> DataFrame:
    """doc_id, num_tokens of the documents with more than `most` tokens in a layer and head: the failed set of
    `precompute`, which evaluations leave out too (`corpus.without_failed`)."""
    return cache.groupBy("doc_id").agg((F.max("token") + 1).alias("num_tokens")).filter(F.col("num_tokens") > most)


def precompute(store: Store, cache: DataFrame, names: list[str], overwrite: bool = False, max_tokens: int | None = None) -> dict[str, int]:
    """Packs a cache under each scheme where it is not stored yet; the number of documents and layers stored by scheme.
    With `max_tokens`, the documents of `too_long` are left out; every other error is raised."""
    if max_tokens is not None:
        cache = corpus.without_failed(cache, too_long(cache, max_tokens))
    return {name: store.pack(cache, name, overwrite) for name in names}


def token_counts(docs: DataFrame, manifest: DataFrame, scheme: str = "fp16", otherwise: int = 512) -> DataFrame:
    """doc_id, num_tokens of every document, from the row that stands of its layer 0 under a scheme; `otherwise` where
    there is none, or where it has no count. `manifest` has doc_id, layer, scheme, num_tokens, stored_at."""
    rows = manifest.filter((F.col("layer") == 0) & (F.col("scheme") == scheme))
    standing = latest(rows.select("doc_id", "num_tokens", "stored_at"), ["doc_id"]).select("doc_id", "num_tokens")
    return docs.select("doc_id").distinct().join(standing, "doc_id", "left").select("doc_id", F.coalesce("num_tokens", F.lit(otherwise)).alias("num_tokens"))


def eval_set(items: DataFrame, dataset: str, max_samples: int, max_words: int, pad_to: int | None = None, order: str = "seq") -> DataFrame:
    """doc_id (the set's name and the place in it), context_text, query_prompt, answers, context_tokens of the first
    `max_samples` items (`order`, context, input, answers): the context, where it is empty the input, cut to `max_words`
    words, and with `pad_to` filled up to so many with those of the samples after it. Null answers count as none."""
    first = items.orderBy(order).limit(max_samples)
    place = F.row_number().over(Window.orderBy(order)) - 1  # over max_samples rows
    context = F.when(F.length("context") > 0, F.col("context")).otherwise(F.coalesce("input", F.lit("")))
    rows = first.withColumn("n", place).select(
        F.format_string(f"{dataset.replace('%', '%%')}_%04d", "n").alias("doc_id"), text.words(context).alias("w"), context.alias("whole"),
        text.extract_query(F.coalesce("input", F.lit("")), F.lit(dataset)).alias("query_prompt"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"),
    )
    cut = F.when(F.size("w") > max_words, F.array_join(F.slice("w", 1, max_words), " ")).otherwise(F.col("whole"))
    samples = rows.select("doc_id", cut.alias("context_text"), "query_prompt", "answers", F.least(F.size("w"), F.lit(max_words)).alias("context_tokens"))
    if pad_to is None:
        return samples
    return samples.drop("context_text", "context_tokens").join(corpus.padded_contexts(samples, pad_to), "doc_id").select(*samples.columns)


def read_eval_set(spark: SparkSession, path: str, dataset: str, max_samples: int, max_words: int, pad_to: int | None = None) -> DataFrame:
    """`eval_set` of a file in JSON lines with context, input and answers, in the order of its lines."""
    items = spark.read.schema("context string, input string, answers array<string>").json(path).withColumn("seq", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    return eval_set(items, dataset, max_samples, max_words, pad_to)


#: What evaluations run on where no tables are given: documents, and questions with the answers looked for.
DEMO_DOCS = (
    ("pages", "A page holds sixteen tokens. The pool hands out the lowest free page first and takes back pages in the opposite order."),
    ("codes", "Keys are turned by a Walsh-Hadamard matrix before they become codes. Each code takes four bits, one of which is the sign of the residual."),
    ("store", "The manifest names every entry by a hash of its document. An entry is written first, and the manifest after it."),
)
DEMO_QUESTIONS = (
    ("q1", "pages", "How many tokens does a page hold?", "sixteen"), ("q2", "codes", "Which matrix turns the keys?", "Walsh-Hadamard"), ("q3", "codes", "How many bits does a code take?", "four"),
    ("q4", "store", "What names every entry?", "the manifest"), ("q5", "pages", "Which page is handed out first?", "lowest"),
)


def demo_corpus(spark: SparkSession) -> DataFrame:
    """id, text of the demonstration."""
    return spark.createDataFrame(DEMO_DOCS, "id string, text string")


def demo_questions(spark: SparkSession) -> DataFrame:
    """id, doc_id, query, answer of the demonstration."""
    return spark.createDataFrame(DEMO_QUESTIONS, "id string, doc_id string, query string, answer string")


def demo_runs(spark: SparkSession, names: tuple[str, ...] = ("fp16", "turbo_prod", "turbo_mse")) -> tuple[DataFrame, DataFrame]:
    """Runs and samples of the demonstration: no model runs here, so the sentence of the document that shares most words
    with the question stands for the answer, and a scheme's size at 36 layers of 2 heads of 128 values for what differs
    between schemes."""
    layout = {"fp16": "dense16", "turbo_prod": "prod4", "turbo_mse": "mse4"}
    sentences = demo_corpus(spark).select(F.col("id").alias("doc_id"), F.explode(F.split("text", r"(?<=\.) ")).alias("answer"), F.size(text.words(F.col("text"))).alias("tokens"))
    asked = demo_questions(spark).withColumnRenamed("answer", "reference").join(sentences, "doc_id")
    met = F.size(F.array_intersect(text.words(F.lower(F.regexp_replace("query", r"\W+", " "))), text.words(F.lower(F.regexp_replace("answer", r"\W+", " ")))))
    best = asked.groupBy("id", "reference").agg(F.max_by(F.struct("answer", "tokens"), F.struct(met, F.col("answer"))).alias("a"))
    config = Config().with_shape(2, 128)
    sizes = F.array(*[F.struct(F.lit(n).alias("scheme"), F.lit(36 * cache_mb(config.block, 1, layout[n], config) / config.block).alias("mb")) for n in names])
    each = best.select("id", "reference", "a.*", F.inline(sizes))
    runs = each.select(F.concat_ws(":", "id", "scheme").alias("run_id"), F.col("id").alias("doc_id"), "scheme", "answer", F.lit(None).cast("double").alias("ttft_ms"), (F.col("mb") * F.col("tokens")).alias("kv_mb"))
    return runs, best.select(F.col("id").alias("doc_id"), F.array("reference").alias("answers"))


def compare(cache: DataFrame, queries: DataFrame, names: list[str], dim: int) -> DataFrame:
    """scheme, part, mse, max_abs, rel_mse of restored keys and values, and attn_mse, of each scheme."""
    packed = {n: schemes.pack(cache, n, dim) for n in names}
    restored = roundtrips(cache, names, dim)
    return restored.join(attention.attention_error(queries, cache, packed, dim).withColumnRenamed("mse", "attn_mse"), "scheme")


def roundtrip(cache: DataFrame, name: str, dim: int) -> DataFrame:
    """scheme, part (k or v), mse, max_abs, rel_mse of what packing and restoring gives against the vectors."""
    return roundtrips(cache, [name], dim)


def roundtrips(cache: DataFrame, names: list[str], dim: int) -> DataFrame:
    """The same of several schemes, in one aggregation."""
    return metrics.errors(reduce(DataFrame.unionByName, [_restored(cache, n, dim) for n in names]), "a", "b", ["scheme", "part"])


def _restored(cache: DataFrame, name: str, dim: int) -> DataFrame:
    """scheme, part, a (the vector), b (what is restored of it). The plain vectors go through the same pass as the codes,
    so nothing is joined."""
    kept = cache.withColumn("k0", F.col("k")).withColumn("v0", F.col("v"))
    back = schemes.restore(schemes.pack(kept, name, dim), name, dim)
    parts = F.array(F.struct(F.lit("k").alias("part"), F.col("k0").alias("a"), F.col("k").alias("b")), F.struct(F.lit("v").alias("part"), F.col("v0").alias("a"), F.col("v").alias("b")))
    halves = lambda c: F.transform(c, lambda x: x.cast("double"))
    return back.select(F.inline(parts)).select(F.lit(name).alias("scheme"), "part", halves("a").alias("a"), halves("b").alias("b"))


def evaluate(runs: DataFrame, samples: DataFrame, base: str) -> DataFrame:
    """The report by scheme with the mean of the best token overlap and of answers that hold a reference; runs without a
    sample count in the times only."""
    joined = runs.join(samples.select("doc_id", "answers"), "doc_id", "left")
    f1 = metrics.best_f1(F.col("answer"), F.col("answers"))
    hit = F.exists("answers", lambda r: text.holds_answer(F.coalesce(F.col("answer"), F.lit("")), r))
    quality = joined.filter(F.col("answers").isNotNull()).groupBy("scheme").agg(F.avg(f1).alias("f1"), F.avg(hit.cast("int")).alias("accuracy"))
    report = metrics.scheme_report(runs, base).alias("r")
    q = quality.alias("q")
    return report.join(q, F.col("r.scheme").eqNullSafe(F.col("q.scheme")), "left").select("r.*", "q.f1", "q.accuracy")
