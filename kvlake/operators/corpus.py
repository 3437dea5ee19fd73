"""From raw records to a corpus of chunks: chunking, ids, collisions, limits, padding.

Raw records have `seq` (their place: path, then record), `base_id` and `text`. Chunks get `chunk` (their number) and `id`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.functions import text as T
from kvlake.operators.paging import running_total

#: Tasks over which the chunks of one id are spread where the id is taken more than once.
SALTS = 16

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH_END = re.compile(r"\n\s*\n")


def fill(pieces: list[str], size: int, overlap: int, join: str) -> list[str]:
    """Pieces joined greedily up to `size` words, each chunk beginning with the longest run of closing pieces of the one
    before that has at most `overlap` words. A piece that is too long by itself is kept whole."""
    counts = [len(p.split()) for p in pieces]
    out, begin, held = [], 0, 0
    for at, n in enumerate(counts):
        if at > begin and held + n > size:
            out.append(join.join(pieces[begin:at]))
            begin, held = at, 0
            while begin and held + counts[begin - 1] <= overlap and overlap:
                begin -= 1
                held += counts[begin]
                if begin == 0:
                    break
        held += n
    return [*out, join.join(pieces[begin:])] if pieces else out


def sentence_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole sentences, which end after `.`, `!` or `?` before white space."""
    return fill([s for s in map(str.strip, _SENTENCE_END.split(text.strip())) if s], size, overlap, " ")


def paragraph_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole paragraphs, which blank lines part; without overlap."""
    return fill([p for p in map(str.strip, _PARAGRAPH_END.split(text)) if p], size, 0, "\n\n")


def fixed_chunks(text: str, size: int, overlap: int) -> list[str]:
    """The windows that `text.windows` gives as a column."""
    words, step = text.split(), max(1, size - overlap)
    last = max(0, -(-(len(words) - size) // step))
    return [" ".join(words[k * step : k * step + size]) for k in range(last + 1)] if words else []


_FOLDS: dict[str, Callable[[str, int, int], list[str]]] = {"fixed": fixed_chunks, "sentence": sentence_chunks, "paragraph": paragraph_chunks}


def chunked(records: DataFrame, how: str, size: int, overlap: int) -> DataFrame:
    """seq, base_id, chunk, id, text: the chunks of every record; null and blank texts give none.

    Folded in Arrow batches, in time linear in the text, without a shuffle. Windows of words could be a column expression
    (`text.windows`), but that took eight times as long on the test documents.
    """
    kept = records.select("seq", "base_id", "text").filter(F.length(T.strip(F.col("text"))) > 0)
    if how in _FOLDS:
        fold = _FOLDS[how]
        types = dict(kept.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                chunks = pa.array([fold(t, size, overlap) for t in b.column(2).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), chunks], ["seq", "base_id", "chunks"])

        each = kept.mapInArrow(run, f"seq {types['seq']}, base_id {types['base_id']}, chunks array<string>")
    else:
        raise ValueError(f"unknown chunking {how!r}; known are fixed, sentence, paragraph")
    each = each.withColumn("total", F.size("chunks"))
    each = each.select("seq", "base_id", "total", F.posexplode("chunks").alias("chunk", "text"))
    return each.select("seq", "base_id", "chunk", T.chunk_id(F.col("base_id"), F.col("chunk"), F.col("total")).alias("id"), "text")


def unique_ids(chunks: DataFrame, salts: int = SALTS) -> DataFrame:
    """id, text, seq, chunk: the first chunk of an id keeps it, later ones get their text's hash behind it; of those with
    the same text one remains, at the first place of that text.

    Chunks are first reduced to one row per id and text hash, on the map side too, so repeated texts cost nothing further;
    only ids with several texts are joined back, over a salt. An id that equals another's with a hash behind it by chance
    is not told apart from it: the two give one row.
    """
    place = F.struct("seq", "chunk")
    texts = chunks.groupBy("id", T.content_hash(F.col("text")).alias("hash")).agg(
        F.min(place).alias("first"), F.min(F.struct(place.alias("at"), F.col("text"))).alias("kept"), F.count(F.lit(1)).alias("n")
    )
    several = texts.groupBy("id").agg(F.min("first").alias("owner"), F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    several = several.select("id", "owner", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(salts)).cast("int"))
    owned = salted.join(several, ["id", "salt"], "left").withColumn("owns", F.col("owner").isNull() | (F.col("owner") == F.col("first")))
    hashed = F.concat(F.col("id"), F.lit("_"), F.col("hash"))
    names = F.when(~F.col("owns"), F.array(hashed)).when(F.col("n") > 1, F.array(F.col("id"), hashed)).otherwise(F.array("id"))
    return owned.select(F.explode(names).alias("id"), F.col("kept.text").alias("text"), F.col("first.seq").alias("seq"), F.col("first.chunk").alias("chunk"))


def limited(corpus: DataFrame, most: int) -> DataFrame:
    """The first `most` rows in the order of their places; Spark keeps only so many per task."""
    return corpus.orderBy("seq", "chunk", F.length("id"), "id").limit(most)


def padded_contexts(samples: DataFrame, target: int, key: str = "doc_id", text: str = "context_text") -> DataFrame:
    """key, context_text, context_tokens: each context filled up to `target` words with those of the samples after it, in
    the order of `key` and around; where all of them are too few, the whole is repeated four times; then cut to `target`.

    The samples' words are thought of as one line, laid out twice; a sample needs the stretch behind its own words. The
    line is cut into buckets of `target` words, and samples meet those whose words lie in the buckets of their stretch, so
    each is joined to about as many others as it takes words from. Keys must be unique; samples without words are filled
    like others; if no sample has a word, all stay empty.
    """
    if target < 1:
        raise ValueError("target must be positive")
    sized = samples.select(key, T.words(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("size", F.size("w").cast("long"))
    placed = running_total(sized, "size", [key], "start")
    whole = sized.agg(F.sum("size")).first()[0] or 0  # one number
    placed = placed.withColumn("all", F.lit(whole).cast("long"))
    lo, hi = F.col("start") + F.col("size"), F.least(F.col("start") + target, F.col("start") + F.col("size") + F.col("all"))
    buckets = lambda a, b: F.sequence(F.floor(a / target), F.floor((b - 1) / target))
    needing = placed.withColumn("lo", lo).withColumn("hi", hi).filter("hi > lo")
    needing = needing.select(key, "lo", "hi", F.floor(F.col("lo") / target).alias("first"), F.explode(buckets(F.col("lo"), F.col("hi"))).alias("bucket"))
    twice = placed.filter("size > 0").select("w", F.explode(F.array("start", F.col("start") + F.col("all"))).alias("a"), "size").withColumn("b", F.col("a") + F.col("size"))
    giving = twice.select("w", "a", "b", F.floor(F.col("a") / target).alias("own"), F.explode(buckets(F.col("a"), F.col("b"))).alias("bucket"))
    met = needing.join(giving, "bucket").filter((F.col("bucket") == F.greatest("first", "own")) & (F.col("a") < F.col("hi")) & (F.col("b") > F.col("lo")))
    from_, to = F.greatest("a", "lo"), F.least("b", "hi")
    piece = F.slice("w", (from_ - F.col("a") + 1).cast("int"), (to - from_).cast("int"))
    more = met.select(key, F.struct(F.col("a"), piece.alias("piece")).alias("p")).groupBy(key).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    joined = placed.select(key, "w").join(more, key, "left").select(key, F.concat("w", F.coalesce(F.flatten("ps.piece"), F.array().cast("array<string>"))).alias("w"))
    filled = joined.select(key, F.slice(F.when(F.size("w") < target, F.flatten(F.array_repeat("w", 4))).otherwise(F.col("w")), 1, target).alias("w"))
    return filled.select(key, F.array_join("w", " ").alias("context_text"), F.size("w").alias("context_tokens"))


def without_failed(docs: DataFrame, failed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that did not fail."""
    return docs.join(failed.select(key).distinct(), key, "left_anti")


def not_blank(text: Column) -> Column:
    return F.length(T.strip(text)) > 0
