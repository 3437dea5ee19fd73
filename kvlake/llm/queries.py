"""The named queries of this subpackage and their SQL; `__spark_entry__` adds them where the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvlake.llm import copies, encode, garble, leaks, pairs, quantiles, split
from kvlake.session import read_table

Query = Callable[[SparkSession, str], DataFrame]

QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every oversized record."""
    return split.split_oversized(read_table(spark, root, "corpus"), ["seq", "id"])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The oversized records with the kind of boundary that is enough to cut them: the first piece of each."""
    return p1_pieces(spark, root).filter(F.col("piece_no") == 0).select("seq", "cut")


def p1_checked(spark: SparkSession, root: str) -> DataFrame:
    """Per oversized record what its pieces give: the hash of the text they join to, and whether each is within the limit,
    starts with the closing characters of the one before as far as there is room, and ends at the strongest boundary in
    reach (no piece and the next one's beginning hold a stronger one within the limit)."""
    w = Window.partitionBy("seq").orderBy("piece_no")
    own = F.expr("substring(piece, n_overlap + 1)")
    p = p1_pieces(spark, root).withColumn("own", own).withColumn("before", F.lag("own").over(w)).withColumn("after", F.lead("own").over(w))
    room = F.least(F.lit(split.OVERLAP), F.lit(split.LIMIT) - F.length("own"), F.length("before"))
    overlaps = F.when(F.col("before").isNull(), F.col("n_overlap") == 0).otherwise((F.col("n_overlap") == room) & (F.expr("left(piece, n_overlap)") == F.expr("right(before, n_overlap)")))
    reach = F.concat("own", F.expr(f"left(after, {split.LIMIT} - length(own))"))
    paragraph, line = r"\n[ \t]*\r?\n", r"\n"
    # a blank line at the very end of what is in reach may go on behind it
    stronger = F.when(F.col("own").rlike(paragraph + r"\z"), F.lit(False)).when(F.col("own").rlike(line + r"\z"), reach.rlike(r"\n[ \t]*\r?\n(?![ \t]*\r?\n)(?=.)")).otherwise(reach.rlike(r"\n(?=.)"))
    cut_well = F.col("after").isNull() | ~F.coalesce(stronger, F.lit(False))
    parts = F.sort_array(F.collect_list(F.struct("piece_no", "own")))
    return p.groupBy("seq").agg(
        F.md5(F.array_join(parts["own"], "")).alias("joined"), F.min(F.length("piece") <= split.LIMIT).alias("within_limit"),
        F.min(overlaps).alias("overlaps"), F.min(cut_well).alias("cut_well"),
    )


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The runs with a defective answer."""
    return pairs.broken_pairs(read_table(spark, root, "run_result"), read_table(spark, root, "eval_samples"))


def _once(spark: SparkSession, root: str) -> DataFrame:
    return quantiles.first_delivery(read_table(spark, root, "lb_scheme_stats"), "stats_id", ["logged_at", "run_day", "dataset", "scheme"])


def _by_both(once: DataFrame, k: int = quantiles.K) -> DataFrame:
    """Sketches per scheme, and per dataset and scheme (`by`): those per scheme are merged of the others."""
    fine = ["dataset", "scheme", "metric"]
    merged = quantiles.merge_sketches(quantiles.sketch_columns(once, fine[:2], ["ttft_ms", "kv_mb"], k), fine, k)
    both = merged.withColumn("by", F.explode(F.array(F.lit("scheme"), F.lit("dataset, scheme")))).withColumn("dataset", F.when(F.col("by") != "scheme", F.col("dataset")))
    return quantiles.merge_sketches(both, ["by", *fine], k)


def p4_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Median, 95th and 99th percentile per scheme, and per dataset and scheme (`by`), with the bound of the rank error."""
    return quantiles.read_quantiles(_by_both(_once(spark, root)), ["by", "dataset", "scheme", "metric"], QS)


def p4_month_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """The same per month and scheme, combined from the sketches of single days."""
    days = ["run_day", "scheme", "metric"]
    per_day = quantiles.merge_sketches(quantiles.sketch_columns(_once(spark, root), days[:2], ["ttft_ms", "kv_mb"]), days)
    months = per_day.withColumn("month", F.date_format("run_day", "yyyy-MM"))
    groups = ["month", "scheme", "metric"]
    return quantiles.read_quantiles(quantiles.merge_sketches(months, groups), groups, QS)


#: Values in a buffer of the sketches that `p4_rank_errors` looks at: so few that groups collapse in small tables too.
SMALL_K = 64


def p4_rank_errors(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of sketches with small buffers, ranked among all values: how many of them lie within the stated bound,
    and whether the bound is above 0 and below a tenth."""
    once = _once(spark, root)
    groups = ["dataset", "scheme", "metric"]
    told = quantiles.read_quantiles(_by_both(once, SMALL_K).filter("by <> 'scheme'"), groups, QS, SMALL_K)
    wanted = told.select(*groups, "n", "max_rank_error", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(name).alias("v")) for name, q in QS.items()])))
    values = once.select("dataset", "scheme", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("xs")) for m in ("ttft_ms", "kv_mb")]))).select(*groups, F.explode("xs").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    counted = values.groupBy(*groups, "x").agg(F.count(F.lit(1)).alias("c"))
    same = [F.col(f"w.{g}").eqNullSafe(F.col(f"c.{g}")) for g in groups]
    ranks = wanted.alias("w").join(counted.alias("c"), same).groupBy(*[F.col(f"w.{g}").alias(g) for g in groups], "n", "max_rank_error", "q").agg(
        F.coalesce(F.sum(F.when(F.col("x") < F.col("v"), F.col("c.c"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("x") <= F.col("v"), F.col("c.c"))), F.lit(0)).alias("upto")
    )
    rank, most = F.greatest(F.lit(1.0), F.ceil(F.round(F.col("q") * F.col("n"), 6))), F.col("max_rank_error") * F.col("n") + 1e-6
    held = (F.col("below") + 1 - rank <= most) & (rank - F.col("upto") <= most)
    return ranks.groupBy(*groups, "n").agg(
        F.sum(held.cast("long")).alias("within"), F.max(F.col("max_rank_error") > 0).alias("collapsed"), F.max(F.col("max_rank_error") < 0.1).alias("bounded")
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The records that are copies of an earlier one."""
    return copies.copies(read_table(spark, root, "corpus"))


def p5_collapsed(spark: SparkSession, root: str) -> DataFrame:
    """One record for each group of copies, with their number."""
    return copies.collapsed(read_table(spark, root, "corpus"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode_corpus(read_table(spark, root, "documents"))


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The hashes of the texts that the ids stand for, and their number."""
    ids = p6_ids(spark, root)
    return encode.decode_corpus(ids).select("doc_id", F.md5("text").alias("hash"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Each document with each evaluation sample found in it."""
    return leaks.leaked(read_table(spark, root, "documents"), read_table(spark, root, "eval_samples"))


def p7_spans(spark: SparkSession, root: str) -> DataFrame:
    """Where in the documents the samples stand, and how much of them."""
    return leaks.leak_spans(read_table(spark, root, "documents"), read_table(spark, root, "eval_samples")).withColumn("coverage", F.round("coverage", 6))


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """The documents that leak, without what leaks."""
    return leaks.without_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_samples")).filter("n_removed > 0")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents with garbled characters."""
    return p8_repaired(spark, root).select("doc_id")


def p8_repaired(spark: SparkSession, root: str) -> DataFrame:
    """The same with the mistakes made and the original text where it can be had back."""
    return garble.garbled(read_table(spark, root, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_checked, p3_found, p4_percentiles, p4_month_percentiles, p4_rank_errors, p5_found, p5_collapsed, p6_ids, p6_decoded, p7_found, p7_spans, p7_cleaned, p8_found, p8_repaired)}


_QUANTILES = ", ".join(f"list_sort(list(x))[greatest(1, ceil(round({q} * count(x), 6)))::BIGINT] AS {name}" for name, q in QS.items())
_VALUES = """
WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stats_id ORDER BY logged_at) AS nth FROM lb_scheme_stats) WHERE nth = 1),
v AS (SELECT run_day, dataset, scheme, 'ttft_ms' AS metric, unnest(ttft_ms) AS x FROM once
      UNION ALL SELECT run_day, dataset, scheme, 'kv_mb', unnest(kv_mb) FROM once),
good AS (SELECT * FROM v WHERE x IS NOT NULL AND NOT isnan(x))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_percentiles": f"""{_VALUES}
SELECT 'scheme' AS "by", NULL::VARCHAR AS dataset, scheme, metric, count(x) AS n, {_QUANTILES}, 0.0::DOUBLE AS max_rank_error FROM good GROUP BY scheme, metric
UNION ALL SELECT 'dataset, scheme', dataset, scheme, metric, count(x), {_QUANTILES}, 0.0::DOUBLE FROM good GROUP BY dataset, scheme, metric""",
        "p4_month_percentiles": f"""{_VALUES}
SELECT strftime(run_day, '%Y-%m') AS month, scheme, metric, count(x) AS n, {_QUANTILES}, 0.0::DOUBLE AS max_rank_error FROM good GROUP BY 1, scheme, metric""",
        "p4_rank_errors": f"""{_VALUES}
SELECT dataset, scheme, metric, count(x) AS n, 3::BIGINT AS "within", count(x) >= {SMALL_K * quantiles.FAN} AS collapsed, true AS bounded FROM good GROUP BY dataset, scheme, metric""",
        "p5_found": _P5 + "SELECT min_seq AS first_seq, seq FROM (SELECT seq, min(seq) OVER (PARTITION BY k) AS min_seq FROM keyed) WHERE seq > min_seq",
        "p5_collapsed": _P5 + "SELECT min(seq) AS seq, count(*) AS n_copies FROM keyed GROUP BY k",
        "p1_found": _P1,
        "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents",
        "p1_checked": "SELECT seq, md5(text) AS joined, true AS within_limit, true AS overlaps, true AS cut_well FROM corpus WHERE length(text) > 2000",
    }


_P1 = r"""
WITH long AS (SELECT seq, text FROM corpus WHERE length(text) > 2000),
marked AS (SELECT seq,
    regexp_replace(text, '\r?\n(?:[ \t]*\r?\n)+', chr(1), 'g') AS p FROM long),
l AS (SELECT seq, p, regexp_replace(p, '\r?\n', chr(1), 'g') AS l FROM marked),
s AS (SELECT *, regexp_replace(regexp_replace(l, '([.!?])([ \t\x{00A0}\x{3000}])', '\1' || chr(1) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g') AS s FROM l),
w AS (SELECT *, regexp_replace(s, '[ \t\x{00A0}\x{3000}]', chr(1), 'g') AS w FROM s),
m AS (SELECT seq,
    list_max(list_transform(string_split(p, chr(1)), lambda x: length(trim(x, ' ' || chr(9) || chr(160) || chr(12288))))) AS mp,
    list_max(list_transform(string_split(l, chr(1)), lambda x: length(trim(x, ' ' || chr(9) || chr(160) || chr(12288))))) AS ml,
    list_max(list_transform(string_split(s, chr(1)), lambda x: length(trim(x, ' ' || chr(9) || chr(160) || chr(12288))))) AS ms,
    list_max(list_transform(string_split(w, chr(1)), lambda x: length(trim(x, ' ' || chr(9) || chr(160) || chr(12288))))) AS mw FROM w)
SELECT seq, CASE WHEN mp <= 2000 THEN 'paragraph' WHEN ml <= 2000 THEN 'line' WHEN ms <= 2000 THEN 'sentence' WHEN mw <= 2000 THEN 'word' ELSE 'none' END AS cut FROM m
"""

_P5 = r"""
WITH base AS (SELECT seq, text, regexp_replace(upper(text), '[^\p{L}\p{N}]', '', 'g') AS canon FROM corpus WHERE text IS NOT NULL),
counted AS (SELECT * FROM base WHERE canon <> ''),
objects AS (SELECT seq, json_valid(text) AND left(trim(text, ' ' || chr(10) || chr(13) || chr(9)), 1) = '{' AS is_object, text, canon FROM counted),
parts AS (SELECT seq, is_object, text, canon,
    CASE WHEN is_object THEN list_transform(json_keys(text), lambda k: k || ':' || json_extract_string(text, '$."' || k || '"'))
         ELSE list_filter(regexp_split_to_array(text, '[\r\n;|]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) END AS f FROM objects),
told AS (SELECT *, is_object OR (len(f) >= 3 AND len(list_filter(f, lambda x: NOT regexp_matches(x, '^[^\p{L}\p{N}]*\p{L}[^:=]{0,39}[:=]') OR len(string_split(trim(regexp_extract(x, '^\P{L}*([^:=]*)', 1)), ' ')) > 3)) = 0) AS is_fields FROM parts),
keyed AS (SELECT seq, CASE WHEN is_fields THEN 'f:' || array_to_string(list_sort(list_distinct(list_transform(f, lambda x:
      regexp_replace(upper(regexp_extract(x, '^[^:=]*')), '[^\p{L}\p{N}]', '', 'g') || '=' || regexp_replace(upper(regexp_extract(x, '[:=](?s)(.*)', 1)), '[^\p{L}\p{N}]', '', 'g')))), ' ')
    ELSE 't:' || canon END AS k FROM told)
"""
