"""Metrics: reconstruction errors, token overlap, percentiles by position, averages, and reports by scheme."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ARTICLE = re.compile(r"\b(?:a|an|the)\b")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
#: Rank error, as a share, of the bracket that an exact percentile is looked for in.
BRACKET = 10_000


def errors(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Per group: mse, max_abs, and rel_mse (mse over the sample variance of `a` plus 1e-8) of two array columns. Rows
    with a null array are left out; a single value has no variance, so its rel_mse is null."""
    each = pairs.select(*by, F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("x"))
    x, y = F.col("x.a").cast("double"), F.col("x.b").cast("double")
    out = each.groupBy(*by).agg(F.avg((x - y) * (x - y)).alias("mse"), F.max(F.abs(x - y)).alias("max_abs"), F.var_samp(x).alias("__var"))
    return out.select(*by, "mse", "max_abs", (F.col("mse") / (F.col("__var") + 1e-8)).alias("rel_mse"))


def normal_words(text: str) -> list[str]:
    """The words of `text.normalise_answer`."""
    return _PUNCTUATION.sub(" ", _ARTICLE.sub(" ", text.lower())).split()


def overlap(answer: str, reference: str) -> float:
    """The harmonic mean of precision and recall of an answer's words, each counted as often as in both. With no words on
    one side it is 1 if there are none on the other, else 0."""
    p, r = normal_words(answer), normal_words(reference)
    if not p or not r:
        return float(not p and not r)
    shared = sum((Counter(p) & Counter(r)).values())
    precision, recall = shared / len(p), shared / len(r)
    return 2 * precision * recall / (precision + recall) if shared else 0.0


def best_f1(answer: Column, references: Column) -> Column:
    """The best overlap over all references; 0 without one; nulls count as empty texts. Vectorised over Arrow batches: as
    a column of nested higher-order functions it took some fifty times as long, since Spark interprets those."""

    @F.pandas_udf("double")
    def best(answers: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([max((overlap(a or "", r or "") for r in rs), default=0.0) if rs is not None else 0.0 for a, rs in zip(answers, lists, strict=True)], dtype="float64")

    return best(answer, references)


def token_f1(answer: Column, reference: Column) -> Column:
    """The overlap with one reference."""
    return best_f1(answer, F.array(reference))


def average(x: Column) -> Column:
    """The mean, 0 without values."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def positional_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group, the exact values at the positions floor(n * share) of the sorted values (the last where that is n);
    nulls are left out.

    No group is gathered: a mergeable sketch gives each group a bracket around each position that holds it for certain,
    values below the bracket are counted, and only the distinct values inside it (some 8 n / BRACKET) are put in order.
    """
    # grouping by a value that is never null lets null groups join
    keyed = df.filter(F.col(value).isNotNull()).select(*by, F.struct(*[F.col(c) for c in by]).alias("__g") if by else F.struct(F.lit(0)).alias("__g"), F.col(value).cast("double").alias("x"))
    if not shares:
        raise ValueError("no share given")
    points = [min(max(q + d, 0.0), 1.0) for q in shares.values() for d in (-4 / BRACKET, 4 / BRACKET)]
    sizes = keyed.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", points, F.lit(BRACKET)).alias("edges"))
    position = lambda q: F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1)
    specs = F.array(*[
        F.struct(F.lit(name).alias("name"), position(q).alias("position"), F.get("edges", F.lit(2 * i)).alias("lo"), F.get("edges", F.lit(2 * i + 1)).alias("hi"))
        for i, (name, q) in enumerate(shares.items())
    ])
    wanted = sizes.select("__g", "n", specs.alias("specs"))
    near = keyed.select("__g", "x").join(wanted, keyed["__g"].eqNullSafe(wanted["__g"])).drop(wanted["__g"])
    each = near.select("__g", "n", "x", F.explode("specs").alias("s"))
    below = F.sum(F.when(F.col("x") < F.col("s.lo"), 1).otherwise(0))
    counts = each.groupBy("__g", "n", "s.name", "s.position").agg(below.alias("below"))
    inside = each.filter((F.col("x") >= F.col("s.lo")) & (F.col("x") <= F.col("s.hi"))).groupBy("__g", "s.name", "x").agg(F.count(F.lit(1)).alias("c"))
    ordered = inside.groupBy("__g", "name").agg(F.sort_array(F.collect_list(F.struct("x", "c"))).alias("xs"))
    c, o = counts.alias("c"), ordered.alias("o")
    both = c.join(o, F.col("c.__g").eqNullSafe(F.col("o.__g")) & (F.col("c.name") == F.col("o.name"))).select("c.*", "o.xs")
    found = F.aggregate(
        "xs",
        F.struct(F.col("below").cast("long").alias("seen"), F.lit(None).cast("double").alias("x")),
        lambda s, v: F.struct((s["seen"] + v["c"]).alias("seen"), F.when(s["x"].isNull() & (s["seen"] + v["c"] > F.col("position")), v["x"]).otherwise(s["x"]).alias("x")),
    )["x"]
    values = both.select("__g", "n", "name", found.alias("v")).groupBy("__g", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return values.select(*[F.col("__g")[c].alias(c) for c in by], "n", *shares)


def latency_report(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by (at least one column), n, avg, p50, p95: the mean and positional percentiles; groups without a value have 0."""
    marks = positional_percentiles(df, by, value, {"p50": 0.5, "p95": 0.95}).drop("n")
    means = df.groupBy(*by).agg(F.count(value).alias("n"), average(F.col(value)).alias("avg"))
    m, p = means.alias("m"), marks.alias("p")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by]
    return m.join(p, same, "left").select("m.*", F.coalesce("p.p50", F.lit(0.0)).alias("p50"), F.coalesce("p.p95", F.lit(0.0)).alias("p95"))


def scheme_report(runs: DataFrame, base: str, by: str = "scheme") -> DataFrame:
    """One row per scheme: runs, mean first-token time and size, and both as ratios to the scheme `base`."""
    means = runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), average(F.col("ttft_ms")).alias("ttft_ms"), average(F.col("kv_mb")).alias("kv_mb"))
    every = Window.partitionBy()  # one row per scheme
    of_base = lambda c: F.max(F.when(F.col(by) == base, F.col(c))).over(every)
    joined = means.withColumn("__t", of_base("ttft_ms")).withColumn("__m", of_base("kv_mb"))
    guarded = lambda x: F.when(x > 0, x)
    return joined.select(by, "n", "ttft_ms", "kv_mb", (F.col("__t") / guarded(F.col("ttft_ms"))).alias("speedup"), (F.col("__m") / guarded(F.col("kv_mb"))).alias("size_ratio"))
