"""Command line: build a corpus, report on a store, plan or apply a migration, compare schemes."""

from __future__ import annotations

import argparse

from kvlake.functions.text import parse_schemes
from kvlake.plans import pipeline
from kvlake.session import get_spark
from kvlake.sources import migrate
from kvlake.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kvlake", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build", help="chunk a folder of files into a corpus")
    b.add_argument("input")
    b.add_argument("output")
    b.add_argument("--formats", default="txt,md,jsonl,csv,pdf")
    b.add_argument("--chunking", default="fixed", choices=("fixed", "sentence", "paragraph"))
    b.add_argument("--size", type=int, default=512)
    b.add_argument("--overlap", type=int, default=64)
    b.add_argument("--max-docs", type=int)
    s = sub.add_parser("pack", help="pack a cache table into a store")
    s.add_argument("cache")
    s.add_argument("store")
    s.add_argument("--schemes", default="prod4,mse4")
    s.add_argument("--dim", type=int, default=128)
    s.add_argument("--overwrite", action="store_true")
    s.add_argument("--max-tokens", type=int, help="leave out documents with more tokens, and name them")
    v = sub.add_parser("verify", help="hold a store against its manifest")
    v.add_argument("store")
    v.add_argument("--dim", type=int, default=128)
    m = sub.add_parser("migrate", help="plan the new names of a folder's files; --yes applies it")
    m.add_argument("folder")
    m.add_argument("ids")
    m.add_argument("--yes", action="store_true")
    e = sub.add_parser("evaluate", help="times, sizes, overlap and accuracy by scheme of a table of runs; without tables, of the demonstration")
    e.add_argument("--runs")
    e.add_argument("--samples")
    e.add_argument("--base", default="fp16")
    c = sub.add_parser("compare", help="errors of schemes on a cache table, queried by a query table")
    c.add_argument("cache")
    c.add_argument("queries")
    c.add_argument("--schemes", default="absmax4,mse4,prod4,sign1")
    c.add_argument("--dim", type=int, default=128)
    a = p.parse_args(argv)
    spark = get_spark()
    if a.what == "build":
        pipeline.build(spark, a.input, a.output, parse_schemes(a.formats), chunking=a.chunking, size=a.size, overlap=a.overlap, most=a.max_docs)
    elif a.what == "pack":
        cache = spark.read.parquet(a.cache)
        print(pipeline.precompute(Store(spark, a.store, a.dim), cache, parse_schemes(a.schemes), a.overwrite, a.max_tokens))
        if a.max_tokens:
            pipeline.too_long(cache, a.max_tokens).show(truncate=False)
    elif a.what == "verify":
        Store(spark, a.store, a.dim).verify().groupBy("status").count().show()
    elif a.what == "migrate":
        print(migrate.migrate(spark, a.folder, migrate.read_ids(spark, a.ids), dry_run=not a.yes))
    elif a.what == "evaluate":
        runs, samples = (spark.read.parquet(a.runs), spark.read.parquet(a.samples)) if a.runs and a.samples else pipeline.demo_runs(spark)
        pipeline.evaluate(runs, samples, a.base).orderBy("scheme").show(truncate=False)
    else:
        pipeline.compare(spark.read.parquet(a.cache), spark.read.parquet(a.queries), parse_schemes(a.schemes), a.dim).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
