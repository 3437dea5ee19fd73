"""Bringing a store of files named by an older hash of their ids to the names in use.

Old names begin with 12 digits of MD5 of the id, new ones with 16 of SHA-256; then come layer and scheme. The plan is a
join of the listing and the ids; only `apply` touches files, and `migrate` writes what it did to the manifest.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kvlake.functions import text as T
from kvlake.session import written_once
from kvlake.sources.store import MANIFEST


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id of a list with one id a line, plain or as JSON with `doc_id`; blank lines are left out. A bare JSON number
    or string stands for itself."""
    line = T.strip(F.col("value"))
    return spark.read.text(path).filter(F.length(line) > 0).select(F.coalesce(F.get_json_object(line, "$.doc_id"), line).alias("doc_id"))


def parse_stem(stem: Column) -> Column:
    """prefix, layer, scheme of a stem; null where it has not that form."""
    form = r"^([^_]*)_L([0-9]+)_(.*)$"
    part = lambda i: F.regexp_extract(stem, form, i)
    return F.when(stem.rlike(form), F.struct(part(1).alias("prefix"), part(2).cast("int").alias("layer"), part(3).alias("scheme")))


def plan(listing: DataFrame, ids: DataFrame, known: DataFrame) -> DataFrame:
    """name, doc_id, action, new_name of every file that belongs to an id: `rename`, `skip` (the new name is taken), or
    `adopt` (a `.bin` under its new name that the manifest does not know). `listing` has `name`, `known` the manifest's
    doc_id, layer, scheme."""
    files = listing.select("name").distinct().select("name", F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("suffix"))
    parsed = files.withColumn("p", parse_stem(F.col("stem"))).filter(F.col("p").isNotNull())
    hashed = ids.select("doc_id").distinct().select("doc_id", F.left(F.md5("doc_id"), F.lit(12)).alias("old"), F.left(F.sha2("doc_id", 256), F.lit(16)).alias("new"))
    old = parsed.join(hashed, parsed["p.prefix"] == hashed["old"]).withColumn("new_name", F.concat(T.store_key(F.col("doc_id"), F.col("p.layer"), F.col("p.scheme")), "suffix"))
    there = files.select(F.col("name").alias("new_name"), F.lit(True).alias("taken"))
    renames = old.join(there, "new_name", "left").select("name", "doc_id", F.when(F.col("taken"), "skip").otherwise("rename").alias("action"), "new_name")
    new = parsed.filter(F.col("suffix") == ".bin").join(hashed, parsed["p.prefix"] == hashed["new"]).select("name", "doc_id", F.col("p.layer").alias("layer"), F.col("p.scheme").alias("scheme"))
    adopts = new.join(known.select("doc_id", "layer", "scheme").distinct(), ["doc_id", "layer", "scheme"], "left_anti").select("name", "doc_id", F.lit("adopt").alias("action"), F.col("name").alias("new_name"))
    return renames.unionByName(adopts)


def counts(planned: DataFrame) -> DataFrame:
    """Files per action."""
    return planned.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def num_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """stem, num_tokens of the `.meta` files (JSON) in a folder; null where one cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta").load(folder)
    content = F.decode(F.col("content"), "UTF-8")
    valid = F.when(F.expr("is_valid_utf8(content)"), F.get_json_object(content, "$.num_tokens").try_cast("int"))
    return files.select(F.regexp_extract("path", r"([^/]*)\.meta$", 1).alias("stem"), valid.alias("num_tokens"))


def entries(planned: DataFrame, tokens: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """The manifest rows (doc_id, sha256, layer, scheme, key, num_tokens) of the `.bin` files that a plan renames or
    adopts; with `there`, a listing (name) made afterwards, of those that stand under their new names. `tokens` has stem
    and num_tokens; a file without them gets null."""
    done = planned.filter("action IN ('rename', 'adopt') AND new_name LIKE '%.bin'")
    if there is not None:
        done = done.join(there.select(F.col("name").alias("new_name")).distinct(), "new_name", "left_semi")
    stemmed = done.withColumn("key", F.regexp_replace("new_name", r"\.bin$", "")).withColumn("p", parse_stem(F.col("key")))
    once = tokens.groupBy(F.col("stem").alias("key")).agg(F.max("num_tokens").alias("num_tokens"))
    rows = stemmed.join(once, "key", "left").select("doc_id", F.sha2("doc_id", 256).alias("sha256"), "p.layer", "p.scheme", "key", "num_tokens")
    return rows.distinct()


def migrate(spark: SparkSession, folder: str, ids: DataFrame, dry_run: bool = True) -> dict[str, int]:
    """Plans the new names of a folder's files against the manifest below it, renames them, and adds what was renamed or
    adopted to the manifest; a dry run only counts. A file that could not be renamed is an error and gets no row."""
    listing = lambda: spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    try:
        known = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException:
        known = spark.createDataFrame([], MANIFEST)
    planned = written_once(plan(listing(), ids, known))  # the folder changes under it
    done = apply(planned, folder, dry_run)
    if not dry_run:
        rows = entries(planned, num_tokens(spark, folder), listing()).withColumn("stored_at", F.unix_micros(F.current_timestamp()).cast("double") / 1e6)
        rows.write.mode("append").parquet(f"{folder}/manifest")
    return done


def apply(planned: DataFrame, folder: str, dry_run: bool = True) -> dict[str, int]:
    """Renames the files of a plan in a folder and counts actions and errors; a dry run only counts. Renaming goes through
    the driver, name by name, since a folder's names are what it changes."""
    done = {"rename": 0, "skip": 0, "adopt": 0, "error": 0}
    for row in planned.select("name", "action", "new_name").toLocalIterator():
        action = row["action"]
        if action == "rename" and not dry_run:
            try:
                os.rename(os.path.join(folder, row["name"]), os.path.join(folder, row["new_name"]))
            except OSError:
                action = "error"
        done[action] += 1
    return done
