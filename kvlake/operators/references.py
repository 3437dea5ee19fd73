"""References to records that do not exist.

A manifest names corpus ids, registry keys and stored files. `references` turns it into one row per reference,
`parent_keys` reduces each parent table to one row per key, and `orphans` finds the references that hold no more.

Plan: the references are first reduced to distinct keys (partial aggregation before the shuffle, so a key that a third
of all references share costs one row per map task). A left anti-join of these keys against the parent keys gives the
missing ones, an inner join the ended and late ones. Only keys that are broken are joined back to the references, over a
salt, so that one broken key that very many references share is spread over `SALTS` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks over which the references to one broken key are spread when they are joined back.
SALTS = 16


def references(manifest: DataFrame) -> DataFrame:
    """One row per reference: manifest_id, doc_id, layer_key, ref_table, ref_key, stored_at (seconds, double).

    A null or empty `entries` gives none; an entry with null or empty layers gives only its reference to the corpus,
    with a null stored_at; a null `key` gives no reference to a file. Columns beyond manifest_id and entries are ignored.
    """
    entry = manifest.select("manifest_id", F.explode("entries").alias("doc_id", "entry"))
    first_stored = F.array_min(F.transform(F.map_values(F.col("entry.layers")), lambda x: x["stored_at"]))

    def ref(table: str, layer: Column, key: Column, stored: Column) -> Column:
        return F.struct(F.lit(table).alias("ref_table"), layer.alias("layer_key"), key.alias("ref_key"), stored.alias("stored_at"))

    at_layer = F.transform(
        F.map_entries(F.col("entry.layers")),
        lambda e: F.array(
            ref("layer_registry", e["key"], e["key"], e["value"]["stored_at"]),
            ref("store_files", e["key"], e["value"]["key"], e["value"]["stored_at"]),
        ),
    )
    own = F.array(ref("corpus", F.lit(""), F.col("doc_id"), first_stored))
    none = F.filter(own, lambda _: F.lit(False))
    refs = F.concat(own, F.coalesce(F.flatten(at_layer), none))
    return entry.select("manifest_id", "doc_id", F.inline(refs)).filter(F.col("ref_key").isNotNull()).select(
        "manifest_id", "doc_id", "layer_key", "ref_table", "ref_key", "stored_at"
    )


def parent_keys(parent: DataFrame, table: str, key: str, start: str, end: str) -> DataFrame:
    """One row per non-null key of a parent table: ref_table, ref_key, live (a row without an end exists), live_from
    (the earliest start among these rows, in seconds; null if none of them has a start)."""
    live = F.col(end).isNull()
    return (
        parent.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("ref_key"))
        .agg(F.max(live).alias("live"), (F.min(F.when(live, F.unix_micros(F.col(start).cast("timestamp")))) / 1e6).alias("live_from"))
        .select(F.lit(table).alias("ref_table"), "ref_key", "live", "live_from")
    )


def orphans(refs: DataFrame, parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """The references that do not hold: manifest_id, doc_id, layer_key, ref_table, status, stored_at.

    status is `missing` if the parent table has no row with the key, `deleted` if all its rows have an end, `late` if the
    earliest start among the rows without an end lies after the reference's stored_at (never if stored_at is null).
    Repeated references stay repeated; an empty parent table makes every reference to it `missing`.
    """
    keys = refs.groupBy("ref_table", "ref_key").agg(F.min("stored_at").alias("first_stored_at"))
    on = ["ref_table", "ref_key"]
    missing = keys.join(parents, on, "left_anti").select(*on, F.lit("missing").alias("bad"), F.lit(None).cast("double").alias("live_from"))
    known = keys.join(parents, on).filter(~F.col("live") | (F.col("live_from") > F.col("first_stored_at")))
    ended = known.select(*on, F.when(F.col("live"), F.lit("late")).otherwise(F.lit("deleted")).alias("bad"), F.when(F.col("live"), F.col("live_from")).alias("live_from"))
    broken = missing.unionByName(ended).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("manifest_id", "doc_id", "layer_key"), F.lit(salts)).cast("int"))
    hit = salted.join(broken, [*on, "salt"]).filter((F.col("bad") != "late") | (F.col("live_from") > F.col("stored_at")))
    return hit.select("manifest_id", "doc_id", "layer_key", "ref_table", F.col("bad").alias("status"), "stored_at")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per ref_table, month of stored_at (null where unknown) and status, with the number of distinct documents."""
    month = F.date_format(F.timestamp_micros((F.col("stored_at") * 1e6).cast("long")), "yyyy-MM")
    per_doc = found.groupBy("ref_table", month.alias("month"), "status", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("ref_table", "month", "status").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_docs"))
