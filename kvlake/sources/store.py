"""The store of packed caches: Parquet partitioned by scheme and layer, with an append-only manifest.

`<root>/entries` holds the packed rows (doc_id, head, token, codes and scales) under scheme, layer and version, so that a
scheme and layer is a folder and a document is found by Parquet statistics (rows are sorted by doc_id in each file). Every
call that packs is a version. `<root>/manifest` holds one row per packed document, layer, scheme and version: doc_id,
sha256 (of the id), layer, scheme, key, num_tokens, stored_at. Nothing is rewritten in place: the latest row of a document,
layer and scheme stands, and with it the rows of its version; rows of versions without a manifest row do not count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kvlake.functions import text as T
from kvlake.functions.layouts import Config, cache_mb
from kvlake.operators import attention, schemes

ENTRY = "doc_id string, head int, token int, k_codes binary, k_scale double, k_residual double, v_codes binary, v_scale double, scheme string, layer int, version string"
MANIFEST = "doc_id string, sha256 string, layer int, scheme string, key string, num_tokens int, stored_at double"
#: The manifest of a store; rows that name files of their own have no version.
STORED = f"{MANIFEST}, version string"
MANIFEST_JSON = "struct<v:int,entries:map<string,struct<sha256:string,layers:map<string,struct<key:string,num_tokens:int,stored_at:double>>>>>"
ID = ["doc_id", "layer", "scheme"]


class StoreError(RuntimeError):
    """The manifest and the store do not agree."""


def manifest_from_json(content: Column) -> Column:
    """A manifest in JSON as a struct; null, or no JSON, gives an empty one of version 1."""
    empty = F.from_json(F.lit('{"v":1,"entries":{}}'), MANIFEST_JSON)
    parsed = F.from_json(content, MANIFEST_JSON)
    return F.when(parsed["entries"].isNotNull(), parsed).otherwise(empty)


def manifest_rows(manifest: DataFrame, entries: str = "entries", keys: tuple[str, ...] = ()) -> DataFrame:
    """Flat rows (keys, doc_id, sha256, layer, scheme, key, num_tokens, stored_at) of nested manifests. A layer key that is
    not `layer::scheme` gives a null layer."""
    docs = manifest.select(*keys, F.explode(entries).alias("doc_id", "e"))
    flat = docs.select(*keys, "doc_id", F.col("e.sha256").alias("sha256"), F.explode("e.layers").alias("lk", "s"))
    return flat.select(*keys, "doc_id", "sha256", F.expr("try_cast(split(lk, '::')[0] as int)").alias("layer"), F.expr("get(split(lk, '::'), 1)").alias("scheme"), "s.key", "s.num_tokens", "s.stored_at")


def missing_layers(docs: DataFrame, registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """store_name, doc_id, layer, scheme that is not stored: of each document (doc_id) every layer and scheme of the
    registry (layer_key, layer, scheme) that a store naming the document has in none of its manifests, and all of them,
    with a null store, where no store names it. Layer keys match only if exactly equal.

    Plan: manifests shrink to one set of keys per store and document before the join; the registry goes along as one row.
    """
    held = manifest.select("store_name", F.explode("entries").alias("doc_id", "e")).select("store_name", "doc_id", F.coalesce(F.map_keys("e.layers"), F.array().cast("array<string>")).alias("keys"))
    held = held.groupBy("store_name", "doc_id").agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"))
    wanted = registry.agg(F.collect_set(F.struct("layer_key", "layer", "scheme")).alias("wanted"))
    each = docs.distinct().join(held, "doc_id", "left").crossJoin(F.broadcast(wanted))
    lacking = F.filter("wanted", lambda w: ~F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), w["layer_key"]))
    return each.select("store_name", "doc_id", F.explode(lacking).alias("w")).select("store_name", "doc_id", "w.layer", "w.scheme")


def latest(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of the rows of one document, layer and scheme the one stored last (of equal times the one with the greatest key)."""
    keys = keys or ID
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.coalesce("stored_at", F.lit(float("-inf"))).alias("__at"), *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def status(rows: DataFrame) -> DataFrame:
    """Adds `status`: `ok`, `wrong_hash` (the hash stored is not that of the id) or `wrong_key` (the key is not the one
    computed). A null hash or key is wrong."""
    good_hash = F.coalesce(F.col("sha256") == F.sha2("doc_id", 256), F.lit(False))
    good_key = F.coalesce(F.col("key") == T.store_key(F.col("doc_id"), F.col("layer"), F.col("scheme")), F.lit(False))
    return rows.withColumn("status", F.when(~good_hash, "wrong_hash").when(~good_key, "wrong_key").otherwise("ok"))


class Store:
    """A store below `root`, for vectors of `dim` values."""

    def __init__(self, spark: SparkSession, root: str, dim: int):
        Config(dim=dim).check()
        self.spark, self.root, self.dim = spark, root, dim

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{what}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def entries(self, scheme: str | None = None, layer: int | None = None) -> DataFrame:
        """Packed rows; a scheme or layer is read from its folder alone."""
        rows, known = self._read("entries", ENTRY), self._read("manifest", STORED)
        if scheme is not None:
            schemes.scheme(scheme)
            rows, known = (x.filter(F.col("scheme") == scheme) for x in (rows, known))
        if layer is not None:
            rows, known = (x.filter(F.col("layer") == layer) for x in (rows, known))
        versions = known.select("version").distinct()  # one row for each call that packed
        standing = latest(known).select(*ID, "version")
        replaced = known.select(*ID, "version").filter("version IS NOT NULL").join(standing.select(*ID, F.col("version").alias("__stands")), ID).filter(~F.col("version").eqNullSafe(F.col("__stands"))).select(*ID, "version")
        return rows.join(versions, "version", "left_semi").join(replaced, [*ID, "version"], "left_anti").drop("version")

    def manifest(self) -> DataFrame:
        return latest(self._read("manifest", STORED)).drop("version")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Of rows with doc_id, layer and scheme those that are not stored, by the manifest alone."""
        return wanted.join(self._read("manifest", MANIFEST).select(*ID).distinct(), ID, "left_anti")

    def exists(self, doc_id: str, layer: int, scheme: str) -> bool:
        return not self.entries(scheme, layer).filter(F.col("doc_id") == doc_id).isEmpty()

    def pack(self, cache: DataFrame, scheme: str, overwrite: bool = False) -> int:
        """Packs and stores a cache (doc_id, layer, head, token, k, v) and returns the number of documents and layers
        stored. What is stored already is left alone; with `overwrite` its new version stands from then on. The rows are
        written first and the manifest after them: of an interrupted call nothing counts as stored, and it can be repeated."""
        schemes.scheme(scheme)
        version = uuid.uuid4().hex
        own = cache.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("layer").cast("int").alias("layer"), F.col("head").cast("int").alias("head"), F.col("token").cast("int").alias("token"), "k", "v")
        if not overwrite:
            ids = own.select("doc_id", "layer").distinct().withColumn("scheme", F.lit(scheme))
            own = own.join(self.missing(ids).drop("scheme"), ["doc_id", "layer"], "left_semi")
        packed = schemes.pack(own, scheme, self.dim).withColumn("scheme", F.lit(scheme)).withColumn("version", F.lit(version))
        packed.sortWithinPartitions("doc_id", "head", "token").write.mode("append").partitionBy("scheme", "layer", "version").parquet(f"{self.root}/entries")
        written = self._read("entries", ENTRY).filter((F.col("scheme") == scheme) & (F.col("version") == version))
        rows = written.groupBy("doc_id", "layer").agg((F.max("token") + 1).alias("num_tokens")).select(
            "doc_id", F.sha2("doc_id", 256).alias("sha256"), "layer", F.lit(scheme).alias("scheme"), T.store_key(F.col("doc_id"), F.col("layer"), F.lit(scheme)).alias("key"),
            "num_tokens", (F.unix_micros(F.current_timestamp()).cast("double") / 1e6).alias("stored_at"), F.lit(version).alias("version"),
        )
        rows.write.mode("append").parquet(f"{self.root}/manifest")
        return self._read("manifest", STORED).filter(F.col("version") == version).count()

    def verify(self, strict: bool = False) -> DataFrame:
        """The manifest's rows with their status; `strict` raises StoreError if one is not ok."""
        rows = status(self.manifest())
        if strict and (bad := rows.filter("status <> 'ok'").first()):
            raise StoreError(f"{bad['doc_id']}, layer {bad['layer']}, {bad['scheme']}: {bad['status']}")
        return rows

    def load(self, doc_id: str, layer: int, scheme: str) -> DataFrame:
        """Packed rows of one document and layer. FileNotFoundError if it is not stored, StoreError if its manifest row,
        where there is one, does not agree."""
        rows = self.entries(scheme, layer).filter(F.col("doc_id") == doc_id)
        own = (F.col("doc_id") == doc_id) & (F.col("layer") == layer) & (F.col("scheme") == scheme)
        if bad := status(self.manifest().filter(own)).filter("status <> 'ok'").first():
            raise StoreError(f"{doc_id}: {bad['status']}")
        if rows.isEmpty():
            raise FileNotFoundError(f"{doc_id}, layer {layer}, {scheme} is not stored")
        return rows

    def restore(self, doc_id: str, layer: int, scheme: str) -> DataFrame:
        """head, token, k, v of one document and layer."""
        return schemes.restore(self.load(doc_id, layer, scheme), scheme, self.dim)

    def dynamic_cache(self, doc_id: str, layers: int, scheme: str) -> DataFrame:
        """layer, head, keys, values (arrays of vectors in token order): the layers below `layers` that are stored. One
        group is one head's tokens of one document."""
        return self._heads(self.entries(scheme).filter((F.col("doc_id") == doc_id) & (F.col("layer") < layers)), scheme).drop("doc_id")

    def dynamic_caches(self, layers: int, scheme: str) -> DataFrame:
        """The same of every document, with its doc_id."""
        return self._heads(self.entries(scheme).filter(F.col("layer") < layers), scheme)

    def _heads(self, rows: DataFrame, scheme: str) -> DataFrame:
        whole = schemes.restore(rows, scheme, self.dim)
        ordered = whole.groupBy("doc_id", "layer", "head").agg(F.sort_array(F.collect_list(F.struct("token", "k", "v"))).alias("x"))
        return ordered.select("doc_id", "layer", "head", F.col("x.k").alias("keys"), F.col("x.v").alias("values"))

    def attend(self, queries: DataFrame, scheme: str) -> DataFrame:
        """Attention on the stored codes; queries have q_id, doc_id, layer, head, q. ValueError for an unknown scheme."""
        return attention.packed_attention(queries, self.entries(scheme), scheme, self.dim)

    def sizes(self, heads: int) -> DataFrame:
        """doc_id, scheme, kv_mb over the stored layers, from the manifest alone."""
        config = Config().with_shape(heads, self.dim)
        per_page = {s: cache_mb(config.block, 1, s, config) for s in schemes.SCHEMES}
        each = F.lit(0.0)
        for name, mb in per_page.items():
            units = F.col("num_tokens") / config.block if name == "dense16" else F.ceil(F.col("num_tokens") / config.block)
            each = F.when(F.col("scheme") == name, units * mb).otherwise(each)
        return self.manifest().groupBy("doc_id", "scheme").agg(F.sum(each).alias("kv_mb"))
