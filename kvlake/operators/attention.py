"""Softmax-weighted sums of values, on plain vectors and directly on packed ones.

Queries have `q_id`, `doc_id`, `layer`, `head`, `q`; a cache has `doc_id`, `layer`, `head`, `token` and plain or packed
vectors. Queries are joined to the tokens of their document, layer and head, over a salt of the token, so that a document
with a third of all tokens is spread over `SALTS` tasks where the join shuffles. Every task folds its pairs into one state
per query (largest logit, weight, weighted values); only states are shuffled, to be merged. On packed vectors a query is
turned once into the domain of the codes, before the join, and the merged result is turned back once.

A query without tokens gives no row; null vectors are left out, vectors of another length, NaN or infinite values raise;
repeated tokens count again; ties and extra columns need no care.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.functions.layouts import Config
from kvlake.functions.vectors import dot, halves
from kvlake.operators.schemes import lists, matrix, half, parts_of, scheme

ON = ["doc_id", "layer", "head"]
BY = ["q_id", *ON]
SALTS = 8

#: Of a batch of pairs, the logits and the values (in the domain that the states are kept in).
Read = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def select_group_heads(queries: DataFrame, query_heads: int, kv_heads: int) -> DataFrame:
    """Where several query heads share one head of the cache: the first of each group, under the cache's head."""
    if kv_heads < 1 or query_heads % kv_heads:
        raise ValueError("query heads must be a multiple of the cache's heads")
    groups = query_heads // kv_heads
    return queries.filter(F.col("head") % groups == 0).withColumn("head", F.floor(F.col("head") / groups).cast("int"))


def plain_logits(queries: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """q_id, doc_id, layer, head, token, logit: scalar products over sqrt(dim)."""
    pairs = queries.select("q_id", *ON, halves(F.col("q")).alias("q")).join(cache.select(*ON, "token", halves(F.col("k")).alias("k")), ON)
    return pairs.select(*BY, "token", (dot(F.col("q"), F.col("k")) / dim**0.5).alias("logit"))


def _paired(queries: DataFrame, cache: DataFrame, columns: list[str]) -> DataFrame:
    """Queries (with q) beside each token of their document, layer and head."""
    asked = queries.select("q_id", *ON, "q", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    tokens = cache.select(*ON, "token", *columns, F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int").alias("__salt"))
    return asked.join(tokens, [*ON, "__salt"]).drop("__salt")


def _heads(b: pa.RecordBatch) -> np.ndarray:
    return b.column(b.schema.get_field_index("head")).to_numpy(zero_copy_only=False).astype(np.int64)


def _doubles(b: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """Vectors of a column of this module's own, as rows."""
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _turned(queries: DataFrame, name: str, dim: int) -> DataFrame:
    """The queries in the domain of a scheme's codes, as array<double>."""
    s = scheme(name)
    kept = queries.filter(F.col("q").isNotNull()).select(*BY, "q")
    types = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = s.turn(matrix(b.column(len(BY)), dim, name), _heads(b))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(BY)], lists(q, pa.float64())], [*BY, "q"])

    return kept.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in BY), "q array<double>"]))


def packed_logits(queries: DataFrame, packed: DataFrame, name: str, dim: int) -> DataFrame:
    """q_id, doc_id, layer, head, token, logit, computed on the codes."""
    s = scheme(name)
    Config(dim=dim).check()
    pairs = _paired(_turned(queries, name, dim), packed, list(s.columns))
    types = dict(pairs.dtypes)
    own = [*BY, "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.select(own).columns, pa.array(_logits(b, name, dim))], [*own, "logit"])

    return pairs.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in own), "logit double"]))


def _logits(b: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    s = scheme(name)
    dots = (_doubles(b, "q", dim) * s.keys(parts_of(b, s.columns), dim)).sum(axis=1)
    return dots / dim**0.5 if s.scaled else dots


def _fold(keys: pa.RecordBatch, most: np.ndarray, w: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of one row each folded by key, in the order in which keys first come: a row of each key, and its state."""
    group = keys.to_pandas().groupby(keys.schema.names, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    top = np.maximum.reduceat(most[order], first)
    scale = np.exp(most[order] - np.repeat(top, np.diff(np.append(first, len(order)))))
    return order[first], top, np.add.reduceat(w[order] * scale, first), np.add.reduceat(acc[order] * scale[:, None], first, axis=0)


#: Merged states turned back: values and heads to the result.
Back = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _states(pairs: DataFrame, read: Read, by: list[str]) -> DataFrame:
    """by (BY among them), most, w, acc: the pairs of every task and batch folded to one state of a key."""
    types = dict(pairs.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                logits, values = read(b)
                yield _state(b, by, _fold(b.select(by), logits, np.ones(len(logits)), values))

    return pairs.mapInArrow(fold, ", ".join([*(f"{c} {types[c]}" for c in by), "most double, w double, acc array<double>"]))


def _state(b: pa.RecordBatch, by: list[str], folded: tuple) -> pa.RecordBatch:
    first, most, w, acc = folded
    return pa.RecordBatch.from_arrays([*b.select(by).take(pa.array(first)).columns, pa.array(most), pa.array(w), lists(acc, pa.float64())], [*by, "most", "w", "acc"])


def _merged(states: DataFrame, by: list[str], dim: int, backs: dict[str | None, Back], kind: str) -> DataFrame:
    """by, out (array of `kind`): states merged in the order of their keys, and turned back by the key's `scheme` (or the
    only way there is). A weight of zero counts as one."""
    types = dict(states.dtypes)

    def told(b: pa.RecordBatch) -> pa.RecordBatch:
        w = b.column(b.schema.get_field_index("w")).to_numpy()
        out, heads = _doubles(b, "acc", dim) / np.where(w > 0, w, 1.0)[:, None], _heads(b)
        names = b.column(b.schema.get_field_index("scheme")).to_pylist() if "scheme" in by else [None] * b.num_rows
        for name in set(names):
            own = np.array([n == name for n in names])
            out[own] = backs[name](out[own], heads[own])
        return pa.RecordBatch.from_arrays([*b.select(by).columns, lists(out, pa.float32() if kind == "float" else pa.float64())], [*by, "out"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last key's state, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            whole = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            merged = _state(whole, by, _fold(whole.select(by), *(whole.column(len(by) + i).to_numpy() for i in (0, 1)), _doubles(whole, "acc", dim)))
            if merged.num_rows > 1:
                yield told(merged.slice(0, merged.num_rows - 1))
            held = merged.slice(merged.num_rows - 1)
        if held is not None:
            yield told(held)

    return states.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, ", ".join([*(f"{c} {types[c]}" for c in by), f"out array<{kind}>"]))


def plain_attention(queries: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """q_id, doc_id, layer, head, out (array<double>), on vectors rounded to half precision."""
    kept = cache.filter(F.col("k").isNotNull() & F.col("v").isNotNull())
    pairs = _paired(queries.filter(F.col("q").isNotNull()), kept, ["k", "v"])

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        q, k, v = (matrix(b.column(b.schema.get_field_index(c)), dim, "plain") for c in ("q", "k", "v"))
        return (q * k).sum(axis=1) / dim**0.5, v

    return _merged(_states(pairs, read, BY), BY, dim, {None: lambda out, _: out}, "double")


def _packed_states(queries: DataFrame, packed: DataFrame, name: str, dim: int, by: list[str]) -> DataFrame:
    s = scheme(name)
    Config(dim=dim).check()
    pairs = _paired(_turned(queries, name, dim), packed, list(s.columns))
    if "scheme" in by:
        pairs = pairs.withColumn("scheme", F.lit(name))
    return _states(pairs, lambda b: (_logits(b, name, dim), s.values(parts_of(b, s.columns), dim)), by)


def _turned_back(name: str) -> Back:
    return lambda out, heads: half(scheme(name).turn_back(out, heads))


def packed_attention(queries: DataFrame, packed: DataFrame, name: str, dim: int) -> DataFrame:
    """q_id, doc_id, layer, head, out (array<float>, in half precision)."""
    return _merged(_packed_states(queries, packed, name, dim, BY), BY, dim, {None: _turned_back(name)}, "float")


def attention_error(queries: DataFrame, cache: DataFrame, packed: dict[str, DataFrame], dim: int, by: tuple[str, ...] = ()) -> DataFrame:
    """scheme, mse (and the columns `by` of doc_id, layer, head): the mean squared difference of packed from plain
    attention. The states of all schemes are merged together; plain attention is computed once, and joined to them."""
    if not packed:
        raise ValueError("no scheme given")
    plain = plain_attention(queries, cache, dim).select(*BY, F.col("out").alias("plain"))
    keys = [*BY, "scheme"]
    states = reduce(DataFrame.unionByName, [_packed_states(queries, table, name, dim, keys) for name, table in packed.items()])
    both = _merged(states, keys, dim, {name: _turned_back(name) for name in packed}, "float").join(plain, BY)
    squares = F.zip_with("out", "plain", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    each = both.select("scheme", *by, F.aggregate(squares, F.lit(0.0), lambda s, x: s + x).alias("sum"), F.size("out").alias("n"))
    return each.groupBy("scheme", *by).agg((F.sum("sum") / F.sum("n")).alias("mse"))
