"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch is a set of sorted buffers of `K` values; a buffer of level l stands for K * FAN**l values. When a level holds
FAN full buffers they collapse into one of the next level: of their merged values every FAN-th is kept, so each kept value
stands for FAN of that weight, and no rank moves by more than half the new weight. Every sketch carries the sum of these
halves (`err`), an exact bound of its rank error. Sketches merge by pooling their buffers level by level and collapsing
again, in any order; with n values the bound is about n * log_FAN(n / K) / (2 * K), and 0 up to K * FAN values.

Plan: repeated deliveries are looked for on their ids alone; a bitmap of fixed size says which rows may be repeated, and
only those are shuffled whole. Arrays are collapsed where they are, per task and group, and only sketches (bounded size)
move on. Sketches merge by a tree: first over as many branches as shuffles have partitions, then `FAN_IN` branches into
one until one is left, so that the depth grows with the cluster and no task gets more than its share of a hot group. Every
merge is a stream that holds one sketch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 4096
FAN = 8
FAN_IN = 16
#: Bits of the map of repeated ids; more ids than it can tell apart cost time only.
MARKS = 1 << 26
#: Groups that one task holds open at once; beyond it, its sketches go out and start anew.
OPEN_GROUPS = 512


class Sketch:
    """Buffers by level: {level: [sorted array of exactly k values]}; `rest` are values of weight one below a full buffer."""

    def __init__(self, k: int = K, fan: int = FAN):
        self.k, self.fan, self.n, self.err = k, fan, 0, 0.0
        self.rest: list[np.ndarray] = []
        self.rest_n = 0
        self.full: dict[int, list[np.ndarray]] = {}

    def add(self, values: np.ndarray) -> None:
        """Adds values of weight one, without NaN."""
        if not len(values):
            return
        self.n += len(values)
        self.rest.append(values)
        self.rest_n += len(values)
        if self.rest_n >= self.k * self.fan:
            pool = np.sort(np.concatenate(self.rest))
            whole = len(pool) // self.k
            # sorted once, cut into interleaved buffers, each of which is sorted again by construction
            for i in range(whole):
                self.full.setdefault(0, []).append(pool[i : whole * self.k : whole])
            self.rest, self.rest_n = [pool[whole * self.k :]], len(pool) - whole * self.k
            self._collapse()

    def _collapse(self) -> None:
        level = 0
        while level <= max(self.full, default=-1):
            buffers = self.full.get(level, [])
            while len(buffers) >= self.fan:
                group, buffers = buffers[: self.fan], buffers[self.fan :]
                merged = np.sort(np.concatenate(group))
                self.full.setdefault(level + 1, []).append(merged[self.fan // 2 :: self.fan])
                self.err += self.fan ** (level + 1) / 2
            self.full[level] = buffers
            level += 1

    def merge(self, other: Sketch) -> None:
        """Takes in another sketch of the same k and fan."""
        n = self.n + other.n
        self.err += other.err
        for level, buffers in other.full.items():
            self.full.setdefault(level, []).extend(buffers)
        self.add(np.concatenate(other.rest) if other.rest else np.empty(0))
        self.n = n
        self._collapse()

    def state(self) -> dict:
        """n, err, and the values with their weights, level by level."""
        levels = sorted(level for level, b in self.full.items() if b)
        rest = np.concatenate(self.rest) if self.rest else np.empty(0)
        parts = [rest, *(x for level in levels for x in self.full[level])]
        return {"n": self.n, "err": self.err, "sizes": [len(rest), *(len(self.full[level]) for level in levels)], "levels": [-1, *levels], "vals": np.concatenate(parts).astype("<f8").tobytes()}

    @classmethod
    def of(cls, n: int, err: float, sizes: list[int], levels: list[int], vals: bytes, k: int = K, fan: int = FAN) -> Sketch:
        s, flat = cls(k, fan), np.frombuffer(vals, "<f8")
        s.n, s.err = int(n), float(err)
        s.rest, s.rest_n, at = [flat[: sizes[0]]], int(sizes[0]), int(sizes[0])
        for level, count in zip(levels[1:], sizes[1:], strict=True):
            s.full[int(level)] = [flat[at + i * k : at + (i + 1) * k] for i in range(count)]
            at += count * k
        return s

    def quantiles(self, qs: list[float]) -> list[float | None]:
        """The values at rank ceil(q * n), at least 1; None without values."""
        if not self.n:
            return [None] * len(qs)
        state = self.state()
        values = np.frombuffer(state["vals"], "<f8")
        weights = np.concatenate([np.full(c if lv < 0 else c * self.k, float(self.fan ** max(lv, 0))) for lv, c in zip(state["levels"], state["sizes"], strict=True)])
        order = np.argsort(values, kind="stable")
        reach = np.cumsum(weights[order])
        ranks = [max(1, int(np.ceil(round(q * self.n, 6)))) for q in qs]
        return [float(values[order[min(int(np.searchsorted(reach, r)), len(order) - 1)]]) for r in ranks]


SKETCH = "n long, err double, sizes array<int>, levels array<int>, vals binary"


def _may_repeat(df: DataFrame, key: str) -> Column:
    """Over `df` joined to `_marks`: whether the bit of the row's key is set."""
    at = F.bitmap_bit_position(F.pmod(F.xxhash64(key), F.lit(MARKS)))
    byte = F.ascii(F.decode(F.substr("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return F.coalesce(F.expr("1") == F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)), F.lit(False)) & F.col(key).isNotNull()


def first_delivery(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per non-null `key`, the first by `order`; rows with a null key are all kept.

    The ids that stand more than once set bits of a map (at most MARKS / 2**15 rows of 4 kB, broadcast); rows whose bit is
    not set are passed on as they are, the others go through a window.
    """
    hashed = F.pmod(F.xxhash64(key), F.lit(MARKS))
    again = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = again.select(hashed.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))
    marked = df.withColumn("__bucket", F.bitmap_bucket_number(hashed)).join(F.broadcast(marks), "__bucket", "left").withColumn("__twice", _may_repeat(df, key))
    once = marked.filter(~F.col("__twice")).select(*df.columns)
    w = Window.partitionBy(key).orderBy(*order)
    first = marked.filter("__twice").select(*df.columns).withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")
    return once.unionByName(first)


def sketch_columns(df: DataFrame, groups: list[str], metrics: list[str], k: int = K, fan: int = FAN) -> DataFrame:
    """One sketch per task, group and metric: groups, metric, SKETCH. `metrics` are array<double> columns.

    Null arrays, null and NaN elements count as nothing; infinite, sentinel and outlying values count as they are. A null
    in a group column is a group of its own. An empty table gives no rows.
    """
    kept = df.select(*groups, *[F.col(m).cast("array<double>").alias(m) for m in metrics])
    fields = [f for f in kept.schema.fields if f.name in groups]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "metric string", SKETCH])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Sketch]] = {}
        kinds: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            rows = [(key, m, s.state()) for key, sketches in held.items() for m, s in zip(metrics, sketches, strict=True) if s.n]
            columns = [pa.array([key[i] for key, _, _ in rows], kinds[i]) for i in range(len(names))]
            columns.append(pa.array([m for _, m, _ in rows], pa.string()))
            for c, t in (("n", pa.int64()), ("err", pa.float64()), ("sizes", pa.list_(pa.int32())), ("levels", pa.list_(pa.int32())), ("vals", pa.binary())):
                columns.append(pa.array([s[c] for _, _, s in rows], t))
            return pa.RecordBatch.from_arrays(columns, [*names, "metric", "n", "err", "sizes", "levels", "vals"])

        for batch in batches:
            kinds = [batch.column(batch.schema.get_field_index(g)).type for g in names]
            keys = list(zip(*(batch.column(batch.schema.get_field_index(g)).to_pylist() for g in names), strict=True)) or [()] * batch.num_rows
            rows_of: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                rows_of.setdefault(key, []).append(i)
            for key, rows in rows_of.items():
                if key not in held:
                    if len(held) >= OPEN_GROUPS:
                        yield out()
                        held.clear()
                    held[key] = [Sketch(k, fan) for _ in metrics]
                part = batch.take(pa.array(rows))
                for m, s in zip(metrics, held[key], strict=True):
                    flat = part.column(part.schema.get_field_index(m)).flatten()
                    values = flat.drop_null().to_numpy(zero_copy_only=False).astype("float64")
                    s.add(values[~np.isnan(values)])
        if held:
            yield out()

    return kept.mapInArrow(run, schema)


def _merge_runs(df: DataFrame, keys: list[str], k: int, fan: int) -> DataFrame:
    """Rows with equal keys that follow each other in a partition merged to one; one sketch is held at a time."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None
        total, kinds = Sketch(k, fan), []

        def out() -> pa.RecordBatch:
            state = total.state()
            columns = [pa.array([v], t) for v, t in zip(open_, kinds, strict=True)]
            columns += [pa.array([state[c]], t) for c, t in (("n", pa.int64()), ("err", pa.float64()), ("sizes", pa.list_(pa.int32())), ("levels", pa.list_(pa.int32())), ("vals", pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, [*keys, "n", "err", "sizes", "levels", "vals"])

        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)) for c in [*keys, "n", "err", "sizes", "levels"]]
            kinds, vals = [c.type for c in own[: len(keys)]], batch.column(batch.schema.get_field_index("vals"))
            for i, row in enumerate(zip(*(c.to_pylist() for c in own), strict=True)):
                key = row[: len(keys)]
                if open_ is None or repr(key) != repr(open_):
                    if open_ is not None:
                        yield out()
                    open_, total = key, Sketch(k, fan)
                total.merge(Sketch.of(*row[len(keys) :], vals[i].as_py(), k, fan))
        if open_ is not None:
            yield out()

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), SKETCH]))


def merge_sketches(sketches: DataFrame, groups: list[str], k: int = K, fan: int = FAN, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per group (`groups` must include metric), merged as a tree over branches of each group. A null in a
    group column is a group of its own; no sketches give no rows."""
    width = max(1, int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    state = ["n", "err", "sizes", "levels", "vals"]
    level = sketches.select(*groups, F.pmod(F.xxhash64("vals", *groups), F.lit(width)).alias("__branch"), *state)
    while width > 1:
        keys = [*groups, "__branch"]
        level = _merge_runs(level.repartition(*keys).sortWithinPartitions(*keys, "n", F.xxhash64("vals")), keys, k, fan)
        width = -(-width // fan_in)
        level = level.withColumn("__branch", F.pmod(F.col("__branch"), F.lit(width)))
    level = level.select(*groups, *state)
    return _merge_runs(level.repartition(*groups).sortWithinPartitions(*groups, "n", F.xxhash64("vals")), groups, k, fan)


def read_quantiles(sketches: DataFrame, groups: list[str], qs: dict[str, float], k: int = K, fan: int = FAN) -> DataFrame:
    """groups, n, one column per name in `qs`, and max_rank_error: no value's rank is off by more than this share of n."""
    types = dict(sketches.dtypes)
    schema = ", ".join([*(f"`{g}` {types[g]}" for g in groups), "n long", *(f"`{q}` double" for q in qs), "max_rank_error double"])
    shares = list(qs.values())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [[*(r[g] for g in groups), r["n"], *Sketch.of(r["n"], r["err"], list(r["sizes"]), list(r["levels"]), r["vals"], k, fan).quantiles(shares), r["err"] / max(r["n"], 1)] for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*groups, "n", *qs, "max_rank_error"])

    return sketches.mapInPandas(run, schema)
