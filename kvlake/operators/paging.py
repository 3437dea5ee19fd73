"""Token slots and pages: which page and offset a token has, by default and after appends, and pages as bytes."""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvlake.functions.layouts import Config, page_bytes, page_regions

BLOCK = 16
#: Ranges that a global order is cut into, at least, and the keys that are looked at for each.
RANGES, SAMPLE = 64, 16


def default_slots(cache: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds slot, page, offset: tokens of a document, layer and head in their order, from slot 0. A document's tokens are
    numbered in ranges, so one with a third of all is spread."""
    numbered = running_total(cache.withColumn("__one", F.lit(1).cast("long")), "__one", ["token"], "slot", within=("doc_id", "layer", "head"))
    return with_pages(numbered.drop("__one").withColumn("slot", F.col("slot").cast("int")), block)


def with_pages(slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds the page and the offset in it of every slot."""
    return slots.withColumn("page", F.floor(F.col("slot") / block).cast("int")).withColumn("offset", F.pmod(F.col("slot"), F.lit(block)).cast("int"))


def _bounds(df: DataFrame, order: list[str], parts: int) -> list[tuple]:
    """At most parts - 1 keys that cut the global order into ranges of about as many rows: of an even sample (the keys
    with the smallest hashes, `SAMPLE` for each range), every SAMPLE-th. The sample's size does not grow with the data."""
    keys = df.select(*order)
    sample = keys.orderBy(F.xxhash64(*order), *order).limit(parts * SAMPLE)
    return [tuple(r) for r in sample.orderBy(*order).collect()[SAMPLE::SAMPLE]]


def _range_of(df: DataFrame, order: list[str], bounds: list[tuple]) -> Column:
    """How many of the bounds are not above a row's key, a function of the key alone: counted among some bounds in
    equal steps, and then among those of one step."""
    types = dict(df.dtypes)
    one = len(order) == 1
    value = lambda key: F.lit(key[0]).cast(types[order[0]]) if one else F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, key, strict=True)])
    key = F.col(f"`{order[0]}`") if one else F.struct(*[F.col(f"`{c}`").alias(c) for c in order])
    reached = lambda keys: F.size(F.filter(keys, lambda b: (b <= key) | b.isNull()))  # noqa: E731  # nulls come first
    step = max(2, isqrt(len(bounds)))
    every, whole = bounds[step - 1 :: step], F.array(*map(value, bounds))
    if not every:
        return reached(whole)
    begun = reached(F.array(*map(value, every))) * step
    return begun + reached(F.slice(whole, begun + 1, F.lit(step)))


def running_total(df: DataFrame, value: str, order: list[str], out: str, parts: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of `value` over all rows before a row in a global order, or over those with the same `within` before it,
    without one task for all, or for all of a group: the order (by `within` first) is cut into ranges at fixed keys, ranges
    are summed where the rows are, by group too, and each row gets what comes before its range and its sum inside the
    range. A row's range is a function of its key, so both readings of the rows agree whatever is recomputed.

    Nulls in `value` count as 0, null keys come first and are a group. Rows with equal keys come in the order of a hash of
    all their columns; rows equal in all columns are told apart in no defined way. An empty table gives no rows. `parts`
    ranges, by default as many as shuffles have, from 64 to 4096.
    """
    parts = parts or min(max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 4096)
    keys = [*within, *order]
    bounds = _bounds(df, keys, parts)
    # a generated column, so that grouping by it does not depend on how its expression is rewritten
    ranged = df.select("*", F.explode(F.array(_range_of(df, keys, bounds) if bounds else F.lit(0))).alias("__part"))
    sums = ranged.groupBy("__part", *within).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", *within, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))  # a row for each range, and group in it
    ties = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    inside = Window.partitionBy("__part", *within).orderBy(*order, ties).rowsBetween(Window.unboundedPreceding, -1)
    if within:
        s = starts.select(*[F.col(c).alias(f"__in{i}") for i, c in enumerate(within)], F.col("__part").alias("__at"), "__start")
        joined = ranged.join(s, reduce(lambda x, y: x & y, [F.col("__part") == F.col("__at"), *(F.col(c).eqNullSafe(F.col(f"__in{i}")) for i, c in enumerate(within))]))
        joined = joined.drop("__at", *(f"__in{i}" for i in range(len(within))))
    else:
        joined = ranged.join(F.broadcast(starts), "__part")
    return joined.withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__part", "__start")


def block_table(appends: DataFrame, block: int = BLOCK) -> DataFrame:
    """seq_id, order, n, start, first_block, new_blocks: per append to a sequence, the tokens before it, the logical block
    that its first token falls into, and the blocks it takes anew. Appends have seq_id, order (unique in a sequence) and n;
    null and negative n count as 0. The appends of one sequence are summed in ranges, so one with a third of all is
    spread."""
    n = F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(0)).cast("long")
    before = running_total(appends.select("seq_id", "order", n.alias("n")), "n", ["order"], "start", within=("seq_id",))
    blocks = lambda tokens: F.ceil(tokens / F.lit(block)).cast("long")
    return before.withColumn("first_block", F.floor(F.col("start") / block).cast("long")).withColumn("new_blocks", blocks(F.col("start") + F.col("n")) - blocks(F.col("start")))


def physical_blocks(table: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """seq_id, logical, physical: blocks are handed out from 0 in the global order of the appends."""
    from_ = running_total(table.filter("new_blocks > 0"), "new_blocks", order, "taken")
    first_new = F.ceil(F.col("start") / F.lit(block)).cast("long")
    return from_.select("seq_id", first_new.alias("base"), "taken", F.explode(F.sequence(F.lit(0), F.col("new_blocks") - 1)).alias("k")).select(
        "seq_id", (F.col("base") + F.col("k")).alias("logical"), (F.col("taken") + F.col("k")).alias("physical")
    )


def slot_map(table: DataFrame, physical: DataFrame, block: int = BLOCK) -> DataFrame:
    """seq_id, order, token, slot: the slot of every appended token."""
    tokens = table.filter("n > 0").select("seq_id", "order", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("token"))
    at = tokens.withColumn("logical", F.floor(F.col("token") / block).cast("long")).join(physical, ["seq_id", "logical"])
    return at.select("seq_id", "order", "token", (F.col("physical") * block + F.pmod(F.col("token"), F.lit(block))).alias("slot"))


class OutOfBlocks(RuntimeError):
    """No block is free."""


class BlockPool:
    """Blocks handed out from the lowest, and again those that came back last."""

    def __init__(self, size: int):
        self.free = list(range(size - 1, -1, -1))

    def take(self) -> int:
        if not self.free:
            raise OutOfBlocks("no block is free")
        return self.free.pop()

    def give_back(self, block: int) -> None:
        self.free.append(block)


class BlockTable:
    """The blocks and lengths of sequences that grow; a request that cannot be met takes nothing."""

    def __init__(self, pool: BlockPool, block: int = BLOCK):
        self.pool, self.block = pool, block
        self.sequences: dict[object, tuple[list[int], int]] = {}

    def append(self, seq_id: object, n: int) -> list[int]:
        """The slots of n new tokens."""
        blocks, length = self.sequences.get(seq_id, ([], 0))
        need = -(-(length + n) // self.block) - len(blocks)
        if need > len(self.pool.free):
            raise OutOfBlocks(f"{need} blocks needed, {len(self.pool.free)} free")
        blocks = blocks + [self.pool.take() for _ in range(need)]
        self.sequences[seq_id] = (blocks, length + n)
        return [blocks[t // self.block] * self.block + t % self.block for t in range(length, length + n)]

    def state(self, seq_id: object) -> tuple[list[int], int]:
        """Blocks and length; KeyError for an unknown sequence."""
        return self.sequences[seq_id]

    def release(self, seq_id: object) -> None:
        for block in reversed(self.sequences.pop(seq_id)[0]):
            self.pool.give_back(block)


def pages(packed: DataFrame, name: str, config: Config) -> DataFrame:
    """doc_id, layer, page, bytes: packed rows (with slots) laid out as pages, region by region; cells without a token are
    zero. One group is one page, of at most block x heads rows."""
    config.check()
    regions, whole = page_regions(name, config), page_bytes(name, config)
    columns = {"k_codes": "k_codes", "k_scale": "k_scale", "k_residual": "k_residual", "v_codes": "v_codes", "v_scale": "v_scale", "k": "k_codes", "v": "v_codes"}
    types = dict(packed.dtypes)

    def lay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(whole, np.uint8)
        for r in rows.sort_values(["slot", "head"]).to_dict("records"):
            cell = (r["slot"] % config.block) * config.heads + r["head"]
            for region, (at, size) in regions.items():
                if region == "page":
                    continue
                value = r[columns[region]]
                raw = np.frombuffer(bytes(value), np.uint8) if columns[region].endswith("codes") else np.frombuffer(np.float16(value).tobytes(), np.uint8)
                each = size // (config.block * config.heads)
                out[at + cell * each : at + cell * each + len(raw)] = raw
        return pd.DataFrame([[*key, out.tobytes()]], columns=["doc_id", "layer", "page", "bytes"])

    return packed.groupBy("doc_id", "layer", "page").applyInPandas(lay, f"doc_id {types['doc_id']}, layer {types['layer']}, page int, bytes binary")
