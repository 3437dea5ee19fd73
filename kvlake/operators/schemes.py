"""Packing and restoring key and value vectors, scheme by scheme.

A cache table has one row per token and head: keys (any columns, `head` among them), `k` and `v` (arrays of DIM floats).
Packed, it has `k_codes`, `k_scale`, `k_residual`, `v_codes`, `v_scale` instead, where a scheme has them. Codes are
binary, scales doubles that half precision holds. All of it is one narrow pass: whole Arrow batches as matrices, the
rotation one product with a DIM x DIM matrix. Null vectors stay null; vectors of another length, NaN or infinite values
raise ValueError, which names the scheme.

- dense16: values in half precision.
- absmax4: no rotation; signed nibbles, scale from the largest magnitude.
- mse4: rotated, 16 levels over the root mean square.
- prod4: keys rotated, 8 levels and the sign of the residual in one nibble, with the residual's own scale; values as mse4.
- sign1: keys rotated with the signs of head 0, one bit each; values as mse4.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.functions.codebook import CLAMP_K, CLAMP_V, FLOOR, LEVELS8, LEVELS16, midpoints
from kvlake.functions.layouts import Config

Parts = dict[str, np.ndarray]

_MID8, _MID16 = np.array(midpoints(LEVELS8)), np.array(midpoints(LEVELS16))
_LEVELS8, _LEVELS16 = np.array(LEVELS8), np.array(LEVELS16)


def half(x: np.ndarray) -> np.ndarray:
    """Rounded to half precision, as doubles."""
    with np.errstate(over="ignore"):
        return x.astype(np.float16).astype(np.float64)


def rotation(dim: int) -> np.ndarray:
    """The normalised Walsh-Hadamard matrix."""
    Config(dim=dim).check()
    h = np.ones((1, 1))
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return h / dim**0.5


def signs(heads: np.ndarray, dim: int) -> np.ndarray:
    return 1.0 - 2.0 * ((heads[:, None] + np.arange(dim)) % 2)


def rotate(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return (x * signs(heads, x.shape[1])) @ rotation(x.shape[1])


def unrotate(y: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return (y @ rotation(y.shape[1])) * signs(heads, y.shape[1])


def _rms(y: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt((y * y).mean(axis=1)), FLOOR)


def pack_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes as rows of bytes, the first code in the lowest bits."""
    each = 8 // bits
    padded = np.zeros((len(codes), -(-codes.shape[1] // each) * each), np.uint8)
    padded[:, : codes.shape[1]] = codes
    return (padded.reshape(len(codes), -1, each) << (bits * np.arange(each, dtype=np.uint8))).sum(axis=2).astype(np.uint8)


def unpack_bits(packed: np.ndarray, bits: int, dim: int) -> np.ndarray:
    each = 8 // bits
    return ((packed[:, :, None] >> (bits * np.arange(each, dtype=np.uint8))) & ((1 << bits) - 1)).reshape(len(packed), -1)[:, :dim]


def _pack16(y: np.ndarray, limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    scale = _rms(y)
    z = y / scale[:, None]
    if limit is not None:
        z = np.clip(z, -limit, limit)
    return pack_bits(np.searchsorted(_MID16, z, "left"), 4), half(scale)


def _restore16(codes: np.ndarray, scale: np.ndarray, dim: int) -> np.ndarray:
    return _LEVELS16[unpack_bits(codes, 4, dim)] * scale[:, None]


def _pack_absmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.maximum(np.abs(x).max(axis=1) / 7, FLOOR)
    q = np.clip(np.rint(x / scale[:, None]), -8, 7).astype(np.int8)
    return pack_bits((q & 15).astype(np.uint8), 4), half(scale)


def _restore_absmax(codes: np.ndarray, scale: np.ndarray, dim: int) -> np.ndarray:
    q = unpack_bits(codes, 4, dim).astype(np.int16)
    return np.where(q >= 8, q - 16, q) * scale[:, None]


def _dense_pack(k: np.ndarray, v: np.ndarray, heads: np.ndarray) -> Parts:
    return {"k_codes": k.astype("<f2").view(np.uint8), "v_codes": v.astype("<f2").view(np.uint8)}


def _dense_restore(p: Parts, heads: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(p[c]).view("<f2").astype(np.float64) for c in ("k_codes", "v_codes"))


def _absmax_pack(k: np.ndarray, v: np.ndarray, heads: np.ndarray) -> Parts:
    (kc, ks), (vc, vs) = _pack_absmax(k), _pack_absmax(v)
    return {"k_codes": kc, "k_scale": ks, "v_codes": vc, "v_scale": vs}


def _mse_pack(k: np.ndarray, v: np.ndarray, heads: np.ndarray) -> Parts:
    (kc, ks), (vc, vs) = _pack16(rotate(k, heads)), _pack16(rotate(v, heads))
    return {"k_codes": kc, "k_scale": ks, "v_codes": vc, "v_scale": vs}


def _prod_pack(k: np.ndarray, v: np.ndarray, heads: np.ndarray) -> Parts:
    y = rotate(k, heads)
    scale = _rms(y)
    z = np.clip(y / scale[:, None], -CLAMP_K, CLAMP_K)
    c = np.searchsorted(_MID8, z, "left")
    e = z - _LEVELS8[c]
    vc, vs = _pack16(rotate(v, heads), CLAMP_V)
    return {"k_codes": pack_bits((e >= 0) * 8 + c, 4), "k_residual": half(_rms(e)), "k_scale": half(scale), "v_codes": vc, "v_scale": vs}


def _sign_pack(k: np.ndarray, v: np.ndarray, heads: np.ndarray) -> Parts:
    y = rotate(k, np.zeros_like(heads))
    vc, vs = _pack16(rotate(v, np.zeros_like(heads)), CLAMP_V)
    return {"k_codes": pack_bits(y >= 0, 1), "k_scale": half(_rms(y)), "v_codes": vc, "v_scale": vs}


def _prod_keys(p: Parts, dim: int) -> np.ndarray:
    n = unpack_bits(p["k_codes"], 4, dim)
    return (_LEVELS8[n & 7] + p["k_residual"][:, None] * (2.0 * (n >> 3) - 1)) * p["k_scale"][:, None]


def _sign_keys(p: Parts, dim: int) -> np.ndarray:
    return (2.0 * unpack_bits(p["k_codes"], 1, dim) - 1) * p["k_scale"][:, None]


@dataclass(frozen=True)
class Scheme:
    """How a scheme packs, and how it gives keys and values back in the domain it keeps them in. `rotated`: by head,
    with the signs of head 0 (`shared`), or not at all; `scaled`: whether logits are divided by sqrt(DIM)."""

    columns: tuple[str, ...]
    pack: Callable[[np.ndarray, np.ndarray, np.ndarray], Parts]
    keys: Callable[[Parts, int], np.ndarray]
    values: Callable[[Parts, int], np.ndarray]
    rotated: str
    scaled: bool = True

    def turn(self, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Into the domain that keys and values are kept in."""
        return x if self.rotated == "no" else rotate(x, heads if self.rotated == "by head" else np.zeros_like(heads))

    def turn_back(self, y: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return y if self.rotated == "no" else unrotate(y, heads if self.rotated == "by head" else np.zeros_like(heads))


def _values16(p: Parts, dim: int) -> np.ndarray:
    return _restore16(p["v_codes"], p["v_scale"], dim)


_PLAIN = ("k_codes", "k_scale", "v_codes", "v_scale")
SCHEMES: dict[str, Scheme] = {
    "dense16": Scheme(("k_codes", "v_codes"), _dense_pack, lambda p, d: _dense_restore(p, None, d)[0], lambda p, d: _dense_restore(p, None, d)[1], "no"),
    "absmax4": Scheme(_PLAIN, _absmax_pack, lambda p, d: _restore_absmax(p["k_codes"], p["k_scale"], d), lambda p, d: _restore_absmax(p["v_codes"], p["v_scale"], d), "no"),
    "mse4": Scheme(_PLAIN, _mse_pack, lambda p, d: _restore16(p["k_codes"], p["k_scale"], d), _values16, "by head"),
    "prod4": Scheme(("k_codes", "k_residual", "k_scale", "v_codes", "v_scale"), _prod_pack, _prod_keys, _values16, "by head"),
    "sign1": Scheme(_PLAIN, _sign_pack, _sign_keys, _values16, "shared", scaled=False),
}
COLUMNS = ("k_codes", "k_scale", "k_residual", "v_codes", "v_scale")


def scheme(name: str) -> Scheme:
    """The scheme of a name; ValueError for an unknown one."""
    if name not in SCHEMES:
        raise ValueError(f"unknown scheme {name!r}; known are {', '.join(SCHEMES)}")
    return SCHEMES[name]


def matrix(column: pa.Array, dim: int, what: str) -> np.ndarray:
    """Vectors of an Arrow column as rows."""
    flat = column.flatten()
    if len(flat) != len(column) * dim or flat.null_count or any(n != dim for n in column.value_lengths().unique().to_pylist()):
        raise ValueError(f"{what}: every vector must have {dim} values and no nulls")
    out = half(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
    if not np.isfinite(out).all():
        raise ValueError(f"{what}: vectors must be finite in half precision")
    return out


def parts_of(batch: pa.RecordBatch, names: tuple[str, ...]) -> Parts:
    """The packed columns of a batch: codes as rows of bytes, scales as doubles."""
    out: Parts = {}
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        if name.endswith("codes"):
            joined = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            out[name] = joined.reshape(len(column), -1) if len(column) else joined.reshape(0, 1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False).astype(np.float64)
    return out


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    n, dim = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _keyed(df: DataFrame, drop: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in drop]


def pack(df: DataFrame, name: str, dim: int) -> DataFrame:
    """The table with `k` and `v` packed under a scheme; it has a column for each of COLUMNS, null where the scheme has no
    use for it. Rows with a null vector are left out."""
    s = scheme(name)
    Config(dim=dim).check()
    keys = _keyed(df, ("k", "v", *COLUMNS))
    kept = df.filter(F.col("k").isNotNull() & F.col("v").isNotNull()).select(*keys, "k", "v", F.col("head").cast("int").alias("__head"))
    types = dict(kept.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), *(f"{c} {'binary' if c.endswith('codes') else 'double'}" for c in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k, v = (matrix(b.column(b.schema.get_field_index(c)), dim, name) for c in ("k", "v"))
            p = s.pack(k, v, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64))
            packed = [pa.nulls(b.num_rows, pa.binary() if c.endswith("codes") else pa.float64()) if c not in p else _bytes(p[c]) if c.endswith("codes") else pa.array(p[c], pa.float64()) for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *packed], [*keys, *COLUMNS])

    return kept.mapInArrow(run, schema)


def restore(df: DataFrame, name: str, dim: int) -> DataFrame:
    """The table with `k` and `v` (array<float>, rounded to half precision) in place of the packed columns."""
    s = scheme(name)
    Config(dim=dim).check()
    keys = _keyed(df, ("k", "v", *COLUMNS))
    kept = df.select(*keys, *s.columns, F.col("head").cast("int").alias("__head"))
    types = dict(kept.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "k array<float>", "v array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            heads = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            p = parts_of(b, s.columns)
            k, v = (half(s.turn_back(x, heads)) for x in (s.keys(p, dim), s.values(p, dim)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), lists(k, pa.float32()), lists(v, pa.float32())], [*keys, "k", "v"])

    return kept.mapInArrow(run, schema)
