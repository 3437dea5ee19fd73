"""Sizes: the configuration of a cache, the regions of a page under each scheme, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import ceil

SCHEMES = ("dense16", "absmax4", "mse4", "prod4", "sign1")


@dataclass(frozen=True)
class Config:
    """Tokens per page, heads, values per head, bits per code, values per scale, alignment of a region, bytes of a scale."""

    block: int = 16
    heads: int = 8
    dim: int = 128
    bits: int = 4
    group: int = 128
    align: int = 256
    scale_bytes: int = 2

    def check(self) -> Config:
        """Raises ValueError where vectors of this shape cannot be rotated or coded."""
        if self.dim < 1 or self.dim & (self.dim - 1) or self.dim > 128:
            raise ValueError(f"dim must be a power of two up to 128, not {self.dim}")
        if self.bits != 4:
            raise ValueError("codes have four bits")
        if min(self.block, self.heads) < 1:
            raise ValueError("block and heads must be positive")
        return self

    def with_shape(self, heads: int, dim: int) -> Config:
        return replace(self, heads=heads, dim=dim, group=dim)


def align_up(n: int, to: int) -> int:
    return -(-n // to) * to


def packed_bytes(values: int, bits: int) -> int:
    """Bytes of `values` codes."""
    return -(-values * bits // 8)


def _cells(scheme: str, c: Config) -> tuple[int, list[tuple[str, int]]]:
    """The alignment, and each region's bytes for one token and head, in their order in a page."""
    four, one = packed_bytes(c.dim, 4), packed_bytes(c.dim, 1)
    if scheme == "dense16":
        return c.align, [("k", 2 * c.dim), ("v", 2 * c.dim)]
    if scheme == "absmax4":
        if c.bits != 4 or c.group != c.dim:
            raise ValueError("absmax4 needs four bits and one scale for each vector")
        return c.align, [("k_codes", four), ("v_codes", four), ("k_scale", c.scale_bytes), ("v_scale", c.scale_bytes)]
    if scheme == "mse4":
        return c.align, [("k_codes", packed_bytes(c.dim, c.bits)), ("v_codes", packed_bytes(c.dim, c.bits)), ("k_scale", 2), ("v_scale", 2)]
    if scheme == "prod4":
        return 2, [("k_codes", four), ("k_residual", 2), ("k_scale", 2), ("v_codes", four), ("v_scale", 2)]
    if scheme == "sign1":
        return 2, [("k_codes", one), ("k_scale", 2), ("v_codes", four), ("v_scale", 2)]
    raise ValueError(f"unknown scheme {scheme!r}; known are {', '.join(SCHEMES)}")


def page_regions(scheme: str, config: Config) -> dict[str, tuple[int, int]]:
    """Region to (offset, bytes), in their order; the key `page` holds (0, bytes of the page)."""
    align, cells = _cells(scheme, config)
    at, out = 0, {}
    for name, each in cells:
        size = config.block * config.heads * each
        out[name] = (at, size)
        at = align_up(at + size, align)
    return out | {"page": (0, at)}


def page_bytes(scheme: str, config: Config) -> int:
    return page_regions(scheme, config)["page"][1]


def cell_offset(scheme: str, config: Config, region: str, slot: int, head: int) -> int:
    """Where the cell of a slot and head begins in a pool of pages."""
    align, cells = _cells(scheme, config)
    page, token = divmod(slot, config.block)
    return page * page_bytes(scheme, config) + page_regions(scheme, config)[region][0] + (token * config.heads + head) * dict(cells)[region]


def dense_bytes(tokens: int, config: Config) -> int:
    """Bytes of keys and values at two bytes a value, without pages."""
    return tokens * config.heads * config.dim * 4


def pool_bytes(tokens: int, scheme: str, config: Config) -> int:
    """Bytes of the pages that so many tokens take."""
    return ceil(tokens / config.block) * page_bytes(scheme, config)


def cache_mb(tokens: int, layers: int, scheme: str, config: Config) -> float:
    """MB (2**20) of a document over all layers."""
    return layers * (dense_bytes(tokens, config) if scheme == "dense16" else pool_bytes(tokens, scheme, config)) / 2**20


def ratio(part: float, whole: float) -> float:
    """whole / part, with a part of zero counted as one."""
    return whole / max(part, 1)


def summary(tokens: int, config: Config, rounded: Callable[[float], float] = lambda x: round(x, 2)) -> dict[str, dict[str, float]]:
    """Per scheme the bytes for so many tokens and their ratio to dense ones."""
    whole = dense_bytes(tokens, config)
    return {s: {"bytes": (b := whole if s == "dense16" else pool_bytes(tokens, s, config)), "ratio": rounded(ratio(b, whole))} for s in SCHEMES}
