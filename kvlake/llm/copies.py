"""Duplicates hidden by formatting differences.

A record becomes a compact tuple of integers: its text is read as a set of fields where it is one, else as one value. Every
value has an entry in a dictionary: it is canonicalised and numbered once for each worker (short values, as names and
values of fields are, stay in the worker's dictionary of at most `ENTRIES` entries; a whole text is looked up in its
batch). A value's number is the 128-bit hash of its canonical form, as two integers: so the dictionaries of all workers
agree without being exchanged, and no record has to be joined to one. The sorted distinct numbers of the fields are the
tuple that records are grouped by, whatever their number. Texts never enter a shuffle.

Plan: one pass over the texts in Arrow batches, whose tuples are written to the shared folder (some 40 bytes a record) for
the counting and for the way back to the records; groups are aggregated per (tuple, salt), then per tuple, and the smallest seq comes back over the
salt, so a group with a third of all records is spread over `SALTS` tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.session import written_once

SALTS = 32
#: Entries of a worker's dictionary, and code points of the longest value that it keeps.
ENTRIES, SHORT = 200_000, 200
MIN_FIELDS = 3

_DROP = re.compile(r"[\W_]+")
_PARTS = re.compile(r"[\r\n;|]+")
_NAME = re.compile(r"\s*([^\W\d_][^:=]{0,39}?)\s*[:=](?!=)")
_LEAD = re.compile(r"^[\s>*#\-+•.]+|[\s*`]+$")
_PAIR = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^",{}\[\]\s]+)')
_ODD_SPACE = re.compile("[  -‏    ⁠　﻿]")


def canonical(text: str) -> str:
    """The letters and digits of a text, letter case ignored."""
    return _DROP.sub("", text.upper())


def _scalar(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _object(text: str) -> list[tuple[str, str]] | None:
    body = _ODD_SPACE.sub(" ", text).strip()
    start, end = body.find("{"), body.rfind("}")
    if start < 0 or end < start or canonical(body[:start]) or canonical(body[end + 1 :]):
        return None
    body = body[start : end + 1]
    try:
        pairs = json.loads(body, object_pairs_hook=list, parse_float=str, parse_int=str, strict=False)
        return [(str(n), _scalar(v)) for n, v in pairs] if isinstance(pairs, list) else None
    except (ValueError, TypeError, RecursionError):
        found = _PAIR.findall(body)
        return found if found and not canonical(_PAIR.sub("", body)) else None


def fields_of(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) fields of a text that consists of them, else None: one JSON object, or at least three parts
    `name: value` or `name=value`, parted by line breaks, `;` or `|`. Parts without letter or digit count as nothing."""
    if "{" in text and (pairs := _object(text)):
        return pairs
    if text.count(":") + text.count("=") < MIN_FIELDS:
        return None
    out: list[tuple[str, str]] = []
    for part in _PARTS.split(text):
        part = _LEAD.sub("", _ODD_SPACE.sub(" ", part))
        if not canonical(part):
            continue
        m = _NAME.match(part.lstrip("\"'"))
        if not m or len(m[1].split()) > 3:
            return None
        out.append((m[1], part.lstrip("\"'")[m.end() :]))
    return out if len(out) >= MIN_FIELDS else None


def _number(value: str) -> bytes:
    return xxhash.xxh3_128_digest(canonical(value).encode("utf-8", "surrogatepass"))


class Dictionary(dict):
    """Values to their numbers; a value is canonicalised when it first comes up. Empties itself when it is full."""

    def __missing__(self, value: str) -> bytes:
        own = _number(value)
        if len(value) <= SHORT:
            if len(self) >= ENTRIES:
                self.clear()
            self[value] = own
        return own


_dictionary = Dictionary()


def _ids(values: pa.Array) -> list[bytes]:
    """A number per value; each distinct value of the column is looked up once."""
    column = values.dictionary_encode()
    own = [_dictionary[v] for v in column.dictionary.to_pylist()]
    return [own[i] for i in column.indices.to_pylist()]


_EMPTY = _number("")


def encode_records(df: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """key, tuple (array<bigint>), of every record whose text holds a letter or digit; null, empty and blank texts give
    no row, repeated rows one each."""
    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kind = kept.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            where: list[tuple[int, int]] = []  # record, 0 for a whole text, 1 for the parts of a field
            values: list[str] = []
            for i, t in enumerate(texts):
                pairs = fields_of(t)
                if pairs is None:
                    where.append((i, 0))
                    values.append(t)
                else:
                    for name, value in pairs:
                        where += [(i, 1), (i, 1)]
                        values += [name, value]
            ids = _ids(pa.array(values, pa.string()))
            tuples: dict[int, set[bytes]] = {}
            j = 0
            while j < len(ids):
                i, paired = where[j]
                if paired:
                    name, value = ids[j], ids[j + 1]
                    if name != _EMPTY or value != _EMPTY:
                        tuples.setdefault(i, set()).add(xxhash.xxh3_128_digest(b"field" + name + value))
                    j += 2
                else:
                    if ids[j] != _EMPTY:
                        tuples.setdefault(i, set()).add(ids[j])
                    j += 1
            rows, out = [], []
            for i, own in tuples.items():
                ordered = sorted(own)
                rows.append(i)
                out.append([int.from_bytes(b[h : h + 8], "big", signed=True) for b in ordered for h in (0, 8)])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(out, pa.list_(pa.int64()))], ["key", "tuple"])

    return kept.mapInArrow(run, f"key {kind}, tuple array<bigint>").withColumnRenamed("key", key)


def copy_groups(df: DataFrame, key: str = "seq", text: str = "text", salts: int = SALTS) -> DataFrame:
    """key, first (the smallest key of the record's copies, itself included), n_copies; one row per counted record.

    Records with a null key cannot be named and take no part; keys are expected to be unique, repeated ones stay repeated
    and count as copies.
    """
    coded = encode_records(df.filter(F.col(key).isNotNull()), key, text).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    coded = written_once(coded)
    part = coded.groupBy("tuple", "salt").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("tuple").agg(F.min("first").alias("first"), F.sum("n").alias("n_copies"), F.collect_list("salt").alias("salts"))
    many = whole.filter("n_copies > 1").select("tuple", "first", "n_copies", F.explode("salts").alias("salt"))
    return coded.join(many, ["tuple", "salt"], "left").select(key, F.coalesce("first", key).alias("first"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def copies(df: DataFrame, key: str = "seq", text: str = "text", salts: int = SALTS) -> DataFrame:
    """first_<key>, <key>: one row per record that is a copy of a record with a smaller key."""
    found = copy_groups(df, key, text, salts).filter(F.col(key) > F.col("first"))
    return found.select(F.col("first").alias(f"first_{key}"), key)


def collapsed(df: DataFrame, key: str = "seq", text: str = "text", salts: int = SALTS) -> DataFrame:
    """<key>, n_copies: one row per group of copies, under its smallest key."""
    coded = encode_records(df.filter(F.col(key).isNotNull()), key, text)
    return coded.groupBy("tuple").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies")).select(key, "n_copies")
