"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Per piece of text (as the vocabulary's splitting pattern gives them), every prefix has exactly one token that can end its
encoding. An automaton over the vocabulary gives the tokens that end at each byte; a token is the last of a prefix if it
is compatible with the last token of the prefix before it, that is, if merging by rank would not have joined or cut them
otherwise. The table of last tokens is filled from left to right, in time linear in the piece, and read backwards.
The results of short pieces are kept per Python worker, up to `KEEP` pieces.

Plan: one pass in Arrow batches without a shuffle. The vocabulary file (a fixed size, checked against `MAX_VOCABULARY`) is
read on the driver and broadcast with the table of merges made from it.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("KVLAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64_000_000
KEEP = 400_000
KEEP_CHARS = 48


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id. Ids must be 0..n-1 and the single bytes among them."""
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: ids must be 0..n-1 and hold every byte")
    return tokens


def merges_of(tokens: list[bytes]) -> list[tuple[int, int]]:
    """By id, the two tokens a token was merged from; a token that is not merged from others stands for itself twice."""
    rank = {t: i for i, t in enumerate(tokens)}
    out: list[tuple[int, int]] = []
    for i, token in enumerate(tokens):
        parts = [token[j : j + 1] for j in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda j: rank.get(parts[j] + parts[j + 1], i))
            if rank.get(parts[best] + parts[best + 1], i) >= i:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out.append((rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (i, i))
    return out


class Encoder(dict):
    """piece -> ids (array of int); pieces up to KEEP_CHARS are kept."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int]], pattern: str = PATTERN):
        super().__init__()
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.merges = merges
        self.pair = {m: i for i, m in enumerate(merges) if m[0] != i}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(pattern).findall
        self.endings = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.endings.add_word(t.decode("latin-1"), i)
        self.endings.make_automaton()

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their joined bytes: going back through the merges
        in the order opposite to their making, no merge across the seam was due before the one that is undone."""
        if (known := self.compatible.get((left, right))) is not None:
            return known
        a, b, before = left, right, len(self.merges)
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < before:
                fits = False
                break
            inner_a, inner_b = self.merges[a][1] != a, self.merges[b][0] != b
            if not inner_a and not inner_b:
                fits = True
                break
            if inner_a and (a > b or not inner_b):  # of two merges with one rank, the left one was made first
                before, a = a, self.merges[a][1]
            else:
                before, b = b + 1, self.merges[b][0]
        if len(self.compatible) > KEEP:
            self.compatible.clear()
        self.compatible[left, right] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        last = [-1] * (len(piece) + 1)
        size, fits = self.size, self.fits
        for end, token in self.endings.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[token]
            if start == 0 or (last[start] >= 0 and fits(last[start], token)):
                last[end] = token
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    def __missing__(self, piece: str) -> array:
        ids = array("i", self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.__getitem__, self.split(text))))


_encoders: dict[str, Encoder] = {}


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """key, ids (array<int>) of every row. Null and empty texts give an empty list; special tokens are ordinary text."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    tokens = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast((tokens, merges_of(tokens)))
    name = f"{path}:{pattern}"
    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders[name] = Encoder(*shared.value, pattern)
        encode = _encoders[name].encode
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                flat, ends = array("i"), array("i", [0])
                for t in part.column(1).to_pylist():
                    if t:
                        flat += encode(t)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    return kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key, text of every row of ids; null and empty lists give an empty text, ids that the vocabulary lacks raise."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(path or os.path.join(TOKENIZERS, VOCABULARY)))
    kept = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(tokens.value.__getitem__, own or ())).decode("utf-8", "surrogatepass") for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
