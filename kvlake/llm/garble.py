"""Garbled text from wrong character encoding.

First pass: in how many documents each pair of adjacent characters stands, over a fixed alphabet of `SYMBOLS` symbols
(characters of the alphabetic, punctuation, drawing and mathematical blocks each, large scripts by class). It gives every
pair its mutual information; a pair counts as improbable where it lies far below what its characters' own shares ask
for. A garbled pair is frequent among its own characters, so the share `RHO` that one kind of garbling may have is taken
off the share of a pair with a character that stands for a single byte (of other pairs, at most a quarter of the rarer
character's share; of a small Western letter beside an ASCII character, as words are spelt, `RHO_SPELT`), and no
character's share counts as less than FLOOR; rarer ones make their pairs less probable. Runs that their form proves
garbled are left out of the pairs' shares, so that a mistake standing in many documents does not become normal.

Second pass: per text, improbable pairs are joined to maximum-scoring segments (characters between them cost), and only
the runs of non-ASCII characters inside segments of `OPEN` bits or more are tested: encoded with what they may have been
decoded with, and decoded as what the bytes may have been. UTF-8 proves itself by its form; a legacy encoding has to make
the run clearly more probable. A replacement character, or a C1 control other than NEL, is garbled without a test.
Characters written as entities (named, decimal, hexadecimal) or as escapes of four hexadecimal digits are read as what they
stand for; those that turn out right stay as they are written.

A run's inverse mappings are looked up character by character in tables made once for each codec, and a mask of the codecs
that hold all its characters decides which are tried.

Plan: two narrow passes over the texts in Arrow batches; the counts are summed per task, then shuffled (at most
SYMBOLS**2 rows per task, in practice some ten thousand), and the matrix that is broadcast has the fixed size of
SYMBOLS**2 bytes, whatever the corpus.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = 2048
RHO, RHO_SPELT, FLOOR = 0.05, 0.005, 0.02
#: Bits above which a pair is improbable, what a character between two of them costs, and the most a pair may count.
TAU, GAP, MOST = 2.5, 1.0, 12.0
#: Bits that a segment needs for its runs to be tested.
OPEN = 3.0
#: Most bits that a character rarer than FLOOR adds, half of them to each of its two pairs.
RARE = 6.0
#: Bits that a run must gain by a repair: as UTF-8, whose form is worth some bits for each character, or as a legacy
#: encoding.
GAIN, PROOF, LEGACY_GAIN = 4.0, 10.0, 12.0
STEP = 400
KEEP = 200_000

#: Codecs that bytes in UTF-8 are commonly decoded with by mistake. The first group maps single bytes of
#: Western text; there, part of a run may be garbled. For the others the whole run has to be.
WESTERN = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_15")
OTHERS = ("cp1251", "gbk", "koi8_r", "cp866", "cp932", "big5", "cp949", "cp1253", "cp1254", "iso8859_5", "mac_cyrillic")
#: Mistaken and true codec of legacy text.
LEGACY = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "gbk"), ("cp1252", "cp866"), ("cp1252", "big5"), ("cp1252", "cp932"), ("cp1252", "cp949"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "cp1252"), ("mac_roman", "cp1252"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp850", "cp1251"),
)

#: Characters written as entities or escapes.
_ESCAPED = re.compile(r"&(?:#\d{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});|\\u[0-9A-Fa-f]{4}")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_REST = re.compile("[\u00c2\u00c3\u00e2]|[\u00e2\u00e3][\u00a1-\u00bf]|\u00f0[\u00a1-\u00bf]{0,2}")
_LOST = re.compile("[\x80-\x84\x86-\x9f�]|&#(?:65533|[xX][fF]{3}[dD]);")
#: What may rightly follow a word, so that a letter before it proves nothing, and what stands under or after a root.
_CLOSING = frozenset("’”“‘…–—»›™®·†‡\u00a0")
_ROOTS = frozenset("π∞Ω∑∏∫∂µ")
_DOUBLE = frozenset(("gbk", "cp932", "big5", "cp949"))
#: Russian letters by how often they stand in text, in hundredths of a percent.
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 4, 4), strict=True))
_BITS = {c: math.log2(33e-4 * n) for c, n in _RUSSIAN.items()}


def _alphabet() -> np.ndarray:
    """Code point to symbol."""
    table = np.zeros(0x110000, np.uint16)
    n = 1
    for lo, hi in ((0, 0x250), (0x2B0, 0x300), (0x370, 0x500), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2190, 0x2200), (0x2200, 0x2270), (0x2300, 0x2330), (0x2500, 0x25D0), (0x3000, 0x3020)):
        table[lo:hi] = np.arange(n, n + hi - lo)
        n += hi - lo
    for lo, hi in ((0x300, 0x370), (0x3040, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x530, 0x590), (0x590, 0x600), (0x600, 0x700), (0x1F300, 0x1FB00), (0xFF00, 0xFF61), (0xFF61, 0xFFA0), (0xE000, 0xF900), (0x3400, 0x4E00), (0x2600, 0x2800), (0xFE00, 0xFE10)):
        table[lo:hi] = n
        n += 1
    table[0x30:0x3A] = table[0x30]
    # ideographs by the row they have in the national standard, which orders them by use and reading
    for row in range(0xB0, 0xF8):
        for cell in range(0xA1, 0xFF):
            try:
                table[ord(bytes([row, cell]).decode("gb2312"))] = n + (row - 0xB0) // 4
            except UnicodeDecodeError:
                pass
    n += 18
    assert n <= SYMBOLS
    return table


ALPHABET = _alphabet()


def _forms() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point one bit for each single-byte codec: begins two bytes of UTF-8, begins three or four, continues."""
    two, more, rest = (np.zeros(0x110000, np.uint16) for _ in range(3))
    for i, codec in enumerate(c for c in (*WESTERN, *OTHERS) if c not in _DOUBLE):
        for byte in range(0x80, 0xF5):
            c = ord(bytes([byte]).decode(codec, "ignore") or chr(byte))
            for table, lo, hi in ((two, 0xC2, 0xE0), (more, 0xE0, 0xF5), (rest, 0x80, 0xC0)):
                if lo <= byte < hi:
                    table[c] |= 1 << i
                    if byte < 0xA0:
                        table[byte] |= 1 << i  # as a control, where the codec was taken for a plainer one
    return two, more, rest


TWO, MORE, REST = _forms()
_TWO, _MORE, _REST_OF = ({chr(c): int(table[c]) for c in np.flatnonzero(table)} for table in (TWO, MORE, REST))
#: Of the pairs of legacy codecs those of Western text.
_WEST = tuple(x for x in LEGACY if {*x} <= {*WESTERN} or x == ("cp1251", "cp1252"))
#: Small letters of Western text, and what they become under those pairs and cannot stand inside a word as.
_SMALL = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß")
_ODD = frozenset(
    c for wrong, true in _WEST for small in _SMALL for c in small.encode(true, "ignore").decode(wrong, "ignore")
    if c not in _CLOSING and ord(c) > 0x9F and (c == "ƒ" or not (c.islower() and unicodedata.name(c, "").startswith("LATIN")))
)
INSIDE = np.zeros(0x110000, bool)
INSIDE[[ord(c) for c in _ODD]] = True
#: Ideographs that the two bytes of a Western letter become, which do not stand inside a Western word either.
INSIDE[[ord(c) for codec in _DOUBLE for small in _SMALL for c in (small + small.upper()).encode().decode(codec, "ignore") if ord(c) > 0x2E7F]] = True


#: Codecs in the order of their bits in `_form`, then the others.
_SINGLE = [c for c in (*WESTERN, *OTHERS) if c not in _DOUBLE]
_WRONG = tuple(dict.fromkeys([*_SINGLE, *_DOUBLE, *(wrong for wrong, _ in LEGACY)]))
_BIT = {c: 1 << i for i, c in enumerate(_WRONG)}


class _Reverse(dict):
    """A codec's characters to bytes, filled as characters come up; C1 controls stand for bytes that it does not define."""

    def __init__(self, codec: str):
        super().__init__()
        self.codec = codec

    def __missing__(self, c: str) -> bytes | None:
        try:
            raw = c.encode(self.codec)
        except UnicodeEncodeError:
            raw = bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else None
        self[c] = raw
        return raw


class _Able(dict):
    """A character to the mask of the codecs that hold it."""

    def __missing__(self, c: str) -> int:
        self[c] = mask = sum(bit for codec, bit in _BIT.items() if _BYTES[codec][c] is not None)
        return mask


_BYTES = {c: _Reverse(c) for c in _WRONG}
_MANY = sum(_BIT[c] for c in _DOUBLE)
_WEST_BITS = sum(_BIT[c] for c in WESTERN)
_ABLE = _Able()


def _able(run: str) -> int:
    """The mask of the codecs that a run may have been decoded with."""
    mask = -1
    for c in run:
        mask &= _ABLE[c]
    return mask


def _form(run: str) -> int:
    """The mask of the single-byte codecs under which some characters of a run begin and continue UTF-8."""
    two, more, rest = _TWO.get, _MORE.get, _REST_OF.get
    mask = 0
    for i in range(len(run) - 1):
        if follows := rest(run[i + 1], 0):
            mask |= two(run[i], 0) & follows
            if i + 2 < len(run):
                mask |= more(run[i], 0) & follows & rest(run[i + 2], 0)
    return mask


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts' code points, the places of pairs with a non-ASCII character, and each text's start. A line end
    stands between texts."""
    points = _points("\n".join(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    high = points > 127
    return points, np.flatnonzero(high[:-1] | high[1:]), starts


def _runs(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of non-ASCII characters."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], high, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _russian(text: str) -> float:
    """Bits by which letters are those of Russian text; far below 0 for other characters and for odd case."""
    if not (text.islower() or text.isupper() or text[:1].isupper() and text[1:].islower()):
        return -99.0
    return sum(_BITS.get(c, -11.6) for c in text.lower())


def _odd(before: str, seq: str, after: str, told: str) -> bool:
    """Whether the characters of one UTF-8 sequence cannot stand as they are: inside a word, or in no order of text."""
    first, second = seq[0], seq[1]
    if before.islower() and first.isupper() or before.isascii() and before.isalpha() and _script(first) not in ("", "LATIN", "CJK"):
        return True
    if first in "√├┬╨╤":
        return before.isascii() and before.isalpha() and second not in _ROOTS and told.isalpha()
    if second in _CLOSING:
        return after.isalpha() and second in "”“…†‡™®" and first.isalpha()
    if len(seq) > 2 and 0x2010 <= ord(told) < 0x2300:
        return True
    return first.isalpha() and not second.isalpha() and not 0x2500 <= ord(second) < 0x25A0


def _proven(run: str, left: str, right: str) -> bool:
    """Whether a run's form alone proves a mistake, whatever its share of the documents: bytes in UTF-8 whose characters
    cannot stand so in text, or a long run that only another encoding makes words of."""
    here = _russian(run) if _script(run[0]) == "CYRILLIC" else -20.0
    if here >= 3 or len(run) > 1 and all(_common_cjk(c) for c in run):
        return False  # right text
    able = _able(run)
    tried = able & (_form(run) | _MANY)
    for codec in (*WESTERN, *OTHERS) if tried else ():
        if not tried & _BIT[codec]:
            continue
        raw = _back(run, codec)
        if codec not in _DOUBLE and len(raw) == len(run):
            found = list(_UTF8.finditer(raw))
            if 2 * sum(len(m[0]) for m in found) < len(raw) or not found:
                continue
            for m in found:
                told = m[0].decode()
                before, after = run[m.start() - 1] if m.start() else left, run[m.end()] if m.end() < len(run) else right
                if _odd(before, run[m.start() : m.end()], after, told) and _plausible(told, *((left, right) if len(found) == 1 else ("", ""))):
                    return True
        try:
            told = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        letters = [c for c in told if c.isalpha()]
        scripts = {_script(c) for c in letters}
        if len(letters) >= 3 and 2 * len(letters) >= len(told) and _plausible(told, left, right) and not all(0x2500 <= ord(c) < 0x25A0 for c in run):
            if scripts <= {"CYRILLIC"} or scripts <= {"GREEK"} or scripts <= {"CJK", "HIRAGANA", "KATAKANA", "HANGUL"} and all(_common_cjk(c) or not 0x4E00 <= ord(c) < 0xA000 for c in letters):
                return True
    if len(run) < 5:
        return False
    for wrong, true in LEGACY:
        if true == "cp1252" or not able & _BIT[wrong] or (told := _told(run, wrong, true)) is None:
            continue
        if true in ("gbk", "big5", "cp932", "cp949"):
            if len(told) >= 4 and all(_common_cjk(c) for c in told):
                return True
        elif told != run and _russian(told) >= max(3.0, here + 8):
            return True
    return False


def _glued(left: str, run: str, right: str) -> bool:
    """Whether a short run stands in a word of small letters as none of them."""
    small = "a" <= left <= "z"
    return small and _ODD.issuperset(run) and ("a" <= right <= "z" or run.isupper())


class Clean:
    """Tells the pairs that stand in no run whose form proves a mistake; where one does, the document's other runs that
    could be of that kind are left out too."""

    def __init__(self) -> None:
        self.kept: dict[tuple[str, str, str], bool] = {}

    def proven(self, run: str, left: str, right: str) -> bool:
        if len(run) > 64:
            return _proven(run[:64], left, "")
        key = (left, run, right)
        if key not in self.kept:
            if len(self.kept) >= KEEP:
                self.kept.clear()
            self.kept[key] = _proven(run, left, right)
        return self.kept[key]

    def places(self, texts: list[str], points: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        p, after, third = points[places], points[np.minimum(places + 1, len(points) - 1)], points[np.minimum(places + 2, len(points) - 1)]
        shape = (TWO[p] & REST[after]) | (MORE[p] & REST[after] & REST[third])
        glued = (p > 0xBF) & (after > 0xBF) & ((p < 0x530) | (p >= 0x2E80))
        begins, ends = _runs(points > 127)
        runs = np.unique(np.searchsorted(begins, places[(shape != 0) | glued], "right") - 1)
        runs = runs[ends[runs] - begins[runs] > 1]
        docs = np.searchsorted(starts, begins[runs], "right") - 1
        out = np.zeros(len(points) + 1, bool)
        sure = set()
        for r, doc in zip(runs.tolist(), docs.tolist(), strict=True):
            if doc in sure:
                continue
            at, to = int(begins[r] - starts[doc]), int(ends[r] - starts[doc])
            text = texts[doc]
            if self.proven(text[at:to], text[max(0, at - 1) : at], text[to : to + 1]):
                sure.add(doc)
        for r, doc in zip(runs.tolist(), docs.tolist(), strict=True):
            if doc in sure:
                out[max(0, begins[r] - 1) : ends[r]] = True
        low = (points > 96) & (points < 123)
        inside = np.flatnonzero(INSIDE[points[1:-1]] & low[:-2] & low[2:])  # a sign that is no small letter, between small letters
        out[inside] = out[inside + 1] = True
        return places[~out[places]]


class Counts:
    """The numbers of documents with each pair of symbols and with each symbol."""

    def __init__(self) -> None:
        self.docs = 0
        self.single = np.zeros(SYMBOLS, np.int64)
        self.codes: list[np.ndarray] = []
        self.pending = 0
        self.pairs, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.clean = Clean()

    def add(self, texts: list[str]) -> None:
        self.docs += len(texts)
        points, places, starts = _pairs(texts)
        symbols = ALPHABET[points]
        there = np.zeros((len(texts), SYMBOLS), bool)
        there[np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(points)))), symbols] = True
        self.single += there.sum(axis=0)
        if len(places):
            places = self.clean.places(texts, points, places, starts)
        if len(places):
            doc = np.searchsorted(starts, places, "right").astype(np.int64)
            own = symbols[places].astype(np.int64) * SYMBOLS + symbols[places + 1]
            self.codes.append(np.unique(doc * SYMBOLS * SYMBOLS + own) % (SYMBOLS * SYMBOLS))
            self.pending += len(self.codes[-1])
            if self.pending > 1 << 20:
                self._sum()

    def _sum(self) -> None:
        own = [np.unique(np.concatenate(self.codes or [self.pairs[:0]]), return_counts=True), (self.pairs, self.n)]
        pairs, n = (np.concatenate(x) for x in zip(*own, strict=True))
        self.pairs, where = np.unique(pairs, return_inverse=True)
        self.n = np.bincount(where, n, len(self.pairs)).astype(np.int64)
        self.codes, self.pending = [], 0

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        """a, b, n as `pair_counts` gives them."""
        self._sum()
        there = np.flatnonzero(self.single)
        a = [*(self.pairs // SYMBOLS).tolist(), *there.tolist(), -1]
        b = [*(self.pairs % SYMBOLS).tolist(), *[-1] * len(there), -1]
        return a, b, [*self.n.tolist(), *self.single[there].tolist(), self.docs]


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """a, b, n: the number of documents with the pair of symbols in a run not proven garbled by its form; (a, -1) of
    those with the symbol, (-1, -1) of all."""
    kept = df.select(F.col(text).alias("text")).filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                counts.add(batch.column(0).slice(at, STEP).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(counts.rows(), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["a", "b", "n"])

    return kept.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def improbability(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """SYMBOLS x SYMBOLS matrix of int8: four times the bits by which a pair lies below independence, less TAU."""
    docs = max(1, sum(n for a, b, n in counts if a < 0))
    own, pair = np.zeros(SYMBOLS), np.zeros((SYMBOLS, SYMBOLS), np.float32)
    for a, b, n in counts:
        if b >= 0:
            pair[a, b] = n
        elif a >= 0:
            own[a] = n
    own = np.minimum(own / docs, 1.0).astype(np.float32)
    byte = np.zeros(SYMBOLS, bool)
    for codec in WESTERN:
        for c in bytes(range(128, 256)).decode(codec, "ignore"):
            byte[ALPHABET[ord(c)]] = True
    less = np.where(byte[:, None] | byte, RHO, np.minimum(RHO, np.minimum.outer(own, own) / 4))
    small = np.zeros(SYMBOLS, bool)
    small[[ALPHABET[ord(c)] for c in _SMALL]] = True
    plain = np.zeros(SYMBOLS, bool)
    plain[ALPHABET[:128]] = True
    less[np.logical_and.outer(small, plain) | np.logical_and.outer(plain, small)] = RHO_SPELT
    rare = np.clip(np.log2(FLOOR / np.maximum(own, 1e-9)), 0, RARE) / 2
    own = np.maximum(own, FLOOR)
    bits = np.log2(np.outer(own, own) / (np.maximum(pair / docs - less, 0) + FLOOR / 512)) - TAU
    bits += np.add.outer(rare, rare)
    bits[:128, :128] = -GAP  # pairs of ASCII characters are not scored
    return np.clip(np.round(bits * 4), -127, MOST * 4).astype(np.int8)


def _back(run: str, codec: str) -> bytes | None:
    """The bytes that a run was decoded from; bytes that the codec does not define stand as C1 controls."""
    table = _BYTES[codec]
    parts = [table[c] for c in run]
    return None if None in parts else b"".join(parts)


def _told(run: str, wrong: str, true: str) -> str | None:
    try:
        return raw.decode(true) if (raw := _back(run, wrong)) is not None else None
    except UnicodeDecodeError:
        return None


_told_short = lru_cache(1 << 16)(_told)  # for runs of one or two characters


@lru_cache(1 << 16)
def _unclean(c: str) -> bool:
    return unicodedata.category(c) in ("Cn", "Cc", "Co", "Cs") and c not in "\n\r\t"


def _clean(text: str) -> bool:
    return not any(map(_unclean, text))


@lru_cache(1 << 16)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0] if c.isalpha() and c not in "\u00aa\u00b5\u00ba" else ""


@lru_cache(1 << 16)
def _common_cjk(c: str) -> bool:
    """Ideographs of the first level of the national standard, and the punctuation used with them."""
    try:
        return 0xB0 <= c.encode("gb2312")[0] <= 0xD7 or 0x3000 <= ord(c) < 0x3020 or 0xFF00 <= ord(c) < 0xFF61
    except UnicodeEncodeError:
        return False


def _plausible(told: str, left: str, right: str) -> bool:
    """Whether a decoded run can be text: assigned characters, no mark of its own, no letter that is used in phonetics
    only, and no letter of another script glued to a Latin one."""
    if not _clean(told) or any(0x180 <= ord(c) <= 0x217 or 0x21C <= ord(c) <= 0x36F or unicodedata.category(c) == "Mn" and 0x370 < ord(c) < 0xFE00 for c in told):
        return False
    scripts = [_script(c) for c in left + told + right]
    mixed = any("LATIN" in pair and len({*pair} - {"", "CJK"}) > 1 for pair in zip(scripts, scripts[1:]))
    return not mixed


def _unescaped(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with its escaped non-ASCII characters as such, and where these stand: begin, end, as written."""
    if "&" not in text and "\\u" not in text:
        return text, []
    parts, spans, at, n = [], [], 0, 0
    for m in _ESCAPED.finditer(text):
        told = chr(int(m[0][2:], 16)) if m[0][0] == "\\" else html.unescape(m[0])
        if told.isascii() or "\ud800" <= told[0] <= "\udfff" or told[0] == "&":
            continue
        parts += [text[at : m.start()], told]
        n += m.start() - at
        spans.append((n, n + len(told), m[0]))
        n, at = n + len(told), m.end()
    return "".join([*parts, text[at:]]), spans


class Finder:
    """Finds and repairs the garbled runs of texts."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.kept: dict[tuple[str, str, str], tuple[str, str] | None] = {}
        self.rated: dict[str, float] = {}

    def bad(self, text: str) -> float:
        """The bits of improbable pairs."""
        rated, total = self.rated, 0.0
        for i in range(len(text) - 1):
            pair = text[i : i + 2]
            if (bits := rated.get(pair)) is None:
                if len(rated) >= KEEP:
                    rated.clear()
                bits = rated[pair] = 0.0 if pair.isascii() else max(0, int(self.matrix[ALPHABET[ord(pair[0])], ALPHABET[ord(pair[1])]])) / 4
            total += bits
        return total

    def _utf8(self, run: str, left: str, right: str, whole: bool) -> tuple[str, str] | None:
        able = _able(run) & (_form(run) | _MANY)
        if not whole:
            able &= _WEST_BITS
        if not able:
            return None
        before = self.bad(left + run + right)
        for codec in (*WESTERN, *OTHERS) if whole else WESTERN:
            if not able & _BIT[codec] or not _UTF8.search(raw := _back(run, codec)):
                continue
            if whole:
                try:
                    told = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
            elif 2 * sum(map(len, _UTF8.findall(raw))) < len(raw):
                continue
            elif len(raw) != len(run):
                continue
            else:
                told, at = "", 0
                for m in _UTF8.finditer(raw):
                    told += run[at : m.start()] + m[0].decode()
                    at = m.end()
                told += run[at:]
            if told == run or not _plausible(told, left, right):
                continue
            gain = before - self.bad(left + told + right) + PROOF * sum(ord(c) > 127 for c in told)
            if gain < GAIN and told != "\ufeff":
                continue
            again = self._utf8(told, left, right, True) if len(told) > 1 else None
            return (again[0], f"{codec}<utf-8 {again[1]}") if again else (told, f"{codec}<utf-8")
        return None

    def _legacy(self, run: str, left: str, right: str) -> tuple[str, str] | None:
        if len(run) < 3:
            return None
        before = self.bad(left + run + right)
        best: tuple[float, str, str] | None = None
        able = _able(run)
        for wrong, true in LEGACY:
            if not able & _BIT[wrong] or before < LEGACY_GAIN and true != "gbk" or (told := _told(run, wrong, true)) is None or told == run or not _clean(told):
                continue
            if len({_script(c) for c in told} - {""}) > 1:
                continue
            after = self.bad(left + told + right)
            gain = before - after
            if true == "gbk" and all(_common_cjk(c) for c in told):
                after, gain = 0.0, gain + 3 * len(told)  # a form that Western text hardly has by chance
            if gain >= LEGACY_GAIN and 2 * after <= before and (best is None or gain > best[0] + before / 4):  # the pairs stand in the order of how common they are
                best = (gain, told, f"{wrong}<{true}")
        if best is None and (raw := run.encode("utf-16-le", "surrogatepass")) and re.fullmatch(rb"[\n\r\t -~]{8,}", raw):
            return raw.decode("ascii"), "utf-16<ascii"
        return (best[1], best[2]) if best else None

    def _cyrillic(self, runs: list[str]) -> tuple[str, str] | None:
        """The codecs by which a document's runs are Russian, by fixed shares of letters: the table may hold no other
        Russian text, or hold this mistake often."""
        words = [r for r in {*runs} if r.isalpha()]
        if max(map(len, words), default=0) < 4:
            return None
        here = sum(max(-20.0, _russian(w)) for w in words) if any(_script(w[0]) == "CYRILLIC" for w in words) else 0.0
        best, codecs = max(8.0, here + 8), None
        for wrong, true in LEGACY:
            if true not in ("cp1251", "koi8_r", "cp866"):
                continue
            told = [_told(w, wrong, true) for w in words]
            if None not in told and (bits := sum(max(-20.0, _russian(t)) for t in told)) > best:
                best, codecs = bits, (wrong, true)
        return codecs

    def _rest(self, run: str, left: str, right: str) -> tuple[str, str] | None:
        """What is left of a UTF-8 sequence whose control characters were dropped, standing apart from letters."""
        if left[-1:].isalpha() or right[:1].isalpha() or not _REST.fullmatch(run):
            return None
        return ("\ufffd", "cp1252<utf-8") if self.bad(left + run + right) >= 2 * GAIN else None

    def repair(self, run: str, left: str, right: str) -> tuple[str, str] | None:
        key = (left, run, right)
        if key not in self.kept:
            if len(self.kept) >= KEEP:
                self.kept.clear()
            multiple = len(run) > 1 or ord(run) > 0x2E7F
            own = (multiple and self._utf8(run, left, right, True)) or self._legacy(run, left, right) or (multiple and self._utf8(run, left, right, False)) or self._rest(run, left, right)
            if len(run) > 64:
                return own
            self.kept[key] = own
        return self.kept[key]

    def segments(self, points: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs that reach OPEN, as [begin, end) of characters."""
        s = self.matrix[ALPHABET[points[places]], ALPHABET[points[places + 1]]]
        bad = np.flatnonzero(s > 0)
        begin = end = -1
        score = most = 0.0
        for at, bits in zip(places[bad].tolist(), (s[bad] / 4).tolist(), strict=True):
            if begin >= 0 and score - (at - end) * GAP > 0:
                score += bits - max(0, at - end) * GAP
            else:
                if most >= OPEN:
                    yield begin, end
                begin, score, most = at, bits, 0.0
            end = at + 2
            most = max(most, score)
        if most >= OPEN:
            yield begin, end

    def _fixes(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
        """What the opened runs of a text become, and by which mistake."""
        out = []
        codecs = self._cyrillic([text[at:to] for at, to in spans]) if any(to - at > 3 for at, to in spans) else None
        for at, to in spans:
            run = text[at:to]
            if codecs and (told := _told(run, *codecs)) and told != run and _clean(told) and {_script(c) for c in told} <= {"", "CYRILLIC"} and (not run.isalpha() or _russian(told) > _russian(run)):
                out.append((at, to, told, f"{codecs[0]}<{codecs[1]}"))
            elif fix := self.repair(run, text[max(0, at - 1) : at], text[to : to + 1]):
                out.append((at, to, *fix))
        done = {at for at, *_ in out}
        return sorted(out + self._western(text, [x for x in spans if x[0] not in done]))

    def _western(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
        """Short runs by the one pair of codecs that makes Western letters of them, weighed over the whole text."""
        runs = [(at, to, text[max(0, at - 1) : at], text[at:to], text[to : to + 1]) for at, to in spans if to - at < 3]
        if not runs or sum(map(self.bad, {"".join(x[2:]) for x in runs if _glued(*x[2:])})) <= LEGACY_GAIN:
            return []
        best: tuple[float, list[tuple[int, int, str, str]]] = (LEGACY_GAIN, [])
        for wrong, true in _WEST:
            gains: dict[tuple[str, str, str], tuple[float, float]] = {}
            fixes = []
            for at, to, left, run, right in runs:
                told = _told_short(run, wrong, true)
                if not told or told == run or not (_SMALL.issuperset(told) or told.isalpha() and _SMALL.issuperset(told.lower()) and not left.islower()) or not (left.isalpha() or right.isalpha()):
                    continue
                before, after = self.bad(left + run + right), self.bad(left + told + right)
                if after < before:
                    fixes.append((at, to, told, f"{wrong}<{true}"))
                    if _glued(left, run, right):
                        gains[left, run, right] = before, after
            total, rest = sum(b for b, _ in gains.values()), sum(a for _, a in gains.values())
            if total - rest > best[0] and 2 * rest <= total:
                best = total - rest, fixes
        return best[1]

    def find(self, texts: list[str]) -> list[tuple[str, list[str]] | None]:
        """Per text None, or the text with what could be repaired, and the mistakes made."""
        raw = texts
        texts, written = zip(*map(_unescaped, raw), strict=True) if raw else ((), ())
        points, places, starts = _pairs(texts)
        out: list[tuple[str, list[str]] | None] = [None] * len(texts)
        if not len(places):
            return out
        run_starts, run_ends = _runs(points > 127)
        cut = np.array(list(self.segments(points, places)), np.int64).reshape(-1, 2)
        step = np.zeros(len(run_starts) + 1, np.int64)  # a run is open where more segments have begun than ended
        np.add.at(step, np.searchsorted(run_ends, cut[:, 0], "right"), 1)
        np.add.at(step, np.searchsorted(run_starts, cut[:, 1], "left"), -1)
        runs = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        docs = np.searchsorted(starts, run_starts[runs], "right") - 1
        opened: dict[int, list[tuple[int, int]]] = {}
        for doc, a, b in zip(docs.tolist(), (run_starts[runs] - starts[docs]).tolist(), (run_ends[runs] - starts[docs]).tolist(), strict=True):
            opened.setdefault(doc, []).append((a, b))
        changes = {doc: self._fixes(texts[doc], spans) for doc, spans in opened.items()}
        for doc, text in enumerate(texts):
            own = changes.get(doc, [])
            if not own and not _LOST.search(raw[doc]):
                continue
            edits = [x[:3] for x in own]
            if written[doc]:
                edits = sorted(edits + [x for x in written[doc] if not any(begin < x[1] and x[0] < end for begin, end, *_ in own)])
            parts, at = [], 0
            for begin, end, told in edits:
                parts += [text[at:begin], told]
                at = end
            fixed = "".join([*parts, text[at:]])
            out[doc] = (fixed, sorted({how for *_, how in own} | ({"lost"} if _LOST.search(fixed) else set())))
        return out


_finders: dict[str, Finder] = {}


def garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mistakes (array<string>, as `wrong<true` codecs from the last mistake to the first; `lost` where characters
    are gone), restored (null where some are gone), of the affected rows.

    Null, empty and ASCII texts are never affected; an empty table gives no rows; repeated rows are found each.
    """
    matrix = improbability([tuple(r) for r in pair_counts(df, text).collect()])  # at most SYMBOLS**2 rows
    shared = df.sparkSession.sparkContext.broadcast(matrix)
    name = uuid.uuid4().hex
    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _finders:
            _finders.clear()
            _finders[name] = Finder(shared.value)
        find = _finders[name].find
        for batch in batches:
            rows, mistakes, texts = [], [], []
            for at in range(0, batch.num_rows, STEP):
                for i, hit in enumerate(find(batch.column(1).slice(at, STEP).to_pylist()), at):
                    if hit:
                        rows.append(i)
                        mistakes.append(hit[1])
                        texts.append(None if "lost" in hit[1] else hit[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(mistakes, pa.list_(pa.string())), pa.array(texts, pa.string())], ["key", "mistakes", "restored"])

    return kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, mistakes array<string>, restored string").withColumnRenamed("key", key)
