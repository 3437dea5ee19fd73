"""Evaluation texts leaking into training text.

The test items' words (contexts and questions) make one generalised suffix automaton. The words of a training text are
streamed through it; wherever the longest match reaches `SEED` words, the items and places of these words are looked up.
Adjacent places on one diagonal make exact runs, runs are chained with the edit distance of the gaps between them, and a
document is reported with an item if a chain covers `MIN_WORDS` or more words of the context of which at most one in
`PER_EDIT` is changed, left out or added to, or if the whole question stands in it. Questions of fewer than `SEED` words
are looked up by themselves.

The runs that lie together make spans of the text; those of `MIN_WORDS` words or more, or that cover `COVERAGE` of their
item, are reported with their places (`leak_spans`) and can be taken out of the text (`without_leaks`).

Words are runs of letters and digits, in scripts written without blanks each character; letter case, compatibility forms,
accents' composition, apostrophes, punctuation, markup tags, entities, escapes and zero-width characters are disregarded.

Plan: a narrow map over the corpus, without a shuffle. The items are a stated query set: they are read in blocks of at
most `BLOCK_CHARS` characters, each broadcast and run against all documents, so the broadcast is bounded whatever their
number. A worker's automaton lies in flat arrays (some 25 bytes a state; dictionaries for states with several ways on).
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
PER_EDIT = 6
SEED = 4
COVERAGE = 0.9
BLOCK_CHARS = 8_000_000
#: Longest gap between two runs of one chain: a longer one holds more edits than any chain around it allows to matter.
MAX_GAP = 48

#: Diagonals by which neighbouring runs of one stretch may differ.
DRIFT = 5
#: Texts that are looked at together.
STEP = 500
#: Size of the filter of neighbouring pairs, in bits of the index; a pair that it lets through wrongly costs time only.
PAIR_BITS = 22

_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[^\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")
_ZERO = re.compile("['’ʼ­​-‏⁠﻿]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrtbf\"/]")
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_CLUSTER = re.compile("(?s).[\u0300-\u036f\u0483-\u0489\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]*")


def _escaped(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " "


def words_of(text: str) -> list[str]:
    """The words that are compared."""
    if "\\" in text:
        text = _ESCAPE.sub(_escaped, text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_ZERO.sub("", text).casefold())


def word_places(text: str) -> list[tuple[int, int]]:
    """Begin and end in the text of each of its `words_of`."""
    now, begins, ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def change(pattern: re.Pattern, told: Callable[[re.Match], str]) -> None:
        nonlocal now, begins, ends
        parts, b, e, at = [], [], [], 0
        for m in pattern.finditer(now):
            if (new := told(m)) == m[0]:
                continue
            i, j = m.span()
            parts += [now[at:i], new]
            b += begins[at:i] + [begins[i]] * len(new)
            e += ends[at:i] + [ends[j - 1]] * len(new)
            at = j
        now, begins, ends = "".join([*parts, now[at:]]), b + begins[at:], e + ends[at:]

    steps: list[tuple[re.Pattern, Callable[[re.Match], str]]] = [
        (_ESCAPE, _escaped), (_TAG, lambda m: " "), (_ENTITY, lambda m: html.unescape(m[0])), (_CLUSTER, lambda m: unicodedata.normalize("NFKC", m[0])),
        (_ZERO, lambda m: ""), (re.compile("(?s)."), lambda m: m[0].casefold()),
    ]
    for pattern, told in steps:
        change(pattern, told)
    places = [(begins[m.start()], ends[m.end() - 1]) for m in _WORD.finditer(now)]
    # letters that compose across clusters are told apart no further: the whole text is then the place of every word
    return places if _WORD.findall(now) == (words := words_of(text)) else [(0, len(text))] * len(words)


class Automaton:
    """Generalised suffix automaton over sequences of integers from 0; remembers where each sequence's prefixes end.

    A state's first way on lies in two arrays (`first`, the integer, and `to`); a dictionary holds those of the states that
    have more. `heads` and `after` chain the prefixes that end in a state.
    """

    def __init__(self):
        self.first, self.to = array("i", [-2]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.size = array("i", [-1]), array("i", [0])
        self.heads = array("i", [-1])
        self.after, self.of, self.at = array("i"), array("i"), array("i")
        self._under: tuple[np.ndarray, np.ndarray] | None = None
        self._places: dict[int, list[tuple[int, int]]] = {}

    def step(self, state: int, word: int) -> int:
        """The state that a word leads to, -1 if none."""
        if self.first[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, -1) if more else -1

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.first[state] in (-2, word):
            self.first[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _state(self, size: int, link: int, like: int = -1) -> int:
        new = len(self.first)
        self.first.append(self.first[like] if like >= 0 else -2)
        self.to.append(self.to[like] if like >= 0 else 0)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        self.size.append(size)
        self.link.append(link)
        self.heads.append(-1)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.size[p] + 1, self.link[q], q)
        self.link[q] = copy
        while p >= 0 and self.step(p, word) == q:
            self._lead(p, word, copy)
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], name: int) -> None:
        last = 0
        for at, word in enumerate(sequence):
            p, q = last, self.step(last, word)
            if q >= 0:
                last = q if self.size[q] == self.size[p] + 1 else self._clone(p, word, q)
            else:
                last = self._state(self.size[p] + 1, 0)
                while p >= 0 and (q := self.step(p, word)) < 0:
                    self._lead(p, word, last)
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = q if self.size[q] == self.size[p] + 1 else self._clone(p, word, q)
            self.after.append(self.heads[last])
            self.heads[last] = len(self.of)
            self.of.append(name)
            self.at.append(at)

    def places(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of every occurrence of the state's words. What is kept of them is at most as many as there are
        words, for states that are the first of their length."""
        if (known := self._places.get(state)) is None:
            if self._under is None:
                links = np.array(self.link)
                self._under = (np.argsort(links, kind="stable"), np.searchsorted(np.sort(links), np.arange(len(links) + 1)))
            children, begins = self._under
            known, todo = [], [state]
            while todo:
                s = todo.pop()
                e = self.heads[s]
                while e >= 0:
                    known.append((self.of[e], self.at[e]))
                    e = self.after[e]
                todo += children[begins[s] : begins[s + 1]].tolist()
            self._places[state] = known
        return known


def edit_distance(a: list[int], b: list[int], most: int = 1 << 30) -> int:
    """The edit distance, or some number above `most` if it is above it."""
    longer = max(len(a), len(b))
    shared = set(a).intersection(b)
    least = longer - min(sum(x in shared for x in a), sum(x in shared for x in b)) if shared else longer
    if not shared or least > most:
        return least
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if most < longer and min(row) > most:
            return most + 1
    return row[-1]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 1_000_003 + b * 8_191) & ((1 << PAIR_BITS) - 1)


class Items:
    """The test items of one block: `find` names the items that leak into a text, `spans` says where."""

    def __init__(self, items: list[tuple[str, str | None, str | None]], min_words: int = MIN_WORDS, per_edit: int = PER_EDIT, seed: int = SEED):
        self.min_words, self.per_edit, self.seed = min_words, per_edit, min(seed, min_words)
        # a longer stretch with few enough edits can be cut into parts of min_words to `most` words, one of which has too
        self.most = 2 * min_words - 1
        # words that at least stand in runs: between e edits lie e + 1 parts, of which all but one may be shorter than a run
        self.least = max(self.seed, min(n - self.seed * (n // per_edit) for n in range(min_words, min_words + 4 * per_edit)))
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.sequences: list[list[int]] = []
        self.whole: list[bool] = []
        self.short: dict[tuple[int, ...], list[int]] = {}
        self.automaton = Automaton()
        for name, context, question in items:
            for text, whole in ((context, False), (question, True)):
                sequence = [self.number.setdefault(w, len(self.number)) for w in words_of(text or "")]
                if len(sequence) < (1 if whole else min_words):
                    continue
                if len(sequence) < self.seed:
                    self.short.setdefault(tuple(sequence), []).append(len(self.sequences))
                else:
                    self.automaton.add(sequence, len(self.sequences))
                self.sequences.append(sequence)
                self.names.append(name)
                self.whole.append(whole)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for sequence in self.sequences:
            own = np.array(sequence, np.int64)
            self.pairs[_pair(own[:-1], own[1:])] = True
        self.heads = {key[0] for key in self.short}

    def _hits(self, texts: list[str]) -> tuple[list[int], list[int], dict[tuple[int, int], list[tuple[int, int]]], list[tuple[int, int, int, int]]]:
        """The texts' words as numbers, each text's start among them (and the end), the places (in text and item) of each text's and
        context's common words, and the questions that stand whole: text, sequence, begin, end."""
        ids: list[int] = []
        starts: list[int] = []
        for text in texts:
            starts.append(len(ids))
            ids += map(self.number.get, words_of(text), repeat(-1))
            ids.append(-1)
        starts.append(len(ids))
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        questions: list[tuple[int, int, int, int]] = []
        numbers = np.array(ids, np.int64)
        for begin, end in self._stretches(numbers):
            doc = bisect_right(starts, begin) - 1
            self._stream(ids, begin, end, doc, hits, questions)
        if self.short:
            for at in np.flatnonzero(np.isin(numbers, list(self.heads))).tolist():
                for n in range(1, self.seed):
                    for sequence in self.short.get(tuple(ids[at : at + n]), ()):
                        questions.append((bisect_right(starts, at) - 1, sequence, at, at + n))
        return ids, starts, hits, questions

    def find(self, texts: list[str]) -> list[set[str]]:
        """The names of the items found in each text."""
        ids, starts, hits, questions = self._hits(texts)
        found: list[set[str]] = [set() for _ in texts]
        for doc, sequence, _, _ in questions:
            found[doc].add(self.names[sequence])
        for (doc, sequence), seeds in hits.items():
            if self.names[sequence] not in found[doc] and self._covered(ids, self.sequences[sequence], seeds, (starts[doc], starts[doc + 1] - 1)):
                found[doc].add(self.names[sequence])
        return found

    def spans(self, texts: list[str], coverage: float = COVERAGE) -> list[list[tuple[str, str, int, int, int, float]]]:
        """Per text the spans that leak: item, `question` or `context`, begin and end in the text, words, and the share of
        the item's words that stand in it. A span reaches from the first to the last run of `seed` words of an item that
        lie together; those below `min_words` words and below `coverage` are left out, unless the item has no longer one."""
        ids, starts, hits, questions = self._hits(texts)
        own: list[list[tuple[str, str, int, int, float]]] = [[] for _ in texts]
        for doc, sequence, begin, end in questions:
            own[doc].append((self.names[sequence], "question", begin - starts[doc], end - starts[doc], 1.0))
        for (doc, sequence), seeds in hits.items():
            item = self.sequences[sequence]
            bounds = starts[doc], starts[doc + 1] - 1
            if not self._covered(ids, item, seeds, bounds):
                continue
            parts = []
            for group in self._ways(seeds):
                begin, end = min(at for at, _ in group) - self.seed + 1, max(at for at, _ in group) + 1
                met = len({i for _, e in group for i in range(e - self.seed + 1, e + 1)}) / len(item)
                parts.append((self._group_covered(ids, item, group, bounds), end - begin, begin, end, met))
            good = [x for x in parts if x[0] and (x[1] >= self.min_words or x[4] >= coverage)] or [max(parts)]
            own[doc] += [(self.names[sequence], "context", begin - starts[doc], end - starts[doc], met) for _, _, begin, end, met in good]
        out = []
        for text, found in zip(texts, own, strict=True):
            places = word_places(text) if found else []
            out.append(sorted((name, kind, places[b][0], places[e - 1][1], e - b, met) for name, kind, b, e, met in set(found)))
        return out

    def _groups(self, seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Seeds that follow each other in the text without a gap that no stretch spans."""
        groups: list[list[tuple[int, int]]] = []
        for at, end in sorted(seeds):
            if groups and at - groups[-1][-1][0] <= MAX_GAP + self.seed:
                groups[-1].append((at, end))
            else:
                groups.append([(at, end)])
        return groups

    def _ways(self, seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Seeds that follow each other both in the text and in the item: each occurrence of a part of the item."""
        ways: list[list[tuple[int, int]]] = []
        open_: list[list[tuple[int, int]]] = []
        for at, end in sorted(seeds):
            open_ = [w for w in open_ if at - w[-1][0] <= MAX_GAP + self.seed]
            near = [w for w in open_ if at > w[-1][0] and 0 < end - w[-1][1] <= MAX_GAP + self.seed]
            if near:
                min(near, key=lambda w: (abs((at - w[-1][0]) - (end - w[-1][1])), at - w[-1][0])).append((at, end))
            else:
                open_.append([(at, end)])
                ways.append(open_[-1])
        return ways

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """The maximal stretches of at least `seed` words whose neighbouring pairs may all stand in the items; no match
        of the automaton that matters reaches beyond one."""
        if self.seed < 2:
            return [(0, len(ids))] if len(ids) else []
        paired = np.zeros(len(ids) + 1, np.int8)
        if len(ids) > 1:
            paired[1:-1] = (ids[:-1] >= 0) & (ids[1:] >= 0) & self.pairs[_pair(ids[:-1], ids[1:])]
        edges = np.diff(paired)
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = ends - begins >= self.seed - 1
        return list(zip(begins[long].tolist(), (ends[long] + 1).tolist(), strict=True))

    def _stream(self, ids: list[int], begin: int, stop: int, doc: int, hits: dict[tuple[int, int], list[tuple[int, int]]], questions: list[tuple[int, int, int, int]]) -> None:
        auto, seed = self.automaton, self.seed
        first, to, more, link, size, known = auto.first, auto.to, auto.more, auto.link, auto.size, auto._places
        state = length = 0
        for at in range(begin, stop):
            word = ids[at]
            while True:
                if first[state] == word:
                    state = to[state]
                    break
                if (ways := more.get(state)) is not None and word in ways:
                    state = ways[word]
                    break
                if not state:
                    length = -1
                    break
                state = link[state]
                length = size[state]
            length += 1
            if length < seed:
                continue
            top = state
            while size[link[top]] >= seed:
                top = link[top]
            for sequence, end in known.get(top) or auto.places(top):
                if not self.whole[sequence]:
                    hits.setdefault((doc, sequence), []).append((at, end))
                elif length > end and end + 1 == len(self.sequences[sequence]) and ids[at - end : at + 1] == self.sequences[sequence]:
                    questions.append((doc, sequence, at - end, at + 1))

    def _covered(self, text: list[int], item: list[int], seeds: list[tuple[int, int]], bounds: tuple[int, int]) -> bool:
        """Whether a stretch of the item stands in the part of `text` within `bounds`."""
        return any(self._group_covered(text, item, group, bounds) for group in self._groups(seeds))

    def _group_covered(self, text: list[int], item: list[int], seeds: list[tuple[int, int]], bounds: tuple[int, int]) -> bool:
        runs: list[list[int]] = []  # text start, item start, length
        open_at: dict[int, list[int]] = {}
        for at, end in seeds:
            run = open_at.get(at - end)
            if run is not None and run[0] + run[2] == at:
                run[2] += 1
            else:
                run = [at - self.seed + 1, end - self.seed + 1, self.seed]
                runs.append(run)
                open_at[at - end] = run
        if max(r[2] for r in runs) >= self.min_words:
            return True
        if not self._enough(runs):
            return False
        runs.sort()
        return len(runs) > 1 and self._chained(text, item, runs) or self._aligned(text, item, runs, bounds)

    def _enough(self, runs: list[list[int]]) -> bool:
        """Whether as many words of the text and of the item stand in runs as any stretch has."""
        return sum(r[2] for r in runs) >= self.least and all(len({x for r in runs for x in range(r[side], r[side] + r[2])}) >= self.least for side in (0, 1))

    def _chained(self, text: list[int], item: list[int], runs: list[list[int]]) -> bool:
        """Whether a chain from one run to another is long and true enough; quick, and right where it says so."""
        gaps: dict[tuple[int, int, int, int], tuple[int, int]] = {}  # the distance, and up to where it is exact
        last = max(r[1] + r[2] for r in runs)
        for first in range(len(runs)):
            edits: dict[int, int] = {first: 0}
            start = runs[first][1]
            most = min(last - start, self.most) // self.per_edit  # edits that the longest chain from here may hold
            if last - start < self.min_words:
                continue
            for p in range(first, len(runs)):
                if p not in edits:
                    continue
                text_end, item_end = runs[p][0] + runs[p][2], runs[p][1] + runs[p][2]
                if item_end - start >= self.min_words and edits[p] * self.per_edit <= item_end - start:
                    return True
                for q in range(p + 1, len(runs)):
                    if runs[q][0] > text_end + MAX_GAP:
                        break
                    cut = max(0, text_end - runs[q][0], item_end - runs[q][1])
                    a, b = runs[q][0] + cut, runs[q][1] + cut
                    least = edits[p] + max(abs((a - text_end) - (b - item_end)), (max(a - text_end, b - item_end) + self.seed - 1) // self.seed)
                    if cut >= runs[q][2] or b > item_end + MAX_GAP or least > most or least >= edits.get(q, 1 << 30):
                        continue
                    gap = (text_end, a, item_end, b)
                    known = gaps.get(gap)
                    if known is None or known[0] > known[1] and known[1] < most - edits[p]:  # not known as far as it matters
                        gaps[gap] = known = (edit_distance(text[text_end:a], item[item_end:b], most - edits[p]), most - edits[p])
                    n = edits[p] + known[0]
                    if n <= most and n < edits.get(q, 1 << 30):
                        edits[q] = n
        return False

    def _aligned(self, text: list[int], item: list[int], runs: list[list[int]], bounds: tuple[int, int]) -> bool:
        """The exact check around runs that lie together on neighbouring diagonals: all stretches of the item against all
        of the text, by edit distance. Of a stretch with at most one edit in PER_EDIT words, `least` or more words stand in
        runs of SEED words, and nearly all words of some MIN_WORDS lie within DRIFT of a diagonal; places without that are
        left out."""
        reach = 2 * self.min_words
        for near in self._together(runs, reach):
            if not self._enough(near):
                continue
            lo_t, lo_i = max(bounds[0], min(r[0] for r in near) - reach), max(0, min(r[1] for r in near) - reach)
            t = np.array(text[lo_t : min(bounds[1], max(r[0] + r[2] for r in near) + reach)], np.int64)
            i = np.array(item[lo_i : max(r[1] + r[2] for r in near) + reach], np.int64)
            if len(i) < self.min_words:
                continue
            offsets = sorted({r[0] - lo_t - (r[1] - lo_i) + k for r in near for k in range(-DRIFT, DRIFT + 1)})
            met = np.zeros(len(i), bool)
            for k in offsets:
                a, b = max(0, -k), min(len(i), len(t) - k)
                if a < b:
                    met[a:b] |= i[a:b] == t[a + k : b + k]
            there = np.concatenate([[0], np.cumsum(met)])
            if (there[self.min_words :] - there[: -self.min_words]).max() < 0.75 * self.min_words:
                continue
            ramp = np.arange(len(t) + 1)
            row = np.zeros((len(i), len(t) + 1), np.int64)  # one line for each first word of a stretch
            for n in range(1, min(len(i), self.most) + 1):
                row = row[: len(i) - n + 1]
                new = np.empty_like(row)
                new[:, 0] = n
                new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (i[n - 1 :, None] != t[None, :]))
                row = np.minimum.accumulate(new - ramp, axis=1) + ramp
                best = int(row.min())
                if n >= self.min_words and best * self.per_edit <= n:
                    return True
                if best * self.per_edit > self.most:
                    break
        return False

    def _together(self, runs: list[list[int]], reach: int) -> Iterator[list[list[int]]]:
        """Runs on diagonals that lie within DRIFT of each other one by one, and in reach of each other in the text."""
        by_diagonal = sorted(runs, key=lambda r: r[0] - r[1])
        begin = 0
        for end in range(1, len(runs) + 1):
            if end < len(runs) and by_diagonal[end][0] - by_diagonal[end][1] - (by_diagonal[end - 1][0] - by_diagonal[end - 1][1]) <= DRIFT:
                continue
            own, begin = sorted(by_diagonal[begin:end]), end
            first = 0
            for last in range(1, len(own) + 1):
                if last < len(own) and own[last][0] <= own[last - 1][0] + own[last - 1][2] + reach:
                    continue
                yield own[first:last]
                first = last


_blocks: dict[str, Items] = {}


def _against(df: DataFrame, items: list[tuple[str, str | None, str | None]], read: Callable[[Items, list[str]], list[list[tuple]]], schema: str, **limits: int) -> DataFrame:
    """`df` (key, text) through `read`, which gives each text's rows; the key stands before them."""
    shared = df.sparkSession.sparkContext.broadcast(items)
    name = uuid.uuid4().hex
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _blocks:
            _blocks.clear()
            _blocks[name] = Items(shared.value, **limits)
        for batch in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for at in range(0, batch.num_rows, STEP):
                for i, own in enumerate(read(_blocks[name], batch.column(1).slice(at, STEP).to_pylist()), at):
                    rows += [i] * len(own)
                    out += own
            columns = [pa.array([x[c] for x in out], _ARROW[t]) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["key", *names])

    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return df.mapInArrow(run, f"key {kind}, {schema}")


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _item_blocks(items: DataFrame, item: str, context: str, question: str, block_chars: int) -> list[list[tuple]]:
    """The items in blocks of bounded size; at least one block, which may be empty."""
    blocks: list[list[tuple]] = [[]]
    chars = 0
    named = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("string"), context, question)
    for row in named.toLocalIterator():
        if chars >= block_chars:
            blocks.append([])
            chars = 0
        blocks[-1].append(tuple(row))
        chars += sum(len(x or "") for x in row)
    return blocks


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "doc_id", context: str = "context_text", question: str = "query_prompt", block_chars: int = BLOCK_CHARS, **limits: int) -> DataFrame:
    """key, item_id: one row per document and test item found in it.

    Null and empty texts leak nothing, items with a null name are left out, null contexts and questions are skipped; an
    empty table on either side gives no rows. Repeated documents give repeated rows, repeated items none beyond the first.
    """
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    read = lambda found, texts: [[(name,) for name in sorted(names)] for names in found.find(texts)]
    parts = [_against(kept, block, read, "item_id string", **limits) for block in _item_blocks(items, item, context, question, block_chars)]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)


def leak_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "doc_id", context: str = "context_text", question: str = "query_prompt", block_chars: int = BLOCK_CHARS, coverage: float = COVERAGE, **limits: int) -> DataFrame:
    """key, item_id, kind (`question` or `context`), begin_at, end_at (code points, from 0, the end not included), n_words,
    coverage: where the items of `leaked` stand; the same documents and items, each with one row for every span."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    read = lambda found, texts: found.spans(texts, coverage)
    schema = "item_id string, kind string, begin_at int, end_at int, n_words int, coverage double"
    parts = [_against(kept, block, read, schema, **limits) for block in _item_blocks(items, item, context, question, block_chars)]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[int, str]:
    """How many code points the spans cover, and the text without them."""
    parts, at, gone = [], 0, 0
    for begin, end in sorted(spans):
        if end > at:
            parts.append(text[at : max(at, begin)])
            gone += end - max(at, begin)
            at = end
    return gone, "".join([*parts, text[at:]])


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "doc_id", context: str = "context_text", question: str = "query_prompt", block_chars: int = BLOCK_CHARS, coverage: float = COVERAGE, **limits: int) -> DataFrame:
    """key, n_removed, text: every row with a non-null text, without the spans of `leak_spans`, and the code points taken
    out. Blocks of items follow each other, each over what the ones before left."""
    now = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    read = lambda found, texts: [[cut(t, [x[2:4] for x in own])] for t, own in zip(texts, found.spans(texts, coverage), strict=True)]
    removed = F.lit(0)
    for block in _item_blocks(items, item, context, question, block_chars):
        step = _against(now.select(F.struct("key", removed.alias("n")).alias("key"), "text"), block, read, "n_removed int, text string", **limits)
        now = step.select("key.key", (F.col("key.n") + F.col("n_removed")).alias("n_removed"), "text")
        removed = F.col("n_removed")
    return now.withColumnRenamed("key", key)
