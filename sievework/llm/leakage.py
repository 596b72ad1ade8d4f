"""Evaluation texts leaking into training text.

Texts are normalised to lower-case words (letters and digits only), which forgets punctuation,
markup, line breaks and line prefixes; the position of each word in the original is kept. One
Aho-Corasick automaton over all windows of ``SEED`` consecutive words of the evaluation items scans
each text once. Hits on one diagonal (same distance between the word's place in the text and in the
item) grow into passages: gaps in which no two neighbouring words differ are bridged, so single
replaced words do not matter. Passages of at least ``PASSAGE`` words are chained in the item's
order, in time linear in their number; a text leaks an item if its best chain holds at least ``SHARE`` of the item's words. Words in
another order, shared short phrases and a shared notice form no such chain.

The items are held-out tests: a small table. They are read in blocks of at most ``ITEM_BLOCK``
characters; each block is one automaton and one pass over the corpus, so what is sent to the
workers is bounded whatever the number of items. A worker builds an automaton once and keeps it for
all its tasks; items of the same words are one. Nothing is shuffled.

Edge cases: null and empty texts or items leak nothing; items with fewer than ``SEED`` words are
matched as a whole; very long texts are scanned whole, in linear time; repeated items and rows give
repeated pairs before ``distinct``; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 4
PASSAGE = 6
SHARE = 0.5
ITEM_BLOCK = 4_000_000
WORD = re.compile(r"[^\W_]+")

FOUND = "doc_id long, item_id long, words int, share double, start long, stop long, passages int"


def words_of(text: str) -> list[str]:
    """Normalised words."""
    return [w.lower() for w in WORD.findall(text)]


def places_of(text: str) -> list[tuple[int, int]]:
    """Where the words lie in the original text."""
    return [m.span() for m in WORD.finditer(text)]


class Matcher:
    """The automaton over a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        same: dict[tuple[str, ...], list[int]] = {}
        for i, t in items:
            same.setdefault(tuple(words_of(t)), []).append(i)
        self.items = [(ids, list(w)) for w, ids in same.items()]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in self.items for w in ws))}
        self.sizes = np.array([len(ws) for _, ws in self.items])
        self.longest = max((len(ws) for _, ws in self.items), default=0)
        self.numbers = np.full((len(self.items), self.longest), -2)
        for n, (_, ws) in enumerate(self.items):
            self.numbers[n, : len(ws)] = [self.vocabulary[w] for w in ws]
        places = defaultdict(list)
        for n, (_, w) in enumerate(self.items):
            size = min(SEED, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                places[" ".join(w[k : k + size])].append((n, k))
        self.automaton = ahocorasick.Automaton()
        for window, at in places.items():
            self.automaton.add_word(f" {window} ", (len(window) + 1, at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def hits(self, words: list[str]) -> dict[int, dict[int, set[int]]]:
        """item -> diagonal -> places in the item at which a seed starts."""
        line = " " + " ".join(words) + " "
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        starts = None
        for stop, (size, at) in self.automaton.iter(line):
            if starts is None:
                starts = [0, *accumulate(len(w) + 1 for w in words)]
            j = bisect_left(starts, stop - size)
            for n, k in at:
                found[n][j - k].add(k)
        return found

    def passages(self, words: list[str], n: int, diagonals: dict[int, set[int]]) -> list[tuple[int, int, int, int]]:
        """(item from, to, text from, to), ends excluded."""
        item = self.items[n][1]
        size = min(SEED, len(item))
        out = []
        for d, seeds in diagonals.items():
            equal = lambda k, d=d: 0 <= k < len(item) and 0 <= k + d < len(words) and item[k] == words[k + d]
            a = b = None
            for k in sorted(seeds):
                if b is not None and k <= b:
                    b = max(b, k + size)
                elif b is not None and all(equal(x) or equal(x + 1) for x in range(b, k)):
                    b = k + size
                else:
                    if b is not None:
                        out.append((a, b, a + d, b + d))
                    a, b = k, k + size
            out.append((a, b, a + d, b + d))
        grown = []
        for a, b, x, y in out:
            d = x - a
            equal = lambda k, d=d: 0 <= k < len(item) and 0 <= k + d < len(words) and item[k] == words[k + d]
            while equal(a - 1) or equal(a - 2) and equal(a - 3):
                a -= 1
            while equal(b) or equal(b + 1) and equal(b + 2):
                b += 1
            grown.append((a, b, a + d, b + d))
        least = min(PASSAGE, len(item))
        return sorted({p for p in grown if p[1] - p[0] >= least}, key=lambda p: (p[2], p[0]))

    @staticmethod
    def chain(passages: list[tuple[int, int, int, int]]) -> tuple[int, list[tuple[int, int, int, int]]]:
        """The most item words that passages cover in the order of both; overlaps count once.

        Passages come in the text's order. For each place of the item the best chain that ends there is kept, so a
        passage looks at as many chains as the item has words, however often the text repeats it.
        """
        best: list[tuple[int, int]] = []
        ends: dict[int, int] = {}  # item place -> passage that ends the best chain up to there
        top_at = -1
        for i, (a, b, x, y) in enumerate(passages):
            top = (b - a, -1)
            for b2, j in ends.items():
                a2, _, x2, y2 = passages[j]
                if a2 <= a and b2 <= b and x2 <= x and y2 <= y:
                    gain = best[j][0] + b - max(a, b2, a + max(0, y2 - x))
                    if gain > top[0]:
                        top = (gain, j)
            best.append(top)
            if b not in ends or top[0] > best[ends[b]][0]:
                ends[b] = i
            if top_at < 0 or top[0] > best[top_at][0]:
                top_at = i
        if not best:
            return 0, []
        total, way, i = best[top_at][0], [], top_at
        while i >= 0:
            way.append(passages[i])
            i = best[i][1]
        return total, way[::-1]

    def leaks(self, text: str) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(item_id, words, share, start, stop, passages) with places in the original text."""
        words, spans = words_of(text), None
        if self.empty or not words:
            return
        margin = self.longest
        padded = np.full(len(words) + 2 * margin, -1)
        padded[margin : margin + len(words)] = [self.vocabulary.get(w, -1) for w in words]
        hits = self.hits(words)
        if not hits:
            return
        owner = np.array([n for n, diagonals in hits.items() for _ in diagonals])
        start = np.array([d for diagonals in hits.values() for d in diagonals]) + margin
        # of two neighbouring words of a passage one is equal at least, so passages hold no more than twice the equal words
        parts = [slice(a, a + 20_000) for a in range(0, len(start), 20_000)]
        equal = np.concatenate([(padded[start[x, None] + np.arange(margin)] == self.numbers[owner[x]]).sum(1) for x in parts])
        most = np.bincount(owner, 2 * equal + 1, len(self.items))
        for n in np.flatnonzero((most > 0) & (most >= SHARE * self.sizes)):
            diagonals = hits[n]
            ids, item = self.items[n]
            total, way = self.chain(self.passages(words, n, diagonals))
            if total >= SHARE * len(item):
                spans = spans or places_of(text)
                for item_id in ids:
                    yield item_id, total, total / len(item), spans[way[0][2]][0], spans[way[-1][3] - 1][1], len(way)


#: Automata of this worker by block; a scan needs one at a time.
_MATCHERS: dict[str, Matcher] = {}


def matcher_for(key: str, items: list[tuple[int, str]]) -> Matcher:
    if key not in _MATCHERS:
        if len(_MATCHERS) > 3:
            _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items)
    return _MATCHERS[key]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per text and item of which it holds at least half."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    rows = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").dropDuplicates().orderBy("item_id").toLocalIterator()
    found = None
    block: list[tuple[int, str]] = []

    def one_pass(block: list[tuple[int, str]]) -> DataFrame:
        shared, key = documents.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = matcher_for(key, shared.value)
            for f in frames:
                got = [(d, *x) for d, t in zip(f["doc_id"], f["text"], strict=True) for x in matcher.leaks(t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "words", "share", "start", "stop", "passages"])

        return texts.mapInPandas(scan, FOUND)

    size = 0
    for r in rows:
        if block and size + len(r[1]) > ITEM_BLOCK:
            part, block, size = one_pass(block), [], 0
            found = part if found is None else found.unionByName(part)
        block.append((r[0], r[1]))
        size += len(r[1])
    part = one_pass(block)
    return part if found is None else found.unionByName(part)
