"""Grammar rules in a small notation, as an automaton for repairs and as a pattern for acceptance.

A grammar here has regular right-hand sides: brackets are the only recursion. The parser works
bottom-up: a bracketed group, whose inner groups are already reduced, is compared with the rules
that may stand inside such brackets and is replaced by one symbol, the *cell*, that tells which
rules derive it. What remains inside a group is a flat string of token classes, and a rule is a
regular expression over classes and cells.

Notation: quoted text is a token, a capitalised or known word a macro or keyword, ``P.x`` ``I.x``
``B.x`` a group in round, square or curly brackets that derives rule x (``P.x/y``: x or y), ``( ) | * + ?`` as usual.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

IDENT, NUMBER, STRING, LIFETIME, BROKEN = "a", "0", '"', "L", "\x01"
#: Cells: first code of each bracket, plus a bit per rule; one flawed cell per bracket.
BASE = {"(": 0xE000, "[": 0xE400, "{": 0xE800}
FLAW = {"(": "\uf000", "[": "\uf001", "{": "\uf002"}
CLOSE = {"(": ")", "[": "]", "{": "}"}
MAX_RULES = 10
#: Entries a memory of a rule holds at most.
MEMORY = 50_000

PIECE = re.compile(r"'([^']+)'|([PIB])\.([\w/]+)|(\w+)|([()|*+?])|\s+")


@dataclass
class Grammar:
    """Words and operators of a language, its macros, and its rules per bracket."""

    name: str
    keywords: dict[str, str] = field(default_factory=dict)
    operators: dict[str, str] = field(default_factory=dict)
    macros: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, list[str]] = field(default_factory=lambda: {"(": [], "[": [], "{": []})
    trees: dict[str, object] = field(default_factory=dict)

    def declare(self, keywords: str, operators: str, groups: dict[str, str]) -> None:
        self.keywords = {w: chr(0x100 + i) for i, w in enumerate(keywords.split())}
        self.operators = {w: chr(0x200 + i) for i, w in enumerate(operators.split())}
        self.kinds = {k: v.split() for k, v in groups.items()}
        assert all(len(v) <= MAX_RULES for v in self.kinds.values())

    def token(self, text: str) -> str:
        return self.keywords.get(text) or self.operators.get(text) or text

    def cells(self, bracket: str, names: str) -> str:
        """All cells of a bracket that derive one of the rules, as a set of characters."""
        kinds = self.kinds[bracket]
        mask = sum(1 << kinds.index(n) for n in names.split("/"))
        base = BASE[bracket]
        return FLAW[bracket] + "".join(chr(base + m) for m in range(1 << len(kinds)) if m & mask)

    def parse(self, text: str):
        """A rule as a tree of ('set', chars) ('seq', ...) ('alt', ...) ('*', x) ('+', x) ('?', x)."""
        pieces = [m for m in PIECE.finditer(text) if m.group().strip()]
        assert "".join(m.group() for m in PIECE.finditer(text)) == text, f"{self.name}: {text}"
        at = 0

        def alt():
            nonlocal at
            options = [seq()]
            while at < len(pieces) and pieces[at].group() == "|":
                at += 1
                options.append(seq())
            return options[0] if len(options) == 1 else ("alt", *options)

        def seq():
            nonlocal at
            parts = []
            while at < len(pieces) and pieces[at].group() not in ("|", ")"):
                parts.append(item())
            return parts[0] if len(parts) == 1 else ("seq", *parts)

        def item():
            nonlocal at
            m = pieces[at]
            at += 1
            if m.group() == "(":
                x = alt()
                assert pieces[at].group() == ")", text
                at += 1
            elif m.group(1):
                x = ("set", self.token(m.group(1)))
                assert len(x[1]) == 1, (self.name, m.group(1))
            elif m.group(2):
                x = ("set", self.cells({"P": "(", "I": "[", "B": "{"}[m.group(2)], m.group(3)))
            else:
                x = self.word(m.group(4))
            while at < len(pieces) and pieces[at].group() in ("*", "+", "?"):
                x = (pieces[at].group(), x)
                at += 1
            return x

        out = alt()
        assert at == len(pieces), (self.name, text)
        return out

    def word(self, w: str):
        fixed = {"a": IDENT, "N": NUMBER, "S": STRING, "L": LIFETIME}
        if w in fixed:
            return ("set", fixed[w])
        if w in self.keywords:
            return ("set", self.keywords[w])
        if w == "ANY":
            return ("set", "".join([IDENT, NUMBER, STRING, *self.keywords.values()]))
        if w not in self.trees:
            self.trees[w] = self.parse(self.macros[w])
        return self.trees[w]

    def rule(self, text: str) -> Rule:
        return Rule(simplify(self.parse(text)))


#: Results by identity of a tree, with the tree, which keeps the identity its own: macros are shared by many rules.
_SIMPLE: dict[int, tuple] = {}
_PATTERNS: dict[int, tuple] = {}


def simplify(tree):
    """The same rule with nested choices flattened and tokens of a choice joined in one set."""
    if id(tree) not in _SIMPLE:
        _SIMPLE[id(tree)] = tree, _simplify(tree)
    return _SIMPLE[id(tree)][1]


def _simplify(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    parts = [simplify(x) for x in tree[1:]]
    if kind == "alt":
        flat = [y for x in parts for y in (x[1:] if x[0] == "alt" else (x,))]
        chars = "".join(dict.fromkeys("".join(x[1] for x in flat if x[0] == "set")))
        rest = [x for x in flat if x[0] != "set"]
        if chars:
            rest.insert(0, ("set", chars))
        return rest[0] if len(rest) == 1 else ("alt", *rest)
    if kind == "seq":
        return ("seq", *[y for x in parts for y in (x[1:] if x[0] == "seq" else (x,))])
    return (kind, *parts)


def pattern(tree) -> str:
    if id(tree) not in _PATTERNS:
        _PATTERNS[id(tree)] = tree, _pattern(tree)
    return _PATTERNS[id(tree)][1]


def _pattern(tree) -> str:
    kind = tree[0]
    if kind == "set":
        return re.escape(tree[1]) if len(tree[1]) == 1 else "[" + _ranges(tree[1]) + "]"
    if kind == "seq":
        return "".join(map(pattern, tree[1:]))
    if kind == "alt":
        single = [x for x in tree[1:] if x[0] == "set"]
        rest = [pattern(x) for x in tree[1:] if x[0] != "set"]
        if len(single) > 1:
            rest.insert(0, pattern(("set", "".join(x[1] for x in single))))
        else:
            rest = [pattern(x) for x in tree[1:]]
        return "(?:" + "|".join(rest) + ")"
    inner = pattern(tree[1])
    return (inner if tree[1][0] in ("set", "alt") else f"(?:{inner})") + kind


@lru_cache
def _ranges(chars: str) -> str:
    codes = sorted(set(map(ord, chars)))
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        lo, hi = re.escape(chr(codes[i])), re.escape(chr(codes[j]))
        out.append(lo if i == j else lo + hi if j == i + 1 else f"{lo}-{hi}")
        i = j + 1
    return "".join(out)


class Rule:
    """A regular right-hand side."""

    def __init__(self, tree):
        self.tree = tree
        self.accepts = re.compile(pattern(tree)).fullmatch
        self._chart = None
        self._repairs: dict[str, tuple[int, list[int]]] = {}

    @property
    def chart(self) -> Chart:
        if self._chart is None:
            self._chart = Chart(self.tree)
        return self._chart

    def repair(self, text: str) -> tuple[int, list[int]]:
        """Least number of token insertions, deletions and replacements, and where they are."""
        found = self._repairs.get(text)
        if found is None:
            if len(self._repairs) >= MEMORY:
                self._repairs.clear()
            found = self._repairs[text] = self.chart.repair(text)
        return found


class Chart:
    """Error-correcting chart over the places of a rule.

    The places of a rule are its occurrences of token sets, one bit each. A chart entry (i, k) holds
    the places at which i tokens can have been read with k edits; entries are sets held as numbers,
    so one step costs a few operations on words. Entries of one i grow with k and are kept only where
    they do, so there is no limit to k. Where a place can follow which is memorised by set.
    """

    def __init__(self, tree):
        self.sets: list[str] = []
        self.follow: list[int] = []
        empty, first, last = self._build(tree)
        self.empty, self.first, self.last = empty, first, last
        self.mask: dict[str, int] = {}
        for i, chars in enumerate(self.sets):
            for c in chars:
                self.mask[c] = self.mask.get(c, 0) | 1 << i
        self._after: dict[int, int] = {}

    def _build(self, t) -> tuple[bool, int, int]:
        kind = t[0]
        if kind == "set":
            self.sets.append(t[1])
            self.follow.append(0)
            bit = 1 << (len(self.sets) - 1)
            return False, bit, bit
        if kind == "alt":
            parts = [self._build(x) for x in t[1:]]
            return any(p[0] for p in parts), _or(p[1] for p in parts), _or(p[2] for p in parts)
        if kind == "seq":
            empty, first, last = True, 0, 0
            for x in t[1:]:
                e, f, z = self._build(x)
                self._link(last, f)
                first = first | f if empty else first
                last = last | z if e else z
                empty = empty and e
            return empty, first, last
        e, f, z = self._build(t[1])
        if kind in "*+":
            self._link(z, f)
        return e or kind in "*?", f, z

    def _link(self, last: int, first: int) -> None:
        for i in _bits(last):
            self.follow[i] |= first

    def after(self, places: int) -> int:
        out = self._after.get(places)
        if out is None:
            if len(self._after) >= MEMORY:
                self._after.clear()
            out = 0
            for i in _bits(places):
                out |= self.follow[i]
            self._after[places] = out
        return out

    def repair(self, text: str) -> tuple[int, list[int]]:
        """(cost, places of the edits). With a number of edits places only become more, so a row holds the numbers at which they do: [(edits, places)]."""
        start = 1 << len(self.sets)  # the place before everything
        step = lambda s: self.after(s & (start - 1)) | (self.first if s & start else 0)
        rows = self._closed([(0, start)], step)
        reached = [0] * (len(text) + 1)  # least edits with which so many tokens are read
        for i, c in enumerate(text):
            m = self.mask.get(c, 0)
            read = [(k, n & m) for k, _, n in rows]
            rows = self._closed(sorted(read + [(k + 1, r | n) for k, r, n in rows]), step)
            reached[i + 1] = rows[0][0]
        ends = self.last | (start if self.empty else 0)
        cost = next(k for k, r, _ in rows if r & ends)
        far, i = [], 0
        for k in range(cost):
            while i < len(text) and reached[i + 1] <= k:
                i += 1
            far.append(i)
        return cost, far

    @staticmethod
    def _closed(found: list[tuple[int, int]], step) -> list[tuple[int, int, int]]:
        """A row from places that are found with a number of edits, in ascending order, with those that insertions lead to, and the places that follow."""
        rows: list[tuple[int, int, int]] = []
        have = follow = at = k = 0
        while True:
            new = have | follow
            if new == have:  # no insertion adds a place: on to the next number at which one is found
                if at == len(found):
                    return rows
                k = max(k, found[at][0])
            while at < len(found) and found[at][0] <= k:
                new |= found[at][1]
                at += 1
            if new != have:
                follow |= step(new & ~have)
                have = new
                rows.append((k, have, follow))
            k += 1


def _or(values) -> int:
    out = 0
    for v in values:
        out |= v
    return out


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low
