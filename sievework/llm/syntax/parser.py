"""Bottom-up chart parser with repair.

``Parser.cost`` reads a text of one language:

1. tokens become one character each (``classes``);
2. innermost bracketed groups are replaced by cells, level by level. A group's text decides its
   cell, so groups and statements that look alike are parsed once per worker: the tables of the
   chart are shared by all files. A group that no rule derives becomes a flawed cell that stands
   for its repair;
3. what is left is the run of top-level statements.

A file without flaws costs nothing. Otherwise ``repair`` parses it again with the places of its
tokens and adds up the least edits: for the pairing of brackets, then for groups and statements under
that pairing; the places of the edits tell truncation (at the end), remains of a merge (at its markers) and content of
another kind (everywhere) apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from sievework.llm.syntax.brackets import pairing
from sievework.llm.syntax.languages import MAKERS, Language
from sievework.llm.syntax.rules import BASE, BROKEN, CLOSE, FLAW

#: Entries a table of the chart holds at most; a full one is emptied, which costs time but no results.
TABLE = 300_000
INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
BRACKET = re.compile(r"[()\[\]{}]")
FLAWED = re.compile("[" + "".join(FLAW.values()) + "]")
FLAWED_CELLS = frozenset(FLAW.values())
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: .*)?\r?$", re.M)


class Table(dict):
    """A dictionary that computes what is missing and stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= TABLE:
            self.clear()
        value = self[key] = self.make(key)
        return value


@dataclass
class Repair:
    cost: int
    reason: str
    places: list[int]


class Parser:
    def __init__(self, language: Language):
        self.lang = language
        g = language.grammar
        self.grammar = g
        self.classes = Table(self._class)
        self.cells = Table(self._cell)
        self.fit = {b: {n: Table(self._fits(rule)) for n, (_, rule) in by.items()} for b, by in language.rules.items()}
        self.top_fits = Table(lambda s: language.top.accepts(s) is not None)
        block = f"{chr(BASE['{'])}-{chr(BASE['{'] + 0x3FF)}{FLAW['{']}"
        self.block = block
        if language.goes_on == "*":
            heads = re.escape(language.long_heads)
            self.statement = re.compile(f"[{heads}][^;{block}]*(?:;[^;{block}]*){{1,2}}[{block}][^;]*;?|[^;]+;?|;" if heads else "[^;]+;?|;")
        else:
            on = re.escape(language.goes_on)
            more = "(?!)" if not on else f"(?=[{on}]|[{chr(BASE['('])}-{chr(BASE['('] + 0x3FF)}])" if g.name in ("js", "ts") else f"(?=[{on}])"
            named = f"[^;{block}]*[{re.escape(language.named_blocks)}]a?[{block}][^;{block}]*(?:[{block}][^;{block}]*)?;|" if language.named_blocks else ""
            self.statement = re.compile(f"{named}(?:[^;{block}]|[{block}]{more})*(?:;|[{block}];?|$)")
        joins = re.escape("".join(sorted(language.joins_line)))
        self.join_after = re.compile(f"\n+(?=[{joins}])") if joins else None

    @staticmethod
    def _fits(rule):
        return lambda s: rule.accepts(s) is not None

    # ---------------------------------------------------------------- tokens

    def _class(self, t: str) -> str:
        g = self.grammar
        if t in g.keywords:
            return g.keywords[t]
        if t in g.operators:
            return g.operators[t]
        if t == "\n":
            return "\n"
        t = t.lstrip(" \t") or t
        c = t[0]
        if t.startswith(self.lang.skip) and self.lang.skip:
            if t.startswith("/*") and not (t.endswith("*/") and len(t) > 3):
                return BROKEN
            if c == "#" and len(t) == 1:
                return "#"
            return "\n" if "\n" in t and self.lang.ends_line is not None else ""
        if c.isdigit() or len(t) > 1 and (c == "." or c == "-") and t[1].isdigit():
            return "0"
        if c.isalpha() and not t.endswith(('"', "'", "#")) or c in "_$" or c == "_":
            return "a"
        if len(t) > 1:
            if t.startswith('"""'):
                return '"' if t.endswith('"""') and len(t) > 5 else BROKEN
            if c == "/":
                return "/"
            body = t.lstrip("br#")
            q = body[:1] or c
            if q in "\"'`":
                closed = len(body) > 1 and body.rstrip("#")[-1:] == q and not re.search(r"(?<!\\)(?:\\\\)*\\$", body[:-1])
                if q == "'" and not closed and re.fullmatch(r"'\w+", body) and self.grammar.name == "rust":
                    return "L"
                return ("`" if q == "`" and self.grammar.name in ("js", "ts") else '"') if closed else BROKEN
        if c in "\"'`":
            return BROKEN
        if c in "\\" or ord(c) < 32:
            return BROKEN
        return c

    def line_ends(self, s: str) -> str:
        """Line breaks as semicolons where the language ends a statement there."""
        ends = self.lang.ends_line
        if ends is None:
            return s
        if self.join_after is not None:
            s = self.join_after.sub("", s)
        out = []
        for line in s.split("\n"):
            if line:
                out.append(line)
                last = line[-1]
                out.append(";" if last in ends or last in ")]}" else "")
        return "".join(out)

    def read(self, text: str) -> str:
        return "".join(map(self.classes.__getitem__, self.lang.tokens.findall(text) if self.lang.tokens.groups == 0 else (m.group() for m in self.lang.tokens.finditer(text))))

    # ---------------------------------------------------------------- chart

    def _parts(self, form: str, inner: str) -> list[str] | None:
        """Pieces of a group's text that must each be derived; None if the form itself is violated."""
        if form == "whole":
            return [inner]
        if form == "semi":
            parts = inner.split(";")
            return parts[:-1] if len(parts) > 1 and not parts[-1] and len(parts) != 3 else parts
        if form == "run":
            return [x for x in self.statement.findall(inner) if x]
        inner = inner.replace(";", ",") if form == "fields" else inner
        if form == "fields":
            return [x for x in inner.split(",") if x]
        if form == "arms":
            block = re.compile(f"(=>|{re.escape(self.grammar.token('=>'))})([{self.block}])(?![,.?])")
            return [x for x in block.sub(r"\1\2,", inner).split(",") if x]
        if not inner:
            return []
        parts = inner.split(",")
        if form == "strict":
            return parts
        if parts[-1] == "" and len(parts) > 1:
            parts.pop()
        return parts

    def _typed_parts(self, parts: list[str]) -> list[str]:
        """Parts of a list with those joined that a comma between angle brackets of a type had parted."""
        two, three = self.grammar.operators.get(">>", ""), self.grammar.operators.get(">>>", "")
        out: list[str] = []
        depth = 0
        for p in parts:
            if depth > 0:
                out[-1] += "," + p
            else:
                out.append(p)
            depth += p.count("<") - p.count(">") - (2 * p.count(two) if two else 0) - (3 * p.count(three) if three else 0)
        return out

    def _cell(self, group: str) -> str:
        bracket, inner = group[0], group[1:-1]
        if bracket != "{" and self.lang.ends_line is not None or self.grammar.name == "go" and bracket == "[":
            inner = inner.rstrip(";")
        mask = 0
        for i, (name, (form, _)) in enumerate(self.lang.rules[bracket].items()):
            text = inner
            if form in ("list", "fields", "strict", "arms", "whole") and self.lang.ends_line is not None:
                text = inner.rstrip(";")
            fit = self.fit[bracket][name]
            parts = self._parts(form, text)
            if all(fit[p if form != "run" or self.grammar.name != "go" else p.rstrip(";")] for p in parts):
                mask |= 1 << i
            elif form in ("list", "fields") and "<" in text and all(map(fit.__getitem__, self._typed_parts(parts))):
                mask |= 1 << i
        if mask:
            return chr(BASE[bracket] + mask)
        return FLAW[bracket]

    def reduce(self, s: str) -> str:
        cells = self.cells
        while True:
            t = INNER.sub(lambda m: cells[m.group()], s)
            if t == s or FLAWED.search(t):
                return t  # an outer group would take a flawed one for its repair
            s = t

    def top_parts(self, s: str) -> list[str]:
        if self.grammar.name == "json":
            return [s]
        parts = [p for p in self.statement.findall(s) if p]
        return [p.rstrip(";") for p in parts] if self.grammar.name == "go" else parts

    def valid(self, text: str) -> bool:
        s = self.read(text)
        if BROKEN in s:
            return False
        s = self.reduce(self.line_ends(s))
        if FLAWED.search(s) or BRACKET.search(s):
            return False
        parts = self.top_parts(s)
        if self.lang.first is not None:
            named = [p for p in parts if p]
            if not named or not self.lang.first.accepts(named[0]):
                return False
        return all(map(self.top_fits.__getitem__, parts))

    # ---------------------------------------------------------------- repair

    def placed(self, text: str) -> tuple[str, list[int]]:
        chars, at = [], []
        for m in self.lang.tokens.finditer(text):
            c = self.classes[m.group()]
            if c:
                chars.append(c)
                at.append(m.start())
        ends = self.lang.ends_line
        if ends is None:
            return "".join(chars), at
        out, where = [], []
        for i, c in enumerate(chars):
            if c == "\n":
                j = i + 1
                while j < len(chars) and chars[j] == "\n":
                    j += 1
                if out and (out[-1] in ends or out[-1] in ")]}") and not (j < len(chars) and chars[j] in self.lang.joins_line):
                    out.append(";")
                    where.append(at[i])
            else:
                out.append(c)
                where.append(at[i])
        return "".join(out), where

    def repair(self, text: str) -> Repair:
        """Least cost and places of the edits of a text that is not valid."""
        s, at = self.placed(text)
        places: list[int] = []
        cost = 0
        partner, _ = pairing(s)
        stack: list[tuple[str, int, int]] = []
        frames: list[list[tuple[str, int]]] = [[]]

        def close_group(bracket: str, items: list[tuple[str, int]], place: int) -> tuple[str, int]:
            nonlocal cost
            group = bracket + "".join(c for c, _ in items) + CLOSE[bracket]
            cell = self.cells[group]
            if cell in FLAWED_CELLS:
                c, edits = self._group_repair(bracket, items)
                cost += c
                places.extend(edits or [place])
            return cell, place

        for i, (c, p) in enumerate(zip(s, at, strict=True)):
            if c == BROKEN:
                cost += 1
                places.append(p)
            elif c in BASE:
                stack.append((c, p, i))
                frames.append([])
            elif c in ")]}":
                if i not in partner:
                    cost += 1
                    places.append(p)
                    continue
                while True:
                    b, q, k = stack.pop()
                    if k != partner[i] or CLOSE[b] != c:  # one that nothing closes, or that another bracket does
                        cost += 1
                        places.append(p)
                    items = frames.pop()
                    frames[-1].append(close_group(b, items, q))
                    if k == partner[i]:
                        break
            else:
                frames[-1].append((c, p))
        end = len(text)
        unclosed = len(stack)
        while stack:
            b, q, _ = stack.pop()
            items = frames.pop()
            cost += 1
            places.append(end)
            frames[-1].append(close_group(b, items, q))
        rest = frames[0]
        flat = "".join(c for c, _ in rest)
        i = 0
        parts = self.top_parts(flat)
        for part in parts:
            i = max(i, flat.find(part, i))
            if not self.top_fits[part]:
                c, edits = self.lang.top.repair(part)
                cost += c
                places += [rest[min(i + e, len(rest) - 1)][1] if i + e < len(rest) else end for e in edits] or [end]
            i += len(part)
        if self.lang.first is not None:
            named = [p for p in parts if p]
            if not named or not self.lang.first.accepts(named[0]):
                cost += 1
                places.append(0)
        return Repair(max(1, cost), self.reason(text, places, unclosed), sorted(places))

    def _group_repair(self, bracket: str, items: list[tuple[str, int]]) -> tuple[int, list[int]]:
        """The rule whose repair of a group costs least."""
        inner = "".join(c for c, _ in items)
        best: tuple[int, list[int]] | None = None
        for name, (form, rule) in self.lang.rules[bracket].items():
            parts = self._parts(form, inner.rstrip(";") if form != "run" else inner)
            bad = [p for p in parts if not self.fit[bracket][name][p.rstrip(";") if self.grammar.name == "go" else p]]
            if best is not None and len(bad) >= best[0]:
                continue
            cost, edits, i = 0, [], 0
            for p in bad:
                i = max(i, inner.find(p, i))
                c, e = rule.repair(p.rstrip(";") if self.grammar.name == "go" else p)
                cost += c
                edits += [items[min(i + x, len(items) - 1)][1] for x in e] if items else []
                if best is not None and cost >= best[0]:
                    break
            if cost and (best is None or cost < best[0]):
                best = (cost, edits)
        return best or (1, [])

    @staticmethod
    def reason(text: str, places: list[int], unclosed: int) -> str:
        marks = [m.start() for m in CONFLICT.finditer(text)]
        if marks and len(places) <= 40:
            return "conflict"
        if not text.strip():
            return "empty"
        tail = max(0, len(text) - 120)
        at_end = sum(p >= tail for p in places)
        if unclosed and at_end or places and at_end == len(places):
            return "truncated"
        if places and max(places) < 300 and len(places) <= 4:
            return "beginning missing"
        lines = text.count("\n") + 1
        return "mismatch" if len(places) > max(2, lines // 20) else "error"


_PARSERS: dict[str, object] = {}


def parser_for(name: str):
    if name not in _PARSERS:
        if name == "py":
            from sievework.llm.syntax.python import PythonParser

            _PARSERS[name] = PythonParser()
        else:
            _PARSERS[name] = Parser(MAKERS[name]())
    return _PARSERS[name]
