"""Grammar and parser of Python: logical lines over cells, and blocks by indentation."""

from __future__ import annotations

import re

from sievework.llm.syntax.brackets import pairing
from sievework.llm.syntax.parser import BRACKET, FLAWED, INNER, Parser, Repair, Table
from sievework.llm.syntax.rules import BASE, BROKEN, CLOSE, FLAW, Grammar

_OPS = "**= //= >>= <<= ... -> := ** // << >> == != <= >= += -= *= /= %= @= &= |= ^="
_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
TOKENS = re.compile(
    r"#[^\n]*|\\\r?\n|\n[ \t\r\f]*"
    + "|" + _PREFIX + r'"""(?:\\[\s\S]|[^\\])*?"""|' + _PREFIX + r"'''(?:\\[\s\S]|[^\\])*?'''"
    + "|" + _PREFIX + r"(?:\"\"\"|''')[\s\S]*"
    + "|" + _PREFIX + r'"(?:\\[\s\S]|[^"\\\n])*"|' + _PREFIX + r"'(?:\\[\s\S]|[^'\\\n])*'"
    + "|" + _PREFIX + r"[\"'][^\n]*"
    + r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)|\d\w*"
    + r"|[^\W\d]\w*|" + "|".join(re.escape(x) for x in _OPS.split()) + r"|\S"
)
WIDTH = 0x3000
LINE = re.compile("\n.", re.S)
BLANK = re.compile("(?:\n.)+(?=\n.)", re.S)
FOLLOWS = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "try", "except"), "except": ("try", "except"), "finally": ("try", "except", "else"), "case": ("match", "case")}


class PythonParser:
    def __init__(self):
        g = self.grammar = Grammar("python")
        g.declare(_WORDS, _OPS, {"(": "names items params comp args", "[": "comp list", "{": "comp dict"})
        g.macros = {
            "Id": "a|match|case|type",
            "Op": "'+'|'-'|'*'|'/'|'//'|'%'|'@'|'&'|'|'|'^'|'<<'|'>>'|'<'|'>'|'=='|'!='|'<='|'>='|'**'|and|or|in|not in|is|is not|':='",
            "Lambda": "lambda ( Id | N | S | None | True | False | '*' | '**' | ',' | '=' | '/' | '-' | '.' | P.args | I.list | B.dict )* ':'",
            "Unit": "( not | '-' | '+' | '~' | await | '*' | '**' | yield from? | Lambda )* ( Id | N | S+ | P.args/comp | I.list/comp | B.dict/comp | None | True | False | '...' | yield ) ( '.' Id | P.args/comp | I.list )*",
            "E": "Unit ( ( Op | if Unit ( Op Unit )* else ) Unit )*",
            "EL": "Unit ( ( Op | ',' | if Unit ( Op Unit )* else ) Unit )* ','?",
            "Comp": "( async? for EL in E ( if E )* )+",
            "Assign": "'='|'+='|'-='|'*='|'/='|'//='|'%='|'@='|'&='|'|='|'^='|'<<='|'>>='|'**='",
            "Dotted": "Id ( '.' Id )*",
            "As": "( as Id )?",
            "Simple": "EL ( Assign EL )* | Unit ':' E ( '=' EL )? | return EL? | raise ( E ( from E )? )? | assert E ( ',' E )? | del EL | pass | break | continue | ( global | nonlocal ) a ( ',' a )* "
            "| import Dotted As ( ',' Dotted As )* | from ( '.' | '...' )* Dotted? import ( '*' | Id As ( ',' Id As )* | P.names/args/params ) | type a I.list? '=' E",
            "Head": "( if | elif | while ) E ':' | async? for EL in EL ':' | ( else | try | finally ) ':' | except '*'? ( E As | EL )? ':' | async? with ( E ( as Unit )? ( ',' E ( as Unit )? )* | P.items/args ) ':' "
            "| async? def Id I.list? P.params ( '->' E )? ':' | class Id I.list? P.args? ':' | match EL ':' | case ( Pat ( ',' Pat )* ','? ) ( if E )? ':'",
            "Pat": "'*'? ( '-'? N | S+ | None | True | False | Id ( '.' Id )* P.args? | P.args | I.list | B.dict ) ( ( '|' | '+' | '-' ) ( '-'? N | S+ | None | True | False | Id ( '.' Id )* P.args? | P.args | I.list | B.dict ) )* As",
        }
        text = {
            "(": {
                "names": ("list", "Id As"),
                "items": ("list", "E ( as Unit )?"),
                "params": ("list", "( '*' | '**' )? Id ( ':' E )? ( '=' E )? | '*' | '/'"),
                "comp": ("whole", "E Comp"),
                "args": ("list", "( Id '=' )? E As"),
            },
            "[": {"comp": ("whole", "E Comp"), "list": ("list", "E? ':' E? ( ':' E? )? | E As")},
            "{": {"comp": ("whole", "( E ':' )? E Comp"), "dict": ("list", "E ( ':' E )? As")},
        }
        self.rules = {b: {n: (form, g.rule(r)) for n, (form, r) in by.items()} for b, by in text.items()}
        self.simple, self.head, self.decorator = g.rule("Simple"), g.rule("Head"), g.rule("'@' E")
        self.classes = Table(self._class)
        self.fit = {b: {n: Table(Parser._fits(rule)) for n, (_, rule) in by.items()} for b, by in self.rules.items()}
        self.cells = Table(self._cell)
        self.lines = Table(self._line)
        self.words = {g.keywords[w]: w for w in "if elif else for while try except finally with def class match case async".split()}

    def _class(self, t: str) -> str:
        g = self.grammar
        if t in g.keywords:
            return g.keywords[t]
        if t in g.operators:
            return g.operators[t]
        c = t[0]
        if c == "\n":
            width = 0
            for x in t[1:]:
                width = width + 1 if x == " " else (width // 8 + 1) * 8 if x == "\t" else width
            return "\n" + chr(WIDTH + min(width, 0x8000))
        if c == "#" or c == "\\" and len(t) > 1 or c in "\r\f﻿":
            return ""
        body = t.lstrip("rRbBfFuU")
        if body[:1] in ('"', "'") and (len(body) != len(t) or c in "\"'"):
            q = body[:3] if body[:3] in ('"""', "'''") else body[0]
            return '"' if len(body) >= 2 * len(q) and body.endswith(q) and not (len(q) == 1 and re.search(r"(?<!\\)(?:\\\\)*\\$", body[:-1])) else BROKEN
        if c.isdigit() or c == "." and len(t) > 1:
            return "0" if re.fullmatch(r"(?:0[xXoObB])?[\d_a-fA-F.]*(?:[eE][+-]?[\d_]+)?[jJ]?", t) and not re.fullmatch(r"0[0-9_]*[1-9]\d*", t) else BROKEN
        if c.isalpha() or c == "_":
            return "a"
        return BROKEN if c in "$?!`" or ord(c) < 32 else c

    def _parts(self, form: str, inner: str) -> list[str]:
        if form == "whole":
            return [inner]
        if not inner:
            return []
        parts = inner.split(",")
        return parts[:-1] if parts[-1] == "" and len(parts) > 1 else parts

    def _cell(self, group: str) -> str:
        bracket, inner = group[0], LINE.sub("", group[1:-1])
        mask = 0
        for i, (name, (form, _)) in enumerate(self.rules[bracket].items()):
            if all(map(self.fit[bracket][name].__getitem__, self._parts(form, inner))):
                mask |= 1 << i
        return chr(BASE[bracket] + mask) if mask else FLAW[bracket]

    def _line(self, s: str) -> tuple[str, str]:
        """(kind, word): simple 's', head with a block to follow 'h' or with statements on its line 'H', decorator 'd', flawed ''."""
        g = self.grammar
        word = self.words.get(s[0], "")
        if word == "async":
            word = self.words.get(s[1:2], "")
        if s[0] == "@":
            return ("d" if self.decorator.accepts(s) else "", "")
        if word:
            if self.head.accepts(s):
                return "h", word
            for i, c in enumerate(s):
                if c == ":" and i + 1 < len(s) and self.head.accepts(s[: i + 1]) and self._simples(s[i + 1 :]):
                    return "H", word
            if word not in ("match", "case"):
                return "", word
        assert g
        return ("s" if self._simples(s) else ""), ""

    def _simples(self, s: str) -> bool:
        parts = s.split(";")
        if len(parts) > 1 and not parts[-1]:
            parts.pop()
        return all(map(self.simple.accepts, parts))

    def read(self, text: str) -> str:
        return "".join(map(self.classes.__getitem__, TOKENS.findall("\n" + text)))

    def reduce(self, s: str) -> str:
        cells = self.cells
        while True:
            t = INNER.sub(lambda m: cells[m.group()], s)
            if t == s or FLAWED.search(t):
                return t  # an outer group would take a flawed one for its repair
            s = t

    def structure(self, s: str):
        """Numbers of the lines at which the text is no program; of the line after the last for an unexpected end."""
        lines = [x for x in BLANK.sub("", s).split("\n") if len(x) > 1]
        stack: list[list] = [[0, ""]]
        block = decorated = False
        kinds = self.lines
        for n, x in enumerate(lines):
            kind, word = kinds[x[1:]]
            width = ord(x[0]) - WIDTH
            if not kind:
                yield n
                kind = "h" if x.endswith(":") else "s"
            if block:
                if width <= stack[-1][0]:
                    yield n
                else:
                    stack.append([width, ""])
            elif width > stack[-1][0]:
                yield n
            if width < stack[-1][0]:
                while len(stack) > 1 and width < stack[-1][0]:
                    if stack.pop()[1] == "try":
                        yield n
                if width > stack[-1][0]:
                    yield n
            top = stack[-1]
            if decorated and not (kind == "d" or word in ("def", "class")):
                yield n
            if word in FOLLOWS and kind in "hH":
                if top[1] not in FOLLOWS[word] and not (word == "case" and len(stack) > 1 and stack[-2][1] == "match"):
                    yield n
            elif top[1] == "try":
                yield n
            top[1] = word
            block, decorated = kind == "h", kind == "d"
        if block or decorated or any(x[1] == "try" for x in stack):
            yield len(lines)

    def valid(self, text: str) -> bool:
        s = self.read(text)
        if BROKEN in s:
            return False
        s = self.reduce(s)
        if FLAWED.search(s) or BRACKET.search(s):
            return False
        return next(self.structure(s), None) is None

    def _group_repair(self, bracket: str, items: list[tuple[str, int]]) -> tuple[int, list[int]]:
        """Cost and places of the rule whose repair of a group costs least."""
        items = [x for x in items if x[0][0] != "\n"]
        inner = "".join(c for c, _ in items)
        end = items[-1][1] if items else 0
        best: tuple[int, list[int]] | None = None
        for name, (form, rule) in self.rules[bracket].items():
            cost, places, i = 0, [], 0
            for part in self._parts(form, inner):
                if not self.fit[bracket][name][part]:
                    c, edits = rule.repair(part)
                    cost += c
                    places += [items[i + e][1] if i + e < len(items) else end for e in edits]
                i += len(part) + 1
            if best is None or cost < best[0]:
                best = cost, places
        return best

    def _simples_repair(self, s: str) -> tuple[int, list[int]]:
        """Cost and offsets of the edits of statements on one line."""
        parts = s.split(";")
        if len(parts) > 1 and not parts[-1]:
            parts.pop()
        cost, edits, i = 0, [], 0
        for part in parts:
            c, e = self.simple.repair(part)
            cost += c
            edits += [i + x for x in e]
            i += len(part) + 1
        return cost, edits

    def _line_repair(self, s: str) -> tuple[int, list[int]]:
        """The same of a line: statements, a decorator, or a head with statements behind it or none."""
        found = [self._simples_repair(s), self.head.repair(s), self.decorator.repair(s)]
        for i, c in enumerate(s[:-1]):
            if c == ":":
                head, rest = self.head.repair(s[: i + 1]), self._simples_repair(s[i + 1 :])
                found.append((head[0] + rest[0], head[1] + [i + 1 + x for x in rest[1]]))
        return min(found, key=lambda x: x[0])

    def repair(self, text: str) -> Repair:
        at, chars = [], []
        for m in TOKENS.finditer("\n" + text):
            c = self.classes[m.group()]
            if c:
                chars.append(c)
                at.append(max(0, m.start() - 1))
        places: list[int] = []
        frames: list[list[tuple[str, int]]] = [[]]
        stack: list[tuple[str, int, int]] = []
        cost = 0
        partner, _ = pairing("".join(c[0] for c in chars))

        def closed(b: str, items: list[tuple[str, int]], place: int, places: list[int]) -> tuple[tuple[str, int], int]:
            """The cell of a group, and the cost of its repair."""
            cell = self.cells[b + "".join(x for x, _ in items) + CLOSE[b]]
            cost = 0
            if cell in FLAW.values():
                cost, edits = self._group_repair(b, items)
                places += edits or [place]
            return (cell, place), cost

        for i, (c, p) in enumerate(zip(chars, at, strict=True)):
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
                    cell, more = closed(b, frames.pop(), q, places)
                    cost += more
                    frames[-1].append(cell)
                    if k == partner[i]:
                        break
            else:
                frames[-1].append((c, p))

        # what is still open is closed at the end, or the brackets are no part of the program
        ends: list[tuple[int, list[int], int]] = []
        flat, total, edits = [*frames[-1]], cost, [*places]
        for (b, q, _), outer in zip(reversed(stack), reversed(frames[:-1]), strict=True):
            cell, more = closed(b, flat, q, edits)
            flat, total = [*outer, cell], total + 1 + more
            edits.append(len(text))
        ends.append((total + self._lines_repair(flat, edits, len(text)), edits, len(stack)))
        if stack:
            edits = [*places, *[q for _, q, _ in stack]]
            flat = [x for frame in frames for x in frame]
            ends.append((cost + len(stack) + self._lines_repair(flat, edits, len(text)), edits, 0))
        cost, places, unclosed = min(ends, key=lambda x: x[0])
        return Repair(max(1, cost), Parser.reason(text, places, unclosed), sorted(places))

    def _lines_repair(self, flat: list[tuple[str, int]], places: list[int], end: int) -> int:
        """Cost of the repair of lines and blocks; adds its places."""
        lines: list[tuple[str, list[int]]] = []
        for c, p in flat:
            if c[0] == "\n":
                lines.append((c[1], []))
            elif lines:
                body, where = lines[-1]
                lines[-1] = body + c, where
                where.append(p)
        lines = [x for x in lines if x[1]]
        cost, before = 0, -1
        for n in self.structure("".join("\n" + x for x, _ in lines)):
            if n == len(lines):
                cost += 1
                places.append(end)
                continue
            body, where = lines[n][0][1:], lines[n][1]
            if self.lines[body][0] or n == before:  # its place among the lines is wrong
                cost += 1
                places.append(where[0])
            else:
                c, edits = self._line_repair(body)
                cost += c
                places += [where[min(e, len(where) - 1)] for e in edits]
            before = n
        return cost
