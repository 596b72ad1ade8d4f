"""Files to chunks: symbols, sections, windows.

One file is one row in and some rows out, so parsing runs per Arrow batch in ``mapInPandas`` and
nothing is shuffled. Python is read with its own parser; other languages with a scanner that knows
strings, comments and brackets and looks for heads of definitions; what neither can read is cut in
windows of lines.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINES, WINDOW, OVERLAP = 200, 50, 10
CHUNKS = "id string, repo string, file_path string, line_start int, line_end int, content string, language string, symbol_type string, symbol_name string, part_index int"
WHOLE_FILE = frozenset({"toml", "yaml", "json", "ini", "dockerfile", "makefile"})

_MOD = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|unsafe|const|extern|inline|pub(?:\([^)\n]*\))?)[ \t]+)*"
#: Heads of definitions by language: (pattern with the name as group 1, kind).
HEADS = {
    "rust": [(rf"^[ \t]*{_MOD}fn[ \t]+(\w+)", "function"), (rf"^[ \t]*{_MOD}struct[ \t]+(\w+)", "struct"), (rf"^[ \t]*{_MOD}enum[ \t]+(\w+)", "enum"), (rf"^[ \t]*{_MOD}trait[ \t]+(\w+)", "trait"), (r"^[ \t]*impl\b[^{\n]*?(\w+)[ \t]*(?:<[^{\n]*>)?[ \t]*\{", "class"), (rf"^[ \t]*{_MOD}mod[ \t]+(\w+)[ \t]*\{{", "module")],
    "go": [(r"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(\w+)", "function"), (r"^type[ \t]+(\w+)[ \t]+struct", "struct"), (r"^type[ \t]+(\w+)[ \t]+interface", "interface")],
    "java": [(rf"^[ \t]*{_MOD}(?:class|record)[ \t]+(\w+)", "class"), (rf"^[ \t]*{_MOD}interface[ \t]+(\w+)", "interface"), (rf"^[ \t]*{_MOD}enum[ \t]+(\w+)", "enum"), (rf"^[ \t]+{_MOD}(?!return\b|new\b|else\b|throw\b)[\w<>\[\], .]+[ \t]+(\w+)[ \t]*\([^;{{}}()]*\)[^;{{}}=]*\{{", "method")],
    "javascript": [(rf"^[ \t]*{_MOD}function\*?[ \t]+(\w+)", "function"), (rf"^[ \t]*{_MOD}class[ \t]+(\w+)", "class"), (rf"^[ \t]*{_MOD}(?:const|let|var)[ \t]+(\w+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:\([^)\n]*\)|\w+)[^=\n]*=>", "function"), (r"^[ \t]*(?:export[ \t]+)?interface[ \t]+(\w+)", "interface"), (r"^[ \t]*(?:export[ \t]+)?(?:const[ \t]+)?enum[ \t]+(\w+)", "enum")],
    "c": [(r"^(?![ \t]*(?:if|for|while|switch|return|else)\b)[\w \t*]*?\b(\w+)[ \t]*\([^;{}()]*\)\s*\{", "function"), (r"^[ \t]*(?:typedef[ \t]+)?struct[ \t]+(\w+)\s*\{", "struct"), (r"^[ \t]*enum[ \t]+(\w+)\s*\{", "enum")],
}
HEADS["typescript"] = HEADS["javascript"]
HEADS["cpp"] = HEADS["c"]
_COMPILED = {k: [(re.compile(p, re.M), kind) for p, kind in v] for k, v in HEADS.items()}
_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'")

Piece = tuple[int, int, str | None, str | None]  # first line, last line, kind, name


def python_symbols(text: str) -> list[Piece] | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return None
    out: list[Piece] = []

    def visit(body, inside: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
                if isinstance(n, ast.ClassDef):
                    inner = [x for x in n.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                    # the class is its head; what follows between its members becomes blocks
                    head = min([min([x.lineno, *[d.lineno for d in x.decorator_list]]) for x in inner], default=n.end_lineno + 1) - 1
                    if head >= first:
                        out.append((first, head, "class", n.name))
                    visit(inner, True)
                else:
                    out.append((first, n.end_lineno, "method" if inside else "function", n.name))

    visit(tree.body, False)
    return out


def brace_symbols(text: str, language: str) -> list[Piece]:
    """Definitions whose body is a block; a definition inside a class is a piece of its own, the class is its head."""
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", "\x01", m.group()), text)  # no white space: heads must not run over it
    starts = [0, *(m.end() for m in re.finditer("\n", blank))]
    line = lambda p: bisect_right(starts, p)
    opens, close, stack = [], {}, []
    for m in re.finditer(r"[{}]", blank):
        if m.group() == "{":
            opens.append(m.start())
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    heads = sorted((m.start(1), m.start(), kind, m.group(1)) for head, kind in _COMPILED[language] for m in head.finditer(blank))
    out: list[Piece] = []
    done = -1
    for name_at, at, kind, name in heads:
        if at <= done:
            continue
        at += len(blank[at:name_at]) - len(blank[at:name_at].lstrip())
        body = bisect_left(opens, name_at)
        body = opens[body] if body < len(opens) else len(blank)
        ends = blank.find(";", name_at, body)
        stop = ends if ends >= 0 and kind not in ("class",) else close.get(body, len(blank) - 1)
        if kind in ("class", "interface", "trait", "module") and language in ("java", "rust") and line(stop) > line(at):
            out.append((line(at), line(at), kind, name))
        else:
            indented = blank[starts[line(at) - 1] : at] != ""
            out.append((line(at), line(stop), "method" if kind == "function" and indented else kind, name))
            done = stop
    return out


def markdown_sections(text: str, name: str) -> list[Piece]:
    """A heading starts a section; fences are respected; text before the first heading is named after the file."""
    out: list[Piece] = []
    start, title, fence = 1, name, False
    lines = text.split("\n")
    for n, x in enumerate(lines, 1):
        if re.match(r"\s*(```|~~~)", x):
            fence = not fence
        m = None if fence else re.match(r"#{1,6}\s+(.*\S)", x)
        if m:
            if n > start:
                out.append((start, n - 1, "section", title))
            start, title = n, m.group(1)
    out.append((start, len(lines), "section", title))
    return out


def with_gaps(symbols: list[Piece], lines: list[str]) -> list[Piece]:
    """Symbols with their comment in front, and blocks for what lies between; blank gaps are dropped."""
    out: list[Piece] = []
    at = 1
    for first, last, kind, name in sorted(symbols):
        if last < at:
            continue
        first = max(first, at)
        while first > at and re.match(r"\s*(//|/\*|\*|#(?!include|define)|@|\"\"\")", lines[first - 2]):
            first -= 1
        out.append((at, first - 1, "block", None))
        out.append((first, last, kind, name))
        at = last + 1
    out.append((at, len(lines), "block", None))
    return [p for p in out if p[1] >= p[0] and any(x.strip() for x in lines[p[0] - 1 : p[1]])]


def split_lines(first: int, last: int, lines: list[str], most: int = MAX_LINES) -> list[tuple[int, int]]:
    """Cuts a long piece: before the limit, at a closing brace alone, else at a statement end or blank line, else hard."""
    out = []
    while last - first + 1 > most:
        stop = first + most - 1
        back = range(stop, stop - max(3, most * 3 // 10) - 1, -1)
        brace = next((i for i in back if lines[i - 1].strip() in ("}", "};", "},")), None)
        soft = next((i for i in back if not lines[i - 1].strip() or lines[i - 1].rstrip().endswith(";")), None)
        cut = brace or soft or stop
        out.append((first, cut))
        first = cut + 1
    out.append((first, last))
    return out


def windows(n: int) -> list[tuple[int, int]]:
    return [(a + 1, min(a + WINDOW, n)) for a in range(0, max(n - OVERLAP, 1), WINDOW - OVERLAP)]


def window_bounds(lines):
    """The same windows as a column: an array of (line_start, line_end) for a number of lines."""
    starts = F.sequence(F.lit(0), F.greatest(lines - OVERLAP - 1, F.lit(0)), F.lit(WINDOW - OVERLAP))
    return F.transform(starts, lambda a: F.struct((a + 1).alias("line_start"), F.least(a + WINDOW, lines).alias("line_end")))


def chunk_text(text: str, language: str, path: str) -> list[tuple[int, int, str | None, str | None, int | None]]:
    """(first line, last line, kind, name, part) of the chunks of a file."""
    body = text[:-1] if text.endswith("\n") else text
    lines = body.split("\n")
    if not body.strip():
        return []
    name = path.rsplit("/", 1)[-1]
    if language in WHOLE_FILE:
        return [(1, len(lines), "block", name, None)]
    symbols: list[Piece] | None = None
    if language == "markdown":
        symbols = markdown_sections(body, name)
    elif language == "python":
        symbols = python_symbols(text)
    elif language in _COMPILED:
        symbols = brace_symbols(body, language)
    if not symbols:
        return [(a, b, "block", None, None) for a, b in windows(len(lines)) if any(x.strip() for x in lines[a - 1 : b])]
    out = []
    for first, last, kind, symbol in with_gaps(symbols, lines):
        parts = split_lines(first, last, lines)
        out += [(a, b, kind, symbol, n if len(parts) > 1 and symbol else None) for n, (a, b) in enumerate(parts, 1)]
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of files (repo, file_path, language, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for repo, path, language, content in zip(f["repo"], f["file_path"], f["language"], f["content"], strict=True):
                lines = content.split("\n")
                for n, (a, b, kind, symbol, part) in enumerate(chunk_text(content, language, path)):
                    rows.append((f"{repo}/{path}:{n}", repo, path, a, b, "\n".join(lines[a - 1 : b]), language, kind, symbol, part))
            out = pd.DataFrame(rows, columns=["id", "repo", "file_path", "line_start", "line_end", "content", "language", "symbol_type", "symbol_name", "part_index"])
            out["part_index"] = out["part_index"].astype("Int32")
            yield out

    return files.where("content is not null and file_path is not null").select("repo", "file_path", F.coalesce(F.lower("language"), F.lit("unknown")).alias("language"), "content").mapInPandas(run, CHUNKS)


def signature(language: str, content: str) -> str:
    """Head of a definition without its body; else the first three lines and how many follow."""
    lines = content.split("\n")
    if language == "python":
        for i, x in enumerate(lines):
            if re.match(r"\s*(?:async\s+)?(?:def|class)\b", x):
                j = i
                while j < len(lines) and not lines[j].rstrip().endswith(":"):
                    j += 1
                return "\n".join(lines[: min(j + 1, len(lines))]) + "\n    ..."
    elif "{" in content and language in _COMPILED:
        return content[: content.index("{")].rstrip() + " { ... }"
    return "\n".join(lines[:3]) + (f"\n[... {len(lines) - 3} more lines]" if len(lines) > 3 else "")


def is_data(line: str) -> bool:
    """Forty bytes or more with at most one word of four letters: numbers, hex, encoded text."""
    x = line.strip()
    return len(x.encode()) >= 40 and len(re.findall(r"[^\W\d_]{4,}", x)) <= 1


def collapse_data_lines(content: str, least: int = 4) -> str:
    """Runs of data lines as one short line each; shorter runs stay."""
    out: list[str] = []
    run: list[str] = []
    for x in [*content.split("\n"), None]:
        if x is not None and is_data(x):
            run.append(x)
            continue
        out += [f"[{len(run)} lines of data]"] if len(run) >= least else run
        run = []
        if x is not None:
            out.append(x)
    return "\n".join(out)


def collapsed(content):
    """`collapse_data_lines` as a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else collapse_data_lines(x))

    return run(content)


def mask_text(content: str, language: str) -> str:
    """Comments and strings blanked, line by line, so that patterns meet code only; the inside of strings that a pattern needs is kept by the caller."""
    if language == "python":
        keep = re.compile(r"#[^\n]*|(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')")
    else:
        keep = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
    return keep.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), content)


def masked(chunks: DataFrame) -> DataFrame:
    """Chunks whose comments are blank."""
    mask = F.pandas_udf(lambda c, lang: pd.Series([None if x is None else mask_text(x, y or "") for x, y in zip(c, lang, strict=True)]), "string")
    return chunks.withColumn("content", mask("content", "language"))


def embedding_text(chunks: DataFrame) -> DataFrame:
    """id, text: what is embedded of a chunk; absent parts leave no line."""
    from sievework.functions import text as t

    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    sign = F.pandas_udf(lambda a, b: pd.Series([signature(x, y) for x, y in zip(a, b, strict=True)]), "string")
    collapse = F.pandas_udf(lambda c: pd.Series([collapse_data_lines(x or "") for x in c]), "string")
    content = F.coalesce("content", F.lit(""))
    lines = F.concat_ws(
        "\n", part("Language", F.col("language")), part("Path", F.col("file_path")), part("Filename", t.file_name(F.col("file_path"))), part("Symbol", F.concat_ws(" ", "symbol_type", t.display_name(F.col("symbol_name"), F.col("part_index")))),
        part("Signature", sign(F.coalesce("language", F.lit("")), content)), part("Flow", t.flow_hints(content)), part("Code", collapse("content")),
    )
    return chunks.select("id", lines.alias("text"))


def truncate_to_budget(content: str, allowed: int) -> str:
    """At most ``allowed`` bytes, cut at a line and marked, never inside a character."""
    mark = "\n[...truncated]"
    raw = content.encode()
    if len(raw) <= allowed:
        return content
    marked = allowed >= len(mark)
    kept = raw[: allowed - len(mark) if marked else allowed].decode("utf-8", "ignore")
    if not marked:
        return kept
    return (kept[: kept.rindex("\n")] if "\n" in kept else kept) + mark


def within_budget(ranked: DataFrame, budget: int, group: str = "query_id") -> DataFrame:
    """Results of each query in rank order with the bytes of content that the shared budget leaves to each."""
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(budget) - F.coalesce(F.sum(F.octet_length("content")).over(before), F.lit(0)), F.lit(0))
    return ranked.withColumn("allowed", F.least(left, F.octet_length("content"))).where("allowed > 0")
