"""Column functions over paths, identifiers and content. All stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path words by class, in the order in which classes are tried.
RUNTIME_WORDS = ("runtime", "bundle", "bundles", "extracted", "extract", "installed", "unpacked", "prebuilt", "preload", "tmp", "temp")
TEST_WORDS = ("test", "tests", "testing", "spec", "specs", "fixture", "fixtures")
EXAMPLE_WORDS = ("example", "examples", "demo", "demos", "sample")
BENCH_WORDS = ("bench", "benches", "benchmark", "benchmarks")
DOC_WORDS = ("docs", "doc", "readme", "guide", "guides", "changelog", "history", "adr")
GENERATED_WORDS = ("generated", "dist", "build", "coverage", "vendor", "binding", "bindings", "node_modules", "target", "out")
SOURCE_WORDS = ("src", "lib", "app", "apps", "crates", "packages")
ARCHIVE_FOLDERS = ("archive", "archived", "legacy", "deprecated", "backup", "backups", "old")
CONFIG_LANGUAGES = ("toml", "yaml", "json", "ini", "dockerfile", "makefile")
DOCUMENT_LANGUAGES = ("markdown", "rst")
SCOPES = {
    "source": ("source", "test", "example", "benchmark", "config", "unknown"),
    "docs": ("docs", "archive"),
    "runtime": ("runtime",),
}
ENTRY_STEMS = ("main", "index", "app", "lib", "mod", "server")
#: Language by extension (names without an entry are "unknown").
LANGUAGES = {
    "py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "sh": "bash", "lua": "lua", "zig": "zig", "hs": "haskell", "md": "markdown", "rst": "rst", "toml": "toml",
    "yaml": "yaml", "yml": "yaml", "json": "json", "ini": "ini", "sql": "sql", "html": "html", "css": "css", "xml": "xml", "proto": "protobuf",
}
FILE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "gemfile": "ruby", "rakefile": "ruby", "cmakelists.txt": "cmake"}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without what follows its last dot."""
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def depth(path: Column) -> Column:
    return F.regexp_count(path, F.lit(r"[/\\]"))


def detect_language(path: Column) -> Column:
    """By file name first, then by extension."""
    names = F.create_map(*[F.lit(x) for kv in FILE_NAMES.items() for x in kv])
    extensions = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(names[F.lower(file_name(path))], extensions[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("unknown"))


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression.

    ``*`` stays in a segment, ``**/`` spans any depth, a final ``**`` everything; other characters,
    ``?`` and ``[`` included, mean themselves. A pattern without ``*`` also matches as a folder.
    """
    p = pattern.replace("\\", "/").removeprefix("./").rstrip("/")
    out, i = "", 0
    while i < len(p):
        if p[i:] == "**":
            out += ".*"
            break
        if p.startswith("**/", i):
            out += "(?:|.*/)"
            i += 3
        elif p[i] == "*":
            out += "[^/]*"
            i += 1
        else:
            out += re.escape(p[i])
            i += 1
    folder = "(?:/.*)?" if p and "*" not in p else ""
    return f"^(?s:{out}{folder})$"


def glob_matches(path: Column, patterns: list[str], stored: bool = True) -> Column:
    """Whether a path matches one of the globs; pure folder patterns become prefix tests, which scans can use.

    Stored paths are relative with forward slashes; with ``stored=False`` paths of other forms are brought to it first.
    """
    clean = path if stored else F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    parts = []
    for p in patterns:
        q = p.replace("\\", "/").removeprefix("./").rstrip("/")
        if q.endswith("/**") and "*" not in q[:-3]:
            parts.append(clean.startswith(q[:-2]))
        else:
            parts.append(clean.rlike(glob_regex(p)))
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(True)


def _words(path: Column) -> Column:
    return F.split(F.lower(path), r"[^a-z0-9]+")


def _any(words: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))


def path_class(path: Column, language: Column) -> Column:
    """Content class from the path alone; the first rule that holds decides."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    words = _words(low)
    folders = F.slice(F.split(low, "/"), 1, F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    archive = _any(folders, ARCHIVE_FOLDERS) | _any(folders, ("snapshot", "snapshots")) & _any(folders, TEST_WORDS)
    runtime = low.rlike(r"\.asar|asar\.unpacked|/tmp/|/temp/|/cache/") | _any(words, RUNTIME_WORDS)
    lang = F.coalesce(F.lower(language), F.lit("unknown"))
    return (
        F.when(runtime, "runtime")
        .when(archive, "archive")
        .when(_any(words, TEST_WORDS), "test")
        .when(_any(words, EXAMPLE_WORDS), "example")
        .when(_any(words, BENCH_WORDS), "benchmark")
        .when(lang.isin(*DOCUMENT_LANGUAGES) | _any(words, DOC_WORDS), "docs")
        .when(lang.isin(*CONFIG_LANGUAGES), "config")
        .when(_any(words, GENERATED_WORDS) | low.contains("node_modules"), "generated")
        .when(_any(words, SOURCE_WORDS), "source")
        .when((lang != "unknown") & ~lang.isin(*DOCUMENT_LANGUAGES), "source")
        .otherwise("unknown")
    )


def text_lines(content: Column) -> Column:
    """Lines of a text; a final line feed starts none."""
    return F.split(F.regexp_replace(content, r"\n$", ""), "\n")


def looks_minified(content: Column) -> Column:
    lines = text_lines(content)
    n = F.when(content == "", 0).otherwise(F.size(lines))
    long = F.size(F.filter(lines, lambda x: F.octet_length(x) >= 240))
    size = F.octet_length(content)
    mean = F.floor(size / F.greatest(n, F.lit(1)))
    many = (long * 3 >= n) | (mean >= 180) & (long * 2 >= n) | content.contains("sourceMappingURL=") | content.contains("__webpack_require__")
    return F.when(n <= 1, size >= 1200).otherwise(many)


def content_class(path: Column, language: Column, content: Column) -> Column:
    base = path_class(path, language)
    generated = (path_class(path, F.lit("unknown")) == "generated") | F.coalesce(looks_minified(content), F.lit(False))
    return F.when(base.isin("source", "unknown", "runtime") & generated, "generated").otherwise(base)


def in_scope(cls: Column, scope: Column, include_generated: Column) -> Column:
    """Whether a class is visible in a scope ('source', 'docs', 'runtime'; null or other: all)."""
    generated = F.coalesce(include_generated, F.lit(False)) & (cls == "generated")
    s = F.lower(scope)
    return (
        F.when(s == "source", cls.isin(*SCOPES["source"]) | generated)
        .when(s == "docs", cls.isin(*SCOPES["docs"]))
        .when(s == "runtime", (cls == "runtime") | generated)
        .otherwise((cls != "generated") | F.coalesce(include_generated, F.lit(False)))
    )


def path_tokens(path: Column) -> Column:
    """Words of a path: split at separators and where lower case turns upper; the file name follows unless contained."""
    name = file_name(path)
    spaced = F.regexp_replace(path, r"(\p{Ll})(\p{Lu})", "$1 $2")
    compact = F.trim(F.regexp_replace(F.lower(spaced), r"[/\\_.\s-]+", " "))
    return F.when(compact == "", name).when(F.contains(compact, name), compact).otherwise(F.concat_ws(" ", compact, name))


def identifier_parts(token: Column) -> Column:
    """Parts of an identifier in lower case: at underscores if it has any, else at changes of case."""
    camel = F.regexp_replace(F.regexp_replace(token, r"([A-Z])([A-Z][a-z])", "$1_$2"), r"([a-z])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(F.when(token.contains("_"), token).otherwise(camel)), "_"), lambda p: p != "")


def split_identifiers(content: Column) -> Column:
    """Parts of all compound identifiers of a text, sorted, once each."""
    tokens = F.array_distinct(F.regexp_extract_all(content, F.lit(r"[A-Za-z0-9_]{4,}"), F.lit(0)))
    split = F.filter(F.transform(tokens, identifier_parts), lambda p: F.size(p) >= 2)
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(split), lambda p: F.length(p) >= 2))), " ")


def normalize_token(token: Column) -> Column:
    """Lower case without final s, if three characters remain."""
    low = F.lower(token)
    bare = F.regexp_replace(low, "s+$", "")
    return F.when(F.length(bare) >= 3, bare).otherwise(low)


def flow_hints(content: Column) -> Column:
    low = F.lower(content)
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    hints = F.array(
        F.when(has("if ", " else", "match ", "switch ", "case "), "branches"),
        F.when(has("for ", "while ", "loop ", ".iter(", ".map(", ".filter("), "loops"),
        F.when(has("try", "catch", "except", "raise", "throw", "err(", "result<", "bail!", "panic!", "abort("), "error handling"),
    )
    return F.array_join(F.array_compact(hints), ", ")


def is_data_line(line: Column) -> Column:
    t = F.trim(line)
    return (F.octet_length(t) >= 40) & (F.regexp_count(t, F.lit(r"\p{L}{4,}")) <= 1)


def display_name(symbol: Column, part: Column) -> Column:
    return F.when(part.isNotNull(), F.concat(symbol, F.lit(" (part "), part.cast("string"), F.lit(")"))).otherwise(symbol)


def token_estimate(content: Column) -> Column:
    return F.ceil(F.octet_length(content) / 4)


def analyze(text: Column) -> Column:
    """Terms for ranked search: runs of letters and digits in lower case, at most 40 characters long."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) <= 40)


# First words of questions, and words of prose.
QUESTION_STARTS = ("how", "what", "where", "why", "when", "which", "who", "does", "do", "is", "are", "can", "could", "should", "find", "show", "list", "get")
PROSE_WORDS = (
    "the", "a", "an", "of", "in", "for", "to", "with", "from", "that", "this", "all", "each", "every", "about", "between", "through", "during", "before", "after", "into",
    "using", "where", "when", "how", "what", "which", "does", "handle", "implement", "return", "returns",
)


def query_kind(query: Column) -> Column:
    """'identifier' or 'natural' by the form of a query."""
    q = F.regexp_replace(F.trim(query), r"\.+$", "")
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    n = F.size(words)
    compound = F.size(F.filter(words, lambda w: w.rlike(r"_|::|\.|/|\\|\p{Ll}\p{Lu}")))
    prose = F.size(F.filter(words, lambda w: F.lower(w).isin(*PROSE_WORDS)))
    question = F.lower(q).rlike("^(?:" + "|".join(QUESTION_STARTS) + ") ") | q.endswith("?")
    return (
        F.when(n <= 1, "identifier")
        .when(q.contains("::") | q.contains("->") | q.contains("."), "identifier")
        .when(compound > F.floor(n / 2), "identifier")
        .when(question | (prose >= 2) | (n >= 3) & (prose * 3 >= n), "natural")
        .when(n >= 3, "natural")
        .otherwise("identifier")
    )
