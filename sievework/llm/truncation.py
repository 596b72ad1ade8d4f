"""Text cut off by field limits or mid-transfer.

A stack automaton reads a text once: code fences, strings, comments and brackets inside code; in
prose inline code and brackets, which a blank line closes (inline markup does not reach over
paragraphs), and markup tags, which stay open until they are closed. What is left on the stack,
broken characters and broken escapes at the end, and the form of the last line say how the text
ends. Whether an unterminated last line is a cut or a habit depends on the source, so three
baselines are counted over all distinct texts of the corpus: closing lines that recur (signatures,
notes), first lines of texts that are titles, and lengths at which the texts of a source pile up
(field limits). Words at the end of titles and list entries are looked up among the words of all
other places of the corpus: a last word that occurs nowhere else was cut.

One scan reads the ends of texts and the words of its task, each once; only counts, closing lines,
last words and lengths are shuffled. Texts whose end decides by itself take no part in the look-ups,
so no key is shared by most rows.

Edge cases: a null, empty or blank text is whole (there is nothing that could be cut); trailing
white space is ignored; repeated rows are judged alike; a null source is a source of its own; very
long texts are read whole in linear time; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut

#: Distinct texts in which a closing line must recur to count as a signature, and their share of the texts of its sources.
SIGNATURE_TEXTS, SIGNATURE_SHARE = 3, 0.002
SIGNATURE_CHARS = 40
TITLE_CHARS = 72
#: Share of bare titles among a source's distinct texts from which a title may also close a text that has none.
TITLE_SHARE = 0.05
#: A length is a field limit if this many distinct texts have it, and so many times the mean around it.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_AROUND = 5, 5.0, 10

MARK = re.compile(
    r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…|more|read more|truncated|cut|clipped|continued|snip)\s*\)"
    r"|\[[^\]\n]{0,40}\b(?:clipped|truncated|cut off|cut|snipped|trimmed|shortened|omitted)\b[^\]\n]{0,20}\]|<(?:truncated|snip|more)>|\bread more)\s*$",
    re.I,
)
TRAILS = re.compile(r"[^\W_]\s*(?:\.\.\.|…)$")
BROKEN = re.compile(r"(?:�|&(?:#?\w{0,6})|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-F]?)$")
LIST = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+\S")
FIELD = re.compile(r"\s{2,}[\w*]+(?:\s*\([^)]*\))?:\s+\S")
HEADING = re.compile(r"#{1,6}\s+\S|(?:={3,}|-{3,})$")
STAMPED = re.compile(r"\[?\d{1,4}[-:/.]\d\d(?:[-:/.]\d\d)?")
SPEAKER = re.compile(r"^[\w.-]{1,24}:\s")
ENDS = re.compile(r"[.!?。！？:;][\"'»”’)\]*_`]*$|[\"'»”’)\]`]{1,3}$")
SENTENCE = re.compile(r"[.!?;,:]\s|[.!?]$")
CODE_LINE = re.compile(
    r"[;{}]$|\)\s*:$|^\s*(?:return|import|from|def|class|if|for|while|else|elif|try|except|raise|assert|with|use|let|const|var|pub|fn|func|package|case|default|switch|type|struct|enum|static|public|private|#include)\b.*[\w)\]}:;,\"'`]$"
    r"|^\s*[\w.\[\]\"']+\s*(?::=|[-+*/^|&]?=)\s*\S|^\s*(?://|/\*)|^\s*[\w.]+\(.*\)$"
)
DANGLING = frozenset(
    "a an the of to in on at by for with from into and or but nor than that which who whose as if when while because so is are was were be been has have had "
    "der die das den dem ein eine einen und oder mit von zu im für auf ist sind wird nicht "
    "le la les un une des du de et ou dans que qui est sont en au aux pour par sur "
    "el los las una y o del al con por para se es son no".split()
)
PROSE, CODE = 0, 1
OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
CODE_TOKEN = re.compile(r'"""|\'\'\'|//|/\*|#|"|\'|`|[()\[\]{}]|\\.', re.S)
TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>|<[A-Za-z!/][^<>\n]*$")
INLINE = re.compile(r"\n[ \t]*\n|`|[()\[\]]|" + TAG.pattern)
CLOSED = re.compile(r"</([A-Za-z][\w-]*)")
#: Distinct words that a task holds before it hands them on.
TASK_WORDS = 500_000
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


def looks_code(lines: list[str]) -> bool:
    """Whether a text without fences is program text."""
    full = [x for x in lines if x.strip() and not re.match(r"\s*(?:#|\*)", x)]
    code = [x for x in full if CODE_LINE.search(x.rstrip()) and not LIST.match(x)]
    return len(code) > 1 and len(code) >= 0.6 * len(full)


def code_rest(text: str) -> str:
    """What is open at the end of program text: '', 'string', 'comment' or 'bracket'."""
    hashes = bool(re.search(r"^\s*(?:def |class |import |from )", text, re.M)) and ";\n" not in text
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        m = CODE_TOKEN.search(text, i)
        if not m:
            break
        t, i = m.group(), m.end()
        if t == "//" and not hashes or t == "#" and hashes:
            i = text.find("\n", i)
            if i < 0:
                break
        elif t == "/*":
            i = text.find("*/", i)
            if i < 0:
                return "comment"
            i += 2
        elif t in ('"""', "'''"):
            i = text.find(t, i)
            if i < 0:
                return "string"
            i += 3
        elif t in "\"'`":
            stop = re.compile(r"\\.|" + t + ("" if t == "`" else r"|\n"), re.S)
            while True:
                e = stop.search(text, i)
                if not e:
                    # an apostrophe that opens a lifetime, label or plain word is no string
                    if t == "'":
                        break
                    return "string"
                i = e.end()
                if e.group() == t or e.group() == "\n":
                    break
        elif t in OPENERS:
            stack.append(OPENERS[t])
        elif t in CLOSERS:
            while stack and stack[-1] != t:
                stack.pop()
            if stack:
                stack.pop()
    return "bracket" if stack else ""


def prose_rest(text: str) -> str:
    """What is open at the end of prose: '', 'code', 'tag' or 'bracket'."""
    closed = {x.lower() for x in CLOSED.findall(text)}  # a tag that nothing closes is a sign of another kind, as in List<String>
    tags: list[str] = []
    inline: list[str] = []
    code = False
    for m in INLINE.finditer(text):
        t = m.group()
        if t[0] == "\n":
            inline.clear()
            code = False
        elif t == "`":
            code = not code
        elif t in OPENERS or t in CLOSERS:
            if code:
                continue
            if t in OPENERS:
                inline.append(OPENERS[t])
            elif t in inline:
                del inline[len(inline) - 1 - inline[::-1].index(t) :]
        elif m.group(2) is None:
            return "code" if code else "tag"
        else:
            name = m.group(2).lower()
            if name in VOID or m.group(3):
                continue
            if not m.group(1):
                if name in closed:
                    tags.append(name)
            elif name in tags:
                del tags[len(tags) - 1 - tags[::-1].index(name) :]
    return "code" if code else "tag" if tags else "bracket" if inline else ""


def ending(text: str | None) -> tuple[str, str, str]:
    """(form of the end, closing line, last word).

    Forms: whole, mark, broken, open, list, short, title, closing, code, loose. 'mark', 'broken', 'open'
    and 'loose' are cuts; 'list', 'short' (an entry of fewer words than its fellows), 'title', 'code' and
    'closing' depend on the baselines.
    """
    body = (text or "").rstrip()
    if not body:
        return "whole", "", ""
    tail = body[body.rfind("\n") + 1 :]
    word = re.search(r"[^\W_]+$", tail)
    word = word.group().lower() if word else ""
    paragraph = body[body.rfind("\n\n") + 2 :] if "\n\n" in body else body
    closing = tail if len(tail) <= SIGNATURE_CHARS and tail == paragraph.strip() and tail != body else ""
    fences = len(re.findall(r"^\s*```", body, re.M))
    if BROKEN.search(body) and not body.endswith("%") and not (body.endswith("\\") and fences):
        return "broken", closing, word
    mark = MARK.search(body)
    if mark:
        # words that trail off on a line of their own may be a habit; explicit marks and bare ellipses are none
        return ("closing" if closing and TRAILS.search(closing) else "mark"), closing, word
    if fences % 2:
        return "open", "", word
    if tail.strip().startswith("```"):
        tail = re.sub(r"^\s*```\s*", "", tail)
        if not fences or not re.search(r"\s", tail):
            return "whole", "", ""
    lines = body.split("\n")
    if not fences and looks_code(lines):
        rest = code_rest(body)
        if rest or CODE_LINE.search(tail):
            return ("open" if rest else "code"), "", word
    outside = re.sub(r"^\s*```.*?^\s*```[^\n]*", "", body, flags=re.S | re.M) if fences else body
    stamped = STAMPED.match(tail)
    if stamped and len(lines) > 1:
        same = [x for x in lines[:-1] if STAMPED.match(x)]
        digits = sum(x.rstrip()[-1:].isdigit() for x in same)
        return ("loose" if same and digits > 0.8 * len(same) and not tail[-1].isdigit() else "list"), "", word
    if LIST.match(tail) or FIELD.match(tail):
        if prose_rest(tail):
            return "open", "", word
        if word in DANGLING or tail.endswith((",", "-", "/")):
            return "loose", "", word
        if ENDS.search(tail):
            return "whole", "", word
        if re.search(r"[.!?]\s", re.sub(r"^\s*\d+[.)]", "", tail)):
            return "loose", "", word  # an entry of sentences stops inside one
        kind = LIST if LIST.match(tail) else FIELD
        others = [len(x.split()) for x in lines[:-1] if kind.match(x)]
        return ("short" if len(others) > 1 and len(tail.split()) < min(others) else "list"), "", word
    if HEADING.match(tail):
        return "whole", closing, word
    rest = prose_rest(outside)
    if rest in ("code", "tag"):
        return "open", closing, word
    if ENDS.search(tail):
        return "whole", closing, word
    if rest:
        return "open", closing, word
    if closing:
        return "closing", closing, word
    if len(lines) == 1 and len(tail) <= TITLE_CHARS and not SENTENCE.search(tail) and not SPEAKER.match(tail) and tail[:1].isupper() and word not in DANGLING and " " in tail:
        return "title", "", word
    return "loose", "", word


def title_like(line: str) -> bool:
    return len(line) <= TITLE_CHARS and not SENTENCE.search(line) and line[:1].isupper() and " " in line


WORDS = re.compile(r"[^\W_]+")
LAST_WORD = re.compile(r"[^\W_]+\s*$")
ENDS_DDL = "doc_id long, source string, text_id long, size int, form string, closing string, word string, head string"


def read_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row how its text ends; and rows without doc_id and form with the words of the task's texts, but for the last of each."""

    def rows(ids, sources, texts, sizes, ends) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(texts, pa.int64()), pa.array(sizes, pa.int32()),
            *[pa.array([e[i] for e in ends], pa.string()) for i in range(4)],
        ], names=["doc_id", "source", "text_id", "size", "form", "closing", "word", "head"])

    def words(found: set[str]) -> pa.RecordBatch:
        nothing = [None] * len(found)
        out = rows(nothing, nothing, nothing, nothing, [(None, None, w, None) for w in found])
        found.clear()
        return out

    found: set[str] = set()
    for b in batches:
        ends = []
        for t in b.column("body").to_pylist():
            t = t or ""
            form, closing, word = ending(t)
            first = t.lstrip().split("\n", 1)[0].strip()
            ends.append((form, closing, word, first if title_like(first) else ""))
            last = LAST_WORD.search(t[-400:]) and LAST_WORD.search(t)
            found.update(WORDS.findall((t[: last.start()] if last else t).lower()))
        yield rows(b.column("doc_id"), b.column("source"), b.column("text_id"), b.column("size"), ends)
        if len(found) > TASK_WORDS:
            yield words(found)
    yield words(found)


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, source, form, truncated: for every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lower(F.regexp_replace(F.trim("source"), r"[\s-]+", "_")), F.lit("")).alias("source"), F.col("text").alias("body"))
    rows = rows.withColumn("text_id", F.xxhash64("body")).withColumn("size", F.length("body"))
    read = cut(rows.mapInArrow(read_ends, ENDS_DDL))
    ends, words = read.where("form is not null"), read.where("form is null").select("word")
    texts = ends.dropDuplicates(["source", "text_id"])

    totals = texts.groupBy("source").agg(F.count("*").alias("source_texts"))
    signs = texts.where("closing != ''").groupBy("closing", "source").agg(F.countDistinct("text_id").alias("n")).join(totals, "source")
    signs = signs.groupBy("closing").agg(F.sum("n").alias("sign_texts"), (F.sum("n") / F.sum("source_texts")).alias("sign_rate"))
    signs = cut(signs.where((F.col("sign_texts") >= SIGNATURE_TEXTS) & (F.col("sign_rate") >= SIGNATURE_SHARE)).select("closing", "sign_texts"))
    # what begins longer lines or sentences elsewhere was cut from one
    # (recurring lines are few: each holds a share of its sources' texts)
    lines = documents.select(F.explode(F.split("text", r"\n|(?<=[.!?])\s+")).alias("line")).select(F.trim("line").alias("line"))
    begun = lines.join(signs, (F.substring("line", 1, 4) == F.substring("closing", 1, 4)) & F.col("line").startswith(F.col("closing")) & (F.length("line") > F.length("closing")))
    signs = signs.join(begun.select("closing").distinct(), "closing", "left_anti")
    titles = texts.where("head != '' and form != 'closing'").groupBy(F.col("head").alias("closing")).agg(F.count("*").alias("title_texts"))

    habits = texts.groupBy("source").agg(F.avg((F.col("form") == "title").cast("int")).alias("title_rate"))

    # lengths at which texts pile up
    sizes = texts.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    around = Window.partitionBy("source").orderBy("size").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    mean = (F.sum("n").over(around) - F.col("n")) / F.lit(2.0 * LIMIT_AROUND)
    limits = sizes.withColumn("mean", mean).where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.greatest("mean", F.lit(0.5)))).select("source", "size", F.lit(True).alias("at_limit"))

    # last words that occur at some other place
    open_forms = ("list", "short", "title", "closing", "code")
    asked = texts.where(F.col("form").isin(*open_forms) & (F.col("word") != "")).select("word").distinct()
    known = words.join(asked, "word", "left_semi").distinct().withColumn("word_texts", F.lit(1))

    asking = ends.where(F.col("form").isin(*open_forms))
    by_closing = signs.join(titles, "closing", "full")
    closed = asking.where("closing != ''").join(by_closing, "closing", "left").unionByName(asking.where("closing = ''"), allowMissingColumns=True)
    worded = closed.where("word != ''").join(known, "word", "left").unionByName(closed.where("word = ''"), allowMissingColumns=True)
    out = worded.unionByName(ends.where(~F.col("form").isin(*open_forms)), allowMissingColumns=True)
    out = out.join(F.broadcast(habits), "source", "left").join(limits, ["source", "size"], "left")  # habits: one row per source
    unknown = (F.col("word") != "") & F.col("word_texts").isNull()
    # a recurring line, or up to three words that open in lower case, a dash or a bracket: no sentence begins so
    signed = (F.coalesce("sign_texts", F.lit(0)) >= SIGNATURE_TEXTS) | F.col("closing").rlike(r"^(\p{Ll}+[.!]?( \p{L}+){0,2}|[-–—]{1,2} ?\p{L}{1,12}|\([^()]*\))$") & ~unknown
    signed = signed & ~F.col("word").isin(*sorted(DANGLING))
    bare = F.col("closing").rlike(r"^\p{Lu}\p{Ll}+( \p{L}+){2,} \p{L}{3,}$") & ~unknown & ~F.col("word").isin(*sorted(DANGLING))
    late_title = (F.col("head") == "") & (F.col("title_texts").isNotNull() | bare & (F.col("title_rate") >= TITLE_SHARE))
    cut_off = (
        F.when(F.col("form").isin("mark", "broken", "open", "loose"), True)
        .when(F.col("form") == "closing", ~signed & ~late_title)
        .when(F.col("form") == "title", unknown)
        .when(F.col("form").isin("list", "code"), unknown & ~F.col("word").rlike("[0-9]"))
        .when(F.col("form") == "short", unknown & ~F.col("word").rlike("[0-9]") | F.coalesce("at_limit", F.lit(False)))
        .otherwise(False)
    )
    return out.select("doc_id", F.nullif("source", F.lit("")).alias("source"), "form", F.coalesce("at_limit", F.lit(False)).alias("at_limit"), cut_off.alias("truncated"))


def rates(judged: DataFrame) -> DataFrame:
    """Per source: documents, truncated ones, rate, and how many of these end at a field limit."""
    t = F.col("truncated").cast("int")
    return judged.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(t).alias("truncated"), F.avg(t).alias("rate"),
        F.sum((F.col("truncated") & F.col("at_limit")).cast("int")).alias("at_limit"),
    )
