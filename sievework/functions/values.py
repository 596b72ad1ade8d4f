"""Small functions over words, sizes, positions, vectors and stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import text as t


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row: inside functions over arrays a column would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shares_stem(a: Column, b: Column) -> Column:
    """Whether words agree in their first four characters, or in five where both are longer than five."""
    least = F.least(F.length(a), F.length(b))
    return F.when(least < 4, False).when(least <= 5, F.substring(a, 1, 4) == F.substring(b, 1, 4)).otherwise(F.substring(a, 1, 5) == F.substring(b, 1, 5))


def identifier_stems(name: Column) -> Column:
    """Parts of a name in lower case without final s and without words of prose."""
    parts = F.flatten(F.transform(F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda p: p != ""), t.identifier_parts))
    return F.filter(F.transform(parts, t.normalize_token), lambda p: ~p.isin(*t.PROSE_WORDS))


def keywords(query: Column) -> Column:
    """Words of a query that carry its meaning, normalised, once each."""
    words = F.filter(t.analyze(query), lambda w: (F.length(w) >= 3) & ~w.isin(*t.PROSE_WORDS, *t.QUESTION_STARTS))
    return F.array_distinct(F.transform(words, t.normalize_token))


def bytes_text(n: Column) -> Column:
    """A size with one decimal in the largest unit that it fills."""
    unit = lambda size, name: F.format_string(f"%.1f {name}", F.bround(n / F.lit(float(size)), 1))
    return F.when(n >= 1 << 30, unit(1 << 30, "GB")).when(n >= 1 << 20, unit(1 << 20, "MB")).when(n >= 1 << 10, unit(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def line_of_byte(content: Column, at: Column) -> Column:
    """The line, from 1, in which a byte of a text lies; bytes behind the end lie in the last."""
    head = F.substring(F.encode(content, "UTF-8"), F.lit(1), at.cast("int"))
    return F.regexp_count(F.decode(head, "ISO-8859-1"), F.lit("\n")) + 1


def byte_of_line(content: Column, line: Column) -> Column:
    """The byte at which a line, counted from 1, begins."""
    before = F.slice(F.split(content, "\n"), F.lit(1), line - 1)
    return F.octet_length(F.array_join(before, "\n")) + F.when(line > 1, 1).otherwise(0)


def shortened(vector: Column, dim: int) -> Column:
    """The first coordinates of a vector of nested resolution, at unit length again."""
    kept = F.transform(F.slice(vector, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(kept, lambda x: x / norm)).otherwise(kept)


def pooled(vectors: Column) -> Column:
    """The mean of token vectors at unit length; null for none."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n, F.lit(1))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(total, lambda x: x / F.greatest(norm, F.lit(1e-12))))


def trusted_stamp(modified: Column, length: Column, now: Column, path: Column) -> Column:
    """A stamp of a file that spares reading it: only of one that was last written more than three seconds ago, and never of restructured text, which includes others."""
    settled = now.cast("double") - modified.cast("double") > 3
    return F.when(settled & ~F.lower(path).endswith(".rst"), F.concat_ws("-", F.unix_micros(modified), length))
