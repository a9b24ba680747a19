"""Several values packed in one field (problem 5).

Quoted spans are replaced by indexed placeholders, the text is split at the remaining separators, and the spans
come back by their index; every step is a built-in expression, so the work stays in one JVM stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.columns import let

#: Private-use characters that bracket a placeholder; where they occur in the text itself they are escaped first.
OPEN, CLOSE, ESC = "\ue000", "\ue001", "\ue002"
#: A double-quoted span; a doubled quote inside stands for one.
#: Possessive, so that spans of any length are matched without recursion.
QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
#: What separates values: bars, double slashes, tabs, line ends, list numbers, and semicolons that don't lead to a volume.
SEPARATOR = r"[|\t\r\n\x0b\x0c\u0085\u2028\u2029]+|//+|;(?!\s*\d+\s*[(:;])(?!\d)|(?<![^\s;|/])(?:\[\d+\]|\(?\d+\))(?=\s)"
#: A citation: a name, a full stop, a year.
CITATION = r"^\S.*\.\s*(?:1[5-9]|20)\d{2}(?!\d)"


def protect(text: Column) -> Column:
    """`text` with the placeholder characters escaped, so that placeholders cannot collide with it."""
    s = F.replace(text, F.lit(ESC), F.lit(ESC + "2"))
    return F.replace(F.replace(s, F.lit(OPEN), F.lit(ESC + "0")), F.lit(CLOSE), F.lit(ESC + "1"))


def unprotect(text: Column) -> Column:
    s = F.replace(F.replace(text, F.lit(ESC + "0"), F.lit(OPEN)), F.lit(ESC + "1"), F.lit(CLOSE))
    return F.replace(s, F.lit(ESC + "2"), F.lit(ESC))


def packed_values(text: Column, separator: str = SEPARATOR) -> Column:
    """ARRAY<STRING> of the values of one field, in order, without empty ones.

    A value loses surrounding space and separators and, if it is one quoted span, its quotes; a doubled quote inside becomes one.
    Spans inside a longer value keep their quotes. An unclosed quote is an ordinary character. Null gives null; blank text gives an empty array.
    """
    whole = f"^{OPEN}(\\d+){CLOSE}$"

    def mark(gaps: Column) -> Column:
        return F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(gaps) - 1, F.concat(g, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(g)), "")

    def restore(p: Column, spans: Column) -> Column:
        def by(only: Column) -> Column:
            span = F.get(spans, F.when(only != "", only).cast("int"))
            bare = F.trim(F.replace(F.substring(span, F.lit(2), F.length(span) - 2), F.lit('""'), F.lit('"')))
            cut = F.split(p, f"[{OPEN}{CLOSE}]", -1)  # odd places hold the numbers of spans
            inner = F.array_join(F.transform(cut, lambda x, i: F.when(i % 2 == 1, F.get(spans, x.cast("int"))).otherwise(x)), "")
            return unprotect(F.when(only != "", bare).otherwise(F.when(p.contains(OPEN), inner).otherwise(p)))

        return let(F.regexp_extract(p, whole, 1), by)

    def split(safe: Column) -> Column:
        pieces = F.transform(F.split(let(F.split(safe, QUOTED, -1), mark), separator, -1), lambda p: F.regexp_replace(p, r"^[\s\u00a0;|]+|[\s\u00a0;|]+$", ""))
        spans = F.regexp_extract_all(safe, F.lit(f"({QUOTED})"), 1)
        return let(spans, lambda found: F.transform(pieces, lambda p: restore(p, found)))

    return F.filter(let(protect(text), split), lambda v: F.length(F.trim(v)) > 0)


def split_packed(df: DataFrame, key: str, text: str, pattern: str | None = None, at_least: int = 1, separator: str = SEPARATOR) -> DataFrame:
    """(key, pos, val): one row per value of `text`; pos counts from 1.

    pattern: only values that match count, and only they take a place. at_least: fields with fewer values give no rows.
    Repeated keys are one delivery each and must be reduced before; null and blank fields give no rows.
    """
    values = packed_values(F.col(text), separator)
    if pattern is not None:
        values = F.filter(values, lambda v: v.rlike(pattern))
    if at_least > 1:  # a field without a separator holds one value at most
        df = df.filter(F.col(text).rlike(separator))
    return (
        df.select(F.col(key).alias("key"), values.alias("vals"))
        .filter(F.size("vals") >= at_least)
        .select(F.col("key").alias(key), F.posexplode("vals").alias("pos", "val"))
        .withColumn("pos", (F.col("pos") + 1).cast("int"))
    )
