"""Text expressions: normalisation, cleaning, escaping, tags and snippets. All are Column to Column, JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's classes miss some of it. One class for every strip and collapse.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Order of labels that open or close at one place.
LABEL_PRIORITY = {"NORMALIZABLES": 0, "Negated": 1, "Speculated": 2, "Spec_cue": 3, "Neg_cue": 4}
OTHER_PRIORITY = 100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once; a lambda would evaluate a captured expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_text(text: Column) -> Column:
    """Control marks to blanks, one kind of line end, single blanks, at most one empty line, stripped; null to empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\x00﻿", "  ")
    plain = F.regexp_replace(plain, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), "\n{3,}", "\n\n"))


def collapse(text: Column) -> Column:
    """White space runs to one blank, stripped."""
    return strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def comparable_span(text: Column, case_sensitive: bool = False, normalize: bool = True) -> Column:
    """Span text as compared between annotation sets."""
    if not normalize:
        return text
    flat = collapse(text)
    return flat if case_sensitive else F.lower(flat)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    """Entities decoded in one pass: the ampersand last."""
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def sanitize_tag(label: Column) -> Column:
    """A label as a tag name."""
    name = F.regexp_replace(F.regexp_replace(label, rf"[{SPACE}]+", "_"), "[^A-Za-z0-9_:-]", "_")
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_+|_+$", "")
    named = F.when(F.length(name) == 0, F.lit("ENTIDAD")).otherwise(name)
    return F.when(named.rlike("^[0-9]"), F.concat(F.lit("X_"), named)).otherwise(named)


def label_priority(label: Column) -> Column:
    ranked = F.lit(OTHER_PRIORITY)
    for name, rank in LABEL_PRIORITY.items():
        ranked = F.when(label == name, F.lit(rank)).otherwise(ranked)
    return ranked


def snippet(text: Column, start: Column, end: Column, window: int = 35) -> Column:
    """A match's surroundings on one line; 0-based start, end exclusive."""
    first = F.greatest(start - window, F.lit(0))
    return collapse(F.substring(text, first + 1, F.least(F.length(text), end + window) - first))


#: Items that running_totals adds up at a time.
_RUN = 128


def _running(items: Column, base: Column) -> Column:
    """base + sums of the first 1, 2, ... items; the result grows item by item, so items are to be few."""
    start = F.struct(base.cast("int").alias("total"), F.array().cast("array<int>").alias("out"))
    grown = F.aggregate(items, start, lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["out"], F.array(a["total"] + x)).alias("out")))
    return grown["out"]


def running_totals(items: Column) -> Column:
    """array<int>: sums of the first 1, 2, ... items. Runs of items are added up by themselves, so long arrays stay near linear."""

    def by_runs(z: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / F.lit(_RUN)).cast("int")), lambda k: F.slice(z, k * _RUN + 1, _RUN))
        return let(runs, lambda parts: let(sums_of(parts), lambda sums: F.flatten(F.transform(parts, lambda part, k: _running(part, F.coalesce(F.get(sums, k - 1), F.lit(0)))))))

    def sums_of(parts: Column) -> Column:
        return _running(F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)), F.lit(0))

    return let(items, lambda z: F.when(F.size(z) > 0, by_runs(z)).otherwise(z))


def find_all(text: Column, pattern: str, groups: tuple[tuple[str, int], ...] = ()) -> Column:
    """All matches as array<struct<start, end, text, one string for each group>>, in order; groups that took no part are empty.

    The pattern is run once: a replacement puts marks around matches and between their groups, and the marked text is cut
    at the marks. Matches and the gaps between them spell the text, so a match starts where the gaps and matches before it
    end. A match must be neither empty nor of U+0001 to U+0003 (the marks themselves are looked at as U+0003).
    """
    shown = "\x01$0" + "".join(f"\x02${k}" for _, k in groups) + "\x01"
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), pattern, shown)

    def at(parts: Column) -> Column:
        odd = lambda k: lambda _, i: i % 2 == k
        cells = F.transform(F.filter(parts, odd(1)), lambda x: F.split(x, "\x02", -1))
        return let(F.struct(cells.alias("m"), F.filter(parts, odd(0)).alias("gaps")), found)

    def found(p: Column) -> Column:
        # from match to match: what was matched before, and the gap
        steps = F.transform(p["m"], lambda _, i: F.length(F.get(p["gaps"], i)) + F.coalesce(F.length(F.get(F.get(p["m"], i - 1), F.lit(0))), F.lit(0)))

        def one(start: Column, i: Column) -> Column:
            cell = lambda k: F.get(F.get(p["m"], i), F.lit(k))
            return F.struct(start.alias("start"), (start + F.length(cell(0))).alias("end"), cell(0).alias("text"), *[cell(k).alias(name) for k, (name, _) in enumerate(groups, 1)])

        return F.transform(running_totals(steps), one)

    return let(F.split(marked, "\x01", -1), at)
