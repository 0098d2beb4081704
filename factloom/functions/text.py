"""Text functions: normalisation, line ranges, quote matching, OCR cleaning, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which the value is computed once: a lambda computes what it refers to anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_text(text: Column) -> Column:
    """White space collapsed and trimmed; a blank on either side of an en dash goes."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.replace(F.replace(flat, F.lit(" –"), F.lit("–")), F.lit("– "), F.lit("–"))


def parse_line_range(location: Column) -> Column:
    """struct(start_line, end_line) of "Lines A-B" or "Line A"; null for anything else."""
    bare = F.trim(F.replace(F.replace(location, F.lit("Lines")), F.lit("Line")))
    parts = F.split(bare, "-")
    start = F.trim(parts[0]).try_cast("int")
    end = F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1))).try_cast("int")).otherwise(start)
    ok = (F.size(parts) <= 2) & start.isNotNull() & end.isNotNull()
    return F.when(ok, F.struct(start.alias("start_line"), end.alias("end_line")))


def parse_line_range_loose(location: Column) -> Column:
    """struct(start_line, end_line) of the first "Line(s) A(-B)" anywhere."""
    start = F.regexp_extract(location, r"Lines? (\d+)(?:-(\d+))?", 1).try_cast("int")
    end = F.regexp_extract(location, r"Lines? (\d+)(?:-(\d+))?", 2).try_cast("int")
    return F.when(start.isNotNull(), F.struct(start.alias("start_line"), F.coalesce(end, start).alias("end_line")))


def match_ratio(quote: Column, text: Column) -> Column:
    """1 if the normalised text holds the quote, else the share of the quote's words that come in order.

    The partial test counts the longest beginning of the quote's words that is a subsequence of the
    text's words, in any case. An empty quote is in every text.
    """

    def in_order(words: Column, t: Column) -> Column:
        fold = F.aggregate(F.split(F.lower(t), " "), F.lit(0), lambda done, w: done + F.when(F.get(words, done) == w, 1).otherwise(0))
        return fold / F.size(words)

    def rated(both: Column) -> Column:
        words = F.split(F.lower(both["q"]), " ")
        return F.when(F.contains(both["t"], both["q"]), 1.0).otherwise(bound(words, lambda w: in_order(w, both["t"])))

    return bound(F.struct(normalize_text(quote).alias("q"), normalize_text(text).alias("t")), rated)


def is_match(ratio: Column, least: float = 0.7) -> Column:
    return ratio >= least


def clean_ocr_text(text: Column) -> Column:
    """Lines stripped; blank lines and dot leaders dropped; long runs of rule characters shortened."""
    stripped = F.transform(lines_of(text), lambda x: F.trim(x))
    dots = lambda x: F.length(x) - F.length(F.replace(x, F.lit(".")))
    kept = F.filter(stripped, lambda x: (x != "") & ~((dots(x) > 20) & (F.length(F.trim(F.replace(x, F.lit(".")))) < 10)))

    def shorten(line: Column) -> Column:
        for pattern, by in ((r"[.:]{10,}", " ... "), (r"[=-]{5,}", "---"), (r"[@#$%^&*](?=\s|$)", "")):
            line = F.regexp_replace(line, pattern, by)
        return line

    return F.array_join(F.transform(kept, shorten), "\n")


def question_citations(answer: Column) -> Column:
    """The numbers of [Fact N] marks, each once, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[Fact (\d+)\]"), F.lit(1)))


def context_entities(text: Column, most: int = 5) -> Column:
    """Capitalised phrases longer than two characters, distinct, the first few by name; any white space joins their words."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\b"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > 2))), 1, most)


def _searched(value: Column) -> Column:
    return F.regexp_replace(value, r"([()\[\]])", r"\\$1")


def has_context(value: Column, text: Column) -> Column:
    """Whether quantity_context finds anything, without looking around a hit."""
    return F.regexp_like(text, F.concat(F.lit("(?is)"), _searched(value)))


def quantity_context(value: Column, text: Column, reach: int = 200) -> Column:
    """The text around the last hit of a quantity within reach of the start, on one line; null if there is none.

    The start is as far before the first hit as the reach allows, so no other place of the text is tried.
    """
    before = F.call_function("regexp_extract", text, F.concat(F.lit("(?is)^(.*?)"), _searched(value)), F.lit(1))
    near = F.substring(text, F.greatest(F.lit(1), F.length(before) - reach + 1), F.length(text))
    pattern = F.concat(F.lit(f"(?is)^.{{0,{reach}}}"), _searched(value), F.lit(f".{{0,{reach}}}"))
    found = F.call_function("regexp_extract", near, pattern, F.lit(0))
    return bound(F.trim(F.regexp_replace(found, r"\s+", " ")), lambda line: F.nullif(line, F.lit("")))


def quote_snippet(quotes: Column, most: int = 60) -> Column:
    """The beginning of the first quote, and how many more there are."""
    first = F.get(quotes, F.lit(0))
    cut = F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)
    more = F.when(F.size(quotes) > 1, F.concat(F.lit(" (+"), (F.size(quotes) - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(cut, more)


def parse_llm_json(raw: Column, schema: str, required: str) -> Column:
    """JSON from the raw text, else from its first fence, marked json or not; null if none parses."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    whole, inner = F.from_json(raw, schema), F.from_json(fenced, schema)
    return F.when(whole[required].isNotNull(), whole).when(inner[required].isNotNull(), inner)
