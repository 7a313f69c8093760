"""Text columns: words, paragraphs, chunks, peeks, key and summary clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_LINE = r"\s*\n\s*\n\s*"
_SPACE = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(_SPACE))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for blank text."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("int")


def paragraphs(text: Column, sep: str = BLANK_LINE) -> Column:
    """The non-empty paragraphs of a text, trimmed."""
    return F.filter(F.transform(F.split(text, sep), strip), lambda p: p != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` uses it. The
    optimizer would put a plain column back into every place, also inside of lambdas, where it
    would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def _chunk_ends(counts: Column, min_words: int) -> Column:
    """End positions of greedy chunks over word counts: a chunk closes as soon as it has
    more than ``min_words`` words; what is left at the end closes as a last, short one."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends")
    )

    def step(state: Column, count: Column) -> Column:
        at = state["at"] + 1
        n = state["n"] + count
        full = n > min_words
        return F.struct(
            at.alias("at"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
            F.when(full, F.concat(state["ends"], F.array(at))).otherwise(state["ends"]).alias("ends"),
        )

    def finish(state: Column) -> Column:
        left_over = F.coalesce(F.try_element_at(state["ends"], F.lit(-1)), F.lit(0)) < state["at"]
        return F.when(left_over, F.concat(state["ends"], F.array(state["at"]))).otherwise(state["ends"])

    return F.aggregate(counts, start, step, finish)


def chunk_array(
    text: Column,
    min_words: int | None = 200,
    sep: str = BLANK_LINE,
    joiner: str = "\n\n",
    count_words: Callable[[Column], Column] = word_count,
) -> Column:
    """The chunks of a text as an array of ``(text, n_words)``. ``min_words=None`` makes every
    paragraph its own chunk."""
    limit = -1 if min_words is None else min_words

    def cut(parts: Column, counts: Column, ends: Column) -> Column:
        def chunk(end: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(ends, i - 1), F.lit(0))
            words = F.aggregate(F.slice(counts, begin + 1, end - begin), F.lit(0), lambda a, c: a + c)
            joined = F.array_join(F.slice(parts, begin + 1, end - begin), joiner)
            return F.struct(joined.alias("text"), words.alias("n_words"))

        return F.transform(ends, chunk)

    return let(
        paragraphs(text, sep),
        lambda parts: let(
            F.transform(parts, count_words),
            lambda counts: let(_chunk_ends(counts, limit), lambda ends: cut(parts, counts, ends)),
        ),
    )


def peek_lines(lines: Column, n: int = 10, width: int = 100) -> Column:
    """The first ``n`` lines of an array, each cut by ``cut_line``."""
    return F.transform(F.slice(lines, 1, n), lambda line: cut_line(line, width))


# What a cut line ends with, and what a stored summary has around its text.
CUT_NOTE = ("... [", " characters truncated]")
SUMMARY_NOISE, SUMMARY_END = ("more...", "(Submitter supplied) "), "Organism"


def cut_line(line: Column, width: int = 100) -> Column:
    """Cut a long line and say how many characters were left out."""
    left_out = (F.length(line) - width).cast("string")
    note = F.concat(F.lit(CUT_NOTE[0]), left_out, F.lit(CUT_NOTE[1]))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), note)).otherwise(line)


def text_lines(text: Column) -> Column:
    """Lines of a text as a file reader counts them: a final newline opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    )


def format_key(key: Column) -> Column:
    return F.replace(F.lower(key), F.lit(" "), F.lit("_"))


def clean_summary(text: Column) -> Column:
    """Drop the "more..." link text and the "(Submitter supplied) " mark, stop at "Organism"."""
    for noise in SUMMARY_NOISE:
        text = F.replace(text, F.lit(noise), F.lit(""))
    return strip(F.substring_index(text, SUMMARY_END, 1))


def ordered_concat(value: Column, order: Column, sep: str) -> Column:
    """Aggregate: the values of a group joined with ``sep`` by ``order``; null if there are none."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), sep))


WordCounter = Callable[[Column], Column]
