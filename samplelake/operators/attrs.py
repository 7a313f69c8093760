"""Attribute tables: ``attr(file, kind, accession, key, key_ord, pos, value)``, one row per
value of an entity's attribute. ``key_ord`` orders an entity's attributes, ``pos`` the values
of one attribute from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.functions.text import WordCounter, ordered_concat, word_count
from samplelake.operators.joins import join_dim
from samplelake.operators.ordered import BLOCK_ROWS, running
from samplelake.fields import Field

# The series attributes that a sample's context ends with.
SERIES_CONTEXT = ("title", "overall_design", "supplementary_file")
PREFIX = {"Sample_": "SAMPLE", "Series_": "SERIES"}


def pair_series(attr: DataFrame, entity: DataFrame) -> DataFrame:
    """``file, sample, series, series_file``: the series whose record the sample follows in its
    file, else the file's first; without any, the first ``series_id`` it names, if that
    series is in another file. No series gives nulls.
    """
    rows = entity.filter(F.col("kind").isin("SAMPLE", "SERIES"))
    blocked = rows.withColumn("__block", F.floor(F.col("ord") / BLOCK_ROWS))
    is_series = F.when(F.col("kind") == "SERIES", F.col("accession"))
    placed = running(blocked, ["file"], ["__block"], ["ord"], lasts={"__before": is_series})
    series = rows.filter(F.col("kind") == "SERIES")
    leading = series.groupBy("file").agg(F.min_by("accession", "ord").alias("__leading"))
    named = attr.filter((F.col("kind") == "SAMPLE") & (F.col("key") == "series_id") & (F.col("pos") == 0))
    elsewhere = series.groupBy(F.col("accession").alias("__named")).agg(F.min("file").alias("__named_file"))

    samples = placed.filter(F.col("kind") == "SAMPLE").select("file", F.col("accession").alias("sample"), "__before")
    found = (
        join_dim(samples, leading, "file")
        .join(
            named.select("file", F.col("accession").alias("sample"), F.col("value").alias("__named")),
            ["file", "sample"],
            "left",
        )
        .withColumn("__here", F.coalesce("__before", "__leading"))
    )
    looked_up = found.withColumn("__named", F.when(F.col("__here").isNull(), F.col("__named")))
    inside = F.col("__here").isNotNull()
    return join_dim(looked_up, elsewhere, "__named").select(
        "file",
        "sample",
        F.when(inside, F.col("__here")).when(F.col("__named_file").isNotNull(), F.col("__named")).alias("series"),
        F.when(inside, F.col("file")).otherwise(F.col("__named_file")).alias("series_file"),
    )


def pick_values(attr: DataFrame, kind: str, wanted: dict[str, str]) -> DataFrame:
    """``file, accession`` and one column per ``wanted`` entry (column -> attribute): the
    values of the attribute by ``pos``, joined with ``;``; null where it is absent."""
    keys = sorted(set(wanted.values()))
    rows = attr.filter((F.col("kind") == kind) & F.col("key").isin(keys))
    return rows.groupBy("file", "accession").agg(
        *[ordered_concat(F.when(F.col("key") == key, F.col("value")), F.col("pos"), ";").alias(name) for name, key in wanted.items()]
    )


def copy_fields(attr: DataFrame, pair: DataFrame, spec: Sequence[Field]) -> DataFrame:
    """``file, sample`` and one column per copy field of ``spec``."""
    copied = [f for f in spec if f.copied]
    by_kind = {kind: {f.name: f.source()[1] for f in copied if f.source()[0] == kind} for kind in ("SAMPLE", "SERIES")}
    out = pair
    if by_kind["SAMPLE"]:
        own = pick_values(attr, "SAMPLE", by_kind["SAMPLE"]).withColumnRenamed("accession", "sample")
        out = out.join(own, ["file", "sample"], "left")
    if by_kind["SERIES"]:
        shared = pick_values(attr, "SERIES", by_kind["SERIES"])
        shared = shared.withColumnRenamed("accession", "series").withColumnRenamed("file", "series_file")
        out = join_dim(out, shared, ["series_file", "series"])
    return out.select("file", "sample", *[F.col(f"`{f.name}`") for f in copied])


def attribute_line(kind: Column, key: Column, value: Column) -> Column:
    return F.concat(F.lit("!"), F.initcap(kind), F.lit("_"), key, F.lit(" = "), value)


def _sample_lines(attr: DataFrame, max_tokens: int, token_count: WordCounter) -> DataFrame:
    rows = attr.filter((F.col("kind") == "SAMPLE") & (F.col("value") != ""))
    lines = rows.withColumn("line", attribute_line(F.col("kind"), F.col("key"), F.col("value")))
    return lines.withColumn("fits", token_count(F.col("line")) < max_tokens)


def sample_text(attr: DataFrame, max_tokens: int = 1000, token_count: WordCounter = word_count) -> DataFrame:
    """``file, sample, raw_metadata``: a sample's attributes as lines, without empty values and
    without lines of ``max_tokens`` tokens or more."""
    lines = _sample_lines(attr, max_tokens, token_count).filter("fits")
    text = ordered_concat(F.col("line"), F.struct("key_ord", "pos"), "\n")
    return lines.groupBy("file", F.col("accession").alias("sample")).agg(text.alias("raw_metadata"))


def long_lines(attr: DataFrame, max_tokens: int = 1000, token_count: WordCounter = word_count) -> DataFrame:
    """``stage, file, accession, message`` for the lines that ``sample_text`` leaves out."""
    return _sample_lines(attr, max_tokens, token_count).filter(~F.col("fits")).select(
        F.lit("context").alias("stage"),
        "file",
        "accession",
        F.concat(F.lit("attribute too long, left out: "), F.col("key")).alias("message"),
    )


def context_lines(
    attr: DataFrame,
    pair: DataFrame,
    max_tokens: int = 1000,
    token_count: WordCounter = word_count,
    *,
    own: DataFrame | None = None,
) -> DataFrame:
    """``file, sample, context``: a sample's lines and then those of its series' title, design
    and supplementary files. ``own`` is the result of ``sample_text``, if it is at hand."""
    if own is None:
        own = sample_text(attr, max_tokens, token_count)
    shared = pick_values(attr, "SERIES", {f"__{k}": k for k in SERIES_CONTEXT})
    tail = F.concat_ws(
        "\n", *[F.concat(F.lit(f"!Series_{k} = "), F.col(f"__{k}")) for k in SERIES_CONTEXT]
    )
    series = shared.select(F.col("file").alias("series_file"), F.col("accession").alias("series"), tail.alias("__tail"))
    paired = pair.join(own, ["file", "sample"], "left")
    whole = F.concat_ws("\n", F.col("raw_metadata"), F.when(F.col("__tail") != "", F.col("__tail")))
    return join_dim(paired, series, ["series_file", "series"]).select("file", "sample", whole.alias("context"))


def match_refs(df: DataFrame, column: Column, refs: Sequence[str]) -> DataFrame:
    """One row per row and ref whose name occurs in ``column``: adds ``ref_no, ref``.

    The refs come from a field specification, so they are literals of the plan and the
    substring test is a projection, not a join.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("ref_no"), F.lit(r).alias("ref")) for i, r in enumerate(refs)])
    hits = F.filter(listed, lambda r: F.contains(column, r["ref"]))
    return df.withColumn("__r", F.explode(hits)).select("*", "__r.*").drop("__r")


def ref_context(attr: DataFrame, pair: DataFrame, refs: Sequence[str]) -> DataFrame:
    """``file, sample, context``: a line per attribute whose name contains a ref's name, in the
    order of the refs and then of the attributes. Samples without a match are left out.
    """
    names = list(dict.fromkeys(refs))
    lines = None
    for prefix, kind in PREFIX.items():
        chosen = [r for r in names if r.startswith(prefix)]
        if not chosen:
            continue
        rows = match_refs(attr.filter(F.col("kind") == kind), F.col("key"), [r.removeprefix(prefix) for r in chosen])
        values = rows.groupBy("file", "accession", "ref", "key").agg(
            F.min("key_ord").alias("key_ord"), ordered_concat(F.col("value"), F.col("pos"), ";").alias("value")
        )
        place = F.array_position(F.array(*[F.lit(n) for n in names]), F.concat(F.lit(prefix), F.col("ref")))
        line = F.concat(F.lit(prefix), F.col("ref"), F.lit(" = "), F.col("value"))
        found = values.select("file", "accession", place.alias("place"), "key_ord", line.alias("line"))
        if kind == "SAMPLE":
            own = pair.select("file", "sample").join(
                found.withColumnRenamed("accession", "sample"), ["file", "sample"]
            )
        else:
            shared = found.withColumnRenamed("accession", "series").withColumnRenamed("file", "series_file")
            own = join_dim(pair, shared, ["series_file", "series"], "inner")
        own = own.select("file", "sample", "place", "key_ord", "line")
        lines = own if lines is None else lines.unionByName(own)
    if lines is None:
        raise ValueError("refs must start with Sample_ or Series_")
    return lines.groupBy("file", "sample").agg(
        ordered_concat(F.col("line"), F.struct("place", "key_ord"), "\n").alias("context")
    )


def check_prefix(samples: DataFrame, column: str = "sample", prefix: str = "GSM") -> tuple[DataFrame, DataFrame]:
    """Samples whose accession has the right prefix, and ``stage, accession, message`` for the others."""
    good = F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False))
    errors = samples.filter(~good).select(
        F.lit("accession").alias("stage"),
        F.col(column).alias("accession"),
        F.lit(f"an accession must start with {prefix}").alias("message"),
    )
    return samples.filter(good), errors
