"""One wide metadata row per sample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.replies import field
from samplelake.functions.text import WordCounter, word_count
from samplelake.operators.attrs import (
    check_prefix,
    context_lines,
    copy_fields,
    long_lines,
    pair_series,
    ref_context,
    sample_text,
)
from samplelake.operators.infer import Responder, infer, parse_replies, reply_errors
from samplelake.operators.joins import join_dim
from samplelake.operators.link import link_concepts
from samplelake.operators.ordered import first_n
from samplelake.operators.prompts import build_prompts
from samplelake.operators.summary import Summary
from samplelake.fields import DEFAULT_FIELDS, Field, Group, split_fields
from samplelake.session import materialise
from samplelake.sources.soft import read_soft


@dataclass(frozen=True)
class Vocabulary:
    """``concepts(concept_id, canonical_name, definition)`` and ``aliases(concept_id, alias)``."""

    concepts: DataFrame
    aliases: DataFrame


@dataclass(frozen=True)
class Extraction:
    """``rows`` and ``errors(stage, file, accession, message)`` are computed when they are read;
    ``summary(item, metric, n)`` has the counts and token sums of what was written before."""

    rows: DataFrame
    errors: DataFrame
    summary: DataFrame


ERROR = ("stage", "file", "accession", "message")


def first_samples(pair: DataFrame, entity: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` samples of each series in file order; samples without one are kept."""
    order = entity.filter(F.col("kind") == "SAMPLE").select("file", F.col("accession").alias("sample"), "ord")
    placed = pair.join(order, ["file", "sample"])
    inside = first_n(placed.filter(F.col("series").isNotNull()), ["series_file", "series"], ["file", "ord"], n)
    return inside.unionByName(placed.filter(F.col("series").isNull())).drop("ord")


def _context(attr: DataFrame, pair: DataFrame, group: Group, texts: DataFrame) -> DataFrame:
    refs = group.refs()
    if not refs:
        return context_lines(attr, pair, own=texts)
    some = materialise(ref_context(attr, pair, refs), "ref-contexts")
    rest = pair.join(some.select("file", "sample"), ["file", "sample"], "left_anti")
    return some.unionByName(context_lines(attr, rest, own=texts))


def _ask(
    attr: DataFrame,
    pair: DataFrame,
    group: Group,
    responder: Responder,
    texts: DataFrame,
    store: str | None,
    tokens: WordCounter,
    model: str,
    options: dict,
    summary: Summary,
) -> tuple[DataFrame, DataFrame]:
    """``file, sample`` and the group's fields; and the errors."""
    context = summary.stored(_context(attr, pair, group, texts), "contexts")
    prompts = build_prompts(context, group, model)
    replies = infer(prompts, responder, None, store, token_count=tokens, summary=summary, **options)
    parsed = parse_replies(replies)
    values = parsed.select("prompt_key", *[field(F.col("value"), f.name).alias(f.name) for f in group.fields])
    keyed = prompts.select("prompt_key", "file", "sample")
    answered = join_dim(keyed, values, "prompt_key").drop("prompt_key")
    failed = join_dim(keyed, reply_errors(replies), "prompt_key", "inner")
    return answered, failed.select("stage", "file", F.col("sample").alias("accession"), "message")


def _linked(rows: DataFrame, fields: Sequence[Field], vocabulary: Vocabulary, k: int, threshold: float) -> DataFrame:
    mentions = rows.select(F.explode(F.array(*[F.col(f"`{f.name}`") for f in fields])).alias("mention"))
    mentions = mentions.filter(F.col("mention").isNotNull()).distinct()
    links = link_concepts(mentions, vocabulary.aliases, vocabulary.concepts, k, threshold)
    labels = materialise(links.select("mention", "label"), "links")
    for f in fields:
        side = labels.select(F.col("mention").alias(f.name), F.col("label").alias(f"{f.name}_umls"))
        rows = join_dim(rows, side, f.name, stored=True)
    return rows


def metadata_columns(spec: Sequence[Field]) -> list[str]:
    """Columns of a result: the sample, the model's fields (each followed by its concept), the
    copied fields, the raw text."""
    copied, groups = split_fields(spec)
    names = ["gsm"]
    for group in groups:
        for f in group.fields:
            names += [f.name, f"{f.name}_umls"] if f.map_to_umls else [f.name]
    return [*names, *[f.name for f in copied], "raw_metadata"]


def extract_metadata(
    attr: DataFrame,
    pair: DataFrame,
    spec: Sequence[Field] = DEFAULT_FIELDS,
    responder: Responder | None = None,
    vocabulary: Vocabulary | None = None,
    *,
    store: str | None = None,
    max_tokens: int = 1000,
    token_count: WordCounter = word_count,
    k: int = 30,
    threshold: float = 0.5,
    model: str = "",
    summary: Summary | None = None,
    **options,
) -> Extraction:
    """A row per (file, sample) of ``pair``, with the columns of ``metadata_columns``.

    Without a ``responder`` the model's fields are null; without a ``vocabulary`` a mapped
    field's concept is its own text. A sample whose reply failed keeps its row, with nulls,
    and has a row in ``errors(stage, file, accession, message)``. ``model`` is part of the
    prompt key; ``options`` go to ``infer``. ``summary`` is told of the tables as they are written.

    ``attr`` is read several times: hand over a stored table, not a plan that parses files.
    """
    copied, groups = split_fields(spec)
    summary = summary or Summary()
    texts = summary.stored(sample_text(attr, max_tokens, token_count), "texts")
    rows = copy_fields(attr, pair, copied)
    errors = long_lines(attr, max_tokens, token_count).select(*ERROR)
    lonely = pair.filter(F.col("series").isNull())
    errors = errors.unionByName(
        lonely.select(
            F.lit("pair").alias("stage"), "file", F.col("sample").alias("accession"),
            F.lit("no series found").alias("message"),
        )
    )
    for group in groups:
        names = [f.name for f in group.fields]
        if responder is None:
            rows = rows.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
        else:
            answered, failed = _ask(attr, pair, group, responder, texts, store, token_count, model, options, summary)
            rows = rows.join(answered, ["file", "sample"], "left")
            errors = errors.unionByName(failed)
    mapped = [f for g in groups for f in g.fields if f.map_to_umls]
    if vocabulary is not None and responder is not None and mapped:
        rows = _linked(materialise(rows, "answered"), mapped, vocabulary, k, threshold)
    else:
        rows = rows.select("*", *[F.col(f"`{f.name}`").alias(f"{f.name}_umls") for f in mapped])
    # The texts, which are most of the bytes, come last, so that none of the tables above holds them.
    named = rows.join(texts, ["file", "sample"], "left").withColumnRenamed("sample", "gsm")
    return Extraction(named.select(*[F.col(f"`{c}`") for c in metadata_columns(spec)]), errors, summary.table(attr.sparkSession))


def extract_from_files(
    spark: SparkSession,
    paths: DataFrame | str | Sequence[str],
    spec: Sequence[Field] = DEFAULT_FIELDS,
    responder: Responder | None = None,
    vocabulary: Vocabulary | None = None,
    *,
    per_series: int | None = 2,
    accession: str | None = None,
    **options,
) -> Extraction:
    """Metadata rows of the samples in SOFT files (paths, or a frame of them): of each series the first ``per_series`` (a
    falsy number takes all), or the one sample named by ``accession``.

    Files are parsed once, into stored tables that hold the chosen samples and all series.
    """
    soft, summary = read_soft(spark, paths), Summary()
    entity = summary.stored(soft.entity, "entities")
    whole = summary.stored(soft.attr, "attributes")
    pair = pair_series(whole, entity)
    bad = spark.createDataFrame([], "stage string, accession string, message string")
    if accession is not None:
        pair, bad = check_prefix(pair.filter(F.col("sample") == accession))
    else:
        pair = first_samples(pair, entity, per_series)
    pair = summary.stored(pair, "samples")
    chosen = pair.select("file", F.lit("SAMPLE").alias("kind"), F.col("sample").alias("accession"))
    attr = whole.filter("kind = 'SERIES'").unionByName(
        join_dim(whole.filter("kind = 'SAMPLE'"), chosen, ["file", "kind", "accession"], "left_semi").select(*whole.columns)
    )
    done = extract_metadata(materialise(attr, "chosen"), pair, spec, responder, vocabulary, summary=summary, **options)
    unread = soft.errors.select("stage", "file", F.lit(None).cast("string").alias("accession"), "message")
    rejected = bad.select("stage", F.lit(None).cast("string").alias("file"), "accession", "message")
    return Extraction(done.rows, done.errors.unionByName(unread).unionByName(rejected), done.summary)
