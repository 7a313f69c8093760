"""Fuzzy link of mentions to the concepts of a vocabulary.

Score: cosine of trigram vectors, weight = count x idf over the distinct aliases, rounded to
six digits. Candidates come from prefix filtering, which is exact: with both vectors' grams
in one global order (rarest first), two vectors whose cosine reaches the threshold share a
gram of both prefixes, a prefix being what must be taken off for the rest's norm to fall
below the threshold. So frequent grams take part in scores but not in the join. At the first
gram that two vectors share, the cosine is at most the product of the norms of what is left of
each from there on; meetings below that bound are dropped. Only numbers of vectors are joined:
vectors are fetched for the distinct pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplelake.functions.text import let, strip
from samplelake.operators.joins import join_dim
from samplelake.session import materialise

DIGITS = 6
_SLACK = 1e-6
#: A gram under which more pairs than this would meet is dealt to ``SALTS`` x ``SALTS`` tasks.
CROWD, SALTS = 1 << 24, 16


def normal_form(text: Column) -> Column:
    return strip(F.lower(text))


def trigrams(text: Column) -> Column:
    """Trigrams of a text as an array; empty for texts under 3 characters."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    grams = F.transform(starts, lambda i: F.substr(text, i, F.lit(3)))
    return F.when(F.length(text) >= 3, grams).otherwise(F.array().cast("array<string>"))


def _gram_counts(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(trigrams(F.col(key))).alias("gram")).groupBy(key, "gram").agg(
        F.count("*").alias("tf")
    )


def _vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``key, vec``: unit vector as an array of (df, gram, w), rarest gram first."""
    weighed = join_dim(counts, idf, "gram", "inner", stored=True).select(
        key, F.struct("df", "gram", (F.col("tf") * F.col("idf")).alias("w")).alias("e")
    )
    gathered = weighed.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))

    def scaled(n: Column) -> Column:
        return F.transform(
            "raw", lambda e: F.struct(e["df"].alias("df"), e["gram"].alias("gram"), (e["w"] / n).alias("w"))
        )

    return gathered.select(key, let(norm, scaled).alias("vec"))


def _prefix(vec: Column, threshold: float) -> Column:
    """Grams to take off, rarest first, until the norm of the rest is below ``threshold``, each with
    the norm from there on."""
    floor = max(threshold - _SLACK, 0.0) ** 2
    none = F.array().cast("array<struct<gram:string,rest:double>>")
    start = F.struct(F.lit(1.0).alias("rest"), none.alias("grams"))

    def step(state: Column, e: Column) -> Column:
        here = F.array(F.struct(e["gram"].alias("gram"), F.sqrt(F.greatest(state["rest"], F.lit(0.0))).alias("rest")))
        return F.struct(
            (state["rest"] - e["w"] * e["w"]).alias("rest"),
            F.when(state["rest"] >= floor, F.concat(state["grams"], here)).otherwise(state["grams"]).alias("grams"),
        )

    return F.aggregate(vec, start, step, lambda s: s["grams"])


def _postings(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """``key, gram, rest``: the grams of each vector's prefix. An outer explode, since for a plain one
    the optimizer adds a filter that computes the prefix again."""
    return vectors.select(key, F.explode_outer(_prefix(F.col("vec"), threshold)).alias("p")).select(key, "p.gram", "p.rest")


def candidate_pairs(mentions: DataFrame, aliases: DataFrame, threshold: float, crowd: int = CROWD) -> DataFrame:
    """``mention_id, alias_id``, each pair once, of vectors (``vec``, rarest gram first) whose cosine
    may reach the threshold. A gram of many on both sides is dealt on both: each pair under it
    meets in one of the tasks."""
    left = materialise(_postings(mentions, "mention_id", threshold), "mention-postings")
    right = materialise(_postings(aliases, "alias_id", threshold), "alias-postings")
    sizes = left.groupBy("gram").agg(F.count("*").alias("n")).join(right.groupBy("gram").agg(F.count("*").alias("m")), "gram")
    crowded = materialise(sizes.filter(F.col("n") * F.col("m") > crowd).select("gram", F.lit(True).alias("crowded")), "crowded-grams")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    none = F.array(F.lit(0))

    def dealt(postings: DataFrame, key: str, own: str, other: str) -> DataFrame:
        marked = join_dim(postings, crowded, "gram", stored=True)
        spot = F.when(F.col("crowded"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        return marked.select(key, "gram", "rest", spot.alias(own), F.explode(F.when(F.col("crowded"), every).otherwise(none)).alias(other))

    near = dealt(left, "mention_id", "row", "column")
    far = dealt(right, "alias_id", "column", "row").withColumnRenamed("rest", "other")
    met = near.join(far, ["gram", "row", "column"]).filter(F.col("rest") * F.col("other") >= threshold - _SLACK)
    return met.select("mention_id", "alias_id").distinct()


def _dot(left: Column, right: Column) -> Column:
    def term(total: Column, e: Column) -> Column:
        return total + e["w"] * F.coalesce(F.try_element_at(right, e["gram"]), F.lit(0.0))

    return F.aggregate(left, F.lit(0.0), term)


def alias_vectors(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary side, which may be kept and used again: ``(idf, vectors)``."""
    names = aliases.select(normal_form(F.col("alias")).alias("alias")).distinct()
    names = materialise(names.filter(F.length("alias") >= 3), "aliases")
    total = F.lit(names.count()).cast("double")
    counts = _gram_counts(names, "alias")
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    idf = materialise(df.withColumn("idf", F.log((1 + total) / (1 + F.col("df"))) + 1), "idf")
    return idf, _numbered(_vectors(counts, idf, "alias"), "alias")


def _numbered(vectors: DataFrame, key: str) -> DataFrame:
    """A stored table of vectors, each with a number of its own."""
    return materialise(vectors.withColumn(f"{key}_id", F.monotonically_increasing_id()), f"{key}-vectors")


def alias_scores(
    mentions: DataFrame, aliases: DataFrame, threshold: float = 0.5, *, vectors: tuple | None = None
) -> DataFrame:
    """``mention, alias, score`` for all pairs with ``score > threshold``, over the distinct
    normal forms of both sides. ``mentions`` holds ``mention``."""
    idf, known = vectors or alias_vectors(aliases)
    asked = mentions.select(normal_form(F.col("mention")).alias("mention")).distinct()
    asked = asked.filter(F.length("mention") >= 3)
    vecs = _numbered(_vectors(_gram_counts(asked, "mention"), idf, "mention"), "mention")
    pairs = candidate_pairs(vecs, known, threshold)
    weights = F.map_from_entries(F.transform("other.vec", lambda e: F.struct(e["gram"], e["w"])))
    scored = pairs.join(vecs, "mention_id").join(known.alias("other"), "alias_id").select(
        "mention", "alias", F.round(_dot(vecs["vec"], weights), DIGITS).alias("score")
    )
    return scored.filter(F.col("score") > threshold)


def link_concepts(
    mentions: DataFrame,
    aliases: DataFrame,
    concepts: DataFrame,
    k: int = 30,
    threshold: float = 0.5,
    *,
    vectors: tuple | None = None,
) -> DataFrame:
    """``mention, concept_id, score, label`` for each distinct non-null mention.

    The ``k`` best (alias, concept) candidates of a mention are kept, then the best score of
    each concept that has a definition, then the best concept (score, then concept id). The
    label is ``name [id]``, or the mention itself where nothing is linked.

    ``mentions(mention)``, ``aliases(concept_id, alias)``,
    ``concepts(concept_id, canonical_name, definition)``.
    """
    texts = mentions.select("mention").filter(F.col("mention").isNotNull()).distinct()
    texts = texts.withColumn("norm", normal_form(F.col("mention")))
    scores = alias_scores(texts.select(F.col("norm").alias("mention")), aliases, threshold, vectors=vectors)
    scores = materialise(scores, "alias-scores")

    owners = aliases.select("concept_id", normal_form(F.col("alias")).alias("alias")).distinct()
    ranked = Window.partitionBy("mention").orderBy(F.desc("score"), "concept_id", "alias")
    candidates = (
        join_dim(scores, owners, "alias", "inner")
        .withColumn("__rank", F.row_number().over(ranked))
        .filter(F.col("__rank") <= k)
    )
    known = concepts.filter(F.col("definition").isNotNull()).select("concept_id", "canonical_name")
    best = (
        join_dim(candidates, known, "concept_id", "inner")
        .groupBy("mention")
        .agg(
            F.max_by(
                F.struct("concept_id", "canonical_name", "score"),
                F.struct(F.col("score"), F.lit(0) - F.col("__rank")),
            ).alias("b")
        )
        .select(F.col("mention").alias("norm"), "b.*")
    )
    name = F.concat(F.col("canonical_name"), F.lit(" ["), F.col("concept_id").cast("string"), F.lit("]"))
    return texts.join(best, "norm", "left").select(
        "mention", "concept_id", "score", F.coalesce(name, F.col("mention")).alias("label")
    )
