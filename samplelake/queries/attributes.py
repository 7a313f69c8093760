"""Attributes, pairs, contexts, metadata rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.fields import DEFAULT_FIELDS, Field, Group
from samplelake.operators.attrs import (
    check_prefix,
    context_lines,
    copy_fields,
    long_lines,
    match_refs,
    pair_series,
    ref_context,
)
from samplelake.operators.link import link_concepts
from samplelake.operators.ordered import first_n
from samplelake.operators.prompts import build_prompts
from samplelake.operators.union import ragged_union, run_summary
from samplelake.plans.metadata import Vocabulary, extract_metadata, first_samples
from samplelake.queries.registry import (
    ATTR_SQL,
    document_attr,
    document_entities,
    document_pairs,
    query,
    table,
)


@query(
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders
    ) WHERE rn <= 2
    """
)
def first_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return first_n(orders, "o_custkey", "o_orderkey", 2)


@query("SELECT source AS file, 'D' || doc_id AS sample, source AS series FROM documents")
def series_pairs(spark: SparkSession, folder: str) -> DataFrame:
    entity = document_entities(spark, folder)
    return pair_series(document_attr(spark, folder), entity).select("file", "sample", "series")


@query(
    """
    SELECT source AS series, 'D' || doc_id AS sample FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents
    ) WHERE rn <= 2
    """
)
def first_samples_per_series(spark: SparkSession, folder: str) -> DataFrame:
    entity = document_entities(spark, folder)
    pairs = pair_series(document_attr(spark, folder), entity)
    return first_samples(pairs, entity, 2).select("series", "sample")


COPIED = tuple(f for f in DEFAULT_FIELDS if f.copied) + (
    Field("design", ref=("Series_overall_design",), copy_from_ref=True),
    Field("description", ref=("Sample_description",), copy_from_ref=True),
)


@query(
    f"""
    WITH {ATTR_SQL},
    own AS (
      SELECT accession,
             string_agg(CASE WHEN key = 'title' THEN value END, ';' ORDER BY pos) AS title,
             string_agg(CASE WHEN key = 'type' THEN value END, ';' ORDER BY pos) AS type,
             string_agg(CASE WHEN key = 'series_id' THEN value END, ';' ORDER BY pos) AS series_id,
             string_agg(CASE WHEN key = 'platform_id' THEN value END, ';' ORDER BY pos) AS platform_id,
             string_agg(CASE WHEN key = 'relation' THEN value END, ';' ORDER BY pos) AS relation,
             string_agg(CASE WHEN key = 'description' THEN value END, ';' ORDER BY pos) AS description
      FROM attr WHERE kind = 'SAMPLE' GROUP BY accession
    ),
    shared AS (
      SELECT accession,
             string_agg(CASE WHEN key = 'pubmed_id' THEN value END, ';' ORDER BY pos) AS pubmed_id,
             string_agg(CASE WHEN key = 'overall_design' THEN value END, ';' ORDER BY pos) AS design
      FROM attr WHERE kind = 'SERIES' GROUP BY accession
    )
    SELECT o.accession AS sample, title, type, series_id, pubmed_id, platform_id, relation, design, description
    FROM documents d JOIN own o ON o.accession = 'D' || d.doc_id JOIN shared s ON s.accession = d.source
    """
)
def copied_fields(spark: SparkSession, folder: str) -> DataFrame:
    return copy_fields(document_attr(spark, folder), document_pairs(spark, folder), COPIED).drop("file")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as samples: an attribute per role, its values by turn."""
    turns = table(spark, folder, "conversations")
    first = turns.groupBy("conv_id", "role").agg(F.min("turn").alias("key_ord"))
    return turns.join(first, ["conv_id", "role"]).select(
        F.lit("conversations").alias("file"), F.lit("SAMPLE").alias("kind"),
        F.col("conv_id").cast("string").alias("accession"), F.col("role").alias("key"),
        "key_ord", F.col("turn").alias("pos"), F.col("text").alias("value"),
    )


TURNS_SQL = r"""
turns AS (
  SELECT conv_id, role, turn, min(turn) OVER (PARTITION BY conv_id, role) AS key_ord,
         '!Sample_' || role || ' = ' || text AS line FROM conversations WHERE text <> ''
),
sized AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS tokens FROM turns)
"""


def _conversation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.lit("conversations").alias("file"), F.col("conv_id").cast("string").alias("sample"),
        F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("series_file"),
    ).distinct()


@query(
    f"""
    WITH {TURNS_SQL},
    texts AS (
      SELECT conv_id, string_agg(line, E'\\n' ORDER BY key_ord, turn) AS context
      FROM sized WHERE tokens < 80 GROUP BY conv_id
    )
    SELECT c.conv_id::VARCHAR AS sample, coalesce(context, '') AS context
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN texts t USING (conv_id)
    """
)
def sample_contexts(spark: SparkSession, folder: str) -> DataFrame:
    attr = _turns(spark, folder)
    return context_lines(attr, _conversation_pairs(spark, folder), max_tokens=80).drop("file")


@query(
    f"""
    WITH {TURNS_SQL}
    SELECT conv_id::VARCHAR AS accession, 'attribute too long, left out: ' || role AS message, count(*) AS n
    FROM sized WHERE tokens >= 80 GROUP BY 1, 2
    """
)
def long_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return long_lines(_turns(spark, folder), max_tokens=80).groupBy("accession", "message").agg(F.count("*").alias("n"))


SERIES_TAIL_SQL = f"""
WITH {ATTR_SQL},
own AS (
  SELECT accession, string_agg('!Sample_' || key || ' = ' || value, E'\\n' ORDER BY key_ord, pos) AS t
  FROM attr WHERE kind = 'SAMPLE' AND value <> '' GROUP BY accession
),
contexts AS (
  SELECT o.accession AS sample,
         o.t || E'\\n!Series_title = Source ' || d.source || E'\\n!Series_overall_design = ' || s.n || ' documents' AS context
  FROM documents d JOIN own o ON o.accession = 'D' || d.doc_id JOIN series s ON s.source = d.source
)
"""


@query(f"{SERIES_TAIL_SQL} SELECT sample, context FROM contexts")
def series_contexts(spark: SparkSession, folder: str) -> DataFrame:
    attr, pairs = document_attr(spark, folder), document_pairs(spark, folder)
    return context_lines(attr, pairs, max_tokens=1_000_000).drop("file")


REFS = ("Series_title", "Sample_id", "Sample_type", "Series_design")


@query(
    f"""
    WITH {ATTR_SQL},
    refs(place, kind, ref) AS (VALUES (1, 'SERIES', 'title'), (2, 'SAMPLE', 'id'), (3, 'SAMPLE', 'type'), (4, 'SERIES', 'design')),
    found AS (
      SELECT a.accession, r.kind, r.place, r.ref, a.key, min(a.key_ord) AS key_ord, string_agg(a.value, ';' ORDER BY a.pos) AS v
      FROM attr a JOIN refs r ON r.kind = a.kind AND contains(a.key, r.ref) GROUP BY ALL
    )
    SELECT 'D' || d.doc_id AS sample,
           string_agg(CASE WHEN f.kind = 'SAMPLE' THEN 'Sample_' ELSE 'Series_' END || f.ref || ' = ' || f.v, E'\\n' ORDER BY place, key_ord) AS context
    FROM documents d JOIN found f
      ON (f.kind = 'SAMPLE' AND f.accession = 'D' || d.doc_id) OR (f.kind = 'SERIES' AND f.accession = d.source)
    GROUP BY 1
    """
)
def ref_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return ref_context(document_attr(spark, folder), document_pairs(spark, folder), REFS).drop("file")


@query(
    """
    SELECT p_partkey, ref_no, ref FROM part
    JOIN (VALUES (0, 'r'), (1, 'bolt'), (2, 'ed w'), (3, 'zzz')) refs(ref_no, ref) ON contains(p_name, ref)
    """
)
def substring_refs(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return match_refs(parts, F.col("p_name"), ["r", "bolt", "ed w", "zzz"]).drop("p_name")


@query(
    """
    SELECT source AS accession, starts_with(source, 'src1') AS accepted, count(*) AS n FROM documents GROUP BY 1, 2
    """
)
def accession_check(spark: SparkSession, folder: str) -> DataFrame:
    good, errors = check_prefix(table(spark, folder, "documents").select("source"), "source", "src1")
    both = good.select(F.col("source").alias("accession"), F.lit(True).alias("accepted")).unionByName(
        errors.select("accession", F.lit(False).alias("accepted"))
    )
    return both.groupBy("accession", "accepted").agg(F.count("*").alias("n"))


ASKED = Group(
    0,
    (
        Field("language", description="language of the text", options=("en", "de", "fr", "es")),
        Field("organ/tissue", description="", map_to_umls=True),
    ),
)


# What the prompt has to say about ``ASKED``.
ASKED_FORM = """{
 "type": "object",
 "properties": {
  "language": {
   "type": "string",
   "description": "language of the text",
   "enum": [
    "en",
    "de",
    "fr",
    "es"
   ]
  },
  "organ/tissue": {
   "type": "string"
  }
 },
 "required": [
  "language",
  "organ/tissue"
 ]
}
"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql() -> str:
    head = "Read the attributes of a biological sample and fill in the form below.\nATTRIBUTES\n"
    tail = (
        "\nFORM\n" + ASKED_FORM + "\nUse null for what the attributes do not say. First give your reasons in "
        "at most 50 words, then one fenced json block that is valid JSON without comments."
    )
    return f"""{SERIES_TAIL_SQL},
    prompts AS (SELECT sample, {_sql_text(head)} || context || {_sql_text(tail)} AS prompt FROM contexts)
    SELECT sample, prompt, sha256('model-a' || chr(10) || prompt) AS prompt_key FROM prompts
    """


@query(_prompt_sql())
def metadata_prompts(spark: SparkSession, folder: str) -> DataFrame:
    contexts = context_lines(document_attr(spark, folder), document_pairs(spark, folder), max_tokens=1_000_000)
    return build_prompts(contexts, ASKED, "model-a").select("sample", "prompt", "prompt_key")


def _vocabulary(spark: SparkSession, folder: str) -> Vocabulary:
    """Words of the part names and the part types as concepts; short words have no definition."""
    parts = table(spark, folder, "part")
    words = F.split("p_name", " ")
    named = (
        parts.select(F.concat(F.lit("N:"), words[1]).alias("concept_id"), words[1].alias("alias"))
        .union(parts.select(F.concat(F.lit("A:"), words[0]), F.concat_ws(" ", words[0], F.lit("thing"))))
        .union(parts.select(F.concat(F.lit("T:"), F.col("p_type")), F.concat(F.col("p_type"), F.lit(" type"))))
        .distinct()
    )
    concepts = named.select(
        "concept_id",
        F.upper("alias").alias("canonical_name"),
        F.when(F.length("alias") > 4, F.lit("defined")).alias("definition"),
    )
    return Vocabulary(concepts, named)


VOCABULARY_SQL = """
aliases AS (
  SELECT DISTINCT 'N:' || split_part(p_name, ' ', 2) AS concept_id, split_part(p_name, ' ', 2) AS alias FROM part
  UNION SELECT DISTINCT 'A:' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || ' thing' FROM part
  UNION SELECT DISTINCT 'T:' || p_type, p_type || ' type' FROM part
),
concepts AS (
  SELECT concept_id, upper(alias) AS canonical_name, CASE WHEN length(alias) > 4 THEN 'defined' END AS definition FROM aliases
)
"""


def link_sql(mentions: str) -> str:
    """The links of the ``mention`` column that the SQL ``mentions`` gives, by plain comparison
    of all pairs that share a gram."""
    return f"""
    {VOCABULARY_SQL},
    mentions AS (SELECT DISTINCT mention, trim(lower(mention)) AS norm FROM ({mentions}) WHERE mention IS NOT NULL),
    owners AS (SELECT DISTINCT concept_id, trim(lower(alias)) AS alias FROM aliases),
    names AS (SELECT DISTINCT alias FROM owners WHERE length(alias) >= 3),
    agrams AS (
      SELECT alias, substr(alias, i, 3) AS g, count(*) AS tf
      FROM names, UNNEST(range(1, length(alias) - 1)) AS u(i) GROUP BY ALL
    ),
    idf AS (SELECT g, ln((1 + (SELECT count(*) FROM names)) / (1 + count(*))) + 1 AS idf FROM agrams GROUP BY g),
    avec AS (SELECT alias, g, tf * idf AS w FROM agrams JOIN idf USING (g)),
    anorm AS (SELECT alias, sqrt(sum(w * w)) AS norm FROM avec GROUP BY alias),
    mgrams AS (
      SELECT m.norm AS mention, substr(m.norm, i, 3) AS g, count(*) AS tf
      FROM (SELECT DISTINCT norm FROM mentions WHERE length(norm) >= 3) m, UNNEST(range(1, length(m.norm) - 1)) AS u(i) GROUP BY ALL
    ),
    mvec AS (SELECT mention, g, tf * idf AS w FROM mgrams JOIN idf USING (g)),
    mnorm AS (SELECT mention, sqrt(sum(w * w)) AS norm FROM mvec GROUP BY mention),
    scores AS (
      SELECT m.mention, a.alias, round(sum(m.w * a.w) / any_value(mn.norm) / any_value(an.norm), 6) AS score
      FROM mvec m JOIN avec a USING (g) JOIN mnorm mn USING (mention) JOIN anorm an USING (alias)
      GROUP BY m.mention, a.alias
    ),
    ranked AS (
      SELECT s.mention, o.concept_id, s.score,
             row_number() OVER (PARTITION BY s.mention ORDER BY s.score DESC, o.concept_id, s.alias) AS rn
      FROM scores s JOIN owners o USING (alias)
    ),
    per_concept AS (
      SELECT r.mention, r.concept_id, c.canonical_name, max(r.score) AS score
      FROM ranked r JOIN concepts c USING (concept_id)
      WHERE r.rn <= 30 AND r.score > 0.5 AND c.definition IS NOT NULL GROUP BY ALL
    ),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, concept_id) AS rn FROM per_concept
    ),
    links AS (
      SELECT m.mention, b.concept_id, b.score,
             coalesce(b.canonical_name || ' [' || b.concept_id || ']', m.mention) AS label
      FROM mentions m LEFT JOIN best b ON b.mention = m.norm AND b.rn = 1
    )
    """


@query("WITH " + link_sql("SELECT p_name AS mention FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part")
       + " SELECT mention, concept_id, score, label FROM links")
def concept_links(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    mentions = parts.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("mention"))
    vocabulary = _vocabulary(spark, folder)
    return link_concepts(mentions, vocabulary.aliases, vocabulary.concepts)


@query(
    """
    SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS priority, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, NULL, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer
    """
)
def aligned_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnsRenamed(
        {"o_orderkey": "id", "o_orderstatus": "status", "o_orderpriority": "priority", "o_totalprice": "price"}
    )
    done = orders.filter("status = 'F'").select("id", "status", "price")
    rest = orders.filter("status <> 'F'").select("id", "priority", "price")
    return ragged_union([done, rest, table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))])


@query(
    """
    SELECT 'documents' AS item, count(*) AS n FROM documents
    UNION ALL SELECT 'samples', count(DISTINCT conv_id) FROM conversations
    UNION ALL SELECT 'prompts', count(DISTINCT text) FROM documents
    """
)
def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    samples = table(spark, folder, "conversations").select("conv_id").distinct()
    return run_summary({"documents": docs, "samples": samples, "prompts": docs.select("text").distinct()})


SPEC = (
    Field("language", description="language of the text"),
    Field("words", description="number of words"),
    Field("condition", description="", map_to_umls=True),
    Field("missing", description="never answered"),
    *(f for f in DEFAULT_FIELDS if f.copied),
)


def attribute_model(prompt: str) -> str:
    """A stand-in for a chat model: it reads the answers from the prompt's attribute lines.
    Asked about a German text, it fails."""
    text = prompt.split("ATTRIBUTES\n", 1)[1].split("\nFORM\n", 1)[0]
    lines = text.split("\n")
    language = next(line for line in lines if line.startswith("!Sample_type = ")).split(" = ", 1)[1]
    if language == "de":
        raise RuntimeError("no German")
    described = [line.split(" = ", 1)[1] for line in lines if line.startswith("!Sample_description = ")]
    words = sum(len(line.split()) for line in described)
    condition = ["blue gizmo", "hot bolts", None][words % 3]
    reply = {"language": language, "words": words, "condition": condition}
    return "Reasons: none.\n```json\n" + json.dumps(reply)[:-1] + ", // that is all\n \"sure\": True}\n```"


def _metadata_sql() -> str:
    mentions = "SELECT * FROM (VALUES ('blue gizmo'), ('hot bolts')) v(mention)"
    return f"""
    {SERIES_TAIL_SQL},
    {link_sql(mentions)},
    counted AS (
      SELECT 'D' || doc_id AS sample, coalesce(sum(len(regexp_extract_all(line, '\\S+'))), 0) AS n
      FROM documents LEFT JOIN doc_values USING (doc_id) GROUP BY 1
    ),
    answers AS (
      SELECT c.sample,
             CASE WHEN d.lang <> 'de' THEN d.lang END AS language,
             CASE WHEN d.lang <> 'de' THEN c.n::BIGINT::VARCHAR END AS words,
             CASE WHEN d.lang <> 'de' THEN CASE c.n % 3 WHEN 0 THEN 'blue gizmo' WHEN 1 THEN 'hot bolts' END END AS condition
      FROM counted c JOIN documents d ON c.sample = 'D' || d.doc_id
    )
    SELECT a.sample AS gsm, a.language, a.words, a.condition, l.label AS condition_umls, NULL::VARCHAR AS missing,
           NULL::VARCHAR AS title, d.lang AS type, d.source AS series_id, s.es::VARCHAR AS pubmed_id,
           CASE WHEN q.quality IS NOT NULL THEN 'Q' || q.quality END AS platform_id, NULL::VARCHAR AS relation, o.t AS raw_metadata
    FROM answers a JOIN documents d ON a.sample = 'D' || d.doc_id JOIN own o ON o.accession = a.sample
    JOIN series s ON s.source = d.source LEFT JOIN labels q ON q.doc_id = d.doc_id
    LEFT JOIN links l ON l.mention = a.condition
    """


def _extraction(spark: SparkSession, folder: str):
    attr, pairs = document_attr(spark, folder), document_pairs(spark, folder)
    return extract_metadata(
        attr, pairs, SPEC, attribute_model, _vocabulary(spark, folder),
        max_tokens=1_000_000, parallel=spark.sparkContext.defaultParallelism,
    )


@query(_metadata_sql())
def metadata_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _extraction(spark, folder).rows


@query(
    """
    SELECT 'infer' AS stage, 'D' || doc_id AS accession, 'RuntimeError: no German' AS message FROM documents WHERE lang = 'de'
    """
)
def metadata_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _extraction(spark, folder).errors.select("stage", "accession", "message")
