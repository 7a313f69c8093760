"""One query per corpus operator over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.llm import (
    binary, content_sort, decontam, dialogue, langid, licenses, lines, packing, phrases, repeats, shards, simhash, simplex,
)
from samplelake.llm.common import table
from samplelake.queries.registry import Query, Run
from samplelake.session import new_table_path

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return add


@query("op1_phrase_fingerprints")
def phrase_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.compare_with_edits(table(spark, folder, "documents"))


@query("op2_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.learn(docs))


@query("op3_minimax_shards")
def minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(table(spark, folder, "documents"))


@query("op4_binary_records")
def binary_records(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "token-records")
    binary.write_ids(table(spark, folder, "documents"), path)
    return binary.read_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op5_simhash")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"), words=3)


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op7_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op8_repeated_strings")
def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"))


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos - 1 AS pos, u.line, trim(u.line, E' \t\r\f\v') AS own
  FROM documents, UNNEST(string_split(text, E'\n')) WITH ORDINALITY AS u(line, pos)
),
owned AS (
  SELECT doc_id, pos, own, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k,
    len(string_split_regex(own, '[ \t\r\f\v]+')) AS words
  FROM lines WHERE own <> ''
),
around AS (
  SELECT *, lag(own) OVER w AS before1, lag(own, 2) OVER w AS before2, lead(own) OVER w AS after1, lead(own, 2) OVER w AS after2,
    lead(own, 3) OVER w AS after3, lead(own, 4) OVER w AS after4, lead(words) OVER w AS more
  FROM owned WINDOW w AS (PARTITION BY doc_id ORDER BY k)
),
sized AS (
  SELECT *, CASE WHEN words >= 20 THEN 1 WHEN words + more >= 20 THEN 2 WHEN after2 IS NOT NULL THEN 3 END AS size FROM around
),
windows AS (
  SELECT doc_id, k, size, before1, before2,
    CASE size WHEN 1 THEN own WHEN 2 THEN own || E'\n' || after1 ELSE own || E'\n' || after1 || E'\n' || after2 END AS win,
    CASE size WHEN 1 THEN after1 WHEN 2 THEN after2 ELSE after3 END AS next1,
    CASE size WHEN 1 THEN after2 WHEN 2 THEN after3 ELSE after4 END AS next2
  FROM sized WHERE size IS NOT NULL
),
met AS (
  SELECT *, row_number() OVER w AS n, first_value(before1) OVER w AS b1, first_value(before2) OVER w AS b2,
    first_value(next1) OVER w AS n1, first_value(next2) OVER w AS n2
  FROM windows WINDOW w AS (PARTITION BY win ORDER BY doc_id, k)
),
spans AS (
  SELECT doc_id,
    k - CASE WHEN before1 = b1 AND before2 = b2 THEN 2 WHEN before1 = b1 THEN 1 ELSE 0 END AS a,
    k + size - 1 + CASE WHEN next1 = n1 AND next2 = n2 THEN 2 WHEN next1 = n1 THEN 1 ELSE 0 END AS b
  FROM met WHERE n > 1
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(x.pos, y.pos + 1)) AS pos
  FROM spans s JOIN owned x USING (doc_id) JOIN owned y USING (doc_id) WHERE x.k = s.a AND y.k = s.b
),
marked AS (
  SELECT l.*, g.pos IS NOT NULL AS gone FROM lines l LEFT JOIN gone g USING (doc_id, pos)
),
edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM marked
)
SELECT doc_id, coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (NOT gone), '') AS text,
  (count(*) FILTER (own <> ''))::INT AS n_lines, (count(*) FILTER (own <> '' AND gone))::INT AS n_removed,
  (count(*) FILTER (starts))::INT AS n_runs
FROM edges GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0, 0 FROM documents WHERE text IS NULL
"""


@query("op9_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.edited(docs).select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed", "n_runs")


@query("op10_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


COPIES_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS own FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(own) AS text_sha256
FROM normal WINDOW w AS (PARTITION BY own)
"""


@query("op11_exact_dedup", COPIES_SQL)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.copies(table(spark, folder, "documents"), keep="largest")


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    """The rounds one after the other; every assignment compares all pairs."""

    def nearest(centroids: str) -> str:
        return f"""
  SELECT vec_id, own, cluster, distance FROM (
    SELECT v.vec_id, v.own, c.cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.own[i] - c.own[i]) ** 2))::BIGINT AS distance
    FROM vectors v CROSS JOIN {centroids} c
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1"""

    parts = [f"""vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS own FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
)""", f"""centroids0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, own FROM vectors
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k}
)"""]
    for i in range(rounds):
        parts += [f"""found{i} AS ({nearest(f"centroids{i}")}
)""", f"""means{i} AS (
  SELECT cluster, list(mean ORDER BY place) AS own FROM (
    SELECT cluster, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
    FROM (SELECT cluster, unnest(own) AS x, unnest(range({dims})) AS place FROM found{i}) GROUP BY cluster, place
  ) GROUP BY cluster
)""", f"""centroids{i + 1} AS (
  SELECT c.cluster, coalesce(m.own, c.own) AS own FROM centroids{i} c LEFT JOIN means{i} m USING (cluster)
)"""]
    parts.append(f"""found AS ({nearest(f"centroids{rounds}")}
)""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.own, ',')) AS centroid_sha256
FROM found JOIN centroids{rounds} c USING (cluster)
"""


@query("op12_centroid_clustering", _clusters_sql())
def centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return simplex.with_inertia(*simplex.cluster(table(spark, folder, "embeddings")))


REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS tab
),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
),
dealt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind
  FROM keyed, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM dealt, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS num,
    rtrim(text, E' \t\n\x0B\x0C\r') AS own
  FROM damaged
),
marked AS (
  SELECT *, CASE WHEN own = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY num) > 1 THEN 'duplicate'
      WHEN right(own, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lead(role) OVER (PARTITION BY conv_id ORDER BY num) AS following
  FROM placed
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (following IS NOT NULL AND role[1] || following[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
),
-- The best way so far into each state: nothing, after a system, a user, an assistant turn.
ways AS (
  SELECT conv_id, n, 0::BIGINT AS num, [
    {'c': 0::BIGINT, 'a': '', 't': ''}, NULL,
    {'c': 5::BIGINT, 'a': 'I', 't': E'user:\n'}, {'c': 10::BIGINT, 'a': 'II', 't': E'user:\nassistant:\n'}
  ] AS w
  FROM counts
  UNION ALL
  SELECT conv_id, n, num, [
    b[1], b[2],
    list_min(list_filter([
      b[3], CASE WHEN b[1] IS NOT NULL THEN {'c': b[1].c + 5, 'a': b[1].a || 'I', 't': b[1].t || E'user:\n'} END,
      CASE WHEN b[2] IS NOT NULL THEN {'c': b[2].c + 5, 'a': b[2].a || 'I', 't': b[2].t || E'user:\n'} END,
      CASE WHEN b[4] IS NOT NULL THEN {'c': b[4].c + 5, 'a': b[4].a || 'I', 't': b[4].t || E'user:\n'} END
    ], lambda x: x IS NOT NULL)),
    list_min(list_filter([
      b[4], CASE WHEN b[3] IS NOT NULL THEN {'c': b[3].c + 5, 'a': b[3].a || 'I', 't': b[3].t || E'assistant:\n'} END,
      CASE WHEN b[1] IS NOT NULL THEN {'c': b[1].c + 10, 'a': b[1].a || 'II', 't': b[1].t || E'user:\nassistant:\n'} END,
      CASE WHEN b[2] IS NOT NULL THEN {'c': b[2].c + 10, 'a': b[2].a || 'II', 't': b[2].t || E'user:\nassistant:\n'} END
    ], lambda x: x IS NOT NULL))
  ] AS w
  FROM (
    SELECT y.conv_id, y.n, m.num, [
      list_min(list_filter([{'c': w[1].c + 2, 'a': w[1].a || 'D', 't': w[1].t}], lambda x: x.c IS NOT NULL)),
      list_min(list_filter([
        {'c': w[2].c + 2, 'a': w[2].a || 'D', 't': w[2].t},
        CASE WHEN stays AND role[1] = 's' THEN {'c': w[1].c + more, 'a': w[1].a || 'K', 't': w[1].t || line} END
      ], lambda x: x.c IS NOT NULL)),
      list_min(list_filter([
        {'c': w[3].c + 2, 'a': w[3].a || 'D', 't': w[3].t},
        CASE WHEN stays AND role[1] = 'u' THEN {'c': w[1].c + more, 'a': w[1].a || 'K', 't': w[1].t || line} END,
        CASE WHEN stays AND role[1] = 'u' THEN {'c': w[2].c + more, 'a': w[2].a || 'K', 't': w[2].t || line} END,
        CASE WHEN stays AND role[1] = 'u' THEN {'c': w[4].c + more, 'a': w[4].a || 'K', 't': w[4].t || line} END,
        CASE WHEN stays THEN {'c': w[1].c + more + 1, 'a': w[1].a || 'R', 't': w[1].t || 'user:' || text || E'\n'} END,
        CASE WHEN stays THEN {'c': w[2].c + more + 1, 'a': w[2].a || 'R', 't': w[2].t || 'user:' || text || E'\n'} END,
        CASE WHEN stays THEN {'c': w[4].c + more + 1, 'a': w[4].a || 'R', 't': w[4].t || 'user:' || text || E'\n'} END
      ], lambda x: x.c IS NOT NULL)),
      list_min(list_filter([
        {'c': w[4].c + 2, 'a': w[4].a || 'D', 't': w[4].t},
        CASE WHEN stays AND role[1] = 'a' THEN {'c': w[3].c + more, 'a': w[3].a || 'K', 't': w[3].t || line} END,
        CASE WHEN stays THEN {'c': w[3].c + more + 1, 'a': w[3].a || 'R', 't': w[3].t || 'assistant:' || text || E'\n'} END
      ], lambda x: x.c IS NOT NULL))
    ] AS b
    FROM ways y JOIN (
      SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
        role || ':' || text || E'\n' AS line
      FROM marked
    ) m ON y.conv_id IS NOT DISTINCT FROM m.conv_id AND m.num = y.num + 1
  )
),
best AS (
  SELECT conv_id, list_min(list_filter([w[1], w[4]], lambda x: x IS NOT NULL)) AS b FROM ways WHERE num = n
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
  sha256(CASE WHEN coalesce(b.t, '') = '' THEN '' ELSE b.t[1:length(b.t) - 1] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON i.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@query("op13_conversation_repair", REPAIR_SQL)
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.repair_damaged(table(spark, folder, "conversations"))
