"""One query per operator on its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.archives import archived
from tillwatch.llm.chat import ORDER, as_events, format_chats, read_back
from tillwatch.llm.cluster_tree import nearest_vectors
from tillwatch.llm.collocations import collocations
from tillwatch.llm.decontamination import contaminated
from tillwatch.llm.language import identify_languages
from tillwatch.llm.lines import dedup_lines
from tillwatch.llm.minhash import near_duplicates
from tillwatch.llm.mixing import mix_by_source
from tillwatch.llm.runs import longest_run, periodic_runs, runs_text
from tillwatch.llm.substrings import dedup_substrings
from tillwatch.llm.token_counts import count_tokens, recount_tokens, revision
from tillwatch.llm.vector_graph import near_vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


#: A public rank file; a parameter of the operator, never part of the repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = count_tokens(table(spark, sf_dir, "documents"), RANKS)
    edited = recount_tokens(trees, revision(F.col("text"), F.col("doc_id")), RANKS)
    return edited.select("doc_id", "tokens_before", "tokens", F.size("leaf_ends").cast("long").alias("leaves"), "pieces_encoded",
                         F.sha2("text", 256).alias("text_sha256"))


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_by_source(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(as_events(rows.unionByName(more)), ORDER))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                       F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), held AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id
"""

def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "entropy", "accepted")


OP8_SQL = r"""
WITH word AS (
  SELECT doc_id, unnest(parts) AS word, unnest(range(len(parts))) AS pos, len(parts) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS parts FROM documents WHERE text IS NOT NULL)
), win AS (
  SELECT doc_id, pos, word, n, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM word
), late AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS late FROM win WHERE pos + 20 <= n
), covered AS (
  SELECT w.doc_id, w.pos, w.word, coalesce(max(l.late::INT) OVER (
    PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM win w LEFT JOIN late l USING (doc_id, pos)
), done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN done USING (doc_id)
"""


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs where a tenth of the texts, told by the id alone, repeat themselves from some word on."""
    parts = F.split("text", "[ \\t\\n\\x0B\\f\\r]+")
    chosen = docs.withColumn("__h", F.crc32(F.col("doc_id").cast("string"))).withColumn(
        "__words", F.when(F.col("__h") % 10 == 0, F.filter(parts, lambda w: w != "")))
    g, n = F.call_function("div", F.col("__h"), F.lit(10)), F.size("__words")
    placed = chosen.withColumn("__a", F.when(n > 0, g % n)).withColumn(
        "__p", F.call_function("div", n - F.col("__a"), F.lit(3) + g % 8) + 1)
    at = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    again = F.concat_ws(" ", F.transform("__words", lambda w, i: F.element_at("__words", (at(i) + 1).cast("int"))))
    return placed.withColumn("text", F.when(F.col("__a").isNotNull(), again).otherwise(F.col("text"))).drop("__h", "__words", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("best", longest_run())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(runs_text(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13),
      'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9)) AS t FROM documents
), piece AS (
  SELECT d, lang, unnest(parts) AS piece, unnest(range(len(parts))) AS p
  FROM (SELECT d, lang, string_split(t, chr(10)) AS parts FROM doc)
), word AS (
  SELECT d, lang, p, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM piece)
), tok AS (
  SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM word WINDOW x AS (PARTITION BY d, p ORDER BY i)
), n AS (SELECT lang, count(*) AS n FROM tok GROUP BY lang),
c1 AS (SELECT lang, w1, count(*) AS a FROM tok GROUP BY ALL),
c2 AS (SELECT lang, w1, w2, count(*) AS a FROM tok WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM tok WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, u, v, max(a) AS f FROM (SELECT lang, w1 AS u, w2 AS v, a FROM c3 UNION ALL SELECT lang, w2, w3, a FROM c3) GROUP BY ALL
), cut AS (
  SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, c2.a, 1 AS k, x.a AS l, y.a AS r
  FROM c2 JOIN c1 x ON x.lang = c2.lang AND x.w1 = c2.w1 JOIN c1 y ON y.lang = c2.lang AND y.w1 = c2.w2
  LEFT JOIN longer ON longer.lang = c2.lang AND u = c2.w1 AND v = c2.w2 WHERE c2.a >= 10 AND NOT coalesce(100 * f >= 50 * c2.a, false)
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.a, 1, x.a, y.a
  FROM c3 JOIN c1 x ON x.lang = c3.lang AND x.w1 = c3.w1 JOIN c2 y ON y.lang = c3.lang AND y.w1 = c3.w2 AND y.w2 = c3.w3
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.a, 2, x.a, y.a
  FROM c3 JOIN c2 x ON x.lang = c3.lang AND x.w1 = c3.w1 AND x.w2 = c3.w2 JOIN c1 y ON y.lang = c3.lang AND y.w1 = c3.w3
), scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_vector_near_dedup": op3_vector_near_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_warc": op5_warc,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
SQL: dict[str, str] = {"op8_substring_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL, "op12_phrase_collocations": OP12_SQL}
