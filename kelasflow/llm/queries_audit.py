"""Registered queries of the source audit, the HTML extraction and the run detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.llm import divergence, html_extract, periodic_runs
from kelasflow.llm.common import table


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of a language against the others, and its distinctive terms."""
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM k GROUP BY ALL),
c AS (SELECT o.lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p,
        1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
        LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER w AS INTEGER) AS rank
FROM f WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 10
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by a hash of the id, the
    words from some place on repeat the first of them.  Null text is empty, a
    null id hashes as the empty string."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    parts = (docs.select("doc_id", text.alias("text"), F.floor(h / 10).alias("_g"), words.alias("_w"))
             .select("doc_id", "text", "_g", "_w", F.size("_w").cast("long").alias("_n")))
    parts = parts.select("doc_id", "text", "_w", "_n", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).alias("_a"), "_g")
    parts = parts.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.expr("array_join(concat(slice(_w, 1, cast(_a as int)), slice(flatten(array_repeat("
                   "slice(_w, cast(_a + 1 as int), cast(_p as int)), cast((_n - _a + _p - 1) div _p as int))),"
                   " 1, cast(_n - _a as int))), ' ')")
    return parts.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text, some of them given repetitions first."""
    found = periodic_runs.find_runs(with_repetitions(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {"op11_source_divergence": op11_source_divergence, "op12_html_extraction": op12_html_extraction,
           "op13_periodic_runs": op13_periodic_runs}

ORACLE_SQL = {"op11_source_divergence": OP11_SQL}
