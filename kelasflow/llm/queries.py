"""The registered queries of the operators, and their SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.llm import chat_format, decontamination, exact_dedup, language_id, mixing, near_dup, pii, quality
from kelasflow.llm import queries_audit, secret_scan, url_filter
from kelasflow.llm.common import id_bucket, table, text_of


QUALITY_THRESHOLD = 0.3


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, base kinds and what their contexts discover."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def number(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted by the template, and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    trap = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat_format.format_chats(rows.unionByName(trap))
    back = made.select("conv_id", "formatted", "valid",
                       chat_format.read_back(F.col("formatted")).alias("turns"))
    back = back.withColumn("learned", F.array_join(
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
m AS (
  SELECT *, CASE role WHEN 'system' THEN length('<<SYS>>' || '<</SYS>>') + 3
                      WHEN 'user' THEN length('[INST] ' || ' [/INST]')
                      WHEN 'assistant' THEN length('<s> ' || ' </s>')
                      ELSE length('[ROLE ' || '] ' || ' [/ROLE]') + length(role)
                           + length(regexp_replace(role, '[^\<\[\]]', '', 'g')) END
            + length(text) + length(regexp_replace(text, '[^\<\[\]]', '', 'g')) AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a'
                                              ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM m GROUP BY conv_id
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150% of the corpus takes of every document."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned without the held-out quarter of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, id_bucket(F.col("id"), 4) != 2)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 0.8 of their 5-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of every document after lower-casing A-Z; the largest id stays."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, keep="max").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


OP6_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


# Formats whose findings count as labelled: what fits one of the first is a secret,
# what fits one of the others is none.
SECRET_FORMS = (r"AKIA[0-9A-Z]{16}", r"password=[0-9a-f]{12,}", r"(?<=token = \")[0-9a-f]{32,}(?=\")")
HARMLESS_FORMS = (r"(?<![0-9A-Za-z+/=_.-])[0-9]{16,19}(?![0-9A-Za-z+/=_.-])", r"(?<=@)[a-z0-9-]++(?:\.[a-z0-9-]++)++")


def _labelled_findings(docs: DataFrame) -> DataFrame:
    """Findings of the fixed formats in four fifths of the documents."""
    text = text_of("text")
    learn = docs.where(id_bucket(F.col("doc_id"), 5) != 0)

    def of(form: str, label: int) -> Column:
        return F.transform(pii.find_all(text, form), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label")))
    return learn.select("doc_id", F.inline(F.concat(
        *[of(f, 1) for f in SECRET_FORMS], *[of(f, 0) for f in HARMLESS_FORMS])))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: candidates that the forest leaves standing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_scan.scan(docs, _labelled_findings(docs))
    per = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum(F.col("secret").cast("long")).alias("n_secrets"),
        F.array_sort(F.collect_list(F.when(F.col("secret"), F.struct("start", "end")))).alias("spans"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"),
                                                                    s["end"].cast("string"))), ",")
    return docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_secrets", F.lit(0)).alias("n_secrets"), F.coalesce(spans, F.lit("")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned without the held-out fifth of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("id"), 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rule or by the trees."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word benchmark windows."""
    found = decontamination.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS l, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, l, i, list_slice(w, i, i + l - 1) AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, l, item FROM dw JOIN win USING (l, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
       FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""


QUERIES = {
    "op1_pii": op1_pii,
    "op2_chat_format": op2_chat_format,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    **queries_audit.QUERIES,
}

ORACLE_SQL = {
    "op2_chat_format": OP2_SQL,
    "op5_ngram_jaccard": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    **queries_audit.ORACLE_SQL,
}
