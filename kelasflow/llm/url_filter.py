"""URL filter: host and path rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.llm.common import ascii_lower, materialize

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"),
         Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/"))
# Bound on the labelled URLs that the trees are fitted on.
MAX_TRAIN = 20_000
SUFFIX_PRIOR = 20.0         # labelled URLs' worth of the overall rate in a suffix's rate
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "n_params",
            "n_hyphens", "suffix_rate", "suffix_weight")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule that fits, else null; of equal ones the first given."""
    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ordered = sorted(rules, key=lambda r: len(r.name))      # shortest innermost: the longest is asked first
    ordered = [r for _, g in _by_length(ordered) for r in reversed(g)]
    return reduce(lambda c, r: F.when(fits(r), F.lit(r.name)).otherwise(c), ordered, F.lit(None).cast("string"))


def _by_length(rules: list[Rule]) -> list[tuple[int, list[Rule]]]:
    out: dict[int, list[Rule]] = {}
    for r in rules:
        out.setdefault(len(r.name), []).append(r)
    return sorted(out.items())


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; one pass per distinct character."""
    n = F.length(text).cast("double")

    def term(acc: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return acc - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), term)


def lexical_features(df: DataFrame, url: Column, host: str = "host", path: str = "path") -> DataFrame:
    """The lexical columns of FEATURES (those of the suffix aside) added."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    n = F.length(u)
    return df.withColumns({
        "url_length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.split(host, "\\.")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy(u)).otherwise(0.0),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
        "n_hyphens": F.regexp_count(F.col(host), F.lit("-")).cast("double"),
    })


def train_sample(labelled: DataFrame, url_col: str, max_rows: int = MAX_TRAIN) -> DataFrame:
    """At most about ``max_rows`` of the labelled URLs, chosen by a hash of the
    URL; a URL that repeats, however often, is one."""
    distinct = labelled.groupBy(url_col).agg(F.max("label").alias("label"))
    n = distinct.count()
    if n <= max_rows:
        return distinct
    place = F.pmod(F.xxhash64(url_col), F.lit(1 << 40)) / float(1 << 40)
    return distinct.where(place < max_rows / n)


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES,
               labelled: DataFrame | None = None, max_train: int = MAX_TRAIN, trees: int = 12, depth: int = 4,
               seed: int = 7) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict added (columns of
    these names are replaced).

    The longest fitting rule decides; a rule fits its host and all
    subdomains when the path starts with the rule's.  Where none fits the
    verdict is that of gradient-boosted trees, blocked at a score of 0.5 or
    more.  They are fitted on ``labelled`` (url_col, label 1 = block), or, if
    that is not given, on the URLs of ``pages`` that a rule decides; at most
    ``max_train`` of them.  Suffix statistics come from the same URLs: the
    smoothed share of blocked ones among those with the host's last two
    labels, and how many there are; they are no more than the training URLs,
    so they are broadcast.  A null url, or one without ``://``, has an empty
    host and path, fits no rule and is judged by the trees.  With URLs of
    one label only, or none, every other page gets that label, or allow.
    """
    out = pages.withColumn("_kf_url", F.col(url_col)).withColumns(
        {"host": host_of(F.col("_kf_url")), "path": path_of(F.col("_kf_url"))})
    out = out.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_name = reduce(lambda c, r: F.when(F.col("rule") == r.name, r.verdict).otherwise(c), rules,
                     F.lit(None).cast("string"))
    if labelled is None:
        named = out.where(F.col("rule").isNotNull()).select(
            F.col("_kf_url").alias("_u"), (by_name == BLOCK).cast("int").alias("label"))
    else:
        named = labelled.select(F.col(url_col).alias("_u"), F.col("label").cast("int").alias("label"))
    sample = materialize(train_sample(named, "_u", max_train).withColumn("_kf_host", host_of(F.col("_u"))).withColumn(
        "_kf_suffix", suffix_of(F.col("_kf_host"))), "url-train")
    total, blocked = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    out = out.drop("score", "verdict")
    if not total or blocked in (0, total):
        score = F.lit(1.0 if total and blocked else 0.0)
        out = out.withColumn("score", score)
    else:
        rate = blocked / total
        suffixes = sample.groupBy("_kf_suffix").agg(F.sum("label").alias("_kf_b"), F.count(F.lit(1)).alias("_kf_n"))

        def with_suffix(df: DataFrame, own: Column) -> DataFrame:
            """``own``: the label of the row itself, left out of its suffix's statistics."""
            n = F.coalesce("_kf_n", F.lit(0)) - own.isNotNull().cast("int")
            b = F.coalesce("_kf_b", F.lit(0)) - F.coalesce(own, F.lit(0))
            return df.join(F.broadcast(suffixes), "_kf_suffix", "left").withColumns({
                "suffix_rate": (b + SUFFIX_PRIOR * rate) / (n + SUFFIX_PRIOR),
                "suffix_weight": F.log1p(n.cast("double"))}).drop("_kf_b", "_kf_n")

        assemble = VectorAssembler(inputCols=[f"_kf_{f}" for f in FEATURES], outputCol="_kf_features")

        def features(df: DataFrame, url: str, host: str, path: str, own: Column) -> DataFrame:
            plain = with_suffix(df.withColumn("_kf_suffix", suffix_of(F.col(host))), own)
            lexical = lexical_features(plain.select("*"), F.col(url), host, path)
            return lexical.withColumns({f"_kf_{f}": F.col(f) for f in FEATURES})

        train = features(sample.withColumn("_kf_path", path_of(F.col("_u"))), "_u", "_kf_host", "_kf_path",
                         F.col("label")).select("label", *[f"_kf_{f}" for f in FEATURES])
        trees = GBTClassifier(labelCol="label", featuresCol="_kf_features", predictionCol="_kf_pred", maxIter=trees,
                              maxDepth=depth, subsamplingRate=0.8, seed=seed)
        trees = trees.setRawPredictionCol("_kf_raw").setProbabilityCol("_kf_prob")
        model = trees.fit(assemble.transform(train))
        keep = out.columns
        rows = out.withColumn("_kf_row", F.struct(*[F.col(f"`{c}`") for c in keep])).select(
            "_kf_row", F.col("_kf_url").alias("_u"), F.col("host").alias("_kf_host"), F.col("path").alias("_kf_path"))
        judged = model.transform(assemble.transform(
            features(rows, "_u", "_kf_host", "_kf_path", F.lit(None).cast("int"))))
        out = judged.select("_kf_row.*", vector_to_array("_kf_prob")[1].alias("score"))
    verdict = F.coalesce(by_name, F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return out.withColumn("verdict", verdict).drop("_kf_url")
