"""Secret scan: candidate strings, and a random forest that removes false positives."""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.llm.common import materialize, text_of
from kelasflow.llm.text import NOT_SPACE, chunks
from kelasflow.llm.word_codes import runs, word_array

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_.-]{16,}")
DICTIONARY = 20_000             # most frequent words of the corpus
MAX_TRAIN = 20_000              # labelled findings that the forest is fitted on
NEIGHBOUR_PRIOR = 5.0           # findings' worth of the overall rate in a word's rate
THRESHOLD = 0.5
COUNT_BYTES = 4 << 20           # text whose words are counted at once
STRETCH = 256                   # characters within which findings are looked for around a candidate
FEATURES = ("length", "turns", "digits", "uppers", "hex_share", "surprise", "coverage", "assigned", "quoted",
            "path_depth", "path_rate", "before_rate", "after_rate")
_WORD = re.compile(r"[a-z]+")
_log = logging.getLogger(__name__)


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY) -> list[tuple[str, int]]:
    """The most frequent words of 3 to 12 letters a-z, over all texts; ties by
    the word.  Words are counted per bounded run of documents before the
    shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(0), COUNT_BYTES):
                start, end, _ = runs(c, c.low, NOT_SPACE)
                if not len(start):
                    continue
                others = np.concatenate([[0], np.cumsum((c.low < 97) | (c.low > 122))])
                size = end - start
                good = (others[end] == others[start]) & (size >= 3) & (size <= 12)
                body = c.low[NOT_SPACE[c.low]][np.repeat(good, size)]
                seen = word_array(body, size[good]).value_counts()
                yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.large_string()).cast(pa.string()),
                                                  seen.field("counts")], names=["word", "n"])

    counted = (docs.select(text_of(text_col).alias("t")).mapInArrow(count, "word string, n long")
               .groupBy("word").agg(F.sum("n").alias("n")))
    return [(r["word"], r["n"]) for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]


@dataclass
class Lexicon:
    """Words, and the cost in bits of one letter after another in them."""

    words: frozenset[str]
    bits: np.ndarray

    @staticmethod
    def of(counted: list[tuple[str, int]]) -> Lexicon:
        pairs = np.ones((26, 26))
        for w, n in counted:
            codes = [ord(c) - 97 for c in w]
            for a, b in zip(codes, codes[1:]):
                pairs[a, b] += n
        return Lexicon(frozenset(w for w, _ in counted), -np.log2(pairs / pairs.sum(axis=1, keepdims=True)))

    def surprise(self, s: str) -> float:
        """Mean bits per letter pair of the string; 8 where it has none."""
        total = n = 0.0
        for run in _WORD.findall(s.lower()):
            for a, b in zip(run, run[1:]):
                total += self.bits[ord(a) - 97, ord(b) - 97]
                n += 1
        return float(total / n) if n else 8.0

    def coverage(self, s: str) -> float:
        """Share of the characters within dictionary words, longest first from the left."""
        low, at, covered = s.lower(), 0, 0
        while at < len(low):
            size = next((k for k in range(min(12, len(low) - at), 2, -1) if low[at:at + k] in self.words), 0)
            covered += size
            at += size or 1
        return covered / len(s)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def candidate_features(text: str, start: int, end: int, lexicon: Lexicon) -> list[float]:
    """The features of FEATURES up to ``quoted``."""
    s = text[start:end]
    n = len(s)
    kinds = [_kind(c) for c in s]
    before = text[max(0, start - 4):start]
    return [math.log2(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, kinds.count(2) / n, kinds.count(1) / n,
            sum(c in "0123456789abcdef" for c in s) / n, lexicon.surprise(s), lexicon.coverage(s),
            float("=" in s.rstrip("=") or "=" in before or ":" in before), float(before[-1:] in ('"', "'"))]


def _neighbour(text: str) -> str:
    return re.sub(r"[^0-9a-z=:]", "", text.lower())[:32]


def candidates(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text",
               path_col: str = "source") -> DataFrame:
    """One row per candidate: id, path, start, end (code points), value_hash,
    before, after and x, the features of the string itself.

    A candidate is a run of 16 or more of ``A-Za-z0-9+/=_.-``; ``before``
    and ``after`` are the neighbouring words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    found_type = "array<struct<start:int,end:int,before:string,after:string,x:array<double>>>"

    @F.arrow_udf(found_type)
    def find(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lex = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()),
                                   ("after", pa.string()), ("x", pa.list_(pa.float64()))]))
        for col in cols:
            out = []
            for t in col:
                text, rows = t.as_py() or "", []
                for m in CANDIDATE.finditer(text):
                    left = text[max(0, m.start() - 80):m.start()].split()
                    right = text[m.end():m.end() + 80].split()
                    # an assignment's name is the word before, also where it is written without spaces
                    name = " ".join(left[-2:]) if left and _neighbour(left[-1]) in ("", "=", ":") else " ".join(left[-1:])
                    if "=" in m.group().rstrip("="):
                        name = m.group().split("=", 1)[0] + "="
                    rows.append({"start": m.start(), "end": m.end(), "before": _neighbour(name),
                                 "after": _neighbour(right[0]) if right else "",
                                 "x": candidate_features(text, m.start(), m.end(), lex)})
                out.append(rows)
            yield pa.array(out, kind)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
                       find(text_of(text_col)).alias("found"))
    return rows.select("id", "path", F.inline("found"))


def _labels(found: DataFrame, known: DataFrame) -> DataFrame:
    """id, start, end and label of the candidates that labelled findings
    overlap; 1 if one of these is a secret.  Both sides are laid out in
    stretches of text, so only what is near one another is compared."""
    def laid(rows: DataFrame, start: str, end: str) -> DataFrame:
        first, last = F.floor(F.col(start) / STRETCH), F.floor((F.col(end) - 1) / STRETCH)
        return rows.where(F.col(start) < F.col(end)).withColumn("stretch", F.explode(F.sequence(first, last)))
    places = laid(found.select("id", "start", "end").distinct(), "start", "end")
    marks = laid(known.select("id", F.col("start").alias("_s"), F.col("end").alias("_e"), "label"), "_s", "_e")
    pairs = materialize(places.join(marks, ["id", "stretch"]).where("start < _e AND _s < end")
                        .select("id", "start", "end", "_s", "_e", "label").distinct(), "overlaps")
    lost = known.count() - pairs.select("id", "_s", "_e").distinct().count()
    if lost:
        _log.warning("%d labelled findings overlap no candidate and are not trained on", lost)
    return pairs.groupBy("id", "start", "end").agg(F.max("label").alias("label"))


def _rates(train: DataFrame, col: str, overall: float) -> DataFrame:
    return train.groupBy(col).agg(F.sum("label").alias("_pos"), F.count(F.lit(1)).alias("_all")).select(
        col, "_pos", "_all")


def scan(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         path_col: str = "source", max_train: int = MAX_TRAIN, trees: int = 20, depth: int = 6,
         threshold: float = THRESHOLD, seed: int = 5) -> DataFrame:
    """Every candidate with its score: id_col, path, start, end, score, secret.

    ``findings`` (id_col, start, end, label 1 = secret) are findings that
    someone has labelled; a candidate that one overlaps has its label, or
    that of a secret among several.  Findings that overlap none are counted
    in a warning.  At most about ``max_train`` labelled candidates,
    chosen by a hash of place and id, train a random forest on length,
    character transitions, dictionary coverage, path and neighbouring words
    (smoothed share of secrets among the training findings with that word,
    leaving the finding itself out; never more words than findings, so they
    are broadcast).  With findings of one label, or none, every candidate
    gets that label's score, or 1: nothing is removed without evidence.
    Null texts have no candidates, null paths are empty ones, repeated rows
    are scanned each, an empty table gives no rows.  Whole texts are read.
    """
    lexicon = Lexicon.of(dictionary(docs, text_col))
    found = materialize(candidates(docs, lexicon, id_col, text_col, path_col), "candidates")
    known = findings.select(F.col(id_col).alias("id"), F.col("start").cast("int").alias("start"),
                            F.col("end").cast("int").alias("end"), F.col("label").cast("int").alias("label"))
    known = materialize(known.groupBy("id", "start", "end").agg(F.max("label").alias("label")), "known-findings")
    labels = materialize(_labels(found, known), "labels")
    labelled = found.join(labels, ["id", "start", "end"]).dropDuplicates(["id", "start", "end"])
    n = labels.count()
    place = F.pmod(F.xxhash64("id", "start"), F.lit(1 << 40)) / float(1 << 40)
    labelled = materialize(labelled.where(place < max_train / n) if n > max_train else labelled, "findings")
    total, secrets = labelled.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or secrets in (0, total):
        score = F.lit(0.0 if total and not secrets else 1.0)
        return found.select(F.col("id").alias(id_col), "path", "start", "end", score.alias("score"),
                            (score >= threshold).alias("secret"))
    overall = secrets / total

    def full(rows: DataFrame, own: bool) -> DataFrame:
        """The features as columns; ``own``: the row's label counts in the rates and is taken out."""
        out = rows
        for col, name in (("path", "path_rate"), ("before", "before_rate"), ("after", "after_rate")):
            out = out.join(F.broadcast(_rates(labelled, col, overall)), col, "left")
            pos, n_all = F.coalesce("_pos", F.lit(0)), F.coalesce("_all", F.lit(0))
            if own:
                pos, n_all = pos - F.col("label"), n_all - 1
            out = out.withColumn(name, (pos + NEIGHBOUR_PRIOR * overall) / (n_all + NEIGHBOUR_PRIOR)).drop("_pos", "_all")
        out = out.withColumn("path_depth", F.size(F.split("path", "/")).cast("double"))
        return out.withColumns({f: F.col("x")[i] for i, f in enumerate(FEATURES[:9])})

    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(assemble.transform(full(labelled, True)).select("features", "label"))
    scored = model.transform(assemble.transform(full(found, False)))
    scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "path", "start", "end", "score",
                         (F.col("score") >= threshold).alias("secret"))
