"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelasflow.llm.common import materialize, text_of

UNKNOWN = "und"
PROFILE = 300               # most frequent n-grams of a document or a language
MAX_TRAIN = 1_500           # documents per language that a profile is counted from
CHARS_AT_ONCE = 1 << 18
_BITS = 21                  # a code point needs 21 bits: three fill an n-gram code


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, one after another, and their ends."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in low])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), ends


def ngram_profiles(texts: list[str], most: int | None = PROFILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its n-grams of one to three characters and their counts, most
    frequent first, ties by code; letters count, every other run of
    characters is one space, and words are padded with it."""
    codes, ends = _codes(texts)
    letter = _letters()[codes] if len(codes) else np.zeros(0, bool)
    start = 0
    for end in ends:
        c, is_letter = codes[start:end], letter[start:end]
        start = end
        if not is_letter.any():
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]              # the first other character after a letter stays, as a space
        x = np.concatenate([[32], np.where(is_letter, c, 32)[keep], [32]])
        if x[1] == 32:
            x = x[1:]
        if len(x) > 1 and x[-2] == 32:
            x = x[:-1]
        one = x[x != 32]
        two = (x[:-1] << _BITS) | x[1:] | (1 << 62)
        three = (x[:-2] << (2 * _BITS)) ^ (x[1:-1] << _BITS) ^ x[2:] ^ np.int64(-(1 << 63))
        grams, counts = _counted(np.concatenate([one, two, three]))
        if most is not None and len(counts) > most:
            floor = np.partition(counts, len(counts) - most)[len(counts) - most]
            some = counts >= floor
            grams, counts = grams[some], counts[some]
        order = np.lexsort((grams, -counts))[:most]
        yield grams[order], counts[order]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.concatenate([at, [len(s)]]))


def _runs(col: pa.Array) -> Iterator[list[str]]:
    """Texts in runs of about CHARS_AT_ONCE characters."""
    run: list[str] = []
    size = 0
    for t in col:
        t = t.as_py() or ""
        run.append(t)
        size += len(t)
        if size >= CHARS_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


@dataclass
class Profiles:
    """The languages that have each n-gram in their profile, and its rank there:
    n-gram i has the entries first[i] .. first[i + 1] - 1."""

    langs: list[str]
    grams: np.ndarray           # sorted
    first: np.ndarray
    lang: np.ndarray            # index into langs, per entry
    rank: np.ndarray

    def distances(self, doc: np.ndarray) -> np.ndarray:
        """Sum over the document's n-grams of how far each is out of its place
        in a language's profile; one that is not there counts PROFILE."""
        at = np.searchsorted(self.grams, doc)
        at[at == len(self.grams)] = 0
        place = np.flatnonzero(self.grams[at] == doc) if len(self.grams) else np.zeros(0, np.int64)
        at = at[place]
        size = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        near = PROFILE - np.minimum(np.abs(self.rank[entry] - np.repeat(place, size)), PROFILE)
        saved = np.bincount(self.lang[entry], near, len(self.langs)).astype(np.int64)
        return PROFILE * len(doc) - saved


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_train: int = MAX_TRAIN, profile: int = PROFILE) -> Profiles:
    """Profiles of the labels of documents that satisfy ``may_learn`` (a
    condition on the columns ``id`` and ``lang``) and have a label.

    Of each language about ``max_train`` documents are counted, chosen by a
    hash of text and id without a shuffle of texts; whole texts are counted.
    Ties of frequency go by the n-gram's code.  Every label has a profile;
    the model, which is broadcast, takes some ten kilobytes a label.
    """
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("lang").isNotNull()).where(may_learn)
    counts = materialize(own.groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")), "labels")     # one row a label
    place = F.pmod(F.xxhash64("text", "id"), F.lit(1 << 40)) / float(1 << 40)
    sample = own.join(counts, "lang").where(place < max_train / F.col("_docs")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, at = b.column(0).to_pylist(), 0
            for run in _runs(b.column(1)):
                by: dict[str, list] = {}
                for lang, (g, n) in zip(langs[at:at + len(run)], ngram_profiles(run, None)):
                    by.setdefault(lang, []).append((g, n))
                at += len(run)
                for lang, parts in by.items():
                    g, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(inv, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)],
                                                     names=["lang", "gram", "n"])

    ranked = (sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1)
              .where(F.col("rank") < profile).select("lang", "gram", "rank").toPandas())
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    col = {lang: i for i, lang in enumerate(langs)}
    entry, lang = ranked["gram"].to_numpy(np.int64), np.array([col[x] for x in ranked["lang"]], np.int64)
    order = np.lexsort((lang, entry))
    grams, first = np.unique(entry[order], return_index=True)
    return Profiles(langs, grams, np.append(first, len(entry)), lang[order], ranked["rank"].to_numpy(np.int64)[order])


def _predict_udf(shared):
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict_texts(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for col in cols:
            langs, scores = [], []
            for run in _runs(col):
                for grams, _ in ngram_profiles(run):
                    if not len(grams) or not model.langs:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    d = model.distances(grams)
                    best = int(np.argmin(d))
                    langs.append(model.langs[best])
                    scores.append(1.0 - float(d[best]) / (PROFILE * len(grams)))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["lang_pred", "score"])
    return predict_texts


def identify(docs: DataFrame, model: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are
    replaced): the language whose profile is nearest, the first by name of
    equally near ones, and one minus its distance over the greatest possible.

    A null or letterless text, or a model without languages, gives ``und``
    and 0.  The whole text is read and only the text: a projection, nothing
    is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn("_kf_lang", _predict_udf(shared)(text_col))
    return out.withColumns({"lang_pred": F.col("_kf_lang.lang_pred"),
                            "score": F.col("_kf_lang.score")}).drop("_kf_lang")
