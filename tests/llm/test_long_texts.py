"""Long runs that patterns find hard; ties; distances by hand."""

import numpy as np
from pyspark.sql import functions as F

from kelasflow.llm import chat_format, language_id, pii



def test_pii_reads_long_runs_of_numbers_and_dots(spark):
    """Texts on which a recursive pattern overflows the stack."""
    texts = ["1." * 10_000, "0" * 10_000 + ".1.1.999"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in pii.find_pii(docs).select("doc_id", F.size("base").alias("n")).collect()}
    assert got == {0: 2_500, 1: 0}


def test_turns_of_equal_number_go_by_the_raw_text(spark):
    rows = [(1, 0, "user", "<b"), (1, 0, "user", "=a"), (1, 0, "user", "[c"), (1, 0, "user", "\\d"), (1, 0, "user", "Ze")]
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    back = made.select(chat_format.read_back(F.col("formatted")).alias("b")).first().b
    assert [t.text for t in back] == sorted(t for *_, t in rows)


def test_distances_equal_a_walk_over_both_profiles():
    r = np.random.default_rng(3)
    langs = [f"l{i:04d}" for i in range(1500)]              # more than any fixed number of labels
    profiles = [r.permutation(900)[:language_id.PROFILE] for _ in langs]
    gram = np.concatenate(profiles)
    lang = np.repeat(np.arange(len(langs)), language_id.PROFILE)
    rank = np.tile(np.arange(language_id.PROFILE), len(langs))
    order = np.lexsort((lang, gram))
    grams, first = np.unique(gram[order], return_index=True)
    model = language_id.Profiles(langs, grams, np.append(first, len(gram)), lang[order], rank[order])
    for size in (0, 1, 50, 300):
        doc = r.permutation(1200)[:size]
        got = model.distances(doc)
        for k in r.integers(0, len(langs), 20):
            place = {g: i for i, g in enumerate(profiles[k].tolist())}
            assert got[k] == sum(min(abs(place[g] - i), language_id.PROFILE) if g in place else language_id.PROFILE
                                 for i, g in enumerate(doc.tolist()))
