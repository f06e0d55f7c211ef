"""Operators against plain Python over small hand-made and generated frames."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kelasflow.llm import (chat_format, decontamination, exact_dedup, language_id, mixing, near_dup, pii, quality,
                           url_filter)
from kelasflow.llm.common import table
from tests.conftest import SF001

LONG = "kata " * 30_000


def frame(spark, texts, **extra):
    """doc_id, text and columns whose names clash with what operators add."""
    rows = [(i, t, "en", "s", 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep_id long, "
                                       "score long, items string")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


# ------------------------------------------------------------------ op6
TEXTS = ["Abc", "aBC", None, "", "ÉCOLE", "école", "abc", "x\ny", LONG, LONG.upper(), "abc "]


@pytest.mark.parametrize("keep,best", [("max", max), ("min", min)])
def test_exact_dedup_equals_brute_force(spark, keep, best):
    docs = frame(spark, TEXTS)
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(lower(t), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, keep=keep).collect()}
    assert len(got) == len(TEXTS)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (best(ids), len(ids), i == best(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    left = exact_dedup.drop_exact_duplicates(docs, keep=keep)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(best(ids) for ids in groups.values())


def test_exact_dedup_compares_bytes_where_hashes_collide(spark):
    docs = frame(spark, ["one", "two", "one"])
    got = exact_dedup.exact_dedup(docs, hash_of=lambda c: F.unhex(F.md5(F.lit("same").cast("binary"))))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(0, 0, 2), (1, 1, 1), (2, 0, 2)]


def test_exact_dedup_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (None, None, 1, True)], key=str)
    assert exact_dedup.drop_exact_duplicates(docs).count() == 2
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs.where("false")).count() == 0


# ----------------------------------------------------------------- op10
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(text, items):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        ws = WORD.findall(lower(t))
        size = min(13, len(ws))
        for k in range(len(ws) - size + 1 if ws else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == ws[k:k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def bench_cases():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "ß1"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(13, 40))) for i in range(8)] + [(8, "Kurz drei  wort"), (9, None), (10, "!! ??"), (11, "solo")]
    texts = [None, "", "solo", "Solo! nicht", "ein KURZ, drei-wort.", LONG]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            source = items[rng.randrange(8)][1].split(" ")
            a = rng.randrange(len(source))
            parts += [say(rng.randint(0, 60)), ", ".join(source[a:a + rng.randint(5, 30)]).upper()]
        texts.append(" ".join(parts))
    return items, texts


@pytest.mark.parametrize("part_bytes", [1 << 20, 400])
def test_contamination_equals_brute_force(spark, part_bytes):
    items, texts = bench_cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(frame(spark, texts), bench, part_bytes=part_bytes).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == contaminated(t, items), i


def test_contaminated_documents_and_spans_go(spark):
    items, texts = bench_cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    want = {i for i, t in enumerate(texts) if not contaminated(t, items)[3]}
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want
    cut = {r.doc_id: r.text for r in decontamination.cut_spans(docs, bench).collect()}
    for i, t in enumerate(texts):
        before, after = contaminated(t, items), WORD.findall(lower(cut[i]))
        assert len(after) == before[0] - before[1]
        if t is not None and not before[1]:
            assert cut[i] == t
    assert decontamination.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.contamination(docs.where("false"), bench).count() == 0


# ------------------------------------------------------------------ op5
def shingles(text):
    ws = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def components(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_cases(seed, n, edits):
    """Families of edited copies, a passage that many texts share, and edge cases."""
    rng = random.Random(seed)
    say = lambda k: [f"t{rng.randrange(4000)}" for _ in range(k)]
    passage = say(60)
    texts = [None, "", " \n ", "a b", "A  b", "a b c", "a b c d e", "A B C D E", LONG, LONG]
    for _ in range(n):
        base = say(rng.randint(5, 150))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(50)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("seed,n,edits", [(1, 60, 3), (2, 25, 8)])
def test_near_duplicates_equal_brute_force(spark, seed, n, edits):
    texts = near_cases(seed, n, edits)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_blocks_and_counters_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "KEYS", 1)
    monkeypatch.setattr(near_dup, "COUNTERS", 4)
    texts = near_cases(3, 20, 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_copies_that_meet_a_foreign_set_are_laid_out_once(spark):
    """20,000 members of one component and one foreign set in a tile: linear rows, and each meets the foreign one."""
    rows = spark.range(20_001).select(F.lit(0).cast("long").alias("tile"), "id", F.lit(100).cast("long").alias("n"),
                                      F.when(F.col("id") < 20_000, 0).otherwise(20_000).cast("long").alias("component"))
    placed = near_dup._placed(rows)
    assert placed.count() <= 3 * 20_001
    cells = placed.groupBy("tile", "band", "i", "j").agg(
        F.collect_set("id").alias("ids"), F.max((F.col("id") == 20_000)).alias("foreign"), F.count(F.lit(1)).alias("m"))
    got = cells.where("foreign").select(F.explode("ids").alias("id")).distinct().count()
    assert got == 20_001
    assert cells.agg(F.max("m")).first()[0] < 2_000


def test_linked_classes_without_a_common_least_hash(spark, monkeypatch):
    """Two groups of near copies that only the crossing search can join: one link per cell joins them."""
    base = [f"w{i}" for i in range(120)]
    near = lambda words, at, tag: " ".join(words[:at] + [tag] + words[at + 1:])
    other = base[:60] + ["x"] + base[61:]
    texts = [near(base, 3, f"a{i}") for i in range(60)] + [near(other, 110, f"b{i}") for i in range(60)]
    monkeypatch.setattr(near_dup, "KEYS", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in components(texts)]


def test_near_duplicates_go_but_one(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (3, "A b c d e f g"), (9, "q"), (None, "x y"), (7, None), (8, "")],
                                 "doc_id long, text string")
    left = near_dup.drop_near_duplicates(docs)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [3, 7, 8, 9, None]
    assert near_dup.near_duplicates(docs.where("false")).count() == 0
    nulls = near_dup.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert [(r.n_shingles, r.component_id) for r in nulls] == [(1, None)]


# ------------------------------------------------------------------ op1
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base_pii(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = [lambda: True, lambda: all(int(x) <= 255 for x in m.group().split(".")),
                    lambda: 14 <= len(d) <= 19 and luhn(d), lambda: 10 <= len(d) <= 15][k]()
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_pii_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "a@b.c_x@y.z.w", "1.2.3.4.5 300.1.2.3 001.02.3.255 1.2.3..4.5.6.7", "é x@y.z ü+49-30-123456789 𝔘 7.8.9.10",
             "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 ++44 20 7946 0958 - +1  ", "9" * 30_000,
             "a" * 100_000 + "@b.c", "+1" + " " * 50_000, "x@y.z " * 2_000, "1.1.1.1 " * 700]
    texts += ["".join(rng.choice("ab.@+-12 05(é") for _ in range(120)) for _ in range(150)]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_pii(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_pii(t), i
    assert pii.find_pii(frame(spark, texts).where("false")).count() == 0


def test_contexts_discover_what_the_base_refuses(spark):
    texts = [f"my mail is u{i}@example.org ok" for i in range(30)]
    texts += ["my mail is boss@localhost ok", "the word boss@localhost ok", "my mail is simple ok", "my mail is p@q.r"]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, texts)).collect()}
    assert [tuple(s) for s in got[30].spans] == [(11, 0, 25)] and not got[30].base
    assert not got[32].spans
    assert all([tuple(s) for s in got[i].base] == base_pii(texts[i]) for i in range(len(texts)))
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got.values())


def test_contexts_discover_grouped_phones_and_cards(spark):
    cards = [c for c in (f"4111 1111 1111 {n:04d}" for n in range(1111, 1400)) if luhn(c.replace(" ", ""))]
    texts = [f"call me +1 (974) 555-{3400 + i} ok" for i in range(20)] + [f"card number {c} ok" for c in cards]
    cases = {"call me (974) 555-3436 ok": (8, 3, 22), "call me 974 555 3436.": (8, 3, 20),
             "call me 555-3436 ok": (8, 3, 16),
             "call me 974 555 3436 (10.0.0.1)": (8, 3, 20), "card number 4111 1111 1111 1112 ok": (12, 2, 31)}
    none = ["the word (974) 555-3436 ok", "call me 12 ok", "call me 97" + "4" * 20, "1 (" + " " * 50_000 + "5) " * 20_000]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, texts + list(cases) + none)).collect()}
    for i, (t, want) in enumerate(cases.items(), len(texts)):
        assert [tuple(s) for s in got[i].spans if s not in got[i].base] == [want], t
        assert [tuple(s) for s in got[i].base] == base_pii(t), t
    assert not any(got[len(texts) + len(cases) + i].spans for i in range(len(none)))


def test_discovered_values_carry_new_contexts(spark):
    texts = [f"my mail is u{i}@example.org ok" for i in range(30)]
    texts += [f"my mail is boss{i}@localhost ok" for i in range(6)] + [f"write to boss{i}@localhost ok" for i in range(6)]
    texts += ["write to guest@localhost ok", "the word guest2@localhost ok"]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(frame(spark, texts)).collect()}
    assert got[42] == [(9, 0, 24)] and not got[43]


# ------------------------------------------------------------------ op2
def test_chats_survive_the_round_trip(spark):
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\\", "\\0", "\\1", "\\2", "é", "\n", " ", "[ROLE x] ", "ok"]
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
            (1, 0, None, None), (2, 0, "we[i]rd\\role", "x"), (3, None, "user", ""), (3, 2, "user", LONG)]
    for c in range(10, 60):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["system", "user", "assistant", "tool", ""]),
                         "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))))
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in made.select("conv_id", "segments", "formatted", "valid", "bad_turn", chat_format.read_back(
        F.col("formatted")).alias("back")).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(b.role, b.text) for b in got[c].back] == [(r, t) for _, r, t in turns], c
        assert [b.loss for b in got[c].back] == [r == "assistant" for _, r, t in turns]
        assert [s.loss for s in got[c].segments] == [r == "assistant" for _, r, t in turns]
        roles = "".join({"system": "s", "user": "u", "assistant": "a"}.get(r, "x") for _, r, _ in turns)
        assert got[c].valid == bool(re.fullmatch("s?(ua)+", roles)), roles
    assert made.where("false").count() == 0


# ------------------------------------------------------------------ op3
def water_fill(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > 2 * sizes[s]]
        if not over:
            return {**{s: left * weight[s] / share for s in open_}, **full}
        for s in over:
            full[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())


def mix_docs(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if rng.random() > 0.05 else None,
             rng.choice(["b", "B", "é", None, "z", "hot", "hot", "hot"])) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("group_rows", [4096, 16])
def test_mix_meets_its_targets(spark, group_rows):
    rows, docs = mix_docs(spark)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    want = water_fill(total)
    got = mixing.mix_plan(docs, group_rows=group_rows).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)       # less than one document
    again = mixing.mix_plan(docs.repartition(7), group_rows=group_rows).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_takes_documents_as_often_as_planned(spark):
    rows, docs = mix_docs(spark)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    seen = {}
    for r in mixing.mix(docs.withColumn("size", F.lit("clash"))).collect():
        seen.setdefault(r.doc_id, []).append(r.copy_no)
    assert {k: len(v) for k, v in seen.items()} == {k: v for k, v in plan.items() if v}
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in seen.values())
    assert mixing.mix_plan(docs.where("false")).count() == 0 and mixing.mix(docs.where("false")).count() == 0


def test_pivotal_rounding_keeps_words_and_chances():
    rows = [(i, 1 + i % 9, 0.1 + 0.8 * (i % 7) / 7) for i in range(400)]
    mean = sum(s * p for _, s, p in rows)
    hits = [0] * len(rows)
    for seed in range(200):
        out = list(mixing.round_group(iter(rows), seed))
        assert sum(not done for _, _, done in out) <= 1 and len(out) == len(rows)
        assert sum(rows[k][1] * p for k, p, _ in out) == pytest.approx(mean)
        for k, p, _ in out:
            hits[k] += p
    assert max(abs(hits[i] / 200 - rows[i][2]) for i in range(len(rows))) < 0.16


# ------------------------------------------------------------------ op9
def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "nonsense", "http://", "HTTP://EXAMPLE.ORG/es/x?a=1#b", "https://a.example.org/es/", "http://example.org/en/12",
            "http://example.org/en/2", "http://notexample.org/es/", "http://org", "http://org/", "ftp://x.com/fr/1", "http://com/de/",
            "http://x.com?/fr/", "http://x.com/de", "x://y://org/", "http://É.ORG/a", "http://n.net/" + "a" * 50_000]
    got = {r.page_id: r for r in url_filter.judge_urls(
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [r for r in url_filter.RULES
                if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best.name if best else None), u
        assert got[i].verdict == best.verdict if best else got[i].verdict in ("allow", "block")


def test_url_trees_learn_labelled_urls(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    good = [f"https://{word()}.net/{word()}" for _ in range(300)]
    bad = [f"https://{word()}-{word()}.net/{rng.randrange(10**9)}?a=1&b=2&c={rng.randrange(99)}" for _ in range(300)]
    rows = [(u, 0) for u in good] + [(u, 1) for u in bad]
    labelled = spark.createDataFrame(rows[::2], "url string, label int")
    pages = spark.createDataFrame(rows[1::2], "url string, truth int")
    got = url_filter.judge_urls(pages, labelled=labelled).collect()
    assert sum((r.verdict == "block") == bool(r.truth) for r in got) >= 0.97 * len(got)
    one = url_filter.judge_urls(pages, labelled=labelled.where("label = 1"))
    assert one.where("verdict = 'allow'").count() == 0
    assert url_filter.judge_urls(pages, labelled=labelled.where("false")).where("verdict = 'block'").count() == 0


# ---------------------------------------------------------------- op4, op8
def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_of_held_out_documents(spark):
    from kelasflow.llm import queries
    docs = {r.doc_id: r for r in table(spark, SF001, "documents").collect()}
    got = queries.op4_language_id(spark, SF001).collect()
    assert len(got) == len(docs) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, "der die das und nicht " * 3, "de") for i in range(20)]
                                 + [(i + 20, "the and of that with " * 3, "en") for i in range(20)],
                                 "id long, text string, lang string")
    model = language_id.train(docs, F.lit(True), id_col="id")
    odd = spark.createDataFrame([(None,), ("",), ("12 !?",), ("Und das nicht",), ("with that",), (LONG,)], "text string")
    got = [r.lang_pred for r in language_id.identify(odd.withColumn("score", F.lit(1)), model).collect()]
    assert got[:5] == ["und", "und", "und", "de", "en"] and got[5] in ("de", "en")
    nothing = language_id.train(docs.where("false"), F.lit(True), id_col="id")
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd.where("false"), model).count() == 0


def test_quality_of_held_out_documents(spark):
    from kelasflow.llm import queries
    truth = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = queries.op8_quality(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted for r in held if truth[r.doc_id])


def test_quality_edge_cases(spark):
    docs = frame(spark, [None, "", "!!", LONG, "a b"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    flat = quality.score(docs, quality.train(docs, none, F.lit(True)), name="s").collect()
    assert {round(r.s, 6) for r in flat} == {0.5}
    one = spark.createDataFrame([(3, 1), (3, None), (99, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, one, F.lit(True), epochs=2), name="s").collect()
    assert len(got) == 5 and all(0 <= r.s <= 1 for r in got)
    assert quality.score(docs.where("false"), quality.constant_model(0.5), name="s").count() == 0
