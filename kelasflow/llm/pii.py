"""Personal data: fixed base patterns, and bootstrapped contextual extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelasflow.llm.common import materialize, text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Quantifiers are possessive where what follows cannot
# match what they took, and a match starts at the beginning of its run or
# where the last match ended (\G): the matches are the leftmost ones of the
# plain patterns, found in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a search to be worth its while.
HINT = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BLOCK = 256

# A run of identifier characters with a digit or an @ in it.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9@._%+-]))[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
# The shape that a candidate needs to be taken for a kind that the base missed.
SHAPE = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]++(?:\.[0-9]++){3,}+$",
    "card": r"^[0-9](-?[0-9]){12,18}$",
    "phone": r"^\+?[0-9]([-.]?[0-9]){6,14}$",
}
# Cards and phones are also written in groups: as many digits as the kind can have, with the base's own separators
# between them; longest from the left, and no group of digits is cut.
GROUPED = {
    "card": r"(?<![A-Za-z0-9@_%])[0-9](?:[\x20-]?+[0-9]){12,18}(?![A-Za-z0-9@_%])",
    "phone": (r"(?<![A-Za-z0-9@_%])(?:\((?=\+?[0-9]{1,15}\)))?\+?(?:\((?=[0-9]{1,15}\)))?"
              r"[0-9](?:[\x20().-]*+[0-9]){6,14}(?![A-Za-z0-9@_%])"),
}
GROUPED_HINT = {"card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"[0-9](?:[\x20().-]*+[0-9]){6}"}
GROUPED_DIGITS = {"card": (13, 19), "phone": (7, 15)}
CONTEXT_CHARS = 64
PIECE = 512
ROUNDS = 3
MIN_CONFIDENCE = 0.6
MIN_SEEDS = 3
SMOOTHING = 1.0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is right."""
    from_end = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = from_end.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike("^" + r"\.".join([OCTET] * 4) + "$")
    n = F.length(_digits(s))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def find_all(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, end, value),
    in code points, end exclusive.  The text between matches gives their
    places; they are summed in one pass and gathered in blocks, so thousands
    of matches in a text cost about as much each as one."""
    p = F.lit(pattern)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("value"))
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    nested = F.array().cast("array<array<struct<start:int,end:int,value:string>>>")

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        block = F.array_append(acc["block"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        full = F.size(acc["block"]) >= BLOCK - 1
        return F.struct(end.alias("at"), F.when(full, empty).otherwise(block).alias("block"),
                        F.when(full, F.array_append(acc["done"], block)).otherwise(acc["done"]).alias("done"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("block"), nested.alias("done")), one,
                        lambda acc: F.flatten(F.array_append(acc["done"], acc["block"])))
    wanted = text.rlike(hint) if hint else F.lit(True)
    return F.when(wanted & (F.size(pairs) > 0), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Array of struct(start, rank, end, value) of the base kinds, sorted."""
    def of(rank: int, kind: str) -> Column:
        found = F.filter(find_all(text, BASE[kind], HINT[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                     m["end"].alias("end"), m["value"].alias("value")))
    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(pieces: Column, start: Column) -> Column:
    """The last two words before a place, lower-cased, from a bounded stretch of
    the text, which comes in pieces of PIECE characters."""
    begin = F.greatest(F.lit(0), start - CONTEXT_CHARS)
    at = F.floor(begin / PIECE).cast("int")
    near = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    near = near.substr(begin - at * PIECE + 1, start - begin)
    before = F.split(F.trim(F.regexp_replace(F.lower(near), r"\s+", " ")), " ")
    return F.array_join(F.slice(before, -F.least(F.lit(2), F.size(before)), F.lit(2)), " ")


def _below(values: Column, x: Column) -> Column:
    """How many numbers of a sorted array are less than ``x``, by bisection."""
    first = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        less = F.get(values, mid) < x
        return F.when(acc["lo"] < acc["hi"], F.struct(
            F.when(less, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(less, acc["hi"]).otherwise(mid).alias("hi"))).otherwise(acc)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, first, halve)["lo"]


def _met(taken: list[tuple[Column, Column]], m: Column) -> list[tuple[Column, Column, Column]]:
    """Per kind, with the starts and ends of its spans (sorted, not
    overlapping): whether some overlap ``m``, the first start, the last end."""
    out = []
    for starts, ends in taken:
        lo, hi = _below(ends, m["start"] + 1), _below(starts, m["end"])
        out.append((lo < hi, F.when(lo < hi, F.get(starts, lo)), F.when(lo < hi, F.get(ends, hi - 1))))
    return out


def _grouped(text: Column, kind: str, taken: list[tuple[Column, Column]]) -> Column:
    """Matches of GROUPED, as find_all gives them; of a match that runs into
    ``taken`` spans, what stands before the first and after the last of them."""
    def pieces(m: Column) -> Column:
        met = _met(taken, m)
        first = F.coalesce(F.least(*[a for _, a, _ in met]), m["end"])
        last = F.coalesce(F.greatest(*[b for _, _, b in met]), m["end"])
        head = F.regexp_replace(m["value"].substr(F.lit(1), first - m["start"]), r"(?<![\x20().-])[\x20().-]++$", "")
        tail = F.regexp_replace(m["value"].substr(last - m["start"] + 1, F.greatest(F.lit(0), m["end"] - last)),
                                r"^[\x20).-]+", "")
        return F.array(F.struct(m["start"].alias("start"), (m["start"] + F.length(head)).alias("end"), head.alias("value")),
                       F.struct((m["end"] - F.length(tail)).alias("start"), m["end"].alias("end"), tail.alias("value")))
    found = F.flatten(F.transform(find_all(text, GROUPED[kind], GROUPED_HINT[kind]), pieces))
    return F.filter(found, lambda m: F.length(_digits(m["value"])).between(*GROUPED_DIGITS[kind]))


def contextual_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """rank, context, confidence and support from the pattern-instance graph.

    ``edges`` has one row per (rank, context, value) with ``n`` occurrences
    and ``seed``, whether the base accepts the value.  A seed is worth 1.  A
    pattern's confidence is the mean worth of what stands in it, smoothed
    towards 0; the worth of another instance is that of at least one of its
    patterns being right.  A pattern's support is the worth of its distinct
    values together, so confirmed instances carry new patterns.  ``rounds``
    passes settle all.
    """
    worth = edges.withColumn("worth", F.col("seed").cast("double"))
    for k in range(rounds):
        patterns = worth.groupBy("rank", "context").agg(
            (F.sum(F.col("worth") * F.col("n")) / (F.sum("n") + SMOOTHING)).alias("confidence"),
            F.sum("worth").alias("support"))
        if k == rounds - 1:
            return patterns
        doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))
        instances = (worth.join(patterns, ["rank", "context"]).groupBy("rank", "value")
                     .agg((1 - F.exp(F.sum(doubt))).alias("_new")))
        worth = (edges.join(instances, ["rank", "value"])
                 .withColumn("worth", F.when(F.col("seed"), 1.0).otherwise(F.col("_new"))).drop("_new"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """id, base and spans for every row: arrays of struct(start, rank, end),
    sorted by start, then kind (rank in KINDS); ``spans`` holds the base and
    what its contexts discovered.

    Base matches are leftmost and non-overlapping per kind; those that fail
    their check are dropped without another try.  Each base match is a seed:
    the two words before it make a pattern of its kind.  Candidates are runs
    of identifier characters of a kind's shape that the base did not accept
    and, for cards and phones, groups of digits with the base's separators
    (blanks and brackets among them; digits of neighbouring numbers are
    taken along up to the kind's most).  They are instances of the patterns
    they stand in.  Patterns whose distinct values are worth
    ``min_seeds`` seeds, discovered ones by their worth, and whose
    confidence reaches ``min_confidence`` discover the candidates that stand
    in them and overlap no base span of the document; one within another of
    its kind is not given.  Null texts are empty; rows that repeat an id and its text
    get the same spans each; a null id is an id like others.  An empty table
    gives no rows; other columns are not read.  Texts are read whole.

    What leaves a task are spans and short contexts, never texts.  Counts of
    a frequent context are folded in each task first; joins on it can be
    split by Spark.
    """
    text = text_of(text_col)
    own = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    based = own.withColumn("full", base_spans(F.col("text")))
    # a candidate is kept once for each kind whose shape it has and whose base refused it
    found = find_all(F.col("text"), CANDIDATE, "[0-9@]")

    # starts and ends per kind, in order; the text in pieces, so that a place is found without reading up to it
    def of_rank(i: int) -> Column:
        return F.filter("full", lambda b: b["rank"] == i)

    def of_shape(kind: str) -> Column:
        return F.filter("free", lambda m: m["value"].rlike(SHAPE[kind]))
    based = based.withColumns({f"start{i}": F.transform(of_rank(i), lambda b: b["start"]) for i in range(len(KINDS))})
    based = based.withColumns({f"end{i}": F.transform(of_rank(i), lambda b: b["end"]) for i in range(len(KINDS))})
    taken = [(F.col(f"start{i}"), F.col(f"end{i}")) for i in range(len(KINDS))]
    shaped = F.filter(found, lambda m: reduce(lambda c, k: c | m["value"].rlike(SHAPE[k]), KINDS, F.lit(False)))
    with_free = based.withColumn("free", shaped).withColumn(
        "free", F.filter("free", lambda m: ~reduce(lambda c, x: c | x[0], _met(taken, m), F.lit(False))))
    with_free = with_free.withColumns({f"run_{k}": of_shape(k) for k in KINDS}).withColumns({
        **{f"run_start_{k}": F.transform(f"run_{k}", lambda m: m["start"]) for k in GROUPED},
        **{f"group_{k}": _grouped(F.col("text"), k, taken) for k in GROUPED},
        "pieces": F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))})

    def instances(spans: Column, rank: Column | None, seed: bool) -> Column:
        return F.transform(spans, lambda m: F.struct(
            (m["rank"] if rank is None else rank).alias("rank"), _context(F.col("pieces"), m["start"]).alias("context"),
            m["value"].alias("value"), F.lit(seed).alias("seed"), m["start"].alias("start"), m["end"].alias("end")))

    def refused(rank: int, kind: str) -> Column:
        own = F.col(f"run_{kind}")
        if kind in GROUPED:             # a group of digits that is a run itself is not another instance
            def again(m: Column) -> Column:
                same = F.get(own, _below(F.col(f"run_start_{kind}"), m["start"]))
                return F.coalesce((same["start"] == m["start"]) & (same["end"] == m["end"]), F.lit(False))
            own = F.concat(own, F.filter(f"group_{kind}", lambda m: ~again(m)))
        return instances(own, F.lit(rank), False)
    seeds = instances(F.col("full"), None, True)
    others = F.flatten(F.array(*[refused(i, k) for i, k in enumerate(KINDS)]))
    base = F.transform("full", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"),
                                                  b["end"].alias("end")))
    read = materialize(with_free.select("id", "text_key", base.alias("base"), F.concat(seeds, others).alias("inst")),
                       "pii")
    inst = read.where(F.size("inst") > 0).select("id", "text_key", F.inline("inst"))
    edges = materialize(inst.where("context <> ''").groupBy("rank", "context", "value", "seed")
                        .agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    good = (contextual_patterns(edges, rounds)
            .where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_seeds))
            .select("rank", "context"))
    hits = (inst.where(~F.col("seed")).join(good, ["rank", "context"])
            .select("id", "text_key", "rank", "start", "end").distinct())
    earlier = (Window.partitionBy("id", "text_key", "rank").orderBy("start", F.desc("end"))
               .rowsBetween(Window.unboundedPreceding, -1))
    new = (hits.withColumn("_upto", F.coalesce(F.max("end").over(earlier), F.lit(-1))).where("_upto < end")
           .groupBy("id", "text_key")
           .agg(F.collect_set(F.struct("start", "rank", "end")).alias("more")))
    out = read.select("id", "text_key", "base").alias("r").join(
        new.alias("n"), F.col("r.id").eqNullSafe(F.col("n.id")) & (F.col("r.text_key") == F.col("n.text_key")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return out.select(F.col("r.id").alias(id_col), F.col("r.base").alias("base"),
                      F.array_sort(F.concat("r.base", F.coalesce("n.more", none))).alias("spans"))
