"""Chat formatting: a role automaton and a declarative template, in Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers around the turns of each role, and the roles whose text is learned.

    ``other`` marks turns of any other role; its opening marker carries the
    role's name.  Every marker starts or ends with one of ``guards``; a text
    never contains these raw, so no text can look like a marker.
    """

    markers: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    guards: str = "<[]"
    escape: str = "\\"
    # state -> role -> next state; a conversation is valid if it ends in `final`
    moves: dict[str, dict[str, str]] = field(default_factory=dict)
    start: str = "start"
    final: frozenset[str] = frozenset()


INSTRUCT = Template(
    markers={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")},
    other=("[ROLE ", "] ", " [/ROLE]"),
    loss=frozenset({"assistant"}),
    moves={"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"},
           "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    final=frozenset({"answered"}),
)


def escape(text: Column, t: Template = INSTRUCT) -> Column:
    """Every guard and every escape character becomes the escape character and
    a digit of its own; undone by :func:`unescape`."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "0"))
    return reduce(lambda c, ig: F.replace(c, F.lit(ig[1]), F.lit(f"{t.escape}{ig[0]}")), enumerate(t.guards, 1), out)


def unescape(text: Column, t: Template = INSTRUCT) -> Column:
    # after an escape character there is always a digit, so the order is free but for the last step
    out = reduce(lambda c, ig: F.replace(c, F.lit(f"{t.escape}{ig[0]}"), F.lit(ig[1])), enumerate(t.guards, 1), text)
    return F.replace(out, F.lit(t.escape + "0"), F.lit(t.escape))


def _opening(role: Column, t: Template) -> Column:
    out = F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.other[1]))
    return reduce(lambda c, m: F.when(role == m[0], F.lit(m[1][0])).otherwise(c), t.markers.items(), out)


def _closing(role: Column, t: Template) -> Column:
    return reduce(lambda c, m: F.when(role == m[0], F.lit(m[1][1])).otherwise(c), t.markers.items(),
                  F.lit(t.other[2]))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "\n" else c for c in s)


def _walk(roles: Column, t: Template) -> Column:
    """struct(state, bad): where the automaton stands at the end, and the
    place (from 1) of the first turn it refused; after a refusal it stays."""
    def move(acc: Column, role: Column) -> Column:
        to = F.lit(None).cast("string")
        for state, by_role in t.moves.items():
            for r, nxt in by_role.items():
                to = F.when((acc["state"] == state) & (role == r), nxt).otherwise(to)
        ok = acc["bad"].isNull() & to.isNotNull()
        return F.struct(F.when(ok, to).otherwise(acc["state"]).alias("state"),
                        F.when(ok | acc["bad"].isNotNull(), acc["bad"]).otherwise(acc["n"] + 1).alias("bad"),
                        (acc["n"] + 1).alias("n"))
    first = F.struct(F.lit(t.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    return F.aggregate(roles, first, move)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: its id, segments, formatted, valid, bad_turn.

    ``segments`` has one struct(role, opening, text, closing, loss) per turn
    in turn order, ``text`` escaped; ``formatted`` is all of them written one
    after another.  The markers of a segment never carry loss.  ``valid``
    says whether the automaton accepted the order of the roles, ``bad_turn``
    the place of the first turn that it refused (null if none; a conversation
    that only stops too early has none).  Conversations are formatted either
    way.  A null text or role is an empty one; turns of equal number go by
    role, then text; repeated rows are turns of their own; a null turn comes
    first; null ids are one conversation.  Turns are put in order by the
    text as it is and then escaped; a conversation is gathered only as the
    one row that it becomes.  An empty table gives no rows; other columns are not read.
    """
    t = template
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # roles without own markers carry their names; the empty name is one, too
    seg = turns.select(
        F.col(conv_col).alias("_c"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("_s"))
    both = seg.groupBy("_c").agg(F.array_sort(F.collect_list("_s")).alias("_t"))
    segments = F.transform("_t", lambda s: F.struct(
        s["role"].alias("role"), _opening(s["role"], t).alias("opening"), escape(s["text"], t).alias("text"),
        _closing(s["role"], t).alias("closing"), s["role"].isin(*t.loss).alias("loss")))
    out = both.select("_c", segments.alias("segments"))
    walked = _walk(F.transform("segments", lambda s: s["role"]), t)
    out = out.select(
        F.col("_c").alias(conv_col), "segments",
        F.array_join(F.transform("segments", lambda s: F.concat(s["opening"], s["text"], s["closing"])), "")
        .alias("formatted"), walked.alias("_w"))
    return out.select(conv_col, "segments", "formatted",
                      (F.col("_w.bad").isNull() & F.col("_w.state").isin(*t.final)).alias("valid"),
                      F.col("_w.bad").alias("bad_turn"))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation: array of struct(role, text, loss)."""
    t = template
    opens = [m[0] for m in t.markers.values()]
    closes = [m[1] for m in t.markers.values()] + [t.other[2]]
    guards = _quoted(t.guards)
    opening = "|".join(map(_quoted, opens)) + f"|{_quoted(t.other[0])}[^{guards}]*{_quoted(t.other[1])}"
    pattern = f"({opening})([^{guards}]*)({'|'.join(map(_quoted, closes))})"
    marks = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))

    def turn(mark: Column, text: Column) -> Column:
        name = mark.substr(F.lit(len(t.other[0]) + 1), F.length(mark) - len(t.other[0]) - len(t.other[1]))
        role = reduce(lambda c, m: F.when(mark == m[1][0], F.lit(m[0])).otherwise(c), t.markers.items(),
                      unescape(name, t))
        return F.struct(role.alias("role"), unescape(text, t).alias("text"), role.isin(*t.loss).alias("loss"))
    return F.zip_with(marks, texts, turn)
