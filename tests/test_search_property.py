"""Keyword search semantics against a regex translation of SQL LIKE:
case-insensitive, '%' any run, '_' one character, NULL never matches."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.functions.predicates import ilike_any

text = st.text(alphabet="abAB_% x", max_size=6)


def like(value, keyword):
    if value is None:
        return False
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{keyword}%")
    return re.fullmatch(rx, value, re.IGNORECASE | re.DOTALL) is not None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), text), st.one_of(st.none(), text)), min_size=1, max_size=12), text)
def test_ilike_any_matches_like(spark, values, keyword):
    df = spark.createDataFrame(values, "a string, b string")
    got = [r[0] for r in df.select(ilike_any(["a", "b"], keyword)).collect()]
    assert got == [like(a, keyword) or like(b, keyword) for a, b in values]
