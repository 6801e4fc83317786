"""Invariants of the span engine and the span algebra on arbitrary texts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkveil.functions import engine as E
from sparkveil.functions.spans import find, render

PIECES = ["my phone number is ", "my otp is ", "9876543210", "4111 1111 1111 1111", "638291", "ABCDE1234F", "a@b.co", " uh ", ". ", ", and ", "example ", "é🙂", "\n", "card ", "nine eight seven ", "my address is flat 12, lake road ", "shit ", "transaction id TXN99123 ", "ß", "mine is "]
TEXT = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_protection(text):
    out = E.protect(text, ids=True)
    for spans in (out["pii"], out["financial_ids"], [x for x, _ in out["profanity"]]):
        assert all(0 <= x.start < x.end <= len(text) for x in spans)
        assert all(not a.touches(b) for i, a in enumerate(spans) for b in spans[i + 1 :])
    assert all(x.value == text[x.start : x.end].strip() or x.value == text[x.start : x.end] for x in out["pii"])
    assert E.protect(text, ids=True) == out


def test_find_and_render_agree_with_python(spark):
    texts = ["".join(PIECES[i % len(PIECES)] for i in range(k, k + 9)) for k in range(40)] + ["", "🙂1🙂22🙂"]
    pattern = r"(?<!\d)\d{2,}(?!\d)"
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", find(F.col("t"), pattern).alias("s"), render(F.col("t"), find(F.col("t"), pattern), lambda m: F.lit("#")).alias("r")).collect()
    for r in rows:
        text = texts[r.i]
        assert [(x["start"], x["end"], x["value"]) for x in r.s] == [(*m.span(), m[0]) for m in re.finditer(pattern, text, re.ASCII)]
        assert r.r == re.sub(pattern, "#", text, flags=re.ASCII)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_word_errors_are_edits(ref, hyp):
    from sparkveil.operators.evaluation import word_error_rate

    n = word_error_rate(" ".join(ref), " ".join(hyp)) * max(1, len(ref))
    assert abs(len(ref) - len(hyp)) - 1e-9 <= n <= max(len(ref), len(hyp)) + 1e-9 and (n < 0.5) == (ref == hyp)
