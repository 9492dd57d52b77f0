"""Personal data: base spans against plain patterns, disguises and their offsets."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from redpen.llm import pii
from redpen.llm.queries import op4_pii_deobfuscation

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The contract read literally, with ordinary regular expressions."""
    out = []
    for kind, shape in SHAPES.items():
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = 0
                for i, d in enumerate(reversed(digits)):
                    total += int(d) if i % 2 == 0 else (int(d) * 2 if int(d) < 5 else int(d) * 2 - 9)
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda x: (x[0], list(SHAPES).index(x[1])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123459+-. ()@ab%_é", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


CASES = [
    ("write to jo.doe (at) mail [dot] example dot org now", "email", "jo.doe (at) mail [dot] example dot org"),
    ("ask kim at host dot net today", "email", "kim at host dot net"),
    ("ask kim @ host.net today", "email", "kim @ host.net"),
    ("x ann＠mail．example．com y", "email", "ann＠mail．example．com"),
    ("x аnn@mаil.exаmple.com y", "email", "аnn@mаil.exаmple.com"),
    ("b​ob@ex­ample.com", "email", "b​ob@ex­ample.com"),
    ("call plus four nine one five one two three four five six seven now", "phone", "plus four nine one five one two three four five six seven"),
    ("card ４０４１ 8943 0160 ９７０６ x", None, None),
    ("at １９２.168.1.1 x", "ip", "１９２.168.1.1"),
    ("ip one nine two dot one six eight dot one dot two end", "ip", "one nine two dot one six eight dot one dot two"),
]


@pytest.mark.parametrize("text,kind,part", CASES)
def test_disguises(text, kind, part):
    added = [(k, text[s:e]) for s, k, e, base in pii.all_spans(text) if not base]
    if kind:
        assert (kind, part) in added
    for s, k, e in pii.base_spans(text):
        assert (s, k, e, True) in pii.all_spans(text)


@pytest.mark.parametrize("text", [
    "look at example.com for more", "he sat at home. Then dot com", "un deux trois", "six one", "", "at dot at dot", "no one at all dot",
])
def test_clean_text_stays(text):
    assert pii.all_spans(text) == []


def test_long_runs_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000, "@" * 300_000, "+1" * 100_000, "1." * 100_000, "a@" * 100_000, " at b" * 60_000, "one " * 60_000):
        pii.all_spans(text)


def test_redaction(spark):
    rows = spark.createDataFrame([("a bo@ex.org, kim at host dot net.",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(pii.redacted(F.col("t"))).collect()] == ["a [EMAIL], [EMAIL].", None, ""]


def test_odd_tables(spark):
    cols = "doc_id long, text string, personal string, kind int"
    rows = spark.createDataFrame([(1, None, "x", 1), (1, "", "x", 1), (None, "a@b.c", None, None), (1, "a@b.c", "x", 1), (1, "a@b.c", "x", 1)], cols)
    found = pii.find_pii(rows, "doc_id", "text").collect()
    assert sorted(len(r["personal"]) for r in found) == [0, 0, 1, 1, 1]
    assert pii.find_pii(rows.limit(0), "doc_id", "text").collect() == []


def test_query_against_the_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_pii_deobfuscation(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[1] for x in want) for k in SHAPES]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


HIDDEN_NUMBERS = [
    ("x 192 dot 168 dot 0 dot 1 y", "ip", "192 dot 168 dot 0 dot 1"),
    ("x 192[.]168[.]0[.]1 y", "ip", "192[.]168[.]0[.]1"),
    ("x 192.168 [dot] 0.1 y", "ip", "192.168 [dot] 0.1"),
    ("x one dot one dot one dot one y", "ip", "one dot one dot one dot one"),
    ("eight dot eight dot four dot four", "ip", "eight dot eight dot four dot four"),
    ("300 dot 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
    ("one 10 dot 0 dot 0 dot one nine nine", "ip", "10 dot 0 dot 0 dot one nine nine"),
    ("eight dot eight dot four dot four nine nine", "ip", "eight dot eight dot four dot four nine"),
    ("call plus 49 151 2345 six seven eight now", "phone", "plus 49 151 2345 six seven eight"),
    ("call +49 30 1234567 eight nine now", "phone", "+49 30 1234567 eight nine"),
    ("call plus 49 30 1234567 now", "phone", "plus 49 30 1234567"),
]


@pytest.mark.parametrize("text,kind,part", HIDDEN_NUMBERS)
def test_hidden_numbers(text, kind, part):
    assert (kind, part) in [(k, text[s:e]) for s, k, e, base in pii.all_spans(text) if not base]


@pytest.mark.parametrize("text", ["256 dot 1 dot 1 dot 1", "1 dot 2 dot 3", "in 2010 one of 12", "section 3 point 4", "plus 12 345"])
def test_other_numbers_stay(text):
    assert pii.all_spans(text) == []


def test_runs_of_groups_take_linear_time():
    for text in ("1 dot " * 60_000, "999 dot " * 60_000, "one dot " * 60_000, "one 9." * 60_000, "9" * 300_000 + " dot 1", "7 " * 100_000 + "one 2"):
        pii.all_spans(text)
