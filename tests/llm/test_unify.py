import itertools
import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.llm import characters as ch
from mnemospark.llm import unify

ALPHABET = "aeoé好，。 \u00a0\u3000\u200b\u0301\u0308\u0327ｅＡﬁ½\u2f26\uf9baрοΑ\u1100\u1161\u11a8가\t\n…"


def whole(text):
    """The form by normalising everything at once."""
    return re.sub(r"\s+", " ", ch.fold(text)).strip(" ")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=30))
def test_splicing_equals_normalising_all(text):
    assert unify.unify_text(text) == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_of_a_form_is_itself(text):
    once = unify.unify_text(text)
    assert unify.unify_text(once) == once


def test_what_is_the_same_and_what_is_not():
    same = [("ａｂｃ", "abc"), ("cafe\u0301", "café"), ("o\u200bk", "ok"), ("a\u00a0 b", "a b"), ("раураl", "paypal"), ("⼩", "小"), (" x ", "x")]
    other = [("Abc", "abc"), ("café", "cafe"), ("a1", "al"), ("a.", "a,"), ("ab", "a b")]
    assert all(unify.unify_text(a) == unify.unify_text(b) for a, b in same)
    assert all(unify.unify_text(a) != unify.unify_text(b) for a, b in other)
    assert unify.unify_text(None) is None and unify.unify_text("") == "" and unify.unify_text(" \u200b\u3000") == ""


def test_quick_check_passes_only_stable_text(spark):
    r = random.Random(1)
    rows = [("".join(r.choice(ALPHABET + "wort") for _ in range(r.randrange(0, 12))),) for _ in range(400)] + [("好" * 20000 + "ｘ",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", unify.unified("t").alias("u"), unify.quick_check(F.col("t")).alias("q")).collect()
    for g in got:
        if g["t"] is None:
            assert g["u"] is None
            continue
        assert g["u"] == whole(g["t"])
        assert g["q"] or whole(g["t"]) == g["t"]


def test_stable_ranges_hold_no_unstable_character():
    spans = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", ch.java_stable())]
    for a, b in spans:
        for o in range(a, b + 1):
            assert ch.fold(chr(o)) == chr(o) and not unicodedata.combining(chr(o))


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(unify, "BLOCK", 3)
    r = random.Random(2)
    base = ["ok", "café", "好的", "a b"]
    spell = {"ok": ["ok", "ｏk", "o\u200bk", "οk"], "café": ["café", "cafe\u0301"], "好的": ["好的", "好\u200b的"], "a b": ["a b", "a  b", "a\u00a0b"]}
    rows = []
    for i in range(80):
        b = r.choice(base[:1] * 5 + base)
        rows.append((r.choice(["originals", "names"]), f"id{r.randrange(50):02d}", r.choice(spell[b])))
    rows += [("originals", "x", None), ("originals", None, "ok"), ("originals", "y", ""), ("originals", "z", "\u200b "), ("originals", "y", " ")]
    df = spark.createDataFrame(rows + rows[:5], "src_table string, id string, text string").withColumn("form", F.lit("clash")).withColumn("n", F.lit(0))
    want = set()
    for (s, i, t), (s2, j, u) in itertools.product([x for x in rows if x[1] and x[2] and whole(x[2])], repeat=2):
        if s == s2 and i < j and t != u and whole(t) == whole(u):
            want.add((s, i, j))
    got = [tuple(x) for x in unify.look_alikes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert unify.look_alikes(df.limit(0)).count() == 0
