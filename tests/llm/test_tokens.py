import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.llm import tokens as T

from ..conftest import DATA


@pytest.fixture(scope="module")
def vocabulary():
    return T.Vocabulary(T.vocabulary_file("byte_bpe_50k"))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_equals_the_library_on_any_text(vocabulary, library):
    @settings(max_examples=500, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet="ab 's't'lle\n\t1好。🙂<|endoftext|>", max_size=80))
    def check(text):
        assert T.encode(vocabulary, text) == library(text)

    check()


def test_long_and_odd_pieces(vocabulary, library):
    for text in ("a" * 5000, " " * 3000 + "x", "好" * 3000, "1" * 999, "\n" * 100, "-" * 700, "🙂" * 200):
        assert T.encode(vocabulary, text) == library(text)


def test_appends_and_edits_are_exact(vocabulary):
    r = random.Random(1)
    again = total = 0
    for _ in range(200):
        e = T.Encoded(vocabulary, "".join(r.choice(["it's ", "word", " ", "好的。", "12", "\n", "  x", "'", "r", "e"]) for _ in range(60)))
        for _ in range(5):
            a = r.randint(0, len(e.text))
            b = min(len(e.text), a + r.choice([0, 0, 2, 9]))
            again += e.replace(a, b, r.choice(["", "e", " it'", "l", "。", "  ", "\n"]))
            again += e.append(r.choice(["", "x", " "]))
            total += len(e.pieces)
            assert e.ids() == T.encode(vocabulary, e.text)
    assert again < total / 3  # only the surroundings of an edit are encoded again


def test_prefixes_grow(vocabulary, library):
    p = T.Prefixes(vocabulary)
    for part in (b"inter", b"nation", b"al", b"isation"):
        p.append(part)
        assert list(p.ids()) == library(p.data.decode())
    assert list(p.ids(5)) == library("inter")


def test_ids_of_a_table(spark, library):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "好" * 30000), (1, "hello world"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted(((r["doc_id"], list(r["ids"])) for r in T.token_ids(df).collect()), key=str)
    assert got == sorted([(1, library("hello world")), (1, library("hello world")), (2, []), (3, []), (4, library("好" * 30000)), (None, library("x"))], key=str)
    assert T.token_ids(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in T.token_counts(df.where("doc_id > 1")).collect()} == {2: 0, 3: 0, 4: len(library("好" * 30000))}


def test_whole_corpus_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in docs.join(T.token_ids(docs), "doc_id").collect():
        assert list(r["ids"]) == library(r["text"] or "")
