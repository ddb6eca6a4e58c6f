import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import pii, pii_train
from mnemospark.llm.charlstm import N_IDS, TAGS, WINDOW, Tagger, char_ids, spans

SCHEMA = "src_table string, row_id string, text string"


def test_gradients_are_those_of_the_loss():
    t = Tagger.fresh(6, 5)
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, N_IDS, (3, 7)), r.integers(0, len(TAGS), (3, 7))
    _, g = t.loss_and_gradients(ids, tags)
    for k in ("T", "O", "f_U", "b_U", "f_W", "b_b"):
        at = tuple(r.integers(0, s) for s in t.p[k].shape)
        values = []
        for step in (1e-2, -1e-2):
            old = t.p[k][at]
            t.p[k][at] = old + step
            values.append(t.loss_and_gradients(ids, tags)[0])
            t.p[k][at] = old
        assert abs((values[0] - values[1]) / 2e-2 - g[k][at]) < 2e-3


def test_training_lowers_the_loss():
    maker = pii_train.Maker(1)
    rows = []
    for _ in range(150):
        m = maker.email()
        rows.append(pii_train.tagged(f"write to {m} soon", [(9, 9 + len(m), "email")]))
    history = Tagger.fresh(8, 8).fit(rows, epochs=4, batch=30, rate=0.02)
    assert history[-1] < history[0] / 3


def test_held_out_accuracy():
    """New mentions of each type in sentences of the test's own."""
    maker = pii_train.Maker(99)
    frames = {
        "email": ["send it to {} tomorrow", "新邮箱：{}。"], "phone": ["call me on {} after six", "我换号了，{}"], "id_number": ["my document number is {}", "身份证是{}。"],
        "address": ["I moved to {} last week", "快递寄{}，谢谢"], "name": ["my landlord is {} now", "房东叫{}。"],
    }
    model = Tagger.load(pii.MODEL)
    right = wrong = 0
    for kind, fs in frames.items():
        for f in fs:
            for _ in range(40):
                text = f.format(maker.make(kind, "路" if "一" <= f[0] <= "鿿" else "Road"))
                right += {k for _, _, k in pii.find([text], model)[0]} == {kind}
                wrong += 1
    assert right / wrong > 0.9


# names and streets that no list of the training has
GIVEN = "Aaliyah Bjorn Chidi Dagmar Eoin Fatima Gunnar Hiroshi Ingrid Joaquin Katarzyna Leila Mandla Niamh Olamide Priya Quentin Rosalind Siobhan Tomasz Ulrike Vikram Wojciech Ximena Yusuf Zainab".split()
FAMILY = "Abernathy Bergqvist Castellanos Delacroix Eriksson Fitzgerald Gunawardena Hashimoto Jankowski Kowalczyk Lindqvist Mbeki Nakamura Okonkwo Papadopoulos Quintero Rosenthal Szymanski Thornbury Underhill Villanueva Yamamoto Zielinski".split()
STREETS = ["{} Abbey Road", "{} Bishopsgate Street", "{} Dunmore Avenue", "{} Eastcheap Lane", "{} Grafton Drive", "{} Jubilee Square", "Via Verdi {}", "Rue Lafayette {}", "Calle Alcalá {}", "Lindenallee {}"]


def test_unseen_vocabulary():
    """Recall of names and addresses whose words the training never had, in sentences of the test's own."""
    held = {*GIVEN, *FAMILY}
    assert not held & {*pii_train.GIVEN, *pii_train.MORE_GIVEN, *pii_train.MORE_FAMILY}
    r = random.Random(5)
    model = Tagger.load(pii.MODEL)

    def name():
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        return r.choice([f"{g} {f}", f"{g} {f}", f"{g} {r.choice('ABCDE')}. {f}", f"{g} {r.choice(GIVEN)} {f}", f"{g} {f} {r.choice(FAMILY)}"])

    frames = {"name": ["We invited {} to dinner", "{} wrote to me last night", "Yesterday {} came by with cake", "ask for {} at the desk"], "address": ["the parcel went to {} again", "our office: {}", "come to {} tonight"]}
    for kind, fs in frames.items():
        right = total = 0
        for f in fs:
            for _ in range(60):
                text = f.format(name() if kind == "name" else r.choice(STREETS).format(r.randint(1, 300)))
                right += kind in {k for *_, k in pii.find([text], model)[0]}
                total += 1
        assert right / total >= 0.9, kind


def test_mentions_that_cross_a_full_stop_or_have_many_words():
    model = Tagger.load(pii.MODEL)
    for text, mention, kind in [
        ("I met Anna Smith yesterday", "Anna Smith", "name"), ("Call Mary Q. Johnson now", "Mary Q. Johnson", "name"), ("Juan Carlos Garcia Lopez", "Juan Carlos Garcia Lopez", "name"),
        ("Via Roma 12, Turin", "Via Roma 12, Turin", "address"), ("12 Mill St. Apt 4", "12 Mill St. Apt 4", "address"),
    ]:
        assert [(text[a:b], k) for a, b, k in pii.find([text], model)[0]] == [(mention, kind)]


def test_plain_text_has_none():
    model = Tagger.load(pii.MODEL)
    plain = ["The shop at Copperleaf Lane had closed.", "订单号75490160157720，还没发货", "update to pkg@9.35.0", "bus 42 stops near Gull Terrace", "the ISBN is 978-9-45002881", "", " ", "I had coffee with Kasimir E.", "Please call Dr. Johnson tomorrow"]
    assert [pii.find([p], model)[0] for p in plain] == [[]] * len(plain)


def test_windows_of_long_texts_agree_with_short_ones():
    model = Tagger.load(pii.MODEL)
    filler = "Nobody knew that the baker fixed the gate, and we counted the tomatoes, "
    text = filler * 5 + "my new mail is ines.osklow@example.org, " + filler * 5
    (found,) = pii.find([text], model)
    assert len(text) > 3 * WINDOW and [k for *_, k in found] == ["email"]
    a, b, _ = found[0]
    assert text[a:b] == "ines.osklow@example.org"


def test_shortcut_of_the_search_changes_nothing():
    model = Tagger.load(pii.MODEL)
    r = np.random.default_rng(3)
    scores = r.normal(0, 6, (200, 12, len(TAGS))).astype(np.float32)
    scores[:100, :, 0] += 25
    assert (model.viterbi(scores) == model._search(scores)).all()


def test_normal_form_keeps_places():
    raw = "ｃall​  me é ﬁx"
    text, place = pii.normalised(raw)
    assert text == "call me é fix" and len(place) == len(text)
    assert [raw[i] for i in place[:4]] == ["ｃ", "a", "l", "l"]


def test_spans_close_where_the_type_changes():
    tags = np.array([0, TAGS.index("B-name"), TAGS.index("I-name"), TAGS.index("I-email"), 0])
    assert spans(tags) == [(1, 3, "name"), (3, 4, "email")]
    assert char_ids("a好").tolist() == [66, 96 + ord("好") % 800]


@pytest.fixture
def texts(spark):
    long = "We counted the tomatoes. " * 4000 + "my full name is Nora Wickdale, don't laugh."
    rows = [
        ("originals", "a", "my new mail is ines.osklow@example.org, same password hint. The gate is fixed."), ("originals", "a", "my new mail is ines.osklow@example.org, same password hint. The gate is fixed."),
        ("originals", "b", None), ("originals", "c", ""), ("originals", "d", "nothing here"), ("episodes", "a", "我换号了，15403637292。房东叫顾桐舟。"), (None, None, "call 0408-5862815"), ("originals", "e", long),
        ("originals", "f", "新邮箱：ＯＳＫＡＲ０８８@ＥＸＡＭＰＬＥ．ＣＯＭ"),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit("clash")).withColumn("h", F.lit(1))


def test_found(texts):
    got = sorted(map(tuple, pii.found(texts).collect()))
    assert got == sorted([("originals", "a", "email"), ("episodes", "a", "phone"), ("episodes", "a", "name"), ("originals", "e", "name"), ("originals", "f", "email")])
    assert pii.found(texts.limit(0)).count() == 0


def test_redacted(texts):
    rows = [(r["row_id"], r["text"]) for r in pii.redacted(texts).collect()]
    assert len(rows) == texts.count()
    got = dict(rows)
    assert got["a"] in ("my new mail is [EMAIL], same password hint. The gate is fixed.", "我换号了，[PHONE]。房东叫[NAME]。")
    assert got["b"] is None and got["c"] == "" and got["d"] == "nothing here" and got["f"] == "新邮箱：[EMAIL]"
    assert got["e"].endswith("my full name is [NAME], don't laugh.") and got["e"].count("tomatoes") == 4000


def test_segments_tile():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["a.", " ", "。", "x", "\n", "！", "3.5"]) for _ in range(30))
        assert "".join(pii.segments(t)) == t


def test_names_with_initials():
    """A name is not cut behind its initial, and is found and masked whole."""
    model = Tagger.load(pii.MODEL)
    for text, name in [("my landlord is Silvan E. Haxcastle", "Silvan E. Haxcastle"), ("signed: Kasimir M. Thorncastle", "Kasimir M. Thorncastle"), ("房东叫Nora R. Draymont", "Nora R. Draymont")]:
        (segment,) = pii.segments(text)
        assert [(segment[a:b], k) for a, b, k in pii.find([segment], model)[0]] == [(name, "name")]
    assert pii.segments("We met. Dr. Lark came.\n好。") == ["We met. Dr. Lark came.\n", "好。"]
    assert pii.plausible("name", "Nora van der Haxcastle") and not pii.plausible("name", "Nora S.")


def test_scores_and_paths_equal_the_plain_sums_however_rows_are_cut():
    """The network by blocks of rows gives the scores of each row alone; the search finds a best path."""
    from mnemospark.llm import charlstm

    m = charlstm.Tagger.load(pii.MODEL)
    r = np.random.default_rng(5)
    ids = r.integers(1, 95, (charlstm.ROWS + 40, 30)).astype(np.int32)
    s = m.emissions(ids)
    assert s.shape == (len(ids), 30, len(charlstm.TAGS))
    for i in (0, charlstm.ROWS - 1, charlstm.ROWS, len(ids) - 1):
        assert np.allclose(s[i], m.emissions(ids[i : i + 1])[0], atol=1e-4)
    tags = m._search(s[:50] + r.normal(0, 5, s[:50].shape).astype(np.float32))
    assert tags.shape == (50, 30) and m.emissions(ids[:0]).shape[0] == 0
    x = r.normal(0, 3, (20, 4, len(charlstm.TAGS))).astype(np.float32)
    T, K = m.p["T"], len(charlstm.TAGS)
    for row, got in zip(x, m._search(x)):
        paths = np.stack(np.meshgrid(*[np.arange(K)] * 4, indexing="ij"), -1).reshape(-1, 4)
        value = sum(row[t][paths[:, t]] for t in range(4)) + sum(T[paths[:, t - 1], paths[:, t]] for t in range(1, 4))
        assert value[(paths == got).all(1)][0] >= value.max() - 1e-4
