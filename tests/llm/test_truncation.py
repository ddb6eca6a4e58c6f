import math
import random

from pyspark.sql import functions as F

from mnemospark.llm import truncation as T


def test_endings(spark):
    cases = {
        "The gate is fixed.": "closed", "好的。": "closed", "see\\u4e": "broken", "foo%E4%B": "broken", "a&am": "broken", "x�": "broken", "first, ": "open", "她说：": "open", "“没事": "open", "I don'": "open",
        "and then it": "ask", "我想种蚕豆啦": "ask", "…": "closed", "🙂": "closed", "done…": "closed", "one": "closed", "he said \"so": "open", "he did it…": "ask", "\"" + "word " * 100 + "so": "open",
    }
    rows = [(i, "s", k) for i, k in enumerate(cases)]
    got = T.tails(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {rows[r["doc_id"]][2]: r["ending"] for r in got} == cases
    row = spark.createDataFrame([("It was 3.5 km",)], "text string").select(T.words(F.col("text")), T.bared(F.lit("it was… \n"))).first()
    assert list(row) == [["it", "was", "0", ".", "0", "km"], "it was"]


def test_counts_of_places(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The oven is hot. The oven is hot today… Wait"), (2, "The oven is hot."), (3, "the oven is")], "doc_id long, text string")
    hot = spark.range(1).select(F.xxhash64(F.array(F.lit("is"), F.lit("hot"))).alias("pair"))
    got = T.ending_statistics(docs, hot)
    one = lambda *w: spark.range(1).select(F.xxhash64(F.array(*map(F.lit, w)))).first()[0]
    by = {r["context"]: (r["n"], r["ended"]) for r in got.collect()}
    assert by[one("is", "hot")] == by[one("oven", "is", "hot")] == (3, 2) and one("hot", "today") not in by
    monkeypatch.setattr(T, "PAIRS", 0)  # the join by hash gives the same
    assert {r["context"]: (r["n"], r["ended"]) for r in T.ending_statistics(docs, hot).collect()} == by


def test_long_sentences_go_in_stretches(spark, monkeypatch):
    """Every place of a long sentence is compared once, with the words before it."""
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ws = ["\u0001", *text.split()]
    got = [tuple(r) for r in T.places(T.sentences(docs)).select(F.array_join(F.slice("w", F.col("i") - 1, 2), " ")).collect()]
    assert sorted(got) == sorted((" ".join(ws[i - 1 : i + 1]),) for i in range(1, 500))
    want = T.compared(T.places(T.sentences(docs))).select(F.explode("numbers")).count()
    monkeypatch.setattr(T, "STRETCH", 1000)
    assert T.compared(T.places(T.sentences(docs))).select(F.explode("numbers")).count() == want


def test_hazards_find_the_limit(spark):
    r = random.Random(1)
    rows = []
    for _ in range(4000):
        n = int(r.expovariate(1 / 300)) + 1
        rows.append(("cut", "chars", min(n, 280)))
        rows.append(("free", "chars", n))
    got = T.hazards(spark.createDataFrame(rows, "source string, unit string, length int")).where("limit").collect()
    assert {(g["source"], g["length"]) for g in got} == {("cut", 280)}
    g = T.hazards(spark.createDataFrame(rows, "source string, unit string, length int")).where("source = 'cut' AND length = 280").first()
    assert g["n"] == g["at_risk"] == sum(1 for s, _, n in rows if s == "cut" and n == 280) and g["p"] < 1e-6 and math.isfinite(g["p"])


def corpus(seed=2):
    """Texts of sentences, with known cuts: at 120 characters in one source, anywhere in another."""
    r = random.Random(seed)
    who, did, why = ["the baker", "my cousin", "our tutor", "grandma", "the plumber"], ["fixed the gate", "counted the tomatoes", "read two chapters", "missed the tram"], ["the oven runs too hot", "the exam moved forward", "nobody wanted the slot"]
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(f"{r.choice(who).capitalize()} {r.choice(did)} because {r.choice(why)}." for _ in range(r.randint(1, 7)))
        source = r.choice(["limited", "free", "free"])
        roll = r.random()
        if source == "limited" and len(text) > 120:
            text = text[:120]
            if text.rstrip()[-1] != ".":
                cut.add(i)
        elif roll < 0.03:
            at = r.randint(10, len(text) - 2)
            while text[at - 1] in ". ":
                at += 1
            text = text[:at]
            if not any(text.endswith(w) for w in why + did):
                cut.add(i)
            else:
                text += "."
        elif roll < 0.1:
            text += "\nsee you soon"
        elif roll < 0.15:
            text = text[:-1] + "…"
        rows.append((i, source, text))
    return rows, cut


def test_cut_texts_are_found(spark):
    rows, cut = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("same", F.lit("clash")).withColumn("cut", F.lit(False))
    got = {r["doc_id"] for r in T.judged(docs).where("cut").collect()}
    right = len(got & cut)
    assert right / len(cut) > 0.97 and right / len(got) > 0.97 and len(cut) > 100


def test_awkward_rows(spark):
    rows, cut = corpus(3)
    odd = [(9001, None, None), (9002, "s", ""), (9003, "s", " \n"), (9004, None, "Grandma fixed the"), (9004, None, "Grandma fixed the"), (9005, "s", "word " * 30000 + "and the"), (None, "s", "x and the")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, source string, text string")
    verdicts = T.judged(docs).collect()
    by = {}
    for v in verdicts:
        by.setdefault(v["doc_id"], []).append(v["cut"])
    assert not {9001, 9002, 9003, None} & set(by)
    assert by[9004] == [True, True] and len(by[9005]) == 1
    assert sum(map(len, by.values())) == len(rows) + 3
    shares = {r["source"]: r for r in T.shares(T.judged(docs)).collect()}
    assert set(shares) == {"limited", "free", "s", ""} and shares[""]["n_cut"] == 2
    assert T.judged(docs.limit(0)).count() == 0


def test_repeated_fragments_are_no_closing_lines(spark):
    """Fragments that end many texts are cut when their words go on elsewhere; lines that close are not."""
    whole = ["The baker fixed the gate\nI keep the oven blue, even if nobody asks.", "The tram was late\nLumi: I keep the oven blue, even if nobody asks."]
    rows = [(i, "s", f"Note {'abcdefghij'[i % 10] * (1 + i // 10)} was read.\n{whole[i % 2]}") for i in range(200)]
    ends = {"I keep the oven": True, "Lumi": True, "I keep the oven blue,": True, "see you soon": False, "Yours truly,": False}
    for k, end in enumerate(ends):
        rows += [(1000 + 100 * k + i, "s", f"Letter {'abcdefghij'[i]} came {'late ' * i}today.\n{end}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"] for r in T.judged(docs).where("cut").collect()}
    assert got == {1000 + 100 * k + i for k, cut in enumerate(ends.values()) if cut for i in range(8)}
