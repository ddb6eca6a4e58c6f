"""Texts cut off by a field limit or in transfer.

Lengths first: of the texts of a source that reach a length, the share that ends just there
is a discrete hazard. A field limit is a length whose hazard stands out from those around
it. Lengths are measured in characters and in bytes, since limits come in both, and tested
per source with control of the false discovery rate.

Endings second: a text that does not close with a full stop, a closing line or another end
its writer meant is compared with all texts. For the longest tail of its words that occurs
elsewhere, it is counted how often a sentence ended there and how often it went on. At a
significant length an ending that is not closed is cut; elsewhere (a transfer stops at any
length) it is cut when sentences go on there. Copies of a cut text are cut as well.

All of it is column expressions: sentences are counted once each whatever number of texts
has them, and only places behind an asked pair of words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialized, shared_dir

#: Lengths on either side that a hazard is compared with.
NEIGHBOURS = 10
#: Share of false discoveries among the lengths taken for limits.
FALSE_DISCOVERY = 0.01
#: An ending counts as incomplete when sentences end there in at most this share of cases.
ENDS_HERE = 0.03
#: Numbers of words (single ideographs count as words) of the tails compared.
ORDERS = (10, 7, 5, 4, 3, 2)
#: A tail must occur this often elsewhere to be judged by; shorter ones are tried otherwise.
LEAST = 2
#: A last line that closes at least this many different texts may be a closing line.
CLOSING = 4
#: It is one when its words end a text in at least this share of the places where they end one or go on.
CLOSES_HERE = 0.5
#: Characters that a closing line has at most, and words looked back for the start of one.
SHORT = 40
#: Words of a sentence handled together.
STRETCH = 200
#: Asked pairs of words that are broadcast at most (8 bytes each); more are joined by hash.
PAIRS = 1_000_000

_WIDE = "぀-ヿ㐀-䶿一-鿿"
_TOKEN = f"[{_WIDE}]|[\\p{{L}}\\p{{M}}\\p{{N}}&&[^{_WIDE}]]+|\n|[^\\s]"
_STOPS = "。.！!？?；;\n"
#: Behind a mark that ends a sentence; dots in a row and between digits end none.
_UNIT = r"(?<=[。！!？?；;\n])|(?<=[.])(?![.0-9])"
_SOFT = r"(?:[…～~]|\.{2,})+$"
#: Remains of a character or escape that was cut in two.
_BROKEN = r"(?:\\u[0-9a-fA-F]{0,3}|\\|(?:%[0-9A-F]{2})*%[0-9A-F]?|(?:%[0-9A-F]{2}){1,5}|&[a-zA-Z]{1,6}|&#[0-9]{0,5}|\x{FFFD})$"
_PAIRS = ("“”", "「」", "『』", "«»", "《》")
_PARTICLES = "啦呀呢吧哦嘛哈"
_BLANK = " \t\n\r\u000b\f\u0085\u00a0\u2007\u202f\u3000"
_START = "\u0001"


def words(c: Column) -> Column:
    """Words of a text in lower case, single ideographs and marks by themselves, numbers as 0."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\p{Nd}+", "0"), F.lit(_TOKEN), F.lit(0))


def bared(text: Column) -> Column:
    """A text without white space and soft marks (dots in a row, waves) at its end; a single
    full stop stays."""
    t = F.rtrim(text, F.lit(_BLANK))
    cut = F.rtrim(t, F.lit(".…～~"))
    mark = F.substring(t, F.length(cut) + 1, F.lit(2))
    return F.when(mark == ".", t).when(mark.startswith(".") & (mark != ".."), F.concat(cut, F.lit("."))).otherwise(F.rtrim(cut, F.lit(_BLANK)))


def last_line(text: Column) -> Column:
    return F.substring_index(F.replace(text, F.lit("\r"), F.lit("\n")), "\n", -1)


def ending(t: Column, bare: Column) -> Column:
    """What the end of a text says by itself, from the text without white space at its end
    and :func:`bared`: ``broken`` (half a character or escape), ``open`` (it stops after a
    comma, an opening mark, an apostrophe, or within a quotation of its last line),
    ``closed``, or ``ask``."""
    line = last_line(t)
    within = (F.length(line) - F.length(F.translate(line, '"', ""))) % 2 == 1
    for a, b in _PAIRS:
        within = within | (F.contains(line, F.lit(a)) & line.rlike(f"{a}[^{b}]*$"))
    end = F.right(bare, F.lit(8))
    return (
        F.when(F.right(t, F.lit(24)).rlike(_BROKEN), F.lit("broken"))
        .when(F.length(bare) == 0, F.lit("closed"))
        .when(within | end.rlike("[,，、：:(（“«「『《<'’‘–-]$|[,，、：:][\"”»'’]*[\"”»]$"), F.lit("open"))
        .when(end.rlike(r"[\p{L}\p{M}\p{N}]$"), F.lit("ask"))
        .otherwise(F.lit("closed"))
    )


def _tail(w: Column, n: int) -> Column:
    """The number of the last ``n`` words, null when there are fewer."""
    return F.when(F.size(w) >= n, F.xxhash64(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n)))


def _stem(w: Column) -> Column:
    """The number of the words of a short line, told from tails of as many words."""
    return F.xxhash64(F.lit("line"), w)


def tails(documents: DataFrame) -> DataFrame:
    """One row per text that shows something: source, lengths, ending and tails to compare.

    ``contexts`` are the numbers of the last words of its last sentence (a mark stands for
    the sentence's start), ``pair`` that of the last two. ``line`` is the last line where it
    is short enough to be a closing line, ``before`` a number of what stands before it,
    ``stem`` the number of its words where they may be a cut line, and ``text_id`` 128 bits
    of the whole text, by which copies are known.
    """
    d = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    d = d.withColumn("_t", F.rtrim("text", F.lit(_BLANK))).withColumn("_bare", bared(F.col("_t"))).withColumn("_last", last_line(F.col("_t")))
    # a closing particle is no part of the sentence it softens
    sentence = F.regexp_replace(F.element_at(F.split(last_line(F.col("_bare")), _UNIT), -1), f"(?<=.)[{_PARTICLES}]$", "")
    d = d.select(
        "doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), ending(F.col("_t"), F.col("_bare")).alias("ending"),
        F.when(F.length("_last") <= SHORT, F.trim("_last")).alias("line"), F.xxhash64(F.substring("_t", F.lit(1), F.length("_t") - F.length("_last"))).alias("before"),
        F.unhex(F.md5("_t")).alias("text_id"), sentence.alias("_s"), F.length("_bare").alias("_n"),
    )
    d = d.withColumn("_w", F.when(F.col("ending") == "ask", F.concat(F.array(F.lit(_START)), words(F.col("_s")))))
    # a text of one word has nothing before it that a cut could be told by
    d = d.withColumn("ending", F.when((F.size("_w") <= 2) & (F.col("_n") - F.length("_s") <= 1), F.lit("closed")).otherwise(F.col("ending")))
    d = d.withColumn("_l", F.when(F.col("ending").isin("ask", "open") & (F.length("line") > 0), words(F.regexp_replace("line", _SOFT, ""))))
    ask, there = F.col("ending") == "ask", F.size("_l") > 0
    return d.select(
        "doc_id", "source", "chars", "bytes", "ending", "line", "before", "text_id",
        F.when(ask, F.array(*[_tail(F.col("_w"), n) for n in ORDERS])).alias("contexts"), F.when(ask, _tail(F.col("_w"), 2)).alias("pair"),
        F.when(there, _stem(F.col("_l"))).alias("stem"), F.when(there, _tail(F.concat(F.array(F.lit(_START)), F.col("_l")), 2)).alias("stem_pair"),
    )


def hazards(lengths: DataFrame, neighbours: int = NEIGHBOURS, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """``source, unit, length, n, at_risk, expected, p, limit`` for every length that occurs.

    ``lengths`` has ``source, unit, length``. The number of texts ending at a length is
    tested against the hazard pooled over the lengths around it, by the Chernoff bound of
    the Poisson tail, which is never smaller than the tail itself. Within a source and unit
    the lengths are ranked by p (Benjamini and Hochberg). The windows run over distinct
    lengths, not over texts.
    """
    n = lengths.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    n = n.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing)))
    near = by.rangeBetween(-neighbours, neighbours)
    # those at risk at every length of the span are about those at risk here, occurring or not
    others = F.sum("n").over(near) - F.col("n")
    n = n.withColumn("expected", F.col("at_risk") * (others + 0.5) / ((F.col("at_risk") + F.col("n")) * (2.0 * neighbours)))
    k, mu = F.col("n").cast("double"), F.col("expected")
    n = n.withColumn("p", F.when(k > mu, F.exp(-(k * F.log(k / mu) - k + mu))).otherwise(F.lit(1.0)))
    ranked = Window.partitionBy("source", "unit").orderBy("p", "length")
    tested = F.count(F.lit(1)).over(Window.partitionBy("source", "unit"))
    n = n.withColumn("rank", F.row_number().over(ranked)).withColumn("passes", F.col("p") <= F.col("rank") / tested * rate)
    last = F.max(F.when(F.col("passes"), F.col("rank"))).over(Window.partitionBy("source", "unit"))
    return n.withColumn("limit", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("rank", "passes")


def sentences(documents: DataFrame) -> DataFrame:
    """``w, n``: the distinct sentences of all texts as words behind a start mark, with the
    number of times they occur. A sentence keeps the mark that ends it; the last one of a
    text has none. Counts combine before the shuffle, so a sentence that a third of all
    texts share is one row of each task."""
    # the outer form, here and below, for the other filters by its argument and so computes it twice
    text = F.replace("text", F.lit("\r"), F.lit("\n"))
    s = documents.where(F.col("text").rlike(r"\S")).select(F.explode_outer(F.split(text, _UNIT)).alias("s")).select(F.trim("s").alias("s")).where(F.length("s") > 1)
    s = s.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    # sentences that differ in numbers and case only are one
    s = s.select(F.array_join(words(F.col("s")), " ").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
    s = s.select(F.concat(F.array(F.lit(_START)), F.split("s", " ")).alias("w"), "n")
    # very long sentences go in stretches, each with the words before it that a place looks back at
    stretch = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("w") - 1) / STRETCH).cast("int")),
        lambda k: F.slice(F.col("w"), F.greatest(k * STRETCH - SHORT, F.lit(0)) + 1, F.when(k > 0, F.lit(STRETCH + SHORT + 3)).otherwise(F.lit(STRETCH + 2))),
    )
    s = s.select("n", F.posexplode_outer(stretch).alias("k", "w")).select("w", F.when(F.col("k") > 0, F.lit(SHORT + 2)).otherwise(F.lit(2)).alias("first"), "n")
    return s.where(F.size("w") > F.col("first"))


def places(sentences_: DataFrame) -> DataFrame:
    """``pair, i, w, n``: every place ``i`` of a sentence that something follows, with the
    number of the pair of words that ends there. Places before a mark that may itself be
    that of a cut say nothing, nor do those behind the end of a sentence."""
    w = F.col("w")
    at = lambda i: F.element_at(w, i)
    # a stretch ends two words behind its last place
    last = F.least(F.size(w) - 1, F.col("first") + STRETCH - 1)
    step = lambda i: F.struct(F.xxhash64(F.slice(w, i - 1, F.lit(2))).alias("pair"), i.alias("i"))
    steps = F.when(last >= F.col("first"), F.transform(F.sequence("first", last), step))
    p = sentences_.select("w", "n", F.explode_outer(steps).alias("p")).where("p IS NOT NULL").select("p.pair", "p.i", "w", "n")
    after, then = at(F.col("i") + 1), F.coalesce(F.try_element_at(w, F.col("i") + 2), F.lit(""))
    return p.where(~at(F.col("i")).isin(*_STOPS) & ~after.isin("…", "～", "~") & ~((after == ".") & (then == ".")))


def compared(places_: DataFrame) -> DataFrame:
    """``numbers, n, ended`` of places: the numbers of the tails that end there (behind a
    word) and of the lines it may be the end of, counted from the start of the sentence and
    of the clause; ``ended``: a sentence ended there, be it behind a particle."""
    w, i = F.col("w"), F.col("i")
    at = lambda k: F.element_at(w, k)
    letter = r"^[\p{L}\p{N}]"
    marks = F.filter(F.sequence(F.greatest(i - SHORT, F.lit(1)), i), lambda k: (k < i) & ~at(k).rlike(letter))
    p = places_.withColumn("_from", F.coalesce(F.array_max(marks), F.greatest(i - SHORT, F.lit(1)))).withColumn("_word", at(i).rlike(letter))
    orders = F.filter(F.array(*map(F.lit, ORDERS)), lambda n: (n <= i) & F.col("_word"))
    tails_ = F.transform(orders, lambda n: F.xxhash64(F.slice(w, i - n + 1, n)))
    whole = F.when((i - 1 <= SHORT) & (at(F.lit(1)) == _START), _stem(F.slice(w, F.lit(2), i - 1)))
    clause = _stem(F.slice(w, F.col("_from") + 1, i - F.col("_from")))
    particle = at(i + 1).isin(*_PARTICLES) & F.coalesce(F.try_element_at(w, i + 2).isin(*_STOPS), F.lit(True))
    return p.select(F.concat(tails_, F.array_distinct(F.array_compact(F.array(whole, clause)))).alias("numbers"), "n", (at(i + 1).isin(*_STOPS) | particle).alias("ended"))


def ending_statistics(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """``context, n, ended`` over all texts, of the tails and lines whose last two words are
    among ``asked`` (column ``pair``).

    Places meet the asked pairs in a join on a number: by broadcast where those are counted
    and few. Otherwise they are joined by hash without their words, which are joined back to
    what passes. Only that is compared.
    """
    asked = asked.select("pair").where("pair IS NOT NULL").distinct()
    s = sentences(documents)
    if asked.count() <= PAIRS:
        hit = places(s).join(F.broadcast(asked), "pair", "left_semi")
    else:
        s = materialized(s)
        passing = places(s).select("pair", "i", F.xxhash64("w").alias("id")).distinct()
        hit = passing.join(asked, "pair", "left_semi").join(s.withColumn("id", F.xxhash64("w")), "id").select("pair", "i", "w", "n")
    c = compared(hit).select(F.explode_outer("numbers").alias("context"), "n", F.when(F.col("ended"), F.col("n")).otherwise(0).alias("e")).where("context IS NOT NULL")
    return c.groupBy("context").agg(F.sum("n").alias("n"), F.sum("e").alias("ended"))


def judged(documents: DataFrame) -> DataFrame:
    """``doc_id, source, cut, reason`` of every text that shows something.

    Null, empty and blank texts have no row and are never cut; a null source is a source of
    its own (''). Ties and repeated rows are judged alike. Nothing but doc_id, source and
    text is used, so other columns may have any name. ``reason`` is one of 'length limit'
    (an ending that is not closed at a significant length), 'broken character', 'open
    ending', 'sentence goes on' (any length) and 'copy of a cut text'.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    found = tails(documents.select("doc_id", "source", "text"))
    found.write.parquet(f"{folder}/tails")
    t = spark.read.schema(found.schema).parquet(f"{folder}/tails")
    lengths = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])
    # copies of one text end at one length for one reason, and count once
    units = t.select("source", "text_id", F.explode(lengths).alias("l")).select("source", "text_id", "l.*").distinct()
    limits = hazards(units).where("limit").select("source", "unit", "length")
    by_chars = limits.where("unit = 'chars'").select("source", F.col("length").alias("chars"), F.lit(True).alias("at_chars"))
    by_bytes = limits.where("unit = 'bytes'").select("source", F.col("length").alias("bytes"), F.lit(True).alias("at_bytes"))
    asked = t.where("ending = 'ask'")
    closing = t.where("stem IS NOT NULL").select("stem", "stem_pair", "before").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("closes"), F.first("stem_pair").alias("pair")).where(F.col("closes") >= CLOSING)
    counts = ending_statistics(documents, asked.select("pair").unionByName(closing.select("pair")))
    wanted = asked.select(F.explode("contexts").alias("context")).unionByName(closing.select(F.col("stem").alias("context"))).where("context IS NOT NULL").distinct()
    counts = counts.join(wanted, "context", "left_semi")
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    # cut fragments come again too, but their words go on elsewhere; those of a closing line hardly do
    closing = (
        closing.join(counts.select(F.col("context").alias("stem"), (F.col("n") - F.col("ended")).alias("on")), "stem", "left")
        .where(F.col("closes") >= CLOSES_HERE * (F.col("closes") + F.coalesce("on", F.lit(0))))
        .select("stem", "closes")
    )
    contexts = asked.select("text_id", "contexts").distinct().select("text_id", F.posexplode("contexts").alias("k", "context")).where("context IS NOT NULL")
    seen = (
        contexts.join(counts, "context")
        .where(F.col("n") >= LEAST)
        .groupBy("text_id")
        .agg(F.min_by(F.struct("n", "ended"), "k").alias("best"))
    )
    rows = (
        t.drop("contexts").join(by_chars, ["source", "chars"], "left")
        .join(by_bytes, ["source", "bytes"], "left")
        .join(closing, "stem", "left")
        .join(seen, "text_id", "left")
    )
    at_limit = F.coalesce("at_chars", "at_bytes", F.lit(False))
    goes_on = F.col("best").isNull() | (F.col("best.ended") <= F.col("best.n") * ENDS_HERE)
    reason = (
        F.when((F.col("ending") == "closed") | ((F.col("ending") != "broken") & F.col("closes").isNotNull()), F.lit(None).cast("string"))
        .when(at_limit, F.lit("length limit"))
        .when(F.col("ending") == "broken", F.lit("broken character"))
        .when(F.col("ending") == "open", F.lit("open ending"))
        .when(goes_on, F.lit("sentence goes on"))
    )
    rows = rows.select("doc_id", "source", "text_id", reason.alias("reason"))
    copies = rows.where("reason IS NOT NULL").select("text_id").distinct().withColumn("copied", F.lit(True))
    return rows.join(copies, "text_id", "left").select(
        "doc_id", "source",
        (F.col("reason").isNotNull() | F.coalesce("copied", F.lit(False))).alias("cut"),
        F.coalesce("reason", F.when(F.col("copied"), F.lit("copy of a cut text"))).alias("reason"),
    )


def shares(verdicts: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, those cut at a significant length, those whose ending
    alone tells, and the share cut."""
    at_limit = F.col("reason") == "length limit"
    return verdicts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), F.count_if(at_limit).alias("n_at_limit"), F.count_if(F.col("cut") & ~at_limit).alias("n_by_ending"),
        F.round(F.avg(F.col("cut").cast("double")), 6).alias("share_cut"),
    )
