"""Text expressions that stay in the JVM: normal form, terms, phrases, excerpts, quotes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scripts written without spaces (kana, ideographs with extension A and
# compatibility forms, syllables).
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
RUN = f"[{CJK}]+|[0-9a-z]+"

# Fixed values that must equal the reference's, in its order: words that say nothing of a topic.
STOP_WORDS = tuple(
    """
的 了 在 是 我 你 他 她 它 们 这 那 有 和 与 也 都 又 就 但 而 或 到 被 把 让 从 对 为 以 及 等 个 不 没 很 太 吗 呢 吧
啊 嗯 哦 哈 呀 嘛 么 啦 哇 喔 会 能 要 想 去 来 说 做 看 给 上 下 里 中 大 小 多 少 好 还 再 才 只 更 最 真 挺
我们 你们 他们 她们 咱们 自己 什么 怎么 怎样 如何 哪里 哪个 哪儿 为什么 还是 然后 因为 所以 虽然 但是 可以 已经 一个 一些 一下 一点
一起 一样 比较 应该 可能 如果 这个 那个 这些 那些 这样 那样 知道 觉得 感觉 时候 现在 今天 昨天 明天 刚才 刚刚 最近 其实 记得
喜欢 真的 有点 有些 就是 不是 没有 不会 还有 或者 而且 然而 只是 一直 一定 非常 特别 好像 这么 那么 怎么样 东西 事情 意思
原话 原文 当时 具体 措辞 说的 说过 怎么说 那天 那次 一次
早上 上午 中午 下午 晚上 傍晚 半夜 凌晨 今晚 昨晚 明早
""".split()
)
# Single stop words that in a pair often make a word (a novel, a university) and so are no glue.
NOT_GLUE = "说做看上下里中大小多少好"
#: Names of those who talk; they are in every message and say nothing of a topic.
PARTICIPANTS = ("user", "ai")

LONG_WORDS = tuple(w for w in STOP_WORDS if len(w) > 1)
STOP_PAIRS = tuple(sorted({w[i : i + 2] for w in LONG_WORDS for i in range(len(w) - 1)}))
GLUE = "".join(w for w in STOP_WORDS if len(w) == 1 and w not in NOT_GLUE)


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Single characters whose compatibility form is one letter, digit or ideograph."""
    source, target = [], []
    for lo, hi in ((0x2E80, 0x3400), (0xF900, 0xFB00), (0xFF00, 0xFFF0), (0x2070, 0x2190), (0xAA, 0xBB)):
        for o in range(lo, hi):
            c = chr(o)
            n = unicodedata.normalize("NFKC", c).lower()
            if n != c and len(n) == 1 and (n.isascii() or "一" <= n <= "鿿") and n.isalnum():
                source.append(c)
                target.append(n)
    return "".join(source), "".join(target)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(c: Column | str) -> Column:
    """Compatibility form and lower case, as far as terms can tell; null gives empty."""
    a, b = _folds()
    return F.lower(F.translate(F.coalesce(_col(c), F.lit("")), a, b))


def terms(c: Column | str) -> Column:
    """Terms in order with repeats: pairs of neighbours of a CJK run (a run of one is itself),
    and each Latin or digit run."""
    runs = F.regexp_extract_all(normalized(c), F.lit(f"({RUN})"), F.lit(1))
    pairs = lambda r: F.regexp_extract_all(r, F.lit("(?=(..))"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))))


def cjk_characters(c: Column | str) -> Column:
    return F.regexp_extract_all(normalized(c), F.lit(f"([{CJK}])"), F.lit(1))


def query_terms(c: Column | str, most: int | None = 64) -> Column:
    """Distinct terms in order of appearance: the first ``most``, or all."""
    all_ = F.array_distinct(terms(c))
    return all_ if most is None else F.slice(all_, 1, most)


def is_stop(term: Column, participants: tuple[str, ...] = PARTICIPANTS) -> Column:
    """Stop words, pairs inside one, names of participants, terms of glue characters only, and
    single Latin letters and digits."""
    listed = sorted({*STOP_WORDS, *STOP_PAIRS, *(p.lower() for p in participants)})
    return term.isin(*listed) | term.rlike(f"^[{GLUE}]+$") | term.rlike("^[a-z0-9]$")


def seam_terms(c: Column | str) -> Column:
    """Pairs of a text that stand there only because of where its stop words lie: both
    characters inside stop words, or on either side of the edge of one of two and more."""
    long = "(?:" + "|".join(sorted(LONG_WORDS, key=len, reverse=True)) + ")"
    three = "(?:" + "|".join(w for w in LONG_WORDS if len(w) > 2) + ")"
    inside = f"(?:(?=[{GLUE}]|{long})|(?<=(?={long}).)|(?<=(?={three})..))"
    seam = f"(?={inside}.{inside}[{CJK}]|.(?<={long})[{CJK}]|[{CJK}]{long})(?=(..))"
    return F.array_distinct(F.regexp_extract_all(normalized(c), F.lit(seam), F.lit(1)))


def informative(c: Column | str, most: int | None = 64) -> Column:
    """Query terms without stop and seam terms."""
    return F.array_except(F.filter(query_terms(c, most), lambda t: ~is_stop(t)), seam_terms(c))


def keywords(c: Column | str) -> Column:
    """Pieces between spaces and list marks, normalised: all of them where there are several,
    one only if it has at most six characters; none whose terms are all stop terms."""
    pieces = F.filter(F.transform(F.split(_col(c), r"[\s,，、/|;；]+"), normalized), lambda p: F.length(p) > 0)
    topical = lambda p: F.exists(terms(p), lambda t: ~is_stop(t))
    kept = lambda all_: F.filter(all_, lambda p: ((F.size(all_) > 1) | (F.length(p) <= 6)) & topical(p))
    # named by a function of one element, for inside a filter the pieces would be made again for each of them
    return F.array_distinct(F.element_at(F.transform(F.array(pieces), kept), 1))


def single_character(c: Column | str) -> Column:
    """The character of a query that is one term of one ideograph, else null."""
    return F.nullif(F.regexp_extract(normalized(c), f"^[^0-9a-z{CJK}]*([{CJK}])[^0-9a-z{CJK}]*$", 1), F.lit(""))


# Fixed values that must equal the reference's: what asks for the words themselves.
QUOTING = "原话|原文|怎么说的|当时.{0,6}说|说了什么|具体措辞|原封不动|逐字|exact words|verbatim|quote"


def quote_intent(c: Column | str) -> Column:
    return normalized(c).rlike(QUOTING)


def phrase(c: Column | str) -> Column:
    """Normal form without white space, punctuation and symbols."""
    return F.regexp_replace(normalized(c), r"[\s\p{P}\p{S}\p{Z}]+", "")


def excerpt(text: Column, needles: Column, width: int = 120) -> Column:
    """A window of the text around the first place any needle occurs, else its start."""
    at = F.array_min(F.filter(F.transform(needles, lambda n: F.instr(F.lower(text), n)), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - width // 4, F.lit(1))
    cut = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(start + width - 1 < F.length(text), F.lit("…")).otherwise(F.lit("")))


def token_estimate(c: Column | str) -> Column:
    """Wide characters count one token, others 2/7 of one; rounded up."""
    c = F.coalesce(_col(c), F.lit(""))
    wide = F.length(c) - F.length(F.regexp_replace(c, f"[{CJK}]", ""))
    return F.ceil(wide + (F.length(c) - wide) / F.lit(3.5)).cast("int")


def quoted(c: Column | str) -> Column:
    """Spans of 1 to 300 characters in quotation marks of five styles, by style in order."""
    styles = ("“([^“”]{1,300})”", "「([^「」]{1,300})」", "『([^『』]{1,300})』", '"([^"]{1,300})"', "‘([^‘’]{1,300})’")
    return F.concat(*[F.regexp_extract_all(_col(c), F.lit(s), F.lit(1)) for s in styles])


def first_sentence(c: Column | str, width: int = 40) -> Column:
    c = _col(c)
    head = F.substring(F.split(c, "[。！？\n]").getItem(0), 1, width)
    return F.when(F.length(head) > 0, head).otherwise(F.substring(c, 1, width))


def gist(excerpt_: Column | str, content: Column | str, width: int = 120) -> Column:
    """The excerpt where there is one, else the start of the content."""
    return F.coalesce(F.nullif(F.trim(_col(excerpt_)), F.lit("")), F.substring(_col(content), 1, width), F.lit(""))


def cleaned_labels(labels: Column | str, width: int = 40, most: int = 12) -> Column:
    """Labels trimmed, cut to a width, without blanks and repeats, in order, the first few."""
    cut = F.transform(F.coalesce(_col(labels), F.array().cast("array<string>")), lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, width))
    return F.slice(F.array_distinct(F.filter(cut, lambda x: F.length(x) > 0)), 1, most)


def rendered(messages: Column | str, most: int = 6, width: int = 300) -> Column:
    """The last messages (array of structs ``speaker, text``) as lines with their speakers."""
    m = _col(messages)
    last = F.slice(m, F.greatest(F.size(m) - most + 1, F.lit(1)), F.lit(most))
    return F.array_join(F.transform(last, lambda x: F.concat(F.coalesce(x["speaker"], F.lit("?")), F.lit(": "), F.substring(F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"\s+", " "), 1, width))), "\n")


def verbatim(words: Column | str, context: Column | str, most: int = 5) -> Column:
    """Words of 2 to 12 characters that occur in the context, the first few."""
    ok = lambda w: (F.length(w) >= 2) & (F.length(w) <= 12) & F.contains(normalized(context), normalized(w))
    return F.slice(F.array_distinct(F.filter(_col(words), ok)), 1, most)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` places filled from columns; null fills with nothing."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out
