"""Pieces of SQL for the comparison engine that say what the text expressions say."""

from __future__ import annotations

from mnemospark.functions import text as T


SPEAKERS = "(SELECT lower(trim(alias)) AS alias, min(speaker) AS speaker FROM speakers WHERE alias IS NOT NULL GROUP BY 1)"
SPELT = "lower(trim(regexp_replace(role, '^\\s+|\\s+$', '', 'g')))"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalized(c: str) -> str:
    a, b = T._folds()
    # a dotted capital I becomes two characters in lower case, as in the other engine
    return f"lower(replace(translate(coalesce({c}, ''), {_q(a)}, {_q(b)}), 'İ', 'i' || chr(775)))"


def terms(c: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all({normalized(c)}, {_q(T.RUN)}), lambda r: CASE WHEN regexp_matches(r, {_q(f'^[{T.CJK}]')}) AND length(r) > 1 "
        "THEN list_transform(range(1, length(r)), lambda i: substring(r, i::INT, 2)) ELSE [r] END))"
    )


def is_stop(t: str) -> str:
    listed = ", ".join(_q(w) for w in sorted({*T.STOP_WORDS, *T.STOP_PAIRS, *T.PARTICIPANTS}))
    return f"({t} IN ({listed}) OR regexp_full_match({t}, '[{T.GLUE}]+') OR regexp_full_match({t}, '[a-z0-9]'))"


def seams(texts: str) -> str:
    """``query_id, term`` of the seam pairs in a table of ``query_id, t`` (in normal form)."""
    two = "(" + ", ".join(_q(w) for w in T.LONG_WORDS if len(w) == 2) + ")"
    three = "(" + ", ".join(_q(w) for w in T.LONG_WORDS if len(w) == 3) + ")"
    at = lambda i, n: f"substring(t, {i}, {n})"
    behind = lambda i, k, n, words: f"({i} > {k} AND {at(f'greatest({i} - {k}, 1)', n)} IN {words})"
    inside = lambda i: f"(regexp_full_match({at(i, 1)}, '[{T.GLUE}]') OR {at(i, 2)} IN {two} OR {at(i, 3)} IN {three} OR {behind(i, 1, 2, two)} OR {behind(i, 1, 3, three)} OR {behind(i, 2, 3, three)})"
    wide = lambda i: f"regexp_full_match({at(i, 1)}, '[{T.CJK}]')"
    end = f"(({behind('i', 1, 2, two)} OR {behind('i', 2, 3, three)}) AND {wide('(i + 1)')})"
    start = f"(({at('i + 1', 2)} IN {two} OR {at('i + 1', 3)} IN {three}) AND {wide('i')})"
    return f"SELECT DISTINCT query_id, {at('i', 2)} AS term FROM (SELECT query_id, t, unnest(range(1, length(t)))::INT AS i FROM {texts}) WHERE ({inside('i')} AND {inside('(i + 1)')} AND {wide('(i + 1)')}) OR {end} OR {start}"


def phrase(c: str) -> str:
    return f"regexp_replace({normalized(c)}, '[\\s\\pP\\pS\\pZ]+', '', 'g')"


def first_sentence(c: str, width: int = 40) -> str:
    head = f"substring(regexp_split_to_array({c}, '[。！？\n]')[1], 1, {width})"
    return f"CASE WHEN length({head}) > 0 THEN {head} ELSE substring({c}, 1, {width}) END"
