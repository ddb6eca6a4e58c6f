"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that the encoding of that
prefix ends with. The encoder stores this last token of each prefix, from left to right: of
the vocabulary's tokens that end at a place it takes the one that may follow the last token
of the prefix before it. Two tokens may follow each other when encoding their joined bytes
gives the two of them back. The ids of a piece are read by walking back from its end; a
longer text needs only the places after the old end, and an edit only the pieces around it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabularies; a parameter of everything that reads one.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

# Fixed value: the published pattern that cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000
#: Characters after a piece that can change where it ends (a contraction looks two ahead).
LOOKAHEAD = 3


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for
    themselves, the others for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the checks of which token may follow which."""

    def __init__(self, content: bytes) -> None:
        model = json.loads(content)["model"]
        letters = _byte_letters()
        ids: dict[str, int] = model["vocab"]
        special = {t["content"] for t in json.loads(content).get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in special}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.longest = max(self.length.values())
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = ids[a], ids[b], ids[a + b]
            self.merged[left, right] = (r, made)
            self.parts.setdefault(made, (left, right))
            self.rank.setdefault(made, r)
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or i in self.parts:
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._borders: dict[tuple[int, int], tuple[int, ...]] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def border(self, token: int, side: int) -> tuple[int, ...]:
        """What stands at one side of a token (0 left, 1 right) while it is being merged,
        from its outermost byte to itself."""
        found = self._borders.get((token, side))
        if found is None:
            chain = [token]
            while chain[-1] in self.parts:
                chain.append(self.parts[chain[-1]][side])
            found = self._borders[token, side] = tuple(reversed(chain))
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether no merge joins the two sides before both are whole, nor then.

        Merges happen by rank, and those of one rank from the left. At every moment the
        border has one token of either side; a merge across it happens if its rank comes
        before the next growth of the left one, and not after that of the right one.
        """
        found = self._follows.get((left, right))
        if found is None:
            a, b = self.border(left, 1), self.border(right, 0)
            i = j = 0
            found = True
            never = 1 << 60
            while True:
                across = self.merged.get((a[i], b[j]), (never, 0))[0]
                grow_a = self.rank[a[i + 1]] if i + 1 < len(a) else never
                grow_b = self.rank[b[j + 1]] if j + 1 < len(b) else never
                if across < grow_a and across <= grow_b and across < never:
                    found = False
                    break
                if grow_a == never and grow_b == never:
                    break
                if grow_a <= grow_b:
                    i += 1
                else:
                    j += 1
            if len(self._follows) > 1_000_000:
                self._follows.clear()
            self._follows[left, right] = found
        return found


class Prefixes:
    """The last token of every prefix of a growing string of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, b"", [-1]
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: entries of old prefixes stay, only new places are filled."""
        v, old = self.v, len(self.data)
        self.data += more
        last = self.last
        last.extend([-1] * len(more))
        begin = max(0, old - v.longest)
        length, follows = v.length, v.follows
        for end, token in v.automaton.iter(self.data[begin:].decode("latin-1")):
            place = begin + end + 1
            if place <= old or last[place] >= 0:
                continue
            start = place - length[token]
            if start == 0 or (start > 0 and follows(last[start], token)):
                last[place] = token

    def ids(self, upto: int | None = None) -> tuple[int, ...]:
        at = len(self.data) if upto is None else upto
        out = []
        while at > 0:
            out.append(self.last[at])
            at -= self.v.length[self.last[at]]
        return tuple(reversed(out))


@lru_cache(1)
def _cutter() -> regex.Pattern:
    return regex.compile(PIECES)


def _piece_ids(v: Vocabulary, piece: str) -> tuple[int, ...]:
    found = v.known.get(piece)
    if found is None:
        found = Prefixes(v, piece.encode("utf-8", "replace")).ids()
        if len(piece) <= 64:
            if len(v.known) >= REMEMBERED:
                v.known.clear()
            v.known[piece] = found
    return found


def encode(v: Vocabulary, text: str | None) -> list[int]:
    """Token ids of a text without special tokens; null and empty texts have none."""
    out: list[int] = []
    for piece in _cutter().findall(text or ""):
        out.extend(_piece_ids(v, piece))
    return out


class Encoded:
    """A text with its pieces and their ids, for appends and edits."""

    def __init__(self, v: Vocabulary, text: str = "") -> None:
        self.v, self.text = v, text
        self.starts = [m.start() for m in _cutter().finditer(text)]
        self.pieces = [_piece_ids(v, p) for p in _cutter().findall(text)]

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Replaces ``text[start:end]``; returns how many pieces were encoded again.

        Pieces that end well before the edit stay. From there on the text is cut anew until
        a cut falls on an old cut behind the edit; what follows is as it was.
        """
        text = self.text[:start] + new + self.text[end:]
        ends = [*self.starts[1:], len(self.text)]
        keep = 0
        while keep < len(self.starts) and ends[keep] + LOOKAHEAD <= start:
            keep += 1
        begin = self.starts[keep] if keep < len(self.starts) else (len(self.text) if not self.starts else ends[-1])
        shift = len(text) - len(self.text)
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, pieces = self.starts[:keep], self.pieces[:keep]
        again = 0
        for m in _cutter().finditer(text, begin):
            if m.start() in old and m.start() >= start + len(new):
                k = old[m.start()]
                starts += [s + shift for s in self.starts[k:]]
                pieces += self.pieces[k:]
                break
            starts.append(m.start())
            pieces.append(_piece_ids(self.v, m.group()))
            again += 1
        self.text, self.starts, self.pieces = text, starts, pieces
        return again


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(content: bytes) -> Vocabulary:
    """One vocabulary per worker process and file."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def vocabulary_file(tokenizer: str, folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{tokenizer}.json"), "rb") as f:
        return f.read()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def _encoder(spark: SparkSession, tokenizer: str, folder: str, counts: bool):
    """Arrow batches of (key, text) to (key, ids) or (key, number of ids)."""
    held = spark.sparkContext.broadcast(vocabulary_file(tokenizer, folder))  # a fixed file of 1.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [encode(v, x) for x in part.column(1).to_pylist()]
                out = pa.array([len(x) for x in found], pa.int32()) if counts else pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["key", "out"])

    return run


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids`` of every row. Null and empty texts give an empty list; no row is
    dropped, repeated keys are encoded each, other columns do not matter."""
    kind = documents.schema[key].dataType.simpleString()
    df = spread(documents.select(key, text))
    return df.mapInArrow(_encoder(df.sparkSession, tokenizer, folder, False), f"key {kind}, out array<int>").toDF(key, "ids")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, n_tokens`` of every row; 0 for null and empty texts."""
    kind = documents.schema[key].dataType.simpleString()
    df = spread(documents.select(key, text))
    return df.mapInArrow(_encoder(df.sparkSession, tokenizer, folder, True), f"key {kind}, out int").toDF(key, "n_tokens")
