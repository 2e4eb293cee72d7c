"""Toxic documents behind disguised spelling: words are restored through a noisy channel, and the restored text is scored.

Restoring: a token that is not plainly a word (signs or digits among its letters, a letter three times in a row, letters that stand apart) becomes a lattice. A digit or sign may stand for a letter or
for a gap between words, a separator for nothing or for a gap, a run of one letter for one or two of it, a star for a vowel; each reading has a fixed cost. A Viterbi search, whose states are the last
two letters, picks the reading with the least cost under a trigram model of characters (Witten-Bell interpolation). That model counts the characters of all documents, folded to `LETTERS`, so its
counts grow with the corpus while its table is a fixed 59 ** 3 numbers, the one thing about the corpus that is sent to the driver and back.

Scoring: a logistic regression on the distinct words of the restored text and on their first 3 to 6 letters, with weights of 0 and above and an L1 penalty, so that what explains the labels stays and
what merely comes along goes. It is fitted on at most `SAMPLE` distinct labelled texts, taken by the order of their digests; candidates are the `CANDIDATES` features with the greatest G statistic, of
those over `SURE`. Nothing but a text's words enters its score.

Each document is one row in one pass: no shuffle by word, no limit on a text's length; memos are bounded.

Cases: null and empty texts, and those without a word, have the score of no evidence; rows that share an id are scored each, and each is learnt from; where labels of an id or of a text differ, toxic
wins; labels without an id, or null, teach nothing; without a toxic and a clean label every score is 0; a row without an id is not held out; repeated rows are learnt once and give repeated rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import trimmed
from .shared import written

SAMPLE = 20_000
CANDIDATES = 4_000
SURE = 10.0
PENALTY = 0.1
THRESHOLD = 0.7
MEMO, MEMO_CHARS = 200_000, 64

# The model's characters: 0 is the edge of a word, the last one stands for every other letter.
LETTERS = "\0" + "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "\1"
N = len(LETTERS)
EDGE, OTHER = 0, N - 1
CODE = {c: i for i, c in enumerate(LETTERS)}

# What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
SEPARATORS = set(" \t\xa0-_.*·~|/\\•,")
UNSEEN = set("​‌‍⁠﻿\xad")
STANDS, STAR, INSIDE, LEADING, OPENING, TRAILING, BREAK, JOINED, SINGLE = 1.0, 2.5, 9.0, 9.0, 0.5, 5.0, 3.5, 5.0, 4.0

_PLAIN = re.compile(r"[^\w$@|!+(<€£¡*#]*([^\W\d_]+)(?:[^\w$@|+(<€£]*|([^\w])\2{2,}[.,]*)").fullmatch
_THRICE = re.compile(r"([^\W\d_])\1\1").search
_TWICE = re.compile(r"(?:([^\W\d_])\1+){3,}[^\w]*").fullmatch
_RUNS = re.compile(r"(.)\1*", re.S).finditer
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t\xa0]{1,2}\S(?!\S)){2,}")
_LETTER = re.compile(r"[^\W\d_]").search


@functools.cache
def _codes() -> np.ndarray:
    """The model's character of each code point, whatever its case."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = CODE.get(x.lower(), OTHER)
    return out


def trigrams(text: str, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The places in the table of a text's trigrams, a block at a time; words have one edge between them and one at either end of the text."""
    tail = np.zeros(1, np.int32)
    for i in range(0, len(text) + 1, block):
        piece = text[i : i + block]
        s = np.concatenate([tail, _codes()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)], np.zeros(int(len(piece) < block), np.int32)]).astype(np.int32)
        s = s[np.concatenate([np.ones(1, bool), (s[1:] != 0) | (s[:-1] != 0)])]
        yield (s[:-2] * N + s[1:-1]) * N + s[2:]
        tail = s[-2:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, size = np.zeros(N**3, np.int64), [], 0
    for batch in batches:
        for value in batch.column("text"):
            for grams in trigrams(value.as_py() or ""):
                held.append(grams)
                size += len(grams)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=N**3)
                    held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=N**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": some, "n": total[some]})


def costs(counts: np.ndarray) -> np.ndarray:
    """-log P of a character behind two others, shaped (N * N, N): each order's estimate is mixed with the shorter one's by the number of kinds that follow a context."""
    tri = counts.reshape(N * N, N).astype(float)
    two = tri.reshape(N, N, N).sum(0)
    one = two.sum(0)
    p = (one + 1) / (one.sum() + N)
    for n, times in ((two, 1), (tri, N)):
        kinds = np.maximum((n > 0).sum(1, keepdims=True), 1)
        p = (n + kinds * (np.tile(p, (times, 1)) if times > 1 else p)) / (n.sum(1, keepdims=True) + kinds)
    return -np.log(p).astype(np.float32)


def language_model(docs: DataFrame) -> np.ndarray:
    """`costs` of the characters of all documents."""
    found = docs.select("text").mapInArrow(trimmed(_counts), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # N ** 3 rows at most
    total = np.zeros(N**3, np.int64)
    total[np.asarray(found["gram"])] = np.asarray(found["n"])
    return costs(total)


class Channel:
    """Restores words; one for each worker process and model."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost.tolist()
        self.memo: dict[str, tuple[str, ...]] = {}

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For each run of one character its readings, strings of letters and edges, with their costs."""
        runs = [(m.group(1), len(m.group())) for m in _RUNS(span) if m.group(1) not in UNSEEN]
        letters = [i for i, (c, _) in enumerate(runs) if c.isalpha()]
        if not letters:
            return []
        first, last = letters[0], letters[-1]
        doubled = all(n > 1 for c, n in runs if c.isalpha())
        # A letter is alone if the characters next to it are none, nor signs that may be letters.
        body = [c.isalpha() or c in SIGNS and c not in SEPARATORS for c, _ in runs]
        alone = [n == 1 and not (i and body[i - 1]) and not (i + 1 < len(runs) and body[i + 1]) for i, (_, n) in enumerate(runs)]
        out = []
        for i, (c, n) in enumerate(runs):
            ways: list[tuple[str, float]] = []
            if c.isalpha():
                ways = [(c, 0.0)] if n == 1 else [(c, 0.0 if n > 2 or doubled else SINGLE), (c + c, 0.0)]
            else:
                apart = first < i < last and n == 1 and c in SEPARATORS and (alone[i - 1] or alone[i + 1])
                if apart:
                    edge = BREAK
                elif c in SEPARATORS or c not in SIGNS or i > last and (n > 2 or c == "!"):
                    edge = 0.0
                elif i < first and c not in "0123456789$@":
                    edge = OPENING
                else:
                    edge = LEADING if i < first else TRAILING if i > last else INSIDE
                ways.append(("\0", edge))
                if c in SIGNS:
                    price = STAR if c == "*" else STANDS
                    ways += [(x * k, price) for x in SIGNS[c] for k in ((1,) if n == 1 else (1, 2))]
                if c in SEPARATORS and first < i < last:
                    ways.append(("", 0.0 if apart else JOINED))
            out.append(ways)
        return out

    def decode(self, span: str) -> tuple[str, ...]:
        """The words of the likeliest reading of a span in lower case."""
        cost, states = self.cost, {0: (0.0, None)}
        for ways in [*self.lattice(span), [("\0", 0.0)]]:
            ahead: dict[int, tuple[float, tuple | None]] = {}
            for state, (price, path) in states.items():
                for reading, more in ways:
                    at, total = state, price + more
                    for x in reading:
                        code = CODE.get(x, OTHER)
                        if code == EDGE and at % N == EDGE:
                            continue
                        total += cost[at][code]
                        at = at % N * N + code
                    if at not in ahead or total < ahead[at][0]:
                        ahead[at] = total, (path, reading) if reading else path
            states = ahead
        _, path = min(states.values(), key=lambda x: x[0])
        read = []
        while path is not None:
            path, reading = path
            read.append(reading)
        return tuple("".join(read[::-1]).replace("\0", " ").split())

    def token(self, token: str) -> tuple[str, ...]:
        """The words that a token without white space restores to."""
        found = self.memo.get(token)
        if found is None:
            low = token.lower()
            if not low.isascii():
                low = "".join(c for c in unicodedata.normalize("NFKC", low).lower() if c not in UNSEEN)
            plain = _PLAIN(low)
            if plain and not _THRICE(low) and not _TWICE(low):
                found = (plain.group(1),)
            else:
                found = self.decode(low) if _LETTER(low) else ()
            if len(token) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo = {}
                self.memo[token] = found
        return found

    def spaced(self, text: str) -> Iterator[tuple[re.Match, tuple[str, ...]]]:
        """Runs of characters that stand apart, three or more, and what they restore to."""
        for m in _SPACED.finditer(text):
            low = m.group().lower()
            if _LETTER(low):
                found = self.memo.get(low)
                if found is None:
                    found = self.decode(low)
                    if len(low) <= MEMO_CHARS and len(self.memo) < MEMO:
                        self.memo[low] = found
                yield m, found

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        out: set[str] = set()
        for token in set(text.split()):
            out.update(self.token(token))
        for _, found in self.spaced(text):
            out.update(found)
        return out

    def restored(self, text: str) -> tuple[str, int]:
        """The text with each disguised token replaced, and how many there were; words that are plain stay as they are written."""
        n = 0

        def one(m: re.Match) -> str:
            nonlocal n
            words, token = self.token(m.group()), m.group()
            if not words or (len(words) == 1 and words[0] in token.lower()):
                return token
            n += 1
            return " ".join(words)

        def apart(m: re.Match) -> str:
            nonlocal n
            low = m.group().lower()
            words = self.decode(low) if _LETTER(low) else ()
            if not words or list(words) == low.split():
                return m.group()
            n += 1
            return " ".join(words)

        return re.sub(r"\S+", one, _SPACED.sub(apart, text)), n


_channels: dict[int, Channel] = {}


def channel(cost: np.ndarray) -> Channel:
    """One for a task's model; a worker that gets another model forgets the one before."""
    key = hash(cost.tobytes())
    if key not in _channels:
        _channels.clear()
        _channels[key] = Channel(cost)
    return _channels[key]


def word_features(word: str) -> list[str]:
    """The word, marked at its end, and its first 3 to 6 letters."""
    return [word + "$", *(word[:i] for i in range(3, min(7, len(word))))]


def _features(cost: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = channel(cost)
        for batch in batches:
            for key, toxic, text in zip(batch.column("key"), batch.column("toxic"), batch.column("text"), strict=True):
                found = sorted({f for w in mine.words(text.as_py()) for f in word_features(w)})
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([toxic.as_py()], pa.int32()), pa.array([found], pa.list_(pa.string()))], ["key", "toxic", "features"])

    return run


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))


def regression(rows: np.ndarray, columns: np.ndarray, label: np.ndarray, n_columns: int, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights of 0 and above and the bias of an L1 logistic regression on 0/1 features, given as (row, column) pairs; accelerated proximal steps."""
    n, size = len(label), n_columns
    along = lambda w: np.bincount(rows, w[columns], minlength=n) if len(rows) else np.zeros(n)
    back = lambda g: np.bincount(columns, g[rows], minlength=size) if len(rows) else np.zeros(size)
    v, norm = np.ones(size + 1), 1.0
    for _ in range(20):  # the greatest eigenvalue of X'X, for the length of a step
        u = along(v[:-1]) + v[-1]
        v = np.r_[back(u), u.sum()]
        norm = np.linalg.norm(v)
        v /= norm
    step = 3.5 / norm
    w, b = np.zeros(size), math.log(label.mean() / (1 - label.mean()))
    z, zb, t = w, b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(along(z) + zb))) - label
        w2, b2 = np.maximum(z - step * (back(g) + penalty), 0), zb - step * g.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    """True for rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, cost: np.ndarray, most: int = SAMPLE) -> Model | None:
    """The classifier, from labels of rows that are not held out; None if these have one class only."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select(F.sha2("text", 256).alias("key"), "toxic", "text")
    kept = rows.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy("key").limit(most)  # of an id with many texts no more are learnt from either
    texts = rows.select("key", "text").join(F.broadcast(kept), "key").groupBy("key").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    found = written(texts.mapInArrow(trimmed(_features(cost)), "key string, toxic int, features array<string>"))
    size = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not (size.get(0) and size.get(1)):
        return None
    clean, toxic = float(size[0]), float(size[1])
    part = lambda n, of: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (clean + toxic) / ((F.col("n0") + F.col("n1")) * of))).otherwise(0.0)
    seen = found.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    seen = seen.where((F.col("n1") + 0.5) / (toxic + 1) > 2.7 * (F.col("n0") + 0.5) / (clean + 1)).withColumn("g", 2 * (part("n1", toxic) + part("n0", clean))).where(F.col("g") >= SURE)
    names = sorted(r.feature for r in seen.orderBy(F.desc("g"), "feature").limit(CANDIDATES).select("feature").collect())
    chosen = found.select("key", "toxic", F.array_intersect("features", F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("features")).orderBy("key").toArrow()  # SAMPLE rows of CANDIDATES names at most
    at = {f: i for i, f in enumerate(names)}
    pairs = [(i, at[f]) for i, fs in enumerate(chosen["features"]) for f in fs.as_py()]
    r, c = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [])))
    w, b = regression(r, c, np.asarray(chosen["toxic"]).astype(float), len(names))
    return Model({f: float(w[i]) for f, i in at.items() if w[i] > 0}, b)


def _scores(cost: np.ndarray, model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, known = channel(cost), {}
        for batch in batches:
            scores = []
            for value in batch.column("text"):
                total = 0.0
                if model is not None:
                    text = value.as_py() or ""
                    for word in mine.words(text):
                        weight = known.get(word)
                        if weight is None:
                            weight = model.weight(word)
                            if len(word) <= MEMO_CHARS:
                                if len(known) >= MEMO:
                                    known.clear()
                                known[word] = weight
                        total += weight
                scores.append(0.0 if model is None else 1 / (1 + math.exp(-max(-700.0, model.bias + total))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, cost: np.ndarray, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_scores(cost, model)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): the character model of all documents, the classifier of the labelled ones, and each document's score."""
    cost = language_model(docs)
    return scored(docs, cost, fit(docs, labels, cost, most), threshold)


def _restored(cost: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = channel(cost)
        for batch in batches:
            for i, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text, n = mine.restored(value.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([text]), pa.array([n], pa.int64())], ["doc_id", "restored", "n_restored"])

    return run


def restore(docs: DataFrame, cost: np.ndarray | None = None) -> DataFrame:
    """(doc_id, restored, n_restored): each row's text with disguised words written plainly, and how many there were; null is empty."""
    cost = language_model(docs) if cost is None else cost
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_restored(cost)), "doc_id long, restored string, n_restored long")
