"""Toxicity: bags of character n-grams, averaged into a linear softmax; embeddings and classes are trained jointly in numpy.

A text is lower-cased and anything but letters becomes a break; the n-grams (3 to 6 bytes, with the breaks at word ends) of a
window of words are averaged, so a misspelt or unseen form of a word shares most of its vectors with the known form. A text's
score is that of its worst window, so that a few words are not diluted by a long text. Training chooses the worst window of
each labelled text anew in every round (multiple-instance learning). Because the class layer is linear, scoring needs one
number for each n-gram; all of it is numpy over the bytes of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.arrow import trimmed
from terravec.llm.common import table

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
WINDOW_WORDS = 3
DIMENSIONS = 8
#: Bounds of the labelled sample that is fitted: rows of each class, and characters in all.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 4_000_000
ROUNDS = 24
RATE = 15.0
OUT_RATE = 0.02
FLAG_AT = 0.7
#: Bytes scored at once.
CHUNK = 1 << 18
_BREAK = 0x20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_WORD = re.compile(rb"[a-z\x80-\xff]+")


@dataclass
class Grams:
    """The n-grams of a run of texts: bucket and word of each; window of each word; text of each window."""

    bucket: np.ndarray
    word: np.ndarray
    window: np.ndarray
    text: np.ndarray


def grams(texts: list[bytes], window_words: int = WINDOW_WORDS) -> Grams:
    """The n-grams of lower-cased texts. Those without a letter have no window."""
    raw = [b" " + t + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    letter = _LETTER[data]
    data = np.where(letter, data, _BREAK)
    n = len(data)
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    word_at = np.cumsum(starts, dtype=np.int32) - np.int32(1)  # of a letter, its word; of a break, the word before it
    first = np.flatnonzero(starts)
    text_of_word = np.searchsorted(np.cumsum([len(r) for r in raw]), first, side="right")
    words_before = np.searchsorted(text_of_word, np.arange(len(raw)))
    rank = np.arange(len(first)) - words_before[text_of_word]
    begins = (rank % window_words) == 0
    window = np.cumsum(begins) - 1
    buckets, owners = [], []
    if n:
        value = np.zeros(n, dtype=np.uint32)
        inner = np.ones(n, dtype=bool)
        for size in range(1, max(SIZES) + 1):
            m = n - size + 1
            if m <= 0:
                break
            value = value[:m] * np.uint32(0x01000193) ^ data[size - 1 :].astype(np.uint32)
            if size >= 3:
                inner = inner[:m] & letter[size - 2 : size - 2 + m]  # all but the first and last byte are letters
            if size in SIZES:
                at = np.flatnonzero(inner)
                mixed = (value[at] ^ (value[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                buckets.append(((mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32))
                owners.append(word_at[at + 1])
    none = np.zeros(0, np.int32)
    return Grams(np.concatenate([none, *buckets]), np.concatenate([none, *owners]), window, text_of_word[begins] if len(first) else np.zeros(0, np.int64))


def window_means(g: Grams, per_gram: np.ndarray) -> np.ndarray:
    """Of each window, the mean of its words' means of their n-grams' values."""
    n_words, n_windows = len(g.window), len(g.text)
    count = np.bincount(g.word, minlength=n_words)
    word = np.bincount(g.word, weights=per_gram[g.bucket], minlength=n_words) / np.maximum(count, 1)
    return np.bincount(g.window, weights=word, minlength=n_windows) / np.maximum(np.bincount(g.window, minlength=n_windows), 1)


@dataclass
class Model:
    """per_gram: the n-grams' share in the logit of class 1 against class 0; bias: what is added."""

    per_gram: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window score of each text; that of the bias alone where there is no window."""
        best = np.full(len(texts), -np.inf)
        for part, owner in _parts(texts):
            g = grams(part)
            np.maximum.at(best, owner[g.text], window_means(g, self.per_gram))
        best[np.isinf(best)] = 0.0
        return 1.0 / (1.0 + np.exp(-np.clip(best + self.bias, -30, 30)))


def _slices(raw: bytes, size: int) -> Iterator[bytes]:
    """A long text in slices of about size bytes, each of whole windows (the last one apart). A word longer than that stays whole."""
    a = 0
    while len(raw) - a > size:
        take = size
        while True:
            letter = _LETTER[np.frombuffer(raw, dtype=np.uint8, count=min(take, len(raw) - a), offset=a)]
            first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
            whole = max(0, len(first) - 1)  # the last word may go on
            whole -= whole % WINDOW_WORDS
            if whole or a + take >= len(raw):
                break
            take *= 2
        if not whole:
            break
        yield raw[a : a + first[whole]]
        a += int(first[whole])
    yield raw[a:]


def _parts(texts: list[str], size: int = CHUNK) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The lower-cased texts, or slices of them, in lists of about size bytes, with the position of the text of each."""
    part, owner, n = [], [], 0
    for i, t in enumerate(texts):
        for piece in _slices(t.lower().encode("utf-8", "replace"), size):
            if n and n + len(piece) > size:
                yield part, np.array(owner)
                part, owner, n = [], [], 0
            part.append(piece)
            owner.append(i)
            n += len(piece)
    if part:
        yield part, np.array(owner)


@dataclass
class Bags:
    """A training sample as bags: each text's words by number, and the n-grams of each distinct word.

    A text of a million words repeats most of them, so the n-grams of distinct words are all that is held.
    """

    word: np.ndarray  # the words of all texts in a row
    window: np.ndarray  # where each window begins among them, and the end
    text: np.ndarray  # where each text begins among the windows, and the end
    gram: np.ndarray  # the buckets of all distinct words in a row
    spell: np.ndarray  # where each distinct word begins among them, and the end

    @staticmethod
    def of(texts: list[str]) -> Bags:
        numbers: dict[bytes, int] = {}
        words, windows, ends = [], [np.zeros(1, np.int64)], [0]
        n = 0
        for t in texts:
            own = np.array([numbers.setdefault(w, len(numbers)) for w in _WORD.findall(t.lower().encode("utf-8", "replace"))], dtype=np.int32)
            words.append(own)
            windows.append(n + np.append(np.arange(WINDOW_WORDS, len(own), WINDOW_WORDS), len(own)) if len(own) else np.zeros(0, np.int64))
            ends.append(ends[-1] + len(windows[-1]))
            n += len(own)
        g = grams(list(numbers), window_words=1)
        order = np.argsort(g.word, kind="stable")
        spell = np.searchsorted(g.word[order], np.arange(len(numbers) + 1))
        return Bags(np.concatenate([np.zeros(0, np.int32), *words]), np.concatenate(windows), np.array(ends), g.bucket[order], spell)

    def word_means(self, per_gram: np.ndarray) -> np.ndarray:
        """Of each distinct word, the mean of its n-grams' values."""
        total = np.concatenate([[0.0], np.cumsum(per_gram[self.gram], dtype=np.float64)])
        return (total[self.spell[1:]] - total[self.spell[:-1]]) / np.maximum(np.diff(self.spell), 1)

    def window_means(self, per_gram: np.ndarray) -> np.ndarray:
        """Of each window, the mean of its words' means."""
        total = np.concatenate([[0.0], np.cumsum(self.word_means(per_gram)[self.word])])
        return (total[self.window[1:]] - total[self.window[:-1]]) / np.maximum(np.diff(self.window), 1)

    def grams_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of some windows: position of the window, bucket, and share in the window's mean."""
        owner, word = _spans(self.window, windows)
        word = self.word[word]
        at, gram = _spans(self.spell, word)
        share = 1.0 / (np.diff(self.spell)[word] * np.diff(self.window)[windows][owner])
        return owner[at], self.gram[gram], share[at]


def _spans(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions within the spans [starts[k], starts[k + 1]) of each k of which, and the place in which of each."""
    size = starts[which + 1] - starts[which]
    owner = np.repeat(np.arange(len(which)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[which], size)


def _document_contrast(bags: Bags, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram: by how many standard errors more texts of class 1 have it than of class 0 (only the first rounds choose
    windows by it), and whether three texts have it."""
    have = np.zeros((2, BUCKETS), dtype=np.int32)
    for i in range(len(labels)):
        own = np.unique(bags.word[bags.window[bags.text[i]] : bags.window[bags.text[i + 1]]])
        have[int(labels[i])][np.unique(bags.gram[_spans(bags.spell, own)[1]])] += 1
    n = np.array([len(labels) - labels.sum(), labels.sum()])
    rate = (have.sum(axis=0) + 1) / (n.sum() + 2)
    z = (have[1] / n[1] - have[0] / n[0]) / np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    return np.maximum(z - 3.0, 0.0), have.sum(axis=0) >= 3


def fit(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 42) -> Model:
    """Gradient descent over embeddings and class weights together. One class only: a constant score near it."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 6.0 if len(texts) and labels[0] == 1 else -6.0)
    rng = np.random.default_rng(seed)
    bags = Bags.of(texts)
    has = np.flatnonzero(bags.text[1:] > bags.text[:-1])
    emb = np.zeros((BUCKETS, DIMENSIONS))  # an n-gram that training never meets stays neutral
    out, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    first, common = _document_contrast(bags, labels)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    for r in range(rounds):
        z = bags.window_means(first if r < 4 else emb @ (out[:, 1] - out[:, 0]))
        chosen, target, portion, rate = [], [], [], RATE * (1 - r / rounds)
        for i in has:
            a, b = bags.text[i], bags.text[i + 1]
            top = a + int(np.argmax(z[a:b]))
            if labels[i] == 1:
                picks = [top]
            else:  # its worst windows, and some others
                k = min(3, b - a)
                picks = [*(a + np.argpartition(z[a:b], -k)[-k:]), *(a + rng.integers(0, b - a, 2))]
            chosen.extend(picks)
            target.extend([i] * len(picks))
            portion.extend([weight[i] / len(picks)] * len(picks))
        chosen, target, portion = np.array(chosen), np.array(target), np.array(portion)
        mix = rng.permutation(len(chosen))
        for part in np.array_split(mix, max(1, len(mix) // 512)):
            win, lab, w = chosen[part], labels[target[part]], portion[part]
            owner, ids, sh = bags.grams_of(win)
            sh = sh * common[ids]  # what only one or two texts have would be learnt by heart
            mean = np.stack([np.bincount(owner, weights=sh * emb[ids, k], minlength=len(win)) for k in range(DIMENSIONS)], axis=1)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(win)), lab.astype(int)] -= 1
            d = p * w[:, None]
            d_mean = d @ out.T
            touched, inverse = np.unique(ids, return_inverse=True)
            d_emb = np.stack([np.bincount(inverse, weights=sh * d_mean[owner, k], minlength=len(touched)) for k in range(DIMENSIONS)], axis=1)
            d_out = mean.T @ d
            # steps of a set length: an n-gram moves by its share in the error, so rare ones are not learnt by heart
            emb[touched] -= rate * d_emb / (np.linalg.norm(d_emb) + 1e-9)
            out -= OUT_RATE * rate * d_out / (np.linalg.norm(d_out) + 1e-9)
            bias -= OUT_RATE * rate * d.sum(axis=0) / len(win)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Up to ``rows`` texts of each class, by a hash of the id, and ``chars`` characters in all (``chars`` / 32 in one text).

    Ids and lengths are chosen first, at most 2 * rows of them, so that the driver never gets more text than it fits. A
    repeated id counts once, with its smallest text; an id that has both labels counts as class 1.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    usable = docs.filter(where & (F.char_length(text_col) <= chars // 32) & (F.col(text_col) != ""))
    ids = usable.select(id_col, F.char_length(text_col).alias("_n")).join(known, id_col).groupBy(id_col, "_label").agg(F.max("_n").alias("_n"))
    picked = [ids.filter(F.col("_label") == k).orderBy(F.xxhash64(id_col, F.lit(42)), id_col).limit(rows) for k in (0, 1)]
    found = sorted(picked[0].unionByName(picked[1]).collect(), key=lambda r: str(r[0]))
    np.random.default_rng(0).shuffle(found)
    taken, n = [], 0
    for r in found:
        if n + r["_n"] <= chars:
            taken.append((r[0], int(r["_label"])))
            n += r["_n"]
    if not taken:
        return [], np.zeros(0, np.int64)
    chosen = docs.sparkSession.createDataFrame(taken, T.StructType([docs.schema[id_col], T.StructField("_label", T.IntegerType())]))
    met = usable.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    got = met.groupBy(id_col, "_label").agg(F.min(text_col).alias("_text")).collect()
    got = sorted(got, key=lambda r: str(r[0]))
    np.random.default_rng(0).shuffle(got)
    return [r["_text"] for r in got], np.array([r["_label"] for r in got], dtype=np.int64)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (double) in place of a column of that name.

    A null, empty or letterless text has the score of no words. A very long text is scored in slices of whole windows, so its
    score is that of the text in one. Rows stay as they are, repeated ones too, and equal texts get equal scores; other columns,
    whatever their names, pass through; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.per_gram, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.append_column(score_col, pa.array(m.scores(texts)))

    own = docs.drop(score_col)
    return own.mapInArrow(trimmed(run), T.StructType([*own.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None) -> Model:
    """A model of the labelled rows for which ``where`` holds (all of them by default)."""
    return fit(*labelled_sample(docs, labels, id_col, text_col, label_col, F.lit(True) if where is None else where))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), where=~F.coalesce(held_out(), F.lit(False)))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= FLAG_AT).cast("int").alias("predicted"))
