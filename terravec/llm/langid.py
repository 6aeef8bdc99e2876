"""Language ID: a byte convolutional network in numpy, applied to every fixed-length window of a text.

Bytes of the lower-cased text are embedded; filters of several widths, a rectifier, max pooling over the window and a softmax
follow. A text's class is that of the mean log probability of its windows, each weighted by its letters. For inference the
embedding and filters are folded into tables by byte pair, so a window costs a few table rows for each byte.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.common import table

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
EPOCHS = 8
#: Bounds of the labelled sample that is fitted: texts of each language, of all languages, and windows of each text. With more
#: languages than the second allows for, each still has one text.
SAMPLE_ROWS = 500
SAMPLE_TEXTS = 20_000
SAMPLE_WINDOWS = 4
UNKNOWN = "und"
#: Windows scored at once.
BATCH = 128
_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> np.ndarray:
    """The whole text in rows of WINDOW bytes, the last one filled up with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), dtype=np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


def has_letter(text: str) -> bool:
    """Whether a character is alphabetic; of digits, fractions and Roman numerals none is."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def some_windows(text: str, seed: int, most: int = SAMPLE_WINDOWS) -> np.ndarray:
    """Windows of a text with letters to learn from, drawn from the whole of it."""
    w = windows(text)
    w = w[_LETTER_BYTE[w].sum(axis=1) >= 8]
    return w[np.random.default_rng(seed).permutation(len(w))[:most]]


@dataclass
class Net:
    classes: list[str]
    emb: np.ndarray  # byte -> EMBEDDING
    kernels: list[np.ndarray]  # for each width: (width * EMBEDDING, FILTERS)
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(classes: list[str], seed: int = 42) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
        return Net(classes, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), [draw(w * EMBEDDING, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(FILTERS * len(WIDTHS), len(classes)), np.zeros(len(classes), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, *self.kernels, *self.offsets, self.out, self.bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean cross entropy of windows x with classes y, in the order of parameters()."""
        n, rows = len(x), np.arange(len(x))[:, None]
        e = self.emb[x]
        pooled, tops = [], []
        for w, k, b in zip(WIDTHS, self.kernels, self.offsets, strict=True):
            cols = sliding_window_view(e, w, axis=1).swapaxes(2, 3).reshape(n, WINDOW - w + 1, w * EMBEDDING)
            z = cols @ k + b
            at = z.argmax(axis=1)
            tops.append((cols, at))
            pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1)
        h = np.maximum(raw, 0)
        logits = h @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[rows[:, 0], y] + 1e-9).mean())
        d = p
        d[rows[:, 0], y] -= 1
        d /= n
        d_h = (d @ self.out.T) * (raw > 0)
        d_emb, d_k, d_b = np.zeros_like(self.emb), [], []
        for i, (w, k) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
            g = d_h[:, i * FILTERS : (i + 1) * FILTERS]
            cols, at = tops[i]
            picked = cols[rows, at]  # (n, FILTERS, w * EMBEDDING)
            d_k.append(np.einsum("nf,nfc->cf", g, picked))
            d_b.append(g.sum(axis=0))
            back = (g[:, :, None] * k.T[None]).reshape(n, FILTERS, w, EMBEDDING)
            hit = x[rows[:, :, None], at[:, :, None] + np.arange(w)[None, None]]
            np.add.at(d_emb, hit.reshape(-1), back.reshape(-1, EMBEDDING))
        return [d_emb, *d_k, *d_b, h.T @ d, d.sum(axis=0)], loss


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 42) -> Net:
    """A net of some windows of each text; a class for each language there is."""
    xs = [some_windows(text, seed + k) for k, text in enumerate(texts)]
    return fit_windows(np.concatenate(xs) if xs else np.zeros((0, WINDOW), np.uint8), [lang for lang, x in zip(langs, xs, strict=True) for _ in x], sorted(set(langs)), epochs, seed)


def fit_windows(x: np.ndarray, langs: list[str], classes: list[str], epochs: int = EPOCHS, seed: int = 42) -> Net:
    """Adam over windows and their languages."""
    net, rng = Net.new(classes, seed), np.random.default_rng(seed)
    if not len(x) or len(classes) < 2:
        return net
    at = {c: k for k, c in enumerate(classes)}
    y = np.array([at[lang] for lang in langs])
    ms, vs, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(order) // 64)):
            t += 1
            xb = x[part].copy()
            short = rng.random(len(xb)) < 0.3  # texts also end within a window
            for i in np.flatnonzero(short):
                xb[i, rng.integers(12, WINDOW) :] = 0
            grads, _ = net.step(xb, y[part])
            rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, m, v in zip(net.parameters(), grads, ms, vs, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def _pooled(z: np.ndarray) -> np.ndarray:
    """z.max(axis=1) by halving, which keeps numpy's inner loops long."""
    while (n := z.shape[1]) > 1:
        half = (n + 1) // 2
        z = np.maximum(z[:, :half], z[:, n - half :])
    return z[:, 0]


class Tables:
    """A net with the embedding and kernels folded: each pair of bytes (or the last single one) has a row for each place in a filter."""

    def __init__(self, net: Net):
        self.net = net
        self.parts: list[list[tuple[int, int, np.ndarray]]] = []
        for w, k in zip(WIDTHS, net.kernels, strict=True):
            one = [net.emb @ k[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            rows = []
            for j in range(0, w, 2):
                rows.append((j, 2, (one[j][:, None, :] + one[j + 1][None]).reshape(-1, FILTERS)) if j + 1 < w else (j, 1, one[j]))
            self.parts.append(rows)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        flat = x.reshape(-1).astype(np.int32)
        pair = np.zeros_like(flat)
        pair[:-1] = (flat[:-1] << 8) | flat[1:]
        h = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for i, (w, rows) in enumerate(zip(WIDTHS, self.parts, strict=True)):
            total = None
            for j, size, values in rows:
                index = (pair if size == 2 else flat).reshape(n, WINDOW)[:, j : j + WINDOW - w + 1]
                got = np.take(values, index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            h[:, i * FILTERS : (i + 1) * FILTERS] = _pooled(total) + self.net.offsets[i]
        logits = np.maximum(h, 0) @ self.net.out + self.net.bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.net.classes:
            return langs, scores
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        sums = np.zeros((len(texts), len(self.net.classes)))
        weights = np.zeros(len(texts))
        held, owners, size = [], [], 0

        def flush() -> None:
            nonlocal held, owners, size
            if held:
                x, owner = np.concatenate(held), np.repeat(owners, [len(h) for h in held])
                for a in range(0, len(x), BATCH):
                    part, own = x[a : a + BATCH], owner[a : a + BATCH]
                    w = _LETTER_BYTE[part].sum(axis=1) + 1e-3
                    np.add.at(sums, own, self.log_probs(part) * w[:, None])
                    np.add.at(weights, own, w)
            held, owners, size = [], [], 0

        for i in known:
            held.append(windows(texts[i]))
            owners.append(i)
            size += len(held[-1])
            if size >= 4 * BATCH:
                flush()
        flush()
        for i in known:
            mean = sums[i] / weights[i]
            p = np.exp(mean - mean.max())
            k = int(p.argmax())
            langs[i], scores[i] = self.net.classes[k], float(p[k] / p.sum())
        return langs, scores


def labelled_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, where: Column, rows: int = SAMPLE_ROWS, texts: int = SAMPLE_TEXTS) -> tuple[np.ndarray, list[str], list[str]]:
    """Windows of up to ``rows`` texts of each language (``texts`` in all), by a hash of the id: windows, their languages, all languages.

    Windows are drawn from whole texts where the texts are, so that the driver gets windows only. A repeated id counts once.
    """
    known = docs.filter(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return np.zeros((0, WINDOW), np.uint8), [], []
    rows = max(1, min(rows, texts // len(sizes)))
    # a share that leaves some four times the rows that are wanted, so that a frequent language isn't one large task
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, 4.0 * rows / n)) for lang, n in sizes.items()], T.StructType([T.StructField("lang", docs.schema[lang_col].dataType), T.StructField("share", T.DoubleType())]))
    order = F.xxhash64("doc", F.lit(42))
    ids = known.select("doc", "lang").join(F.broadcast(share), "lang").filter(F.pmod(order, F.lit(1 << 20)) < F.ceil(F.col("share") * (1 << 20))).select("doc", "lang").distinct()
    picked = ids.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc"))).filter(F.col("_r") <= rows).select("doc").distinct()

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [some_windows(t.as_py(), zlib.crc32(str(d.as_py()).encode())).tobytes() for d, t in zip(b.column("doc"), b.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("lang"), pa.array(raw, pa.binary())], names=["doc", "lang", "raw"])

    met = known.join(F.broadcast(picked), "doc")  # at most ``texts`` ids
    found = met.mapInArrow(drawn, T.StructType([met.schema["doc"], met.schema["lang"], T.StructField("raw", T.BinaryType())]))
    got = found.groupBy("doc").agg(F.min(F.struct("lang", "raw")).alias("one")).select("doc", "one.*").collect()
    got = sorted(got, key=lambda r: str(r["doc"]))
    xs = [np.frombuffer(bytes(r["raw"]), dtype=np.uint8).reshape(-1, WINDOW) for r in got]
    return np.concatenate([np.zeros((0, WINDOW), np.uint8), *xs]), [r["lang"] for r, x in zip(got, xs, strict=True) for _ in x], sorted(sizes)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Net:
    return fit_windows(*labelled_windows(docs, id_col, text_col, lang_col, F.lit(True) if where is None else where))


def identified(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of columns of those names; ``und`` and 0 for null texts and those without a letter.

    All windows of a text count, however long it is; of equally likely languages the first in order is taken. Rows stay as they
    are, repeated ones with equal results; other columns pass through, whatever their names; an empty table gives an empty
    result. A net that knows one language predicts it, and one that knows none ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in batches:
            langs, scores = tables.predict(batch.column(text_col).to_pylist())
            yield batch.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores))

    own = docs.drop("lang_pred", "score")
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs, where=~held_out())
    return identified(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
