"""Language identification by a byte convolutional network, trained in numpy.

Bytes of the lower-cased text are embedded; filters of several widths slide over fixed-length windows;
the largest response of each filter in a window feeds a softmax layer. A text's language has the highest
mean window score, weighted by the windows' bytes; every byte of every text is in one window.

A filter of width w over embedded bytes is a sum of w table look-ups, so both training and scoring use
tables: one per filter tap while training, joint tables of two neighbouring bytes while scoring.

Training reads a bounded sample: `max_docs` labelled documents in the order of a seeded hash, and
`windows_per_doc` windows of each at seeded places. Only text and label are used.

Defined results: `und` with score 0 for a null text, one without a letter, and where no labelled document
exists to learn from; repeated rows get equal predictions; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, seeded_sample, text_groups

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
FILTERS, EMBED, WINDOW = 16, 8, 256
MAX_DOCS, WINDOWS_PER_DOC, STEPS, BATCH, SEED = 3000, 3, 300, 128, 17


@dataclass
class ByteCNN:
    """Parameters: embedding (256, e); per width taps (w, e, f) and bias (f); output (widths * f, classes)."""

    classes: list[str]
    embedding: np.ndarray
    taps: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and tap the response to each byte."""
        return [[np.ascontiguousarray(self.embedding @ t) for t in taps] for taps in self.taps]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into zero-padded windows, and the number of windows of each; an empty text has one."""
    counts = np.array([max(1, -(-len(d) // window)) for d in data], np.int64)
    at = np.concatenate([[0], np.cumsum(counts)]) * window
    flat = np.zeros(int(at[-1]), np.uint8)
    for d, a in zip(data, at.tolist(), strict=False):
        if d:
            flat[a : a + len(d)] = np.frombuffer(d, np.uint8)
    return flat.reshape(-1, window), counts


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], steps: int = STEPS, batch: int = BATCH, seed: int = SEED, rate: float = 0.01) -> ByteCNN:
    """Adam on the cross entropy; gradients reach only the window places where a filter was largest."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    model = ByteCNN(
        classes,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        [rng.normal(0, 0.5 / np.sqrt(w), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (total, len(classes))).astype(np.float32),
        np.zeros(len(classes), np.float32),
    )
    params = [model.embedding, *model.taps, *model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(windows), batch)
        for p, g, m, v in zip(params, gradients(model, windows[rows], labels[rows]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def gradients(model: ByteCNN, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The mean cross entropy's gradients, in the order embedding, taps, bias, out, out_bias."""
    hidden, best = [], []
    for w, taps, bias in zip(WIDTHS, model.tables(), model.bias, strict=True):
        n = x.shape[1] - w + 1
        response = taps[0][x[:, :n]]
        for k in range(1, w):
            response += taps[k][x[:, k : k + n]]
        place = response.argmax(axis=1)
        best.append(place)
        hidden.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0] + bias)
    h = np.concatenate(hidden, axis=1)
    active = np.maximum(h, 0)
    slope = softmax(active @ model.out + model.out_bias)
    slope[np.arange(len(x)), y] -= 1
    slope /= len(x)
    back = (slope @ model.out.T) * (h > 0)
    d_embedding, d_taps, d_bias = np.zeros_like(model.embedding), [], []
    for i, w in enumerate(WIDTHS):
        g, gradient = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(model.taps[i])
        for k in range(w):
            of_byte = np.zeros((256, FILTERS), g.dtype)
            np.add.at(of_byte, (x[np.arange(len(x))[:, None], best[i] + k], np.arange(FILTERS)[None, :]), g)
            gradient[k] = model.embedding.T @ of_byte
            d_embedding += of_byte @ model.taps[i][k].T
        d_taps.append(gradient)
        d_bias.append(g.sum(axis=0))
    return [d_embedding, *d_taps, *d_bias, active.T @ slope, slope.sum(axis=0)]


class Scorer:
    """Scores windows with joint tables of two neighbouring bytes."""

    def __init__(self, model: ByteCNN):
        self.model, self.pairs = model, []
        for taps in model.tables():
            steps = []
            for k in range(0, len(taps), 2):
                joint = k + 1 < len(taps)
                steps.append((k, joint, (taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, -1) if joint else taps[k]))
            self.pairs.append(steps)

    def logits(self, windows: np.ndarray, rows: int = 48) -> np.ndarray:
        found = []
        for at in range(0, len(windows), rows):
            x = windows[at : at + rows]
            two = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            hidden = []
            for w, steps, bias in zip(WIDTHS, self.pairs, self.model.bias, strict=True):
                n = x.shape[1] - w + 1
                response = None
                for k, joint, table in steps:
                    part = table[two[:, k : k + n] if joint else x[:, k : k + n]]
                    response = part if response is None else np.add(response, part, out=response)
                hidden.append(response.max(axis=1) + bias)
            found.append(np.maximum(np.concatenate(hidden, axis=1), 0) @ self.model.out + self.model.out_bias)
        return np.concatenate(found)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the index of its class and that class's probability."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for b, e in text_groups(texts):
            data = [(t or "").lower().encode("utf-8", "replace") for t in texts[b:e]]
            windows, counts = windows_of(data)
            used = np.maximum((windows != 0).sum(axis=1), 1).astype(np.float64)
            begin = np.cumsum(counts) - counts
            z = np.add.reduceat(self.logits(windows) * used[:, None], begin, axis=0) / np.add.reduceat(used, begin)[:, None]
            p = softmax(z)
            best[b:e], score[b:e] = p.argmax(axis=1), p.max(axis=1)
        return best, score


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_docs: int = MAX_DOCS, per_doc: int = WINDOWS_PER_DOC) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounded sample: at most max_docs documents and per_doc windows of WINDOW characters of each."""
    text, key = F.col(text_col), F.col(id_col)
    room = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    cut = F.array(*[text.substr(F.pmod(F.xxhash64(key, F.lit(k)), room).cast("int") + 1, F.lit(WINDOW)) for k in range(per_doc)])
    labelled = docs.where((fold(key) != 0) & F.col(label_col).isNotNull())
    rows = labelled.where(text.rlike(r"\p{L}")).select(key.alias("k"), F.col(label_col).alias("y"), cut.alias("w"))
    rows = seeded_sample(rows, max_docs, SEED, "k", "y", "w", total=labelled.count()).collect()
    classes = sorted({r.y for r in rows})
    data = [(w.lower().encode("utf-8", "replace")[:WINDOW], classes.index(r.y)) for r in rows for w in r.w]
    return windows_of([d for d, _ in data])[0], np.array([y for _, y in data], np.int64), classes


def fit(docs: DataFrame, **options) -> ByteCNN | None:
    """A network learned from the rows outside the held-out fold, or None without labelled rows."""
    windows, labels, classes = training_windows(docs, **options)
    return train(windows, labels, classes) if len(labels) else None


_scorers: dict[int, Scorer] = {}


def predictor(model: ByteCNN | None) -> Callable[[Column], Column]:
    """A function from a text column to struct(lang, score)."""
    if model is None:
        return lambda text: F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    mark = hash((model.out.tobytes(), model.embedding.tobytes()))

    def predict(texts: pd.Series) -> pd.DataFrame:
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(model)
        best, score = _scorers[mark].texts(texts.tolist())
        return pd.DataFrame({"lang": [model.classes[k] for k in best], "score": np.clip(score, 0, 1)})

    # Not deterministic for the optimizer, lest it runs the network again for a filter on its result.
    udf = F.pandas_udf(predict, "lang string, score double").asNondeterministic()
    return lambda text: udf(text)


def identify(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the predicted language and its probability to all columns of docs."""
    text = F.col(text_col)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    name = "guess"
    while name in docs.columns:
        name += "_"
    guess = docs.withColumn(name, predictor(model)(text))
    lang = F.when(letters, F.col(f"{name}.lang")).otherwise(UNKNOWN)
    score = F.when(letters, F.col(f"{name}.score")).otherwise(F.lit(0.0))
    return guess.withColumn(lang_col, lang).withColumn(score_col, score).drop(name)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the others' labels."""
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
