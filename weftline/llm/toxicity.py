"""Toxic passages by maximum-scoring segments of token log-odds.

Learning. Tokens are lower-cased words and their marked beginnings and ends, counted once per document in
toxic and clean labelled documents. A token's weight is its log-odds ratio with an informative Dirichlet
prior (each token's own share of all counts); only tokens that a likelihood-ratio test finds more frequent
in toxic documents keep it. A word scores its best token's weight, any other word -DRIFT.

Search. The linear-time scan for all maximal scoring segments (Ruzzo and Tompa) runs over each text's
words. Segment scores are normalised by extreme-value statistics (Karlin and Altschul: lambda from the
background's score distribution, K from seeded background sequences), and a segment is a toxic passage if
its p-value within its text is at most MAX_P. A logistic curve over the sum and the largest of the
normalised scores, fitted on the sample, gives the text's score.

Learning uses a bounded sample of MAX_DOCS labelled documents outside the held-out fold, in the order of a
seeded hash, one of each group of copies; every token of the sample that passes the test is kept. Labels,
languages, sources and identifiers never enter a score.

Defined results: null and empty texts have no passage and the curve's lowest score; without labels of both
classes all scores are 0; a document labelled more than once is toxic if any label is, and so are equal texts;
of near copies the first in a hash's order is learned from, with its own label; null labels and identifiers
are not learned from; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, hashed_words, held_out, persisted, seeded_sample
from .omh_dedup import shingles

MAX_DOCS, SEED = 20_000, 29
#: Copies are told by the smallest hashes of their shingles, so many of each text, half of which must be equal.
MARKS = 64
PRIOR, MIN_G2, DRIFT, MAX_P = 500.0, 24.0, 0.25, 0.01
CACHE_WORDS = 400_000
WORD = re.compile(r"[^\W\d_]+")
PASSAGE = "array<struct<start: int, end: int, score: double, p: double>>"


def tokens_of(word: str) -> list[str]:
    """The word, and its marked beginnings and ends of four and five letters."""
    found = [word]
    for n in (4, 5):
        if len(word) > n:
            found += ["^" + word[:n], word[-n:] + "$"]
    return found


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text, in linear time.

    hits: places and scores of the positive words, ascending; every other word scores -drift. Each segment
    keeps the running totals before its start and at its end, and a link to the nearest earlier segment with a
    smaller total before its start. Links are followed instead of the list, so each is passed once.
    """
    first: list[int] = []
    last: list[int] = []
    before: list[float] = []
    after: list[float] = []
    link: list[int] = []
    total, at = 0.0, 0
    for place, score in hits:
        total -= drift * (place - at)
        begin, low = place, total
        total += score
        at = place + 1
        j = len(first) - 1
        while j >= 0 and before[j] >= low:
            j = link[j]
        while j >= 0 and after[j] < total:
            # The new segment reaches back to that one's start, whose link is right for it.
            begin, low, k = first[j], before[j], link[j]
            for kept in (first, last, before, after, link):
                del kept[j:]
            j = k
        first.append(begin)
        last.append(place)
        before.append(low)
        after.append(total)
        link.append(j)
    return [(a, b, r - left) for a, b, left, r in zip(first, last, before, after, strict=True)]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = PRIOR) -> np.ndarray:
    """Log-odds ratios of counts with the prior's mass shared by the tokens' overall counts."""
    both = toxic + clean
    mass = prior * both / max(1, both.sum())
    of = lambda y, n: np.log((y + mass) / (n + prior - y - mass))
    return of(toxic, max(n_toxic, toxic.max(initial=0))) - of(clean, max(n_clean, clean.max(initial=0)))


def g2(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """The likelihood-ratio statistic of a token's toxic share against the sample's."""
    both = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0)
        b = np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0)
    return 2 * (a + b)


def extreme_values(scores: np.ndarray, shares: np.ndarray, seed: int = SEED) -> tuple[float, float]:
    """lambda and K of a background in which scores occur with these shares; the mean must be negative."""
    low, high = 0.0, 1.0
    while (shares * np.exp(high * scores)).sum() < 1:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(middle * scores)).sum() < 1 else (low, middle)
    lam = (low + high) / 2
    # Largest segment totals of background sequences follow a Gumbel law; hits are drawn by their gaps. A
    # length that holds about 50 hits keeps rare ones from leaving most sequences empty.
    rng = np.random.default_rng(seed)
    positive = scores > 0
    rate = shares[positive].sum()
    length = int(min(1e12, max(1000, 50 / rate)))
    largest = []
    for _ in range(64):
        n = rng.poisson(length * rate)
        places = np.sort(rng.integers(0, length, n))
        drawn = rng.choice(scores[positive], n, p=shares[positive] / rate)
        largest.append(max((s for _, _, s in segments(list(zip(places.tolist(), drawn.tolist(), strict=True)))), default=0.0))
    k = math.exp(min(50.0, max(-50.0, lam * float(np.mean(largest)) - 0.5772156649))) / length
    return lam, k


@dataclass
class ToxicModel:
    weights: dict[str, float]
    lam: float
    k: float
    curve: tuple[float, float, float]  # offset, per summed score, per largest score


class Scanner:
    """Scores texts; the scores of words are kept for reuse."""

    def __init__(self, model: ToxicModel):
        self.model, self.known = model, {}

    def word(self, word: str) -> float:
        best = max((self.model.weights.get(t, 0.0) for t in tokens_of(word)), default=0.0)
        if len(self.known) < CACHE_WORDS:
            self.known[word] = best
        return best

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """(first word, last word, normalised score, p-value) of the significant segments."""
        if not text:
            return []
        words, known = WORD.findall(text.lower()), self.known
        hits = [(i, s) for i, w in enumerate(words) if (s := known[w] if w in known else self.word(w))]
        if not hits:
            return []
        space, found = math.log(self.model.k * len(words)), []
        for first, last, score in segments(hits):
            normal = self.model.lam * score - space
            p = -math.expm1(-math.exp(-normal)) if normal > -30 else 1.0
            if p <= MAX_P:
                found.append((first, last, normal, p))
        return found

    @staticmethod
    def features(passages: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """Logarithms of the sum and of the largest of the normalised scores."""
        scores = [x[2] for x in passages]
        return math.log1p(sum(scores)), math.log1p(max(scores, default=0.0))

    def scan(self, text: str | None) -> tuple[float, list[dict]]:
        """The text's score, and its passages with character places.

        Where lower() changes a text's length, places are those of the lower-cased text.
        """
        found = self.passages(text)
        a, b, c = self.model.curve
        x, y = self.features(found)
        score = 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x + c * y))))
        places = [m.span() for m in WORD.finditer(text.lower())] if found else []
        return score, [{"start": places[i][0], "end": places[j][1], "score": s, "p": p} for i, j, s, p in found]


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(text, toxic): texts, without copies, of at most max_docs labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = persisted(seeded_sample(known, max_docs, SEED, "doc_id"), "tox-labels")
    # At most max_docs rows of two numbers are broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return persisted(without_copies(rows.select("text", "toxic")), "tox-sample")


def marked(texts: DataFrame) -> DataFrame:
    """Adds marks, the MARKS smallest hashes of the text's shingles of five words, to (text, toxic)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                runs = np.unique(shingles(hashed_words([text])[0]))[:MARKS]
                found.append(runs.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["text", "toxic", "marks"])

    return texts.mapInArrow(measure, "text string, toxic int, marks array<long>")


def seeded_hash(seed: int) -> Callable[[Column], Column]:
    return lambda m: F.xxhash64(F.lit(seed), m)


def without_copies(rows: DataFrame) -> DataFrame:
    """One text of each group of copies, lest a group's ordinary words look toxic.

    Three times the texts meet that share the smallest seeded hash of their marks, and a text goes if half of
    its marks are those of the first text there: that is, if it shares about a third of all five-word shingles.
    """
    equal = rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = marked(equal).withColumn("h", F.xxhash64("text"))
    for seed in range(3):
        mark = F.coalesce(F.array_min(F.transform("marks", seeded_hash(seed))), F.col("h"))
        group = W.partitionBy("mark").orderBy("h", "text")
        rows = rows.withColumn("mark", mark).withColumn("first", F.first("marks").over(group)).withColumn("place", F.row_number().over(group))
        common = F.size(F.array_intersect("marks", "first"))
        rows = rows.where((F.col("place") == 1) | (2 * common < F.size("marks"))).select("text", "toxic", "marks", "h")
    return rows.select("text", "toxic")


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, in_toxic, in_clean): documents that hold the token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                found[1 if toxic else 0].update({t for w in words for t in tokens_of(w)})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_pydict({"token": pa.array(names, pa.string()), "t": pa.array([found[1][x] for x in names], pa.int64()), "c": pa.array([found[0][x] for x in names], pa.int64())})

    parts = sample.select("text", "toxic").mapInArrow(count, "token string, t long, c long")
    return parts.groupBy("token").agg(F.sum("t").alias("in_toxic"), F.sum("c").alias("in_clean"))


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> ToxicModel | None:
    """A model, or None without labelled documents of both classes."""
    sample = labelled_sample(docs, labels, max_docs)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sum(n for y, n in sizes.items() if y)
    if not n_clean or not n_toxic:
        return None
    share = n_toxic / (n_toxic + n_clean)
    # A token below this many toxic documents can't pass the test, so that few of the sample's tokens are gathered.
    least = MIN_G2 / (2 * math.log(1 / share))
    rows = token_counts(sample).where((F.col("in_toxic") >= least) & (F.col("in_toxic") > share * (F.col("in_toxic") + F.col("in_clean")))).collect()
    rows = sorted(rows, key=lambda r: r.token)
    toxic, clean = (np.array([r[k] for r in rows], np.float64) for k in (1, 2))
    weights = log_odds(toxic, clean, n_toxic, n_clean)
    kept = (g2(toxic, clean, share) >= MIN_G2) & (weights > 2 * DRIFT)
    model = ToxicModel({r.token: float(w) for r, w, k in zip(rows, weights, kept, strict=True) if k}, 1.0, 1.0, (0.0, 0.0, 0.0))
    model.lam, model.k = background(sample, model)
    model.curve = calibrated(sample, model)
    return model


def background(sample: DataFrame, model: ToxicModel) -> tuple[float, float]:
    """Extreme-value parameters from the word scores of the sample's clean documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found.update(round(scanner.word(w), 1) for w in WORD.findall((text or "").lower()))
            yield pa.RecordBatch.from_pydict({"s": pa.array(list(found), pa.float64()), "n": pa.array(list(found.values()), pa.int64())})

    rows = sample.where("toxic = 0").select("text").mapInArrow(count, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    counts = Counter({r.s: r.n for r in rows})
    total = max(1, sum(counts.values()))
    # Half a count for every weight that the clean documents don't show.
    for w in {round(w, 1) for w in model.weights.values()} or {5.0}:
        counts[w] = max(counts[w], 0.5)
    positive = sorted(s for s in counts if s > 0)
    scores = np.array([-DRIFT, *positive])
    shares = np.array([total, *(counts[s] for s in positive)], np.float64)
    shares /= shares.sum()
    # The mean has to be negative; a background full of hits is diluted until it is.
    while (scores * shares).sum() >= -DRIFT / 10:
        shares[1:] /= 2
        shares[0] = 1 - shares[1:].sum()
    return extreme_values(scores, shares)


def calibrated(sample: DataFrame, model: ToxicModel) -> tuple[float, float, float]:
    """A logistic curve with slopes that aren't negative, by Newton's method with a weak ridge."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            found = [scanner.features(scanner.passages(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "x": pa.array([f[0] for f in found], pa.float64()), "z": pa.array([f[1] for f in found], pa.float64())})

    rows = sample.select("text", "toxic").mapInArrow(measure, "y int, x double, z double").groupBy("y", F.round("x", 2).alias("x"), F.round("z", 2).alias("z")).agg(F.count("*").alias("n")).collect()
    rows = sorted((r.y, r.x, r.z, r.n) for r in rows)
    y, x, z, n = (np.array(c, np.float64) for c in zip(*rows, strict=True))
    features = np.stack([np.ones(len(y)), x, z], axis=1)
    for used in ((0, 1, 2), (0, 1)):
        a, w = features[:, used], np.zeros(len(used))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = a.T @ (n * (y - p)) - 0.01 * w
            curve = (a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(len(used))
            step = np.clip(np.linalg.solve(curve, slope), -5, 5)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all() or len(used) == 2:
            return float(w[0]), float(w[1]), float(w[2]) if len(used) == 3 else 0.0
    raise AssertionError


_scanners: dict[int, Scanner] = {}


def scorer(spark, model: ToxicModel | None):
    """A function from a text column to struct(score, passages); the model, as small as the sample, is broadcast."""
    if model is None:
        return lambda text: F.struct(F.lit(0.0).alias("score"), F.array().cast(PASSAGE).alias("passages"))
    shared = spark.sparkContext.broadcast(model)

    def scan(texts: pd.Series) -> pd.DataFrame:
        mark = id(shared.value)
        if mark not in _scanners:
            _scanners.clear()
            _scanners[mark] = Scanner(shared.value)
        scanner = _scanners[mark]
        scores, passages = zip(*map(scanner.scan, texts), strict=True) if len(texts) else ((), ())
        return pd.DataFrame({"score": scores, "passages": passages})

    udf = F.pandas_udf(scan, f"score double, passages {PASSAGE}").asNondeterministic()  # run once, whatever is filtered by its result
    return lambda text: udf(text)


def score_texts(docs: DataFrame, model: ToxicModel | None, text: Column | str = "text") -> DataFrame:
    """Adds score and passages to all columns of docs."""
    text = F.col(text) if isinstance(text, str) else text
    return docs.withColumn("__scan", scorer(docs.sparkSession, model)(text)).select(*docs.columns, F.col("__scan.score").alias("score"), F.col("__scan.passages").alias("passages"))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every document."""
    scored = score_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
