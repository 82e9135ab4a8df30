"""Mixing sources to target weights by fitting word budgets.

Every source gets a target number of words. Whole passes over a source come first; what is left of its
target is a subset-sum problem over its documents, solved on counts of documents by exact length: each
length gives its proportional share, then bounded-knapsack dynamic programming closes the rest. Of each
length the documents with the smallest seeded hashes are taken.

Only counts by (source, length) reach the solver, one task per source: as many numbers as the source has
lengths, which is at most the words of its longest text. The choice itself is a threshold on (hash,
identifier) per (source, length), found in hash buckets of about BUCKET_ROWS different values, so a length
that a third of all rows share is spread over tasks. Repeated rows at a threshold are numbered, and as many
of them taken as are wanted.

Sources in code-point order, null last, weigh 5, 2, 1, repeating; together they take SHARE of all words. A
target stops at MOST times its source's words, and the excess is shared again by weight.

Defined results: null and empty texts have size 0 and take 0 words; of repeated rows with one identifier and
one text those are taken first that come first by a hash of all their columns; a null doc_id is hashed as
such; an empty table gives no rows. Totals per source pass through the driver: they are as many as there
are sources.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import with_row_number
from .common import join_by_key, persisted

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 23
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
DP_WORDS, BUCKET_ROWS = 1 << 16, 1000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, found = share * sum(sizes.values()), list(names), {}
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            return found | {s: unit * weight[s] for s in free}
        for s in full:
            found[s] = most * sizes[s]
            rest = max(0.0, rest - found[s])
        free = [s for s in free if s not in found]
    return found


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each size to take, at most counts, for a total close to budget.

    The total stays within budget unless one more document brings it closer.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.array([n * budget // total for n in counts.tolist()], np.int64)
    rest = budget - int((sizes * taken).sum())
    left = counts - taken
    order = [i for i in np.argsort(-sizes).tolist() if sizes[i] > 0]
    for i in order:
        if rest <= dp_words:
            break
        k = min(int(left[i]), (rest - dp_words) // int(sizes[i]) + 1, rest // int(sizes[i]))
        taken[i] += k
        left[i] -= k
        rest -= k * int(sizes[i])
    chosen = knapsack(sizes, left, rest)
    taken += chosen
    short = rest - int((sizes * chosen).sum())
    over = np.flatnonzero((counts > taken) & (sizes >= short) & (sizes < 2 * short))
    if len(over):
        taken[over[np.argmin(sizes[over])]] += 1
    return taken


def knapsack(sizes: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the multiset of sizes whose sum is the largest reachable one within budget.

    Multiplicities are split in powers of two. For each sum the first part that reached it is kept, which
    is enough to walk back.
    """
    taken = np.zeros(len(sizes), np.int64)
    first = np.full(budget + 1, -1, np.int64)
    first[0] = -2
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-sizes).tolist():
        size, n, k = int(sizes[i]), int(left[i]), 1
        if size <= 0:
            continue
        while n > 0 and first[budget] == -1:
            k = min(k, n)
            weight = size * k
            if weight <= budget:
                new = np.flatnonzero((first[:-weight] != -1) & (first[weight:] == -1)) + weight
                first[new] = len(parts)
                parts.append((i, k))
            n -= k
            k *= 2
        if first[budget] != -1:
            break
    at = int(np.flatnonzero(first != -1)[-1])
    while at:
        i, k = parts[first[at]]
        taken[i] += k
        at -= int(sizes[i]) * k
    return taken


def group_of(source: str, size: str) -> Column:
    """A key of a source and a length; nulls are a source too."""
    return F.concat(F.col(size).cast("string"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))


def sized(docs: DataFrame, seed: int = SEED, carry: Iterable[str] = ()) -> DataFrame:
    """(__id, __source, __size, __hash, __group) and the carried columns."""
    text = F.col("text").cast("string")
    rows = docs.select(
        *carry,
        F.col("doc_id").cast("long").alias("__id"),
        F.col("source").cast("string").alias("__source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("__size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("__hash"),
    )
    return rows.withColumn("__group", group_of("__source", "__size"))


def choice(rows: DataFrame) -> tuple[DataFrame, dict[str | None, tuple[int, float]]]:
    """The plan by (source, size), and words and target of each source.

    Plan columns: __group, rows, passes, and the limit (limit_hash, limit_id) up to which a document is taken once
    more; of the `ties` rows at the limit itself `wanted` are. rows is what sized() gives; it is read several times.
    """
    spark = rows.sparkSession
    counts = persisted(rows.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count("*").alias("n")), "mix-counts")
    totals = {r.source: int(r.words) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    target = targets(totals)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        source = group.source.iloc[0]
        source = None if pd.isna(source) else source
        group = group.sort_values("size")
        words, goal = totals[source], round(target[source])
        passes = goal // words if words else 0
        extra = fill(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), goal - passes * words)
        return group.assign(passes=passes, extra=extra)

    plan = persisted(counts.groupBy("source").applyInPandas(solve, "source string, size long, n long, passes long, extra long"), "mix-plan")
    plan = plan.withColumn("__group", group_of("source", "size"))
    # Hash buckets: the threshold lies in the one bucket of a size that its count falls into.
    partial = plan.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select("__group", "extra", "n", F.col("n").alias("rows"))
    unit = F.shiftrightunsigned(F.col("__hash"), 11) / F.lit(float(1 << 53))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    cut = join_by_key(rows, persisted(partial, "mix-partial"), "__group", rows.count())
    cut = cut.select("__group", "extra", unsigned(F.col("__hash")).alias("h"), F.col("__id").alias("id"), F.least(F.floor(unit * buckets), buckets - 1).alias("bucket"))
    cut = persisted(cut.groupBy("__group", "bucket", "extra", "h", "id").agg(F.count("*").alias("ties")), "mix-cut")
    before = F.sum("rows").over(W.partitionBy("__group").orderBy("bucket")) - F.col("rows")
    filled = cut.groupBy("__group", "bucket").agg(F.sum("ties").alias("rows")).withColumn("before", before)
    edge = cut.join(filled, ["__group", "bucket"]).where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("rows")))
    # Unsigned order of the hash is the order of the buckets.
    upto = F.sum("ties").over(W.partitionBy("__group").orderBy("h", F.col("id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = edge.withColumn("wanted", F.col("extra") - F.col("before") - upto + F.col("ties"))
    limit = edge.where((F.col("wanted") > 0) & (F.col("wanted") <= F.col("ties"))).select("__group", F.col("h").alias("limit_hash"), F.col("id").alias("limit_id"), "wanted", "ties")
    everything = F.when(F.col("extra") == F.col("n"), F.lit((1 << 63) - 1))
    full = plan.join(limit, "__group", "left").select("__group", F.col("n").alias("rows"), "passes", F.coalesce("limit_hash", everything).alias("limit_hash"), "limit_id", "wanted", "ties")
    return persisted(full, "mix-limits"), {s: (totals[s], target[s]) for s in totals}


def unsigned(h):
    """Signed 64-bit values in the order of the unsigned ones."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def copies(rows: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """Adds how often each document is taken, as column copies."""
    names = rows.columns
    joined = join_by_key(rows, plan.withColumnRenamed("passes", "copies"), "__group", total)
    hashed = unsigned(F.col("__hash"))
    same = (hashed == F.col("limit_hash")) & F.col("__id").eqNullSafe(F.col("limit_id"))
    earlier = F.coalesce(F.col("limit_id").isNotNull() & (F.col("__id").isNull() | (F.col("__id") < F.col("limit_id"))), F.lit(False))
    every = F.col("wanted").isNull() | (F.col("wanted") == F.col("ties"))
    under = (hashed < F.col("limit_hash")) | (hashed == F.col("limit_hash")) & (earlier | F.col("wanted").isNull()) | same & every
    extra = F.when(F.coalesce(under, F.lit(False)), 1).otherwise(0)
    done = lambda df, more: df.select(*names, (F.col("copies") + more).cast("long").alias("copies"))
    some = F.coalesce(same & ~every, F.lit(False))
    if plan.where("wanted < ties").isEmpty():
        return done(joined, extra)
    # Repeated rows of which only some are wanted.
    tied = with_row_number(joined.where(some), ["__group", F.xxhash64(*(F.col(c) for c in names))], "__number")
    firsts = persisted(tied.groupBy("__group").agg(F.min("__number").alias("__first"), F.count("*").alias("rows")), "mix-ties")
    tied = join_by_key(tied, firsts, "__group", tied.count())
    taken = F.when(F.col("__number") - F.col("__first") < F.col("wanted"), 1).otherwise(0)
    return done(joined.where(~some), extra).unionByName(done(tied, taken))


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document."""
    rows = persisted(sized(docs), "mix-rows")
    plan, sources = choice(rows)
    known = docs.sparkSession.createDataFrame([(s, *x) for s, x in sources.items()], "source string, source_size long, target double")
    taken = copies(rows, plan, rows.count())
    # One row per source: as small as the list of sources.
    return taken.join(F.broadcast(known), F.col("__source").eqNullSafe(F.col("source"))).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: all columns of docs, each row as often as it is taken."""
    narrow = persisted(sized(docs), "mix-rows")
    plan, _ = choice(narrow)
    names = docs.columns
    rows = sized(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), "doc_id", "source", "text"), carry=["__row"])
    taken = copies(rows, plan, narrow.count()).where(F.col("copies") > 0)
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(*(F.col("__row")[c].alias(c) for c in names))
