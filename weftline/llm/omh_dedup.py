"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Sketches. A document's words (hashed_words) give its shingles of SHINGLE words; a shorter text is one
shingle. Shingles are labelled by their occurrence; each of SKETCHES seeded hashes picks the PICKED smallest
ones, and their hashes in text order are one sketch. Equal sketches are likely for texts that share their
shingles in the same order, that is for a large edit similarity.

Candidates. Texts with an equal sketch share a bucket. No bucket emits its pairs: a leader is elected and every
member is aligned with it (if AGREEING sketches of the two are equal). Buckets elect by ORDERS different orders,
so that a text meets several members of a large class.

The rest. Leaders leave pairs uncompared. Whatever bucket then holds members of several classes gives all of
them, with a single equal sketch too, to an exact join by rare shingles: similar texts share one of the rarest
shingles of each, a fifth of the shorter text's and a third of the longer one's at a similarity of 0.8. Common
passages are not rare, so that members of a family with one template meet only where they share more. Texts of
one class never meet, and two classes first by the texts that stand for them, by all only if these aren't similar. All texts of at most SHORT shingles take part, as few shingles make few different
sketches: of their pairs none is left out.

With 32 sketches of 4, long texts at the threshold (two thirds of all shingles common) have no equal sketch
with a chance of 0.0009, those with three quarters common 0.000005, with four fifths 0.00000005.

Verification. Two texts of n and m shingles whose best alignment has L equal shingles are similar if
2 L / (n + m) is at least MIN_SIMILARITY. The alignment is restricted to the band that any alignment of that
quality must stay in, so it is exact for similar pairs. Equal texts are found by their digests.

Classes are the connected components of the verified pairs, of texts; a class is named by its smallest doc_id.
A text's links to leaders, as few as its sketches, are first contracted to about one.

Defined results: null texts are alone in their class and named by their own doc_id; texts without words, empty
ones too, are similar to equal texts only; rows without doc_id belong to classes like others, and the name is
null where all of a class lack one; rows with one doc_id and different texts are classified by their texts, and
only then two classes may have one name; an empty table gives no rows. keep_one() keeps, of a class, the smallest doc_id, nulls last, of these the smallest
digest, of equal rows with other columns one that their hash picks; null texts all stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import name_of
from .common import hashed_words, join_by_key, key_of, mixed, persisted, text_digest, text_groups

SHINGLE, MIN_SIMILARITY = 5, 0.8
SKETCHES, PICKED, AGREEING, SEED = 32, 4, 2, 41
#: Leaders are elected by so many different orders.
ORDERS = 8
#: Texts of at most so many shingles are compared exactly, whatever their sketches.
SHORT = 30
BLOCK = 1 << 15

_rng = np.random.default_rng(SEED)
SALTS = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0xD6E8FEB86659FD93)
LARGEST = np.uint64((1 << 64) - 1)


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words, or of all words if there are fewer."""
    n = min(n, len(words))
    if not n:
        return words
    found = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        found = found * STEP + words[k : len(words) - n + 1 + k]
    return mixed(found)


def occurrences(values: np.ndarray) -> np.ndarray:
    """Of each value how many equal ones precede it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.arange(len(values)) - np.repeat(first, np.diff(np.concatenate([first, [len(values)]])))
    found = np.empty(len(values), np.int64)
    found[order] = rank
    return found


def sketch(values: np.ndarray, picked: int = PICKED) -> list[int]:
    """The order-preserving sketches of a shingle sequence, as signed 64-bit numbers."""
    if not len(values):
        return []
    labelled = mixed(values + occurrences(values).astype(np.uint64) * STEP)
    if len(values) <= picked:
        places = np.arange(len(values))[None, :]
    else:
        each = np.arange(SKETCHES)
        places = np.empty((SKETCHES, 0), np.int64)
        hashes = np.empty((SKETCHES, 0), np.uint64)
        for at in range(0, len(values), BLOCK):
            part = (labelled[None, at : at + BLOCK] ^ SALTS[:, None]) * FACTORS[:, None]
            for _ in range(min(picked, part.shape[1])):
                least = part.argmin(axis=1)
                places = np.column_stack([places, least + at])
                hashes = np.column_stack([hashes, part[each, least]])
                part[each, least] = LARGEST
            if at:
                best = np.argsort(hashes, axis=1)[:, :picked]
                places, hashes = np.take_along_axis(places, best, 1), np.take_along_axis(hashes, best, 1)
        places = np.sort(places, axis=1)
    found = np.arange(1, len(places) + 1, dtype=np.uint64)
    for k in range(places.shape[1]):
        found = mixed(found * STEP + values[places[:, k]])
    return found.view(np.int64).tolist()


def similarity(x: np.ndarray, y: np.ndarray, least: float = MIN_SIMILARITY) -> float:
    """2 L / (n + m) of a banded alignment of two shingle sequences; 0 where it must be below least."""
    n, m = len(x), len(y)
    if not n or not m:
        return 0.0
    band = int((1 - least) * (n + m) + 1e-9)
    if abs(n - m) > band:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(x[n - short + head :][::-1] != y[m - short + head :][::-1]) if head < short else []
    tail = int(differ[0]) if len(differ) else short - head
    a, b = x[head : n - tail].tolist(), y[head : m - tail].tolist()
    return 2 * (head + tail + aligned(a, b, band)) / (n + m)


def aligned(a: list[int], b: list[int], band: int) -> int:
    """The most equal elements of an alignment that pairs only places at most band apart.

    Bit i of `open_` is 0 where the alignment of a[: i + 1] gains an element; one step per element of b.
    """
    if not a or not b:
        return 0
    masks: dict[int, int] = {}
    for i, v in enumerate(a):
        masks[v] = masks.get(v, 0) | 1 << i
    full, width = (1 << len(a)) - 1, (1 << 2 * band + 1) - 1
    open_ = full
    for j, v in enumerate(b):
        hits = masks.get(v)
        if hits is not None:
            hits &= width << j - band if j >= band else width >> band - j
            gain = open_ & hits
            if gain:
                open_ = (open_ + gain | open_ - gain) & full
    return len(a) - open_.bit_count()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, sketches, size in shingles) of every row; the digest is null for a null text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for b, e in text_groups(texts):
                words, at = hashed_words(texts[b:e])
                runs = [shingles(words[at[i] : at[i + 1]]) for i in range(e - b)]
                found, sizes = [sketch(x) for x in runs], [len(x) for x in runs]
                part = batch.slice(b, e - b)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["doc_id", "digest", "sketches", "size"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text_digest("text").alias("digest"), text.alias("text"))
    return rows.mapInArrow(measure, "doc_id long, digest binary, sketches array<long>, size int")


def promising(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough equal sketches, of (node, sketches)."""
    one = pairs.join(marks.select(F.col("node").alias("b"), F.col("sketches").alias("of_b")), "b")
    both = one.join(marks.select(F.col("node").alias("a"), F.col("sketches").alias("of_a")), "a")
    least = F.least(F.lit(AGREEING), F.size("of_a"), F.size("of_b"))
    return both.where(F.size(F.array_intersect("of_a", "of_b")) >= least).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b), by their texts (node, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b, first, second = (c.to_pylist() for c in batch.columns)
            found = []
            for i in range(len(a)):
                if last != a[i]:
                    last, left = a[i], shingles(hashed_words([first[i]])[0])
                found.append(similarity(left, shingles(hashed_words([second[i]])[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def compared(met: DataFrame, marks: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The verified links (member, leader) of pairs (node, leader), which may repeat, in either direction."""
    pairs = met.groupBy(*ordered("node", "leader")).agg(F.min("node").alias("member"))
    leader = F.when(F.col("member") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    pairs = persisted(pairs.select(leader.alias("a"), F.col("member").alias("b")), "omh-pairs")
    alike = verify(promising(pairs, marks), texts).where(F.col("similarity") >= least)
    return persisted(alike.select(F.col("b").alias("member"), F.col("a").alias("leader")), "omh-links")


def led_buckets(nodes: DataFrame, total: int) -> DataFrame:
    """(bucket, node, leader) of all buckets of several nodes."""
    members = nodes.select("node", F.explode("sketches").alias("bucket"))
    order = F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS)))
    leaders = members.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "node")).alias("first"), F.count("*").alias("rows")).where(F.col("rows") > 1)
    leaders = persisted(leaders.select("bucket", F.col("first.node").alias("leader"), "rows"), "omh-leaders")
    return persisted(join_by_key(members, leaders, "bucket", total), "omh-buckets")


def contracted(found: DataFrame) -> DataFrame:
    """Links (a, b) with the components of the links (member, leader), about one a member.

    A member keeps its smallest leader, and its other leaders are linked to that one instead.
    """
    stars = found.groupBy("member").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    first = F.col("leaders")[0].alias("a")
    pairs = F.concat(F.array(F.struct(first, F.col("member").alias("b"))), F.transform(F.slice("leaders", F.lit(2), F.size("leaders")), lambda x: F.struct(first, x.alias("b"))))
    return stars.select(F.inline(pairs)).distinct()


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, class) of all members of buckets that hold several classes, by the labels (node, label)."""
    rows = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("class"))
    rows = persisted(rows, "omh-labelled")
    kinds = rows.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("rows"))
    several = persisted(kinds.where(F.col("x") < F.col("y")).select("bucket", "rows"), "omh-several")
    return join_by_key(rows, several, "bucket", rows.count())


def labelled_shingles(texts: DataFrame) -> DataFrame:
    """(node, class, size, shingle) of each text's (node, class, text) shingles, labelled by their occurrence."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for b, e in text_groups(texts):
                words, at = hashed_words(texts[b:e])
                found = [shingles(words[at[i] : at[i + 1]]) for i in range(e - b)]
                sizes = np.array([len(x) for x in found])
                each = pa.array(np.repeat(np.arange(b, e), sizes))
                labelled = np.concatenate([mixed(x + occurrences(x).astype(np.uint64) * STEP) if len(x) else x for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(np.repeat(sizes, sizes), pa.int32()), pa.array(labelled.view(np.int64))], ["node", "class", "size", "shingle"])

    return texts.select("node", "class", "text").mapInArrow(measure, "node long, class long, size int, shingle long")


def rare_places(texts: DataFrame, least: float) -> DataFrame:
    """(node, class, size, bucket, shingle, room, early) of the shingles that may be the first common ones.

    texts: (node, class, text). All shingles have one order, those within one class first, then rare before
    frequent ones. The first common shingle of two similar texts stands so early in both that enough can follow
    it; room is what can, and early is what is early enough for the shorter text. Sizes of similar texts lie in
    one bucket or in neighbouring ones.
    """
    rows = persisted(labelled_shingles(texts), "omh-shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("class").alias("x"), F.max("class").alias("y")).where(F.col("x") < F.col("y")).select("shingle", "often")
    shared = rows.join(often, "shingle").groupBy("node", "class", "size").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("shared"))
    places = shared.select("node", "class", "size", F.size("shared").alias("count"), F.posexplode("shared").alias("at", "s"))
    room = F.col("count") - F.col("at")
    bucket = F.floor(F.log(F.col("size").cast("double")) / math.log((2 - least) / least * 1.0001))
    places = places.select("node", "class", "size", bucket.alias("bucket"), F.col("s.shingle").alias("shingle"), room.alias("room"))
    # The least overlap with the shortest text that can be similar, and with a longer one.
    enough = F.col("room") + 1e-9
    places = places.where(enough >= F.col("size") * (least / (2 - least))).withColumn("early", enough >= F.col("size") * least)
    return persisted(places, "omh-rare")


def class_pairs(places: DataFrame, least: float) -> DataFrame:
    """Pairs of classes with a common shingle, if their sizes and what can follow allow a similar pair of nodes.

    (shingle, class, own, a) of the shorter text's side and (other, bucket, b) of the longer one's, with the least
    size and the most room there; a and b are the nodes with the most room on either side.
    """
    sums = [F.min("size").alias("low"), F.max("size").alias("high"), F.max("room").alias("room"), F.max(F.struct("room", "node")).alias("best")]
    early = places.where("early").groupBy("shingle", "class", F.col("bucket").alias("own")).agg(*sums).withColumn("bucket", F.explode(F.array("own", F.col("own") + 1)))
    other = places.groupBy("shingle", F.col("class").alias("other"), "bucket").agg(*sums)
    other = other.select("shingle", "bucket", "other", F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.col("room").alias("o_room"), F.col("best.node").alias("b"))
    fits = room_for(F.col("low"), F.col("room"), least)
    met = early.join(other, ["shingle", "bucket"]).where((F.col("class") != F.col("other")) & (F.col("low") <= F.col("o_high")) & fits)
    return persisted(met.select("shingle", "class", "own", F.col("best.node").alias("a"), "other", "bucket", "b", "o_low", "o_room"), "omh-class-pairs")


def room_for(n: Column, room: Column, least: float) -> Column:
    """Whether a text of n shingles, with this room, may be similar to one of a class."""
    return F.least(room, "o_room") + 1e-9 >= (n + F.greatest(n, "o_low")) * (least / 2)


def node_pairs(places: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of the class pairs: a superset of the similar ones."""
    short = places.where("early").select("shingle", "class", F.col("bucket").alias("own"), F.col("node").alias("a"), F.col("size").alias("n"), F.col("room").alias("r"))
    short = short.join(met.drop("a", "b"), ["shingle", "class", "own"]).where(room_for(F.col("n"), F.col("r"), least))
    long = places.select("shingle", F.col("class").alias("other"), "bucket", F.col("node").alias("b"), F.col("size").alias("m"), F.col("room").alias("q"))
    enough = F.least("r", "q") + 1e-9 >= (F.col("n") + F.col("m")) * (least / 2)
    pairs = short.join(long, ["shingle", "other", "bucket"]).where((F.col("n") <= F.col("m")) & enough)
    return pairs.select(*ordered("a", "b")).distinct()


def exact_links(texts: DataFrame, rest: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs (x, y) of classes of the rest (node, class) that have a similar pair of nodes.

    Classes are compared first by the nodes that stand for them at a shingle, and by all their nodes if those
    give no link.
    """
    places = rare_places(texts.join(rest, "node"), least)
    met = class_pairs(places, least)
    named = lambda node, name: rest.select(F.col("node").alias(node), F.col("class").alias(name))

    def alike(pairs: DataFrame, purpose: str) -> DataFrame:
        found = verify(persisted(pairs, purpose), texts).where(F.col("similarity") >= least).select("a", "b")
        found = found.join(named("a", "p"), "a").join(named("b", "q"), "b")
        return persisted(found.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), f"{purpose}-links")

    first = alike(met.select(*ordered("a", "b")).distinct(), "omh-standing")
    sides = met.withColumn("x", F.least("class", "other")).withColumn("y", F.greatest("class", "other"))
    apart = persisted(sides.join(first, ["x", "y"], "left_anti").select(*met.columns), "omh-apart")
    return first.unionByName(alike(node_pairs(places, apart, least), "omh-rare-pairs")).where(F.col("x") < F.col("y"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of the edges (a, b).

    Nodes with a single edge, as b, are leaves: they take no part in the rounds and get their label from a.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("up")))
    nodes = persisted(ends.groupBy("node").agg(F.count("*").alias("n"), F.count("up").alias("n_up"), F.min("up").alias("up")), "nodes")
    is_leaf = (F.col("n") == 1) & (F.col("n_up") == 1)
    leaves = nodes.where(is_leaf)
    stars = leaves.groupBy(F.col("up").alias("hub")).agg(F.min("node").alias("least"), F.count("*").alias("rows"))
    hubs = nodes.where(~is_leaf).join(stars, F.col("node") == F.col("hub"), "left").select("node", F.least("node", "least").alias("least"), F.coalesce("rows", F.lit(0)).alias("rows"))
    hubs = persisted(hubs, "hubs")
    core = edges.join(leaves.select(F.col("node").alias("b")), "b", "left_anti")
    labels = persisted(hubs.join(spread(core, hubs), "node").select(F.col("node").alias("up"), "label", "rows"), "hub-labels")
    named = join_by_key(leaves.select("node", "up"), labels, "up", leaves.count()).select("node", "label")
    return persisted(labels.select(F.col("up").alias("node"), "label").unionByName(named), "labels")


def spread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least value in each node's component of the edges (a, b), of nodes (node, least).

    Every round takes the smallest label among the neighbours, then that of the node where the label began.
    """
    both = persisted(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = nodes.select("node", F.struct(F.col("least").alias("value"), F.col("node").alias("at")).alias("label"))
    while True:
        told = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("told"))
        near = labels.join(told, labels["node"] == told["to"], "left").select("node", F.least("label", "told").alias("next"), F.col("label").alias("old"))
        above = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = near.withColumn("at", F.col("next.at")).join(above, "at").select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("old")).alias("moved"))
        new = persisted(new, "labels")
        if new.where("moved").isEmpty():
            return new.select("node", F.col("label.value").alias("label"))
        labels = new.select("node", "label")


def grouped(docs: DataFrame, least: float = MIN_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and (digest, class, doc_id, class_id, rows) of every text.

    class numbers the classes; doc_id is the smallest of the text's rows, class_id of the class's.
    """
    rows = persisted(sketches(docs), "omh-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sketches", "size"))
    nodes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(first.alias("f"), F.count("*").alias("rows"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("f.doc_id").alias("doc_id"), "rows", F.col("f.sketches").alias("sketches"), F.col("f.size").alias("size"))
    nodes = persisted(nodes, "omh-nodes")
    total = rows.count()
    met = led_buckets(nodes, total * SKETCHES)
    # A single shingle is similar to an equal one only, which has the same sketch.
    short = nodes.where(F.col("size").between(2, SHORT)).select("node")
    involved = nodes.join(met.select("node").union(short).distinct(), "node", "left_semi").select("node", "digest", key_of("doc_id").alias("key"))
    text = F.col("text").cast("string")
    texts = docs.select(text_digest("text").alias("digest"), key_of("doc_id").alias("key"), text.alias("text"))
    # Rows with one digest have one text.
    texts = persisted(texts.join(involved, ["digest", "key"]).groupBy("digest", "key", "node").agg(F.first("text").alias("text")).select("node", "text"), "omh-texts")
    marks = nodes.select("node", "sketches")
    found = compared(met.where(F.col("node") != F.col("leader")), marks, texts, least)
    labels = components(contracted(found))
    rest = mixed_buckets(met.select("bucket", "node"), labels).select("node", "class")
    rest = persisted(rest.union(short.join(labels, "node", "left").select("node", F.coalesce("label", "node"))).distinct(), "omh-rest")
    more = components(exact_links(texts, rest, least).select(F.col("x").alias("a"), F.col("y").alias("b")))
    classed = nodes.join(labels, "node", "left").select("digest", "doc_id", F.col("rows").alias("copies"), F.coalesce("label", "node").alias("part"))
    classed = persisted(classed, "omh-classed")
    parts = classed.groupBy("part").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    parts = parts.join(more.withColumnRenamed("node", "part"), "part", "left").withColumn("class", F.coalesce("label", "part"))
    parts = persisted(parts.select("part", "class", "least", "rows"), "omh-parts")
    names = parts.groupBy("class").agg(F.min("least").alias("class_id"))
    named = persisted(parts.join(names, "class").select("part", "class", "class_id", "rows"), "omh-names")
    return rows.select("doc_id", "digest"), persisted(join_by_key(classed, named, "part", total).select("digest", "class", "doc_id", "class_id", F.col("copies").alias("rows")), "omh-classes")


def classes(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, class_id, copies (rows with an equal text) of every row."""
    rows, texts = grouped(docs, least)
    named = texts.select("digest", "class_id", F.col("rows").alias("copies"), "rows")
    found = join_by_key(rows.where(F.col("digest").isNotNull()), named, "digest", rows.count()).select("doc_id", "class_id", "copies")
    return found.unionByName(rows.where(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies")))


def keep_one(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """All columns of one document of each class; see the module's text on which one."""
    _, texts = grouped(docs, least)
    best = texts.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best"))
    kept = best.select(F.col("best.digest").alias("__digest"), key_of("best.doc_id").alias("__key"))
    text = F.col("text").cast("string")
    row = F.struct(*(name_of(c) for c in docs.columns))
    rows = docs.where(text.isNotNull()).select(text_digest("text").alias("__digest"), key_of("doc_id").alias("__key"), row.alias("__row"))
    rows = rows.withColumn("__order", F.xxhash64(*(F.col("__row")[c] for c, t in docs.dtypes if "map<" not in t))).join(kept, ["__digest", "__key"])
    one = rows.groupBy("__digest", "__key").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")
    return one.unionByName(docs.where(text.isNull()))
