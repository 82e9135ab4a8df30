"""Pairs that the search must not leave out, against brute force."""

import random

import pytest

from weftline.llm import omh_dedup
from weftline.llm.common import hashed_words


def words_of(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def shingles_of(text):
    return omh_dedup.shingles(hashed_words([text])[0])


def similar_pairs(rows):
    """All pairs (a, b) of the rows (id, text) whose similarity is at least 0.8."""
    found = {i: shingles_of(t) for i, t in rows}
    sets = {i: set(s.tolist()) for i, s in found.items()}
    return {(a, b) for b in found for a in found if a < b and 2 * len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b])) and omh_dedup.similarity(found[a], found[b]) >= 0.8}


def template_family():
    """150 pairs at 0.815 among texts that are at 0.78 to all others by their template."""
    rng, rows = random.Random(21), []
    template = words_of(rng, 160)
    for _ in range(150):
        both = [*template, *words_of(rng, 7)]
        rows += [" ".join([*both, *words_of(rng, 37)]) for _ in range(2)]
    return rows


def short_texts():
    """Texts of 6 to 13 words, each with a copy that has a word or two more at one end."""
    rng, rows = random.Random(22), []
    for k in range(160):
        own, more = words_of(rng, 6 + k % 8), words_of(rng, 1 + k % 3 // 2)
        rows += [" ".join(own), " ".join([*own, *more] if k % 16 < 8 else [*more, *own])]
    return rows


def one_equal_sketch():
    """Pairs at the threshold of which only one sketch is equal."""
    rng, rows = random.Random(23), []
    while len(rows) < 24:
        both = words_of(rng, 84)
        pair = [" ".join([*both, *words_of(rng, 20)]) for _ in range(2)]
        if len(set.intersection(*(set(omh_dedup.sketch(shingles_of(t))) for t in pair))) == 1:
            rows += pair
    return rows


KINDS = [template_family, short_texts, one_equal_sketch]


@pytest.fixture(scope="module")
def pairs(spark):
    """By kind the similar pairs, and the class of every text."""
    rows = {kind: [(10_000 * k + i, t) for i, t in enumerate(kind())] for k, kind in enumerate(KINDS)}
    docs = spark.createDataFrame([r for some in rows.values() for r in some], "doc_id long, text string")
    return {kind: similar_pairs(some) for kind, some in rows.items()}, {r.doc_id: r.class_id for r in omh_dedup.classes(docs).collect()}


@pytest.mark.parametrize("kind", KINDS)
def test_every_similar_pair_is_in_one_class(pairs, kind):
    want, got = pairs[0][kind], pairs[1]
    assert len(want) >= 12
    lost = [p for p in want if got[p[0]] != got[p[1]]]
    assert not lost, f"{len(lost)} of {len(want)}"


def test_nothing_else_is_joined(pairs):
    want, got = set.union(*pairs[0].values()), pairs[1]
    first = {i: i for i in got}
    for a, b in sorted(want):
        first[b] = min(first[a], first[b])
    assert got == first
