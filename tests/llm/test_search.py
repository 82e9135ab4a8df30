"""Near duplicates, decontamination and the pipeline, against brute force."""

import os
import random
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import cgk_decontam, omh_dedup
from weftline.llm.common import hashed_words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so") for b in ("ta", "ve", "wi", "xo", "zu", "pe") for c in ("", "n", "s", "l", "rt")]


def edited(rng, words, rate):
    found = []
    for w in words:
        u = rng.random()
        if u < rate / 3:
            continue
        found.append(rng.choice(VOCABULARY) if u < 2 * rate / 3 else w)
        if 2 * rate / 3 <= u < rate:
            found.append(rng.choice(VOCABULARY))
    return found


def lcs(a, b, band):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (a[i] == b[j] and abs(i - j) <= band))
    return table[-1][-1]


def test_words():
    words, at = hashed_words(["Hello world, hello", "", None, "world x", "é Hello"])
    assert at.tolist() == [0, 3, 3, 3, 5, 7]
    assert words[0] == words[2] == words[6] and words[1] == words[3] and len({*words.tolist()}) == 4


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 28))] for _ in range(2))
        band = rng.randint(0, 28)
        assert omh_dedup.aligned(a, b, band) == lcs(a, b, band)
    for _ in range(100):
        a = np.array([rng.randint(0, 9) for _ in range(rng.randint(1, 40))], np.uint64)
        b = np.array(edited(rng, a.tolist(), 0.0) if rng.random() < 0.3 else [x for x in a.tolist() if rng.random() > 0.1] or [1], np.uint64)
        want = 2 * lcs(a.tolist(), b.tolist(), 99) / (len(a) + len(b))
        got = omh_dedup.similarity(a, b)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_sketches_keep_order():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    one, other = omh_dedup.sketch(values), omh_dedup.sketch(values[::-1].copy())
    assert one == omh_dedup.sketch(values.copy()) and len(one) == omh_dedup.SKETCHES
    assert len(set(one) & set(other)) <= 6  # one order in 24 of four shingles
    assert omh_dedup.sketch(values[:0]) == [] and len(omh_dedup.sketch(values[:3])) == 1


def test_occurrences():
    assert omh_dedup.occurrences(np.array([5, 3, 5, 5, 3], np.uint64)).tolist() == [0, 0, 1, 2, 1]


@pytest.fixture(scope="module")
def copied(spark):
    """Exact and near copies of one text in hundreds, pairs, and texts that share a passage."""
    rng, rows = random.Random(8), []
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    for i in range(120):
        rows.append(" ".join(edited(rng, base, 0.02)))
    rows += [" ".join(base)] * 80
    for i in range(150):
        own = [rng.choice(VOCABULARY) for _ in range(rng.randint(60, 200))]
        rows += [" ".join(own), " ".join(edited(rng, own, 0.01)) + ("!" if i % 2 else "")]
        rows.append(" ".join([*[rng.choice(VOCABULARY) for _ in range(70)], *passage]))
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], DOCUMENTS)


def test_classes_against_all_pairs(copied):
    docs = {r.doc_id: r.text for r in copied.collect()}
    got = {r.doc_id: r.class_id for r in omh_dedup.classes(copied).collect()}
    shingles = {d: omh_dedup.shingles(hashed_words([t])[0]) for d, t in docs.items()}
    sets = {d: set(s.tolist()) for d, s in shingles.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked, lost = 0, 0
    ids = sorted(docs)
    for i in ids:
        for j in ids[:i]:
            if 2 * len(sets[i] & sets[j]) >= 0.7 * (len(sets[i]) + len(sets[j])) and omh_dedup.similarity(shingles[j], shingles[i]) >= 0.8:
                linked += 1
                lost += got[i] != got[j]
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert linked > 5000 and lost <= 0.002 * linked
    assert all(root(i) == root(j) for i, j in got.items())  # nothing else is joined
    assert sum(got[i] == root(i) for i in ids) >= 0.99 * len(ids)


def test_odd_classes(spark, odd_documents, no_documents):
    found = {(r.doc_id, r.class_id, r.copies) for r in omh_dedup.classes(odd_documents).collect()}
    assert (4, 4, 3) in found and (5, 4, 3) in found and (None, None, 1) in found and (1, 1, 1) in found and (2, 2, 1) in found
    kept = omh_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-9, 1, 2, 3, 4, 9_000_000_000]
    assert kept.where("doc_id IS NULL").count() == 2
    assert omh_dedup.classes(no_documents).count() == 0 and omh_dedup.keep_one(no_documents).count() == 0
    same = spark.createDataFrame([(None, "x y"), (3, "x y")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in omh_dedup.classes(same).collect()} == {(None, 3), (3, 3)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, x) for x in range(501, 560)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in omh_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def sellers(item, text):
    best, column = len(item), list(range(len(item) + 1))
    for w in text:
        following = [0]
        for i in range(len(item)):
            following.append(min(column[i] + (item[i] != w), column[i + 1] + 1, following[i] + 1))
        column = following
        best = min(best, column[-1])
    return best


def test_best_match():
    rng = random.Random(6)
    for _ in range(300):
        item, text = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))], [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        assert cgk_decontam.best_match(item, text)[0] == sellers(item, text)


def test_contamination_against_all_pairs(spark):
    rng = random.Random(11)
    items = [[rng.choice(VOCABULARY) for _ in range(rng.randint(8, 60))] for _ in range(40)]
    docs = []
    for i in range(400):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 200))]
        if i % 2:
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, rng.choice(items), rng.choice([0, 0, 0.05, 0.1]))
        docs.append((i, " ".join(words).upper() if i % 3 == 0 else ", ".join(words), "en", "s", 1))
    df = spark.createDataFrame(docs, DOCUMENTS)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in cgk_decontam.contamination(df, bench).collect()}
    hashed = [hashed_words([" ".join(t)])[0].tolist() for t in items]
    want = {}
    for d, text, *_ in docs:
        words = hashed_words([text])[0].tolist()
        for i, item in enumerate(hashed):
            if (n := sellers(item, words)) <= int(0.2 * len(item) + 1e-9):
                want[d, i] = n
    assert len(want) > 150 and set(got) <= set(want) and all(want[k] == n for k, n in got.items())
    assert len(got) >= 0.98 * len(want)
    kept = {r.doc_id for r in cgk_decontam.clean(df, bench).collect()}
    assert kept == {d for d, *_ in docs} - {d for d, _ in got}


def with_edits(rng, words, n):
    """Exactly n edits, each of one word."""
    found = list(words)
    for _ in range(n):
        at = rng.randrange(len(found))
        kind = rng.randrange(3)
        found[at : at + (kind < 2)] = [] if kind == 1 else [f"new{rng.randrange(10**6)}"]
    return found


def test_items_with_all_edits_allowed(spark):
    """Recall at the limit: a fifth of the words edited, which the number of walks is derived from."""
    rng, rows, items = random.Random(21), [], []
    for i in range(400):
        item = [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(rng.randint(8, 90))]
        items.append((i, " ".join(item)))
        around = [[rng.choice(VOCABULARY) for _ in range(rng.randint(0, 120))] for _ in range(2)]
        rows.append((i, " ".join(around[0] + with_edits(rng, item, cgk_decontam.edits_of(len(item))) + around[1]), "en", "s", 1))
    got = {(r.doc_id, r.item_id) for r in cgk_decontam.contamination(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in got for i in range(400)) >= 400 * (cgk_decontam.RECALL - 0.02)


def test_long_items(spark):
    """Items of thousands of words with a fifth of them edited: found, and searched for with the walks of short ones."""
    rng = random.Random(51)
    words = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    began = time.process_time()
    assert all(cgk_decontam.walks_for(cgk_decontam.class_of(n)) <= 6 for n in (64, 127, 128, 1000, 20_000)) and time.process_time() - began < 6
    lengths = [64, 127, 128, 200, 300, 700, 1500, 5000, 20_000]
    items, rows = [], []
    for i, n in enumerate(lengths):
        item = words(n)
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(words(150) + with_edits(rng, item, cgk_decontam.edits_of(n)) + words(90)), "en", "s", 1))
        rows.append((100 + i, " ".join(words(40) + item[: n // 2]), "en", "s", 1))  # half an item is none
    got = {(r.doc_id, r.item_id): r.distance for r in cgk_decontam.contamination(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(i, i) for i in range(len(lengths))} and all(d <= cgk_decontam.edits_of(lengths[i]) for (i, _), d in got.items())


def test_pieces_cover_an_item():
    for n in (1, 8, 63, 64, 127, 128, 129, 4999):
        pieces = cgk_decontam.pieces_of(n)
        assert pieces[0][0] == 0 and pieces[-1][1] == n and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        assert n < 128 and len(pieces) == 1 or all(64 <= e - b < 128 for b, e in pieces)


def test_short_items_are_found_exactly(spark):
    rng = random.Random(5)
    few = VOCABULARY[:12]
    items = [[rng.choice(few) for _ in range(rng.randint(1, 7))] for _ in range(60)]
    docs = [[rng.choice(few) for _ in range(rng.randint(0, 25))] for _ in range(150)]
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(docs)], DOCUMENTS)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in cgk_decontam.contamination(df, bench).collect()}
    want = {(d, i): n for d, t in enumerate(docs) for i, x in enumerate(items) if (n := sellers(x, t)) <= int(0.2 * len(x) + 1e-9)}
    assert got == want and len(want) > 500


def test_odd_contamination(spark, odd_documents, no_documents):
    text = "the same few words of a text that is here"
    bench = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "words"), (None, "few words of a text"), (4, " ")], "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("digest", F.lit(1))
    odd = odd_documents.withColumn("item", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("key", F.lit(3))
    got = sorted((r.doc_id, r.item_id, r.distance) for r in cgk_decontam.contamination(odd, bench).collect())
    assert got == [(4, 1, 0), (4, 3, 0), (5, 1, 0), (5, 3, 0)]
    # The row without an identifier holds an item too; null texts and rows with one identifier stay by their texts.
    kept = cgk_decontam.clean(odd, bench)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, -9), (True, 1), (True, 2), (True, 3), (True, 9_000_000_000)]
    twice = spark.createDataFrame([(7, text), (7, "nothing of that kind")], "doc_id long, text string")
    assert [r.text for r in cgk_decontam.clean(twice, bench).collect()] == ["nothing of that kind"]
    nameless = bench.where("item_id IS NULL")
    assert cgk_decontam.contamination(odd, nameless).count() == 0 and cgk_decontam.clean(odd, nameless).count() == odd.count() - 3
    assert cgk_decontam.contamination(no_documents, bench).count() == 0 and cgk_decontam.contamination(odd_documents, bench.limit(0)).count() == 0


def test_one_of_each_class_is_kept(spark):
    """Rows are told apart by their texts, whatever their identifiers, and the row kept is always the same."""
    text, near = " ".join(VOCABULARY[:120]), " ".join(VOCABULARY[:118])
    other, lone = " ".join(VOCABULARY[60:180]), " ".join(VOCABULARY[100:])
    rows = [(1, text, "x"), (1, other, "x"), (2, near, "x"), (None, near, "x"), (None, lone, "x"), (None, lone, "y"), (3, lone + " end", "x"), (None, None, "x"), (None, None, "x"), (1, text, "a"), (1, text, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("digest", F.lit(0)).withColumn("node", F.lit(0)).withColumn("class", F.lit(0))
    kept = [sorted((str(r.doc_id), r.text or "", r.source) for r in omh_dedup.keep_one(d).collect()) for d in (docs, docs.repartition(3))]
    assert kept[0] == kept[1]
    assert [r[:2] for r in kept[0]] == sorted([("1", text), ("1", other), ("3", lone + " end"), ("None", ""), ("None", "")])
    found = {(r.doc_id, r.class_id) for r in omh_dedup.classes(docs).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (None, 3), (3, 3), (None, None)}


def brute_classes(texts):
    """The class of each distinct text, by comparing all pairs whose shingle sets allow it."""
    texts = sorted(set(texts))
    runs = [omh_dedup.shingles(hashed_words([t])[0]) for t in texts]
    sets, parent = [set(r.tolist()) for r in runs], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.5 * min(len(sets[i]), len(sets[j])) > 0 and omh_dedup.similarity(runs[i], runs[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {t: root(i) for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline_against_brute_force(spark):
    """Every stage's result from its own input by plain means: all pairs, all items, the tokenizer itself."""
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline as P
    from weftline.llm.budget_mix import targets
    from weftline.llm.common import persisted, table
    from weftline.llm.sstable_tokens import default_tokenizer

    sf = "/root/testdata/sf0.001"
    docs, stages = table(spark, sf, "documents"), []
    for _, stage in P.STAGES:
        after = persisted(stage(spark, docs, sf), "test")
        stages.append((docs.collect(), after.collect(), after.columns))
        docs = after
    columns = table(spark, sf, "documents").columns
    assert [c for *_, c in stages[:4]] == [columns] * 4

    before, after, _ = stages[0]
    assert set(after) <= set(before) and {r for r in before if r.text and len(r.text) > 400} <= set(after)
    assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in after)

    before, after, _ = stages[1]
    classes = brute_classes(r.text for r in before)
    first = {}
    for r in before:
        first[classes[r.text]] = min(first.get(classes[r.text], (r.doc_id, r.text)), (r.doc_id, r.text))
    assert sorted((r.doc_id, r.text) for r in after) == sorted(first.values())

    before, after, _ = stages[2]
    items = [hashed_words([r.text])[0].tolist() for r in table(spark, sf, "benchmark").collect()]
    dirty = {r.doc_id for r in before if any(cgk_decontam.best_match(i, hashed_words([r.text])[0].tolist())[0] <= cgk_decontam.edits_of(len(i)) for i in items if i)}
    assert dirty and {r.doc_id for r in after} == {r.doc_id for r in before} - dirty

    before, after, _ = stages[3]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sources = sorted({r.source for r in before}, key=lambda x: (x is None, x or ""))
    words = {x: sum(size(r) for r in before if r.source == x) for x in sources}
    largest = {x: max(size(r) for r in before if r.source == x) for x in sources}
    for x, target in targets(words).items():
        assert abs(sum(size(r) for r in after if r.source == x) - target) <= largest[x]
    assert all(after.count(r) <= 2 * before.count(r) for r in before) and set(after) <= set(before)

    before, after, _ = stages[4]
    tokenizer, start, want = tokenizers.Tokenizer.from_file(default_tokenizer()), 0, []
    for r in sorted(before, key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after) == want


def test_pipeline_of_odd_documents(spark, odd_documents, no_documents, tmp_path):
    """Nulls, long and empty texts, repeated rows and clashing columns pass all stages; so does an empty table."""
    import corpus_pipeline as P
    from weftline.llm.common import persisted

    odd = odd_documents
    for c in ("__lang", "__score", "guess", "row", "__hash", "__row", "copies", "digest", "class", "path", "shard"):
        odd = odd.withColumn(c, F.lit(1))
    spark.createDataFrame([(1, "the same few words of a text that is here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, least in ((odd, 1), (no_documents, 0)):
        columns = docs.columns
        for name, stage in P.STAGES:
            docs = persisted(stage(spark, docs, str(tmp_path)), "test")
            assert docs.count() >= least, name
            if name != "token shards":
                assert docs.columns == columns
        assert "ids_crc32" in docs.columns


def test_every_operator_is_registered():
    from weftline.llm.queries import ORACLE_SQL, QUERIES

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
