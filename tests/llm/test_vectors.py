"""Whitening against a dense eigensolver, clustering against all distances, packing against the tokenizer."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import level_packing, ptolemaic_kmeans, whitening
from weftline.llm.vectors import integer_vectors

VECTORS = "vec_id long, embedding array<float>, x int, p string"


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], 1, "p") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def scaled(vectors):
    return np.floor(np.asarray(vectors, np.float32).astype(np.float64) * 1024).astype(np.int64)


def random_vectors(n, dims=64, seed=5):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 0.2, (12, dims))
    return (centres[random.integers(0, 12, n)] + random.normal(0, 0.1, (n, dims))).astype(np.float32)


ODD = [None, [0.5] * 63, [0.5] * 65, [], [0.1] * 63 + [None], [0.1] * 63 + [float("nan")], [float("inf")] + [0.1] * 63]


def test_integer_vectors(spark):
    got = integer_vectors(frame(spark, [*ODD, [3e38] + [0.0] * 63, [-0.0001] * 64]), shift=7, limit=1 << 20, dims=64).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [7, 8] and got[0].x == [(1 << 20) + 7] + [7] * 63 and got[1].x == [6] * 64


def plain_kmeans(vectors, ids, clusters=8, rounds=10):
    x = scaled(vectors).tolist()
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i]))
    centroids = [x[i] for i in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for v in x:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if own[j] else centroids[j] for j in range(len(centroids))]
    return [nearest(v) for v in x], centroids


@pytest.mark.parametrize("n", [1, 5, 400])
def test_clusters_are_those_of_all_distances(spark, n):
    vectors, ids = [v.tolist() for v in random_vectors(n)], list(range(100, 100 + n))
    vectors += vectors[:3] * 2  # repeated rows, also of one identifier and of none
    ids += [ids[0], *range(9000, 9000 + len(vectors) - n - 2), None]
    want, centroids = plain_kmeans(vectors, ids)
    got = ptolemaic_kmeans.cluster_table(frame(spark, vectors + ODD, ids + list(range(len(ODD))))).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), j, d) for i, (d, j) in zip(ids, want, strict=True))
    inertia = defaultdict(int)
    for d, j in want:
        inertia[j] += d
    for r in got:
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_bounds_never_pass_the_distance():
    random = np.random.default_rng(1)
    for scale in (1, 1000, 1 << 26, (1 << 31) - 1):
        x, c, p = (random.integers(-scale, scale + 1, (n, 64)) for n in (300, 9, 8))
        c[0], c[1], p[1] = p[0], x[0], p[0]  # a centroid on a pivot and one on a vector, equal pivots
        pivots = ptolemaic_kmeans.Pivots.of(p)
        exact = ptolemaic_kmeans.squared(x, c)
        bound = ptolemaic_kmeans.lower_bounds(ptolemaic_kmeans.squared(x, p), ptolemaic_kmeans.squared(c, p), pivots)
        assert (bound <= exact.astype(float) * (1 + 2.0**-50)).all()
        cluster, distance, _ = ptolemaic_kmeans.nearest(x, ptolemaic_kmeans.squared(x, p), c, pivots)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_bounds_leave_out_far_centroids():
    random = np.random.default_rng(2)
    centres = random.integers(-100_000, 100_000, (8, 64))
    x = centres[np.arange(400) % 8] + random.integers(-500, 500, (400, 64))
    pivots = ptolemaic_kmeans.Pivots.of(x[:8])
    _, _, checked = ptolemaic_kmeans.nearest(x, ptolemaic_kmeans.squared(x, pivots.vectors), centres, pivots)
    assert checked.mean() < 1.5


def test_kmeans_of_outliers(spark):
    vectors = [v.tolist() for v in random_vectors(60)]
    vectors += [[1e6, *vectors[0][1:]], [-2e5] * 64, [2e6] * 64, [-2e6] * 64]
    ids = list(range(len(vectors)))
    want, _ = plain_kmeans(vectors, ids)
    got = {r.vec_id: r for r in ptolemaic_kmeans.cluster_table(frame(spark, vectors)).collect()}
    for i, (d, j) in enumerate(want):
        assert got[i].cluster == j and got[i].distance == (d if d < 1 << 63 else None)
    assert any(d >= 1 << 63 for d, _ in want) == any(r.inertia is None for r in got.values())


def test_kmeans_ties_and_no_rows(spark):
    got = ptolemaic_kmeans.cluster_table(frame(spark, [[0.25] * 64] * 20)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20
    empty = ptolemaic_kmeans.cluster_table(frame(spark, ODD))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "checked"]


def test_kmeans_sql_is_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    pa = pytest.importorskip("pyarrow")
    vectors = [*(v.tolist() for v in random_vectors(60)), *ODD]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}))
    found = con.execute(ptolemaic_kmeans.oracle_sql())
    names = [d[0] for d in found.description]
    got = ptolemaic_kmeans.cluster_table(frame(spark, vectors)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def dense(vectors, k=8):
    x = scaled(vectors) + 100_000
    n, sums = len(x), x.sum(axis=0)
    near = (x * n - sums) / n
    values, found = np.linalg.eigh(near.T @ near / n)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    return x, near, values, found


def table_of(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.vec_id][r.component] = r
    return out


def test_whitening_is_that_of_a_dense_solver(spark):
    vectors = [v.tolist() for v in random_vectors(700, seed=9)]
    x, near, values, found = dense(vectors)
    got = table_of(whitening.whitened_table(frame(spark, [*vectors, None, [0.1, None], [float("nan")] * 64])))
    assert sorted(got) == list(range(700))
    have = np.array([[got[i][c].whitened for c in range(1, 9)] for i in range(700)])
    want = near @ found / np.sqrt(values)
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-9
    trace = (near * near).sum() / 700
    for c in range(1, 9):
        assert abs(got[3][c].explained / (values[c - 1] / trace) - 1) < 1e-12
    n, sums = 700, x.sum(axis=0)
    assert all(got[i][1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)) and got[i][1].n == n for i in range(0, 700, 50))
    assert len({r.identity_error for row in got.values() for r in row.values()}) == 1 and got[0][1].identity_error < 1e-10


@pytest.mark.parametrize("values", [[9, 9, 9, 9, 9, 9, 4, 4, 4, 1], [5] * 10, [100, 50, 25, 12, 6, 3, 1, 0, 0, 0], [1, 1, 0, 0, 0, 0, 0, 0, 0, 0], [1e6, 1e3, 1, 1, 1e-3, 1e-3, 1e-3, 1e-6, 1e-6, 1e-6]])
def test_repeated_and_missing_singular_values(values):
    random = np.random.default_rng(3)
    u, _ = np.linalg.qr(random.standard_normal((200, 10)))
    v, _ = np.linalg.qr(random.standard_normal((10, 10)))
    x = u * np.array(values, float) @ v.T

    def product(left, c):
        w = x @ c
        return (x @ left).T @ w, float(w @ w), x.T @ w

    got, right = whitening.bidiagonalise(product, 10, float(np.linalg.norm(x)), 8)
    k = min(8, int(np.sum(np.array(values) > 1e-9 * max(values))))
    assert np.allclose(got[:k], values[:k], rtol=1e-8, atol=1e-12 * max(values)) and np.allclose(right[:, :k].T @ right[:, :k], np.eye(k), atol=1e-12)
    for i in range(k):
        assert np.linalg.norm(x.T @ (x @ right[:, i]) - values[i] ** 2 * right[:, i]) < 1e-9 * max(values) ** 2


def test_lanczos_ends_before_all_dimensions():
    random = np.random.default_rng(4)
    u, _ = np.linalg.qr(random.standard_normal((300, 100)))
    v, _ = np.linalg.qr(random.standard_normal((100, 100)))
    values, passes = np.concatenate([2.0 ** np.arange(10, 0, -1), np.full(90, 0.05)]), []
    x = u * values @ v.T

    def product(left, c):
        passes.append(1)
        w = x @ c
        return (x @ left).T @ w, float(w @ w), x.T @ w

    got, _ = whitening.bidiagonalise(product, 100, float(np.linalg.norm(x)), 8)
    assert np.allclose(got[:8], values[:8], rtol=1e-12) and len(passes) < 40


def test_whitening_of_odd_tables(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [None, [None]], [[0.5] * 4], [[0.5] * 4] * 6, [[], []]):  # nothing, one row, equal rows, no dimension
        df = whitening.whitened_table(frame(spark, vectors))
        assert df.columns == columns and df.collect() == []
    got = table_of(whitening.whitened_table(frame(spark, [[1.0, 0.0], [1.0], [0.0], [3.0, 2.0]], [None, 4, 4, 5])))
    assert set(got) == {None, 4, 5} and set(got[5]) == {1, 2}  # a short vector ends in zeros
    huge = table_of(whitening.whitened_table(frame(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 0.5]])))
    assert huge[0][1].deviation is None or huge[0][1].deviation >= 0


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(level_packing.default_tokenizer())


def test_chunks_encode_as_the_whole_text(tokenizer, monkeypatch):
    random = np.random.default_rng(6)
    signs = [" ", " ", "\n", "\n", "a", "be", "é", "’", "'s", "don't", "1", "23", "!", "...", "\t", "\x85", " ", "\x1d", "\0", "日本", "<|endoftext|>", "​", "ß", "x" * 50]
    texts = ["", None, "Hello, World's end.\n\nTwo  lines\n", *("".join(signs[i] for i in random.integers(0, len(signs), random.integers(1, 12))) for _ in range(3000))]
    for room in (600_000, 5):
        monkeypatch.setattr(level_packing, "CACHE_WORDS", room)
        encoder = level_packing.ByteEncoder(level_packing.default_tokenizer())
        for t in texts:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def packed(lengths, size, most_open):
    packer, done = level_packing.LevelPacker(size, most_open), []
    for i, n in enumerate(lengths):
        done += packer.add(i, np.arange(n, dtype="<u4").tobytes())
        assert packer.n_open == packer.counts.sum() == sum(map(len, packer.levels)) < most_open
    return done + list(packer.end())


def test_every_token_is_in_one_window():
    random = np.random.default_rng(7)
    for lengths, most_open in ((random.integers(1, 200, 500), 1000), ([600] * 300, 20), ([1], 9), ([1024] * 3, 9), ([1023] * 50, 9), (random.geometric(0.002, 400), 30), ([], 9)):
        seen = [np.zeros(n, bool) for n in lengths]
        numbers = set()
        for number, pieces in packed(lengths, 1024, most_open):
            full = 0
            assert number not in numbers
            numbers.add(number)
            for i, start, ids in pieces:
                found = np.frombuffer(ids, "<u4")
                assert len(found) and (found == np.arange(start, start + len(found))).all() and not seen[i][found].any()
                seen[i][found] = True
                full += len(found)
            assert full == 1024 or full & (full - 1) == 0
        assert all(s.all() for s in seen)


def test_levels_are_those_of_least_squares():
    random, size = np.random.default_rng(8), 16
    packer = level_packing.LevelPacker(size, 1 << 30)
    for n in random.integers(1, size, 300):
        levels = packer.counts.copy()

        def after(h, n=n, levels=levels):
            there = levels.copy()
            if h:
                there[h] -= 1
            if h + n < size:
                there[h + n] += 1
            return int((there**2).sum())

        allowed = [h for h in range(size - n + 1) if h == 0 or levels[h]]
        best = min(map(after, allowed))
        assert packer.best_level(int(n)) == max(h for h in allowed if after(h) == best)
        list(packer.add("d", bytes(4 * int(n))))


def test_pack(spark, tokenizer, odd_documents, no_documents):
    pieces = level_packing.pack(odd_documents)
    rows = pieces.collect()
    want = sorted((str(r.doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in odd_documents.collect() for ids in [[*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]])
    assert sum(r.length for r in rows) == sum(n for _, n, _ in want)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for doc_id in (3, -9, 9_000_000_000):  # the others' identifiers are repeated
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        ids = np.array([x for r in own for x in r.ids], "<u4")
        assert (str(doc_id), len(ids), zlib.crc32(ids.tobytes())) in want and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
    sequences = {r.sequence_id: r for r in level_packing.sequences(pieces).collect()}
    for number, s in sequences.items():
        own = sorted((r for r in rows if r.sequence_id == number), key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert s.ids == [x for r in own for x in r.ids] and {r.sequence_tokens for r in own} == {len(s.ids)}
        assert len(s.ids) <= 1024 and (len(s.ids) == 1024 or len(s.ids) & (len(s.ids) - 1) == 0)
    assert level_packing.pack(no_documents, keep_ids=False).collect() == []
    assert "ids" not in level_packing.pack(no_documents, keep_ids=False).columns
