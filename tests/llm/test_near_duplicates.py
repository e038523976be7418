"""Operators 2 and 10 against brute force."""

import random

import numpy as np
import xxhash

from gleaner.llm import buckets, embedding_dedup, simhash
from gleaner.llm.common import Stages
from gleaner.llm.components import components


def union(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(rnd):
    words = ["w%d" % i for i in range(400)]
    rows = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80))) for _ in range(120)]
    long = [rnd.choice(words) for _ in range(600)]
    for _ in range(60):
        near = long[:]
        near[rnd.randrange(600)] = "other%d" % rnd.randrange(9)
        rows.append(" ".join(near))
    return [*rows, None, "", " \t\n", "UPPER case Ünï", "upper CASE Ünï", rows[5], rows[5], "x" * 50_000, " ".join(long * 30)]


def test_simhash_groups(spark):
    rnd = random.Random(3)
    found = texts(rnd)
    ids = rnd.sample(range(10_000), len(found))
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in zip(ids, found)], "doc_id long, text string, fp long, rep long")
    got = {r.doc_id: r for r in simhash.simhash_dedup(docs).collect()}
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    prints = [plain_fingerprint(found[k]) for k in order]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    low = union(len(prints), links)
    assert len(got) == len(ids)
    for i, k in enumerate(order):
        assert got[ids[k]].fp % (1 << 64) == prints[i]
        assert got[ids[k]].component_id == ids[order[low[i]]]


def test_simhash_edge_cases(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = simhash.simhash_dedup(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "q r s t"), (9, None)], schema)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=str)


def test_documents_that_share_an_id_and_differ(spark):
    a, b = "one two three four five six seven eight", "neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn"
    rows = simhash.simhash_dedup(spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (0, "quite another text that stands alone here")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert len({r.fp for r in rows if r.doc_id in (1, 2)}) == 2
    rows = simhash.simhash_dedup(spark.createDataFrame([(5, a), (5, b), (2, a), (9, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(2, 2), (5, 2), (5, 5), (9, 5)]


def test_blocks_of_a_hot_bucket_lose_no_pair(spark):
    """Random fingerprints around few centres, with blocks of eight."""
    rnd = random.Random(5)
    prints = []
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.append(x)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fp long"), Stages(spark, "t"), block=8).collect()
    low = union(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    want = {fp: low[i] for i, fp in rows}
    assert {r.fp: r.component_id for r in got} == want


def brute_vectors(rows, threshold=0.93):
    n = len(rows)
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    pairs.append((i, j))
    links = [0] * n
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    low = union(n, pairs)
    return {r[0]: (links[i], rows[low[i]][0]) for i, r in enumerate(rows)}


def vectors(rnd):
    rows = []
    for label in (0, 1):
        for _ in range(25):
            centre = rnd.normal(size=64)
            for _ in range(rnd.integers(1, 6)):
                rows.append((centre + rnd.normal(size=64) * 0.12, label))
    hot = rnd.normal(size=64)
    rows += [(hot + rnd.normal(size=64) * 0.05, 1) for _ in range(80)] + [(hot, 1)] * 20 + [(hot, 0)] * 3 + [(hot, None)]
    return [(i, [float(x) for x in np.float32(v)], label) for i, (v, label) in enumerate(rows)]


def test_embedding_links_and_components(spark):
    rows = vectors(np.random.default_rng(1))
    n = len(rows)
    odd = [(None, 1), ([], 1), ([0.0] * 64, 1), ([float("nan")] * 64, 1), ([None] * 64, 1), ([float("inf")] * 64, 0), ([1.0, 0.0, 0.0], 1), ([2.0, 0.0, 0.0], 1), ([5.0], 1), ([3.0], 1)]
    rows += [(n + i, v, label) for i, (v, label) in enumerate(odd)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, kind long, copies long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame, block=16).collect()}
    want = brute_vectors(rows)
    assert set(got) == set(want)
    linked = sum(v[0] for v in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)  # nothing that is no link
    assert sum(v[0] for v in got.values()) >= 0.98 * linked  # recall
    exact = [k for k in want if got[k] == want[k]]
    assert len(exact) >= 0.95 * len(want)


def test_vectors_that_share_an_id_or_have_none(spark):
    schema = "vec_id long, embedding array<double>, label int"

    def found(rows):
        frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in rows], schema)
        return sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()), key=str)

    assert found([(1, (1, 0, 0)), (1, (0, 1, 0)), (2, (1, 0.01, 0)), (3, (0.01, 1, 0))]) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert found([(5, (1, 0, 0)), (5, (1, 0, 0)), (5, (0, 1, 0)), (2, (1, 0.01, 0))]) == [(2, 2, 2), (5, 0, 5), (5, 2, 2), (5, 2, 2)]
    assert found([(None, (1, 0, 0)), (2, (1, 0.01, 0)), (3, (1, 0.02, 0))]) == [(2, 2, 2), (3, 2, 2), (None, 2, 2)]
    assert found([(None, (1, 0, 0)), (None, (1, 0.01, 0)), (None, (0, 0, 0))]) == [(None, 0, None), (None, 1, None), (None, 1, None)]


def test_embedding_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(2).normal(size=(5, 64))
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), 64 * x)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 1999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}


def test_groups_are_cut_across_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": pa.array([1, 2, 2]), "v": pa.array([1, 2, 3])}), pa.RecordBatch.from_pydict({"k": pa.array([2, 3]), "v": pa.array([4, 5])}), pa.RecordBatch.from_pydict({"k": pa.array([3, 4]), "v": pa.array([6, 7])})]
    assert [g.column("v").to_pylist() for g in buckets.groups(iter(batches), ["k"])] == [[2, 3, 4], [5, 6]]
