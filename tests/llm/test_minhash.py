import random
import re

import numpy as np
import pyarrow as pa
import pytest

from noticeflow.llm import minhash, queries
from noticeflow.llm.components import components

from .cases import awkward, nothing


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent=80):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def family(rnd, n, size, edits):
    """A chain of near copies: each differs from the one before by some words."""
    words = [f"w{rnd.randint(0, 5000)}" for _ in range(size)]
    for _ in range(n):
        yield " ".join(words)
        words = list(words)
        for _ in range(edits):
            words[rnd.randrange(size)] = f"w{rnd.randint(0, 5000)}"


@pytest.mark.parametrize("k", [2, 5])
def test_like_brute_force(spark, k):
    rnd = random.Random(k)
    texts = [t for size, edits in ((60, 2), (200, 7), (200, 12), (40, 1), (9, 1)) for t in family(rnd, 12, size, edits)]
    texts += [" ".join(f"v{rnd.randint(0, 40)}" for _ in range(rnd.randint(1, 60))) for _ in range(60)] + texts[:20] + ["A b c", "a B c", "x", "X", ""]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=k)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    out = got.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


@pytest.mark.parametrize("tile", [(1 << 17, 1 << 19), (300, 900)])
def test_tiles_when_centres_do_not_settle(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "CENTRES", 1)
    monkeypatch.setattr(minhash, "TILE", tile)
    rnd = random.Random(9)
    rows = list(enumerate([*family(rnd, 40, 120, 6), *family(rnd, 25, 60, 4)]))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 2)


def test_awkward_rows(spark):
    out = [tuple(r) for r in minhash.near_duplicates(awkward(spark), k=2).collect()]
    by = {r[0]: r for r in out if r[0] is not None}
    assert len(out) == 13
    assert [by[i][2] for i in range(10)] == [0, 1, 2, 3, 3, 5, 6, 7, 7, 9]
    assert [by[i][1] for i in (0, 1, 2, 3, 6)] == [0, 0, 0, 1, 1]
    assert [r for r in out if r[0] is None] == [(None, 3, None, True)]
    assert minhash.near_duplicates(nothing(spark), k=2).count() == 0
    kept = minhash.keep_one(awkward(spark), k=2)
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted([(False, i) for i in (0, 1, 2, 3, 5, 6, 7, 9, 9, 9)] + [(True, None)])


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d"), (2, "p q r s"), (3, "a b c d"), (3, "p q r s")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 1)}


def test_signatures_estimate_similarity_and_positions_are_permutations():
    rnd = np.random.default_rng(4)
    a, b = (rnd.integers(0, 2**63, 400).astype(np.uint64) for _ in range(2))
    b[:300] = a[:300]  # 300 of 500
    est = []
    for seed in range(40):
        sets = [np.unique(x * np.uint64(2 * seed + 1) + np.uint64(seed)) for x in (a, b)]
        sig = minhash.superminhash(np.concatenate(sets), np.cumsum([len(x) for x in sets]), 128)
        est.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(est) - 0.6) < 0.015
    assert np.std(est) < np.sqrt(0.24 / 128)  # less than plain MinHash
    one = minhash.superminhash(np.array([123], np.uint64), np.array([1]), 16)[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(16))


def test_early_stop_is_exact():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2**63, 300).astype(np.uint64)
    together = minhash.superminhash(np.concatenate([x, x[:2]]), np.array([300, 302]), 32)
    assert (together[0] == minhash.superminhash(x, np.array([300]), 32)[0]).all()
    each = np.min([minhash.superminhash(x[i : i + 1], np.array([1]), 32)[0] for i in range(300)], axis=0)
    assert (together[0] == each).all()


def test_shingles_of_texts():
    elements, ends = minhash.shingle_sets(pa.array(["A b\tc", "a B c", None, "", "q", "a b a b a"]), 2)
    assert np.diff(ends, prepend=0).tolist() == [2, 2, 0, 0, 1, 2]
    assert (elements[:2] == elements[2:4]).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(90)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    parent = {i: i for e in edges for i in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {i: find(i) for i in parent if find(i) != i}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op2_minhash(spark, sf).collect()) == brute(rows, 2)
