import duckdb
import numpy as np
from pyspark.sql import functions as F

from noticeflow.llm import nearest, queries


def brute(rows, k=20):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, a) in enumerate(good):
        if q % 20 == 0:
            scores = []
            for other, (i, b) in enumerate(good):
                if other != at:
                    s = 0.0
                    for x, y in zip(a, b, strict=True):
                        s += x * y
                    scores.append((-s, i))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, id int")
    return sorted(tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, **options).collect())


def test_like_brute_force_over_many_tiles(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 24)) * rnd.choice([1e-3, 1, 50], (400, 1))
    x[100:160] = x[100]  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, query_block=7, candidate_block=37) == brute(rows)


def test_bounds_hold():
    rnd = np.random.default_rng(4)
    a, b = rnd.normal(size=(50, 64)), rnd.normal(size=(80, 64)) * 9
    qa, sa, ea, na = nearest.quantise(a)
    qb, sb, eb, nb = nearest.quantise(b)
    about = (qa.astype(int) @ qb.astype(int).T) * sa[:, None] * sb[None, :]
    assert (np.abs(a @ b.T - about) <= (na + ea)[:, None] * eb[None, :] + ea[:, None] * nb[None, :] + 1e-9).all()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.5]), (8, [-1.0, 0.5]), (40, [0.0, -0.0])]
    assert run(spark, rows) == brute(rows)
    assert [r[:3] for r in run(spark, rows) if r[0] == 0] == [(0, 1, 1), (0, 2, 20), (0, 3, 8), (0, 4, 8)]
    assert run(spark, rows[:0]) == []


def test_repeated_ids(spark):
    """Rows of one id, with equal or other vectors, are queries and candidates each for itself."""
    rnd = np.random.default_rng(6)
    rows = [(i % 45, rnd.normal(size=5).tolist()) for i in range(90)]
    rows += [rows[0], rows[20], rows[20], rows[7]]
    got = run(spark, rows, query_block=3, candidate_block=11)
    assert got == brute(rows) and len(got) == 20 * sum(i % 20 == 0 for i, _ in rows)


def test_a_tile_of_equal_vectors_takes_bounded_memory():
    import resource

    n, dims, asked = 8192, 64, 256
    vectors = np.tile(np.random.default_rng(7).normal(size=dims), (n, 1))
    keys = np.arange(n)
    ids = np.random.default_rng(8).permutation(n)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = list(nearest.tile(keys[:asked], vectors[:asked], keys, ids, vectors, 20))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024  # MB; the survivors' vectors would take 1074
    assert grown < 300 and len(found) == asked
    for i, own in found:
        assert [j for _, j in own] == [j for j in range(21) if j != ids[i]][:20] and len({s for s, _ in own}) == 1


def test_each_length_is_searched(spark):
    rnd = np.random.default_rng(5)
    by_length = {n: [(int(i), rnd.normal(size=n).tolist()) for i in range(at, at + count)] for n, at, count in ((24, 0, 200), (7, 200, 130), (1200, 340, 41), (3, 400, 1))}
    rows = [r for own in by_length.values() for r in own]
    want = sorted(x for own in by_length.values() for x in brute(own))
    assert {r[0] for r in want} >= {0, 200, 320, 340, 380} and run(spark, rows, query_block=5, candidate_block=37) == want


def test_query_like_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op4_nearest(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op4_nearest"]).fetchall())
    assert len(got) == 500
