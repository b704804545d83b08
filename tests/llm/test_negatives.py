import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import negatives, queries


def brute(rows, positives=5, negatives=10):
    good = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (a, y, v) in enumerate(good):
        if a % 100 == 0:
            scores = [(-sum(x * z for x, z in zip(v, w, strict=True)), i, label) for other, (i, label, w) in enumerate(good) if other != at and len(w) == len(v)]
            for s, p, _ in sorted(x for x in scores if x[2] == y)[:positives]:
                fit = sorted(x for x in scores if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
                out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, 2, 3, 4) for i, v, y in rows], "vec_id bigint, embedding array<double>, label int, rank int, id int, key int")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.mark.parametrize("scale", [0.1, 1.0, 40.0, 1e5])
def test_like_brute_force_over_many_tiles(spark, scale):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(600, 16)) * scale + 0.1 * scale
    x[150:260] = x[100]  # a large group of copies
    x[300:380] = 0
    y = rnd.integers(0, 4, 600)
    y[120:320] = 1  # a label with a third of all rows
    rows = [(i % 510, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]  # ids repeat
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows, anchor_block=3, row_block=41) == want == run(spark, rows)


def test_intervals_hold_and_tighten():
    rnd = np.random.default_rng(4)
    anchors, rows = rnd.integers(-300, 300, (20, 32)), rnd.integers(-500, 500, (70, 32))
    truth, widths = anchors @ rows.T, []

    def keep(low, high):
        assert (low <= truth).all() and (truth <= high).all()
        widths.append(float((high - low).max()))
        return np.ones(low.shape, bool)

    i, j, scores = negatives.bounded(anchors, rows, keep, np.zeros(truth.shape, bool))
    assert (scores == truth[i, j]).all() and len(i) == truth.size
    assert len(widths) == 4 and widths == sorted(widths, reverse=True) and widths[-1] == 0  # 10 planes: 4, 2, 2, 2


def test_pairs_go_before_the_last_plane():
    rnd = np.random.default_rng(5)
    anchors, rows = rnd.integers(-60, 60, (8, 64)), rnd.integers(-200, 200, (4000, 64))
    rows[:20] += 3 * anchors[0]
    alive = []

    def keep(low, high):
        out = high >= negatives.kth(low, 5)
        alive.append(int((out & np.isfinite(low)).sum()))
        return out

    negatives.bounded(anchors, rows, keep, np.zeros((8, 4000), bool))
    assert alive[0] < 32000 * 0.7 and alive[-1] <= 8 * 5 + 8 and alive == sorted(alive, reverse=True)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [0.5, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (2, [0.5, 1.0], 2), (3, [0.4, 1.1], 3), (3, None, 2), (4, [], 1), (200, [], 1), (5, [], 2), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (None, [1.0, 1.0], 2), (9, [0.6, 1.0], None), (300, [-1.0, 0.0], 4), (301, [1.0, 0.0], 4), (302, [1.0], 5), (100, [0.5, 2.0], 1)]
    got = run(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {0, 100, 200}
    assert run(spark, rows + [(10, [1e300, 1.0], 2), (11, [3e6, 3e6], 2)]) == got  # the last two's products need not fit a long
    assert run(spark, rows[:0]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_query_like_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.op11_negatives(spark, sf)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    got = sorted(tuple(r) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op11_negatives"]).fetchall()) and len(got) > 100
