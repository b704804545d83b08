import random
import re

import numpy as np
import pytest

from noticeflow.llm import queries, suffixes

from .cases import LONG, awkward, nothing


def brute(rows, m):
    """doc_id -> set of code points that stand in a run seen before, by looking at every run."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = [(x.start(), x.end(), x[0]) for x in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for i in range(len(words) - m + 1):
            run = tuple(w for _, _, w in words[i : i + m])
            if run in seen:
                out.setdefault(doc, set()).update(range(words[i][0], words[i + m - 1][1]))
            seen.add(run)
    return out


def points(spans):
    out = {}
    for r in spans:
        own = out.setdefault(r.doc_id, set())
        assert not own & set(range(r.start, r.end))
        own.update(range(r.start, r.end))
    return out


def corpus(rnd, n):
    words = lambda k: [f"é{rnd.randint(0, 3000)}" for _ in range(k)]
    passages = [words(k) for k in (49, 50, 51, 60, 90, 200)]
    docs = []
    for _ in range(n):
        parts = [words(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "other"
            parts += [p, words(rnd.randint(0, 30))]
        docs.append(rnd.choice(["  ", " ", "\n"]).join(w for p in parts for w in p))
    return docs + docs[:6] + [" ".join(["same"] * 300), " ".join(["x", "y"] * 90)]


@pytest.mark.parametrize("parts", [1, 7])
def test_like_brute_force(spark, parts):
    rows = list(enumerate(corpus(random.Random(parts), 60)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts * 3))
    spans = suffixes.repeats(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert points(spans) == brute(rows, 50)
    texts = dict(rows)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for r in spans:
        assert split(texts[r.doc_id][r.start : r.end]) == split(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        assert split(texts[r.doc_id])[r.first_word : r.first_word + 50] == split(texts[r.from_doc_id])[r.from_word : r.from_word + 50]
        assert (r.from_doc_id, r.from_word) < (r.doc_id, r.first_word)


def test_minimisers_cover_every_run():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**60, 500).astype(np.uint64)
    first = np.array([0, 30, 79, 129, 400, 500])
    place, _, lo, n = suffixes.minimisers(h, first)
    runs = [r for a, b in zip(lo, n, strict=True) for r in range(a, a + b)]
    assert runs == [s for a, b in zip(first[:-1], first[1:], strict=True) for s in range(a, b - 49)]
    assert (place >= lo + n - 1).all() and (place <= lo + 34).all()


def test_places_grow_with_the_text(monkeypatch):
    h = np.random.default_rng(2).integers(0, 2**60, 3000).astype(np.uint64)
    want = suffixes.minimisers(h, np.array([0, 3000]))
    monkeypatch.setattr(suffixes, "PLACE_BITS", 1)
    assert all((a == b).all() for a, b in zip(want, suffixes.minimisers(h, np.array([0, 3000])), strict=True))


def test_awkward_rows(spark):
    docs = awkward(spark)
    spans = suffixes.repeats(docs).collect()
    assert points(spans) == brute([(i, t) for i, t in [(7, LONG), (8, LONG)]], 50)
    assert suffixes.repeats(nothing(spark)).collect() == []
    left = suffixes.without_repeats(docs, length_col="n_chars")
    assert left.columns == docs.columns
    out = {r.doc_id: r for r in left.collect()}
    assert 8 not in out and out[0].text is None and out[1].text == "" and out[9].text == "the cat sat on the mat"
    assert left.count() == docs.count() - 1
    assert len(out[7].text) == out[7].n_chars < len(LONG)


def test_rows_of_one_id_have_their_own_cuts(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    shared = words("s", 60)
    rows = [(1, f"{shared} {words('a', 30)}", 1), (2, f"{words('b', 30)} {shared}", 2), (2, f"{words('c', 200)}", 3), (2, words("d", 9), 4), (None, f"{words('e', 5)} {shared}", 5), (None, words("f", 70), 6), (None, words("f", 70), 7)]
    docs = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], "doc_id bigint, text string, n int, _cuts int, _of int, _row int, _ROW_ int").repartition(3)
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.n: r.text.strip() for r in out.collect()}
    assert len(texts) == 6 and texts.pop(6, None) or texts.pop(7, None) == words("f", 70)
    assert texts == {1: rows[0][1], 2: words("b", 30), 3: rows[2][1], 4: rows[3][1], 5: words("e", 5)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert points(queries.op10_suffixes(spark, sf).collect()) == brute(rows, 50)
