from collections import defaultdict

import corpus_pipeline
from noticeflow.llm import pii

from .cases import awkward, nothing
from .test_minhash import brute as same_groups
from .test_packing import check as check_packing
from .test_suffixes import brute as repeated

SF = "/root/testdata/sf0.001"


def cut(text, points):
    out, gone = [], []
    for i, c in enumerate(text):
        (gone if i in points else out).append(c)
    return "".join(out)


def expected(docs):
    """(doc_id, text) after each stage but the last, by brute force on what the first one keeps."""
    groups = same_groups([(r.doc_id, r.text) for r in docs], 5)
    kept = [r for r in docs if dict((i, c) for i, _, c in groups)[r.doc_id] == r.doc_id]
    spans = repeated([(r.doc_id, r.text) for r in kept], 50)
    left = [(r.doc_id, cut(r.text, spans.get(r.doc_id, ()))) for r in kept]
    return [r.doc_id for r in kept], {i: t for i, t in left if t.strip() or i not in spans}


def test_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs, SF)
    rows = first.collect()
    assert first.columns == columns and len(rows) == docs.count()  # all of these are in a language
    kept, texts = expected(rows)
    second = stages["near_dup"](spark, first, SF).cache()
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(kept)
    third = stages["repeats"](spark, second, SF).cache()
    assert third.columns == columns and {r.doc_id: r.text for r in third.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in third.collect() if texts[r.doc_id] != next(x.text for x in rows if x.doc_id == r.doc_id))
    fourth = stages["private"](spark, third, SF).cache()
    assert fourth.columns == columns and {r.doc_id: r.text for r in fourth.collect()} == {i: pii.redacted(t) for i, t in texts.items()}
    check_packing(fourth, corpus_pipeline.run(spark, SF).collect(), 2048)


def test_null_and_repeated_ids_are_grouped_by_text(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    copy, near, shared = words("a", 80), words("b", 300), words("s", 60)
    rows = [(None, copy)] * 3 + [(5, copy)] * 2  # exact copies: 5 is the first
    rows += [(None, near), (9, near + " b"), (9, "c " + near)]  # near copies of null and equal ids
    rows += [(None, f"{words('x', 200)} {shared} {words('y', 200)}"), (None, f"{words('z', 200)} {shared}")]
    rows += [(7, f"{words('v', 200)} {words('w', 60)}"), (7, f"{words('u', 200)} {words('w', 60)}"), (None, None), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near_dup"](spark, docs, SF).cache()
    assert one.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert len(kept) == 9 and [i for i, t in kept if t == copy] == [5] and [i for i, t in kept if t and "b299" in t] == [9]
    assert kept.count((None, None)) == 2 and (8, "") in kept
    left = stages["repeats"](spark, one, SF).cache()
    texts = [r.text or "" for r in left.collect()]
    assert left.columns == docs.columns and len(texts) == 9
    assert [sum(w in t.split() for t in texts) for w in ("s0", "s59", "w0", "w59", "x0", "y0", "z0", "u0", "v0")] == [1] * 9


def test_awkward_rows(spark):
    for docs in (awkward(spark), nothing(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == columns
        by = defaultdict(int)
        for r in docs.collect():
            by[r.sequence_id] += r.length
        assert all(n <= 2048 for n in by.values())
