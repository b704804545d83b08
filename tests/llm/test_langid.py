import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from noticeflow.llm import langid, queries

from .cases import awkward, nothing


def test_viterbi_like_brute_force():
    rnd = random.Random(6)
    for _ in range(200):
        n, k = rnd.randint(1, 6), rnd.randint(1, 3)
        scores = np.array([[rnd.uniform(-9, 0) for _ in range(k)] for _ in range(n)])
        value = lambda p, s=scores: sum(s[i, x] for i, x in enumerate(p)) - 4 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(value(p) for p in itertools.product(range(k), repeat=n))
        assert abs(value(langid.viterbi(scores, 4.0)) - best) < 1e-9


def model(spark):
    de = "der die das und nicht eine schön straße über zwischen haus gehen wird auch mit".split()
    en = "the and of that with have this house going through would which their about".split()
    ru = "и в не на что он как это дом идти будет также".split()
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(w, k=60)), lang) for i, (w, lang) in enumerate([(de, "de"), (en, "en"), (ru, "ru")] * 20)]
    return langid.train_on(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), de, en, ru


def test_spans_of_mixed_text(spark):
    m, de, en, ru = model(spark)
    rnd = random.Random(2)
    parts = [rnd.choices(w, k=30) for w in (de, en, ru, en)]
    text = " ".join(w for p in parts for w in p)
    single = " ".join(rnd.choices(de, k=50))
    spans, one, none = langid.Labeller(m).spans(pa.array([text, single, "12 !"]))
    assert [x[0] for x in spans] == ["de", "en", "ru", "en"]
    raw = text.encode()
    got = [raw[x[1] : x[2]].decode().split() for x in spans]
    assert sum(len(set(a) & set(b)) > 0 for a, b in zip(got, parts, strict=True)) == 4
    assert [abs(len(a) - 30) <= 3 for a in got] == [True] * 4
    assert [x[0] for x in one] == ["de"] and langid.verdict(none)[0] == "und"
    assert m.uses[langid.SCRIPTS.index("Cyrillic")].tolist() == [False, False, True]


def test_the_quick_test_never_hides_a_switch(spark):
    m, de, en, ru = model(spark)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice([de, en])[rnd.randrange(14)] for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    lab = langid.Labeller(m)
    for text, spans in zip(texts, lab.spans(pa.array(texts)), strict=True):
        path = langid.viterbi(m.scores(text.split())[0])
        want = [m.languages[k] for k, _ in itertools.groupby(path)]
        assert [x[0] for x in spans] == want


def test_other_scripts_and_small_table(spark, monkeypatch):
    m, de, _, _ = model(spark)
    monkeypatch.setattr(langid, "CACHE_WORDS", 2)
    lab = langid.Labeller(m)
    lab.index.BITS = 3
    lab._reset()
    a, b = lab.spans(pa.array([" ".join(de), "日本語 テスト 日本"]))
    assert langid.verdict(a)[:2] == ("de", 1.0)
    lang, score, known = langid.verdict(b)
    assert lang in m.languages and score == 0 and known == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = langid.predict(docs).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (0, 1, 2, 5, 6)] == ["und"] * 5 and by[9].lang_pred == "en"
    assert by[0].score == 0.0 and by[None].held_out is False
    assert langid.predict(nothing(spark)).count() == 0
    kept = langid.in_known_languages(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 4, 7, 8, 9, 9, 9]
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.predict(unlabelled).collect()} == {"und"}


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rnd = random.Random(8)
    letters = "bcdfghjklmnpqrstvwxz"
    foreign = [
        "Komisja postanowiła przełożyć posiedzenie, ponieważ wielu członków nie mogło być obecnych tego dnia z powodu strajku kolejarzy",
        "Komisyon toplantıyı ertelemeye karar verdi çünkü birçok üye o gün tren grevi nedeniyle hazır bulunamadı ve yeni tarih belli değil",
        " ".join("".join(rnd.choices(letters, k=rnd.randint(3, 9))) for _ in range(40)),
    ]
    mixed = " ".join(r.text[:300] for r in docs.orderBy("doc_id").limit(6).collect())  # of learned languages
    rows = [(10**9 + i, t, None, "s", len(t)) for i, t in enumerate([*foreign, mixed])]
    out = langid.in_known_languages(docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")))
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i >= 10**9) == [10**9 + 3] and len(ids) == docs.count() + 1  # labelled documents stay


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_langid(spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)
