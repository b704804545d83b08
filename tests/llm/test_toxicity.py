import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from noticeflow.llm import queries, toxicity
from noticeflow.llm.common import split_words

from .cases import CLASH, LONG, awkward, nothing

INSULTS = ["idiot", "moron", "clown", "worthless"]


def corpus(n, seed=0):
    """Documents of invented words; every fourth is toxic."""
    rnd = np.random.default_rng(seed)
    syllables = ["ta", "ber", "lin", "or", "the", "min", "sa", "cre", "dow", "pel"]
    word = lambda: "".join(rnd.choice(syllables, rnd.integers(1, 4)))
    rows = []
    for i in range(n):
        toxic = int(i % 4 == 0)
        sentences = []
        for _ in range(rnd.integers(3, 9)):
            own = [word() for _ in range(rnd.integers(4, 12))]
            if toxic and (rnd.random() < 0.4 or not sentences):
                own[rnd.integers(0, len(own))] = str(rnd.choice(INSULTS))
            sentences.append(" ".join(own) + ".")
        rows.append((i, " ".join(sentences), toxic))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    return docs, labels


def cosine(a, b):
    """The kernel of two strings from all their subsequences."""

    def weights(s):
        out = {}
        for places in itertools.combinations(range(len(s)), toxicity.ORDER):
            letters = "".join(s[i] for i in places)
            if places[-1] - places[0] < toxicity.SPAN and toxicity.GAP not in letters:
                out[letters] = out.get(letters, 0) + toxicity.DECAY ** (places[-1] - places[0] + 1 - toxicity.ORDER)
        return out

    x, y = weights(a), weights(b)
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / size if size else 0.0


def test_kernel_like_all_subsequences(monkeypatch):
    words = ["idiot", "id-iot", "idiots", "Banana", "a", "ñandú", "ab.cd.ef", "élève", "xyzzyxyzzy", "😀ab𝒳cd"]
    strings = [s for w in words for s in toxicity.strings_of(w)]
    landmarks = [toxicity.strings_of(w)[0] for w in ("idiot", "banana", "xyzzy", "élève", "a")]
    want = np.array([[cosine(s, t) ** toxicity.POWER for t in landmarks] for s in strings])
    assert np.allclose(toxicity.Kernel(landmarks)(strings), want, atol=1e-5)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(toxicity.Kernel(landmarks)(strings), want, atol=1e-5)


def test_strings_of_words():
    a, b = toxicity.START, toxicity.END
    own = lambda w: [s.replace(a, "^").replace(b, "$").replace(toxicity.GAP, "_") for s in toxicity.strings_of(w)]
    assert own("(Idiot!)") == ["^idiot$"] and own("id-iot") == ["^id_iot$", "^iot$"] and own("i.d.i.o.t") == own("i d i o t") == ["^idiot$"]
    assert own("123") == own("---") == [] and own("ab1cd") == ["^ab_cd$"]
    long = own("x" * 70)
    assert all(len(s) <= toxicity.WINDOW for s in long) and "".join(long).count("$") == 1 and len(long) > 2


def test_sentences_and_spelled_out_words():
    words = split_words(pa.array(["a b. c d\ne", "", "i d i o t", "x", "y z " + "w1 " * 30]))
    starts, ends, sentence, cuts, first = toxicity.units(words)
    text = words.data.tobytes()
    units = {(text[s:e].decode(), k) for s, e, k in zip(starts.tolist(), ends.tolist(), sentence.tolist(), strict=True)}
    assert ("i d i o t", 3) in units and not any(t.startswith("x y") for t, _ in units)  # not across texts
    assert np.diff(cuts).tolist() == [3, 0, 1, 1, 3] and len(first) == 8


def test_learns_and_finds_gapped_insults(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    extra = ["ta berlin {} or the mintasa.", "{} thesa cre dow. pelor ta the {} min."]
    forms = ["idiot", "IDIOT", "id-iot", "i.d.i.o.t", "i d i o t", "(moron)", "mo*ron", "c l o w n", "worth-less"]
    more = [(10_000 + i, e.format(f, f), None) for i, (e, f) in enumerate(itertools.product(extra, forms))]
    clean = [(20_000 + i, t, None) for i, (_, t, toxic) in enumerate(corpus(200, seed=9)) if not toxic]
    all_docs = docs.union(spark.createDataFrame([r[:2] for r in more + clean], docs.schema))
    got = {r.doc_id: r for r in toxicity.score(all_docs, labels).collect()}
    assert len(got) == len(rows) + len(more) + len(clean)
    for i, _, toxic in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == toxic == int(got[i].score >= 0.7)
    # gaps cost some of the margin: each is found, and above all clean documents, most beyond the bound too
    assert all(got[i].n_toxic >= 1 for i, _, _ in more) and sum(got[i].predicted for i, _, _ in more) >= len(more) * 3 // 4
    assert not any(got[i].predicted for i, _, _ in clean)
    assert min(got[i].score for i, _, _ in more) > max(got[i].score for i, _, _ in clean)
    assert "moron" in got[10_005].worst
    # labels of held-out documents change nothing
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    again = {r.doc_id: r.score for r in toxicity.score(all_docs, turned).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_awkward_rows(spark):
    rows = corpus(60)
    docs, labels = frames(spark, rows)
    extra = spark.createDataFrame([(None, 1), (3, None), (3, 0), (3, 0)], "doc_id bigint, toxic int").selectExpr("doc_id", "toxic", *(f"1 as `{c}`" for c in CLASH))
    labels = labels.selectExpr("doc_id", "toxic", *(f"1 as `{c}`" for c in CLASH)).union(extra)
    odd = awkward(spark).selectExpr("doc_id + 1000 as doc_id", "text", "score", "rank")
    got = toxicity.score(docs.selectExpr("doc_id", "text", "1 as score", "2 as rank").union(odd), labels).collect()
    assert len(got) == 60 + 13 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1002].score and by[1000].n_sentences == 0 and by[1000].worst is None
    assert not any(r.held_out for r in got if r.doc_id is None) and by[1007].n_sentences >= len(LONG.split()) // 12
    assert toxicity.score(nothing(spark), labels).collect() == []


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(0, 0), (3, 0)], 0.0), ([(0, 1), (3, 1)], 1.0)])
def test_labels_of_one_kind(spark, labels, score):
    docs = awkward(spark)
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == 13 and {r.score for r in got} == {score}


def test_tables_that_are_full(monkeypatch):
    rows = corpus(80)
    docs = np.arange(80)
    kernel, weights, bias = toxicity.fit([t for _, t, _ in rows], docs, np.array([y for *_, y in rows]))
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows])], ["text"])
    want = toxicity.sentences_of(batch, toxicity.Scorer(kernel, weights), bias)[:3]
    assert want[0].sum() > 20
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 5)
    monkeypatch.setattr(toxicity.HashIndex, "BITS", 3)
    small = toxicity.Scorer(kernel, weights)
    for i in [*range(80), *range(80)]:
        got = toxicity.sentences_of(batch.slice(i, 1), small, bias)[:3]
        assert all(np.isclose(g[0], w[i]) for g, w in zip(got, want, strict=True))


def test_held_out_documents_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    df = queries.op13_toxicity(spark, sf)
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = dict(tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    held = [(labels[r.doc_id], r.predicted) for r in df.collect() if r.held_out and r.doc_id in labels]
    caught = sum(p for y, p in held if y) / sum(y for y, _ in held)
    wrong = sum(p for y, p in held if not y) / sum(1 - y for y, _ in held)
    assert caught >= 0.85 and wrong <= 0.02, (caught, wrong)  # some toxic labels stand on texts without any insult
