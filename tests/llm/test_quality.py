import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeflow.llm import quality, queries

from .cases import awkward, nothing

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é#\n\t日", max_size=60), max_size=4))
def test_counts_like_the_plain_way(texts):
    got = quality.text_counts(pa.array([*texts, None], pa.string()))
    assert [tuple(int(got[c][i]) for c in BASE) for i in range(len(texts) + 1)] == [plain(t) for t in [*texts, None]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZéÉжЖ日한ß€😀。「#7 \n", max_size=40), max_size=4))
def test_letters_are_those_of_unicode(texts):
    got = quality.text_counts(pa.array([*texts, None], pa.string()))
    for i, t in enumerate([*texts, ""]):
        letters = [c for c in t if c.isalpha()]
        with_letter = [x for x in t.split() if any(c.isalpha() for c in x)]
        assert (got["n_letters"][i], got["n_upper"][i], got["n_letter_words"][i]) == (len(letters), sum(c.isupper() for c in letters), len(with_letter))


def test_signs_and_emoji_are_junk_and_other_scripts_are_not(spark):
    good = [f"Слово номер {'абвгдежзик'[i % 10]}{i} стоит в этом длинном предложении, и оно ничем не плохо." for i in range(40)]
    junk = " ".join(f"😀€{i} 「。」{i} ₽₽{i}" for i in range(40))
    shout = " ".join(f"{'ЩЖБДГЛ'[i % 6] * 4} ÉÀÇ{i}" for i in range(60))
    rows = [*enumerate(good), (100, junk), (101, shout)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("kept").collect()}
    assert kept == set(range(40))


def test_estimation_finds_accuracies_and_classes():
    rnd = np.random.default_rng(7)
    good = rnd.random(40_000) < 0.75
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rnd.random(len(good)) < 0.3, 0, np.where((rnd.random(len(good)) < r) == good, 1, -1)) for r in right], axis=1)
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, chances = quality.estimate(patterns, n.astype(float), [0.8] * 5)
    assert abs(share - 0.75) < 0.03
    for i, r in enumerate(right):
        assert abs(chances[i, 1, 2] / (chances[i, 1, 0] + chances[i, 1, 2]) - r) < 0.05
    kept = quality.posterior(patterns, share, chances)[which.reshape(-1)] >= 0.5
    assert (kept == good).mean() > 0.9


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = quality.judge(docs).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        assert tuple(r[c] for c in BASE) == plain(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(nothing(spark)).count() == 0


def test_query_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in BASE) == plain(texts[r.doc_id])
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    print(sum(good) / len(good), sum(bad) / len(bad))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)
