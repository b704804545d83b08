import os
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeflow.llm import common


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB é日\n\t\x0b\x1c!", max_size=30), max_size=6))
def test_words_and_hashes(texts):
    w = common.split_words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    raw = w.data.tobytes()
    got = [raw[s:e].decode() for s, e in zip(w.starts, w.ends, strict=True)]
    assert got == [x for own in want for x in own] and np.diff(w.first).tolist() == [len(x) for x in want]
    by = {}
    for word, h in zip(got, w.hashes().tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_sliced_arrays_and_chunks():
    texts = pa.array(["zero", "one two", None, "three", "x" * 50])
    assert len(common.split_words(texts.slice(1, 2)).starts) == 2
    batch = pa.record_batch([texts.slice(1), pa.array([1, 2, 3, 4])], ["text", "i"])
    parts = list(common.chunks(batch, most=8))
    assert [x for p in parts for x in p.column("i").to_pylist()] == [1, 2, 3, 4] and len(parts) == 3


def test_hash_index():
    rnd = np.random.default_rng(2)
    index = common.HashIndex()
    index.BITS = 6
    index.clear()
    keys = rnd.integers(1, 2**63, 40).astype(np.uint64)
    assert [index.put(k) for k in keys.tolist()] == list(range(40)) and not index.room(20)
    assert index.find(np.concatenate([keys, keys[:3] + np.uint64(1)])).tolist() == [*range(40), -1, -1, -1]


def test_hash_index_takes_many_at_once():
    rnd = np.random.default_rng(3)
    index = common.HashIndex(7)
    keys = np.unique(rnd.integers(1, 40, 60)).astype(np.uint64) * np.uint64(128)  # all want one slot
    assert index.put_many(keys[:5]).tolist() == list(range(5)) and index.put_many(keys[5:]).tolist() == list(range(5, len(keys)))
    assert index.find(keys).tolist() == list(range(len(keys))) and index.n == len(keys)


def test_powers_of_long_texts_are_not_kept():
    powers = common.Powers(0x9E3779B97F4A7C15)
    for n in (10, common.Powers.KEPT, 3 * common.Powers.KEPT):
        up, down = powers.upto(n)
        assert len(up) >= n and (up[:n] * down[:n] == 1).all() and len(powers.held[0]) <= common.Powers.KEPT


def test_own_folder_only_where_none_is_set(spark):
    assert common.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = common.materialize(spark.range(5), "x")
    assert df.inputFiles()[0].removeprefix("file://").startswith(common.scratch_dir(spark)) and df.count() == 5


def test_scratch_tables_go_but_for_those_to_keep(spark):
    with common.scratch(spark):
        gone = common.materialize(spark.range(5), "x")
        kept = common.materialize(gone, "y", keep=True)
        path = os.path.dirname(gone.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(path)
    assert not os.path.exists(os.path.dirname(path)) and kept.count() == 5
    after = common.materialize(spark.range(3), "z")
    assert os.path.dirname(path) not in after.inputFiles()[0] and after.count() == 3
