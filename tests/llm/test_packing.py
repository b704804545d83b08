import random
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

from noticeflow.llm import bpe, packing, queries

from .cases import awkward, nothing


def one_by_one(lengths, capacity):
    """Best-fit decreasing: the number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def filled(rows, capacity):
    """Checks that sequences are gapless; their number."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_as_few_as_one_by_one():
    rnd = random.Random(3)
    for _ in range(200):
        capacity = rnd.choice([5, 17, 64])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))]
        histogram = defaultdict(int)
        for n in lengths:
            histogram[n] += 1
        bins = defaultdict(list)
        for length, a, b, first, offset, each in packing.best_fit(histogram, capacity):
            for i in range(b - a):
                bins[first + i // each].append((offset + i % each * length, length))
        assert sorted(x for own in bins.values() for _, x in own) == sorted(lengths)
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) == one_by_one(lengths, capacity)


def check(docs, rows, capacity):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want, lengths = defaultdict(list), []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[r.doc_id, k, at].append((len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
            lengths.append(len(own))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start].append((r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert filled(rows, capacity) == one_by_one(lengths, capacity)


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs, packing.pack(docs, 64).collect(), 64)
    assert packing.pack(nothing(spark)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{sf}/documents.parquet"), queries.op7_packing(spark, sf).collect(), 2048)


def test_supersteps_on_executors_like_in_one_process(spark):
    rnd = random.Random(8)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[rnd.choice([rnd.randint(1, 2047), rnd.randint(1, 40), 700])] += 1
    rows = packing.placements(spark, histogram, 2048).collect()
    assert sorted((r.size, r["rank"], r["rank"] + r.n, r["first"], r.offset, r.each) for r in rows) == sorted(packing.best_fit(histogram, 2048))
    assert packing.placements(spark, {}, 2048).count() == 0


def test_few_sequences():
    """As many as one-by-one best-fit decreasing, and near the least that the tokens need."""
    rnd = random.Random(9)
    lengths = [rnd.randint(1, 2047) for _ in range(3000)] + [rnd.randint(1, 60) for _ in range(3000)]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    used = {first + i // each for _, a, b, first, _, each in packing.best_fit(histogram, 2048) for i in range(b - a)}
    assert len(used) == one_by_one(lengths, 2048) <= -(-sum(lengths) // 2048) * 1.01
