import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from noticeflow.llm import bpe, queries

from .cases import awkward, nothing

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    e = bpe.encoder(PATH)
    for text, (ids, labels), want in zip(texts, e.batch(pa.array(texts)), library.encode_batch(texts, add_special_tokens=False), strict=True):
        decoded = library.decode(want.ids, skip_special_tokens=False)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want.ids, text
        assert labels.decode() == decoded, text
        assert e.decode(ids) == decoded
        assert e.one(text) == (ids, labels), text
    assert [x for x, _ in e.batch(pa.array(texts), with_labels=False)] == [x for x, _ in e.batch(pa.array(texts))]


def test_like_the_library_on_odd_texts(library):
    same(library, ["", "aaaa", "abababab", "!!!!!!!", "don't I'LL 'sat ''s \"'s 'r l've", "<|endoftext|>a <|startoftext|>", "İstanbul ΣΑΣ", "日本語", "🙂🙂", "a b\x1cc\x85d", "½ ² ٣", "ﬁ ǅ", "नमस्ते", "é é", "×÷", "x" * 5000])


def test_like_the_library_on_random_words(library):
    rnd = random.Random(5)
    for alphabet in ("ab", "aetn", "abehtino!'#é 1", "!?.-'"):
        same(library, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(800)])


def test_like_the_library_in_all_scripts(library):
    rnd = random.Random(6)
    marks = ["<|endoftext|\u0338>\u0338 \u0338", "<|endoftext|><|startoftext|>\u2019s it\u2019s", "\u0301a", "e\u0301\u0323 \u1eb9\u0301 \u00e9\u0323", "\u1100\u1161\u11a8 \u1112\u1161", "K\u212a \u212b", "\u00a0\u3000x\u200b", "<|endoftext|", "text|> <|endof", "a" * 400 + " " + "\u4e00" * 300]
    same(library, marks)
    blocks = [(0x20, 0x7F), (0xA0, 0x180), (0x300, 0x370), (0x400, 0x500), (0x900, 0x980), (0x1100, 0x1200), (0x2000, 0x2070), (0x4E00, 0x5000), (0x1F600, 0x1F650)]
    for a, b in blocks:
        same(library, ["".join(chr(rnd.randrange(a, b)) if rnd.random() < 0.8 else rnd.choice(" e'\u2019\u0301") for _ in range(rnd.randint(1, 50))) for _ in range(300)])
    same(library, ["".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(500)])


def test_one_way_for_all_texts(library):
    """What a chunk holds besides doesn't change a text's tokens."""
    texts = ["plain words", "caf\u00e9 d'\u00e9t\u00e9", "\u201cquoted\u201d it\u2019s", "\u65e5\u672c\u8a9e \U0001f642", "", "<|endoftext|>"]
    e = bpe.encoder(PATH)
    assert list(e.batch(pa.array(texts))) == [next(e.batch(pa.array([t]))) for t in texts]
    assert list(e.batch(pa.array(texts[::-1])))[::-1] == list(e.batch(pa.array(texts)))


def test_arcs_like_merging():
    """The compiled automaton against merging pair by pair, over all short words of a small vocabulary."""
    rnd = random.Random(7)
    for _ in range(20):
        names = [(bytes([b]), end) for b in b"ab" for end in (False, True)]
        merges, seen = [], set()
        for _ in range(8):
            a, b = rnd.choice([i for i, n in enumerate(names) if not n[1]]), rnd.randrange(len(names))
            name = (names[a][0] + names[b][0], names[b][1])
            if name not in names and (a, b) not in seen:
                seen.add((a, b))
                names.append(name)
                merges.append((a, b, len(names) - 1))
        automaton = bpe.Automaton(names, merges)
        words = [bytes(w) for n in range(1, 9) for w in itertools.product(b"ab", repeat=n)]
        states, ends = automaton.encode(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
        for w, path in zip(words, np.split(states, ends[:-1]), strict=True):
            tokens = [names.index((bytes([c]), i == len(w) - 1)) for i, c in enumerate(w)]
            for a, b, c in merges:
                at = 0
                while at < len(tokens) - 1:
                    if tokens[at : at + 2] == [a, b]:
                        tokens[at : at + 2] = [c]
                    at += 1
            assert path.tolist() == tokens


def test_small_word_table(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_ARCS", 5)
    monkeypatch.setattr(bpe.WordTable, "BITS", 4)
    monkeypatch.setitem(bpe._ENCODERS, PATH, bpe.Encoder(PATH))
    same(library, ["one two three four five six seven", "eight nine ten eleven one", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))])


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    got = bpe.encode(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(([*r][:4] for r in got.collect()), key=key) == sorted(map(list, want), key=key)
    assert bpe.encode(nothing(spark)).count() == 0


def test_query(spark, library):
    rows = queries.op6_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
