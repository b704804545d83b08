import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from noticeflow.llm import alignment, queries
from noticeflow.llm.bpe import byte_symbols

from .cases import awkward, nothing

PATHS = alignment.default_vocabularies()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def one(libraries, text):
    """The groups and the links of a whole text, byte by byte; None where there are no tokens."""
    a, b = libraries
    if not text:
        return None
    byte_of = {c: i for i, c in enumerate(byte_symbols())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    owner_a, owner_b = ([i for i, x in enumerate(own) for _ in x] for own in (bytes_a, bytes_b))
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    groups, group = [], ([], [])
    for at, (i, j) in enumerate(zip(owner_a, owner_b, strict=True)):
        last_a, last_b = (at + 1 == len(o) or o[at + 1] != o[at] for o in (owner_a, owner_b))
        if last_a:
            group[0].append(ids_a[i])
        if last_b:
            group[1].append(ids_b[j])
        if last_a and last_b:
            groups.append("|".join(",".join(map(str, x)) for x in group))
            group = ([], [])
    return ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]


def brute(libraries, rows):
    found = [(i, one(libraries, t)) for i, t in rows]
    counts = Counter(x for _, own in found if own for x in own[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, own in found:
        if own is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = own
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


STRANGE = ["a", " a", "a ", "a  ", "  a  b", "\n\na \n b", "a\t b\r\n c", "é é ﬁ ①  x 　 y  z", "<|endoftext|> <s>x</s> <0x41> <unk>", "x ▁ y", "▁", " ", "\n", "it's 'tis we'll  'S", "日本語 テキスト と text", "😀 👩‍👩‍👧 é", "1234567 89 000", "a\u0085 b   c", "\x00 \x1f b", "ab" * 3000, "#### **x** |---| ...", "don’t “x” — y…  z"]


def test_strange_texts_like_the_libraries(spark, libraries):
    rows = [(i, t) for i, t in enumerate(STRANGE)]
    rnd = np.random.default_rng(1)
    signs = np.array(list("abé's  \n\t 　’1▁ß日."))
    rows += [(100 + i, "".join(signs[rnd.integers(0, len(signs) - 4 * (i % 2), rnd.integers(1, 60))])) for i in range(300)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), with_groups=True).collect()
    assert order(r[:8] for r in got) == order(brute(libraries, rows))
    for r in got:
        own = one(libraries, dict(rows)[r.doc_id])
        assert r.groups == (";".join(own[2]) if own else "")
    assert sum(r.n_a > 0 for r in got) > 150 and sum(r.n_a == 0 for r in got) > 20


def test_awkward_rows(spark, libraries):
    docs = awkward(spark)
    df = alignment.align(docs, with_groups=False)
    assert df.columns == COLUMNS
    assert order(df.collect()) == order(brute(libraries, [(r.doc_id, r.text) for r in docs.collect()]))
    assert alignment.align(nothing(spark)).collect() == []


def test_bytes_that_are_no_text(libraries):
    broken = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 4, 6], np.int32)), pa.py_buffer(b"a \xffbok")])
    found = list(alignment.Aligner(*PATHS).texts(broken, True))
    assert found[0][:3] == ([0, 0, 0, 0], b"", b"") and found[1][0][0] > 0


def test_blocks_of_a_text_and_small_tables(libraries, monkeypatch):
    texts = [" ".join(f"word{i % 37} été{i % 5}" for i in range(700)), "x", "tail of it"]
    whole = list(alignment.Aligner(*PATHS).texts(pa.array(texts), True))
    monkeypatch.setattr(alignment, "BLOCK", 7)
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 3)
    monkeypatch.setattr(alignment.Segments, "BITS", 3)
    small = alignment.Aligner(*PATHS)
    for _ in range(2):
        again = [x for t in texts for x in small.texts(pa.array([t]), True)]
        for a, b in zip(whole, again, strict=True):
            assert a[:3] == b[:3] and (a[3] == b[3]).all() and (a[4] == b[4]).all()


def test_sums_beyond_what_a_partition_holds(spark, libraries, monkeypatch):
    rows = [(i, f"word{i % 50} and {i % 7} more") for i in range(200)]
    encoded = alignment.encode(spark.createDataFrame(rows, "id bigint, text string"), *PATHS, False)
    want = Counter((b << 32) | a for _, t in rows for a, b in one(libraries, t)[3])
    got = alignment.pair_counts(encoded).collect()
    assert {r.key: r.n for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(alignment, "HELD_KEYS", 20)
    monkeypatch.setattr(alignment, "HELD_SUMS", 10)
    assert {r.key: r.n for r in alignment.pair_counts(encoded).collect()} == want


def test_shards_are_found_and_copied(tmp_path, monkeypatch):
    keys, counts = np.array([3, 9, 12, 2**40], np.int64), np.array([5, 1, 7, 2], np.int64)
    for i, cut in enumerate((slice(0, 2), slice(2, 4))):
        keys[cut].tofile(tmp_path / f"{i}.keys")
        counts[cut].tofile(tmp_path / f"{i}.counts")
    found = [(f"{tmp_path}/1", 12, 2**40), (f"file:{tmp_path}/0", 3, 9)]
    assert alignment.Shards(found).counts(np.array([3, 12, 2**40])).tolist() == [5, 7, 2]
    # a file system that isn't local: by a copy without a name
    local = pa.fs.LocalFileSystem()
    monkeypatch.setattr(alignment, "place", lambda p: (pa.fs.SubTreeFileSystem(str(tmp_path), local), p.rsplit("/", 1)[-1]))
    assert alignment.mapped(f"far://x/1.counts").tolist() == [7, 2]


def test_query_like_the_libraries_on_a_whole_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    df = queries.op12_alignment(spark, sf)
    assert df.dtypes == [(c, "bigint") for c in COLUMNS[:-1]] + [("groups_sha256", "string")]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert order(df.collect()) == order(brute(libraries, docs))
