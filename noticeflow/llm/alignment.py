"""Operator 12: alignment of the tokens of two tokenizers, with corpus-wide counts of linked ids.

A space and a text are encoded by A (byte-level BPE) and, the space being B's own, by B (BPE of pieces).
Both cut before a single space that follows a character that isn't white: A's splitter starts a word
there, and no piece of B's has a space after another character (checked when the vocabulary is read).
So a text is a sequence of such segments, each is encoded by itself, and a worker keeps what it found
for each: token counts, the groups as text, and the links as packed keys, B's id in the upper half of
an int64 and A's in the lower. A link is a stretch between neighbouring ends of either tokenizer's
tokens, as two tokens overlap in one stretch or not at all; a group is a stretch between common ends.

    encoded   a row for each document, written once: counts, hash, its distinct keys and their numbers
    partials  np.unique over a partition's keys: key, n; a row a key for each partition
    shards    partials range-partitioned and sorted by key, their runs summed; each partition writes a
              file of sorted keys and one of counts to shared storage and returns a row about it. A
              frequent key has a row for each partition of the step before, however frequent it is
    lookup    each partition of `encoded` memory-maps the shards and finds its keys by searchsorted

The driver reads a row for each shard, and the highest count for each id of B: the vocabulary's size.

Defined results: a text that is null, empty, not UTF-8, or of which a tokenizer's bytes differ from
space and text (as where the text holds U+2581, B's mark for a space) has no tokens: zeros and ''. Ids
aren't looked at: null and repeated ones are rows like others. Memory is bounded by BLOCK segments of
a text and a text's distinct keys.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

from .bpe import byte_symbols, gather
from .common import Growing, HashIndex, chunks, columns, give_back, materialize, scratch_dir, span_hashes, text_bytes

#: Segments that a worker keeps: the table is emptied at the first chunk after it holds more.
CACHE_SEGMENTS = 500_000
#: Segments of one text whose groups and links are put together at once.
BLOCK = 1 << 16
#: Keys that a partition holds before they are summed, and sums it holds before they are given out.
HELD_KEYS, HELD_SUMS = 1 << 22, 1 << 21
SPACE_MARK = "▁"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def flat_table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])


def numbers(n: int, between: str, last: str) -> tuple[np.ndarray, np.ndarray]:
    """Row 2 i + (is the last) is id i and what follows it."""
    return flat_table([f"{i}{x}".encode() for i in range(n) for x in (between, last)])


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments start: at texts (which start with a space each) and at spaces after a character
    that isn't white. Three-byte characters from U+1000 to U+3FFF count as white, as some are."""
    n = len(data)
    before = np.concatenate([np.zeros(3, np.uint8), data[: n - 1]]) if n else np.zeros(3, np.uint8)
    one, two, three = before[2 : n + 2], before[1 : n + 1], before[:n]
    white = (one <= 0x20) | (one >= 0x80) & ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3))
    starts = (data == 0x20) & ~white
    starts[offsets[:-1]] = True
    return np.flatnonzero(starts)


class Segments(HashIndex):
    """What is known of segments, row by row."""

    def clear(self) -> None:
        super().clear()
        self.counts = Growing(np.int64)  #: n_a, n_b, n_groups, n_links, fits for each row
        self.text, self.text_ends = Growing(np.uint8), Growing(np.int64)
        self.links, self.link_ends = Growing(np.int64), Growing(np.int64)
        for x in (self.text_ends, self.link_ends):
            x.extend(np.zeros(1, np.int64))

    def add(self, keys: np.ndarray, counts: np.ndarray, text: np.ndarray, text_ends: np.ndarray, links: np.ndarray, link_ends: np.ndarray) -> np.ndarray:
        self.text_ends.extend(text_ends + self.text.n)
        self.link_ends.extend(link_ends + self.links.n)
        self.text.extend(text)
        self.links.extend(links)
        self.counts.extend(counts.reshape(-1))
        return self.put_many(keys)


class Aligner:
    """Both tokenizers and the segments known."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel parts
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = self.a.get_vocab(with_added_tokens=False)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        entries = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in own.items():
            entries[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("pieces with a space after another character can't be aligned by segments")
        self.bytes_a = flat_table(entries)
        self.bytes_b = flat_table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])
        self.ids_a, self.ids_b = numbers(len(entries), ",", "|"), numbers(len(pieces), ",", ";")
        self.known = Segments()

    def both(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each tokenizer, and how many each string has. Strings start with a space."""
        a = [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in strings], num_threads=1)
        # B's space comes only with a text
        space = self.b.piece_to_id(SPACE_MARK)
        b = [x or [space] for x in b]
        flat = lambda ids: (np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids)))
        return *flat(a), *flat(b)

    def align(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """counts (segments x 5), groups as text and where each segment's end, links and where they end."""
        raw = data.tobytes()
        a, per_a, b, per_b = self.both([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        n = len(starts)
        of_a, of_b = np.repeat(np.arange(n), per_a), np.repeat(np.arange(n), per_b)
        fits = np.ones(n, bool)
        for ids, of, (_, table_ends) in ((a, of_a, self.bytes_a), (b, of_b, self.bytes_b)):
            fits &= np.bincount(of, np.diff(table_ends)[ids], n) == ends - starts
        for ids, of, (table, table_ends) in ((a, of_a, self.bytes_a), (b, of_b, self.bytes_b)):
            got, _ = gather(table, table_ends, ids[fits[of]])
            sizes = np.where(fits, ends - starts, 0)
            to = np.cumsum(sizes)
            want = data[np.repeat(starts - (to - sizes), sizes) + np.arange(len(got))]
            fits[np.searchsorted(to, np.flatnonzero(got != want), "right")] = False
        a, of_a, b, of_b = a[fits[of_a]], of_a[fits[of_a]], b[fits[of_b]], of_b[fits[of_b]]
        ends_a, ends_b = np.cumsum(np.diff(self.bytes_a[1])[a]), np.cumsum(np.diff(self.bytes_b[1])[b])
        stretches, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, stretches), np.searchsorted(ends_b, stretches)
        links = b[at_b] << 32 | a[at_a]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        count = lambda of: np.bincount(of, minlength=n)
        n_links = count(of_a[at_a])
        counts = np.stack([count(of_a), count(of_b), count(of_a[np.isin(ends_a, common)]), n_links, fits.astype(np.int64)], axis=1)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        rows = np.concatenate([2 * a + (common[group_a] == ends_a), 2 * b + (common[group_b] == ends_b) + len(self.ids_a[1]) - 1])[order]
        table, table_ends = np.concatenate([self.ids_a[0], self.ids_b[0]]), np.concatenate([self.ids_a[1], self.ids_b[1][1:] + self.ids_a[1][-1]])
        text, to = gather(table, table_ends, rows)
        text_ends = np.concatenate([[0], to])[np.cumsum(counts[:, 0] + counts[:, 1])]
        return counts, text, text_ends, links, np.cumsum(n_links)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the table for segments."""
        known, hashes = self.known, np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        if known.n > CACHE_SEGMENTS:
            known.clear()
        rows = known.find(hashes)
        new = np.flatnonzero(rows < 0)
        keys, first = np.unique(hashes[new], return_index=True)
        if not known.room(len(keys)):  # more than there is room for: a new table, large enough for all
            known.BITS = max(known.BITS, (2 * len(hashes)).bit_length())
            known.clear()
            keys, first = np.unique(hashes, return_index=True)
            new = np.arange(len(hashes))
        if len(keys):
            known.add(keys, *self.align(data, starts[new[first]], ends[new[first]]))
            rows = known.find(hashes)
        return rows

    def texts(self, texts: pa.Array, with_groups: bool) -> Iterator[tuple[list[int], bytes, bytes, np.ndarray, np.ndarray]]:
        """For each text the four counts, the groups' SHA-256 and, with_groups, the groups as text,
        and its distinct keys with their numbers."""
        data, offsets = text_bytes(texts)
        empty = np.diff(offsets) == 0
        data, offsets = np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))
        starts = segment_starts(data, offsets)
        rows = self.rows(data, starts, np.append(starts[1:], len(data)))
        first = np.searchsorted(starts, offsets)
        k = self.known
        counts = k.counts.view().reshape(-1, 5)[rows]
        for i in range(len(empty)):
            own = slice(first[i], first[i + 1])
            if empty[i] or not counts[own, 4].all():
                yield [0, 0, 0, 0], b"", b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            sha, groups, keys, times = hashlib.sha256(), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(own.start, own.stop, BLOCK):
                part = rows[at : min(at + BLOCK, own.stop)]
                text, _ = gather(k.text.view(), k.text_ends.view(), part)
                text = text[: len(text) - (at + BLOCK >= own.stop)].tobytes()  # without the last mark
                sha.update(text)
                if with_groups:
                    groups.append(text)
                more, n = np.unique(gather(k.links.view(), k.link_ends.view(), part)[0], return_counts=True)
                keys, times = summed(np.concatenate([keys, more]), np.concatenate([times, n])) if len(keys) else (more, n)
            yield counts[own, :4].sum(axis=0).tolist(), sha.hexdigest().encode(), b"".join(groups), keys, times


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n, starts) if len(keys) else n


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def encode(docs: DataFrame, a: str, b: str, with_groups: bool) -> DataFrame:
    """docs: id, text. A row for each: id, the counts, the hash, [groups,] keys and times."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups, "keys", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            for part in chunks(batch):
                counts, hashes, groups, keys, times = zip(*both.texts(part.column("text"), with_groups), strict=True)
                each = np.array(counts, np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (keys, times)]
                text = [pa.array([x.decode() for x in groups], pa.string())] * with_groups
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c) for c in each.T.copy()), pa.array([h.decode() for h in hashes], pa.string()), *text, *lists], names)
        give_back()

    return docs.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, {'groups string, ' * with_groups}keys array<bigint>, times array<bigint>")


# ---------------------------------------------------------------- counts


def partials(encoded: DataFrame) -> DataFrame:
    """key, n: sums of a partition, which give out more than one row a key only beyond HELD_SUMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        give = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
        for batch in batches:
            held.append(tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "times")))
            size += len(held[-1][0])
            if size > HELD_KEYS:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD_SUMS:
                    yield give(*held[0])
                    held, size = [], 0
        if held:
            yield give(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return encoded.select("keys", "times").mapInArrow(run, "key bigint, n bigint")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """key, n: all pairs with their counts, sorted by key over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the run that the next batch may carry on
        for batch in batches:
            if batch.num_rows:
                key, n = summed(*(np.concatenate([x, batch.column(c).to_numpy()]) for c, x in (("key", key), ("n", n))))
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1]), pa.array(n[:-1])], ["key", "n"])
                key, n = key[-1:], n[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return partials(encoded).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, n bigint")


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Spark takes it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


def mapped(path: str) -> np.ndarray:
    """A file of int64, memory-mapped: from where it lies, or from a local copy that has no name any more."""
    store, at = place(path)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return np.memmap(at, "<i8", "r")
    with tempfile.TemporaryFile() as copy, store.open_input_stream(at) as source:
        shutil.copyfileobj(source, copy)
        copy.flush()
        return np.memmap(copy, "<i8", "r")


class Shards:
    """Sorted count shards, each opened when it is first needed."""

    def __init__(self, found: list[tuple[str, int, int]]):
        self.found, self.open = sorted(found, key=lambda x: x[1]), {}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of keys that are all there, distinct and in order."""
        out = np.zeros(len(keys), np.int64)
        for path, first, last in self.found:
            a, b = np.searchsorted(keys, [first, last + 1])
            if a < b:
                if path not in self.open:
                    self.open[path] = mapped(path + ".keys"), mapped(path + ".counts")
                sorted_keys, counts = self.open[path]
                out[a:b] = counts[np.searchsorted(sorted_keys, keys[a:b])]
        return out


_SHARDS: dict[str, Shards] = {}


def shards_of(folder: str, found: list[tuple[str, int, int]]) -> Shards:
    """Those of the folder that this worker has looked into last."""
    if folder not in _SHARDS:
        _SHARDS.clear()
        _SHARDS[folder] = Shards(found)
    return _SHARDS[folder]


def write_shards(counts: DataFrame, folder: str) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(path, first key, last key) of each shard, and each B id's highest count. An attempt writes to
    names of its own, so one that is lost or runs twice leaves nothing that is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = place(folder)
        store.create_dir(at, recursive=True)
        name, ends, best = uuid.uuid4().hex, [0, 0], np.zeros(0, np.int64)
        with store.open_output_stream(f"{at}/{name}.keys") as keys_to, store.open_output_stream(f"{at}/{name}.counts") as counts_to:
            total = 0
            for batch in batches:
                if batch.num_rows:
                    keys, n = (batch.column(c).to_numpy().astype("<i8") for c in ("key", "n"))
                    ids = keys >> 32
                    if len(best) <= ids[-1]:
                        best = np.concatenate([best, np.zeros(int(ids[-1]) + 1 - len(best), np.int64)])
                    np.maximum.at(best, ids, n)
                    keys_to.write(keys.tobytes())
                    counts_to.write(n.tobytes())
                    ends = [ends[0] if total else int(keys[0]), int(keys[-1])]
                    total += len(keys)
        if total:
            ids = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([ends[0]]), pa.array([ends[1]]), pa.array([ids]), pa.array([best[ids]])], ["path", "first", "last", "ids", "best"])

    rows = counts.mapInArrow(run, "path string, first bigint, last bigint, ids array<bigint>, best array<bigint>").collect()
    best = np.zeros(max((r.ids[-1] + 1 for r in rows), default=0), np.int64)
    for r in rows:
        np.maximum.at(best, r.ids, r.best)
    return [(r.path, r.first, r.last) for r in rows], best


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None, with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with_groups, groups:
    `a1,a2|b1;a3|b2,b3`, the ids of each group."""
    a, b = vocabularies or default_vocabularies()
    spark = docs.sparkSession
    encoded = materialize(encode(columns(docs, id=id_col, text=text_col), a, b, with_groups), "encoded", codec="zstd")
    folder = f"{scratch_dir(spark)}/noticeflow/counts-{uuid.uuid4().hex}"
    found, best = write_shards(pair_counts(encoded), folder)
    kind = encoded.schema["id"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = shards_of(folder, found)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "times"))
            distinct, which = np.unique(keys, return_inverse=True)
            counts = shards.counts(distinct)
            is_best = counts == best[distinct >> 32]
            of = np.repeat(np.arange(batch.num_rows), batch.column("keys").value_lengths().to_numpy(zero_copy_only=False))
            sums = []
            for each in (is_best[which] * times, counts[which] * times):
                total = np.concatenate([[0], np.cumsum(each)])
                to = np.searchsorted(of, np.arange(batch.num_rows + 1))
                sums.append(pa.array(total[to[1:]] - total[to[:-1]]))
            has = {**{c: batch.column(c) for c in batch.schema.names}, "n_best": sums[0], "count_sum": sums[1]}
            yield pa.RecordBatch.from_arrays([has["id"], *(has[c] for c in names)], ["doc_id", *names])

    types = dict.fromkeys(names, "bigint") | {"groups_sha256": "string", "groups": "string"}
    return encoded.mapInArrow(look, f"doc_id {kind}, " + ", ".join(f"{c} {types[c]}" for c in names))
