"""Shared parts: scratch tables on shared storage, byte-level word splitting, hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step works on; bounds a worker's memory.
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- scratch


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. One is set only where none is, and only in
    local mode, where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="noticeflow-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_WITHIN: ContextVar[str | None] = ContextVar("scratch folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside, but for those to keep, are removed at the end; by then
    nothing may be left to compute from them."""
    folder = f"{scratch_dir(spark)}/noticeflow/{uuid.uuid4().hex}"
    token = _WITHIN.set(folder)
    try:
        yield
    finally:
        _WITHIN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to shared storage and read it back: lineage ends there, lost executors
    cost nothing, and later readers prune columns. keep: whatever scratch() it is made in."""
    spark = df.sparkSession
    folder = None if keep else _WITHIN.get()
    path = f"{folder or scratch_dir(spark) + '/noticeflow'}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what this process has freed to the machine: reused Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):  # another C library
        return
    trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64. Those that a usual chunk needs are
    kept; a longer text's are made for it alone."""

    KEPT = CHUNK_BYTES + (1 << 16)

    def __init__(self, base: int):
        self.base, self.held = base, (np.ones(1, U64), np.ones(1, U64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) >= n:
            return self.held
        size = self.KEPT if self.KEPT // 16 < n <= self.KEPT else max(n, self.KEPT // 16)
        made = []
        for b in (self.base, _inverse(self.base)):
            x = np.full(size, b, U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size <= self.KEPT:
            self.held = (made[0], made[1])
        return made[0], made[1]


_BYTE_POWERS, _WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; lower: A-Z count as a-z."""
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    p = _prefix((_LOWER_VALUES if lower else _BYTE_VALUES)[data] * up[: len(data)])
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def gram_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of words[start:end], a run of word hashes, for each span."""
    up, down = _WORD_POWERS.upto(len(words) + 1)
    p = _prefix(words * up[: len(words)])
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts + seed).astype(U64) * U64(0xE7037ED1A0B428DB))


class HashIndex:
    """64-bit hashes -> rows numbered as they come, by open addressing: a whole chunk's hashes are
    looked up at once."""

    BITS = 20

    def __init__(self, bits: int | None = None) -> None:
        if bits:
            self.BITS = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, U64)
        self.rows = np.zeros(1 << self.BITS, np.int32)
        self.n = 0

    def room(self, new: int) -> bool:
        return self.n + new <= (1 << self.BITS) * 3 // 4

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """A row for each hash (none is 0), -1 where there is none."""
        mask = (1 << self.BITS) - 1
        out = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        slots = (hashes & U64(mask)).astype(np.int64)
        while len(todo):
            keys = self.keys[slots]
            same = keys == hashes[todo]
            out[todo[same]] = self.rows[slots[same]]
            on = ~same & (keys != 0)
            todo, slots = todo[on], (slots[on] + 1) & mask
        return out

    def put_many(self, keys: np.ndarray) -> np.ndarray:
        """The rows of new keys, all different."""
        mask = (1 << self.BITS) - 1
        new = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        todo, slots = np.arange(len(keys)), (keys & U64(mask)).astype(np.int64)
        while len(todo):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[todo[free]]  # of several that want a slot the last one has it
            won = self.keys[slots] == keys[todo]
            self.rows[slots[won]] = new[todo[won]]
            todo, slots = todo[~won], (slots[~won] + 1) & mask
        self.n += len(keys)
        return new

    def put(self, key: int) -> int:
        return int(self.put_many(np.array([key], U64))[0])


class Growing:
    """A flat array that is added to at its end."""

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.data, self.n = np.empty(1 << 10, self.kind), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            data = np.empty(max(self.n + len(x), len(self.data) * 3 // 2), self.kind)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)

    def view(self) -> np.ndarray:
        return self.data[: self.n]


# ---------------------------------------------------------------- words


@dataclass
class Words:
    """Words of consecutive texts; a word is a run of bytes other than 0x20 and 0x09-0x0D."""

    data: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: a text's bytes are data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: a text's words are [first[i], first[i + 1])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)

    def code_points(self) -> np.ndarray:
        """Code points before each byte, counted from the first text's start."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def code_points(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The code points of the characters that start at leads."""
    b = [data[np.minimum(leads + i, len(data) - 1)].astype(np.int32) for i in range(4)]
    two = (b[0] & 0x1F) << 6 | b[1] & 0x3F
    three = (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
    four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
    return np.minimum(np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))), 0x10FFFF)


def split_words(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes in all (at least one row each)."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spare(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_row(docs: DataFrame, stage: Callable[..., DataFrame], id_col: str = "doc_id", **options) -> DataFrame:
    """stage on docs with an id_col that names each row. Where ids are null or repeat this is a key in
    the order of the ids (null last), which is written once, so that tasks that run again can't change
    it; ids that name each row already need none."""
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        return stage(docs, id_col=id_col, **options)
    key = spare(docs, "_row")
    order = [F.col(id_col).asc_nulls_last(), F.col(key)]  # the key spreads rows of one id over the tasks
    ranged = docs.withColumn(key, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = materialize(ranged.withColumn(key, F.monotonically_increasing_id()), "keyed")
    return stage(keyed, id_col=key, **options).drop(key)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, so that others with clashing names can't interfere."""
    return df.select(*(F.col(v).alias(k) for k, v in names.items()))
