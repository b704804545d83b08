"""Operator 10: repeated passages by sparse suffix arrays.

A passage is a run of MIN_WORDS words (bytes other than 0x20 and 0x09-0x0D) that stands at several
places of the corpus. Of the suffixes of all texts only those are kept that start at the minimiser
of some run: of the run's GRAM-word grams the one with the least hash, the leftmost on a tie. Equal
runs choose the same place, so a passage can't go unseen. The kept suffixes are sorted (by the hash
of their gram, then by that of their surroundings, so that equal ones stand together), in ranges
over all tasks, and neighbours are compared:

- a gram that neither neighbour has stands once, and all runs that chose it are unique;
- a suffix whose whole surroundings (all runs that chose it) equal its neighbour's is a repeat of
  the first of them as a whole;
- one that shares only the gram is extended to the left and to the right: its runs, which reach up
  to MIN_WORDS - GRAM words to either side, are compared one by one, by hash and gram.

The earliest place of each run, by doc_id and then position, stays; every other one is a repeat, and
overlapping repeats of a document merge into spans. Suffixes at the ends of a range, whose neighbour
is in another task, are always extended, so where ranges are cut makes no difference.

Defined results: null, empty and short texts have no passages. Rows without doc_id can't be named and
take no part. Rows that share a doc_id are one document: what stands at the same place in each isn't
a repeat. A passage that repeats within its own document counts too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_row, chunks, columns, give_back, gram_hashes, materialize, spare, split_words

MIN_WORDS, GRAM = 50, 16
#: Bits of a minimiser's key that hold its place; more only where a chunk has more words than that.
PLACE_BITS = 24


def minimisers(hashes: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each kept suffix: its word number, the hash of its gram, the first run that chose it and
    how many did. Words of texts are [first[i], first[i + 1]); runs don't cross texts."""
    runs = len(hashes) - min_words + 1
    if runs < 1:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    places = np.uint64((1 << max(PLACE_BITS, len(hashes).bit_length())) - 1)
    at = np.arange(len(hashes) - gram + 1)
    grams = gram_hashes(hashes, at, at + gram)
    least = grams & ~places | at.astype(np.uint64)
    width, over = min_words - gram + 1, 1
    while 2 * over <= width:
        least = np.minimum(least[:-over], least[over:])
        over *= 2
    least = np.minimum(least[:runs], least[width - over : width - over + runs])
    place = (least & places).astype(np.int64)
    ends = np.repeat(first[1:], np.diff(first))
    inside = np.flatnonzero(np.arange(runs) + min_words <= ends[:runs])
    place = place[inside]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    return place[new], grams[place[new]], inside[new], np.diff(np.append(new, len(place)))


def _suffixes(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """gram, around (the hash of all words of the suffix's runs), doc_id, run and runs (the first
    run's word number in its text, and how many), start and end (in code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = split_words(part.column("text"))
                h = w.hashes()
                place, grams, lo, n = minimisers(h, w.first, min_words, gram)
                doc = np.searchsorted(w.first, lo, "right") - 1
                around = gram_hashes(h, lo, lo + n + min_words - 1, place - lo)
                points = w.code_points()
                zero = points[w.offsets[doc]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(around.view(np.int64)), part.column("doc_id").take(pa.array(doc)), pa.array((lo - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((points[w.starts[lo]] - zero).astype(np.int32)), pa.array((points[w.ends[lo + n + min_words - 2]] - zero).astype(np.int32))],
                    ["gram", "around", "doc_id", "run", "runs", "start", "end"],
                )
        give_back()

    return docs.mapInArrow(run, "gram bigint, around bigint, doc_id bigint, run int, runs int, start int, end int")


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one range in order. Out: repeats as a whole, with the first of them as from_doc and
    from_run; and suffixes to extend, with from_doc null."""
    names = ["gram", "doc_id", "run", "runs", "start", "end"]
    held: dict | None = None  # the last group's first row; whether the group before has its gram
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        gram, around, n = cols["gram"], cols["around"], batch.num_rows
        new = np.ones(n, bool)
        new[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
        new[0] = held is None or (gram[0], around[0]) != (held["gram"], held["around"])
        group = np.flatnonzero(new)
        head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = {c: np.where(head >= 0, cols[c][np.maximum(head, 0)], held[c] if held is not None else 0) for c in ("doc_id", "run")}
        copy = np.flatnonzero(~new & ((cols["doc_id"] != first["doc_id"]) | (cols["run"] != first["run"])))
        yield pa.RecordBatch.from_arrays([*(pa.array(cols[c][copy]) for c in names), pa.array(first["doc_id"][copy]), pa.array(first["run"][copy])], [*names, "from_doc", "from_run"])
        heads = {c: np.concatenate([[held[c]], cols[c][group]]).astype(cols[c].dtype) if held is not None else cols[c][group] for c in batch.schema.names}
        like = heads["gram"][1:] == heads["gram"][:-1]
        before = np.concatenate([[held["shared"] if held is not None else True], like])  # the range's first group is extended
        ask = before.copy()
        ask[:-1] |= like
        out = np.flatnonzero(ask[:-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([*(pa.array(heads[c][out]) for c in names), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int32())], [*names, "from_doc", "from_run"])
        held = {c: v[-1] for c, v in heads.items()} | {"shared": bool(before[-1])}
    if held is not None:  # and so is its last
        yield pa.RecordBatch.from_arrays([*(pa.array([held[c]]) for c in names), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], [*names, "from_doc", "from_run"])


def _extended(docs: DataFrame, asked: DataFrame, min_words: int) -> DataFrame:
    """Every run of the suffixes asked for: gram, hash, doc_id, run, start, end."""
    lists = asked.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "run", "runs")).alias("asked"))
    joined = docs.join(lists, "doc_id").select("doc_id", "text", "asked.gram", "asked.run", "asked.runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = split_words(part.column("text"))
                h, points = w.hashes(), w.code_points()
                lists = {c: part.column(c) for c in ("gram", "run", "runs")}
                doc = np.repeat(np.arange(part.num_rows), lists["run"].value_lengths().to_numpy())
                gram, lo, n = (lists[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gram", "run", "runs"))
                to = np.cumsum(n)
                at = np.repeat(lo + w.first[doc] - (to - n), n) + np.arange(to[-1] if len(to) else 0)
                doc, gram = np.repeat(doc, n), np.repeat(gram, n)
                fits = at + min_words <= w.first[doc + 1]
                at, doc, gram = at[fits], doc[fits], gram[fits]
                zero = points[w.offsets[doc]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(gram_hashes(h, at, at + min_words).view(np.int64)), part.column("doc_id").take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array((points[w.starts[at]] - zero).astype(np.int32)), pa.array((points[w.ends[at + min_words - 1]] - zero).astype(np.int32))],
                    ["gram", "hash", "doc_id", "run", "start", "end"],
                )
        give_back()

    return joined.mapInArrow(run, "gram bigint, hash bigint, doc_id bigint, run int, start int, end int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each span of repeats: doc_id, start, end (code points, end exclusive), first_word,
    n_words, from_doc_id and from_word: where the words at its start stand for the first time."""
    source = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).filter("doc_id is not null")
    suffixes = materialize(_suffixes(source, min_words, gram), "suffixes")
    order = ["gram", "around", "doc_id", "run"]
    compared = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare_neighbours, "gram bigint, doc_id bigint, run int, runs int, start int, end int, from_doc bigint, from_run int")
    compared = materialize(compared, "compared")
    runs = materialize(_extended(source, compared.filter("from_doc is null"), min_words), "runs")
    earliest = runs.groupBy("gram", "hash").agg(F.min(F.struct("doc_id", "run")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("gram", "hash", "f")
    single = runs.join(earliest, ["gram", "hash"]).filter("doc_id != f.doc_id or run != f.run")
    found = single.select("doc_id", "run", F.lit(1).alias("runs"), "start", "end", F.col("f.doc_id").alias("from_doc"), F.col("f.run").alias("from_run"))
    found = found.unionByName(compared.filter("from_doc is not null").drop("gram"))

    by = W.partitionBy("doc_id").orderBy("run", "runs", "from_doc", "from_run")
    reach = F.max(F.col("run") + F.col("runs") + min_words - 1).over(by.rowsBetween(W.unboundedPreceding, -1))
    spans = found.withColumn("new", F.coalesce((F.col("run") >= reach).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("run").alias("first_word"),
        (F.max(F.col("run") + F.col("runs")) + min_words - 1 - F.min("run")).alias("n_words"),
        F.min(F.struct("run", "from_doc", "from_run")).alias("f"),
    ).select("doc_id", "start", "end", "first_word", "n_words", F.col("f.from_doc").alias("from_doc_id"), F.col("f.from_run").alias("from_word"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with all their columns, without the repeats in their texts; length_col, where there is
    such a column, is that of the text that is left. Texts of which nothing is left but white space
    go; texts without repeats, null and empty ones stay as they are. Every row is a text of its own,
    whatever its id: what is cut from one stands in another, and rows of one id or none have different
    cuts; an exact copy of a row goes."""
    return by_row(docs, _without, id_col, **options)


def _without(docs: DataFrame, id_col: str, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    spans = repeats(docs, id_col=id_col, text_col=text_col, **options)
    cut_col, of_col = spare(docs, "_cuts"), spare(docs, "_of")
    cuts = spans.groupBy(F.col("doc_id").alias(of_col)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut_col))
    marked = docs.join(cuts, docs[id_col] == F.col(of_col), "left").drop(of_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in chunks(batch, text_col)):
            cuts = part.column(cut_col)
            own = part.select([c for c in part.schema.names if c != cut_col])
            rows = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            if len(rows):
                texts, keep = own.column(text_col).to_pylist(), np.ones(part.num_rows, bool)
                lengths = own.column(length_col).to_pylist() if length_col in own.schema.names else None
                for i in rows.tolist():
                    text, at, parts = texts[i] or "", 0, []
                    for c in cuts[i].as_py():
                        parts.append(text[at : c["start"]])
                        at = c["end"]
                    texts[i] = "".join([*parts, text[at:]])
                    keep[i] = bool(texts[i].strip())
                    if lengths is not None:
                        lengths[i] = len(texts[i])
                own = own.set_column(own.schema.get_field_index(text_col), text_col, pa.array(texts, own.column(text_col).type))
                if lengths is not None:
                    own = own.set_column(own.schema.get_field_index(length_col), length_col, pa.array(lengths, own.column(length_col).type))
                own = own.filter(pa.array(keep))
            yield own
        give_back()

    return marked.mapInArrow(run, docs.schema)
