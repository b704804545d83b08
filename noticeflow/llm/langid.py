"""Operator 1: language identification of mixed-language text.

Training counts byte n-grams (1 to ORDER, hashed into BUCKETS) of the words of each language and the
scripts of its letters. It takes labelled documents, TRAIN_DOCS of each language at most in
expectation (a bound by hash, documented as such; every document is predicted).

A word's script, by ranges of code points, narrows the candidates to the languages that use it; its
score for each candidate is the tempered log-likelihood of its n-grams. Viterbi then finds the
labels of a text's words that maximise the sum of scores less PENALTY for each switch, which gives
spans. A text is first tested in whole arrays: if no other language gains PENALTY / 2 over the best
one in any stretch of words, no switch can pay, and the text is one span.

The prediction is the language with most letters in its spans (ties: the first by name) and the
score its share of all letters, those of scripts that no language uses included.

Whether a text is in a learned language at all is a matter of its words' log-likelihoods, each in the
language of its span. On a scale from the average n-gram of that language's training texts (0) to
one that they don't have (1), a text whose n-grams average beyond FAR + SHORT / n-grams is foreign; a
language with fewer training n-grams than the smoothing adds can't tell and finds nothing foreign.

Defined results: a text that is null, empty or without letters is `und` with score 0 and no spans;
so is every text if there is nothing to learn from. A null id stays null and isn't held out. Repeated
rows give repeated results.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, chunks, give_back, mix, split_words

TRAIN_DOCS, ORDER, BUCKETS, SMOOTHING, TEMPER, PENALTY = 2000, 4, 1 << 16, 0.5, 0.4, 12.0
UNKNOWN = "und"
#: How far from its training texts a text of a language may be; what a text of few n-grams may add.
FAR, SHORT = 0.3, 10.0
#: Share of a language's letters from which on a script counts as its own.
SCRIPT_SHARE = 0.01
#: Words that a worker keeps the scores of.
CACHE_WORDS = 400_000

#: First code points of script ranges, in order (fixed values from the Unicode block list).
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1C80, "Cyrillic"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA640, "Cyrillic"), (0xA700, "Latin"),
    (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPT_RANGES]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_INDEX = {s: i for i, s in enumerate(SCRIPTS)}
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LATIN = re.compile(r"[\x00-ͯ]*")


def script_of(word: str) -> int:
    """The script of most of a word's letters (the first in order on a tie), -1 without letters."""
    if _LATIN.fullmatch(word):
        return _INDEX["Latin"] if word else -1
    counts: dict[int, int] = {}
    for c in word:
        s = _INDEX[SCRIPT_RANGES[bisect_right(_STARTS, ord(c)) - 1][1]]
        counts[s] = counts.get(s, 0) + 1
    return max(sorted(counts), key=counts.__getitem__)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters_of(words: list[str]) -> list[str]:
    """Words without what isn't a letter, in lower case (composed, if not plain)."""
    text = "\n".join(words)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return ["".join(filter(str.isalpha, w)) if not w.isalpha() and w else w for w in (_NOT_LETTERS.sub("", x) for x in text.lower().split("\n"))]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, each between two spaces, per order; and the word of
    each byte, with n-grams that reach over their word's last space set to BUCKETS."""
    data = np.frombuffer((" " + "  ".join(words) + " " * (ORDER + 1)).encode(), np.uint8)
    sizes = np.array([len(w.encode()) + 2 for w in words], np.int64)
    to = np.cumsum(sizes)
    n = int(to[-1]) if len(to) else 0
    whose = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(to, sizes) - np.arange(n)  # bytes to the word's end
    out = np.empty((ORDER, n), np.int32)
    value = np.zeros(n, np.uint64)
    for k in range(ORDER):
        value = value * np.uint64(257) + data[k : k + n] + np.uint64(1)
        out[k] = np.where(left > k, (mix(value + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(BUCKETS)).astype(np.int32), BUCKETS)
    return out, whose, to - sizes


@dataclass
class Model:
    languages: list[str]  #: in order of name
    logs: np.ndarray  #: (BUCKETS + 1) x languages, float32; the last row is 0
    uses: np.ndarray  #: scripts x languages, bool
    usual: np.ndarray  #: the average log-likelihood of an n-gram in each language's training texts
    rare: np.ndarray  #: that of an n-gram they don't have; the same as `usual` if they are too few to tell

    def scores(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Scores (words x languages), letters, whether any language uses the word's script, and for
        words of such scripts the best language's log-likelihood and the number of n-grams."""
        own = letters_of(words)
        letters = np.array([len(w) for w in own], np.int32)
        script = np.array([script_of(w) for w in own], np.int64)
        grams, _, first = grams_of(own)
        total = np.zeros((len(first), len(self.languages)), np.float32)
        for row in grams:
            total += np.add.reduceat(self.logs[row], first, axis=0)
        total *= TEMPER
        uses = self.uses[script] & (script >= 0)[:, None]
        known = uses.any(axis=1)
        best = np.where(uses, total, -np.inf).max(axis=1, initial=-np.inf)
        total = np.where(uses, total - np.where(known, best, 0)[:, None], -2 * PENALTY)
        total[~known] = 0
        fit = np.where(known, best / TEMPER, 0).astype(np.float32)
        n = np.where(known & (letters > 0), np.add.reduceat((grams < BUCKETS).sum(axis=0), first), 0).astype(np.int32)
        return np.maximum(total, -2 * PENALTY).astype(np.float32), letters, known, fit, n


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """docs: text, lang and key (what the bound goes by; not a feature)."""
    labelled = docs.filter("text is not null and lang is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), np.zeros(0), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))))
    chosen = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "lang")), strict=True):
                own = letters_of(text.split())
                grams, _, _ = grams_of([w for w in own if w])
                into = sums.setdefault(lang, np.zeros(BUCKETS + 1 + len(SCRIPTS), np.int64))
                into[: BUCKETS + 1] += np.bincount(grams.reshape(-1), minlength=BUCKETS + 1)
                for w in own:
                    if w:
                        into[BUCKETS + 1 + script_of(w)] += len(w)
        for lang, into in sums.items():
            into[BUCKETS] = 0
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(into[at])], ["lang", "slot", "n"])

    # At most languages x (BUCKETS + scripts) rows, however many documents there are.
    found = chosen.mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS + 1 + len(SCRIPTS), len(languages)))
    table[found["slot"].to_numpy(), np.searchsorted(np.array(languages), np.array(found["lang"].to_pylist(), dtype=np.array(languages).dtype))] = found["n"].to_numpy()
    grams = table[:BUCKETS] + SMOOTHING
    logs = np.vstack([np.log(grams / grams.sum(axis=0)), np.zeros(len(languages))])
    scripts = table[BUCKETS + 1 :]
    seen = table[:BUCKETS].sum(axis=0)
    rare = np.log(SMOOTHING / grams.sum(axis=0))
    usual = np.where(seen < SMOOTHING * BUCKETS, rare, (table[:BUCKETS] * logs[:BUCKETS]).sum(axis=0) / np.maximum(seen, 1))
    return Model(languages, logs.astype(np.float32), scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0)), usual, rare)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> list[int]:
    """The labels of one text's words; ties stay in the language they are in, else the first."""
    rows = scores.tolist()
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(best)
        at = best.index(top)
        came = [i if b >= top - penalty else at for i, b in enumerate(best)]
        best = [(b if b >= top - penalty else top - penalty) + s for b, s in zip(best, row, strict=True)]
        back.append(came)
    at = best.index(max(best))
    path = [at]
    for came in reversed(back):
        at = came[at]
        path.append(at)
    return path[::-1]


class Labeller:
    """Labels words; keeps the scores of words seen."""

    def __init__(self, model: Model):
        self.model, self.index = model, HashIndex()
        self._reset()

    def _reset(self) -> None:
        self.index.clear()
        self.held = [np.zeros((0, len(self.model.languages)), np.float32), *(np.zeros(0, kind) for kind in (np.int32, bool, np.float32, np.int32))]

    def words(self, w, hashes: np.ndarray) -> list[np.ndarray]:
        if self.index.n > CACHE_WORDS:
            self._reset()
        rows = self.index.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            keys, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if not self.index.room(len(keys)):
                self.index.BITS = max(self.index.BITS, (2 * len(hashes)).bit_length())
                self._reset()
                return self.words(w, hashes)
            take, raw = missing[first], w.data.tobytes()
            new = self.model.scores([raw[s:e].decode() for s, e in zip(w.starts[take].tolist(), w.ends[take].tolist(), strict=True)])
            self.held = [np.concatenate([held, x]) for held, x in zip(self.held, new, strict=True)]
            rows[missing] = self.index.put_many(keys)[which]
        return [held[rows] for held in self.held]

    def spans(self, texts: pa.Array) -> Iterator[list[tuple]]:
        """Of each text: (language, start, end (bytes), letters, known letters, n-grams, how far
        their log-likelihood is below the language's usual one, and how far it would be if none of
        them were in its training texts) of each span."""
        w = split_words(texts)
        n = len(w.first) - 1
        if not self.model.languages or not len(w.starts):
            yield from ([] for _ in range(n))
            return
        scores, letters, known, fit, grams = self.words(w, np.maximum(w.hashes(), np.uint64(1)))
        doc, count = w.doc(), np.diff(w.first)
        some = np.flatnonzero(count)
        at = w.first[some]
        sums = np.zeros((n, scores.shape[1]))
        sums[some] = np.add.reduceat(scores, at, axis=0, dtype=np.float64)
        best = sums.argmax(axis=1)
        mixed = np.zeros(n, bool)
        own = scores[np.arange(len(doc)), best[doc]]
        for k in range(scores.shape[1]):  # the most that language k gains over any stretch of a text
            gain = np.cumsum(scores[:, k].astype(np.float64) - own)
            before = np.concatenate([[0.0], gain[:-1]])
            down = -4.0 * PENALTY * (len(doc) + 1) * np.arange(n)[doc]  # keeps texts apart
            low = np.minimum.accumulate(before + down)
            mixed[some] |= np.maximum.reduceat(gain + down - low, at) >= PENALTY / 2
        sum_letters, sum_known, sum_grams, sum_fit = (np.concatenate([[0], np.cumsum(x)]) for x in (letters, letters * known, grams, fit.astype(np.float64)))
        usual, room = self.model.usual.tolist(), (self.model.usual - self.model.rare).tolist()

        def span(k: int, s: int, e: int, zero: int) -> tuple:
            n = int(sum_grams[e] - sum_grams[s])
            here = float(sum_fit[e] - sum_fit[s]) + float(scores[s:e, k].sum(dtype=np.float64)) / TEMPER
            below = (n * usual[k] - here, n * room[k]) if room[k] else (0.0, 0.0)
            return self.model.languages[k], int(w.starts[s]) - zero, int(w.ends[e - 1]) - zero, int(sum_letters[e] - sum_letters[s]), int(sum_known[e] - sum_known[s]), n, *below

        for i in range(n):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if a == b:
                yield []
                continue
            if mixed[i]:
                path = np.array(viterbi(scores[a:b]))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
                parts = [(int(path[s]), a + s, a + e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                parts = [(int(best[i]), a, b)]
            zero = int(w.offsets[i])
            yield [span(k, s, e, zero) for k, s, e in parts]


def verdict(spans: list[tuple]) -> tuple[str, float, float]:
    """The predicted language, its share of all letters, and the share of letters in known scripts."""
    total = sum(x[3] for x in spans)
    if not total:
        return UNKNOWN, 0.0, 0.0
    by: dict[str, list[int]] = {}
    for lang, _, _, letters, known, *_ in spans:
        own = by.setdefault(lang, [0, 0])
        own[0] += letters
        own[1] += known
    lang = min(by, key=lambda k: (-by[k][0], k))
    return lang, by[lang][1] / total, sum(x[1] for x in by.values()) / total


def foreign(spans: list[tuple]) -> bool:
    """Whether the words are too unlikely to be of the languages they are labelled with."""
    n, below, room = (sum(x[i] for x in spans) for i in (5, 6, 7))
    return n > 0 and below > (FAR + SHORT / n) * room


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with all rows, and the columns lang_pred, score, known (the share of letters in scripts
    of learned languages) and spans (array of language, start, end: bytes of the text). Columns of
    docs with these names are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        kind = pa.list_(pa.struct([("language", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in chunks(batch, text_col):
                spans = list(labeller.spans(part.column(text_col)))
                found = [verdict(x) for x in spans]
                lists = pa.array([[{"language": x[0], "start": x[1], "end": x[2]} for x in own] for own in spans], kind)
                cols = [pa.array([x[0] for x in found]), *(pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)), lists]
                keep = [i for i, c in enumerate(part.schema.names) if c not in ADDED]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *cols], [*(part.schema.names[i] for i in keep), *ADDED])
        del labeller
        give_back()

    docs = docs.drop(*ADDED)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, known double, spans array<struct<language:string,start:int,end:int>>")


ADDED = ("lang_pred", "score", "known", "spans")


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model of the documents that aren't held out."""
    return train(docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("key")), **options)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for each row of docs (doc_id, text, lang)."""
    model = train_on(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


def in_known_languages(docs: DataFrame, **names) -> DataFrame:
    """The rows of docs, with their columns, that are in a learned language: those without letters,
    with less than half of them in scripts of learned languages, or foreign by their words' scores
    are rejected."""
    model, text_col = train_on(docs, **names), names.get("text_col", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            for part in chunks(batch, text_col):
                found = [(*verdict(x), foreign(x)) for x in labeller.spans(part.column(text_col))]
                yield part.filter(pa.array([lang != UNKNOWN and known >= 0.5 and not far for lang, _, known, far in found], pa.bool_()))
        del labeller
        give_back()

    return docs.mapInArrow(run, docs.schema)
