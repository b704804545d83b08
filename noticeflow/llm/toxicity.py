"""Operator 13: toxicity by a support vector machine over a subsequence string kernel.

A text is a row of sentences, a sentence a bag of words, a word a string of letters and gaps between a
start and an end mark: what stands between letters within a word, and spaces between letters that stand
alone, are gaps. The features of a string are its subsequences of ORDER characters within SPAN, each
worth DECAY for every character skipped, so insults with gaps or inserted characters share most of
their features with the plain ones. The kernel of two words is the cosine of their features to the
power POWER.

Landmarks are words of the labelled sentences: up to three quarters of them those whose neighbourhoods tell
toxic documents best (by the share of a document's words that are near, toxic against clean documents),
the rest drawn by hash. With K their kernel matrix, a word's Nyström features are K^-1/2 k(word, landmarks).
The machine (squared hinge, Newton steps) is trained on labelled sentences as bags: every word of a
clean document's sentence is negative, of a toxic document's sentence its worst word is positive if it
is near a telling landmark at first, if the last machine takes it for positive then, as most sentences
of a toxic document hold no insult. A sentence's margin is that of its worst word. The machine is folded
into one weight a landmark, so a word's margin is kernel values times weights, and each distinct word
is scored once.

A document's score is the logistic function of how many of its sentences are toxic, their share, and how
near its worst sentence comes to being toxic, fitted on the labelled documents.

What is learned from: TRAIN_DOCS documents of each label in expectation, chosen by hash, and SENTENCES
sentences of each; these come to the driver. Everything else covers all rows. With labels of one kind
only, or none, there is no model and every score is the share of toxic labels (0 without any).

Defined results: null and empty texts, and those without letters, have no sentence with words and get
the score of no toxic sentence. Ids aren't looked at but for who is held out: null ones are not.
Letters of a word are read in windows of WINDOW; memory doesn't depend on a word's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Growing, HashIndex, Words, chunks, give_back, mix, span_hashes, split_words

ORDER, SPAN, DECAY, POWER = 4, 6, 0.7, 2
LANDMARKS = 160
#: Documents of each label that are learned from, and sentences of each (in expectation).
TRAIN_DOCS, SENTENCES = 600, 30
#: Words of a sentence without an end mark.
LONGEST = 12
#: Characters of a word that are looked at together, and how far apart the next ones start.
WINDOW, STRIDE = 32, 16
#: Single letters in a row that count as one spelled-out word.
SPELLED = 3
CACHE_WORDS = 500_000
#: Features that are multiplied with the landmarks' at once.
BLOCK = 1 << 14
#: Words that are compared with candidates at once.
NEAR_WORDS = 1 << 13
#: The machine's cost of an error; rounds of choosing positive sentences; the ridge of the last fit.
COST, ROUNDS, RIDGE = 3000.0, 3, 1e-2
#: Standard errors that make a landmark telling, the kernel value from which two say the same, and that
#: from which a word counts as near one at first.
SURE, CLOSE, NEAR = 2.5, 0.8, 0.2
#: How much more frequent a word is in toxic documents' sentences if it can be what makes them toxic.
RATIO = 4.0
TOXIC = 0.7

START, END, GAP = "\x02", "\x03", "\x00"
LETTERS = re.compile(r"[^\W\d_]+")


def strings_of(word: str) -> list[str]:
    """What a word is compared as: its letters with gaps and, where it has parts, each of three letters
    and more; of one spelled out the letters alone. In windows where that is long."""
    parts = LETTERS.findall(word.lower())
    if len(parts) > 2 and max(map(len, parts)) == 1:
        own = ["".join(parts)]
    else:
        own = [GAP.join(parts)] if parts else []
        own += [p for p in parts if len(p) >= 3 and len(parts) > 1]
    out = []
    for x in own:
        x = START + x + END
        out += [x] if len(x) <= WINDOW + 2 else [x[i : i + WINDOW] for i in range(0, len(x) - WINDOW + STRIDE, STRIDE)]
    return out


#: The places of a subsequence within SPAN, and what it is worth.
PLACES = [(*p, DECAY ** (p[-1] + 1 - ORDER)) for p in combinations(range(SPAN), ORDER) if p[0] == 0]


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which string, packed subsequence and worth, one for each occurrence. Characters outside the
    basic plane are told apart by their last 16 bits."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) & np.uint64(0xFFFF)
    which = np.repeat(np.arange(len(strings)), [len(x) for x in strings])
    out: tuple[list, list, list] = ([], [], [])
    letter = codes != 0
    for *places, worth in PLACES:
        n = max(0, len(codes) - places[-1])
        fits = which[:n] == which[places[-1] :]
        for i in places:
            fits &= letter[i : i + n]
        at = np.flatnonzero(fits)
        key = np.zeros(len(at), np.uint64)
        for i in places:
            key = key << np.uint64(16) | codes[at + i]
        out[0].append(which[at])
        out[1].append(key)
        out[2].append(np.full(len(at), worth))
    return tuple(np.concatenate(x) for x in out)


def norms(n: int, which: np.ndarray, keys: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The norm of each of n strings' features (1 where there are none). 40 bits tell features apart."""
    packed = which.astype(np.uint64) << np.uint64(40) | mix(keys) >> np.uint64(24)
    order = np.argsort(packed)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(packed[order]) != 0])) if len(order) else order
    sums = np.add.reduceat(worth[order], starts) if len(order) else worth
    squares = np.bincount(which[order[starts]], sums**2, n)
    return np.sqrt(np.where(squares > 0, squares, 1))


@dataclass
class Kernel:
    """Kernel values with landmarks."""

    landmarks: list[str]

    def __post_init__(self) -> None:
        which, keys, worth = features(self.landmarks)
        self.keys, rows = np.unique(keys, return_inverse=True)
        self.table = np.zeros((len(self.keys), len(self.landmarks)), np.float32)
        np.add.at(self.table, (rows, which), worth)
        self.table /= norms(len(self.landmarks), which, keys, worth).astype(np.float32)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(46)).astype(np.int64)

    def __call__(self, strings: list[str]) -> np.ndarray:
        """strings x landmarks."""
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        if not strings or not len(self.keys):
            return out
        which, keys, worth = features(strings)
        size = norms(len(strings), which, keys, worth)
        some = np.flatnonzero(self.maybe[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        some, at = some[self.keys[at] == keys[some]], at[self.keys[at] == keys[some]]
        order = np.argsort(which[some], kind="stable")
        which, at, worth = which[some][order], at[order], (worth[some] / size[which[some]])[order].astype(np.float32)
        for a in range(0, len(which), BLOCK):
            own = which[a : a + BLOCK]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[starts]] += np.add.reduceat(self.table[at[a : a + BLOCK]] * worth[a : a + BLOCK, None], starts, axis=0)
        return out**POWER


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  #: of the kernel values
    bias: float
    document: np.ndarray  #: of a document's features, the constant last


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and of spelled-out ones, the sentence each is in, where sentences of
    each text start, and each sentence's first word."""
    data, starts, ends = words.data, words.starts, words.ends
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(len(words.first), np.int64), none
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    closes = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
    new = np.zeros(n, bool)
    new[0] = True
    new[1:] = closes[:-1] | (lines[starts[1:]] > lines[ends[:-1]])
    new[words.first[:-1][words.first[:-1] < n]] = True
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    new |= (np.arange(n) - begin) % LONGEST == 0
    sentence = np.cumsum(new) - 1
    # runs of characters that stand alone, across sentences' ends but not texts'
    chars = words.code_points()
    alone = (chars[ends] - chars[starts] == 1) & ~((data[starts] < 0x41) | (data[starts] > 0x5A) & (data[starts] < 0x61) | (data[starts] > 0x7A) & (data[starts] < 0x80))
    doc = words.doc()
    follows = np.concatenate([[False], alone[1:] & alone[:-1] & (doc[1:] == doc[:-1])])
    run = np.cumsum(~follows) - 1
    size = np.bincount(run)
    heads = np.flatnonzero(~follows)
    spelled = np.flatnonzero(size >= SPELLED)
    a, b = heads[spelled], heads[spelled] + size[spelled] - 1
    first = np.flatnonzero(new)
    return np.concatenate([starts, starts[a]]), np.concatenate([ends, ends[b]]), np.concatenate([sentence, sentence[a]]), np.searchsorted(first, words.first), first


class Scorer:
    """Margins of words, kept by their hash."""

    def __init__(self, kernel: Kernel, weights: np.ndarray):
        self.kernel, self.weights = kernel, weights.astype(np.float32)
        self.index, self.margins = HashIndex(), Growing(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """The margin of each word: that of its string with the largest one."""
        own = [strings_of(w) for w in words]
        flat = [x for s in own for x in s]
        each = self.kernel(flat) @ self.weights
        out = np.full(len(words), -np.inf, np.float32)
        np.maximum.at(out, np.repeat(np.arange(len(words)), [len(s) for s in own]), each)
        return np.where(np.isfinite(out), out, 0)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        index, hashes = self.index, np.maximum(span_hashes(data, starts, ends, lower=True), np.uint64(1))
        if index.n > CACHE_WORDS:
            index.clear()
            self.margins.clear()
        rows = index.find(hashes)
        new = np.flatnonzero(rows < 0)
        keys, first = np.unique(hashes[new], return_index=True)
        if not index.room(len(keys)):
            index.BITS = max(index.BITS, (2 * len(hashes)).bit_length())
            index.clear()
            self.margins.clear()
            new = np.arange(len(hashes))
            keys, first = np.unique(hashes, return_index=True)
        if len(keys):
            take, raw = new[first], data.tobytes()
            spelled = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[take].tolist(), ends[take].tolist(), strict=True)]
            self.margins.extend(self.words(spelled))
            index.put_many(keys)
            rows = index.find(hashes)
        return self.margins.view()[rows]


def document_features(toxic: np.ndarray, sentences: np.ndarray, worst: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(toxic), np.log((toxic + 0.5) / (sentences + 2)), np.clip(worst, -2, 1), np.ones(len(toxic))], axis=1)


def sentences_of(batch: pa.RecordBatch, scorer: Scorer, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray]:
    """For each text its toxic sentences, sentences and worst margin; its words, the sentences' margins
    and first words."""
    words = split_words(batch.column("text"))
    starts, ends, sentence, cuts, first = units(words)
    margins = np.full(len(first), -np.inf)
    np.maximum.at(margins, sentence, scorer.spans(words.data, starts, ends) + bias)
    total = np.concatenate([[0], np.cumsum(margins > 0)])
    worst = np.full(batch.num_rows, bias, float)
    some = np.diff(cuts) > 0
    if some.any():
        worst[some] = np.maximum.reduceat(margins, cuts[:-1][some])
    return total[cuts[1:]] - total[cuts[:-1]], np.diff(cuts), worst, words, margins, first


# ---------------------------------------------------------------- training


def newton(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Weights w that make |w|^2 / 2 + sum c max(0, 1 - y x[rows].w)^2 least; the last column is not
    shrunk. Works through the rows in blocks."""
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    w, inside = np.zeros(x.shape[1]), np.ones(len(rows), bool)
    for step in range(30):
        square, right = keep.copy(), np.zeros(x.shape[1])
        at = np.flatnonzero(inside)
        for a in range(0, len(at), NEAR_WORDS):
            own = at[a : a + NEAR_WORDS]
            part = x[rows[own]].astype(np.float64)
            weighed = part * c[own, None]
            square += 2 * weighed.T @ part
            right += 2 * weighed.T @ y[own]
        new = np.linalg.solve(square, right)
        w = new if step < 5 else (w + new) / 2
        again = np.concatenate([y[a : a + NEAR_WORDS] * (x[rows[a : a + NEAR_WORDS]] @ w) < 1 for a in range(0, len(rows), NEAR_WORDS)])
        if (again == inside).all():
            break
        inside = again
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is not shrunk."""
    keep = RIDGE * len(y) / 100 * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(keep + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (y - p) - keep @ w)
        w += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def by_hash(strings: set[str]) -> list[str]:
    data, ends = "".join(order := sorted(strings)).encode(), np.cumsum([len(x.encode()) for x in order], dtype=np.int64)
    hashes = span_hashes(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends) if order else np.zeros(0)
    return [order[i] for i in np.argsort(hashes, kind="stable")]


def candidates(strings: list[list[str]], words: np.ndarray, docs: np.ndarray, toxic: np.ndarray, most: int) -> list[str]:
    """Strings of toxic documents, those first that few clean ones have; some by hash."""
    bad, good = Counter(), Counter()
    for word, doc in np.unique(np.stack([words, docs], axis=1), axis=0).tolist():
        (bad if toxic[doc] else good).update(strings[word])
    odds = {s: n * np.log((n + 0.5) / max(1, toxic.sum()) * max(1, (toxic == 0).sum()) / (good[s] + 0.5)) for s, n in bad.items()}
    first = sorted(odds, key=lambda s: (-odds[s], s))[: most * 3 // 4]
    return list(dict.fromkeys(first + by_hash(set(bad))))[:most]


def telling(found: list[str], near: Callable[[int, int], np.ndarray], words: np.ndarray, docs: np.ndarray, toxic: np.ndarray, kernel: Kernel, most: int) -> list[str]:
    """Candidates that more of the words of toxic documents are near to than of clean ones', best first,
    none close to a better one. near(a, b): words a to b x candidates."""
    # one number for each pair of a document and a word, block of words by block
    packed, times = np.unique((words // NEAR_WORDS * len(toxic) + docs) * NEAR_WORDS + words % NEAR_WORDS, return_counts=True)
    share = np.zeros((len(toxic), len(found)), np.float32)
    for block in range(int(words.max(initial=-1)) // NEAR_WORDS + 1):
        a, b = np.searchsorted(packed, np.array([block, block + 1]) * len(toxic) * NEAR_WORDS)
        doc, word = np.divmod(packed[a:b] - block * len(toxic) * NEAR_WORDS, NEAR_WORDS)
        close = near(block * NEAR_WORDS, (block + 1) * NEAR_WORDS)
        close[close <= NEAR] = 0
        for at in range(0, len(doc), NEAR_WORDS):
            own = doc[at : at + NEAR_WORDS]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            each = close[word[at : at + NEAR_WORDS]] * times[a + at : a + at + len(own), None].astype(np.float32)
            share[own[starts]] += np.add.reduceat(each, starts, axis=0)
    share /= np.maximum(1, np.bincount(docs, minlength=len(toxic)))[:, None]
    bad, good = share[toxic > 0], share[toxic == 0]
    z = (bad.mean(axis=0) - good.mean(axis=0)) / np.sqrt(bad.var(axis=0) / len(bad) + good.var(axis=0) / len(good) + 1e-12)
    between, out = kernel(found), []
    for i in np.argsort(-z, kind="stable").tolist():
        if z[i] > SURE and len(out) < most and all(between[i, j] < CLOSE for j in out):
            out.append(i)
    return [found[i] for i in out]


def worst_words(margins: np.ndarray, sentence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each sentence's word with the largest margin, and the margin."""
    order = np.lexsort((margins, sentence))
    last = np.flatnonzero(np.concatenate([sentence[order][1:] != sentence[order][:-1], [True]])) if len(order) else order
    return order[last], margins[order[last]]


def fit(sentences: list[str], docs: np.ndarray, toxic: np.ndarray, m: int = LANDMARKS) -> tuple[Kernel, np.ndarray, float]:
    """The kernel, its landmarks' weights and the bias, from labelled sentences and their documents
    (numbered from 0)."""
    words = split_words(pa.array(sentences, pa.string()))
    starts, ends, _, _, _ = units(words)
    sentence = np.searchsorted(words.offsets, starts, "right") - 1
    raw = words.data.tobytes()
    spelled = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    vocabulary, which = np.unique(np.array(spelled, dtype=object), return_inverse=True)
    strings = [strings_of(w) for w in vocabulary]
    flat, of = [s for own in strings for s in own], np.repeat(np.arange(len(strings)), [len(s) for s in strings])

    def near(kernel: Kernel, first: int, last: int) -> np.ndarray:
        """words x landmarks: of each word's strings the nearest."""
        a, b = np.searchsorted(of, [first, min(last, len(strings))])
        out = np.zeros((min(last, len(strings)) - first, len(kernel.landmarks)), np.float32)
        if a < b:
            starts = np.flatnonzero(np.concatenate([[True], of[a + 1 : b] != of[a : b - 1]]))
            out[of[a:b][starts] - first] = np.maximum.reduceat(kernel(flat[a:b]), starts, axis=0)
        return out

    label = np.zeros(docs.max() + 1, np.int64)
    label[docs] = toxic
    wide = Kernel(candidates(strings, which, docs[sentence], label, 3 * m))
    tells = telling(wide.landmarks, partial(near, wide), which, docs[sentence], label, wide, m * 3 // 4)
    kernel = Kernel(list(dict.fromkeys(tells + by_hash(set(flat))))[:m])
    square = kernel(kernel.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    root = vectors @ np.diag(np.where(values > 1e-6, 1, 0) / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    each = np.concatenate([near(kernel, a, a + NEAR_WORDS) for a in range(0, len(strings), NEAR_WORDS)])
    x = np.concatenate([each @ root.astype(np.float32), np.ones((len(each), 1), np.float32)], axis=1)
    clean = np.bincount(which[toxic[sentence] == 0], minlength=len(strings))
    per_clean = (toxic == 0).sum() / max(1, (toxic > 0).sum())
    negative = np.flatnonzero(clean)
    bad = np.flatnonzero(toxic[sentence] > 0)
    margins = each[:, : len(tells)].max(axis=1, initial=0) - NEAR
    w = np.zeros(x.shape[1])
    w[-1] = -1
    for _ in range(ROUNDS):
        at, worst = worst_words(margins[which[bad]], sentence[bad], len(sentences))
        positive = np.bincount(which[bad[at[worst > 0]]], minlength=len(strings))
        positive[positive * per_clean <= RATIO * clean] = 0  # as frequent where nothing is toxic
        if not positive.any():
            break
        own = np.flatnonzero(positive)
        y = np.concatenate([np.ones(len(own)), -np.ones(len(negative))])
        weight = np.concatenate([positive[own], clean[negative] / RATIO]) / positive.sum()
        w = newton(x, np.concatenate([own, negative]), y, COST * weight)
        margins = x @ w
    return kernel, root @ w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, docs_of_label: int = TRAIN_DOCS, sentences: int = SENTENCES) -> Model | float:
    """docs: key (not a feature), text; labels: key, toxic (0 or 1), with none held out. A share of
    toxic labels where they are of one kind. Labels are drawn first, by hash of the key, so that what
    meets the texts is broadcast whatever the tables' size: 2 x docs_of_label rows in expectation."""
    labels = labels.filter("key is not null and toxic is not null").select("key", (F.col("toxic") != 0).cast("int").alias("toxic")).distinct()
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(max(counts, default=0))
    share = F.when(F.col("toxic") == 1, min(1.0, docs_of_label / counts[1])).otherwise(min(1.0, docs_of_label / counts[0]))
    by = F.xxhash64("key", F.lit("toxicity"))
    drawn = labels.filter(F.pmod(by, F.lit(1 << 20)) < share * (1 << 20))
    chosen = docs.select("key", "text").join(F.broadcast(drawn), "key").withColumn("seed", by)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column("text"))
                _, _, _, cuts, first = units(words)
                of = np.repeat(np.arange(part.num_rows), np.diff(cuts))
                seeds = part.column("seed").to_numpy().astype(np.uint64)[of]
                draw = mix(seeds + np.arange(len(of), dtype=np.uint64) - cuts[of].astype(np.uint64)) >> np.uint64(40)
                at = np.flatnonzero(draw < np.minimum(1.0, sentences / np.diff(cuts)[of]) * (1 << 24))
                last = np.append(first[1:], len(words.starts))[at] - 1
                raw = words.data.tobytes()
                text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first[at]].tolist(), words.ends[last].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(seeds[at].astype(np.int64)), part.column("toxic").take(pa.array(of[at])), pa.array(text, pa.string())], ["doc", "toxic", "sentence"])

    # In expectation at most 2 x docs_of_label x sentences rows of LONGEST words, however many documents there are.
    found = chosen.mapInArrow(cut, "doc bigint, toxic int, sentence string").orderBy("doc", "toxic", "sentence").toArrow()
    toxic = found["toxic"].to_numpy()
    if len(set(toxic.tolist())) < 2:
        return counts[1] / sum(counts.values())
    _, doc = np.unique(found["doc"].to_numpy(), return_inverse=True)
    kernel, weights, bias = fit(found["sentence"].to_pylist(), doc, toxic)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kernel, weights)
        for batch in batches:
            for part in chunks(batch):
                n_toxic, n, worst, *_ = sentences_of(part, scorer, bias)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(n_toxic.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(worst)], ["toxic", "bad", "n", "worst"])

    # One row for each document learned from.
    rows = chosen.mapInArrow(measure, "toxic int, bad bigint, n bigint, worst double").orderBy("toxic", "bad", "n", "worst").toArrow()
    x = document_features(*(rows[c].to_numpy() for c in ("bad", "n", "worst")))
    return Model(kernel.landmarks, weights, bias, logistic(x, rows["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", held_out: Column | None = None, with_worst: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, n_toxic and, with_worst, worst: the sentence
    of the highest margin. Labels of held-out documents aren't learned from; a document with several
    labels is learned from with each."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1 if held_out is None else held_out, F.lit(False))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(toxic_col).alias("toxic")).filter(~held_out)
    model = train(own.withColumnRenamed("doc_id", "key"), known.withColumnRenamed("doc_id", "key"))
    names = ["doc_id", "held_out", "score", "predicted", "n_sentences", "n_toxic", *["worst"] * with_worst]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = not isinstance(model, Model)
        kernel = Kernel([] if empty else model.landmarks)
        scorer = Scorer(kernel, np.zeros(0) if empty else model.weights)
        for batch in batches:
            for part in chunks(batch):
                bad, n, worst, words, margins, first = sentences_of(part, scorer, 0.0 if empty else model.bias)
                if empty:
                    result = np.full(part.num_rows, model)
                else:
                    result = 1 / (1 + np.exp(-np.clip(document_features(bad, n, worst) @ model.document, -30, 30)))
                arrays = [part.column("doc_id"), part.column("held_out"), pa.array(result), pa.array((result >= TOXIC).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(bad.astype(np.int64))]
                if with_worst:
                    cuts = np.concatenate([[0], np.cumsum(n)])
                    last, raw, text = np.append(first[1:], len(words.starts)) - 1, words.data.tobytes(), []
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        at = a + int(np.argmax(margins[a:b])) if b > a else -1
                        text.append(raw[words.starts[first[at]] : words.ends[last[at]]].decode("utf-8", "replace") if b > a else None)
                    arrays.append(pa.array(text, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)
        give_back()

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences bigint, n_toxic bigint{', worst string' * with_worst}")
