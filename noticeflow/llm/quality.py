"""Operator 5: quality by weak supervision.

Rules look at a text's counts and vote: 1 (good), -1 (bad) or 0 (abstain). How often each rule votes
which way on good and on bad texts is estimated by expectation-maximisation over the votes of all
documents, without labels, starting from a guess (DEFECT, MERIT) that also counts as a prior worth
PRIOR of the documents; a rule's vote can't count against its own meaning. A text is kept if it
passes the base rules and its posterior probability of being good is at least KEEP. Documents come in
as counts of vote patterns (at most 3 to the number of rules), so the estimation doesn't grow with
the corpus. Letters and capitals are Unicode's, so emoji, currency signs and punctuation of any
script aren't letters.

Defined results: null text counts as empty: all counts 0, base_failed. Repeated rows give repeated
results; a null id stays null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, columns, gram_hashes, materialize, mix, span_hashes, split_words

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
PRIOR, DEFECT, MERIT, GOOD, KEEP, ROUNDS = 0.05, 0.95, 0.6, 0.8, 0.5, 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_letter_words", "n_ended_lines")
_SYMBOL, _END = (np.zeros(256, bool) for _ in range(2))
_SYMBOL[list(b"#*$%&|<>")] = True
_END[list(b".!?:;\"')")] = True


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and a capital, by Unicode's categories."""
    letter, upper = (np.zeros(0x110000, bool) for _ in range(2))
    for i in range(0x110000):
        c = chr(i)
        letter[i], upper[i] = c.isalpha(), c.isupper()
    return letter, upper & letter


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a letter, and a capital, starts at each byte."""
    letter, upper = _alphabet()
    out = [np.where(data < 0x80, x[:256][data], False) for x in (letter, upper)]
    leads = np.flatnonzero(data >= 0xC0)
    points = code_points(data, leads)
    for flags, x in zip(out, (letter, upper), strict=True):
        flags[leads] = x[points]
    return out[0], out[1]


def _sum(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _twins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which equal any other one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for each text."""
    w = split_words(texts)
    data, n = w.data, len(w.first) - 1
    words = np.diff(w.first)
    doc = w.doc()
    per_doc = lambda flags, edges: (s := _sum(flags))[edges[1:]] - s[edges[:-1]]
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    lead = _sum((data & 0xC0) != 0x80)
    letter, upper = _letters(data)
    letters = _sum(letter)
    out = {"n_words": words, "word_chars": per_doc(lead[w.ends] - lead[w.starts], w.first), "n_symbols": per_doc(_SYMBOL[data], w.offsets)}

    # Lines: cut at line feeds and where texts begin.
    breaks = np.flatnonzero(data == 0x0A)
    ends = np.sort(np.concatenate([breaks, w.offsets[1:]]))  # a text's last line ends where it does
    starts = np.sort(np.concatenate([breaks + 1, w.offsets[:-1]]))
    line_doc = np.repeat(np.arange(n), 1 + per_doc(data == 0x0A, w.offsets))
    word_at = np.searchsorted(w.starts, np.stack([starts, ends]))
    full = np.flatnonzero(word_at[1] > word_at[0])
    own = line_doc[full]
    dup, _ = _twins(mix(span_hashes(data, starts[full], ends[full]) ^ salt[own]))
    out["n_dup_lines"], out["n_lines"] = np.bincount(own[dup], minlength=n), np.bincount(own, minlength=n)
    ended = _END[data[w.ends[word_at[1][full] - 1] - 1]] if len(full) else np.zeros(0, bool)
    out["n_ended_lines"] = np.bincount(own[ended], minlength=n)

    # Words in windows that are found again.
    last = np.repeat(w.first[1:], words)
    at = np.flatnonzero(np.arange(len(doc)) + WINDOW <= last)
    _, again = _twins(mix(gram_hashes(w.hashes(), at, at + WINDOW) ^ salt[doc[at]]))
    step = np.zeros(len(doc) + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + WINDOW, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(step[:-1]) > 0, w.first)

    out["n_letters"] = letters[w.offsets[1:]] - letters[w.offsets[:-1]]
    out["n_upper"] = per_doc(upper, w.offsets)
    out["n_letter_words"] = per_doc(letters[w.ends] > letters[w.starts], w.first)
    return out


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    source = columns(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def rules() -> dict[str, tuple[Column, float]]:
    """Each rule's vote, over the columns COUNTS, and how often it is taken to be right before
    estimation. Rules that look for one defect abstain without it, as texts have other defects;
    the rules for what any good text has vote for it with little weight. Shares of nothing abstain."""
    c = F.col
    share = lambda a, b: c(a) / F.nullif(c(b), F.lit(0))
    bad = lambda x: (F.when(x, -1).otherwise(0), DEFECT)
    good = lambda x: (F.when(x, 1).otherwise(0), MERIT)
    return {
        "symbols": bad(share("n_symbols", "n_words") > 0.1),
        "capitals": bad(share("n_upper", "n_letters") > 0.5),
        "windows": bad(share("n_repeat_words", "n_words") > 0.15),
        "lines": bad(share("n_dup_lines", "n_lines") > 0.3),
        "word_size": bad(~share("word_chars", "n_words").between(2.5, 12)),
        "letters": bad(share("n_letter_words", "n_words") < 0.7),
        "length": good(c("n_words") >= 50),
        "endings": good(share("n_ended_lines", "n_lines") >= 0.9),
    }


def estimate(patterns: np.ndarray, weights: np.ndarray, accuracies: list[float], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """From vote patterns (patterns x rules) and how many documents have each: the share of good
    documents, and the chances of votes -1, 0, 1 of each rule on bad and on good ones (rules x 2 x
    3)."""
    total = max(float(weights.sum()), 1.0)
    k = patterns.shape[1]
    prior = np.empty((k, 2, 3))
    for i, right in enumerate(accuracies):
        silent = float(weights[patterns[:, i] == 0].sum()) / total
        speak = 1 - silent
        prior[i] = [[speak * right, silent, speak * (1 - right)], [speak * (1 - right), silent, speak * right]]
    prior = (prior + 0.01) / (prior + 0.01).sum(axis=2, keepdims=True)
    chances, good = prior, GOOD
    for _ in range(rounds):
        p = posterior(patterns, good, chances)
        good = (float((weights * p).sum()) + PRIOR * total * GOOD) / (total * (1 + PRIOR))
        new = np.empty_like(chances)
        for y, w in ((0, weights * (1 - p)), (1, weights * p)):
            for v in (-1, 0, 1):
                new[:, y, v + 1] = ((patterns == v) * w[:, None]).sum(axis=0)
        new += PRIOR * total * prior
        new /= new.sum(axis=2, keepdims=True)
        bad = new[:, 0, 0] < new[:, 1, 0]  # a vote for bad that is likelier on good texts says nothing
        new[bad, :, 0] = new[bad, :, 0].mean(axis=1, keepdims=True)
        up = new[:, 1, 2] < new[:, 0, 2]
        new[up, :, 2] = new[up, :, 2].mean(axis=1, keepdims=True)
        new /= new.sum(axis=2, keepdims=True)
        if np.abs(new - chances).max() < 1e-9:
            break
        chances = new
    return good, chances


def posterior(patterns: np.ndarray, good: float, chances: np.ndarray) -> np.ndarray:
    """The probability that a document with each vote pattern is good."""
    logs = np.log(chances)
    odds = np.log(good / (1 - good)) + sum(logs[i, 1, patterns[:, i] + 1] - logs[i, 0, patterns[:, i] + 1] for i in range(patterns.shape[1]))
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, quality (the posterior)."""
    voting = rules()
    code = sum(((v + 1) * 3**i for i, (v, _) in enumerate(voting.values())), F.lit(0))
    table = materialize(counts(docs, id_col, text_col).withColumn("votes", code.cast("int")), "counts")
    # At most 3 ** len(rules) rows, however many documents there are.
    seen = table.groupBy("votes").agg(F.count("*").alias("n")).collect()
    codes = np.array(sorted(r.votes for r in seen), np.int64)
    weights = {r.votes: r.n for r in seen}
    patterns = codes[:, None] // 3 ** np.arange(len(voting)) % 3 - 1
    chances = posterior(patterns, *estimate(patterns, np.array([weights[x] for x in codes.tolist()], float), [a for _, a in voting.values()])) if len(codes) else np.zeros(0)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    # The table of posteriors has one row for each pattern, so it can be broadcast whatever the corpus.
    known = docs.sparkSession.createDataFrame(list(zip(codes.tolist(), chances.tolist(), strict=True)), "votes int, quality double")
    kept = ~F.col("base_failed") & (F.col("quality") >= KEEP)
    return table.join(F.broadcast(known), "votes").select(*names, failed.alias("base_failed"), "quality").select(*names, "base_failed", kept.alias("kept"), "quality")
