"""Operator 6: BPE encoding and decoding with a tokenization automaton.

The merges compile, one after the other, into a deterministic automaton over tokens. At first
there is a state for each base symbol and an arc from each state by each symbol. The gadget of
merge r, (a, b) -> c, cuts the arc by b out of a's state, and adds a state c whose outgoing arcs
are those that b's state has at this moment and which is entered wherever a was, at this moment.
A token sequence that the finished automaton accepts is the one that BPE gives for its string.

All of it is compiled into flat arrays, which hold for the automaton's life:

- gadgets: left and right part and rank of each state, and a table of cut arcs (a, b) -> rank;
- labels: a table of transitions (node, byte) -> node that spells the labels of the states from
  their last byte to the first, and the state of each node at which a label is complete;
- arcs: a table (state, token) -> open or cut. A full row would have an arc for almost every token,
  so arcs are computed when first asked for, by following the gadgets that copied them back to their
  symbols, and kept.

Exactly one accepted path spells a word, and its prefixes are accepted paths too. So words are encoded
from left to right, one byte of all words of a chunk at a time: the state after a byte is that of the
label which ends there and whose arc leaves the state at its start. Decoding emits the labels of the
arcs.

All texts take the same way. Lower-casing and composition of what lies outside ASCII and the plain
Latin-1 letters is left to the library's normaliser, for each distinct run of such characters (and the
character before it, with which it may compose) once; whether a character is a letter, a number, white
space or another is asked of the library's splitter once for each character.

Null text counts as empty: no tokens, and the hashes of nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Growing, HashIndex, chunks, code_points, columns, give_back, mix, span_hashes, text_bytes

WORD_END = "</w>"
#: Words that a worker keeps: the table is emptied at the first chunk after it holds more.
CACHE_WORDS = 700_000
#: Arcs that a worker keeps; the table is emptied when it is full.
CACHE_ARCS = 700_000
#: Normalised runs that a worker keeps, and the bytes of the longest.
CACHE_RUNS, RUN_BYTES = 50_000, 64
#: Bytes of new words that are encoded side by side.
BLOCK_BYTES = 1 << 18
#: With fewer words than this left at a place, the rest of each is encoded by itself.
SIDE_BY_SIDE = 12


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable symbol for each byte that byte-level vocabularies use."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (x for x in range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Transitions:
    """(node, byte) -> node; nodes 0 and 1 are the starts for labels within a word and at its end.
    Nodes near the start have a full row, the others are looked up."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, kind: np.ndarray, states: np.ndarray):
        """flat[ends[i - 1]:ends[i]] are the bytes of label i, kind[i] its start, states[i] its state."""
        sizes = np.diff(ends, prepend=0)
        node, alive, n, keys, self.dense = kind.astype(np.int64), np.arange(len(sizes)), 2, [], 2
        found: list[tuple[np.ndarray, np.ndarray]] = []
        depth = 0
        while len(alive):
            key, which = np.unique(node[alive] << 8 | flat[ends[alive] - 1 - depth], return_inverse=True)
            node[alive] = n + which
            keys.append(key)
            n += len(key)
            self.dense = n if not depth else self.dense
            depth += 1
            whole = alive[sizes[alive] == depth]
            found.append((node[whole], states[whole]))
            alive = alive[sizes[alive] > depth]
        all_keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.state = np.full(n, -1, np.int32)
        for at, which in found:
            self.state[at] = which
        near = all_keys < self.dense << 8
        self.rows = np.full(self.dense << 8, -1, np.int32)
        self.rows[all_keys[near]] = 2 + np.flatnonzero(near)
        far = np.flatnonzero(~near)
        self.table = HashIndex(max(4, (2 * len(far)).bit_length()))
        self.table.put_many(mix((all_keys[far] + 1).astype(np.uint64)))
        self.first_far = int(far[0]) + 2 if len(far) else n  # keys come level by level, so far ones are the last

    def step(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The next node of each, -1 where there is none."""
        keys = nodes.astype(np.int64) << 8 | data
        near = nodes < self.dense
        if near.all():
            return self.rows[keys]
        out = self.table.find(mix((keys + 1).astype(np.uint64)))
        out = np.where(out >= 0, out + self.first_far, -1)
        if near.any():
            out[near] = self.rows[keys[near]]
        return out


class Automaton:
    """States are tokens: bytes and whether they end their word; allowed(t, u) is the transition
    from state t by token u."""

    def __init__(self, names: list[tuple[bytes, bool]], merges: list[tuple[int, int, int]]):
        """names: the states, base symbols first; merges (a, b, c) in order of rank."""
        n, parts = len(names), np.array(merges, np.int64).reshape(-1, 3)
        self.left, self.right, self.rank = (np.full(n, -1, np.int32) for _ in range(3))
        ranks = np.arange(len(parts), dtype=np.int32)
        for into, x in ((self.left, parts[::-1, 0]), (self.right, parts[::-1, 1]), (self.rank, ranks[::-1])):
            into[parts[::-1, 2]] = x  # of several merges to one token the first holds
        pair, first = np.unique(parts[:, 0] << 32 | parts[:, 1], return_index=True)
        self.cuts = HashIndex(max(4, (2 * len(pair)).bit_length()))
        self.cuts.put_many(mix(pair.astype(np.uint64) + np.uint64(1)))
        self.cut_rank = np.append(ranks[first], np.int32(len(parts)))  # the last one: not cut
        self.merges = len(parts)
        self.arcs, self.open = HashIndex(20), Growing(bool)
        made = self._made()
        kept = np.flatnonzero(made)
        sizes = np.array([len(names[i][0]) for i in kept.tolist()], np.int64)
        flat = np.frombuffer(b"".join(names[i][0] for i in kept.tolist()), np.uint8)
        self.labels = Transitions(flat, np.cumsum(sizes), np.array([names[i][1] for i in kept.tolist()], bool), kept.astype(np.int32))

    def _arc(self, t: np.ndarray, u: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether the arcs are there when merges from `before` on haven't run: each goes back to the
        gadget of the younger token, which copied it at its own rank from its last part (as a
        source) or its first part (as a target). Of two equal pairs that overlap the left one
        merges first, so an arc into a gadget of the same rank is cut too and one out of it isn't."""
        out = np.zeros(len(t), bool)
        todo = np.arange(len(t))
        t, u, before = (x.astype(np.int64) for x in (t, u, before))
        while len(todo):
            cut = self.cut_rank[self.cuts.find(mix((t << 32 | u).astype(np.uint64) + np.uint64(1)))]  # -1 finds the last one
            rt, ru = self.rank[t].astype(np.int64), self.rank[u].astype(np.int64)
            stands = cut >= before
            base = (rt < 0) & (ru < 0)
            out[todo[stands & base]] = True
            on = stands & ~base
            todo, t, u, rt, ru = todo[on], t[on], u[on], rt[on], ru[on]
            source = rt > ru
            before = np.where(source, rt, ru + 1)
            t, u = np.where(source, self.right[t], t), np.where(source, u, self.left[u])
        return out

    def _made(self) -> np.ndarray:
        """Which tokens BPE gives for their own string: their parts are given for theirs, and nothing
        joins them before their own merge does. No other token is in any accepted path."""
        own = np.flatnonzero(self.rank >= 0)
        ok = np.ones(len(self.rank), bool)
        ok[own] = self._arc(self.left[own], self.right[own], self.rank[own])
        good, left, right = ok.tolist(), self.left.tolist(), self.right.tolist()
        for c in own[np.argsort(self.rank[own])].tolist():
            good[c] = good[c] and good[left[c]] and good[right[c]]
        return np.array(good, bool)

    def allowed(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arcs (t, u) from the table; those that it doesn't hold yet are computed."""
        keys = mix((t.astype(np.int64) << 32 | u).astype(np.uint64) + np.uint64(1))
        rows = self.arcs.find(keys)
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return self.open.view()[rows]
        new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
        at = missing[first]
        fresh = self._arc(t[at], u[at], np.full(len(at), self.merges))
        out = np.empty(len(keys), bool)
        out[missing] = fresh[which]
        held = rows >= 0
        out[held] = self.open.view()[rows[held]]
        if self.arcs.n + len(new) > CACHE_ARCS or not self.arcs.room(len(new)):
            self.arcs.clear()
            self.open.clear()
        if self.arcs.room(len(new)):
            self.arcs.put_many(new)
            self.open.extend(fresh)
        return out

    def _candidates(self, data: np.ndarray, starts: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels that end at the places `at` and start in the same word: for each place where its
        labels end in the lists; first bytes and states, the longest of each place first. starts:
        the word's first byte, for each byte; last: whether it is the word's last."""
        which, node, q = np.arange(len(at)), last[at].astype(np.int32), at
        count, found = np.zeros(len(at), np.int64), []
        while len(which):
            node = self.labels.step(node, data[q])
            alive = node >= 0
            which, node, q = which[alive], node[alive], q[alive]
            state = self.labels.state[node]
            whole = np.flatnonzero(state >= 0)
            found.append((which[whole], count[which[whole]], q[whole], state[whole]))
            count[which[whole]] += 1
            more = q > starts[q]
            which, node, q = which[more], node[more], q[more] - 1
        ends = np.cumsum(count)
        first, states = np.empty(ends[-1] if len(ends) else 0, np.int32), np.empty(ends[-1] if len(ends) else 0, np.int32)
        for place, nth, q, state in found:
            to = ends[place] - 1 - nth
            first[to], states[to] = q, state
        return ends, first, states

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The accepted paths that spell words, data[ends[i - 1]:ends[i]] (not empty): their states,
        word after word, and where each word's end."""
        sizes = np.diff(ends, prepend=0)
        order = np.argsort(-sizes, kind="stable")
        paths, counts = [], np.zeros(len(sizes), np.int64)
        at = 0
        while at < len(order):  # blocks of bounded size, the longest words first
            n = max(1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), BLOCK_BYTES, "right")))
            block = order[at : at + n]
            own = sizes[block]
            spans = np.repeat(ends[block] - np.cumsum(own), own) + np.arange(int(own.sum()))
            states, used = self._encode(data[spans], own)
            to = np.cumsum(own)
            counts[block] = np.add.reduceat(used, to - own)
            paths.append(states[used])
            at += n
        done = np.concatenate(paths) if paths else np.zeros(0, np.int32)
        # From the order of length back to that of the words.
        done_ends = np.cumsum(counts[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gather(done, np.concatenate([[0], done_ends]), back)

    def _encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each byte of words in descending order of length, and which of them are
        on their word's path."""
        to = np.cumsum(sizes)
        starts = np.repeat(to - sizes, sizes)
        last = np.zeros(len(data), bool)
        last[to - 1] = True
        state, begin = np.full(len(data), -1, np.int32), np.zeros(len(data), np.int32)
        # Words that are a label as a whole need no other state.
        whole_ends, first, states = self._candidates(data, starts, last, to - 1)
        longest = np.concatenate([[0], whole_ends[:-1]])
        some = np.flatnonzero(whole_ends > longest)
        hit = some[first[longest[some]] == to[some] - sizes[some]]
        state[to[hit] - 1], begin[to[hit] - 1] = states[longest[hit]], to[hit] - sizes[hit]
        rest = np.ones(len(sizes), bool)
        rest[hit] = False
        words = np.flatnonzero(rest)
        if len(words):
            places = np.flatnonzero(np.repeat(rest, sizes))
            ends, first, states = self._candidates(data, starts, last, places)
            heads = np.concatenate([[0], ends[:-1]])
            base = (np.cumsum(sizes * rest) - sizes)[words]  # a word's first place
            own, zero = sizes[words], (to - sizes)[words]
            for i in range(int(own[0])):
                live = int(np.searchsorted(-own, -i, "left"))  # words of more than i bytes
                if live < SIDE_BY_SIDE:
                    for w in range(live):
                        self._alone(i, int(own[w]), int(base[w]), int(zero[w]), heads, ends, first, states, state, begin)
                    break
                here = base[:live] + i
                head, end, at, zeros = heads[here], ends[here], zero[:live] + i, zero[:live]
                while len(at):
                    more = head < end
                    if not more.all():
                        head, end, at, zeros = head[more], end[more], at[more], zeros[more]
                    q, token = first[head], states[head]
                    good = q == zeros
                    ask = np.flatnonzero(~good)
                    before = state[q[ask] - 1]
                    ask, before = ask[before >= 0], before[before >= 0]
                    if len(ask):
                        good[ask] = self.allowed(before, token[ask])
                    state[at[good]], begin[at[good]] = token[good], q[good]
                    on = ~good
                    head, end, at, zeros = head[on] + 1, end[on], at[on], zeros[on]
        used = np.zeros(len(data), bool)
        place = to - 1
        if (state[place] < 0).any():
            raise ValueError("no path spells a word")
        lone = sizes > 64 * max(1, int(np.median(sizes))) if len(sizes) else np.zeros(0, bool)
        for w in np.flatnonzero(lone).tolist():  # long words' paths, each by itself
            p, zero, own = int(to[w]) - 1, int(to[w] - sizes[w]), begin[to[w] - sizes[w] : to[w]].tolist()
            steps = []
            while p >= zero:
                steps.append(p)
                p = own[p - zero] - 1
            used[steps] = True
        place, zeros = place[~lone], (to - sizes)[~lone]
        while len(place):
            used[place] = True
            place = begin[place] - 1
            on = place >= zeros
            place, zeros = place[on], zeros[on]
        return state, used

    def _alone(self, i: int, size: int, base: int, zero: int, heads, ends, first, states, state, begin) -> None:
        """_encode for one word from its byte i on."""
        low, high = int(heads[base + i]), int(ends[base + size - 1])
        h, e, q, s = heads[base + i : base + size].tolist(), ends[base + i : base + size].tolist(), first[low:high].tolist(), states[low:high].tolist()
        done, began = state[zero : zero + i].tolist(), []
        known: dict[int, bool] = {}
        one = lambda t, u: bool(self.allowed(np.array([t]), np.array([u]))[0])
        for a, b in zip(h, e, strict=True):
            token, at = -1, 0
            for c in range(a - low, b - low):
                if (at := q[c]) == zero:
                    token = s[c]
                    break
                if (before := done[at - 1 - zero]) < 0:
                    continue
                key = before << 32 | s[c]
                if key not in known:
                    if len(known) > CACHE_RUNS:
                        known.clear()
                    known[key] = one(before, s[c])
                if known[key]:
                    token = s[c]
                    break
            done.append(token)
            began.append(at)
        state[zero + i : zero + size], begin[zero + i : zero + size] = done[i:], began


class WordTable(HashIndex):
    """The hash of a word -> its row of ids, in flat arrays."""

    BITS = 20

    def clear(self) -> None:
        super().clear()
        self.ids, self.ends = Growing(np.uint32), Growing(np.int64)
        self.ends.extend(np.zeros(1, np.int64))

    def add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.ends.extend(ends + self.ids.n)
        self.ids.extend(ids)
        return self.put_many(keys)


def gather(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of flat for rows, one after the other, and where each one ends."""
    counts = ends[rows + 1] - ends[rows]
    to = np.cumsum(counts)
    total = int(to[-1]) if len(to) else 0
    return flat[np.repeat(ends[rows] - (to - counts), counts) + np.arange(total)], to


# Kinds of characters. Tab, line feed, carriage return, printable ASCII and the precomposed Latin-1
# letters (bytes C3 80 to C3 BF but for the two signs) are known; lower-casing and composition are
# plain for these.
LETTER, NUMBER, WHITE, OTHER, ODD, MARKER = range(6)
_KIND = np.full(256, ODD, np.uint8)
_KIND[0x21:0x7F] = OTHER
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = WHITE
_KIND[0x30:0x3A] = NUMBER
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:0xC0] = _KIND[0xC3] = LETTER
_DOWN = np.zeros(256, np.uint8)
_DOWN[0x41:0x5B] = 0x20


def _odd(data: np.ndarray, kind: np.ndarray, latin: np.ndarray) -> np.ndarray:
    """Bytes of characters that aren't known; latin: bytes that follow a C3."""
    odd = (kind == ODD) | latin & ((data == 0x97) | (data == 0xB7))
    if odd.any():
        odd[:-1] |= odd[1:] & (data[:-1] == 0xC3)
        lead = (data & 0xC0) != 0x80
        if len(lead):
            lead[0] = True
        odd = odd[lead][np.cumsum(lead) - 1]
    return odd


class Encoder:
    """Texts to ids and labels, as the tokenizers library encodes with this vocabulary file and
    no special tokens added; truncation and padding play no part."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a BPE vocabulary with word ends and plain decoding")
        vocab = model["vocab"]
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        state: dict[str, int] = {}
        names = []
        for s in byte_of:
            for x in (s, s + WORD_END):
                state[x] = len(names)
                names.append((bytes([byte_of[s]]), x != s))
        merges = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if (c := a + b) not in state:
                state[c] = len(names)
                (left, _), (right, end) = names[state[a]], names[state[b]]
                names.append((left + right, end))
            merges.append((state[a], state[b], state[c]))
        self.automaton = Automaton(names, merges)
        self.ids_of = np.zeros(len(names), np.uint32)
        for x, t in state.items():
            self.ids_of[t] = vocab.get(x, 0xFFFFFFFF)
        self.added = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.special = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or b"(?!)")
        shown = {i: t for t, i in vocab.items()} | {i: t.decode() for t, i in self.added.items()}
        shown_bytes = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.label_ends = np.concatenate([[0], np.cumsum([len(x) for x in shown_bytes])])
        self.label_bytes = np.frombuffer(b"".join(shown_bytes), np.uint8)
        # The library's normaliser and splitter, without its model.
        bare = spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "truncation": None, "padding": None}
        tokenizer = Tokenizer.from_str(json.dumps(bare))
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.kinds = np.full(0x110000, 255, np.uint8)
        self.runs: dict[bytes, bytes] = {}
        self.words = WordTable()

    def kind_of(self, points: np.ndarray) -> np.ndarray:
        """The kinds of code points, asked of the library's splitter once for each."""
        found = self.kinds[points]
        for p in np.unique(points[found == 255]).tolist():
            c = chr(p) if not 0xD800 <= p < 0xE000 else "�"
            if len(self.splitter.pre_tokenize_str(f"a{c}a")) == 1:
                self.kinds[p] = LETTER
            else:
                self.kinds[p] = (WHITE, OTHER, NUMBER)[min(2, len(self.splitter.pre_tokenize_str(c + c)))]
        return self.kinds[points]

    def _normal(self, run: bytes) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self.normalizer.normalize_str(run.decode("utf-8", "replace")).encode()
            if len(run) <= RUN_BYTES:
                if len(self.runs) >= CACHE_RUNS:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def _markers(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Where added tokens stand: first byte, end and id of each."""
        raw, texts = data.tobytes(), set()
        for x in self.added:
            at = raw.find(x)
            while at >= 0:
                texts.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(x, at + 1)
        return [(m.start(), m.end(), self.added[m[0]]) for i in sorted(texts) for m in self.special.finditer(raw, int(offsets[i]), int(offsets[i + 1]))]

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Normalised bytes of texts, where the words in them start and end, each word's text, and
        the ids of words that are added tokens (-1: none)."""
        markers = np.array(self._markers(data, offsets), np.int64).reshape(-1, 3)
        kind = _KIND[data]
        latin = np.zeros(len(data), bool)
        latin[1:] = data[:-1] == 0xC3
        low = data + _DOWN[data] + np.where(latin & (data >= 0x80) & (data <= 0x9E), 0x20, 0).astype(np.uint8)
        odd = _odd(data, kind, latin)
        marked = np.zeros(len(data) + 1, bool)
        for a, b in markers[:, :2].tolist():
            marked[a:b] = True
        if odd.any():
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            starts = np.flatnonzero(odd & (~np.concatenate([[False], odd[:-1]]) | edge[:-1]))
            ends = np.flatnonzero(odd & (~np.concatenate([odd[1:], [False]]) | edge[1:])) + 1
            own = (starts > 0) & ~edge[starts] & ~marked[starts - 1]  # with the character before
            starts = starts - own
            starts = starts - (own & ((data[starts] & 0xC0) == 0x80))
            keys, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            normal = [self._normal(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            size = np.array([len(x) for x in normal], np.int64)
            pool = np.concatenate([low, np.frombuffer(b"".join(normal), np.uint8)])
            place = len(low) + np.cumsum(size) - size
            # Pieces in turn: what stands before a run, and the run.
            piece = np.empty(2 * len(starts) + 1, np.int64)
            piece_size = np.empty_like(piece)
            piece[0::2], piece[1::2] = np.concatenate([[0], ends]), place[which]
            piece_size[0::2], piece_size[1::2] = np.append(starts, len(low)) - piece[0::2], size[which]
            to = np.cumsum(piece_size)
            grown = np.concatenate([[0], np.cumsum(size[which] - (ends - starts))])
            low = pool[np.repeat(piece - (to - piece_size), piece_size) + np.arange(int(to[-1]))]
            shift = lambda x: x + grown[np.searchsorted(ends, x, "right")]
            offsets, markers[:, 0], markers[:, 1] = shift(offsets), shift(markers[:, 0]), shift(markers[:, 1])
            latin = np.zeros(len(low), bool)
            latin[1:] = low[:-1] == 0xC3
            kind = _KIND[low]
            odd = _odd(low, kind, latin)
            lead = (low & 0xC0) != 0x80
            if len(lead):
                lead[0] = True
            leads = np.flatnonzero(lead)
            by_lead = kind[leads]
            ask = odd[leads]
            by_lead[ask] = self.kind_of(code_points(low, leads[ask]))
            kind = by_lead[np.cumsum(lead) - 1]
        for a, b in markers[:, :2].tolist():
            kind[a:b] = MARKER
        n = len(low)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge[markers[:, 0]] = edge[markers[:, 1]] = True
        edge[1:n] |= kind[1:] != kind[:-1]
        edge[:n] |= (kind == NUMBER) & ((low & 0xC0) != 0x80)
        last = np.repeat(offsets[1:], np.diff(offsets))  # of each byte, where its text ends
        quote = np.flatnonzero((low == 0x27) & edge[:n])
        at = lambda i: np.where(i < last[quote], low[np.minimum(i, n - 1)], 0) if len(quote) else np.zeros(0, np.uint8)
        one, two = at(quote + 1), at(quote + 2)
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, np.where((one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        edge[quote + 1] = False
        edge[quote + size] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        keep = kind[starts] != WHITE
        starts, ends = starts[keep], ends[keep]
        given = np.full(len(starts), -1, np.int64)
        given[np.searchsorted(starts, markers[:, 0])] = markers[:, 2]
        return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1, given

    def _rows(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Rows of the word table for words."""
        words = self.words
        hashes = np.maximum(np.where(given >= 0, mix(given.astype(np.uint64) + np.uint64(1 << 40)), span_hashes(low, starts, ends)), np.uint64(1))
        if words.n > CACHE_WORDS:
            words.clear()
        rows = words.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        keys, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        if not words.room(len(keys)):  # more new words than there is room for: a new table, large enough for all
            words.BITS = max(words.BITS, (2 * len(hashes)).bit_length())
            words.clear()
            rows[:] = -1
            missing = np.arange(len(hashes))
            keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        take = missing[first]
        is_marker = given[take] >= 0
        sizes = np.where(is_marker, 0, ends[take] - starts[take])
        spell = np.flatnonzero(sizes)
        to = np.cumsum(sizes[spell])
        data = low[np.repeat(starts[take[spell]] - (to - sizes[spell]), sizes[spell]) + np.arange(int(to[-1]) if len(to) else 0)]
        states, path_ends = self.automaton.encode(data, to)
        counts = np.ones(len(take), np.int64)
        counts[spell] = np.diff(path_ends, prepend=0)
        ids = np.empty(int(counts.sum()), np.uint32)
        markers = np.repeat(is_marker, counts)
        ids[~markers], ids[markers] = self.ids_of[states], given[take[is_marker]]
        rows[missing] = words.add(keys, ids, np.cumsum(counts))[which]
        return rows

    def one(self, text: str) -> tuple[bytes, bytes]:
        return next(self.batch(pa.array([text], pa.string())))

    def batch(self, texts: pa.Array, with_labels: bool = True) -> Iterator[tuple[bytes, bytes]]:
        """Ids (as little-endian unsigned 32-bit integers) and, with_labels, decoded text (the labels
        of the arcs taken, with spaces between them; UTF-8) of each text."""
        data, offsets = text_bytes(texts)
        low, starts, ends, whose, given = self.segments(data, offsets)
        rows = self._rows(low, starts, ends, given)
        ids, to = gather(self.words.ids.view(), self.words.ends.view(), rows)
        cuts = np.concatenate([[0], to])[np.searchsorted(whose, np.arange(len(offsets)))]
        if with_labels:
            text, to = gather(self.label_bytes, self.label_ends, ids.astype(np.int64))
            label_cuts = np.concatenate([[0], to])[cuts]
        ids = ids.astype("<u4", copy=False)
        for i in range(len(offsets) - 1):
            labels = text[label_cuts[i] : label_cuts[i + 1]].tobytes()[:-1] if with_labels else b""
            yield ids[cuts[i] : cuts[i + 1]].tobytes(), labels

    def decode(self, ids: bytes) -> str:
        text, _ = gather(self.label_bytes, self.label_ends, np.frombuffer(ids, "<u4").astype(np.int64))
        return text.tobytes()[:-1].decode()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_tokens: bool = True) -> DataFrame:
    """A row for each row of docs, repeated ones too: doc_id, n_tokens, ids_sha256, decoded_sha256
    and, with_tokens, ids array<int> and decoded string. Null text counts as empty, and a null id
    stays null. One pass without a shuffle; the memory needed is that of one batch and the word
    table (CACHE_WORDS)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in chunks(batch):
                rows: list[list] = [[], [], [], [], []]
                for ids, decoded in e.batch(part.column("text")):
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    for out, x in zip(rows, (*row, np.frombuffer(ids, "<u4").astype("i4"), decoded.decode()) if with_tokens else row, strict=False):
                        out.append(x)
                arrays = [part.column("id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_tokens:
                    arrays += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)
        give_back()

    source = columns(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_tokens
    return source.mapInArrow(run, schema)
