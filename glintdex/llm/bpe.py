"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is exactly one token that ends the prefix's own encoding.  A suffix automaton over the
vocabulary lists the tokens that end at a position; a token is the right one if it may stand after the last token of
the prefix before it, that is if no merge would join them.  Back-pointers from the word's end give its ids, the same
that applying merges by rank gives.

Defined results: a null or empty text has no ids and decodes to ""; text of any length is encoded whole; special-token
strings in a text become their ids; null ids decode to "".  Other columns stay out of it: only the key and the text
are read, so names that clash don't matter.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintdex.llm.shared import kept_by_worker, slices
from glintdex.llm.words import Splitter, WordIds, byte_symbols

END = "</w>"
NEVER = 1 << 60


class SuffixAutomaton:
    """Of a set of token strings (tuples of symbols): which of them end at each position of a word."""

    def __init__(self, tokens: dict[tuple[int, ...], int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = {}
        for symbols, token in tokens.items():
            last = 0
            for s in symbols:
                last = self._extend(last, s)
            ends[last] = token
        # A token's own end is in no longer token, so it is the longest string of its state and the only one there.
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.token = [ends.get(v, -1) for v in range(len(self.next))]
        self.up = [-1] * len(self.next)
        for v in order[1:]:
            parent = self.link[v]
            self.up[v] = parent if self.token[parent] >= 0 else self.up[parent]

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, s: int) -> int:
        """A state for the part of ``q``'s strings that ``p`` reaches by ``s``."""
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(s) == q:
            self.next[p][s] = c
            p = self.link[p]
        return c

    def _extend(self, p: int, s: int) -> int:
        q = self.next[p].get(s)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._clone(p, q, s)
        new = self._new(self.length[p] + 1, 0, {})
        while p >= 0 and s not in self.next[p]:
            self.next[p][s] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][s]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, s)
        return new


class Steps:
    """An automaton's moves as a hash table in arrays: from many states at once, by a symbol each."""

    def __init__(self, automaton: SuffixAutomaton, place: dict[int, int]):
        found = [(v << 9 | place[s], to) for v, step in enumerate(automaton.next) for s, to in step.items()]
        keys, to = (np.array(c, np.int64) for c in zip(*found, strict=True))
        self.bits = int(len(keys) * 3).bit_length()
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        self.tries = 0
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = keys[free]  # of several for one slot the last stays
            left = left[self.key[at[left]] != keys[left]]
            done = self.key[at] == keys
            self.to[at[done]] = to[done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.tries += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> (63 - self.bits)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state after each move, -1 where there is none."""
        key = state << 9 | symbol
        at = self._slot(key)
        out = np.where(self.key[at] == key, self.to[at], -1)
        left = np.flatnonzero((out < 0) & (self.key[at] >= 0))
        for _ in range(self.tries - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            hit = self.key[at[left]] == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (self.key[at[left]] >= 0)]
        return out


class PrefixCodec:
    """Encodes and decodes as the vocabulary file at ``path`` says."""

    #: Words of more bytes are encoded one by one, others side by side.
    LONG = 64
    #: Remembered answers of ``compatible``, as a power of two.
    FITS = 20

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        model = self.splitter.file["model"]
        vocab = model["vocab"]
        self.tokens = token_list(self.splitter.file)
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(model["merges"])}
        self.merged = [vocab[a + b] for a, b in model["merges"]]
        letters = byte_symbols()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + END] for b in range(256)]
        self.symbols = {i: self._symbols(token, vocab) for token, i in vocab.items()}
        self.right, self.left = functools.cache(self._right), functools.cache(self._left)
        # A token that its own symbols never merge into can't end any prefix.
        self.automaton = SuffixAutomaton({s: i for i, s in self.symbols.items() if self._made(i) is not None})
        self.fits: dict[int, bool] = {}
        sam = self.automaton
        # Symbol k is byte k inside a word, 256 + k the same at its end.
        self.steps = Steps(sam, {s: k for k, s in enumerate([*self.inner, *self.final])})
        self.link, self.length, self.token, self.up = (np.array(x, np.int64) for x in (sam.link, sam.length, sam.token, sam.up))
        self.size = np.zeros(len(self.tokens), np.int64)
        for i, own in self.symbols.items():
            self.size[i] = len(own)
        self.fit_key, self.fit = np.full(1 << self.FITS, -1, np.int64), np.zeros(1 << self.FITS, bool)
        self.words = WordIds(self.splitter, self.encode_words)

    @staticmethod
    def _symbols(token: str, vocab: dict[str, int]) -> tuple[int, ...]:
        if token.endswith(END) and len(token) > len(END):
            head, last = token[: -len(END) - 1], token[-len(END) - 1 :]
            return (*(vocab[c] for c in head), vocab[last])
        return tuple(vocab[c] for c in token)

    @functools.cache  # noqa: B019  one codec lives as long as its worker
    def _made(self, i: int) -> tuple[int, int, int] | None:
        """The last merge (left, right, rank) by which token ``i`` comes of its own symbols; () for a symbol, None if never."""
        parts, merge = list(self.symbols.get(i, ())), ()
        while len(parts) > 1:
            found = min(((r, k) for k, pair in enumerate(itertools.pairwise(parts)) if (r := self.rank.get(pair)) is not None), default=None)
            if found is None:
                return None
            r, k = found
            merge = (parts[k], parts[k + 1], r)
            parts[k : k + 2] = [self.merged[r]]
        return merge if parts == [i] else None

    def _edge(self, i: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``i`` while it is made, each with the rank of the merge that ends it."""
        out, until = [], NEVER
        while True:
            out.append((i, until))
            merge = self._made(i)
            if not merge:
                return out
            i, until = merge[side], merge[2]

    def _right(self, i: int) -> list[tuple[int, int]]:
        return self._edge(i, 1)

    def _left(self, i: int) -> list[tuple[int, int]]:
        return self._edge(i, 0)

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` stays beside ``a``: no merge across the border comes while both its parts are there.

        Of equal pairs the leftmost merges first, so a merge inside ``a`` of the same rank wins and one inside ``b`` loses.
        """
        rank = self.rank.get
        return not any((r := rank((x, y))) is not None and r < x_until and r <= y_until for x, x_until in self.right(a) for y, y_until in self.left(b))

    def _encode(self, word: str) -> list[int]:
        if word in self.splitter.special:
            return [self.splitter.special[word]]
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        sam, state = self.automaton, 0
        step, link, token_of, up, length, fits = sam.next, sam.link, sam.token, sam.up, sam.length, self.fits
        last = [-1] * len(symbols)
        matched = 0
        for i, s in enumerate(symbols):
            while state and s not in step[state]:
                state = link[state]
                matched = length[state]
            if s in step[state]:
                state = step[state][s]
                matched += 1
            # The state may also hold strings longer than what matched; then its token is one of those.
            v = state if token_of[state] >= 0 and length[state] <= matched else up[state]
            while v > 0:
                token, before = token_of[v], i - length[v]
                if before < 0:
                    last[i] = token
                    break
                pair = last[before] << 20 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.compatible(last[before], token)
                if fit:
                    last[i] = token
                    break
                v = up[v]
        out, i = [], len(symbols) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(self.symbols[last[i]])
        return out[::-1]

    def _fitting(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs.  Each pair has one slot of a table; another pair there gives way."""
        pair = before << 20 | token
        at = (pair * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> (63 - self.FITS)
        out, new = self.fit[at], np.flatnonzero(self.fit_key[at] != pair)
        if len(new):
            own, which = np.unique(pair[new], return_inverse=True)
            fits = np.array([self.compatible(p >> 20, p & 0xFFFFF) for p in own.tolist()], bool)
            out[new] = fits[which]
            self.fit_key[at[new]] = pair[new]
            self.fit[at[new]] = self._of_last(at[new], out[new])
        return out

    @staticmethod
    def _of_last(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each slot the value of the pair that was written there last."""
        _, first = np.unique(at[::-1], return_index=True)
        slots = at[::-1][first]
        return values[::-1][first][np.searchsorted(slots, at)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids.  All words go on by one symbol at a time, the longest ones first in the arrays."""
        raw = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(words)
        short = []
        for k, (w, r) in enumerate(zip(words, raw, strict=True)):
            if w in self.splitter.special or len(r) > self.LONG:
                out[k] = np.array(self._encode(w), "<u4").tobytes()
            else:
                short.append(k)
        short.sort(key=lambda k: -len(raw[k]))
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for k, ids in zip(part, self._side_by_side([raw[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _side_by_side(self, raw: list[bytes]) -> list[bytes]:
        sizes = np.array([len(r) for r in raw])
        ends = np.cumsum(sizes)
        start = ends - sizes
        symbol = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbol[ends - 1] += 256
        last = np.zeros(len(symbol), np.int64)
        state, matched = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i, "left"))  # words that go on
            at = start[:n] + i
            s, own, held = symbol[at], state[:n], matched[:n]
            to = self.steps(own, s)
            stuck = np.flatnonzero((to < 0) & (own > 0))
            while len(stuck):
                own[stuck] = self.link[own[stuck]]
                held[stuck] = self.length[own[stuck]]
                to[stuck] = self.steps(own[stuck], s[stuck])
                stuck = stuck[(to[stuck] < 0) & (own[stuck] > 0)]
            moved = to >= 0
            own[:] = np.where(moved, to, 0)
            held[:] = np.where(moved, held + 1, 0)
            # The state may also hold strings longer than what matched; then its token is one of those.
            v = np.where((self.token[own] >= 0) & (self.length[own] <= held), own, self.up[own])
            open_ = np.flatnonzero(v > 0)
            while len(open_):
                token, before = self.token[v[open_]], i - self.length[v[open_]]
                fit = before < 0
                inner = np.flatnonzero(~fit)
                fit[inner] = self._fitting(last[start[open_[inner]] + before[inner]], token[inner])
                last[at[open_[fit]]] = token[fit]
                open_ = open_[~fit]
                v[open_] = self.up[v[open_]]
                open_ = open_[v[open_] > 0]
        # Back-pointers, from all ends at once; ids are marked where they end.
        used = np.zeros(len(symbol), bool)
        at = ends - 1
        here = np.arange(len(raw))
        while len(here):
            used[at] = True
            at = at - self.size[last[at]]
            on = at >= start[here]
            at, here = at[on], here[on]
        ids = last[used].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(used)[ends - 1]).tolist()]
        return [ids[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each whole text's ids."""
        if len(self.fits) > 500_000:
            self.fits.clear()
        return [np.frombuffer(x, "<u4") for x in self.words.encode_all(texts)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return decode(self.tokens, ids)


def decode(tokens: list[str], ids: list[int]) -> str:
    """As the library without a decoder: tokens joined by a space."""
    return " ".join(map(tokens.__getitem__, ids))


def token_list(file: dict) -> list[str]:
    """Token by id, special ones too."""
    found = file["model"]["vocab"] | {x["content"]: x["id"] for x in file["added_tokens"]}
    tokens = [""] * (1 + max(found.values()))
    for token, i in found.items():
        tokens[i] = token
    return tokens


@functools.lru_cache(2)
def stored_tokens(path: str) -> list[str]:
    """All that decoding needs."""
    with open(path, encoding="utf-8") as f:
        return token_list(json.load(f))


def codec(path: str) -> PrefixCodec:
    """One for each worker process and vocabulary."""
    return kept_by_worker(("codec", path), lambda: PrefixCodec(path))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32)))


def encode_documents(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every whole text; with ``decoded`` also the ``text`` that the ids decode to.

    That is ``decode_documents`` in the same pass over the data, from the ids alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for batch in batches:
            for part in slices(batch, 1):
                ids = c.encode_all(part.column(1).to_pylist())
                columns = [part.column(0), _lists(ids)]
                if decoded:
                    columns.append(pa.array([decode(c.tokens, x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "text"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, vocab: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and the decoded ``text`` of every row of ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = stored_tokens(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, flat = part.column(1), part.column(1).flatten().to_numpy().tolist()
                ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
                texts = [decode(tokens, flat[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], [key, "ids", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, text string")


def digests(docs: DataFrame, vocab: str) -> DataFrame:
    """The round trip of every document: number of ids, SHA-256 of the ids and of the decoded text."""
    trip = encode_documents(docs, vocab, decoded=True)
    return trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
