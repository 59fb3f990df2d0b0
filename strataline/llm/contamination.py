"""Evaluation texts leaking into training text (problem 8).

Candidates come from SimHash windows of the sizes of the items: whole items, halves and quarters of them, since half an
item, in stretches, must be found wherever it stands. A window's 64-bit fingerprint is the sign of its weighted words' votes;
windows of documents have the same sizes, to a factor GRID. Multi-index Hamming blocks guarantee that all pairs of
fingerprints within the radius are found: of four 16-bit blocks one differs in no more bits than its part of the radius, and every
item window is listed under all values of a block that near. Candidates are verified by local in-order alignments of
weighted words, which count the item's words found; its own details must be among them, so that passages built
alike with others are no cases.

Documents are streamed past the items' index, map-only, without a shuffle; items are a bounded set, read in blocks of
ITEM_BLOCK, so a larger set takes more passes and no more memory.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.words import words

#: Windows: share of an item's words and radius in bits; windows are rounded down to sizes GRID apart.
PARTS, GRID = ((1.0, 15), (0.5, 14), (0.25, 11)), 1.4
#: Steps between the windows of an item and of a document, as shares of the window.
ITEM_STEP, STEP = 1 / 6, 1 / 16
#: Least share of a document's window that must be words of items.
KNOWN = 0.5
BITS, BLOCKS = 64, 4
#: Words between two found words of one stretch.
GAP = 8
#: Least share of an item's words that must be found.
SHARE = 0.5
#: Alignments, in mean words of the item: least score of a stretch (and as a share of a short item), cost of a changed or
#: dropped word as a share of its weight, cost of a word put in between.
STRETCH, STRETCH_SHARE, MISSED, EXTRA = 9.0, 0.3, 0.7, 0.35
#: Share of an item's own details that its stretches must hold.
OWN = 0.55
#: Items of one pass; words of a piece in which a document is searched; words fingerprinted and cells aligned at once.
ITEM_BLOCK, SLICE, CHUNK, CELLS = 2000, 5_000, 20_000, 1_000_000

_WIDTH = BITS // BLOCKS
_WEIGHTS = 8


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _near(word: str) -> set[str]:
    """Keys that words one edit apart share: the word and what remains without one letter."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def details(items: list[tuple[int, list[str]]]) -> list[np.ndarray]:
    """Which words of each item are its own (names, numbers, things): other words stand in items between the same two neighbours."""
    between: dict[tuple[str, str], set[str]] = {}
    frames = [[(ws[j - 1] if j else "", ws[j + 1] if j + 1 < len(ws) else "") for j in range(len(ws))] for _, ws in items]
    for (_, ws), around in zip(items, frames, strict=True):
        for w, f in zip(ws, around, strict=True):
            between.setdefault(f, set()).add(w)
    return [np.array([len(between[f]) > 1 for f in around], bool) for around in frames]


def near_values(bits: int) -> np.ndarray:
    """All block values with at most so many bits set."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << _WIDTH, dtype=np.uint16)) <= bits).astype(np.uint16)


class Windows:
    """Item windows of one size, to be found by fingerprints within a radius."""

    def __init__(self, size: int, radius: int, prints: np.ndarray, owners: np.ndarray):
        pairs = np.unique(np.stack([prints, owners.astype(np.uint64)]), axis=1)
        self.size, self.radius, self.prints, self.owners = size, radius, pairs[0], pairs[1].astype(np.int32)
        self.blocks = []
        for b in range(BLOCKS):
            # Parts that sum to radius - BLOCKS + 1: were every block further off, the whole would be beyond the radius.
            part = (radius + 1) // BLOCKS - 1 + (b < (radius + 1) % BLOCKS)
            near = near_values(part) if part >= 0 else np.zeros(0, np.uint16)
            keys = (self._block(self.prints, b).astype(np.uint16)[:, None] ^ near[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            start = np.zeros((1 << _WIDTH) + 1, np.int64)
            np.cumsum(np.bincount(keys, minlength=1 << _WIDTH), out=start[1:])
            self.blocks.append(((order // max(1, len(near))).astype(np.int32), start))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, item number) of all windows within the radius of a window of the item."""
        found_w, found_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b, (order, start) in enumerate(self.blocks):
            value = self._block(prints, b)
            n = start[value + 1] - start[value]
            at = np.repeat(np.arange(len(prints)), n)
            if len(at):
                other = order[np.arange(len(at)) + np.repeat(start[value] - np.cumsum(n) + n, n)]
                close = np.bitwise_count(prints[at] ^ self.prints[other]) <= self.radius
                found_w.append(at[close])
                found_i.append(self.owners[other[close]])
        return np.concatenate(found_w), np.concatenate(found_i)


class Vocabulary(dict):
    """Numbers of words in order of their first use, with their votes and what they are among the items' words."""

    def __init__(self, index: "ItemIndex"):
        super().__init__()
        self.index = index
        self.votes, self.exact, self.known, self.has_near = np.zeros((1024, BITS), np.int16), np.zeros(1024, np.int32), np.zeros(1024, bool), np.zeros(1024, bool)
        self.near: dict[int, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k == len(self.votes):
            for name in ("votes", "exact", "known", "has_near"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.votes[k] = self.index.word_votes(word)
        exact, near = self.index.like(word)
        self.exact[k], self.known[k], self.has_near[k] = exact, exact >= 0, bool(near)
        if near:
            self.near[k] = near
        return k


class ItemIndex:
    """Windows, weights and words of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], counts: Counter, total: int, own: list[np.ndarray] | None = None):
        self.own = details(items) if own is None else own
        self.ids = [i for i, _ in items]
        self.weight = {w: math.log((total + 1) / (c + 0.5)) for w, c in counts.items()}
        self.most = math.log((total + 1) / 0.5)
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.by_near: dict[str, list[int]] = {}
        for w, k in self.number.items():
            if len(w) > 3 and not w.isdigit():
                for key in _near(w):
                    self.by_near.setdefault(key, []).append(k)
        self.words = [np.array([self.number[w] for w in ws], np.int32) for _, ws in items]
        self.mean_weight = []
        for _, ws in items:
            x = np.array([self.weight[w] for w in ws])
            self.mean_weight.append(x / x.mean() if x.sum() else np.ones(len(ws)))
        self.vocabulary = Vocabulary(self)
        grouped: dict[tuple[int, int], list] = {}
        for k, (_, ws) in enumerate(items):
            ids = self.numbers(ws)
            for part, radius in PARTS:
                size = window_size(math.ceil(part * len(ws)))
                starts = np.arange(0, len(ws) - size + 1, max(1, int(size * ITEM_STEP)))
                starts = np.unique(np.append(starts, max(0, len(ws) - size)))
                prints = self.fingerprints(ids, size, starts)
                grouped.setdefault((size, radius), []).append((prints, np.full(len(prints), k, np.int32)))
        self.windows = [Windows(*key, *map(np.concatenate, zip(*parts, strict=True))) for key, parts in sorted(grouped.items())]

    def word_votes(self, word: str) -> np.ndarray:
        """Votes of a word for the bits of a fingerprint, by its rarity among the items; words of no item have none."""
        if word not in self.weight:
            return np.zeros(BITS, np.int16)
        signs = np.unpackbits(np.frombuffer(word_hash(word).to_bytes(8, "little"), np.uint8), bitorder="little").astype(np.int16) * 2 - 1
        return signs * np.int16(max(1, round(_WEIGHTS * self.weight[word] / self.most)))

    def like(self, word: str) -> tuple[int, tuple[int, ...]]:
        """(number of the item word, numbers of item words one edit away); -1 if it is no item word."""
        exact = self.number.get(word, -1)
        if exact >= 0 or len(word) <= 3 or word.isdigit():
            return exact, ()
        if len(word) > 1 + self.longest:  # further than one edit from every item word
            return -1, ()
        return -1, tuple(sorted({k for key in _near(word) for k in self.by_near.get(key, ())}))

    @property
    def longest(self) -> int:
        if not hasattr(self, "_longest"):
            self._longest = max(map(len, self.number), default=0)
        return self._longest

    def numbers(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.__getitem__, ws), np.int32, len(ws))

    def fingerprints(self, ids: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows of ``size`` words that begin at ``starts``; a shorter text is one window."""
        # Sums of one window are small, so differences of running sums are right though these may wrap around.
        sums = np.zeros((len(ids) + 1, BITS), np.int16)
        np.cumsum(self.vocabulary.votes[ids], axis=0, dtype=np.int16, out=sums[1:])
        return self._signs(sums, size, starts)

    @staticmethod
    def _signs(sums: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
        ends = np.minimum(starts + size, len(sums) - 1)
        return np.packbits((sums[ends] - sums[starts]) > 0, axis=1, bitorder="little").view(np.uint64).ravel()

    def candidates(self, pieces: list[np.ndarray]) -> set[tuple[int, int]]:
        """(piece, item) of all pieces of text with a window within the radius of one of the item's."""
        ids, lengths = np.concatenate(pieces), np.array([len(p) for p in pieces])
        owner, first = np.repeat(np.arange(len(pieces)), lengths), np.cumsum(lengths) - lengths
        sums = np.zeros((len(ids) + 1, BITS), np.int16)
        np.cumsum(self.vocabulary.votes[ids], axis=0, dtype=np.int16, out=sums[1:])
        held = np.append(0, np.cumsum(self.vocabulary.known[ids]))
        found: set[tuple[int, int]] = set()
        for w in self.windows:
            starts = np.arange(0, len(ids) - w.size + 1, max(1, int(w.size * STEP)))
            starts = starts[owner[starts] == owner[starts + w.size - 1]] if len(starts) else starts
            # The first and the last window of every piece, whatever the step.
            whole = lengths >= w.size
            starts = np.unique(np.concatenate([starts, first[whole], (first + lengths - w.size)[whole]]))
            # A window of other words for the most part repeats no item.
            starts = starts[held[starts + w.size] - held[starts] >= KNOWN * w.size]
            at, item = w.hits(self._signs(sums, w.size, starts))
            found.update(zip(owner[starts[at]].tolist(), item.tolist(), strict=True))
        return found

    def present(self, ids: np.ndarray) -> np.ndarray:
        """Which item words stand somewhere among these words, one edit in a word allowed."""
        out, known, once = np.zeros(len(self.number), bool), self.vocabulary, np.unique(ids)
        out[known.exact[once[known.known[once]]]] = True
        for k in once[known.has_near[once]].tolist():
            out[list(known.near[k])] = True
        return out

    def same(self, item: int, ids: np.ndarray) -> np.ndarray:
        """Which of the item's words (rows) equal these words (columns), one edit in a word allowed."""
        a, known = self.words[item], self.vocabulary
        same = a[:, None] == known.exact[ids][None, :]
        for j in np.flatnonzero(known.has_near[ids]):
            for number in known.near[int(ids[j])]:
                same[:, j] |= a == number
        return same

    def align(self, todo: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """Which of the item's words lie in stretches that the columns of each matrix repeat in order; matrices are stacked."""
        order = sorted(range(len(todo)), key=lambda k: todo[k][1].shape[1])
        out: list = [None] * len(todo)
        while order:
            # From the widest down, as many as fit.
            n = todo[order[-1]][1].shape[1]
            rows = max(len(self.words[todo[k][0]]) for k in order)
            some = order[-max(1, CELLS // max(1, n * rows)) :]
            del order[-len(some) :]
            weights, sames = [self.mean_weight[todo[k][0]] for k in some], [todo[k][1] for k in some]
            for k, covered in zip(some, covered_words(weights, sames), strict=True):
                out[k] = covered
        return out

    def _has_own(self, item: int, found: np.ndarray) -> bool:
        """Whether the stretches found hold the item's own details and not only wording that it shares."""
        at = np.nonzero(found)[0]
        stretch = found.copy()
        for a, b in zip(at, at[1:], strict=False):
            if b - a <= GAP:
                stretch[a:b] = True
        return (found & self.own[item]).sum() >= OWN * (stretch & self.own[item]).sum()

    def search_all(self, documents: list[list[str]], share: float = SHARE) -> list[list[tuple[int, float]]]:
        """(item id, share of its words found) of the candidate items of each document; those that cannot reach ``share`` are left out."""
        if len(self.vocabulary) > 200_000:
            self.vocabulary = Vocabulary(self)
        ids = [self.numbers(ws) for ws in documents]
        overlap = max((w.size for w in self.windows), default=1) - 1
        pieces = [(d, x[at : at + SLICE + overlap]) for d, x in enumerate(ids) for at in range(0, len(x), SLICE)]
        spots: set[tuple[int, int]] = set()
        while pieces:
            some, held = [], 0
            while pieces and held < CHUNK:
                some.append(pieces.pop())
                held += len(some[-1][1])
            spots.update((some[k][0], item) for k, item in self.candidates([x for _, x in some]))
        found: dict[tuple[int, int], np.ndarray] = {}
        todo: list[tuple[int, np.ndarray]] = []
        pairs: list[tuple[int, int]] = []
        cells = 0

        def settle() -> None:
            for pair, covered in zip(pairs, self.align(todo), strict=True):
                found[pair] = found[pair] | covered if pair in found else covered
            todo.clear()
            pairs.clear()

        last, present = -1, np.zeros(0, bool)
        for d, item in sorted(spots):
            if d != last:
                last, present = d, self.present(ids[d])
            # Words that stand nowhere cannot be found.
            if present[self.words[item]].mean() >= share:
                # Slices overlap by more than a stretch can reach.
                reach = SLICE + 4 * len(self.words[item])
                parts = [self.same(item, ids[d][at : at + reach]) for at in range(0, len(ids[d]), SLICE)]
                todo += [(item, x) for x in parts]
                pairs += [(d, item)] * len(parts)
                cells += sum(x.size for x in parts)
            if cells > 8 * CELLS:
                settle()
                cells = 0
        settle()
        out: list[list[tuple[int, float]]] = [[] for _ in documents]
        for (d, item), covered in sorted(found.items()):
            out[d].append((self.ids[item], float(covered.mean()) if self._has_own(item, covered) else 0.0))
        return out

    def search(self, ws: list[str], share: float = SHARE) -> list[tuple[int, float]]:
        """The same of one document."""
        return self.search_all([ws], share)[0]


def window_size(n: int) -> int:
    """The greatest size of a window that is no more than ``n`` words."""
    return max(1, math.floor(GRID ** math.floor(math.log(max(1, n)) / math.log(GRID) + 1e-9)))


def covered_words(weights: list[np.ndarray], sames: list[np.ndarray]) -> list[np.ndarray]:
    """Which words of each item lie in stretches that a text repeats in order; ``sames``: equal words, item x text.

    Local alignments from both sides, their scores bounded by the least score of a stretch: a word repeated earns its
    weight, one changed or dropped costs MISSED of it, one put in between EXTRA of a mean word. A word is
    covered if the best alignment through it reaches the least score. All pairs are aligned at once, padded to one size.
    """
    m, n = max(len(w) for w in weights), max(x.shape[1] for x in sames)
    weight, same = np.zeros((len(weights), m)), np.zeros((len(weights), m, n), bool)
    for k, (w, x) in enumerate(zip(weights, sames, strict=True)):
        weight[k, : len(w)], same[k, : len(w), : x.shape[1]] = w, x
    least = np.array([min(STRETCH, STRETCH_SHARE * len(w)) for w in weights])[:, None]
    both, gain = np.stack([same, same[:, ::-1, ::-1]]), np.stack([weight, weight[:, ::-1]])
    put = np.arange(n) * EXTRA
    best, before = np.empty((2, len(weights), m, n)), np.zeros((2, len(weights), n))
    for i in range(m):
        diagonal, earned = np.zeros_like(before), gain[:, :, i, None]
        diagonal[..., 1:] = before[..., :-1]
        step = np.where(both[:, :, i], diagonal + earned, np.maximum(diagonal, before) - MISSED * earned)
        step = np.maximum(np.maximum(step, before - MISSED * earned), 0)
        before = best[:, :, i] = np.minimum(np.maximum.accumulate(step + put, axis=-1) - put, least)
    through = same & (best[0] + best[1][:, ::-1, ::-1] - weight[:, :, None] >= least[:, :, None] - 1e-9)
    return [x[: len(w)].any(axis=1) for w, x in zip(weights, through, strict=True)]


#: The index of the last block of items used in this process, so that tasks that follow in it need not build it again.
_last: tuple[str, ItemIndex] | None = None


def _index(key: str, parts: tuple) -> ItemIndex:
    global _last
    if _last is None or _last[0] != key:
        _last = (key, ItemIndex(*parts))
    return _last[1]


def leaks(documents: DataFrame, items: DataFrame, *, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share) of documents whose text holds at least ``share`` of an item's words.

    ``documents``: doc_id, text; ``items``: item_id, text. Case, accents, punctuation, spacing, markup and
    line breaks do not count; single words may be changed, dropped or put in between. Null and empty texts,
    documents without words and null ids give no rows; repeated rows give a pair once. Texts of any length are searched whole.
    """
    spark = documents.sparkSession
    wanted = items.select("item_id", "text").filter("item_id is not null and text is not null").dropDuplicates(["item_id"])
    rows = sorted((int(r["item_id"]), words(r["text"])) for r in wanted.toLocalIterator())
    rows = [(i, ws) for i, ws in rows if ws]
    counts = Counter(w for _, ws in rows for w in set(ws))
    own = details(rows)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null and doc_id is not null")

    def run(at: int) -> DataFrame:
        block = rows[at : at + ITEM_BLOCK]
        sent = spark.sparkContext.broadcast((block, Counter({w: counts[w] for _, ws in block for w in ws}), len(rows), own[at : at + ITEM_BLOCK]))

        key = f"{spark.sparkContext.applicationId} {uuid.uuid4()}"

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                index = _index(key, sent.value)
                found = index.search_all([words(text) for text in pdf["text"]], share)
                out = [(d, i, s) for d, pairs in zip(pdf["doc_id"], found, strict=True) for i, s in pairs if s >= share]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

        return docs.mapInPandas(find, "doc_id bigint, item_id bigint, share double")

    if not rows:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("share")).limit(0)
    parts = [run(at) for at in range(0, len(rows), ITEM_BLOCK)]
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
