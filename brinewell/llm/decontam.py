"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of an item with at most e edits shares with it all but e*q of any set of its q-grams, and the diagonals of the
shared ones lie within e of each other. So hits are counted in diagonal bands of width 2(e+1) that overlap by half, bands
with enough distinct item places are kept, and a banded alignment verifies them. q is 8, and less for items so short that
8-grams would leave the lemma without a bound, so that each item has its whole edit budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import filtered, in_groups, pick, slices, written

#: Lengths of grams, the longest that leaves an item a bound first; items shorter than the first one occur as whole words.
QS = 8, 4, 2, 1
#: Edits allowed per byte of a normalised item.
RATE = 0.1
#: Bytes of benchmark text that are broadcast at a time: a larger benchmark is taken in blocks.
BLOCK = 8 << 20
CHUNK = 1 << 21
NONE = 255


def normalised(text: str) -> bytes:
    """Lower case, runs of white space as one space, UTF-8."""
    return " ".join(text.lower().split()).encode()


def packed(a: np.ndarray, q: int = QS[0]) -> np.ndarray:
    """The q-gram (q: 1, 2, 4 or 8) from each place on as one integer."""
    out, n = a.astype(np.uint64), 1
    while n < q:
        out, n = out[:-n] | out[n:] << np.uint64(8 * n), 2 * n
    return out


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Least edits of item against text within diagonals low to high (text place minus item place), and that match's start and end."""
    width = high - low + 1
    padded = np.full(max(0, high + len(item)) + max(0, -low) + 1, NONE, np.uint8)
    shift = max(0, -low)
    part = text[: len(padded) - shift]
    padded[shift : shift + len(part)] = part
    slots = np.arange(width)
    cost, start = np.zeros(width, np.int64), low + slots
    for j, c in enumerate(item.tolist()):
        at = shift + low + j
        step = cost + (padded[at : at + width] != c)
        gap = np.append(cost[1:], len(item) + 1) + 1
        new = np.where(gap < step, gap, step)
        from_ = np.where(gap < step, np.append(start[1:], 0), start)
        best = np.minimum.accumulate(((new - slots) << 32) + slots)
        cost = (best >> 32) + slots
        start = from_[best & 0xFFFFFFFF]
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), low + k + len(item)


class Grams:
    """The q-grams of some items (index, normalised text as bytes, edits), and the search for them."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], q: int):
        self.q, self.index = q, [i for i, _, _ in items]
        self.items, self.edits = [a for _, a, _ in items], [e for _, _, e in items]
        grams = [packed(a, q) for a in self.items]
        self.need = [len(g) - e * q for g, e in zip(grams, self.edits)]
        who, at = np.concatenate([np.full(len(g), k) for k, g in enumerate(grams)]), np.concatenate([np.arange(len(g)) for g in grams])
        gram = np.concatenate(grams)
        # The lemma holds for any part of an item's q-grams, so the most frequent ones can go while two thirds of the bound stay.
        _, inverse, n = np.unique(gram, return_inverse=True, return_counts=True)
        keep, common = np.ones(len(gram), bool), n[inverse]
        ends = np.cumsum([len(g) for g in grams])
        for k, need in enumerate(self.need):
            first = int(ends[k]) - len(grams[k])
            drop = first + np.argsort(-common[first : ends[k]], kind="stable")[: max(0, need - 2) * 2 // 3]
            keep[drop] = False
            self.need[k] = max(1, need - len(drop))
        order = np.flatnonzero(keep)[np.argsort(gram[keep], kind="stable")]
        self.keys, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.who, self.at = who[order], at[order]
        self.table = np.zeros(1 << 20, bool)
        self.table[self._slot(self.keys)] = True
        self.need_of, self.edits_of = np.array(self.need, np.int64), np.array(self.edits, np.int64)
        self.longest = max(map(len, self.items))

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)

    def find(self, a: np.ndarray, texts: list[bytes], ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the best occurrence of each item in each of the joined texts that has one."""
        gram = packed(a, self.q)
        place = np.flatnonzero(self.table[self._slot(gram)])
        g = gram[place]
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        hit = self.keys[at] == g
        place, at = place[hit], at[hit]
        n = self.count[at]
        if not len(n):
            return
        entry = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, j = self.who[entry], self.at[entry]
        diagonal = np.repeat(place, n) - j
        band = (diagonal + self.longest) // (self.edits_of[item] + 1) + 1  # of band and band - 1, which overlap
        size = len(a) + self.longest + 3
        key = item * size + band
        # A cheap count first: enough hits in the band or in its neighbour.
        slot, below, above = ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64) for x in (key, key - 1, key + 1))
        tally = np.bincount(slot, minlength=1 << 22)
        some = np.flatnonzero(tally[slot] + np.maximum(tally[below], tally[above]) >= self.need_of[item])
        keys, which = np.unique(np.concatenate([key[some], key[some] - 1]), return_inverse=True)
        pair = np.unique(which * self.longest + np.tile(j[some], 2))
        which, n = np.unique(pair // self.longest, return_counts=True)
        good = keys[which[n >= self.need_of[keys[which] // size]]] if len(which) else keys
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in good.tolist():
            item, band = divmod(k, size)
            w, pattern = self.edits[item] + 1, self.items[item]
            low, high = (band - 1) * w - self.longest, (band + 1) * w - 1 - self.longest
            middle = min(max((low + high) // 2 + len(pattern) // 2, 0), len(a) - 1)
            t = min(int(np.searchsorted(ends, middle)), len(texts) - 1)
            for text in {max(t - 1, 0), t, min(t + 1, len(texts) - 1)}:
                offset = int(ends[text]) - len(texts[text])
                own = a[offset : ends[text]]
                if high - offset < -len(pattern) or low - offset > len(own):
                    continue
                exact = own[max(0, low - offset) : max(0, high - offset + len(pattern) + 1)].tobytes().find(pattern.tobytes())
                if exact >= 0:
                    start = max(0, low - offset) + exact
                    found = (0, start, start + len(pattern))
                else:
                    found = aligned(pattern, own, low - offset - w, high - offset + w)
                    found = (found[0], max(0, found[1]), min(len(own), found[2]))
                if found[0] <= self.edits[item]:
                    best[text, item] = min(found, best.get((text, item), found))
        for (text, item), (edits, start, end) in best.items():
            yield text, self.index[item], start, end, edits


class Finder:
    """Items of a benchmark block: (item_id, normalised text). Empty ones match nothing."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.ids = [i for i, t in items if t]
        self.items = [np.frombuffer(t, np.uint8) for _, t in items if t]
        self.short = {k: a.tobytes() for k, a in enumerate(self.items) if len(a) < QS[0]}
        by_q: dict[int, list] = {}
        for k, a in enumerate(self.items):
            if k not in self.short:
                e = int(rate * len(a))
                by_q.setdefault(next(q for q in QS if q == 1 or len(a) - q + 1 - e * q > 0), []).append((k, a, e))
        self.grams = [Grams(some, q) for q, some in by_q.items()]

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the best occurrence of each item in each text that has one."""
        for k, word in self.short.items():
            for t, text in enumerate(texts):
                if b" " + word + b" " in b" " + text + b" ":
                    start = (b" " + text + b" ").index(b" " + word + b" ")
                    yield t, k, start, start + len(word), 0
        if self.grams and texts:
            a = np.frombuffer(b"\n".join(texts) + b"\n" * QS[0], np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1
            for grams in self.grams:
                yield from grams.find(a, texts, ends)


def blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[list[tuple]]:
    """(item_id, normalised text) lists of at most `most` bytes of text (or one item)."""
    held, size = [], 0
    for row in pick(benchmark, "item_id", "text").filter("text is not null").toLocalIterator():
        item = (row["item_id"], normalised(row["text"]))
        if held and size + len(item[1]) > most:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    yield held


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits, similarity: a row for each document and item that occurs in it.

    start and end are byte places in the normalised document, edits the least edit distance in bytes (at most rate times the
    item's length, rounded down). Null and empty texts match nothing; an item of under eight bytes has to occur as whole
    words. Repeated documents or items give repeated rows. The benchmark is broadcast in blocks of bounded size; of several
    the results are written one by one, so that one block is held at a time. Empty tables: no rows.
    """
    out, held = None, None
    docs = pick(docs, "doc_id", "text")
    for block in blocks(benchmark):
        if held is not None:
            out = written(out)
            held.destroy()
        found, held = _search(docs, block, rate, benchmark.schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, block: list[tuple], rate: float, schema) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(Finder(block, rate))
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = next((f.dataType.simpleString() for f in schema if f.name.lower() == "item_id"), "string")

    def run(batches):
        finder = shared.value
        for batch in (some for batch in batches for some in slices(batch)):
            ids, rows, before = batch.column(0).to_pylist(), [], 0
            for group in in_groups([normalised(t or "") for t in batch.column(1).to_pylist()], CHUNK):
                rows += [(ids[before + t], finder.ids[k], start, end, edits, 1 - edits / len(finder.items[k])) for t, k, start, end, edits in finder.find(group)]
                before += len(group)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([batch.schema.field(0).with_name("doc_id"), ("item_id", item_type), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())]))

    names = ["doc_id", "item_id", "start", "end", "edits", "similarity"]
    item_type = pa.string() if item_kind == "string" else pa.int32() if item_kind == "int" else pa.int64()
    return docs.mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, start long, end long, edits long, similarity double"), shared


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, with all their columns, in which no item occurs; null and empty texts stay."""
    held = None
    for block in blocks(benchmark):
        if held is not None:
            docs = written(docs)
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(Finder(block, rate))

        def keep(texts: list[str], shared=held) -> list[bool]:
            bad, before = set(), 0
            for group in in_groups([normalised(t) for t in texts], CHUNK):
                bad |= {before + found[0] for found in shared.value.find(group)}
                before += len(group)
            return [i not in bad for i in range(len(texts))]

        docs = filtered(docs, keep)
    return docs
