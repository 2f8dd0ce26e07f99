"""Removal of byte strings of a given length that occur anywhere else, verified on suffix arrays.

Every window of `length` bytes belongs to its minimiser, the q-gram in it with the least hash; equal windows have equal
minimisers at equal offsets. Consecutive windows of one minimiser form a run. Runs whose minimiser occurs once can't repeat
and stay out. Equal runs (by a 128-bit BLAKE2b digest) are one kind with a count; a kind that occurs again repeats as a
whole. The kinds meet by minimiser, one run of each; what of them has a chance to repeat is suffix-sorted by grouping
(suffix_sort), and neighbours in the suffix array that agree over `length` bytes are the repeats.

The kinds of a minimiser that has very many are split before they are sorted: windows at offsets of one half of the range
share not just the minimiser but a longer string around it, which is the key of the half. Halves are treated as runs were,
and split again while there are too many kinds of one; a single window's key is the window itself. So no key's runs
are too many for one task, and every way ends at a suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_groups, pick, slices, written
from .suffix_sort import suffix_array

LENGTH, Q = 200, 32
#: Bytes, and windows of a long text, handled at a time.
CHUNK = 1 << 20
#: Bytes that are suffix-sorted together (a minimiser's runs are never parted).
SORT = 1 << 16
#: Kinds of one key above which they are split by longer keys. Bounds what a task sorts; no result depends on it.
MANY = 4096
#: Minimisers that occur more often are dealt out to SALTS tasks where all their runs are looked at; they are known by
#: their bucket, so that what is broadcast is bounded.
COMMON, SALTS, BUCKETS = 10_000, 32, 1 << 20
MULTIPLIERS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


@lru_cache
def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    r = MULTIPLIERS[which]
    out = []
    for base in (r, pow(r, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


class Hashes:
    """64-bit hashes of all substrings of some bytes, from prefix sums."""

    def __init__(self, a: np.ndarray, which: int = 0):
        n = 1 << max(20, int(len(a) + 1).bit_length())
        power, self.inverse = powers(which, n)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    m, span = v, 1
    while span * 2 <= width:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    return m if span == width else np.minimum(m[: len(v) - width + 1], m[width - span :])


def digest(data) -> tuple[int, int]:
    two = int.from_bytes(hashlib.blake2b(data, digest_size=16).digest(), "little")
    return (two & (1 << 64) - 1) - (1 << 63), (two >> 64) - (1 << 63)


def runs(texts: list[bytes], length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimiser's offset in the first window, its hash) of all texts' runs; none shorter than length has any."""
    sizes = np.array([len(t) for t in texts], np.int64)
    a = np.frombuffer(b"".join(texts), np.uint8)
    if not (sizes >= length).any():
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    offsets = np.cumsum(sizes) - sizes
    h = Hashes(a)
    at = np.arange(len(a) - q + 1)
    gram = h.of(at, at + q)
    chosen = least(gram >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64), length - q + 1)
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets, windows)
    place = (chosen[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    s, place = start[first], place[first]
    return text[first], s - offsets[text[first]], n, place - s, gram[place]


def pieces(text: bytes, length: int = LENGTH, most: int = CHUNK):
    """(offset, bytes) parts of a text that hold each of its windows once."""
    for at in range(0, max(1, len(text) - length + 1), most):
        yield at, text[at : at + most + length - 1]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h, text. Rows with equal doc_id and h are repeated rows, and share their outcome."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def parted(texts: list[str], length: int) -> tuple[list[bytes], list[int], list[int]]:
    """Parts of texts, whose they are, and where they begin."""
    parts, owner, offset = [], [], []
    for k, text in enumerate(texts):
        for at, part in pieces(text.encode(), length):
            parts.append(part)
            owner.append(k)
            offset.append(at)
    return parts, owner, offset


def minimisers(rows: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """gram, c: how many runs have a minimiser, summed up by batch."""

    def run(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            parts, _, _ = parted(batch.column(2).to_pylist(), length)
            for group in in_groups(parts, CHUNK):
                gram, c = np.unique(runs(group, length, q)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(c)], ["gram", "c"])

    return rows.mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def salted(shared: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """shared (gram, c) once for each salt that its runs can have, and the buckets whose runs have one other than 0."""
    bucket = F.pmod("gram", F.lit(BUCKETS)).cast("int").alias("b")
    common = np.zeros(BUCKETS, bool)
    common[shared.filter(F.col("c") > COMMON).select(bucket).distinct().toArrow().column(0).to_numpy()] = True

    def run(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy()
            n = np.where(common[gram & BUCKETS - 1], SALTS, 1)
            salt = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gram, n)), pa.array(salt.astype(np.int32))], ["g", "s"])

    return shared.mapInArrow(run, "g long, s int"), common


def all_runs(rows: DataFrame, common: np.ndarray, length: int = LENGTH, q: int = Q) -> DataFrame:
    """doc_id, h, start, n, off, gram, salt, w0, w1 (digest of the run's bytes) for every run of every text."""

    def run(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            parts, owner, offset = parted(batch.column(2).to_pylist(), length)
            done = 0
            for group in in_groups(parts, CHUNK):
                which, start, n, off, gram = runs(group, length, q)
                gram = gram.astype(np.int64)
                bounds = zip(which.tolist(), start.tolist(), (start + n - 1 + length).tolist())
                w = np.array([digest(group[k][s:e]) for k, s, e in bounds], np.int64).reshape(-1, 2)
                row = np.array(owner[done : done + len(group)], np.int64)[which]
                start = start + np.array(offset[done : done + len(group)], np.int64)[which]
                done += len(group)
                salt = np.where(common[gram & BUCKETS - 1], (w[:, 0] ^ start) % SALTS, 0)
                cols = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (start, n, off)), pa.array(gram), pa.array(salt.astype(np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "start", "n", "off", "gram", "salt", "w0", "w1"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h long, start int, n int, off int, gram long, salt int, w0 long, w1 long")


def repeated_windows(texts: list[bytes], group: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text which of its windows equals another window of a text of the same group, or of its own."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    offsets, ends = np.cumsum(sizes) - sizes, np.cumsum(windows)
    a = np.frombuffer(b"".join(texts), np.uint8)
    start = np.arange(windows.sum()) - np.repeat(ends - windows, windows) + np.repeat(offsets, windows)
    h = Hashes(a, 1).of(start, start + length) if len(start) else np.zeros(0, np.uint64)
    # Windows whose hash is alone have no equal; the others, in maximal runs, are sorted, one of each distinct string.
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    alive = n[inverse] > 1 if len(h) else np.zeros(0, bool)
    text = np.repeat(np.arange(len(texts)), windows)
    cut = np.ones(len(alive), bool)
    cut[1:] = (alive[1:] != alive[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(alive))
    raw = a.tobytes()
    strings: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(alive[first]).tolist():
        s = int(start[first[k]])
        strings.setdefault(raw[s : s + int(last[k] - first[k]) - 1 + length], []).append(k)
    joined, held, size = [], [], 0
    repeats = np.zeros(len(alive), bool)

    def settle():
        flags = sorted_repeats(joined, length)
        for string, ks in zip(held, flags, strict=True):
            for k in string:
                repeats[first[k] : last[k]] = True if len(string) > 1 else ks
        joined.clear()
        held.clear()

    for string, ks in sorted(strings.items(), key=lambda x: group[text[first[x[1][0]]]]):
        if size >= SORT and group[text[first[ks[0]]]] != group[text[first[held[-1][0]]]]:
            settle()
            size = 0
        joined.append(string)
        held.append(ks)
        size += len(string)
    if joined:
        settle()
    return np.split(repeats, ends[:-1]) if len(texts) else []


def sorted_repeats(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct strings which of its windows occurs again in one of them: equal neighbours among the suffixes."""
    text = b"".join(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    windows = sizes - length + 1
    valid = np.zeros(len(text), bool)
    for o, w in zip((np.cumsum(sizes) - sizes).tolist(), windows.tolist()):
        valid[o : o + w] = True
    order = np.array(suffix_array(text), np.int64)
    order = order[valid[order]]
    again = np.zeros(len(text), bool)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
    for i in range(0, len(order) - 1, 4096):
        x, y = order[i : i + 4096], order[i + 1 : i + 4097]
        x = x[: len(y)]
        same = (view[x] == view[y]).all(axis=1)
        again[x[same]] = True
        again[y[same]] = True
    return [again[o : o + w] for o, w in zip((np.cumsum(sizes) - sizes).tolist(), windows.tolist())]


def spans(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the flagged windows of a run that begins at start."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(start + int(i), start + int(j) - 1 + length) for i, j in zip(edge[::2], edge[1::2])]


def compared(kinds: DataFrame, length: int, kind: str) -> DataFrame:
    """kinds (gram, doc_id, h, start, part) -> doc_id, h, start, end: repeated bytes, found within each key's runs."""

    def run(batches):
        def done():
            texts = [r[4] for r in held]
            found = [(r[1], r[2], s, e) for r, flags in zip(held, repeated_windows(texts, [r[0] for r in held], length)) for s, e in spans(flags, r[3], length)]
            held.clear()
            for i in range(0, len(found), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + 8192]), (types[0], pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "h", "start", "end"])

        types: list = []
        held: list[tuple] = []
        size = 0
        for batch in batches:
            types[:] = [batch.schema.field(1).type]
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= CHUNK and r[0] != held[-1][0]:
                    yield from done()
                    size = 0
                held.append(r)
                size += len(r[4])
        if held:
            yield from done()

    return kinds.select("gram", "doc_id", "h", "start", "part").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, f"doc_id {kind}, h long, start int, end int")


def halves(start: int, n: int, off: int, part: bytes, gram: int, level: int, length: int, q: int) -> Iterator[tuple]:
    """(start, n, off, part, key) of the parts of a run whose windows have the minimiser at offsets of one interval.

    Intervals of a level are twice as many as of the one before. The key is a hash of what all windows of an interval
    contain, whether or not this run has them all."""
    width = max(1, 1 << (length - q).bit_length() >> level)
    at = 0
    while at < n:
        low = (off - at) // width * width
        last = min(n - 1, off - low)
        high = min(low + width - 1, length - q)
        core = part[off - low : off - high + length]
        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=f"{level}:{low}".encode()).digest(), "little", signed=True)
        yield start + at, last - at + 1, off - at, part[at : last + length], key
        at = last + 1


def split(kinds: DataFrame, level: int, length: int, q: int, kind: str) -> DataFrame:
    """Runs (with their bytes as part) of too many kinds a key as runs of longer keys."""

    def run(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            out: list[list] = [[] for _ in range(8)]
            row = []
            for k, r in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)))):
                for start, n, off, part, key in halves(*r[1:], r[0], level, length, q):
                    row.append(k)
                    for o, v in zip(out, (key, start, n, off, part, *digest(part))):
                        o.append(v)
            at = pa.array(row, pa.int64())
            kinds_ = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), batch.column(1).take(at), batch.column(2).take(at), *(pa.array(o, t) for o, t in zip(out[1:7], kinds_))], ["gram", "doc_id", "h", "start", "n", "off", "part", "w0", "w1"])

    return kinds.select("gram", "doc_id", "h", "start", "n", "off", "part").mapInArrow(run, f"gram long, doc_id {kind}, h long, start int, n int, off int, part binary, w0 long, w1 long")


def by_kind(met: DataFrame, length: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """Spans of the runs whose kind (gram, w0, w1) occurs again, and one run of each kind of keys that have several (how many)."""
    one = F.min(F.struct("doc_id", "h", "start", "n", "off", *more)).alias("one")
    kinds = written(met.groupBy("gram", "w0", "w1").agg(F.count("*").alias("c"), one))
    again = kinds.filter("c > 1").select(F.col("gram").alias("g"), F.col("w0").alias("x"), F.col("w1").alias("y"))
    whole = met.join(again, (F.col("gram") == F.col("g")) & (F.col("w0") == F.col("x")) & (F.col("w1") == F.col("y")))
    whole = whole.select("doc_id", "h", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))
    several = kinds.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("kinds")).filter("kinds > 1")
    return whole, kinds.join(several, F.col("gram") == F.col("g")).select("gram", "kinds", "one.*")


def repeated_spans(rows: DataFrame, length: int = LENGTH, q: int = Q, many: int | None = None) -> DataFrame:
    """doc_id, h, start, end: byte spans of keyed documents that strings occurring elsewhere cover."""
    kind, many = rows.schema["doc_id"].dataType.simpleString(), MANY if many is None else many
    shared, common = salted(written(minimisers(rows, length, q).filter("c > 1")))
    met = written(all_runs(rows, common, length, q).join(shared, (F.col("gram") == F.col("g")) & (F.col("salt") == F.col("s"))).drop("g", "s", "salt"))
    out, kinds = by_kind(met, length)
    wanted = kinds.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_list(F.struct("start", "n", "off", "gram", "kinds")).alias("wanted"))
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")))
    found = found.select("doc_id", "h", F.encode("text", "utf-8").alias("raw"), F.explode("wanted").alias("x"))
    found = written(found.select("doc_id", "h", "x.*", F.substring("raw", F.col("x.start") + 1, F.col("x.n") - 1 + length).alias("part")))
    for level in range(1, (length - q).bit_length() + 1):
        out = out.unionByName(compared(found.filter(F.col("kinds") <= many), length, kind))
        large = found.filter(F.col("kinds") > many)
        if large.isEmpty():
            return out
        parts = written(split(large, level, length, q, kind))
        shared = parts.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("c")).filter("c > 1")
        whole, found = by_kind(parts.join(shared, F.col("gram") == F.col("g"), "left_semi"), length, "part")
        found = written(found)
        out = out.unionByName(whole)
    return out.unionByName(compared(found, length, kind))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: and kept, binary): a row for every input row.

    Bytes of the UTF-8 text covered by a string of `length` bytes that also starts elsewhere, in the same document or in
    another, are removed; strings are judged on the input, and matches never cross documents. Null text counts as empty.
    Repeated rows are copies of each other like any two rows. Empty tables give no rows.
    """
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    cover = repeated_spans(rows, length).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cover"))
    joined = rows.join(cover, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left").select("doc_id", "text", "cover.start", "cover.end")

    def run(batches):
        for batch in batches:
            out = []
            for text, starts, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw, kept, at, n, cut = text.encode(), [], 0, 0, -1
                for s, e in zip(starts or [], ends or []):
                    if s > cut:
                        n += 1
                        kept.append(raw[at:s])
                    cut = at = max(cut, e)
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
            cols = [batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 4 + with_text]))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
