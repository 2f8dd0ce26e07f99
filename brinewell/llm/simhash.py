"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code over the whole fingerprint: two blocks of 23 bits are covered by the binary
Golay code (radius 3 each), one of 15 by the Hamming code (radius 1), the last three bits stand for themselves. A
fingerprint's home is its nearest anchor, within the covering radius; it is replicated to every anchor within radius plus
threshold that some fingerprint at most `threshold` bits away has as home. So of two linked fingerprints each is at the
other's home, and comparing homes with visitors per anchor finds every link. There are 2^38 anchors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, without, written
from .graph import connected_components, spanning

#: Comparisons that an anchor makes at a time.
COMPARED = 1 << 22
#: Bytes of a text taken at a time, and hashes gathered before they are summed.
STEP, FLUSH = 1 << 20, 1 << 16
BLANK = regex.compile(rb"[\x20\x09-\x0D]")


def words(text: bytes):
    """Lists of a lower-cased text's words, a bounded part of it at a time. bytes.split() splits at \\x20 and \\x09-\\x0D."""
    at = 0
    while at < len(text):
        end = at + STEP
        if end < len(text):
            end = m.start() if (m := BLANK.search(text, end)) else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, n: int):
    """XXH64 (seed 42) of the shingles of n words, repeats included; the whole sequence if it has fewer, nothing if it is empty."""
    rest, any_ = [], False
    for some in words(text):
        rest += some
        if len(rest) >= n:
            any_ = True
            yield [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*[rest[i:] for i in range(n)])]
            rest = rest[len(rest) - n + 1 :]
    if rest and not any_:
        yield [xxhash.xxh64_intdigest(b" ".join(rest), 42)]


def fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    """A bit is 1 if set in over half of the shingles' hashes; without words, zero."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    ends: list[tuple[int, int]] = []

    def flush():
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = [0, *(e for _, e in ends[:-1])]
            np.add.at(ones, [k for k, _ in ends], np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        hashes.clear()
        ends.clear()

    for k, text in enumerate(texts):
        for some in shingle_hashes(text, n):
            hashes += some
            ends.append((k, len(hashes)))
            total[k] += len(some)
            if len(hashes) >= FLUSH:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprint_documents(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long), raw (a hash of the text) of every row; null and empty texts have fp 0."""

    def run(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(texts, shingle).astype(np.int64)), batch.column(2)], ["doc_id", "fp", "raw"])

    picked = pick(docs, "doc_id", "text").withColumn("raw", F.xxhash64("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long, raw long")


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code: bits of a word and of a message, covering radius, generator polynomial."""

    bits: int
    message: int
    radius: int
    generator: int

    def syndrome(self, w: np.ndarray) -> np.ndarray:
        """Remainder of a word modulo the generator."""
        check, w = self.bits - self.message, w.copy()
        for i in range(self.bits - 1, check - 1, -1):
            w ^= np.where(w >> i & 1, self.generator << (i - check), 0).astype(w.dtype)
        return w

    @lru_cache
    def leaders(self) -> np.ndarray:
        """The one error within the radius for each syndrome."""
        errors = np.concatenate([flips(self.bits, k) for k in range(self.radius + 1)])
        out = np.zeros(1 << self.bits - self.message, np.int64)
        out[self.syndrome(errors)] = errors
        return out

    def reached(self, w: np.ndarray, most: int) -> list[np.ndarray]:
        """For 0 to `most` changed bits, the messages of the codewords first nearest then, -1 where there are fewer."""
        found: list[np.ndarray] = []
        for k in range(most + 1):
            v = w[:, None] ^ flips(self.bits, k)
            code = np.sort((v ^ self.leaders()[self.syndrome(v)]) >> (self.bits - self.message), axis=1)
            code[:, 1:][code[:, 1:] == code[:, :-1]] = -1
            for before in found:
                for j in range(before.shape[1]):
                    code[code == before[:, j : j + 1]] = -1
            code = -np.sort(-code, axis=1)
            found.append(code[:, : max(1, int((code >= 0).sum(axis=1).max(initial=0)))])
        return found


def flips(bits: int, k: int) -> np.ndarray:
    """All words with k bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), k)], np.int64)


#: The generator polynomials x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (Golay) and x^4 + x + 1 (Hamming).
GOLAY, HAMMING = Code(23, 12, 3, 0b110001110101), Code(15, 11, 1, 0b10011)
CODES = GOLAY, GOLAY, HAMMING


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs: where each fingerprint goes. The first len(fps) pairs are the homes.

    A bit of the last three that differs leads to the anchor that differs in it."""
    sides, at = [], 0
    for code in CODES:
        sides.append(code.reached((fps >> np.uint64(at)).astype(np.int64) & (1 << code.bits) - 1, threshold))
        at += code.bits
    rest = (fps >> np.uint64(at)).astype(np.int64)
    sides.append([rest[:, None] ^ flips(64 - at, k) for k in range(threshold + 1)])
    widths = [*(code.message for code in CODES), 64 - at]
    rows, out = [], []
    for ks in sorted(product(range(threshold + 1), repeat=len(sides)), key=sum):
        if sum(ks) > threshold:
            break
        anchor = np.zeros((len(fps), 1), np.int64)
        for side, k, width in zip(sides, ks, widths):
            new = side[k]
            anchor = np.where((anchor[:, :, None] >= 0) & (new[:, None, :] >= 0), anchor[:, :, None] << width | new[:, None, :], -1).reshape(len(fps), -1)
        r, c = np.nonzero(anchor >= 0)
        rows.append(r)
        out.append(anchor[r, c])
    return np.concatenate(rows), np.concatenate(out)


def links(fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what of an anchor's members is within threshold: fewer than members, though pairs may be many."""
    n, own = len(fps), np.flatnonzero(home)
    label = np.arange(n)
    for i in range(0, len(own), max(1, COMPARED // n)):
        some = own[i : i + max(1, COMPARED // n)]
        a, b = np.nonzero(np.bitwise_count(fps[some, None] ^ fps[None, :]) <= threshold)
        new = label[some[a]] != label[b]
        if new.any():
            label = spanning(n, np.concatenate([some[a[new]], np.arange(n)]), np.concatenate([b[new], label]))
    other = np.flatnonzero(label != np.arange(n))
    return fps[other], fps[label[other]]


def fingerprint_links(classes: DataFrame, threshold: int = 2) -> DataFrame:
    """a, b: links over distinct fingerprints (column fp) that connect all those within threshold bits of each other."""

    def replicate(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(every), 1024):
                fps = every[i : i + 1024]
                row, anchor = anchors(fps.astype(np.uint64), threshold)
                home = np.arange(len(row)) < len(fps)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches):
        def done(anchor, fp, home):
            """Links of whole anchors; those with one member, or without a home, have none."""
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            last = np.append(first[1:], len(anchor))
            met = (last - first > 1) & np.logical_or.reduceat(home, first)
            for i, j in zip(first[met].tolist(), last[met].tolist()):
                a, b = links(fp[i:j].astype(np.uint64), home[i:j], threshold)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

        open_: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if open_ and (cut or now[0][0] != open_[-1][0][-1]):
                yield from done(*(np.concatenate(c) for c in zip(*open_, [x[:cut] for x in now])))
                open_ = []
            elif cut:
                yield from done(*(x[:cut] for x in now))
            open_.append([x[cut:] for x in now])
        if open_:
            yield from done(*(np.concatenate(c) for c in zip(*open_)))

    placed = classes.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def components(prints: DataFrame, threshold: int = 2, links: DataFrame | None = None) -> DataFrame:
    """prints (doc_id, fp, raw) -> those and component_id: the smallest doc_id reachable over links, its own included.

    Links (a, b, over fingerprints) are those within the threshold, unless others are given."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(classes, threshold) if links is None else links)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    of = rooted.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(of, F.col("fp") == F.col("f")).select("doc_id", "fp", "raw", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: a row for every input row.

    Null text counts as empty. Texts without words have fingerprint zero and are linked like any others; equal texts
    share a fingerprint, so copies are one class and never pairs. A null doc_id doesn't name a component unless all of
    its doc_ids are null. Repeated rows come out repeated.
    """
    prints = written(fingerprint_documents(docs, shingle))
    out = components(prints, threshold)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """The documents, with all their columns, whose doc_id names their component; rows with a null doc_id always stay."""
    prints = written(fingerprint_documents(docs, shingle))
    gone = components(prints, threshold).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), "raw")
    return without(docs, gone)


def replicas(threshold: int = 2) -> int:
    """Most anchors that a fingerprint can go to: the bound on the growth of the replicated table."""
    bits = [*(code.bits for code in CODES), 64 - sum(code.bits for code in CODES)]
    return sum(int(np.prod([comb(n, k) for n, k in zip(bits, ks)])) for ks in product(range(threshold + 1), repeat=len(bits)) if sum(ks) <= threshold)
