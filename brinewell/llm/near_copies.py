"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

Two such sets share l shingles among the least fifth and l of each, in any order that is the same for all sets (prefix
filtering); shingles common in a sample come last, and l is a twentieth of a set and one, so that a passage in common makes
no candidates of long texts. Texts that share so many are compared by parity sketches: a bit is the parity of the shingles
that hash to it, so the bits in which two differ are no more than the shingles in which the sets do, and nothing similar is
lost. Narrow sketches travel with every shared shingle, wide ones (four bits or more for each shingle) with the pairs that
the narrow ones leave; the last are verified on the sets. First each text is compared with a pivot that it shares most shingles with and with the nearest one of those it shares a
shingle with, which joins the large groups; then every pair that is not yet in one component is judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, without, written
from .graph import connected_components
from .simhash import components, fingerprint_documents, fingerprint_links, shingle_hashes

#: Buckets of shingles that are counted, those that are told apart as common, one of how many texts is counted. Only the
#: order of shingles depends on them, never a result.
BUCKETS, COMMON, SAMPLE = 1 << 20, 1 << 16, 8
#: Least bits of a narrow sketch, words compared at a time, and most bits of a wide one (more only means longer verification).
NARROW, BLOCK, WIDEST = 1024, 1 << 18, 1 << 20
#: Similarity is 4 / 5: sets of s and t shingles that differ in d have it just if 9 d <= s + t.
PARTS, DIFFER = 5, 9
#: A set of s shingles has s / SHARE + 1 in common, among those looked at, with any that is similar and no smaller.
SHARE = 20


def shingle_set(text: bytes, n: int) -> np.ndarray:
    return np.unique(np.array([h for some in shingle_hashes(text, n) for h in some], np.uint64))


def sketch(hashes: np.ndarray, width: int) -> np.ndarray:
    """width bits (a power of two) as words: of each place whether an odd number of hashes is there."""
    places = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % width, minlength=width)
    return np.packbits((places & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def narrow_sketch(hashes: np.ndarray) -> np.ndarray:
    """At least half a bit for each shingle: enough that texts with little in common differ in more bits than similar ones may."""
    return sketch(hashes, max(NARROW, 1 << (len(hashes) * 3 // 5).bit_length()))


def wide_sketch(hashes: np.ndarray) -> bytes:
    """Four to eight bits for each shingle, so that few of them fall together."""
    return sketch(hashes, max(NARROW, min(WIDEST, 4 << (len(hashes) + 1).bit_length()))).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (the last axis) as ones of fewer words: places modulo both widths agree, as both are powers of two."""
    return np.bitwise_xor.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def shared_least(size):
    return size // SHARE + 1


def common_shingles(rows: DataFrame, n: int) -> np.ndarray:
    """How often a bucket's shingles occur in the sample, 0 for all but the most common ones."""

    def count(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in (some for batch in batches for some in slices(batch)):
            for t in batch.column(1).to_pylist():
                counts[(shingle_set((t or "").encode(), n) % np.uint64(BUCKETS)).astype(np.int64)] += 1
        some = np.flatnonzero(counts > 1)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    counted = rows.filter(F.pmod("raw", F.lit(SAMPLE)) == 0).mapInArrow(count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bucket").limit(COMMON).collect():
        out[r["bucket"]] = r["n"]
    return out


def prefixes(rows: DataFrame, n: int) -> DataFrame:
    """raw, keys (the shingles that must be looked at), size, bits and wide of the set, for every text with words."""
    common = common_shingles(rows, n)

    def run(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            out: tuple[list, ...] = ([], [], [], [], [])
            for raw, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_set((t or "").encode(), n)
                if len(hashes):
                    order = np.argsort(common[(hashes % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")
                    keys = hashes[order[: len(hashes) // PARTS + shared_least(len(hashes))]].astype(np.int64)
                    for o, v in zip(out, (raw, keys, len(hashes), narrow_sketch(hashes).view(np.int64), wide_sketch(hashes))):
                        o.append(v)
            kinds = pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["raw", "keys", "size", "bits", "wide"])

    return rows.mapInArrow(run, "raw long, keys array<long>, size int, bits array<long>, wide binary")


def _groups(batches):
    """Column arrays that end where a group of the first column does."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (open_ and open_[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*open_, batch.slice(0, cut)]) if cut else pa.Table.from_batches(open_)
            open_ = []
        open_.append(batch.slice(cut))
    if open_:
        yield pa.Table.from_batches(open_)


def _shared(batches):
    """(key, raw) of rows sorted by key, size, raw that share their key with another whose size allows the similarity: of
    all others one next to it in size is nearest to that. Only the last row of a batch is held back."""
    held, kept = None, False

    def rows(key, raw):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(raw)], ["key", "raw"])

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
        if held is not None:
            now = [np.concatenate([h, x]) for h, x in zip(held, now)]
        key, size, raw = now
        if not len(key):
            continue
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (raw[1:] != raw[:-1])])
        key, size, raw = key[new], size[new], raw[new]
        fits = (key[1:] == key[:-1]) & (PARTS * size[:-1] >= (PARTS - 1) * size[1:])
        many = np.concatenate([[kept], fits]) | np.concatenate([fits, [False]])
        if many[:-1].any():
            yield rows(key[:-1][many[:-1]], raw[:-1][many[:-1]])
        held, kept = (key[-1:], size[-1:], raw[-1:]), bool(many[-1])
    if kept:
        yield rows(held[0], held[2])


def hamming(bits: np.ndarray, at: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches i and j (of so many words from a place on) differ, the wider one folded."""
    out = np.zeros(len(i), np.int64)
    both = words[i] << 32 | words[j]
    for key in np.unique(both).tolist():
        a, b = key >> 32, key & (1 << 32) - 1
        least, which = min(a, b), np.flatnonzero(both == key)
        for k in range(0, len(which), max(1, BLOCK // max(a, b))):
            some = which[k : k + max(1, BLOCK // max(a, b))]
            x, y = bits[at[i[some], None] + np.arange(a)], bits[at[j[some], None] + np.arange(b)]
            out[some] = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(axis=1, dtype=np.int64)
    return out


def _pairs(cuts: np.ndarray, label: np.ndarray, size: np.ndarray):
    """(i, j) arrays, a bounded number at a time, of members of one group (between cuts, sorted by size) whose labels differ
    and whose sizes allow the similarity."""
    first = np.repeat(cuts[:-1], np.diff(cuts))
    n = len(size)
    # Of a group's members, those of the size that each one allows begin here: sizes grow within a group, groups follow each other.
    scale = np.int64(size.max()) + 1 if n else 1
    low = np.maximum(first, np.searchsorted(first * scale + size, first * scale + -(-(PARTS - 1) * size // PARTS)))
    count = np.arange(n) - low
    at = 0
    while at < n:
        sums = np.cumsum(count[at : at + BLOCK])
        end = at + max(1, int(np.searchsorted(sums, BLOCK, "right")))
        for i, start in ((at, low[at]),) if end == at + 1 else ():
            for k in range(int(start), i, BLOCK):  # one member with very many partners
                j = np.arange(k, min(i, k + BLOCK))
                j = j[label[j] != label[i]]
                yield np.full(len(j), i), j
        if end > at + 1:
            c = count[at:end]
            i = np.repeat(np.arange(at, end), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:end], c)
            differ = label[i] != label[j]
            yield i[differ], j[differ]
        at = end


def placed(shared: DataFrame, marks: DataFrame) -> DataFrame:
    """shared (key, raw) with marks (raw, fp, label, size, bits), of keys that several components share. Sketches, which
    are wide, come to the rows last, so that they are shuffled by key just once."""
    light = shared.join(marks.select("raw", "label"), "raw").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    several = light.filter("low <> high").select("key")
    return shared.join(several, "key", "left_semi").join(marks, "raw").select("key", "raw", "fp", "label", "size", "bits")


def stars(shared: DataFrame, marks: DataFrame) -> DataFrame:
    """a, b, fa, fb: each text with the pivot that it shares most shingles with, if the sizes allow the similarity.

    A shingle's pivots are the texts with the least and the largest hash that have it. Sums and joins alone: a shingle
    of very many texts is summed before it is shuffled, and its join is one that adaptive execution splits."""
    pivots = shared.groupBy(F.col("key").alias("k")).agg(F.array(F.min("raw"), F.max("raw")).alias("both"))
    met = shared.join(pivots, F.col("key") == F.col("k")).select("raw", F.explode("both").alias("q")).filter("raw <> q")
    best = met.groupBy("raw", "q").agg(F.count("*").alias("n")).groupBy("raw").agg(F.max(F.struct("n", "q")).alias("m"))
    pairs = best.select(F.least("raw", "m.q").alias("a"), F.greatest("raw", "m.q").alias("b")).distinct()
    of = lambda r, f: marks.select(F.col("raw").alias(r), F.col("fp").alias(f), F.col("label").alias(f"label_{r}"), F.col("size").alias(f"size_{r}"))
    both = pairs.join(of("a", "fa"), "a").join(of("b", "fb"), "b")
    fits = PARTS * F.least("size_a", "size_b") >= (PARTS - 1) * F.greatest("size_a", "size_b")
    return both.filter((F.col("label_a") != F.col("label_b")) & fits).select("a", "b", "fa", "fb")


def nearest(shared: DataFrame, marks: DataFrame) -> DataFrame:
    """a, b, fa, fb as of candidates(), of the smaller texts that each text shares a shingle with just the nearest one."""
    return candidates(shared, marks, True)


def candidates(shared: DataFrame, marks: DataFrame, one: bool = False) -> DataFrame:
    """a, b, fa, fb: all pairs of texts of different components that share enough shingles, where the sketches allow the similarity.

    The rows of one shingle meet in one task, as far as it is shared by more than one component."""

    def compare(batches):
        for some in _groups(batches):
            key, raw, fp, label, size = (some.column(i).to_numpy() for i in range(5))
            lists = some.column(5).combine_chunks()
            at = lists.offsets.to_numpy().astype(np.int64)
            words, bits = np.diff(at), lists.values.to_numpy().view(np.uint64)
            size = size.astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            found: list[tuple] = [(np.zeros(0, np.int64),) * 2]
            for i, j in _pairs(cuts, label, size):
                differ = hamming(bits, at, words, i, j)
                near = np.flatnonzero(DIFFER * differ <= size[i] + size[j])
                if one and len(near):
                    near = near[np.lexsort((differ[near], i[near]))]
                    near = near[np.concatenate([[True], i[near][1:] != i[near][:-1]])]
                found.append((i[near], j[near]))
            a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
            a, b = np.where(raw[a] < raw[b], a, b), np.where(raw[a] < raw[b], b, a)
            if len(a):
                _, once, n = np.unique(np.stack([raw[a], raw[b]]), axis=1, return_index=True, return_counts=True)
                a, b = a[once], b[once]
                least = shared_least(np.minimum(size[a], size[b]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (raw[a], raw[b], fp[a], fp[b], least, n)], ["a", "b", "fa", "fb", "least", "n"])

    return placed(shared, marks).repartition("key").sortWithinPartitions("key", "size", "raw").mapInArrow(compare, "a long, b long, fa long, fb long, least long, n long").groupBy("a", "b", "fa", "fb", "least").agg(F.sum("n").alias("n")).filter(F.lit(one) | (F.col("n") >= F.col("least"))).drop("least", "n")


def with_both(pairs: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """pairs with that column of known (by raw) of a and of b, as x and y."""
    x, y = known.select(F.col("raw").alias("a"), F.col(column).alias("x")), known.select(F.col("raw").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def refined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose wide sketches allow the similarity."""

    def compare(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            keep = []
            for x, y, s in zip(batch.column(4), batch.column(5), batch.column(6).to_pylist()):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                least = min(len(x), len(y))
                keep.append(DIFFER * int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(dtype=np.int64)) <= s)
            yield batch.select(["a", "b", "fa", "fb"]).filter(pa.array(keep, pa.bool_()))

    known = sets.select("raw", F.struct("wide", "size").alias("v"))
    both = with_both(pairs, known, "v").select("a", "b", "fa", "fb", F.col("x.wide").alias("x"), F.col("y.wide").alias("y"), (F.col("x.size") + F.col("y.size")).alias("s"))
    return both.mapInArrow(compare, "a long, b long, fa long, fb long")


def verified(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """a, b: fingerprints of those pairs whose sets have the similarity."""

    def sets(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set((t or "").encode(), n).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["raw", "hashes"])

    def compare(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(DIFFER * (len(s) + len(t) - 2 * both) <= len(s) + len(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct())
    # Most texts aren't asked for: a bounded table of buckets spares their shuffle, the join decides.
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS)).cast("int")
    hit = np.zeros(BUCKETS, bool)
    hit[asked.select(bucket("r").alias("k")).distinct().toArrow().column(0).to_numpy()] = True

    def wanted(batches):
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit[raw & (BUCKETS - 1)], pa.bool_()))

    known = written(rows.mapInArrow(wanted, rows.schema).join(asked, F.col("raw") == F.col("r"), "left_semi").dropDuplicates(["raw"]).mapInArrow(sets, "raw long, hashes binary"))
    return with_both(pairs, known, "hashes").select("fa", "fb", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def near_links(docs: DataFrame, prints: DataFrame, links: DataFrame, n: int = 5) -> DataFrame:
    """a, b: links over fingerprints that, with the given ones, connect the texts (prints: fp, raw) that are similar."""
    rows = pick(docs, "text").select(F.xxhash64("text").alias("raw"), "text")
    keyed = written(prefixes(rows, n))
    shared = written(keyed.select(F.explode("keys").alias("key"), "size", "raw").repartition("key").sortWithinPartitions("key", "size", "raw").mapInArrow(_shared, "key long, raw long"))
    enough = shared.groupBy(F.col("raw").alias("r")).agg(F.count("*").alias("n"))
    sets = keyed.select("raw", "size", "bits", "wide").dropDuplicates(["raw"]).join(enough, F.col("raw") == F.col("r")).filter(F.col("n") > F.floor(F.col("size") / SHARE))
    sets = written(sets.drop("r", "n").join(prints.select("raw", "fp").distinct(), "raw"))
    kept = written(shared.join(sets.select("raw"), "raw", "left_semi"))
    out = links
    for propose in (stars, nearest, candidates):
        roots = connected_components(out)
        marks = written(sets.join(roots, sets["fp"] == roots["node"], "left").select("raw", "fp", F.coalesce("root", "fp").alias("label"), "size", "bits"))
        out = written(out.unionByName(verified(written(refined(written(propose(kept, marks)), sets)), rows, n)))
    return out


def representatives(docs: DataFrame, shingle: int = 3, threshold: int = 2, n: int = 5) -> DataFrame:
    """The documents, with all their columns, whose doc_id names their component over both kinds of links: fingerprints of
    three-word shingles within two bits, and sets of five-word shingles at similarity 0.8. Rows with a null doc_id stay."""
    prints = written(fingerprint_documents(docs, shingle))
    links = written(fingerprint_links(written(prints.select("fp").distinct()), threshold))
    gone = components(prints, threshold, near_links(docs, prints, links, n)).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), "raw")
    return without(docs, gone)
