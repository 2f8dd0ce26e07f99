"""Language identification with interpolated Kneser-Ney character models.

One 4-gram model per language, stored as sorted arrays of 64-bit n-gram hashes beside log probabilities and back-off
weights, probed by binary search. A text gets the language with the lowest cross-entropy per character; it is rejected if
even that is further above the language's usual value than any calibration text was, with a margin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, in_groups, pick, slices, written

ORDER, BITS = 4, 6
OTHER, PAD = 62, 63
MASK = (1 << BITS) - 1
#: Labelled rows per language that the models are fitted on: the documented bound of the sample.
ROWS_PER_LANGUAGE = 2000
#: Every so many-th of them calibrates rejection and score and isn't fitted on.
CALIBRATE = 5
#: Rejection begins at so many times the largest deviation among the calibration texts.
MARGIN = 1.5
#: Least variance of long texts' cross-entropy, and least largest deviation: small samples show too little of either.
FLOOR = (0.01, 8.0)
CHUNK = 1 << 20

_letters: list = []


def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case."""
    if not _letters:
        is_letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                is_letter[ord(c)] = True
                lower[ord(c)] = ord(x) if len(x := c.lower()) == 1 else ord(c)
        _letters.append((is_letter, lower))
    return _letters[0]


def alphabet(counts: np.ndarray) -> np.ndarray:
    """Code point -> symbol: the 61 most frequent lower-case letters, one symbol for all other letters, 0 for the rest."""
    is_letter, lower = letters()
    out = np.where(is_letter, OTHER, 0).astype(np.uint8)
    common = np.lexsort((np.arange(len(counts)), -counts))[: OTHER - 1]
    common = common[counts[common] > 0]
    out[common] = np.arange(1, len(common) + 1)
    return np.where(is_letter, out[lower], 0).astype(np.uint8)


def points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all texts, how many each text has, and how many letters. Runs of non-letters are one symbol."""
    pad = ORDER - 1
    lengths = np.array([len(t) for t in texts], np.int64)
    x = symbol[points(["\0" * pad + t for t in texts])]
    starts = np.cumsum(lengths + pad) - lengths - pad
    for k in range(pad):
        x[starts + k] = PAD
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    kept, seen = np.cumsum(keep), np.cumsum((x > 0) & (x < PAD))
    ends = starts + lengths + pad - 1
    first = kept[starts] - 1
    n = kept[ends] - first - pad
    n_letters = seen[ends] - seen[starts]
    x = x[keep].astype(np.uint32)
    g = x.copy()
    for k in range(1, ORDER):
        g[k:] |= x[:-k] << np.uint32(BITS * k)
    return g[x != PAD], n, n_letters


def hashed(code: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of an n-gram and its order (the finaliser of a splittable generator: one to one)."""
    h = code.astype(np.uint64) | np.uint64(order << 32)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(31)


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney over symbol 4-grams: (keys, log probabilities) and (keys, log back-off weights), keys sorted."""

    p_keys: np.ndarray
    p: np.ndarray
    b_keys: np.ndarray
    b: np.ndarray

    @staticmethod
    def fit(code: np.ndarray, count: np.ndarray) -> KneserNey:
        levels = {ORDER: (code.astype(np.int64), count.astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter one
            levels[k] = tuple(np.unique(levels[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True))
        below = np.full(1 << BITS, 1 / (1 << BITS))
        below_codes = np.arange(1 << BITS)
        p_keys, p, b_keys, b = [], [], [], []
        for k in range(1, ORDER + 1):
            gram, n = levels[k]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 else 0.5
            context, at = np.unique(gram >> BITS, return_inverse=True)
            total = np.bincount(at, n)
            weight = discount * np.bincount(at) / total
            if k == 1:
                shorter = below[gram]
            else:
                shorter = below[np.searchsorted(below_codes, gram & ((1 << BITS * (k - 1)) - 1))]
            prob = (n - discount) / total[at] + weight[at] * shorter
            if k == 1:  # every symbol has a unigram
                full = weight[0] * below
                full[gram] = prob
                gram, prob = np.arange(1 << BITS), full
            else:
                b_keys.append(hashed(context, k))
                b.append(np.log2(weight))
            p_keys.append(hashed(gram, k))
            p.append(np.log2(prob))
            below_codes, below = gram, prob
        p_keys, p, b_keys, b = (np.concatenate(x) for x in (p_keys, p, b_keys, b))
        i, j = np.argsort(p_keys), np.argsort(b_keys)
        return KneserNey(p_keys[i], p[i].astype(np.float32), b_keys[j], b[j].astype(np.float32))

    def log2(self, code: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each 4-gram after the others."""
        out, weight, open_ = np.zeros(len(code)), np.zeros(len(code)), np.arange(len(code))
        for k in range(ORDER, 0, -1):
            c = code[open_].astype(np.int64) & ((1 << BITS * k) - 1)
            at, found = _probe(self.p_keys, hashed(c, k))
            hit = open_[found]
            out[hit] = weight[hit] + self.p[at[found]]
            open_, c = open_[~found], c[~found]
            if k > 1 and len(open_):
                at, found = _probe(self.b_keys, hashed(c >> BITS, k))
                weight[open_[found]] += self.b[at[found]]
        return out


def _probe(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    symbol: np.ndarray
    languages: list[str]
    models: list[KneserNey]
    sharpness: float = 8.0
    #: By language: usual cross-entropy, its variance among long texts, variance times length among short ones, most z.
    usual: list[tuple[float, float, float, float]] = field(default_factory=list)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, number of symbols, number of letters."""
        code, n, n_letters = grams(texts, self.symbol)
        out = np.zeros((len(texts), len(self.models)))
        if len(code):
            seen, row = _scratch()
            seen[code] = True
            some = np.flatnonzero(seen)
            seen[some] = False
            row[some] = np.arange(len(some), dtype=np.int32)
            rows = row[code]
            has = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[has]
            for k, model in enumerate(self.models):
                out[has, k] = -np.add.reduceat(model.log2(some)[rows], starts) / n[has]
        return out, n, n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether it is rejected, cross-entropy."""
        if not self.models:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
        h, n, n_letters = self.entropies(texts)
        best = h.argmin(axis=1)
        lowest = h[np.arange(len(texts)), best]
        score = 1 / np.exp2(-self.sharpness * (h - lowest[:, None])).sum(axis=1)
        mean, wide, short, most = np.array(self.usual)[best].T
        z = (lowest - mean) / np.sqrt(wide + short / np.maximum(n, 1))
        none = n_letters == 0
        languages = ["und" if x else self.languages[b] for x, b in zip(none, best)]
        return languages, np.where(none, 0.0, score), none | (z > MARGIN * most), np.where(none, 0.0, lowest)


_arrays: list = []


def _scratch() -> tuple[np.ndarray, np.ndarray]:
    if not _arrays:
        _arrays.append((np.zeros(1 << BITS * ORDER, bool), np.zeros(1 << BITS * ORDER, np.int32)))
    return _arrays[0]


def labelled_sample(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, text, lang, part (0: calibration) of about rows_per_language rows of each label, chosen by a hash of doc_id.

    Only rows whose crc32(doc_id) mod 4 is not 2 and whose text and lang are not null. Languages are a small closed set.
    """
    rows = pick(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null").filter(~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0)
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, math.ceil(min(1, rows_per_language / n) * (1 << 30))).otherwise(limit)
    key = F.xxhash64(F.col("doc_id").cast("string"))
    return rows.filter(F.pmod(key, F.lit(1 << 30)) < limit).withColumn("part", F.pmod(F.shiftright(key, 30), F.lit(CALIBRATE)).cast("int"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Models of all labels of docs. Counting is distributed; what reaches the driver is bounded by the sample and the alphabet."""
    sample = written(labelled_sample(docs, rows_per_language))

    def letter_counts(batches):
        is_letter, lower = letters()
        for batch in batches:
            for group in in_groups(batch.column(1).to_pylist(), CHUNK):
                c = points(group)
                letter, n = np.unique(lower[c[is_letter[c]]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(letter.astype(np.int32)), pa.array(n.astype(np.int64))], ["letter", "n"])

    counts = np.zeros(0x110000, np.int64)
    for r in sample.mapInArrow(letter_counts, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(OTHER - 1).collect():
        counts[r["letter"]] = r["n"]
    symbol = alphabet(counts)

    def gram_counts(batches):
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lang in sorted(set(langs)):
                for group in in_groups([t for t, x in zip(texts, langs) if x == lang], CHUNK):
                    g, n = np.unique(grams(group, symbol)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    fitted = sample.filter("part > 0").mapInArrow(gram_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    model = Model(symbol, [], [])
    for lang, part in fitted.groupby("lang", sort=True):
        part = part.sort_values("gram")
        model.languages.append(lang)
        model.models.append(KneserNey.fit(part["gram"].to_numpy(), part["n"].to_numpy()))
    if model.models:
        _calibrate(model, sample.filter("part = 0"), sample.sparkSession)
    return model


def _calibrate(model: Model, sample: DataFrame, spark) -> None:
    """Usual cross-entropy by language and the score's sharpness, from texts that the models weren't fitted on."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for texts, langs in zip(*(list(x) for x in _grouped(batch.column(1).to_pylist(), batch.column(2).to_pylist()))):
                h, n, _ = shared.value.entropies(texts)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(n), pa.array(h.tolist(), pa.list_(pa.float64()))], ["lang", "n", "h"])

    rows = sample.mapInArrow(score, "lang string, n long, h array<double>").filter("n > 0").toPandas()
    place = {lang: k for k, lang in enumerate(model.languages)}
    rows = rows[rows["lang"].isin(model.languages)].sort_values(["lang", "n"])
    h = np.array(rows["h"].tolist()).reshape(-1, len(model.models))
    own, n = np.array([place[x] for x in rows["lang"]], np.int64), rows["n"].to_numpy(np.float64)
    right = h.argmin(axis=1) == own if len(h) else np.zeros(0, bool)
    for k in range(len(model.models)):
        x, size = h[right & (own == k), k], n[right & (own == k)]
        if len(x) < 8:
            model.usual.append((float(x.mean()) if len(x) else 2.5, 0.05, 50.0, FLOOR[1]))
            continue
        mean = float(np.median(x))
        wide = max(FLOOR[0], float(np.median((x[size >= np.median(size)] - mean) ** 2)) * 2.2)
        short = max(1.0, float(np.mean(np.maximum(0, (x - mean) ** 2 - wide) * size)))
        model.usual.append((mean, wide, short, max(FLOOR[1], float(((x - mean) / np.sqrt(wide + short / size)).max()))))
    if len(h):
        model.sharpness = max((8.0 * 2**k for k in range(8)), key=lambda s: -np.log2(np.exp2(-s * (h - h[np.arange(len(h)), own][:, None])).sum(axis=1)).sum())


def _grouped(texts: list[str], others: list) -> tuple:
    """in_groups of texts, with what belongs to each."""
    groups = list(in_groups(texts, CHUNK))
    ends = np.cumsum([len(g) for g in groups]).tolist()
    return groups, [others[e - len(g) : e] for g, e in zip(groups, ends)]


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy: a row for every input row.

    Null texts and texts without a letter are 'und' with score 0 and rejected; without labelled rows everything is. Equal
    cross-entropies go to the label that sorts first. lang, source and doc_id are no input of a prediction; whole texts are
    scored. Repeated rows come out repeated. A null doc_id isn't held out.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in (some for batch in batches for some in slices(batch)):
            made = [shared.value.predict(g) for g in in_groups([t or "" for t in batch.column(2).to_pylist()], CHUNK)]
            lang = [x for m in made for x in m[0]]
            score, rejected, h = (np.concatenate([m[k] for m in made]) if made else np.zeros(0) for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected.astype(bool)), pa.array(h, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"])

    rows = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, with all their columns, that aren't rejected: those without a letter go, and those unlike any language."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return filtered(docs, lambda texts: [not r for g in in_groups(texts, CHUNK) for r in shared.value.predict(g)[2].tolist()])
