"""Byte-level BPE with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so it is a certain cut. A text is cut before
each space that follows something else (no token has a byte other than white space before a space), which is where nearly
all fragments end; each distinct fragment is encoded once on its own, new ones many at a time with a byte between them that
no token has inside, long ones cut further at the rare pairs within words; then the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import in_groups, pick, slices

#: Fixed value: the split pattern of byte-level pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each worker's two caches before they start anew; results don't depend on it.
CACHE = 300_000
#: Characters of texts handled at a time.
CHUNK = 1 << 20
#: Fixed value: what the pattern's \s matches.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBpe:
    """Encodes as the tokenizer file's own library does with add_special_tokens=False; decodes all ids."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in model["model"]["vocab"]}
        self.bytes_of = {i: raw[token] for token, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        id_of = {b: model["model"]["vocab"][token] for token, b in raw.items()}
        self.byte_id = [id_of[bytes([b])] for b in range(256)]
        self.merge = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = (raw[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge.setdefault((id_of[a], id_of[b]), (rank, id_of[a + b]))
        inside = {p for b in raw.values() for p in zip(b, b[1:])}
        self.inside = inside
        # Merging by the ids of the merged tokens is the same as merging by rank when the ids follow the ranks.
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=id_of, special_tokens={})._core_bpe if all(i == 256 + rank for rank, i in self.merge.values()) else None
        self.find = regex.compile(PATTERN).findall
        self.space_cuts = not any(a not in SPACE.encode() and b == 32 for a, b in inside)
        self.between = self.byte_id[0] if not any(0 in pair for pair in inside) else None
        n = 1 + max(self.bytes_of)
        self.length = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)
        self.known: dict[str, bytes] = {}

    def cut(self, piece: bytes) -> list[bytes]:
        """piece at its forced boundaries."""
        if self.inside.issuperset(zip(piece, piece[1:])):
            return [piece]
        at = [0, *(i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in self.inside), len(piece)]
        return [piece[i:j] for i, j in zip(at, at[1:])]

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens, pre-token by pre-token."""
        return b"".join(self.encode_fragment(f) for piece in self.find(text) for f in self.cut(piece.encode()))

    def encode_fragment(self, fragment: bytes) -> bytes:
        if self.core and len(fragment) < 256:
            ids = self.core.encode_single_piece(fragment)
        else:
            ids = self.merged_by_heap([self.byte_id[b] for b in fragment])
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        """The lowest-ranked pair, leftmost first, until none is left: a heap of pairs over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (m := self.merge.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return [x for x in ids if x >= 0]

    def learn(self, fragments: set[str]) -> None:
        """Encodes fragments, each as it stands after a space."""
        many = []
        for f in fragments:
            if self.core and self.between is not None and f and len(f) < 64 and "\0" not in f and not f[-1].isspace():
                many.append(f)
            else:
                self.known[f] = self.plain(f" {f}")
        if many:
            ids = np.array(self.core.encode_ordinary("\0".join([f" {f}" for f in many])), "<u4")
            ends = np.append(np.flatnonzero(ids == self.between), len(ids)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(many, [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)], strict=False))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.split_special.split(t) if self.special and any(s in t for s in self.special) else [t] for t in texts]
        parts = [[None if p in self.special else self.fragments(p) for p in ps] for ps in split]
        new = set().union(*(f[1:] for ps in parts for f in ps if f)).difference(self.known)
        self.learn(new)
        get = self.known.__getitem__
        one = lambda p, f: struct.pack("<I", self.special[p]) if p in self.special else self.plain(p) if f is None else b"".join([self.plain(f[0]), *map(get, f[1:])])
        return [b"".join([one(p, f) for p, f in zip(ps, fs)]) for ps, fs in zip(split, parts)]

    def fragments(self, text: str) -> list[str] | None:
        """text cut at its spaces, which the fragments but for the first have lost; None if spaces stand in runs of white space."""
        if not self.space_cuts or any(c in text and c + " " in text for c in SPACE):
            return None
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        coded = self.encode_many(texts)
        ids = np.frombuffer(b"".join(coded), "<u4")
        length = self.length[ids]
        ends = np.cumsum(length)
        raw = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + length, length)].tobytes()
        out, at, byte = [], 0, 0
        for c in coded:
            at += len(c) // 4
            end = int(ends[at - 1]) if at else 0
            decoded = raw[byte:end].decode("utf-8", "replace").encode()
            out.append((len(c) // 4, hashlib.sha256(c).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            byte = end
        return out


_made: dict[int, ForcedBoundaryBpe] = {}


def tokenizer(spec: str) -> ForcedBoundaryBpe:
    """One for each vocabulary and Python worker."""
    key = hash(spec)
    if key not in _made:
        _made[key] = ForcedBoundaryBpe(spec)
    return _made[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (with_ids: and ids), a row for every input row.

    Null text counts as empty: no tokens, digests of nothing. The vocabulary file is read by the driver and broadcast; its
    size is that of the file, whatever the input. Special tokens in a text are found as the library finds them.
    """
    spark = docs.sparkSession
    with open(path or default_path()) as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = tokenizer(spec.value)
        for batch in (some for batch in batches for some in slices(batch)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = [m for group in in_groups(texts, CHUNK) for m in bpe.digests(group)]
            cols = [batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())]
            if with_ids:
                cols.append(pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    picked = pick(docs, "doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)
