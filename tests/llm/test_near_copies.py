"""Near copies of the pipeline's stage against every pair's Jaccard similarity."""

import random

import corpus_pipeline
from brinewell.llm import near_copies


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_near_copies_equal_every_pairs_similarity(spark):
    rng = random.Random(5)
    line = [f"line{i}" for i in range(20)]
    texts = [""]
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 40, 150, 400]))]
        texts += [" ".join(edited(rng, base, k) + line * (g % 2)) for k in (0, 1, 1, 2, 3, 4, 6, 9)]
    texts += [" ".join(edited(rng, [f"v{i}" for i in range(150)], 3)) for _ in range(40)]
    every = list(dict.fromkeys(texts))
    sets = [shingles(t) for t in every]
    pairs = {(i, j) for i in range(len(every)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(pairs) > 40
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    # Without fingerprint links the components are just those of the similar pairs.
    prints = spark.createDataFrame([(i, i, t) for i, t in enumerate(every)], "doc_id long, fp long, text string").selectExpr("doc_id", "fp", "xxhash64(text) as raw")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "doc_id long, text string")
    links = near_copies.near_links(docs, prints, spark.createDataFrame([], "a long, b long"))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(prints, 2, links).collect()}
    assert got == {i: find(i) for i in range(len(every))}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert not any(i in kept and j in kept for i, j in pairs)
