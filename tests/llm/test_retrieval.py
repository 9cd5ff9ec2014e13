"""Fingerprints of repeats, and candidates by cosine alone against all candidates."""

import random

import numpy as np

from tidemark.llm import decontaminate
from tidemark.llm import substring_dedup as sd


def test_runs_that_differ_in_high_bits_are_no_repeat():
    sizes = sd.sizes_of(1 << 20)
    rows = [np.array(c, np.uint64) for c in ([7, 7, 7], [5, 5 | 1 << 41, 5], [1, 2, 3], [0, 0, 0], [0, 0, 0], [3, 3, 3], [0, 0, 0])]
    out = sd.equal_runs(0, [sd.planes(sd.RUN, rows)], sizes)
    gone = [sd.unplaned(sd.SPANS, [spans])[0].tolist() for _, spans, _ in out if spans is not None]
    assert gone == [[3]]  # only the third document has the first one's run


def test_cosine_alone_finds_what_all_candidates_give(spark):
    """On the documents, whose prose has most words of the benchmark, and on paraphrases of it made of their words."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items, texts = bench.collect(), [r.text for r in docs.select("text").limit(200).collect()]
    rng = random.Random(6)
    words = [w for t in texts for w in t.split()]
    rows = []
    for i in range(150):
        edited = [rng.choice(words) if rng.random() < 0.25 else w for w in rng.choice(items).text.split() if rng.random() > 0.1]
        rows.append((10**6 + i, " ".join([*rng.sample(words, 80), *edited, *rng.sample(words, 60)])))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(both, bench).collect()}
    want = {(r.doc_id, r.item_id) for r in decontaminate.hits(both, bench, by_terms=True).collect()}
    planted = {x for x in want if x[0] >= 10**6}
    assert len(want - planted) > 10 and len(planted) > 40
    assert got <= want and want - planted <= got and len(got & planted) >= 0.95 * len(planted)
