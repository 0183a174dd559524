"""Near copies inside larger groups of texts that share buckets without being linked."""

import random

import brute
import numpy as np

from barloom.llm import minhash_dedup


def test_difference_counts_take_all_bits():
    """a signed word counted as its magnitude, so that every second pair of round B was rejected unseen."""
    rng = np.random.default_rng(8)
    a = rng.integers(-(2**63), 2**63, (50, 8), np.int64)
    want = [sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(r, a[0], strict=True)) for r in a]
    assert minhash_dedup.flips_of(a, a[0]).tolist() == want


def test_pairs_within_a_crowd(spark):
    """512 pairs of texts out of the same two times fourteen passages. Two texts of a pair differ in one passage, all others
    in two or more, so that no bucket is a pair's own and most pairs never hold their bucket's leader."""
    r, kinds = random.Random(4), []
    for x in range(1 << 14):
        if len(kinds) < 512 and all((x ^ y).bit_count() >= 4 for y in kinds):
            kinds.append(x)
    passage = [[" ".join(f"{r.randrange(10**9)}" for _ in range(20)) for _ in range(2)] for _ in range(14)]
    text = lambda x: " ".join(passage[k][x >> k & 1] for k in range(14))
    rows = [row for i, x in enumerate(kinds) for row in ((2 * i, text(x)), (2 * i + 1, text(x ^ 1 << i % 14)))]
    got = {x[0]: tuple(x)[1:] for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=64).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    want = brute.near_duplicates(rows)
    assert sum(v[2] for v in want.values()) == len(kinds) == 512
    assert got == want
