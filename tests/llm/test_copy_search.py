"""The pipeline's near copies are found by SimHash: wide fingerprints, shards of their bits, BK-trees."""

import random

import numpy as np
import pytest
from notegrain.llm import simhash

M = (1 << 64) - 1


def brute_print(shingles):
    words = (simhash.PRINT_BITS + simhash.SEARCH_BITS) // 64
    seeds = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, (2, words), np.int64).tolist()
    counts = [[0] * 64 for _ in range(words)]
    for h in shingles:
        for w in range(words):
            z = (h * (seeds[0][w] << 1 | 1) + seeds[1][w]) & M
            z = ((z ^ z >> 32) * 0x9E3779B97F4A7C15) & M
            z ^= z >> 29
            for k in range(64):
                counts[w][k] += z >> k & 1
    # bytes from the lowest, bits of a byte too, as numpy unpacks them: highest first
    return [counts[w][8 * byte + 7 - k] * 2 > len(shingles) for w in range(words) for byte in range(8) for k in range(8)]


def test_wide_print_against_brute_force():
    rnd = random.Random(2)
    for n in (0, 1, 2, 4, 255, 256, 700):
        shingles = sorted({rnd.getrandbits(64) for _ in range(n)})
        assert np.unpackbits(simhash.wide_print(np.array(shingles, np.uint64))).tolist() == brute_print(shingles)


@pytest.mark.parametrize(("count", "shard_rows"), [(900, 1024), (900, 2), (1 << 20, 1024)])
def test_pairs_at_the_threshold_meet_and_others_do_not(spark, count, shard_rows):
    rnd = random.Random(3)
    rows, pairs = [], set()
    for k in range(300):
        n = rnd.randrange(20, 400)
        base = [rnd.getrandbits(64) for _ in range(n)]
        gone = n // 9  # of one size: (n - gone) / (n + gone) is just 0.8 or more
        edited = base[gone:] + [rnd.getrandbits(64) for _ in range(gone)]
        assert n - gone >= 0.8 * (n + gone)
        rows += [(2 * k, base), (2 * k + 1, edited), (1000 + k, [rnd.getrandbits(64) for _ in range(n)])]
        pairs.add((2 * k, 2 * k + 1))
    # a crowd with one print, above a chunk of its shards
    rows += [(2000 + k, [7, 8, 9]) for k in range(9)]
    prints = [(i, bytearray(simhash.wide_print(np.unique(np.array(s, np.uint64))).tobytes())) for i, s in rows]
    nodes = spark.createDataFrame(prints, "node long, print binary")
    found = {(r.u, r.v) for r in simhash.copy_candidates(nodes, count, shard_rows).collect()}
    assert {p for p in found if p[0] < 2000} == pairs
    assert len({r.component for r in simhash.components(spark.createDataFrame([p for p in found if p[0] >= 2000], "u long, v long")).collect()}) == 1


def test_no_shard_is_named_by_bits_of_the_trees():
    for nodes in (0, 1 << 14, 1 << 20, 1 << 24, 1 << 40):
        chosen = simhash.shard_bits(nodes)
        assert chosen.max() < simhash.PRINT_BITS and all(len(set(row)) == len(row) for row in chosen.tolist())
        assert nodes >> chosen.shape[1] <= simhash.CROWD or chosen.shape[1] == 24
