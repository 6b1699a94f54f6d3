"""Large groups of near copies: their links grow in proportion, and none is lost between chunks."""

import random

import numpy as np
import pytest
from notegrain.llm import simhash


def connected(pairs, nodes):
    forest = simhash._Forest()
    for a, b in pairs:
        forest.join(a, b)
    return {n: forest.find(n) for n in nodes}


def test_links_of_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    rnd, real, edges = random.Random(4), simhash.components, []
    monkeypatch.setattr(simhash, "components", lambda e: edges.append(e.count()) or real(e))
    found = []
    for n in (75, 300):
        nodes = []
        for k in range(n):
            print_ = np.zeros((simhash.PRINT_BITS + simhash.SEARCH_BITS) // 8, np.uint8)
            print_[-rnd.randrange(1, 30)] = 1 << rnd.randrange(8)
            nodes.append((k, bytearray(print_.tobytes())))
        links = [tuple(r) for r in simhash.copy_candidates(spark.createDataFrame(nodes, "node long, print binary"), n, 8).collect()]
        assert set(connected(links, range(n)).values()) == {0}
        found.append(len(links))
    assert found[1] < 4 * 1.5 * found[0] and found[1] < 2 * 300
    crowd, found = [f"c{k}" for k in range(300)], []
    edges.clear()
    for n in (75, 300):
        docs = spark.createDataFrame([(k, " ".join([*crowd[:k], "other", *crowd[k + 1 :]])) for k in range(n)], "doc_id long, text string")
        assert len({r.component for r in simhash.copies(docs, shard_rows=8).collect()}) == 1
        found.append(edges[-1])  # the verified links
    assert found[1] < 4 * 1.5 * found[0] and found[1] < 2 * 300


@pytest.mark.parametrize("shard_rows", [3, 10, 1000])
def test_no_link_is_lost_between_chunks(spark, shard_rows):
    rnd = random.Random(6)
    sets, node = {}, 0
    for n, step in ((40, 3), (25, 0), (12, 5), (1, 0), (1, 0)):  # chains (neighbours alike, others not), a crowd, strays
        base = [rnd.getrandbits(63) for _ in range(30 + n * 5)]
        for k in range(n):
            sets[node] = set(base[k * step : k * step + 30]) | ({rnd.getrandbits(63)} if not step else set())
            node += 1
    order = list(sets)
    rnd.shuffle(order)
    rows = [(j % 2 if shard_rows == 10 else 0, j, bytearray(np.array(sorted(sets[i]), np.uint64).tobytes())) for j, i in enumerate(order)]
    members = spark.createDataFrame(rows, "place long, node long, item binary").repartition(3)
    large = members.groupBy("place").count().withColumnRenamed("count", "size").where(f"size > {shard_rows}")
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    wanted = connected([(j, k) for p, j, _ in rows for q, k, _ in rows if p == q and alike(sets[order[j]], sets[order[k]])], range(len(rows)))
    links = simhash.links_by_place(members, large, simhash.copy_links, shard_rows, shard_rows, turns=1 + shard_rows % 2).collect()
    assert all(r.u < r.v for r in links) and connected(links, range(len(rows))) == wanted


def test_indexed_comparison_against_brute_force(monkeypatch):
    rnd = random.Random(8)
    for block in (1, 60, 1 << 20):
        monkeypatch.setattr(simhash, "BLOCK", block)
        sets = []
        for k in range(60):
            base = set(range(rnd.choice([0, 5, 9, 10, 20])))
            for _ in range(rnd.randrange(3) * bool(base)):
                base = (base - {rnd.choice(sorted(base))}) | {rnd.randrange(1000)}
            sets.append((k, base))
        held = [(k, np.array(sorted(s), np.uint64).tobytes()) for k, s in sets]
        for a, b in ((60, 0), (25, 25)):
            pairs = [(i, j) for i, s in sets[:a] for j, t in sets[b:] if len(s & t) >= 0.8 * len(s | t)]
            assert connected(simhash.copy_links(held[:a], held[b:] if b else None), range(60)) == connected(pairs, range(60))
