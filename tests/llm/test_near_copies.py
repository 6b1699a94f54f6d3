"""Near copies of the pipeline's stage: five words, exact Jaccard similarity of 0.8 or more."""

import random

from notegrain.llm import simhash
from test_operators import brute_components, brute_simhash


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_edited_copies_are_one_document(spark):
    rnd = random.Random(17)
    rows, planted = [], 0
    for k in range(40):
        base = [f"w{rnd.randrange(2000)}" for _ in range(rnd.randrange(40, 400))]
        rows.append((10 * k, " ".join(base)))
        for n in (1, 2):
            edited = base[:]
            for _ in range(max(1, len(base) * n // 60)):
                edited[rnd.randrange(len(edited))] = f"x{rnd.randrange(2000)}"
            rows.append((10 * k + n, " ".join(edited)))
    # many copies of one text, so that a cluster is cut into chunks
    crowd = [f"c{k}" for k in range(150)]
    rows += [(1000 + k, " ".join([*crowd[:k], "other", *crowd[k + 1 :]])) for k in range(0, 150, 5)]
    rows += [(2000, None), (2001, ""), (2002, " \n")]
    parent, sets = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                planted += (brute_simhash(a) ^ brute_simhash(b)).bit_count() > 4
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    assert planted > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = sorted({find(i) for i in parent})
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == wanted
    assert wanted != sorted(set(brute_components([(i, brute_simhash(t)) for i, t in rows]).values()))
    groups = simhash.copies(docs, shard_rows=4).collect()
    assert len({r.component for r in groups}) == len(wanted)
