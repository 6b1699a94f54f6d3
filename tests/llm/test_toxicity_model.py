"""The noisy-or against its definition, its gradient against differences, and the sample."""

import math
import random

import numpy as np

from notegrain.llm import toxicity

WEIGHTS = {"vile": 9.0, "bad": 4.0, "vilen*": 3.0, "kind": -2.0}


def brute(text, bias, weights, window=toxicity.WINDOW):
    """Sentences cut by hand; odds above the base rate, summed in every run of sentences."""
    sentences, now = [], ""
    for a, b in zip(text, [*text[1:], ""], strict=True):
        now += a
        if a in ".!?\n" and b not in ".!?\n" or not b:
            sentences.append(now)
            now = ""
    base = math.log1p(math.exp(bias))
    odds, spots, at = [], [], 0
    for s in sentences:
        words = set("".join(c if c.isalpha() else " " for c in s.lower()).split())
        words |= {w[:k] + "*" for w in words for k in (5, 7) if len(w) > k}
        z = bias + sum(weights.get(w, 0) for w in words)
        odds.append(max(0.0, math.log1p(math.exp(z)) - base) if words & weights.keys() else 0.0)
        if words & weights.keys() and odds[-1] > 0 and 1 / (1 + math.exp(-z)) >= toxicity.SENTENCE_THRESHOLD:
            spots.append((at, at + len(s)))
        at += len(s)
    best = max((sum(odds[k : k + window]) for k in range(len(odds))), default=0.0)
    return 1 - math.exp(-best), spots


def test_scores_are_the_noisy_or():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(("vile ", "bad ", "kind ", "vileness ", "x ", ". ", "! ", "?\n", "Vile, ")) for _ in range(rnd.randrange(1, 160)))
        value, found = toxicity.sentence_scores(text, -7.0, WEIGHTS)
        wanted, spots = brute(text, -7.0, WEIGHTS)
        assert abs(value - wanted) < 1e-9 and [(a, b) for a, b, _ in found] == spots


def loss(bias, weight, labels, bags):
    total = 0.0
    for label, bag in zip(labels, bags, strict=True):
        nothing = math.prod(1 - 1 / (1 + math.exp(-(bias + sum(weight[w] for w in s)))) for s in bag)
        total -= math.log(1 - nothing if label else nothing)
    return total / len(labels)


def test_gradient_by_differences():
    rnd = random.Random(5)
    bags = [[[w for w in range(6) if rnd.random() < 0.4] for _ in range(rnd.randrange(1, 5))] for _ in range(12)]
    labels = [k % 2 for k in range(12)]
    weight, bias = np.array([rnd.uniform(-1, 1) for _ in range(6)]), -1.3
    sentences = [(b, s) for b, bag in enumerate(bags) for s in bag]
    row = np.array([k for k, (_, s) in enumerate(sentences) for _ in s])
    word = np.array([w for _, s in sentences for w in s])
    found = toxicity.noisy_or_gradient(bias, weight, np.array(labels), np.array([b for b, _ in sentences]), row, word)
    for k in range(7):
        step = np.zeros(6)
        if k < 6:
            step[k] = 1e-6
        up, down = loss(bias + 1e-6 * (k == 6), weight + step, labels, bags), loss(bias - 1e-6 * (k == 6), weight - step, labels, bags)
        assert abs(found[k] - (up - down) / 2e-6) < 1e-6


def test_the_sample_is_determined_and_bounded(spark, monkeypatch):
    rnd = random.Random(8)
    clean = [f"w{k:x}q" for k in range(400)]
    rows = [(k, " ".join(rnd.choice(clean) for _ in range(30)) + (". rarest vile." if k % 4 == 0 else ".")) for k in range(400)]
    rows += [(k, f"another text of {k}. vile.") for k in range(0, 400, 7)]  # repeated ids
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    docs = lambda seed: spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").repartition(seed)
    first, second = toxicity.fit(docs(2), labels), toxicity.fit(docs(5), labels)
    assert first == second and first[1]["vile"] > 3
    # every word may get a weight, also one of a few documents
    few = [(k, "plain words here. " + ("zyxwv" if k % 4 == 0 and k < 60 else "")) for k in range(400)]
    bias, weights = toxicity.fit(spark.createDataFrame(few, "doc_id long, text string"), labels.where("toxic = 0 or doc_id < 60"))
    assert weights["zyxwv"] > 0
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    sample = toxicity._sampled(docs(2), labels, "toxic").collect()
    for label in (0, 1):
        sizes = [len(r.text) for r in sample if r.label == label]
        assert sizes and sum(sizes) <= 4000
    long = spark.createDataFrame([(k, "x. " * 5000) for k in range(50)], "doc_id long, text string")
    assert toxicity.fit(long, labels) == (-math.inf, {})  # nothing fits the bytes
