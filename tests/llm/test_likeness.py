"""Fingerprints and likenesses against plain versions; rows of one id, and repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np

from notegrain.llm import prefix_hash as ph
from test_operators import signed_hash


def plain_fingerprint(text):
    """Sums term by term."""
    sums = [[0], [0]]
    for j, c in enumerate(text):
        for k, (p, b) in enumerate(zip(ph.PRIMES, ph.BASES, strict=True)):
            sums[k].append((sums[k][-1] + (ord(c) + 1) * pow(b, j, p)) % p)
    ladder, step = [], 1
    while step <= len(text):
        ladder.append(f"{sums[0][step] & 0xFFFF:04x}")
        step = max(step + 1, step * 5 // 4)
    slots = [None] * ph.SLOTS
    for i in range(len(text) - ph.SPAN + 1):
        h = sum((ord(c) + 1) * pow(ph.BASES[0], t, ph.PRIMES[0]) for t, c in enumerate(text[i : i + ph.SPAN])) % ph.PRIMES[0]
        value = (h * 0x9E3779B97F4A7C15) % 2**64 >> 32
        slot = value * ph.SLOTS >> 32
        slots[slot] = value if slots[slot] is None else min(slots[slot], value)
    return ".".join((f"{len(text):08x}", f"{sums[0][-1]:08x}{sums[1][-1]:08x}", "".join(ladder), "".join("----" if s is None else f"{s & 0xFFFF:04x}" for s in slots)))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (n, _, x, s), (m, _, y, t) = a.split("."), b.split(".")
    step, agreed = 1, 0
    for k in range(0, min(len(x), len(y)), 4):
        if x[k : k + 4] != y[k : k + 4]:
            break
        agreed, step = step, max(step + 1, step * 5 // 4)
    pairs = [(s[k : k + 4], t[k : k + 4]) for k in range(0, len(s), 4)]
    filled = [p for p in pairs if p != ("----", "----")]
    return max(agreed / max(int(n, 16), int(m, 16)), sum(p == q for p, q in filled) / len(filled) if filled else 0.0)


def texts():
    rnd = random.Random(3)
    out = ["", "a", "😀é" * 40, "word " * 200]
    for _ in range(25):
        base = "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(0, 400)))
        out += [base, base[: len(base) // 2] + "x" + base[len(base) // 2 :]]
    return out


def test_fingerprints_and_likeness_are_the_plain_ones(monkeypatch):
    found = [ph.fingerprint(ph.PrefixHashes(t)) for t in texts()]
    assert found == [plain_fingerprint(t) for t in texts()]
    for a, b in zip(found, found[1:], strict=False):
        assert ph.likeness(a, b) == plain_likeness(a, b) == ph.likeness(b, a)
    near = [ph.likeness(a, b) for a, b, t in zip(found[4::2], found[5::2], texts()[4::2], strict=True) if len(t) > 100]
    assert min(near) >= 0.4  # half of each is a common beginning
    monkeypatch.setattr(ph, "_STEP", 7)  # pieces don't show
    assert [ph.fingerprint(ph.PrefixHashes(t)) for t in texts()] == found


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1]), r[1]))
    out = Counter()
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 4
        changed = text[: len(text) - k] + following[:k]
        a, b, c = plain_fingerprint(text), plain_fingerprint(changed), plain_fingerprint(following)
        common = next((i for i in range(min(len(text), len(changed))) if text[i] != changed[i]), min(len(text), len(changed)))
        out[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c), common] += 1
    return out


def test_rows_of_one_id_and_repeated_rows(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    rows = [(7, word(60)) for _ in range(60)] + [(9, "same text of many rows, again and again")] * 50 + [(k, word(50)) for k in range(30)] + [(None, word(20))] * 8 + [(3, None), (3, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, area int").repartition(5)
    wanted = brute(rows)
    for least in (1000, 3):
        monkeypatch.setattr(ph, "HOT_ROWS", least)
        out = ph.fingerprint_edits(docs, range_bytes=300)
        assert Counter(tuple(r) for r in out.collect()) == wanted
    areas = Counter(r.area for r in ph._neighbours(docs, 300).where("doc_id = 7 and not lead").collect())
    assert len(areas) > 3 and max(areas.values()) < 40  # one id is dealt to several ranges


def test_areas():
    edges, first, times = ph._areas([5.0, 5.0, 9.0, 5.0])
    assert edges.tolist() == [5.0, 9.0] and first.tolist() == [1, 4] and times.tolist() == [3, 1]
    assert ph._areas([2.0**60, 2.0**60])[2].tolist() == [1] and ph._areas([])[0].tolist() == []
    assert np.array_equal(ph._areas([1.0])[1], [1])
