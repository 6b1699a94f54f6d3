"""The training-data operators against brute force and exact round trips, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from notegrain.llm import avi_mjpeg, license_scan, piece_bpe, pii, prefix_hash, shard_ring, simhash, source_mix, toxicity, url_filter

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("size", T.IntegerType())])
LICENCE = "Licensed under the Apache License, Version 2.0."


def corpus():
    """Nulls, empty, white space, long and repeated texts, near copies, repeated ids; columns that clash with results."""
    rnd = random.Random(3)
    words = ["the", "heon", "ander", "été", "überall", "niño", "x", "lorem", "token", "日本語", "a.b"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(90)) * (rnd.random() < 0.3) for _ in range(n))
    base = text(400)
    rows = [(1, None, "a", "f", 1), (2, "", "a", "f", 1), (3, " \n\t ", None, None, 0), (4, base, "b", "f", 2), (5, base, "b", "f", 3), (6, base + " tail", "c", "f", 3), (7, text(20000), "b", "f", 1)]
    rows += [(8, "one", "d", "f", 1), (9, "two words", None, "f", 1), (10, text(60) + " " + LICENCE + "\n" + text(60), "a", "f", 1), (11, "a😀é" * 30, "d", "f", 1), (12, text(50), "b", "f", 1)]
    rows += [(12, rows[-1][1], "b", "f", 1), (None, "no id " + text(10), "b", "f", 1), (13, LICENCE.upper(), "", "f", 1)]
    return rows + [(20 + k, text(rnd.randrange(1, 120)), rnd.choice("abc"), "f", 1) for k in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_prefix_hash_spans_and_extensions():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 40))) for _ in range(2))
        x, y = prefix_hash.PrefixHashes(a), prefix_hash.PrefixHashes(b)
        i, j = rnd.randrange(len(a) + 1), rnd.randrange(len(b) + 1)
        n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert prefix_hash.common_extension(x, i, y, j) == n
        length = rnd.randrange(6)
        assert prefix_hash.spans_equal(x, i, y, j, length) == (i + length <= len(a) and j + length <= len(b) and a[i : i + length] == b[j : j + length])


def signed_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def test_prefix_hash_query(docs, empty):
    rows = [r.asDict() for r in prefix_hash.fingerprint_edits(docs, range_bytes=1 << 12).collect()]
    order = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1]), r[1]))
    expected = Counter()
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 4
        expected[doc_id, len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[4] == prints[5] != prints[6] and prints[1] == prints[2]
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] == 7)["near_edited"] > 0.4
    assert prefix_hash.fingerprint_edits(empty).count() == 0


def test_license_scan(docs, empty, spark):
    found = {(r.doc_id, r.license, r.template) for r in license_scan.scan(docs).collect()}
    assert found == {(10, "Apache-2.0", LICENCE), (13, "Apache-2.0", LICENCE)}
    assert license_scan.scan(empty).count() == 0
    worst = 0.8 * 0.25 / (1 + 0.2 * 0.25)
    assert 1 - (1 - worst) ** license_scan.bands_for() >= license_scan.RECALL
    # a long notice is found with up to a fifth of its shingles gone, by brute-force containment
    rnd = random.Random(5)
    notice = license_scan.TEMPLATES[1][1].split()
    rows = []
    for k in range(40):
        words = list(notice)
        if k % 2:
            words[rnd.randrange(len(words))] = "changed"
        rows.append((k, " ".join(["lead"] * rnd.randrange(50) + words + ["tail"] * rnd.randrange(50)), "a", "", 0))
    import re

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    own = shingles(" ".join(notice))
    wanted = {k for k, t, *_ in rows if len(own & shingles(t)) / len(own) >= 0.8}
    assert {r.doc_id for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()} == wanted and len(wanted) > 30


def test_shard_ring(docs, empty, spark):
    rows = shard_ring.shard(docs).collect()
    wanted = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == wanted
    many = spark.createDataFrame([(k, "same" * 50 if k % 3 == 0 else f"text {k} " * (k % 7 + 1), "a", "", 0) for k in range(6000)], SCHEMA)
    placed = shard_ring.shard(many).collect()
    loads, slots = Counter(), defaultdict(list)
    for r in placed:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(loads.values()) / 8
    assert max(loads.values()) <= 1.01 * mean and min(loads.values()) >= 0.98 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.shard, r.slot) for r in placed) == Counter((r.doc_id, r.shard, r.slot) for r in shard_ring.shard(many.repartition(5)).collect())
    assert shard_ring.shard(empty).count() == 0
    units = [(k * 13 % shard_ring.CELLS, 10) for k in range(4000)]
    eight, nine = (shard_ring.place(units, n, capacity=1.25) for n in (8, 9))
    moved = sum(a != b for a, b in zip(eight, nine, strict=True))
    assert moved < 0.35 * len(units)  # most stay where they are


def test_url_filter_against_brute_force(spark):
    rnd = random.Random(2)
    hosts = ["com", "a.com", "acom", "example.com", "x.example.com", "badexample.com", "example.net", "b.net", "org", "q.org:80", "EXAMPLE.com"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/7', '/en/71?x', '/de/8', '/de/9#t', '/es/', '/En/', '/x.com/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "a://b://c.com/en/", "https://u.com?/en/", "http://" + "s." * 3000 + "com/en/" + "p" * 5000]
    schema = "page_id long, url string, rule string"
    rows = url_filter.judge(spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], schema)).collect()
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    for r in rows:
        host, path = url_filter.canonical(urls[r.page_id])
        fits = [(v, n) for v, n in rules for d, p in [n.split("/", 1)] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        verdict, name = max(fits, key=lambda f: len(f[1]), default=("allow", None))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, verdict)
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0
    # many globs over several words of bits
    globs = [url_filter.Rule("block", g, g) for g in ["**/ads/**", "*.bad?.org/**", ".host/a*b", "**.exe"] + [f"*.site{k}.net/**" for k in range(20)]]
    automaton = url_filter.Automaton(globs)
    assert automaton.words > 4
    texts = [".x.org/ads/1", ".q.bad1.org/", ".q.bad.org/", ".host/axxb", ".host/a/b", ".h/f.exe", ".w.site7.net/", ".site7.net/", ""]
    plain = [[_glob(g.glob, t) for g in globs] for t in texts]
    assert automaton.run([t.encode() for t in texts]).tolist() == plain


def _glob(glob, text):
    import re

    body = re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.fullmatch(body, text, re.S) is not None


def test_toxicity_held_out(spark, docs, empty):
    rnd = random.Random(4)
    clean, foul = [f"word{k}" for k in range(200)], ["vilest", "vilify"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        sentences = [" ".join(rnd.choice(clean) for _ in range(8)) + "." for _ in range(rnd.randrange(1, 12))]
        if toxic:
            sentences[rnd.randrange(len(sentences))] = f"you {rnd.choice(foul)} {rnd.choice(clean)}."
        rows.append((k, " ".join(sentences), "a", "", 0))
        labels.append((k, int(toxic), 1))
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, known)
    out = toxicity.score(df, model).collect()
    held = [r for r in out if r.held_out]
    assert 250 < len(held) < 350 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) > 0.97 * len(held)
    hit = next(r for r in held if r.predicted)
    spot = rows[hit.doc_id][1][hit.offending[0].start : hit.offending[0].end]
    assert any(f in spot for f in foul)
    assert toxicity.drop_toxic(df, model).where("doc_id % 3 = 0").count() < 15
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(corpus()) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(empty, model).count() == 0
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, known.where("toxic = 1"))).collect())


def test_source_mix_against_iteration(docs, empty):
    rows = source_mix.mix(docs).collect()
    import re

    sizes = Counter()
    for r in corpus():
        sizes[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # clamp, reshare, again
        level = (total - sum(2 * sizes[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    target = {s: level * weight[s] if s in open_ else 2 * sizes[s] for s in order}
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    largest = {s: max(r["size"] for r in rows if r.source == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix(docs.repartition(4)).collect()))
    assert source_mix.mix(empty).count() == 0 and source_mix.repeat_rows(empty).count() == 0
    repeated = source_mix.repeat_rows(docs)
    assert repeated.columns == docs.columns
    again = Counter(r.doc_id for r in repeated.collect() if len((r.text or "").split()))
    assert again == Counter({k: n for k, n in Counter({i: sum(r.taken // r["size"] for r in rows if r.doc_id == i and r["size"]) for i in {r.doc_id for r in rows}}).items() if n})


def test_pii_rows(docs, empty):
    out = pii.surrogates(docs, pii.TEST_KEY)
    assert out.count() == len(corpus()) and pii.surrogates(empty, pii.TEST_KEY).count() == 0
    assert {r.text for r in out.where("doc_id in (1, 2)").collect()} == {None, ""}
    rows = pii.replace_in_rows(docs, pii.TEST_KEY)
    assert rows.columns == docs.columns and rows.count() == len(corpus()) and pii.replace_in_rows(empty, pii.TEST_KEY).count() == 0


def test_avi_round_trip():
    rnd = random.Random(6)
    for n in (0, 1, 63, 64, 65, 5000):
        data = bytes(rnd.choice((0, 255, 254, 7, 128)) for _ in range(n))
        back, frames, avi = avi_mjpeg.restore(avi_mjpeg.store(data))
        assert back == data and all(np.array_equal(avi_mjpeg.decode_frame(f), x) for f, x in zip(avi.frames, frames, strict=True))
    still = np.full((10, 32, 32), 40, np.uint8)
    still[5:] = 200
    media = avi_mjpeg.write_avi(avi_mjpeg.encode_frames(still), 32, 32)
    assert [(c.first, c.last) for c in avi_mjpeg.find_shots(avi_mjpeg.histograms(avi_mjpeg.decode_frames(avi_mjpeg.read_avi(media))), 40_000)] == [(0, 4), (5, 9)]
    no_index = media[: media.rindex(b"idx1")]
    assert len(avi_mjpeg.read_avi(no_index).frames) == 10


def test_avi_query(docs, empty, spark):
    rows = avi_mjpeg.media_columns(docs).collect()
    texts = Counter()
    for r in rows:
        texts[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32] += 1
    wanted = Counter()
    for doc_id, text, *_ in corpus():
        data = (text or "").encode()
        full = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        wanted[doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert texts == wanted
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (4, 5)}) == 1
    assert avi_mjpeg.media_columns(empty).count() == 0
    damaged = spark.createDataFrame([(1, None), (2, bytearray(b"RIFFxxxxAVI ")), (3, bytearray(avi_mjpeg.store(b"abc" * 3000)))], "id long, media binary")
    clips = avi_mjpeg.clips(damaged).collect()
    assert {c.id for c in clips} == {3} and clips[0].start_s == 0


@pytest.fixture(scope="module")
def vocabulary():
    return piece_bpe.MergeVocabulary(piece_bpe.model_bytes())


def test_pieces_equal_the_library(vocabulary):
    rnd = random.Random(1)
    symbols = "ab \n\t▁é梦😀\x00ﬁ　thinger.,!#   "
    texts = ["".join(rnd.choice(symbols) for _ in range(rnd.randrange(0, 90))) for _ in range(1500)] + ["", " ", "▁", " a" * 50, "the" * 200, "x" * 500, " " * 300]
    for text in texts:
        theirs = vocabulary.library.encode(text)
        assert vocabulary.encode(text) == theirs
        assert [x for s in vocabulary.segments(text) for x in vocabulary.agenda_encode(s)] == theirs
        assert vocabulary.decode(theirs) == vocabulary.library.decode(theirs)


def test_piece_query(docs, empty, vocabulary):
    model = piece_bpe.model_bytes()
    rows = Counter(tuple(r) for r in piece_bpe.piece_codec(docs, model).collect())
    wanted = Counter()
    for doc_id, text, *_ in corpus():
        ids = vocabulary.library.encode(text or "")
        wanted[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest()] += 1
    assert rows == wanted and piece_bpe.piece_codec(empty, model).count() == 0
    known = piece_bpe.SegmentTable(vocabulary, most=5)  # a table that starts anew all the time
    assert [a for a, _ in piece_bpe.encode_batch(known, ["one two three four five six", "two"])][1] == ",".join(map(str, vocabulary.library.encode("two")))


def brute_simhash(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(values, radius=4):
    """values: (id, fingerprint); smallest id of each one's component."""
    parent = {i: i for i, _ in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(values):
        for j, b in values[:k]:
            if (a ^ b).bit_count() <= radius:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i in parent}


def test_simhash_query(docs, empty, spark):
    rows = simhash.near_duplicates(docs).collect()
    prints = Counter((i, f"{brute_simhash(t):016x}") for i, t, *_ in corpus())
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == prints
    wanted = brute_components([(i, brute_simhash(t)) for i, t, *_ in corpus() if i is not None])
    assert all(r.component_id == wanted[r.doc_id] for r in rows if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and Counter(i for i in ids if i is not None) == Counter(set(wanted.values()))
    assert ids.count(None) == 1  # its text is like no other


def test_simhash_rows_without_id_and_repeated_ids(spark):
    rnd = random.Random(5)
    base = [rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(400)]
    texts = [" ".join(base)]
    while len(texts) < 3:  # a chain: each text links to the next, the ends don't
        last = brute_simhash(texts[-1])
        tried = " ".join([*texts[-1].split(), rnd.choice("xyz") + str(rnd.randrange(9))])
        far = (brute_simhash(tried) ^ brute_simhash(texts[0])).bit_count()
        if (brute_simhash(tried) ^ last).bit_count() <= 4 and (far > 4 or len(texts) == 1 and far):
            texts.append(tried)
        elif (brute_simhash(tried) ^ last).bit_count() <= 4:
            texts[-1] = tried if len(texts) > 1 else texts[-1]
    other, lonely = " ".join(reversed(base)), "all alone here with nobody like it"
    rows = [(7, texts[0]), (None, texts[1]), (9, texts[2]), (9, other), (9, other), (None, lonely), (None, lonely)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, row string")
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(i, f"{brute_simhash(t):016x}", 7 if t in texts else 9 if t == other else None) for i, t in rows}
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == Counter([(7, texts[0]), (9, other), (None, lonely)])


def test_links_in_chunks_connect_what_brute_force_does(spark):
    rnd = random.Random(7)
    centre = rnd.getrandbits(64)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for _ in range(300):  # one dense group, walked away from its centre
        value = centre
        for _ in range(rnd.randrange(12)):
            value ^= 1 << rnd.randrange(64)
        values.add(value)
    rows = [(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes, shard_rows=16)).collect()}
    wanted = brute_components([(n, f & (1 << 64) - 1) for f, n in rows])
    assert all(found.get(n, n) == wanted[n] for _, n in rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 502), (501, 502)], "u long, v long")
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 201)}, 501: 500, 502: 500}


def test_bk_tree():
    rnd = random.Random(8)
    values = [rnd.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in (rnd.getrandbits(16) for _ in range(50)):
        assert {tree.values[k] for k in tree.within(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}
