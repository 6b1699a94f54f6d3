"""Licence values, URL cases, blocks and hubs of near-duplicates, bounded tables, Arrow pieces, checkpoints."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from notegrain.llm import _common, license_scan, piece_bpe, simhash, url_filter
from test_operators import brute_components


def shingle_texts(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]


def test_license_values_of_whole_and_repeated_passages(spark):
    rnd = random.Random(6)
    library = [("L%d" % k, " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(rnd.randrange(6, 40)))) for k in range(130)]  # two blocks
    rows = []
    for k in range(60):
        chosen = rnd.sample(library, 2)
        gap = lambda: " ".join(f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 30)))
        times = rnd.choice((1, 1, 3))
        rows.append((k, " ".join([gap(), *[chosen[0][1] + " " + gap() for _ in range(times)], chosen[1][1].upper(), gap()])))
    rows += [(60, rows[0][1]), (60, rows[0][1]), (61, None), (62, "")]
    found = license_scan.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string"), library)
    wanted = Counter()
    for doc_id, text in rows:
        own = shingle_texts(text or "")
        places = {s: own.index(s) for s in reversed(own)}
        for name, template in library:
            t = set(shingle_texts(template))
            share = len(t & places.keys()) / len(t)
            if share >= license_scan.SIMILARITY:
                wanted[doc_id, name, template, share, min(places[s] for s in t & places.keys())] += 1
    assert Counter((r.doc_id, r.license, r.template, r.containment, r.first_word) for r in found.collect()) == wanted and len(wanted) > 100


def test_url_cases(spark):
    rules = (url_filter.host_rule("block", "a.com/x"), url_filter.host_rule("allow", "a.com/x"), url_filter.host_rule("allow", "b.com/"), url_filter.host_rule("block", "c.com/"))
    rows = [(1, "http://a.com/xy"), (1, "http://a.com/xy"), (None, "http://w.b.com/"), (2, None), (2, "http://c.com"), (3, "http://c.com/")]
    out = url_filter.judge(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string"), rules, "ask")
    wanted = Counter({(1, "a.com", "/xy", "a.com/x", "block"): 2, (None, "w.b.com", "/", "b.com/", "allow"): 1, (2, "", "", None, "ask"): 1, (2, "c.com", "", None, "ask"): 1, (3, "c.com", "/", "c.com/", "block"): 1})
    assert Counter(map(tuple, out.collect())) == wanted  # of equally long rules the first listed


def test_blocks():
    rnd = random.Random(2)
    for blocks in (6, 7, 8, 11):
        masks = [m & (1 << 64) - 1 for m in simhash.block_masks(4, blocks)]
        assert min(m.bit_count() for m in masks) >= 64 // blocks * (blocks - 4)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)
    assert simhash.blocks_for(10) == 6 and simhash.blocks_for(2 * 10**10) == 7 and simhash.blocks_for(10**12) > 7
    assert all(simhash.blocks_for(n) <= simhash.blocks_for(10 * n) for n in (10**k for k in range(1, 15)))


def test_links_by_more_blocks_and_hubs(spark, monkeypatch):
    rnd = random.Random(7)
    centre = rnd.getrandbits(64)
    values = {rnd.getrandbits(64) for _ in range(80)}
    for _ in range(250):  # a crowd near one centre: hubs
        value = centre
        for _ in range(rnd.randrange(5)):
            value ^= 1 << rnd.randrange(64)
        values.add(value)
    rows = [(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    wanted = brute_components([(n, f & (1 << 64) - 1) for f, n in rows])
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    monkeypatch.setattr(simhash, "HOT_PARTS", 20)
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes, shard_rows=32, blocks=8)).collect()}
    assert all(found.get(n, n) == wanted[n] for _, n in rows)
    star = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(k, 1000) for k in range(100, 160)] + [(5, 100)], "u long, v long")
    got = {r.node: r.component for r in simhash.components(star).collect()}
    assert set(got.values()) == {0} and len(got) == 120
    left = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(90)], "key long, value long")
    right = spark.createDataFrame([(7, 45, "hot"), (1, 15, "warm"), (99, 0, "none")], "key long, size long, name string")
    joined = Counter(map(tuple, simhash.join_counted(left, right, "key", 90).collect()))
    assert joined == Counter((k % 3 if k % 2 else 7, k, "hot" if k % 2 == 0 else "warm") for k in range(90) if k % 2 == 0 or k % 3 == 1)


def test_segment_table_is_bounded():
    vocabulary = piece_bpe.MergeVocabulary(piece_bpe.model_bytes())
    known = piece_bpe.SegmentTable(vocabulary, characters=300)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 8))) for _ in range(20)) for _ in range(40)] + ["梦" * 5000, "x" * 3000, None, "", "梦" * 5000]
    for start in range(0, len(texts), 4):
        batch = texts[start : start + 4]
        for text, (ids, back) in zip(batch, piece_bpe.encode_batch(known, batch), strict=True):
            theirs = vocabulary.library.encode(text or "")
            assert ids == ",".join(map(str, theirs)) and back == vocabulary.library.decode(theirs)
        assert known.held <= 300 + sum(len(t or "") for t in batch)
    list(piece_bpe.encode_batch(known, ["a"]))
    assert max(map(len, known.ids)) <= piece_bpe.WIDE
    wrong = piece_bpe.SegmentTable(vocabulary)
    wrong.learn({" the"})
    wrong.ids[" the"] = "5"
    with pytest.raises(AssertionError, match="otherwise"):
        list(piece_bpe.encode_batch(wrong, ["the"]))


def test_pieces_and_settings(spark):
    texts = ["x" * 10] * 2000 + ["y" * 100_000] * 8
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    cut = list(_common.pieces([batch, batch.slice(0, 0)], rows=300, size=150_000))
    assert [x for p in cut for x in p.column(0).to_pylist()] == texts
    assert max(p.num_rows for p in cut) <= 300 and max(p.nbytes for p in cut if p.num_rows > 1) <= 300_000
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for before, after in (("64m", _common.BATCH_BYTES), ("1m", 1 << 20)):
        spark.conf.set(name, before)
        _common.bound_batches(spark)
        assert spark.conf.get(name) in (f"{after}b", before if before == "1m" else "")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
    spark.conf.unset(name)


CLASH = "doc_id long, text string, source string, place string, cell int, keys string, node long, score double, each int"


def clashing():
    rnd = random.Random(9)
    word = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    rows = [(k, word(rnd.randrange(0, 40)), "s" + str(k % 3) if k % 5 else None) for k in range(60)]
    rows += [rows[3]] * 4 + [(3, "another text with the id three", "s0"), (None, word(9), "s1"), (None, word(9), None), (70, None, "s2"), (71, "", "s2"), (72, word(30_000), "s1")]
    return [(*r, "p", k % 4, "k", 5, 0.5, k % 2) for k, r in enumerate(rows)]


def test_stages_with_clashing_columns_repeated_ids_and_empty_tables(spark, tmp_path):
    rows = clashing()
    docs = spark.createDataFrame(rows, CLASH)
    spark.createDataFrame([(k, k % 2) for k in range(0, 60, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.collect()
        if name == "toxicity":  # labels of one kind: nothing goes
            assert Counter(map(tuple, found)) == Counter(rows)
        if name == "simhash_near_dedup":
            kept = Counter((r.doc_id, r.text) for r in found)
            assert max(kept.values()) == 1 and (3, "another text with the id three") in kept and sum(i == 3 for i, _ in kept) == 2
            assert sum(not (t or "").split() for _, t in kept) == 1
        if name == "pii_surrogates":
            assert Counter(map(tuple, found)) == Counter(rows)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()
        conf = defaultdict(lambda: None)

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.checkpoint(Frame())
    assert corpus_pipeline.surrogate_key(spark) == corpus_pipeline.pii.TEST_KEY
    spark.conf.set("spark.notegrain.pii.key", "own")
    assert corpus_pipeline.surrogate_key(spark) == b"own"
    spark.conf.unset("spark.notegrain.pii.key")
