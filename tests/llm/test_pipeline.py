"""The pipeline against a brute-force version of its stages."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from notegrain.llm import pii, piece_bpe, source_mix, toxicity
from test_operators import brute_components, brute_simhash


def corpus():
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(k, text(rnd.randrange(5, 60)) + ".") for k in range(150)]
    rows = [(k, t + f" vile{k % 2} thing." if k % 5 == 0 else t) for k, t in rows]
    rows += [(200 + k, rows[k + 1][1]) for k in range(0, 40, 3)]
    rows += [(300, "mail a.b@c1.example.org now"), (301, ""), (302, None), (303, "10.0.0.7 " + text(20))]
    docs = [(i, t, "en", "s" + str(i % 4) if i % 17 else None, len(t or "")) for i, t in rows]
    return docs, [(i, 1, int(" vile" in (t or ""))) for i, t in rows]


def place(doc_id):
    return int(hashlib.md5(f"{source_mix.SEED}:{doc_id}".encode()).hexdigest()[:12], 16)


def brute_mix(docs):
    """Repetitions by source: clamp and reshare, then whole and, in the order of places, the nearest to the rest."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for _, t, _, s, _ in docs:
        sums[s] += size(t)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set(order)
    while True:
        level = (1.5 * sum(sums.values()) - sum(2 * sums[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sums[s]}
        if not over:
            break
        open_ -= over
    out = []
    for s in order:
        target = level * weight[s] if s in open_ else 2 * sums[s]
        whole = int(target // sums[s]) if sums[s] else 0
        rest, running = target - whole * sums[s], 0
        for d in sorted((d for d in docs if d[3] == s), key=lambda d: place(d[0])):
            n, running = size(d[1]), running + size(d[1])
            under = rest - (running - n)
            extra = rest > 0 and (running <= rest or under > 0 and running - rest < under)
            out += [d] * (whole + extra)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns

    bias, weights = toxicity.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [d for d in docs if toxicity.sentence_scores(d[1], bias, weights)[0] < toxicity.THRESHOLD]
    assert 20 < len(docs) - len(kept) < 45
    component = brute_components([(d[0], brute_simhash(d[1])) for d in kept])
    kept = [d for d in kept if component[d[0]] == d[0]]
    kept = [(d[0], pii.replace(d[1], corpus_pipeline.surrogate_key(spark))[0], *d[2:]) for d in kept]
    assert not any("a.b@c1" in (d[1] or "") or "10.0.0.7" in (d[1] or "") for d in kept)
    library = piece_bpe.MergeVocabulary(piece_bpe.model_bytes()).library
    wanted = Counter((d[0], tuple(library.encode(d[1] or ""))) for d in brute_mix(kept) if (d[1] or "").strip())
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.n_tokens)
    assert got == wanted
