"""Toxicity by multiple-instance learning: labels are known for documents, scores are made for sentences.

A document is the bag of its sentences. Each sentence has a probability (logistic in its distinct words and their
beginnings); the document's is their noisy-or, 1 - prod(1 - p). A score takes the odds above the base rate, in the worst run
of WINDOW sentences, so that background doesn't add up with a document's length. The weights are fitted to document labels only, by
descent on the bags' likelihood with an L1 pull to zero, so the words that tell the labels apart keep weights and the
sentences holding them are found.

The fit uses a bounded sample of the labelled training rows: at most SAMPLE of each label and at most SAMPLE_BYTES of
their texts, in the order of a hash of doc_id (a text that doesn't fit the bytes left is passed over). Every word of the
sample may get a weight; which ones do is left to the pull. Executors cut the sampled texts into sentences and words, the
driver gets these, so its data are bounded by the sample's bytes. Scoring is one pass over whole texts with no shuffle.

Defined results: a null or empty text is one empty sentence and scores 0; without labelled rows of both
kinds every score is 0; repeated label rows of a document count once, as the largest label; null labels and null ids
don't count; of texts that share an id the fit reads the least; repeated documents are scored alike; an empty table gives
an empty table.
"""

from __future__ import annotations

import ctypes
import gc
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrain.llm._common import checkpoint, id_and_text, pieces, table

#: Labelled rows of either kind that the fit reads at most.
SAMPLE = 2500
#: Bytes of text that the fit reads at most, of either kind.
SAMPLE_BYTES = 6 << 20
#: A document is predicted toxic from this score on; a sentence is reported from this one on.
THRESHOLD, SENTENCE_THRESHOLD = 0.7, 0.5
#: Sentences that are combined at a time.
WINDOW = 40
#: Lengths of word beginnings.
STEMS = (5, 7)
_STEPS, _L1, _RATE = 400, 2e-4, 0.1
#: Steps between looks at all words; in between only those move that have a weight or a gradient above the pull.
_LOOK = 20
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, str]]:
    """(start, sentence) spans that cover the text."""
    return [(m.start(), m[0]) for m in _SENTENCE.finditer(text or "")] or [(0, "")]


def plain_words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def words(sentence: str) -> set[str]:
    """Distinct words, and the beginnings of longer ones, written with a star: inflected words share them."""
    found = plain_words(sentence)
    return found.union(*[{f"{w[:k]}*" for w in found if len(w) > k} for k in STEMS])


def training_rows(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, label of the rows the fit may see: crc32 of the id's digits, modulo 3, is not 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return known.where("crc32(cast(doc_id as string)) % 3 != 1").groupBy("doc_id").agg(F.max("label").alias("label"))


def _sampled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """text, label of the sample, in no order."""
    rows = training_rows(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # at most 2 * SAMPLE ids, so they can be sent to every executor
    chosen = rows.where("label = 1").orderBy(*order).limit(SAMPLE).unionByName(rows.where("label = 0").orderBy(*order).limit(SAMPLE))
    found = checkpoint(id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    sizes = found.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy(*order).collect()
    left, kept = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sizes:
        if r.label in left and r.bytes <= left[r.label]:
            left[r.label] -= r.bytes
            kept.append((r.doc_id,))
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id").select("text", "label")


def _bags(sample: DataFrame) -> pa.Table:
    """For each sampled document: its label, number of sentences, its words, and (sentence, word) places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place: dict[str, int] = {}
                spans = [sorted(plain_words(s)) for _, s in sentences(text)]
                hits = [(k, place.setdefault(w, len(place))) for k, found in enumerate(spans) for w in found]
                for column, value in zip(out, (label, len(spans), list(place), [h[0] for h in hits], [h[1] for h in hits]), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["label", "n", "words", "sentence", "word"])

    return sample.mapInArrow(run, "label int, n int, words array<string>, sentence array<int>, word array<int>").toArrow()


def noisy_or_gradient(bias: float, weight: np.ndarray, labels: np.ndarray, bag: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of the mean loss -log P(label) by the weights and, last, the bias."""
    n = len(labels)
    z = bias + np.bincount(row, weight[word], len(bag))
    odds = np.logaddexp(0, z)  # -log(1 - p) of a sentence
    total = np.maximum(np.bincount(bag, odds, n), 1e-9)
    slope = np.where(labels == 1, -1 / np.expm1(total), 1.0) / n  # of the loss by total
    by_z = slope[bag] / (1 + np.exp(-z))
    return np.append(np.bincount(word, by_z[row], len(weight)), by_z.sum())


def fit_noisy_or(labels: np.ndarray, bag: np.ndarray, row: np.ndarray, word: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Bias and weights. bag: each sentence's document; row, word: the words of each sentence."""
    bias, weight = -6.0, np.zeros(size)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    live = np.arange(size)
    for step in range(1, _STEPS + 1):
        if step % _LOOK == 1:  # a word that is left out has no weight, and its gradient is below the pull
            gradient = noisy_or_gradient(bias, weight, labels, bag, row, word)
            live = np.flatnonzero((weight != 0) | (np.abs(gradient[:-1]) > _L1 / 2))
            place = np.full(size, -1)
            place[live] = np.arange(len(live))
            held = place[word] >= 0
            rows, words_ = row[held], place[word[held]]
            gradient = gradient[np.append(live, size)]
        else:
            gradient = noisy_or_gradient(bias, weight[live], labels, bag, rows, words_)
        at = np.append(live, size)
        first[at] = 0.9 * first[at] + 0.1 * gradient
        second[at] = 0.99 * second[at] + 0.01 * gradient**2
        rate = _RATE * (1 - 0.9 * step / _STEPS)
        scale = np.sqrt(second[at] / (1 - 0.99**step)) + 1e-6
        move = rate * (first[at] / (1 - 0.9**step)) / scale
        bias = min(bias - move[-1], -3.0)
        # the pull to zero, scaled as the move is, so that words without a use for the labels end at zero
        moved = weight[live] - move[:-1]
        weight[live] = np.sign(moved) * np.maximum(np.abs(moved) - rate * _L1 / scale[:-1], 0)
    return float(bias), weight


def _give_back() -> None:
    """What the fit held goes back to the system, as the driver has later stages to run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[float, dict[str, float]]:
    """Bias and word weights, from labelled training rows."""
    bags = _bags(_sampled(docs, labels, label))
    known = bags["label"].to_numpy() if bags.num_rows else np.zeros(0, np.int64)
    if len(set(known.tolist())) < 2:
        return -math.inf, {}
    # the same sample in another order gives the same model
    bags = bags.append_column("first", pc.binary_join(bags["words"], " ")).sort_by([("label", "ascending"), ("first", "ascending"), ("n", "ascending")])
    sizes, sentences_in = bags["n"].to_numpy(), bags["sentence"].combine_chunks()
    found = pc.list_flatten(bags["words"]).combine_chunks().dictionary_encode()
    vocabulary, code = found.dictionary.to_pylist(), found.indices.to_numpy()
    words_before = np.cumsum(np.append(0, pc.list_value_length(bags["words"]).to_numpy()))[:-1]
    hits = pc.list_value_length(bags["sentence"]).to_numpy()
    row = pc.list_flatten(sentences_in).to_numpy() + np.repeat(np.cumsum(sizes) - sizes, hits)
    word = code[pc.list_flatten(bags["word"]).to_numpy() + np.repeat(words_before, hits)]
    known = bags["label"].to_numpy()
    del bags, sentences_in, found, code
    # beginnings are features too; a sentence has each once
    place = {w: k for k, w in enumerate(vocabulary)}
    own = [np.fromiter((place.setdefault(w[:n] + "*", len(place)) if len(w) > n else -1 for w in vocabulary), np.int32, len(vocabulary)) for n in STEMS]
    parts = [row * len(place) + word]
    for beginning in (o[word] for o in own):
        parts.append(row[beginning >= 0] * len(place) + beginning[beginning >= 0])
    pairs = np.unique(np.concatenate(parts))
    del parts, own, vocabulary
    row, word = (pairs // len(place)).astype(np.int32), (pairs % len(place)).astype(np.int32)
    del pairs
    bias, weight = fit_noisy_or(known, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), row, word, len(place))
    chosen = set(np.flatnonzero(weight).tolist())
    weights = {w: float(weight[k]) for w, k in place.items() if k in chosen}
    del place, row, word, weight
    _give_back()
    return bias, weights


def sentence_scores(text: str | None, bias: float, weights: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
    """The largest noisy-or of WINDOW sentences in a row, and (start, end, score) of the offending sentences."""
    if bias == -math.inf:
        return 0.0, []
    offending, known = [], weights.keys()
    base = math.log1p(math.exp(bias))
    window: deque[tuple[int, float]] = deque()
    now = most = 0.0
    for k, (start, sentence) in enumerate(sentences(text)):
        hits = known & words(sentence)
        z = bias + sum(weights[w] for w in hits)
        odds = (math.log1p(math.exp(z)) if z < 30 else z) - base if hits else 0.0
        if odds <= 0:
            continue
        window.append((k, odds))
        now += odds
        while window[0][0] <= k - WINDOW:
            now -= window.popleft()[1]
        most = max(most, now)
        p = 1 / (1 + math.exp(-z)) if z > -30 else 0.0
        if p >= SENTENCE_THRESHOLD:
            offending.append((start, start + len(sentence), p))
    return -math.expm1(-most), offending


def score(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, offending (start, end, score of sentences) of each row."""
    bias, weights = model
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [sentence_scores(t.as_py(), bias, weights) for t in batch.column(1)]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "offending"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double, offending array<struct<start: int, end: int, score: double>>")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), "offending"
    )


def drop_toxic(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """The documents' rows but for those predicted toxic; the score is made beside the text, without a join.

    Null and empty texts score 0 and stay; repeated rows are judged alike; an empty table stays empty with its columns.
    """
    bias, weights = model

    @F.pandas_udf("double")
    def toxic(texts):  # noqa: ANN001, ANN202  pandas infers the kind of UDF from annotations it can resolve
        return texts.map(lambda t: sentence_scores(t, bias, weights)[0])

    return docs.where(toxic(F.coalesce(F.col("text").cast("string"), F.lit(""))) < THRESHOLD)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score of the whole documents table by a model of the labels' training rows; see the module for the defined cases."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
