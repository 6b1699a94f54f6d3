"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two moduli, the sum of c[j] * B**j over its first i code points, modulo p. The
difference of two entries, brought to a common power, is the hash of a span, so spans of any two texts are compared in
constant time and the longest common extension from two places is found by binary search.

A fingerprint, a string of hex digits, is read off these arrays: the number of code points; the hash of the whole text;
prefix hashes at a ladder of lengths, each a quarter longer; and a sketch of all spans of SPAN code points, the least
span hash in each of SLOTS slots. Likeness is 1 for equal texts, else the greater of two figures, both of which need
only the fingerprints: the share of agreeing sketch slots (an estimate of the spans in common), and the longest common
beginning, found by binary search in the ladder, by the longer length.

The query also needs each document's successor by doc_id. Documents are dealt once into ranges of doc_id whose bounds
are quantiles of the ids; an id that is several quantiles is cut further, by the text's hash. The first document of each
range is dealt to the range before it too. A range is then read in order, one document at a time. That is the one shuffle.
Rows that repeat id and text very often (see HOT_PARTS) are counted before it and travel as one row.

Defined results: null texts are empty; equal texts have equal fingerprints; ties of doc_id are ordered by the text's hash
(XXH64, seed 42, signed), then text; nulls of doc_id come first; the last document's successor is the first; one document
is its own; an empty table gives an empty table. Very long texts take memory in proportion to their length (some 30 bytes
for each code point), one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrain.llm._common import checkpoint, id_and_text, pieces, table

#: Two Mersenne-size primes and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 911382323)
SPAN, SLOTS = 16, 64
#: Ranges of doc_id at most: their bounds are kept by the driver. Larger inputs have larger ranges, sorted with spill.
MOST_RANGES = 20_000
#: Rows of one id and text above this part of all rows travel as one; fewer than so many can be. Below HOT_ROWS none do.
HOT_PARTS, HOT_ROWS = 1000, 1000
#: Code points hashed at a time, to bound what is only needed meanwhile.
_STEP = 1 << 18
_LADDER = [1]
while _LADDER[-1] < 1 << 40:
    _LADDER.append(max(_LADDER[-1] + 1, _LADDER[-1] * 5 // 4))

_powers: list[np.ndarray] = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of both bases up to n at least, doubled as longer texts come."""
    while len(_powers[0]) <= n:
        for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
            grown = pow(b, len(_powers[k]), p)
            _powers[k] = np.concatenate([_powers[k], (_powers[k].astype(np.uint64) * np.uint64(grown) % np.uint64(p)).astype(np.uint32)])
    return _powers


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        powers = _power_table(self.n + SPAN)
        self.sums = [np.zeros(self.n + 1, np.uint32) for _ in PRIMES]
        for at in range(0, self.n, _STEP):
            end = min(at + _STEP, self.n)
            own = points[at:end].astype(np.uint64) + np.uint64(1)
            for k, p in enumerate(PRIMES):
                # terms below 2**31 add up without overflow
                total = np.cumsum(own * powers[k][at:end] % np.uint64(p)) + self.sums[k][at]
                self.sums[k][at + 1 : end + 1] = total % np.uint64(p)

    def span(self, start: int, end: int, top: int) -> tuple[int, int]:
        """Hash of a span, multiplied up to the power top - start; spans are equal if hashes with one top are."""
        powers = _power_table(top)
        return tuple((int(self.sums[k][end]) - int(self.sums[k][start])) * int(powers[k][top - start]) % p for k, p in enumerate(PRIMES))  # type: ignore[return-value]

    def whole(self) -> str:
        return f"{int(self.sums[0][-1]):08x}{int(self.sums[1][-1]):08x}"

    def spans(self, width: int) -> Iterator[np.ndarray]:
        """A 32-bit value for each span of a width, some at a time."""
        p = np.uint64(PRIMES[0])
        for at in range(0, self.n - width + 1, _STEP):
            n = min(_STEP, self.n - width + 1 - at)
            # B**(n - i) brings every span to one power; it is the table read backwards
            raw = (self.sums[0][at + width : at + width + n] + p - self.sums[0][at : at + n]) % p * _power_table(n)[0][n:0:-1] % p
            # the power left over depends on at and n only: divide it out, so that equal spans anywhere agree
            raw = raw * np.uint64(pow(pow(BASES[0], at + n, PRIMES[0]), PRIMES[0] - 2, PRIMES[0])) % p
            yield ((raw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether two spans are alike, in constant time."""
    if i + length > a.n or j + length > b.n:
        return False
    top = max(i, j)
    return a.span(i, i + length, top) == b.span(j, j + length, top)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension from i and j, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if spans_equal(a, i, b, j, middle) else (low, middle - 1)
    return low


def fingerprint(hashes: PrefixHashes) -> str:
    """length (8 digits and more), whole hash (16), ladder (4 each), sketch (4 each), joined by "."."""
    steps = [int(hashes.sums[0][k]) & 0xFFFF for k in _LADDER if k <= hashes.n]
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    least: list[int | None] = [None] * SLOTS
    for values in hashes.spans(SPAN):
        values.sort()
        at = np.searchsorted(values, np.arange(SLOTS, dtype=np.uint64) << np.uint64(shift))
        for k, i in enumerate(at.tolist()):
            if i < len(values) and int(values[i]) >> int(shift) == k and (least[k] is None or int(values[i]) < least[k]):
                least[k] = int(values[i])
    # an empty slot is "----"; it counts for no likeness
    slots = ["----" if v is None else f"{v & 0xFFFF:04x}" for v in least]
    return ".".join((f"{hashes.n:08x}", hashes.whole(), "".join(f"{s:04x}" for s in steps), "".join(slots)))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (n, _, steps, slots), (m, _, other_steps, other_slots) = a.split("."), b.split(".")
    longer = max(int(n, 16), int(m, 16))
    low, high = 0, min(len(steps), len(other_steps)) // 4
    while low < high:  # how many steps of the ladder agree: a prefix of a common prefix is common
        middle = (low + high + 1) // 2
        same = steps[4 * middle - 4 : 4 * middle] == other_steps[4 * middle - 4 : 4 * middle]
        low, high = (middle, high) if same else (low, middle - 1)
    beginning = _LADDER[low - 1] / longer if low else 0.0
    filled = [(slots[k : k + 4], other_slots[k : k + 4]) for k in range(0, 4 * SLOTS, 4) if (slots[k : k + 4], other_slots[k : k + 4]) != ("----", "----")]
    spans = sum(x == y for x, y in filled) / len(filled) if filled else 0.0
    return max(beginning, spans)


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by as many of the following text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _areas(bounds: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bounds; the number of the area that begins with each; and how many areas the bound's own id has."""
    edges, times = np.unique(np.array(bounds, np.float64), return_counts=True)
    # beyond exact doubles several ids could pass for a bound
    times = np.where(np.abs(edges) < 2.0**53, times, 1)
    return edges, np.cumsum(times) - times + 1, times


def _neighbours(docs: DataFrame, range_bytes: int) -> DataFrame:
    """area, doc_id, hash, text, copies, lead: ranges of doc_id in order; lead rows end a range, being the next range's first."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = id_and_text(docs).select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
    # texts are read once for this and once more to be dealt
    light = checkpoint(rows.select("doc_id", "hash", F.octet_length("text").alias("bytes")))
    total = light.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    n_rows, n_bytes = (total.rows, total.bytes or 0) if total else (0, 0)
    # fewer than HOT_PARTS keys
    often = light.groupBy("doc_id", "hash").count().where(F.col("count") > max(n_rows // HOT_PARTS, HOT_ROWS)).collect()
    every = rows.withColumn("copies", F.lit(1).cast("long"))
    if often:
        hot = F.broadcast(spark.createDataFrame([(r.doc_id, r.hash) for r in often], "hot_id long, hot_hash long"))
        same = F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("hash") == F.col("hot_hash"))
        repeated = rows.join(hot, same, "left_semi").groupBy("doc_id", "hash", "text").agg(F.count("*").alias("copies"))
        every = every.join(hot, same, "left_anti").unionByName(repeated)
    ranges = max(1, min(int(n_bytes // range_bytes) + 1, n_rows // 8 + 1, MOST_RANGES))
    probabilities = [k / ranges for k in range(1, ranges)]
    known = light.where("doc_id is not null")
    edges, first, times = _areas(known.approxQuantile("doc_id", probabilities, 0.2 / ranges) if probabilities else [])

    @F.pandas_udf("int")
    def area_of(ids, hashes):  # noqa: ANN001, ANN202
        import pandas as pd

        place = np.where(ids.isna(), -1, np.searchsorted(edges, ids.fillna(0), side="right") - 1)
        at = np.maximum(place, 0)
        if not len(edges):
            return pd.Series(np.zeros(len(ids), "int32"))
        share = np.minimum((hashes.to_numpy() + 2.0**63) / 2.0**64, 1 - 1e-9)
        # an id that is a bound several times has as many areas; whatever follows it belongs to the last of them
        inner = np.where(ids.fillna(0) == edges[at], share * times[at], times[at] - 1).astype("int64")
        return pd.Series(np.where(place < 0, 0, first[at] + inner).astype("int32"))

    area = area_of("doc_id", "hash")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")
    # a row of numbers for each range, at most MOST_RANGES
    firsts = sorted(light.select("*", area.alias("area")).groupBy("area").agg(F.min(order).alias("first")).collect())
    marks = [(r.first.doc_id, r.first.hash, firsts[k - 1].area) for k, r in enumerate(firsts)]
    marked = F.broadcast(spark.createDataFrame(marks, "mark_id long, mark_hash long, target int"))
    found = every.withColumn("area", area).join(marked, F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.col("hash") == F.col("mark_hash")), "left")
    own = F.struct("area", "copies", F.lit(False).alias("lead"))
    lead = F.struct(F.col("target").alias("area"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("lead"))
    each = F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, lead))).alias("e")
    return found.select("doc_id", "hash", "text", each).select("e.area", "doc_id", "hash", "text", "e.copies", "e.lead")


def fingerprint_edits(docs: DataFrame, range_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_start.

    common_start is how far the text and the edited one agree, by binary search.
    """
    areas = _neighbours(docs, range_bytes).repartition("area").sortWithinPartitions("area", "lead", F.col("doc_id").asc_nulls_first(), "hash", "text")
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    kinds += [("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_start", pa.int64()), ("times", pa.int64())]

    def judged(doc_id: int | None, text: str, own: tuple[PrefixHashes, str], following: str, next_print: str, times: int) -> tuple:
        changed = edited(text, following)
        hashes = PrefixHashes(changed)
        mark = fingerprint(hashes)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, own[1], mark, likeness(own[1], mark), likeness(own[1], next_print), common_extension(own[0], 0, hashes, 0), times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in pieces(batches, rows=256):
            out = []
            for area, doc_id, _, text, copies, lead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = PrefixHashes(text)
                mark = (hashes, fingerprint(hashes))
                if held is not None and held[0] == area:
                    out.append(judged(*held[1:], text, mark[1], 1))
                held = None if lead else (area, doc_id, text, mark)
                if copies > 1:  # all but the last are followed by the same text
                    out.append(judged(doc_id, text, mark, text, mark[1], copies - 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], [n for n, _ in kinds])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long, times long"
    found = areas.mapInArrow(run, schema)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("each")
    return found.select("*", each).drop("times", "each")


def op1_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint_edits of the whole documents table; see the module for nulls, ties and empty tables."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
