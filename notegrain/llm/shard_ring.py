"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A document's key is its text, so equal texts share a place on the ring. Each shard owns virtual nodes; a key belongs to
the next node clockwise. A shard may hold at most CAPACITY times the mean; what doesn't fit goes on clockwise to the
next node of a shard with room. So sizes are balanced for any input (law ``bytes``), and another shard or a changed
input moves only the keys near the places where that changes an owner or an overflow.

The ring is walked for CELLS equal arcs, not for documents: the bytes of each arc are summed on the executors and the
walk sees only these sums. Keys with more than HOT of a shard's share of bytes or of rows are placed by themselves. Above
SPLIT of the bytes a key is dealt into SPLIT_PIECES pieces by doc_id that are placed one by one, so its copies spread only
as far as capacity makes them. Numbers within a shard come from the sums of rows by arc, plus the row's number in its arc;
a hot key's rows (a null text may be most of them, with few bytes) are counted and numbered in as many parts as they
exceed the share of rows, by a hash of doc_id, so no task numbers more than a few shares.

Defined results: a null text counts as empty: size 1, checksum 0; equal texts stay together unless split; repeated rows
are rows; ties in an arc are numbered by key, doc_id and size; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrain.llm._common import checkpoint, table

SHARDS = 8
VIRTUAL_NODES = 128
#: A shard's capacity in means.
CAPACITY = 1.001
CELLS = 1 << 16
#: Keys above this part of a shard's mean load are placed by themselves; there are at most SHARDS / HOT of them.
HOT = 0.002
#: Keys above this part are dealt into pieces.
SPLIT, SPLIT_PIECES = 0.05, 64
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: int) -> int:
    """A 64-bit hash of a small integer (splitmix64)."""
    x = (x + _MIX[0]) & (2**64 - 1)
    x = ((x ^ x >> 30) * _MIX[1]) & (2**64 - 1)
    x = ((x ^ x >> 27) * _MIX[2]) & (2**64 - 1)
    return x ^ x >> 31


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in cells, ascending) and owners of all virtual nodes."""
    nodes = sorted((_mixed(s << 32 | v) % cells, s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in nodes]), np.array([s for _, s in nodes])


def place(cells: list[tuple[int, int]], shards: int, capacity: float = CAPACITY) -> list[int]:
    """Shards of (cell, bytes) units: clockwise from each unit's cell to the first shard with room.

    Larger units come first, so that small ones fill what is left. If rounding leaves room nowhere, the emptiest
    shard takes the unit; it then exceeds its capacity by less than that unit.
    """
    places, owners = ring(shards)
    total = sum(b for _, b in cells)
    room = np.full(shards, int(total * capacity / shards) + 1)
    out = [0] * len(cells)
    for k in sorted(range(len(cells)), key=lambda k: (-cells[k][1], cells[k][0], k)):
        cell, load = cells[k]
        at = int(np.searchsorted(places, cell))
        order = owners[(np.arange(len(owners)) + at) % len(owners)] if room[owners[at % len(owners)]] < load else owners[[at % len(owners)]]
        fits = np.flatnonzero(room[order] >= load)
        out[k] = int(order[fits[0]]) if len(fits) else int(room.argmax())
        room[out[k]] -= load
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(text)
    rows = checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            key.alias("key"),
            F.pmod(key, F.lit(CELLS)).cast("int").alias("cell"),
        )
    )
    keys = rows.groupBy("key", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    limit, row_limit = (max(1, int((n or 0) * HOT / shards)) for n in ((total.bytes, total.rows) if total else (0, 0)))
    # fewer than 2 * shards / HOT keys can be above a limit; their parts are as few and a part for each key
    hot = [(r.key, r.bytes > limit * (SPLIT / HOT), -(-r.rows // row_limit)) for r in keys.where((F.col("bytes") > limit) | (F.col("rows") > row_limit)).collect()]
    spark = docs.sparkSession
    hot_keys = spark.createDataFrame(hot, "key long, split boolean, parts long").withColumn("hot", F.lit(True))
    by_id = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 40))
    piece = F.when(F.col("split"), F.pmod(by_id, F.lit(SPLIT_PIECES)).cast("int")).otherwise(F.lit(-1))
    part = F.when(F.col("split"), F.pmod(F.floor(by_id / SPLIT_PIECES), F.ceil(F.col("parts") / SPLIT_PIECES))).when(F.col("hot"), F.pmod(by_id, F.col("parts"))).otherwise(F.lit(0))
    # a hot key or its pieces are units of their own; all other keys of a cell are one
    units = rows.join(F.broadcast(hot_keys), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("piece", piece).withColumn("part", part.cast("long"))
    units = units.withColumn("unit_key", F.when(F.col("hot"), F.col("key")).otherwise(F.lit(0)))
    unit, by = ["cell", "unit_key", "piece"], ["cell", "unit_key", "piece", "part"]
    # at most CELLS sums and what the hot keys have, whatever the number of documents
    sums = units.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toArrow().sort_by([(c, "ascending") for c in by])
    whole = sums.group_by(unit, use_threads=False).aggregate([("bytes", "sum")]).sort_by([(c, "ascending") for c in unit])
    placed = dict(zip(zip(*(whole[c].to_pylist() for c in unit), strict=True), place(list(zip(whole["cell"].to_pylist(), whole["bytes_sum"].to_pylist(), strict=True)), shards), strict=True))
    chosen = np.array([placed[u] for u in zip(*(sums[c].to_pylist() for c in unit), strict=True)], np.int32)
    rows_in, start = sums["rows"].to_numpy(), np.zeros(len(chosen), np.int64)
    for s in range(shards):
        start[chosen == s] = np.cumsum(rows_in[chosen == s]) - rows_in[chosen == s]
    plan = sums.select(by).append_column("shard", pa.array(chosen)).append_column("start", pa.array(start))
    planned = F.broadcast(spark.createDataFrame(plan))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("key", "doc_id", "size"))
    return units.withColumn("number", number).join(planned, by).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard of the whole documents table; see the module for nulls, ties and empty tables."""
    return shard(table(spark, sf_dir, "documents"))
