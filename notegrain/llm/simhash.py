"""Near-duplicates by SimHash, BK-trees and connected components.

Fingerprints: A-Z lower-cased, words cut at ASCII white space, word shingles (repeats included), XXH64 with seed 42,
majority of each bit. Equal fingerprints are one node, named by the fingerprint, before anything is compared.

Links: 64 bits are cut into blocks, six at first. Two fingerprints that differ in at most four bits agree on all blocks
but four, so every pair to be linked meets in one of the shards that two (all but four) blocks' values name. More
fingerprints are cut into more blocks (blocks_for): the keys grow, so that shards keep their size. Each shard becomes a
BK-tree: a child's key is its integer Hamming distance to its parent, and a search follows only the edges within the
radius of the distance at hand. Shard trees are not broadcast: together they hold every fingerprint and so grow with
the corpus; their members travel by the shuffle to the task that builds the tree. A shard above SHARD_ROWS is cut into
chunks whose trees are searched chunk by chunk, in as many groups, so no task holds more than two chunks; nothing is
dropped. Each group reports a spanning forest of its links, at most one link for each member.

Near copies (keep_one, the pipeline's stage) are another rule: five-word shingles with an exact Jaccard similarity of 0.8
or more. At 0.8 some 15% of the bits differ, which no pigeonhole of 64 bits survives in a large corpus. So their SimHash is
wider: PRINT_BITS name shards, each by some bits drawn from them, so many shards that a pair at 0.8 shares one but for
MISSED; SEARCH_BITS more, which are never part of a name, are what the shards' BK-trees hold and are searched for within
COPY_RADIUS. Whoever the searches connect is a cluster, and in it every link is verified on the whole sets of shingles.

Components: links are contracted by alternating large-star and small-star rounds until every node points at the
smallest one it can reach. Nothing is collected but one count per round.

A fingerprint, component or hub may hold a large part of all rows. Wherever rows are joined to such keys, the keys above
one HOT_PARTS-th of the rows (fewer than HOT_PARTS, by count) are broadcast and their rows stay where they are.

Defined results: a null, empty or white-space text has fingerprint zero and is linked as any other; repeated rows and
equal texts share their component; rows without doc_id are linked as any other, but name no component: one whose group
has no id at all gets a null component; an empty table gives an empty table; very long texts are taken whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrain.llm._common import checkpoint, id_and_text, pieces, table

SEED = 42
RADIUS = 4
SHINGLE_WORDS = 4
#: Members of a shard's tree at most; larger shards are cut into chunks.
SHARD_ROWS = 1024
#: Near copies (keep_one): words of a shingle and Jaccard similarity from which on two texts are linked.
COPY_WORDS, COPY_JACCARD = 5, 0.8
#: Bits of the wide fingerprint that shards are named by, and of the one in their trees.
PRINT_BITS, SEARCH_BITS = 1024, 256
#: Bits of SEARCH_BITS that near copies may differ in: 5 standard deviations above the mean at COPY_JACCARD.
COPY_RADIUS = 67
#: Pairs at COPY_JACCARD that share no shard, at most, were shards independent.
MISSED = 0.0002
#: Unrelated texts in a shard, on average, from which on its name gets another bit.
CROWD = 64
#: Shingles that an index for exact comparisons holds.
BLOCK = 1 << 20
#: Bits of the filter for texts that have candidates.
FILTER_BITS = 1 << 26
#: Keys above this part of a join's rows are hot; fewer than so many can be.
HOT_PARTS = 1000
#: Keys of no more rows than this are never hot.
HOT_ROWS = 100
#: Shingles hashed at a time, to bound memory on very long texts.
_STEP = 1 << 15
#: Links among (node, item) members, or between them and the other side's.
Compare = Callable[[list[tuple[int, bytes]], list[tuple[int, bytes]] | None], list[tuple[int, int]]]


def simhash(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)) if len(words) >= width else [(0, len(joined))]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(spans), _STEP):
        data = b"".join([digest(joined[a:b], SEED) for a, b in spans[at : at + _STEP]])
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans)).view(">u8")[0])


class BKTree:
    """Integers under Hamming distance; children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Put a value in; equal values share a node."""
        at, new = 0, len(self.values)
        while new:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                break
            at = child
        self.values.append(value)
        self.children.append({})
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes at most radius away: only edges keyed from d-radius to d+radius can lead to one."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            stack += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]


class _Forest:
    """Union by smaller root; says whether two were apart."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a
        return a != b


def group_links(tree_side: list[tuple[int, int]], search_side: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among (fingerprint, node) members, or between the two sides."""
    tree, forest, nodes, out = BKTree(), _Forest(), [], []
    for value, node in tree_side:
        if search_side is None:
            for at in tree.within(value, radius):
                if forest.join(nodes[at], node):
                    out.append((min(nodes[at], node), max(nodes[at], node)))
        if tree.add(value) == len(nodes):
            nodes.append(node)
    for value, node in search_side or ():
        for at in tree.within(value, radius):
            if forest.join(nodes[at], node):
                out.append((min(nodes[at], node), max(nodes[at], node)))
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text as it is), fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [simhash(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def blocks_for(nodes: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> int:
    """Blocks at least two more than the radius, so many that evenly spread fingerprints give shards of shard_rows."""
    blocks = radius + 2
    while blocks < 16 and nodes >> (64 // blocks * (blocks - radius)) > shard_rows:
        blocks += 1
    return blocks


def block_masks(radius: int = RADIUS, blocks: int | None = None) -> list[int]:
    """Masks of all but radius blocks: whoever differs in at most radius bits agrees under one of them."""
    n = blocks or radius + 2
    cut, start = [], 0
    for k in range(n):
        size = 64 // n + (k < 64 % n)
        cut.append(((1 << size) - 1) << start)
        start += size
    masks = [sum(chosen) for chosen in itertools.combinations(cut, n - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of left (so many rows) with right, which has each key once and, as size, the rows that left has of it.

    Rows of hot keys (see HOT_PARTS) meet a broadcast of at most HOT_PARTS rows; only the others are shuffled.
    """
    hot = right.where(F.col("size") > max(total // HOT_PARTS, HOT_ROWS)).drop("size")
    names = [c for c in hot.columns if c != key]
    marked = left.join(F.broadcast(hot.withColumn("hot key", F.lit(True))), key, "left")
    found = marked.where(F.col("hot key")).drop("hot key")
    rest = marked.where(F.col("hot key").isNull()).select(*left.columns).join(right.drop("size"), key)
    columns = [key, *[c for c in left.columns if c != key], *names]
    return found.select(*columns).unionByName(rest.select(*columns))


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, blocks: int | None = None) -> DataFrame:
    """u < v: links between nodes (fp, node) that connect all those within the radius."""
    masks = block_masks(radius, blocks)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
    members = nodes.select("fp", "node", keys.alias("at")).select("at.band", "at.key", "fp", "node")
    counts = members.groupBy("band", "key").count().where("count > 1").withColumnRenamed("count", "size")
    chunk = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    shared = members.join(counts, ["band", "key"]).withColumn("chunks", F.ceil(F.col("size") / F.lit(shard_rows))).withColumn("own", chunk)
    # a member builds or searches with each chunk of its shard: group (lo, hi), the tree holds chunk lo
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    dealt = dealt.select(
        "band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("searches"), "fp", "node"
    )
    ordered = dealt.repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", "searches", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, found = None, ([], []), []

        def close() -> None:
            if now is not None:
                found.extend(group_links(sides[0], sides[1] if now[2] != now[3] else None, radius))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for band, key, lo, hi, searches, fp, node in zip(*columns, strict=True):
                if (band, key, lo, hi) != now:
                    close()
                    now, sides = (band, key, lo, hi), ([], [])
                sides[searches].append((fp & 0xFFFFFFFFFFFFFFFF, node))
            if len(found) > 10_000:
                yield _pairs(found)
                found.clear()
        close()
        yield _pairs(found)

    return ordered.mapInArrow(run, "u long, v long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _with_least(rows: DataFrame, key: str, value: str, hot: list[int]) -> DataFrame:
    """rows and m, the least value of their key; hot keys' least values are few and broadcast."""
    found = rows.where(~F.col(key).isin(hot)).withColumn("m", F.min(value).over(Window.partitionBy(key)))
    if not hot:
        return found
    few = rows.where(F.col(key).isin(hot))
    return found.unionByName(few.join(F.broadcast(few.groupBy(key).agg(F.min(value).alias("m"))), key))


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node in edges (u < v): the smallest node it can reach.

    Alternating stars: each round hangs larger neighbours on a node's smallest one, then a node and its smaller
    neighbours on the smallest. At the end each node but the roots has one edge, to its component's smallest node.
    """
    now, before = checkpoint(edges), None
    while True:
        total = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = F.col("v") > F.col("u")
        degrees = both.groupBy("u").agg(F.count("*").alias("n"), F.count_if(up).alias("larger"), F.bit_xor(F.when(up, F.xxhash64("u", "v"))).alias("x"))
        hubs = F.collect_list(F.when(F.col("n") > max(2 * total // HOT_PARTS, HOT_ROWS), F.col("u")))
        state = degrees.agg(F.sum("larger"), F.bit_xor("x"), F.sum(F.col("u").cast("decimal(38,0)") * F.col("larger")), hubs).first()
        known, hot = (tuple(state)[:3], list(state[3])) if state else ((), [])
        if known == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = known
        large = _with_least(both, "u", "v", hot).where(up).select(F.least("m", "u").alias("u"), "v").where("u < v")
        # a node and its smaller neighbours go to the smallest: the link to the smallest stays, each other one becomes its neighbour's
        small = _with_least(large, "v", "u", hot).select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        now = checkpoint(small.distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, width: int = SHINGLE_WORDS, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row."""
    prints = checkpoint(fingerprints(docs, width))
    member = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_hash")
    # a fingerprint's first document: least doc_id first, rows without id last
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(member).alias("first"), F.count("*").alias("size")))
    counted = nodes.agg(F.count("*").alias("nodes"), F.sum("size").alias("rows")).first()
    n, rows = (counted.nodes, counted.rows or 0) if counted else (0, 0)
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), radius, shard_rows, blocks or blocks_for(n, radius, shard_rows)))
    groups = checkpoint(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "first", F.col("size").alias("rows")))
    least = groups.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("size")).select("component", F.col("first.doc_id").alias("component_id"), "size")
    named = join_counted(groups.select("component", "fp", "rows"), least, "component", n).select("fp", "component_id", F.col("rows").alias("size"))
    return join_counted(prints.select("fp", "doc_id"), named, "fp", rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = COPY_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles, cut as simhash cuts them; none for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest, joined = xxhash.xxh64_digest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)) if len(words) >= width else [(0, len(joined))] * bool(words)
    parts = [np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans[at : at + _STEP]]), ">u8") for at in range(0, len(spans), _STEP)]
    return np.unique(np.concatenate(parts).astype(np.uint64)) if parts else np.zeros(0, np.uint64)


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in PRINT_BITS + SEARCH_BITS bits, packed in bytes: the majority of each bit.

    Each 64 bits come from a keyed mixing of the shingles' hashes.
    """
    words = (PRINT_BITS + SEARCH_BITS) // 64
    seeds = np.random.default_rng(SEED).integers(0, 1 << 63, (2, words), np.int64).astype(np.uint64)
    counts = np.zeros(words * 64, np.int64)
    for at in range(0, len(shingles), 255):  # so many that a byte counts them
        mixed = shingles[at : at + 255, None] * (seeds[0] << np.uint64(1) | np.uint64(1)) + seeds[1]
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1)
        counts += bits.view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(counts * 2 > len(shingles))


def shard_bits(nodes: int) -> np.ndarray:
    """The bits that name each shard of a text: one row for each shard.

    A pair at COPY_JACCARD (sets of one size: cosine 2J/(1+J)) agrees on a bit with probability 1 - angle/pi.
    """
    width = 8
    while width < 24 and nodes >> width > CROWD:
        width += 1
    agree = (1 - np.arccos(2 * COPY_JACCARD / (1 + COPY_JACCARD)) / np.pi) ** width
    rnd = np.random.default_rng(SEED + 1)
    return np.array([rnd.choice(PRINT_BITS, width, replace=False) for _ in range(int(np.ceil(np.log(MISSED) / np.log1p(-agree))))])


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect the same nodes: each to the smallest that it can reach, so that what many tasks find is often the same."""
    forest = _Forest()
    for u, v in links:
        forest.join(u, v)
    return [(root, node) for node in list(forest.parent) if (root := forest.find(node)) != node]


def _meet(dealt: DataFrame, compare: Compare) -> DataFrame:
    """u < v: what compare links among those dealt (place, lo, hi, searches, label, item) to one group, or between its two sides."""
    ordered = dealt.select("place", "lo", "hi", "searches", "label", "item").repartition("place", "lo", "hi").sortWithinPartitions("place", "lo", "hi", "searches", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, found = None, ([], []), []

        def close() -> None:
            if now is not None and len(sides[0]) + len(sides[1]) > 1:
                found.extend(_stars(compare(sides[0], sides[1] if now[1] != now[2] else None)))

        for batch in pieces(batches, 1 << 14):
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for place, lo, hi, searches, label, item in zip(*columns, strict=True):
                if (place, lo, hi) != now:
                    close()
                    now, sides = (place, lo, hi), ([], [])
                sides[searches].append((label, item))
            if len(found) > 10_000:
                yield _pairs(found)
                found.clear()
        close()
        yield _pairs(found)

    return ordered.mapInArrow(run, "u long, v long").distinct()


def links_by_place(members: DataFrame, large: DataFrame, compare: Compare, shard_rows: int, limit: int, turns: int = 1) -> DataFrame:
    """u < v: links that connect all members (place, node, item) of a place that compare links.

    Large places (place, size) are few, and cut into chunks of shard_rows, in so many turns. Whom these connect need not meet again:
    afterwards only those outside of a place's main component meet each other and the main one, in chunks of limit. So
    neither rows dealt nor links grow with the square of a group whose chunks are connected.
    """
    chunks = F.coalesce(F.ceil(F.col("size") / F.lit(shard_rows)), F.lit(1)).cast("int")
    first = members.join(F.broadcast(large), "place", "left").withColumn("chunks", chunks).withColumn("turn", F.lit(0))
    if turns > 1:
        first = first.withColumn("turn", F.explode(F.when(F.col("chunks") > 1, F.sequence(F.lit(0), F.lit(turns - 1))).otherwise(F.array(F.lit(0)))))
    chunk = (F.col("turn") * F.col("chunks") + F.pmod(F.xxhash64("node", "place", "turn"), F.col("chunks"))).cast("int")
    found = _meet(first.select("place", chunk.alias("lo"), chunk.alias("hi"), F.lit(False).alias("searches"), F.col("node").alias("label"), "item"), compare)
    if large.isEmpty():
        return found
    found = components(found)
    label = F.coalesce("component", "node").alias("label")
    inside = checkpoint(members.join(F.broadcast(large.select("place")), "place").join(found, "node", "left").select("place", "node", label, "item"))
    sizes = inside.groupBy("place", "label").agg(F.count("*").alias("n")).groupBy("place").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("main"))
    parts = {"rest": F.col("all") - F.col("main.n"), "most": F.col("main.n")}
    plan = sizes.select("place", F.col("main.label").alias("main"), *[F.ceil(v / F.lit(limit)).cast("int").alias(k) for k, v in parts.items()]).where("rest > 0")
    # chunks of the rest come first: those of the main component only meet these
    dealt = inside.join(F.broadcast(plan), "place").withColumn("in main", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("node", F.lit("chunk")), F.when(F.col("in main"), F.col("most")).otherwise(F.col("rest"))) + F.when(F.col("in main"), F.col("rest")).otherwise(0)
    last = F.when(F.col("in main"), F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1
    dealt = dealt.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("place", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("searches"), "label", "item")
    return found.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(_meet(dealt, compare))


def near_links(own: list[tuple[int, bytes]], others: list[tuple[int, bytes]] | None) -> list[tuple[int, int]]:
    """group_links of (node, bits) within COPY_RADIUS."""
    sides = [None if side is None else [(int.from_bytes(bits), node) for node, bits in side] for side in (own, others)]
    return group_links(sides[0], sides[1], COPY_RADIUS)


def copy_candidates(nodes: DataFrame, count: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """u < v: links that connect all nodes (node, print) that meet in a shard and differ in at most COPY_RADIUS of SEARCH_BITS.

    Shards above shard_rows and one HOT_PARTS-th of the nodes (fewer than HOT_PARTS for each name) are cut, see links_by_place.
    """
    chosen = shard_bits(count)
    powers = np.int64(1) << np.arange(chosen.shape[1], dtype=np.int64)
    names = np.arange(len(chosen), dtype=np.int64) << 32

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(prints[:, : PRINT_BITS // 8], axis=1)
            shards = np.stack([bits[:, row] @ powers for row in chosen], axis=1) + names
            sought = pa.array([p[PRINT_BITS // 8 :].tobytes() for p in prints], pa.binary()).take(pa.array(np.repeat(np.arange(len(prints)), len(chosen))))
            columns = [pa.array(shards.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), len(chosen))), sought]
            yield pa.RecordBatch.from_arrays(columns, ["place", "node", "item"])

    members = nodes.select("node", "print").mapInArrow(named, "place long, node long, item binary")
    limit = max(shard_rows, count // HOT_PARTS)
    large = checkpoint(members.groupBy("place").agg(F.count("*").alias("size")).where(F.col("size") > limit))
    return links_by_place(members, large, near_links, shard_rows, limit)


def common_shingles(sets: list[np.ndarray], queries: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each query the number of shingles that it has in common with each of the sets; all are sorted and distinct."""
    held = np.concatenate(sets)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    for query in queries:
        left, right = held.searchsorted(query), held.searchsorted(query, "right")
        counts = right - left
        at = np.arange(counts.sum()) + np.repeat(left - counts.cumsum() + counts, counts)
        yield np.bincount(owner[at], minlength=len(sets))


def copy_links(own: list[tuple[int, bytes]], others: list[tuple[int, bytes]] | None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of (node, shingles) with a Jaccard similarity of COPY_JACCARD, or of those between the two sides.

    Each set meets blocks of others; a block has up to BLOCK shingles, or one set. Two empty sets are alike.
    """
    forest, out = _Forest(), []
    own, others = [None if side is None else [(node, np.frombuffer(shingles, np.uint64)) for node, shingles in side] for side in (own, others)]
    block = np.cumsum([len(x) for _, x in own]) // BLOCK
    for k in np.unique(block):
        begin, end = np.searchsorted(block, [k, k + 1]).tolist()
        nodes, sets = zip(*own[begin:end], strict=True)
        sizes, queries = np.array([len(x) for x in sets]), own[begin:] if others is None else others
        for (node, shingles), common in zip(queries, common_shingles(sets, [x for _, x in queries]), strict=True):
            for other in np.flatnonzero(common >= COPY_JACCARD * (sizes + len(shingles) - common)).tolist():
                if forest.join(nodes[other], node):
                    out.append((min(nodes[other], node), max(nodes[other], node)))
    return out


def _maybe_in(nodes: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits that has the bits of all nodes set; bounded, so it can travel with the tasks."""
    bit = F.pmod("node", F.lit(FILTER_BITS))
    found = nodes.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {FILTER_BITS}L) & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out


def copies(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each distinct text's group: node (its XXH64), component (a node), first (its first document, rows without id last).

    Texts whose five-word shingles have a Jaccard similarity of COPY_JACCARD or more are linked. Candidates are found by
    their SimHash in the BK-trees of shards (copy_candidates); whoever is reached by candidates is a cluster, and within a
    cluster all pairs are compared by their exact similarity, in chunks as the shards are. Shingles travel once for each
    chunk, and only those of clusters.
    """
    texts = id_and_text(docs).withColumn("node", F.xxhash64("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = [wide_print(shingle_set(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary())], ["doc_id", "node", "print"])

    member = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", F.col("node").alias("text_hash"))
    rows = texts.mapInArrow(printed, "doc_id long, node long, print binary")
    nodes = checkpoint(rows.groupBy("node").agg(F.min(member).alias("first"), F.min("print").alias("print")))
    near = components(copy_candidates(nodes, nodes.count(), shard_rows))
    clusters = checkpoint(near.unionByName(near.select(F.col("component").alias("node"), "component").distinct()))
    maybe = docs.sparkSession.sparkContext.broadcast(_maybe_in(clusters))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            bit = np.mod(batch.column(2).to_numpy(), FILTER_BITS)
            chosen = np.flatnonzero(maybe.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)
            sets = [shingle_set(batch.column(1)[k].as_py()).tobytes() for k in chosen.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(chosen)), pa.array(sets, pa.binary())], ["node", "shingles"])

    # repeated texts are merged on the map side
    sets = texts.mapInArrow(held, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))
    large = checkpoint(clusters.groupBy(F.col("component").alias("place")).agg(F.count("*").alias("size")).where(F.col("size") > shard_rows))
    members = clusters.withColumnRenamed("component", "place").join(sets.withColumnRenamed("shingles", "item"), "node")
    if not large.isEmpty():
        members = checkpoint(members)
    found = components(links_by_place(members, large, copy_links, shard_rows, shard_rows, turns=2))
    return nodes.select("node", "first").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents' rows, one of each group of near copies (see copies): the one with the smallest doc_id.

    Rows without doc_id come after all others. Rows that repeat id and text are one document; the least by a hash of all
    columns stays. They are merged before the one shuffle of texts, so a document that is repeated often is no hot key.
    """
    chosen = copies(docs).groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    names = [f"column {k}" for k in range(len(docs.columns))]
    column = dict(zip(docs.columns, names, strict=True))
    doc_id = F.col(column["doc_id"]).cast("long")
    # the id without nulls, so that grouping and join agree on the partitioning
    keys = {"without_id": doc_id.isNull(), "known_id": F.coalesce(doc_id, F.lit(0)), "text_hash": F.xxhash64(F.col(column["text"]).cast("string"))}
    documents = docs.toDF(*names).groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    chosen = chosen.select("without_id", F.coalesce("doc_id", F.lit(0)).alias("known_id"), "text_hash")
    # an inner join: a semi-join would be moved below the merging of repeated rows
    return documents.join(chosen, list(keys)).select("row.*").toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of the whole documents table; see the module for nulls, ties and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))
