"""SimHash near-dedup with sharded BK-trees (op1 and the pipeline's second stage).

Distinct fingerprints are dealt into shards; each shard is a BK-tree whose children are keyed by their integer Hamming
distance to the parent, and a query follows only edges within the radius of its own distance. Trees are built and searched
level by level for all shards of a block at once in numpy.

Shards of the 64-bit fingerprint are exact: of BLOCKS blocks of bits, `radius` differing bits leave at least BLOCKS - radius
blocks untouched, so two linked fingerprints share one of the shards that name BLOCKS - radius blocks. Trees are not broadcast: they grow
with the data. A shard holds distinct fingerprints only, so copies never weigh on it, and it gives back a spanning
forest of its links rather than all pairs.

The pipeline's stage takes distinct sets of shingles instead. Its 256-bit fingerprints, of each shingle once, only find
clusters of candidates, within a radius that pairs of similarity 0.8 hardly leave; each link is then verified by the exact
Jaccard similarity of the two sets. Each set is first verified with one near it, mostly its group's centre. The classes that
are left apart within a cluster then meet block by block, and only links that join two classes are given back.

Defined results: null or blank text has fingerprint 0 and links like any other; repeated rows link to each other; a null
doc_id takes part and is never the smallest id of a component that has another; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import graph, shared
from relictum.llm.windows import mix

SHINGLE, RADIUS, BLOCKS, SEED = 4, 4, 7, 42
#: The pipeline's stage: 5-word shingles, 256 bits. Sets of Jaccard similarity 0.8 differ in 39 of the bits, give or take 6.
STAGE_SHINGLE, STAGE_WORDS, STAGE_RADIUS = 5, 4, 60
#: Two documents are near-duplicates from this Jaccard similarity on, in fifths.
FIFTHS = 4
#: Shards of the 256-bit fingerprint: TABLES times BITS bits drawn at random. A pair of similarity 0.8 is within the radius
#: and meets in a shard with 0.996 (binomial model).
TABLES, BITS = 128, 16
#: Groups of so many items get a pivot in their middle.
MANY = 8
#: Pairs of query and node that a search holds at once.
FRONTIER = 4_000_000
#: Sets and shingles of a block, of which two are compared at once.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 200_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashes(text: str | bytes | None, shingle: int) -> np.ndarray:
    """One hash for each shingle of a text, repeats included; of a shorter text, for all of it."""
    raw = text.encode() if isinstance(text, str) else text or b""
    raw = b" ".join(raw.translate(LOWER).split())  # bytes split at 0x20 and 0x09-0x0D
    if not raw:
        return np.zeros(0, np.uint64)
    gap = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    start, end = [0, *(gap + 1).tolist()], [*gap.tolist(), len(raw)]
    spans = zip(start, end[shingle - 1 :]) if len(start) >= shingle else ((0, len(raw)),)
    one = xxhash.xxh64_intdigest
    return np.array([one(raw[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """`words` unsigned 64-bit numbers; a bit is set if it is in over half of the shingles' hashes, repeats included."""
    return majority(hashes(text, shingle), words)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    for w in range(words if len(h) else 0):
        own = h if w == 0 else mix(h + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 16):
            ones += np.unpackbits(own[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(ones * 2 > len(own), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """docs(doc_id, text, rid) -> doc_id, rid, f0 .. f(words-1), node: a fingerprint's name, itself if it has one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.stack([fingerprint(x.as_py(), shingle, words) for x in batch.column(2)] or [np.zeros(words, np.uint64)])[: batch.num_rows].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(made[:, w]) for w in range(words))], names=["doc_id", "rid", *(f"f{w}" for w in range(words))])

    fields = ", ".join(f"f{w} long" for w in range(words))
    rows = docs.select(F.col("doc_id").cast("long"), "rid", "text").mapInArrow(run, f"doc_id long, rid long, {fields}")
    return rows.withColumn("node", F.col("f0") if words == 1 else F.xxhash64(*(f"f{w}" for w in range(words))))


def shingle_sets(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """docs(doc_id, text, rid) -> doc_id, rid, f0 .. f(words-1), n: number of distinct shingles, node: the set's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(hashes(x.as_py(), shingle)) for x in batch.column(2)]
            made = np.stack([majority(h, words) for h in own] or [np.zeros(words, np.uint64)])[: batch.num_rows].view(np.int64)
            name = [xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) for h in own]
            columns = [batch.column(0), batch.column(1), *(pa.array(made[:, w]) for w in range(words)), pa.array([len(h) for h in own], pa.int32()), pa.array(name, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", *(f"f{w}" for w in range(words)), "n", "node"])

    fields = ", ".join(f"f{w} long" for w in range(words))
    return docs.select(F.col("doc_id").cast("long"), "rid", "text").mapInArrow(run, f"doc_id long, rid long, {fields}, n int, node long")


def masks(words: int) -> list[list[int]]:
    """For each shard family, the bits that must agree, a mask for each fingerprint word."""
    if words == 1:
        edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
        block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
        return [[sum(x)] for x in combinations(block, BLOCKS - RADIUS)]
    rng = np.random.default_rng(7)
    out = []
    for _ in range(TABLES):
        bits = rng.choice(64 * words, BITS, replace=False)
        out.append([sum(1 << int(b % 64) for b in bits if b // 64 == w) for w in range(words)])
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(group: np.ndarray, items: np.ndarray, radius: int) -> np.ndarray:
    """BK-trees over the items of each group; the smallest item of each linked set, by item."""
    return searched(group, items, radius)[0]


def searched(group: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over the items of each group (equal numbers, together): the smallest item of each set that links of at most
    `radius` bits connect, by item; for each item an item within the radius, itself if there is none or it was not asked; and
    whether that is its group's pivot.

    group: shard of each item. items: (n, words) fingerprints.

    What lies within the radius of its group's pivot, the item nearest to the bitwise majority, is one set without a search.
    Any other item asks the tree, unless an earlier answer has joined it to the pivot's set by then: a link between that set
    and an item outside is found from outside."""
    n = len(group)
    lead = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(lead)
    sizes = np.diff(np.append(first, n))
    root = np.repeat(first, sizes)
    distance = lambda a, b: np.bitwise_count(items[a] ^ items[b]).sum(1, dtype=np.int64)
    pivot = pivots(items, first, sizes)[np.cumsum(lead) - 1]
    every = np.arange(n)
    near = np.where(distance(every, pivot) <= radius, pivot, every)
    label, covered = unite(every.copy(), every, near), near != every
    ask = np.flatnonzero((near == every) & (pivot != every))
    if not len(ask):
        return label, near, covered
    # Build: every item goes down from its root; the first of each (node, distance) becomes the child.
    parents, gaps, children = [], [], []
    live = np.flatnonzero(~lead & np.isin(group, group[ask]))
    at = root[live]
    while len(live):
        d = distance(live, at)
        code = at * 512 + d
        _, found, inverse = np.unique(code, return_index=True, return_inverse=True)
        child = live[found]
        parents.append(at[found])
        gaps.append(d[found])
        children.append(child)
        rest = np.ones(len(live), bool)
        rest[found] = False
        at, live = child[inverse][rest], live[rest]
    parent, gap, child = map(np.concatenate, (parents, gaps, children))
    order = np.lexsort((gap, parent))
    code, child = (parent * 512 + gap)[order], child[order]
    # Search: pairs (query, node), in blocks of queries that keep the frontier bounded; small groups share a block.
    weight = np.cumsum(np.repeat(sizes, sizes)[ask])
    low = 0
    while low < len(ask):
        high = max(low + 1, int(np.searchsorted(weight, (weight[low - 1] if low else 0) + FRONTIER, "right")))
        query = ask[low:high]
        query = query[label[query] != label[pivot[query]]]
        low = high
        node = root[query]
        while len(query):
            d = distance(query, node)
            hit = (d <= radius) & (node != query)
            label = unite(label, query[hit], node[hit])
            near[query[hit]] = node[hit]
            a = np.searchsorted(code, node * 512 + np.maximum(d - radius, 0))
            b = np.searchsorted(code, node * 512 + np.minimum(d + radius, 511), "right")
            count = b - a
            query = np.repeat(query, count)
            node = child[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    return label, near, covered


def pivots(items: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An item of each group: the nearest to the bitwise majority of a group of MANY or more, the first of a smaller one."""
    out = first.copy()
    large = np.flatnonzero(sizes >= MANY)
    if not len(large):
        return out
    rows = np.flatnonzero(np.repeat(sizes >= MANY, sizes))
    size = sizes[large]
    which = np.repeat(np.arange(len(large)), size)
    ones = np.zeros((len(large), 64 * items.shape[1]), np.int32)
    step = max(1, 4_000_000 // ones.shape[1])
    for low in range(0, len(rows), step):
        own = np.unpackbits(np.ascontiguousarray(items[rows[low : low + step]]).view(np.uint8), axis=1, bitorder="little")
        at = np.flatnonzero(np.diff(which[low : low + step], prepend=-1))
        ones[which[low : low + step][at]] += np.add.reduceat(own, at, axis=0, dtype=np.int32)
    most = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).reshape(len(large), -1)
    away = np.bitwise_count(items[rows] ^ most[which]).sum(1, dtype=np.int64)
    out[large] = rows[np.lexsort((away, which))[np.cumsum(size) - size]]
    return out


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def links(distinct: DataFrame, words: int, radius: int) -> DataFrame:
    """distinct(node, f0..) -> links(a, b, d): of each shard, links that connect what the radius connects, and for each node a that
    has one a node b within the radius, with their distance d; else d is null. A node is at most twice an a in each family of shards."""
    names = [f"f{w}" for w in range(words)]
    shards = F.array(*[F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(signed(m)).cast("long")) for c, m in zip(names, mask) if m]) for i, mask in enumerate(masks(words))])
    dealt = distinct.select(F.explode(shards).alias("shard"), "node", *names).repartition("shard").sortWithinPartitions("shard", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
            size += len(held[-1])
            if size > 200_000 and held[-1][-1, 0] != held[0][0, 0]:
                rows = np.concatenate(held)
                last = int(np.searchsorted(rows[:, 0] == rows[-1, 0], True))
                yield from edges(rows[:last])
                held, size = [rows[last:]], len(rows) - last
        if held:
            yield from edges(np.concatenate(held))

    def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = rows[1:, 0] == rows[:-1, 0]
        rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if len(rows):
            items = np.ascontiguousarray(rows[:, 2 : 2 + words]).view(np.uint64)
            label, near, covered = searched(rows[:, 0], items, radius)
            every, node = np.arange(len(rows)), rows[:, 1]
            # An item near the pivot needs no other link: the pivot has one to the label.
            plain = np.flatnonzero((label != every) & (label != near) & ~covered)
            close = np.flatnonzero(near != every)
            if len(plain) + len(close):
                a, b = np.concatenate([node[plain], node[close]]), np.concatenate([node[label[plain]], node[near[close]]])
                away = np.bitwise_count(items[close] ^ items[near[close]]).sum(1, dtype=np.int64)
                d = pa.array(np.concatenate([np.zeros(len(plain), np.int64), away]).astype(np.int32), mask=np.arange(len(a)) < len(plain))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), d], names=["a", "b", "d"])

    return dealt.mapInArrow(run, "a long, b long, d int")


def thinned(found: DataFrame) -> DataFrame:
    """links(a, b) -> fewer edges(a, b) that connect the same: each node and all that it links to, with the smallest of these."""
    rows = found.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("every"))
    return rows.select("m", F.explode(F.array_union("every", F.array("a"))).alias("a")).where("a <> m").select("a", F.col("m").alias("b")).distinct()


def enough(common, one, two):
    """Whether sets of these sizes, with so many in common, have the similarity."""
    return (5 + FIFTHS) * common >= FIFTHS * (one + two)


def own_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """wanted(node, rid) -> node, own: the set of shingles, sorted, from the row of docs(rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(hashes(x.as_py(), shingle)).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])

    rows = docs.select("rid", "text").join(wanted, "rid").select("node", "text").mapInArrow(run, "node long, own array<long>")
    return shared.table(rows.dropDuplicates(["node"]), "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets(node, own) have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return both.where(enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def blocks(items: DataFrame) -> DataFrame:
    """items(node, cluster, root, n) of clusters of several classes -> node, cluster, block, bin: blocks of about BLOCK_ROWS sets and
    BLOCK_SHINGLES shingles. A block holds sets of one bin of sizes, and either whole small classes or a part of a large one."""
    binned = items.withColumn("bin", F.floor(F.log2(F.greatest("n", F.lit(1))) / np.log2(5 / FIFTHS)).cast("int"))
    parts = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum(F.col("n").cast("long")) / F.lit(BLOCK_SHINGLES))).cast("int")
    own = shared.table(binned.groupBy("cluster", "bin", "root").agg(parts().alias("parts"), F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("s")), "class-sizes")
    rest = own.where("parts = 1").groupBy("cluster", "bin").agg(F.ceil(F.greatest(F.sum("c") / F.lit(BLOCK_ROWS), F.sum("s") / F.lit(BLOCK_SHINGLES))).cast("int").alias("small"))
    known = shared.table(own.join(rest, ["cluster", "bin"], "left").select("cluster", "bin", "root", "parts", "small"), "class-parts")
    block = F.when(F.col("parts") > 1, F.xxhash64("cluster", "bin", "root", F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.xxhash64("cluster", "bin", F.pmod(F.xxhash64("root"), "small")))
    return binned.join(known, ["cluster", "bin", "root"]).select("node", "root", "cluster", "bin", block.alias("block"), F.when(F.col("parts") > 1, F.col("root")).alias("whole"))


def across(items: DataFrame, sets: DataFrame, words: int, radius: int) -> DataFrame:
    """items(node, f0.., n, cluster, root) of clusters of several classes -> edges(a, b): links between classes, each verified on the
    sets(node, own), enough of them to connect all classes that any link connects.

    Every two blocks of a cluster whose sizes and classes allow a link meet once, so that no cluster is ever one task."""
    names = [f"f{w}" for w in range(words)]
    dealt = shared.table(blocks(items), "blocks")
    one = dealt.select("cluster", "bin", "block", "whole").distinct()
    two = one.select("cluster", F.col("bin").alias("bin2"), F.col("block").alias("block2"), F.col("whole").alias("whole2"))
    met = one.join(two, "cluster").where("abs(bin - bin2) <= 1 and block <= block2 and not (whole is not null and whole <=> whole2)")
    met = shared.table(met.select(F.xxhash64("block", "block2").alias("pair"), "block", "block2"), "block-pairs")
    sides = met.select("pair", "block", F.lit(0).alias("side")).unionByName(met.where("block <> block2").select("pair", F.col("block2").alias("block"), F.lit(1).alias("side")))
    full = items.select("node", "root", *names).join(dealt.select("node", "block"), "node").join(sets, "node")
    rows = full.join(sides, "block").select("pair", "side", "node", "root", *names, "own").repartition("pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            pair = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for low, high in zip(cuts, cuts[1:]):
                if held and high > low and held[-1].column(0)[0] != batch.column(0)[low]:
                    yield from linked(held)
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            yield from linked(held)

    def linked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        side, node, root = column("side"), column("node"), column("root")
        prints = np.stack([column(c) for c in names], 1).view(np.uint64)
        lists = table.column("own").combine_chunks()
        a, b = meeting(side, root, prints, lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def meeting(side: np.ndarray, root: np.ndarray, prints: np.ndarray, sizes: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between items of two classes, by number: those of side 0 with those of side 1, or all if there is one side.

    A link is within the radius and has the similarity; those that join nothing new are left out."""
    m = len(side)
    both = side.max() > side.min()
    at = np.cumsum(sizes) - sizes
    # A shingle that two sets share is a bit; what no two share counts in the sizes alone.
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    bit = np.full(len(values), -1)
    bit[order] = np.where(often, np.cumsum(np.concatenate([[True], ~same])) - 1, -1)
    used, bit_of = np.unique(bit[bit >= 0], return_inverse=True)
    bits = np.zeros((m, max(1, -(-len(used) // 64))), np.uint64)
    owner = np.repeat(np.arange(m), sizes)[bit >= 0]
    np.bitwise_or.at(bits, (owner, bit_of >> 6), np.uint64(1) << (bit_of & 63).astype(np.uint64))
    label = np.unique(root, return_inverse=True)[1].astype(np.int64)
    label = np.array([np.flatnonzero(label == x)[0] for x in range(label.max() + 1)])[label] if m else label
    found: list[tuple[int, int]] = []
    step = max(1, 2_000_000 // bits.shape[1])
    del at
    for i in range(m):
        if both and side[i] == 1:
            continue
        others = np.flatnonzero(side == 1) if both else np.arange(i + 1, m)
        others = others[label[others] != label[i]]
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[5 * low >= FIFTHS * high]
        others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(1, dtype=np.int64) <= radius]
        for k in range(0, len(others), step):
            own = others[k : k + step]
            own = own[enough(np.bitwise_count(bits[own] & bits[i]).sum(1, dtype=np.int64), sizes[own], sizes[i])]
            for j in own.tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((i, j))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return a, b


def similar(docs: DataFrame, shingle: int, words: int, radius: int) -> DataFrame:
    """As `classes`, of links verified by exact similarity."""
    docs = docs.withColumn("rid", shared.row_id())
    prints = shared.table(shingle_sets(docs, shingle, words), "prints")
    names = [f"f{w}" for w in range(words)]
    distinct = shared.table(prints.groupBy("node", *names, "n").agg(F.min("rid").alias("rid")), "distinct")
    found = shared.table(links(distinct, words, radius), "links")
    clusters = shared.table(graph.components(thinned(found)), "clusters")
    sets = own_sets(docs, clusters.select("node").join(distinct.select("node", "rid"), "node"), shingle)
    # First each set with the nearest one known, mostly its group's centre; then what is left apart within each cluster.
    nearest = found.where("d is not null").groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    first = shared.table(verified(nearest, sets), "first")
    roots = shared.table(graph.components(first), "roots")
    placed = clusters.withColumnRenamed("root", "cluster").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = shared.table(distinct.drop("rid").join(placed, "node"), "placed")
    several = placed.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cluster")
    more = across(placed.join(several, "cluster"), sets, words, radius)
    found = shared.table(graph.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "components")
    return prints.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame, shingle: int = SHINGLE, words: int = 1, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, rid, f0.., node, root: rows of one root are near-duplicates of each other."""
    prints = shared.table(fingerprints(docs.withColumn("rid", shared.row_id()), shingle, words), "prints")
    distinct = prints.select("node", *[f"f{w}" for w in range(words)]).distinct()
    found = shared.table(graph.components(thinned(links(distinct, words, radius))), "components")
    return prints.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def dedup(docs: DataFrame, shingle: int = STAGE_SHINGLE, words: int = STAGE_WORDS, radius: int = STAGE_RADIUS) -> DataFrame:
    """The operator: one document of each class stays, that of the smallest doc_id; of equal rows, one. Same columns."""
    kept = similar(docs, shingle, words, radius).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("one"))
    rid = shared.free(docs, "rid_")
    keyed = docs.withColumn(rid, shared.row_id())
    return keyed.join(shared.table(kept.select(F.col("one.rid").alias(rid)), "kept"), rid, "left_semi").dropDuplicates([rid]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(classes(shared.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "f0", "root"), "classes")
    least = shared.table(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
