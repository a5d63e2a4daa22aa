"""Operator 6: near-duplicate classes by an LSH forest of MinHash signatures, links confirmed on full shingle sets.

Documents with equal shingle sets are one node. TREES trees each read a node's signature of TREES * 4 MinHash values in an order of
their own. Nodes that agree in a tree's first `depth` values form a region; depth is chosen so that a pair at the threshold misses all
regions with a chance below 1e-6. A region of more than REGION nodes is split by the next value of its order, and so on, so depth
adapts to how dense it is; the member at the end of the heaviest branch (the region's likely original) and each member's neighbour
with the longest common prefix stay with every part. Regions of more than `most` nodes are range-partitioned by the next values of the
order and read in pieces, so none is held by one task. Within a part the signatures rank pairs; those that may reach the threshold
(estimate above it less 4.5 standard deviations) are linked as a spanning forest by falling estimate and confirmed exactly. Members
that confirmed links have not brought together come again, each with its 8, 64, ... best untried partners, until none is left. So pairs
within a class cost no more than its links; but pairs of different classes whose estimate stays above the bound (similarities of 0.64 to
0.8) are all confirmed, for nothing less tells them from links. Regions of more than `most` nodes give a spanning forest only. What
their members may still be linked with is found exactly: regions that share nodes are a family, its members are dealt to blocks by
the size of their sets, and each two blocks of sizes that can reach the threshold are compared pair by pair, the intersections
counted as a product of 0-1 matrices. Members of different families are joined on the rarest shingles of each set (prefix filter).

Defined results: texts without words, null included, have an empty set and are linked with nothing; so are rows without a doc_id, which
have no class (null) and are kept; fewer words than the shingle length are one shingle; rows that repeat a doc_id are one document's
versions and share a class; extra columns aren't read; an empty table gives an empty table. Shingles are compared by 64-bit hashes: among
10**12 distinct ones about 27,000 pairs share a hash, which moves a similarity by less than its share of one set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, skew, textnp
from .components import components

TREES, WIDTH = 32, 4
HASHES = TREES * WIDTH
REGION = 512
#: Largest list of documents (8 bytes each) that may be broadcast to choose rows of the documents.
BROADCAST_ROWS = 500_000
#: Shingles of a block of a family's sets (8 bytes each), a set counting as LIGHT at least, and columns of a matrix at a time.
BLOCK, LIGHT, COLUMNS = 1 << 19, 256, 2048
#: Shingles (8 bytes each) whose hashes are taken at a time.
CACHED = 1 << 15
_rng = np.random.default_rng(6)
FACTORS = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and their rows."""
    data, offsets = textnp.utf8(column)
    data = textnp.LOWER[data]
    starts, ends, rows = textnp.words(data, offsets, textnp.table("nonspace"))
    hashes = textnp.word_hashes(data, starts, ends)
    grams = textnp.gram_hashes(hashes, n)
    whole = rows[: len(grams)] == rows[n - 1 : n - 1 + len(grams)]
    keys, at = [grams[whole]], [rows[: len(grams)][whole]]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    for m in range(1, n):  # texts of m < n words
        short = np.flatnonzero(counts == m)
        if len(short):
            keys.append(textnp.gram_hashes(hashes, m)[first[short]])
            at.append(short)
    k, r = np.concatenate(keys), np.concatenate(at)
    if len(keys) > 1:
        order = np.argsort(r, kind="stable")
        k, r = k[order], r[order]
    edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])[: len(r)])
    stop = np.append(edge[1:], len(r))[: len(edge)]
    several = stop - edge > 1
    for a, b in zip(edge[several].tolist(), stop[several].tolist(), strict=True):  # each set in place: no order over all of them
        k[a:b].sort()
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return k[new], r[new]


def signatures(keys: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The MinHash values of the sets that begin at `edge`. A few sets at a time, so that their keys stay in the processor's cache while
    all hashes are taken; the smallest upper half is that of the smallest whole."""
    out = np.empty((len(edge), HASHES), np.uint32)
    stop = np.append(edge[1:], len(keys))
    at = 0
    while at < len(edge):
        to = max(at + 1, int(np.searchsorted(stop, edge[at] + CACHED, "right")))
        some, begin = keys[edge[at] : stop[to - 1]], edge[at:to] - edge[at]
        work = np.empty_like(some)
        for j in range(HASHES):
            np.bitwise_xor(some, MASKS[j], out=work)
            np.multiply(work, FACTORS[j], out=work)
            out[at:to, j] = np.minimum.reduceat(work, begin) >> np.uint64(32)
        at = to
    return out


def _signer(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch, "text", 2 << 20):
                keys, rows = shingles(part.column("text"), n)
                counts = np.bincount(rows, minlength=part.num_rows)
                full = np.flatnonzero(counts)
                edge = (np.cumsum(counts) - counts)[full]
                one, two = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                signs = np.zeros((len(full), HASHES), np.uint32)
                if len(full):
                    one[full] = np.add.reduceat(keys, edge).view(np.int64)
                    two[full] = np.bitwise_xor.reduceat(textnp.mix(keys), edge).view(np.int64)
                    signs[:] = signatures(keys, edge)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(one), pa.array(two), _rows(signs, counts > 0)],
                    ["doc_id", "n", "h1", "h2", "sig"],
                )

    return run


def _rows(signs: np.ndarray, full: np.ndarray) -> pa.Array:
    size = 4 * HASHES * full.astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(signs))])


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _keys(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = _signs(batch.column("sig"))
            keys, following = np.empty((TREES, len(signs)), np.uint64), np.empty((TREES, len(signs)), np.uint64)
            for t in range(TREES):
                h = np.full(len(signs), np.uint64(t + 1), np.uint64)
                for d in range(depth):
                    h = textnp.mix(h * textnp.PRIME + signs[:, (WIDTH * t + d) % HASHES])
                keys[t] = h
                a, b = (signs[:, (WIDTH * t + depth + k) % HASHES].astype(np.uint64) for k in (0, 1))
                following[t] = a << np.uint64(31) | b >> np.uint64(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.arange(TREES, dtype=np.int32), len(signs))), pa.array(np.tile(batch.column("node").to_numpy(), TREES)), pa.array(following.ravel().view(np.int64))], ["key", "tree", "node", "next"]
            )

    return run


def _parts(signs: np.ndarray, members: np.ndarray, tree: int, depth: int, most: int) -> Iterator[np.ndarray]:
    """Index sets of at most about `most` members that share ever longer prefixes of the tree's order."""
    if len(members) <= most or depth >= HASHES:
        for at in range(0, len(members), most):  # equal signatures through and through: runs that share a member
            yield members[max(0, at - 1) : at + most]
        return
    column = signs[members, (WIDTH * tree + depth) % HASHES]
    values, inverse, counts = np.unique(column, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    heavy = int(np.argmax(counts))
    hub = _heaviest(signs, members[inverse == heavy], tree, depth + 1)
    loose: list[int] = []
    for value, group in enumerate(np.split(members[order], np.cumsum(counts)[:-1])):
        if len(group) == 1:
            loose.append(int(group[0]))
        else:
            yield from _parts(signs, group, tree, depth + 1, most)
        if value != heavy and len(group) > 1:
            for at in range(0, len(group), most - 1):
                yield np.concatenate([[hub], group[at : at + most - 1]])
    for at in range(0, len(loose), most - 1):
        yield np.unique(np.concatenate([[hub], loose[at : at + most - 1]]))


def _heaviest(signs: np.ndarray, members: np.ndarray, tree: int, depth: int) -> int:
    """The member reached by always taking the branch with most members."""
    while len(members) > 1 and depth < HASHES:
        column = signs[members, (WIDTH * tree + depth) % HASHES]
        values, counts = np.unique(column, return_counts=True)
        members = members[column == values[np.argmax(counts)]]
        depth += 1
    return int(members[0])


def _agreement(signs: np.ndarray) -> np.ndarray:
    out = np.empty((len(signs), len(signs)), np.int16)
    for i in range(0, len(signs), 64):
        out[i : i + 64] = (signs[i : i + 64, None, :] == signs[None, :, :]).sum(2)
    return out


def _spanning(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A maximum spanning forest of the pairs that agree in at least `least` places (Prim)."""
    n = len(same)
    best, source, out = same[0].copy(), np.zeros(n, np.int64), []
    best[0] = -1
    todo = np.ones(n, bool)
    todo[0] = False
    for _ in range(n - 1):
        i = int(np.argmax(np.where(todo, best, -1)))
        if best[i] >= least:
            out.append((int(source[i]), i))
        todo[i] = False
        closer = todo & (same[i] > best)
        best[closer], source[closer] = same[i][closer], i
    return out


def _candidates(depth: int, least: int, quota: int, most: int, pieces: int = 16):
    """Pairs to confirm in each region (rows sorted by key and the order's next values). quota 0: spanning forests; else each member's
    `quota` best partners of other classes. Of one region, pieces of `pieces * most` consecutive rows are held at most."""

    def region(tree: int, nodes: np.ndarray, comps: np.ndarray, signs: np.ndarray, out: list) -> None:
        for part in _parts(signs, np.arange(len(nodes)), tree, depth, most):
            if len(part) < 2 or (quota and (comps[part] == comps[part[0]]).all()):
                continue
            same = _agreement(signs[part])
            if not quota:
                for i, j in _spanning(same, least):
                    out.append((int(nodes[part[i]]), int(nodes[part[j]]), False))
                continue
            open_ = (same >= least) & (comps[part][:, None] != comps[part][None, :])
            for i in np.flatnonzero(open_.any(1)):
                others = np.flatnonzero(open_[i])
                more = len(others) > quota
                for j in others[np.argsort(-same[i][others], kind="stable")][:quota]:
                    out.append((int(nodes[part[i]]), int(nodes[part[j]]), bool(more)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            keys, trees, nodes, comps = (table.column(c).to_numpy() for c in ("key", "tree", "node", "comp"))
            signs = _signs(table.column("sig").combine_chunks())
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            stop = np.append(edge[1:], len(keys))
            out: list[tuple[int, int, bool]] = []
            twos = edge[stop - edge == 2]
            if len(twos):  # most regions are of two
                hit = twos[((signs[twos] == signs[twos + 1]).sum(1) >= least) & ((comps[twos] != comps[twos + 1]) | (quota == 0))]
                out += zip(nodes[hit].tolist(), nodes[hit + 1].tolist(), [False] * len(hit), strict=True)
            for a, b in zip(edge.tolist(), stop.tolist(), strict=True):
                if b - a > 2:
                    region(int(trees[a]), nodes[a:b], comps[a:b], signs[a:b], out)
            a, b, more = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(more)], ["a", "b", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column("key")[0] == batch.column("key")[-1]:
                if sum(x.num_rows for x in held) >= pieces * most:  # a piece of a large region
                    yield emit(pa.Table.from_batches(held).combine_chunks())
                    held = []
                continue  # one region so far
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield emit(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch, "text"):
                keys, rows = shingles(part.column("text"), n)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))], ["node", "shingles"])

    return run


def _full_sets(given: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the wanted nodes."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = given.withColumnRenamed("doc_id", "node").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    return scratch.saved(chosen.mapInArrow(_sets(n), "node long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, near), told by the full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return scratch.saved(both.select("a", "b", (100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).alias("near")), "judged")


def _families(wide: DataFrame) -> DataFrame:
    """(node, family) of the nodes of wide regions (key, node); regions that share a node are of one family."""
    hubs = wide.groupBy("key").agg(F.min("node").alias("b"))
    return components(skew.lookup(wide, hubs, ["key"], F.col("node")).select(F.col("node").alias("a"), "b")).withColumnRenamed("comp", "family")


def _matrix(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes, classes, set sizes, and row and shingle of each entry."""
    lists = pa.concat_arrays(table.column("shingles").chunks)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return table.column("node").to_numpy(), table.column("comp").to_numpy(), counts, np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy()


def _intersections(shape: tuple[int, int], rows_a: np.ndarray, a: np.ndarray, rows_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each set of one block shares with each of the other."""
    out = np.zeros(shape, np.int64)
    shared = np.intersect1d(a, b)
    sides = []
    for rows, keys in ((rows_a, a), (rows_b, b)):
        at = np.searchsorted(shared, keys)
        has = np.flatnonzero(at < len(shared))
        has = has[shared[at[has]] == keys[has]]
        has = has[np.argsort(at[has], kind="stable")]
        sides.append((rows[has], at[has]))
    for begin in range(0, len(shared), COLUMNS):
        pair = []
        for height, (rows, at) in zip(shape, sides, strict=True):
            lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
            dense = np.zeros((height, min(COLUMNS, len(shared) - begin)), np.float32)
            dense[rows[lo:hi], at[lo:hi] - begin] = 1
            pair.append(dense)
        out += np.rint(pair[0] @ pair[1].T).astype(np.int64)
    return out


def _compared(percent: int):
    """Of two blocks: a pair at the threshold for each two classes that have one."""

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        (a, ca, na, ra, ka), (b, cb, nb, rb, kb) = _matrix(one), _matrix(two)
        inter = _intersections((len(a), len(b)), ra, ka, rb, kb)
        i, j = np.nonzero((100 * inter >= percent * (na[:, None] + nb[None, :] - inter)) & (ca[:, None] != cb[None, :]))
        lo, hi = np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])
        by = np.lexsort((hi, lo))
        new = np.ones(len(by), bool)
        new[1:] = (lo[by[1:]] != lo[by[:-1]]) | (hi[by[1:]] != hi[by[:-1]])
        x, y = a[i[by[new]]], b[j[by[new]]]
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    return run


def _family_links(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the classes within each family (node, comp, family): at least one for each two classes that have any."""
    sized = sets.select("node", F.size("shingles").cast("long").alias("n")).join(members, "node").withColumn("load", F.greatest("n", F.lit(LIGHT).cast("long")))
    placed = skew.running_sum(sized, ["family"], ["n", "node"], "load", "before", "placed").select("node", "n", "comp", "family", F.expr(f"before div {BLOCK}").alias("block"))
    placed = scratch.saved(placed, "placed")
    spans = placed.groupBy("family", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("least"), F.max("comp").alias("last"))
    one, two = (spans.select("family", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "lo", "hi", "least", "last"))) for side in "ij")
    # blocks hold sets of rising size
    pairs = one.join(two, "family").where(f"block_i <= block_j and 100 * hi_i >= {percent} * lo_j and not (least_i = last_i and least_j = last_j and least_i = least_j)")
    pairs = scratch.saved(pairs.select("family", "block_i", "block_j"), "blocks")
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    full = scratch.saved(placed.select("node", "comp", "family", "block").join(sets, "node"), "full")
    sides = []
    for side in "ij":
        rows = full.withColumnRenamed("block", f"block_{side}").join(F.broadcast(pairs) if few else pairs, ["family", f"block_{side}"])
        # columns of their own, for both sides are of one table
        sides.append(rows.select(*(F.col(c).alias(c) for c in ("family", "block_i", "block_j", "node", "comp", "shingles"))).groupBy("family", "block_i", "block_j"))
    return scratch.saved(sides[0].cogroup(sides[1]).applyInArrow(_compared(percent), "a long, b long"), "found")


def _prefix_pairs(sets: DataFrame, members: DataFrame, percent: int, most: int) -> DataFrame:
    """All pairs (a, b) of different classes and families that may reach the threshold.

    Sets of x and y shingles at the threshold share percent % of the larger one at least, so, with all shingles in one order, they share
    one of the first x - ceil(percent % of x) + 1 and y - ceil(percent % of y) + 1. The order is the rarest first.
    """
    items = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("g"))
    counts = scratch.saved(items.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    ranked = skew.lookup(items, counts, ["g"], F.col("node")).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "g"))).alias("gs"))
    first = F.slice("gs", F.lit(1), F.expr(f"int(n - ({percent} * n + 99) div 100 + 1)"))
    posts = ranked.select("node", "n", F.explode(first).alias("x")).select("node", "n", "x.g", "x.c").where("c > 1").join(members, "node")
    posts = scratch.saved(posts, "posts")
    across = posts.groupBy("g").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("g", F.lit(True).alias("across"))
    posts = scratch.saved(skew.lookup(posts, across, ["g"], F.col("node")).where("across").drop("across"), "posts")
    # lists of more than `most` nodes are spread over tasks
    last = F.when(F.col("c") > most, F.lit(skew.SALTS - 1)).otherwise(F.lit(0))
    one = posts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("family").alias("fa"), "g", F.pmod(F.xxhash64("node"), last + 1).cast("int").alias("salt"))
    two = posts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("family").alias("fb"), "g", F.explode(F.sequence(F.lit(0), last)).alias("salt"))
    joined = one.join(two.hint("merge"), ["g", "salt"]).where("a < b and ca <> cb and fa <> fb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.select("a", "b").distinct()


def _crowded(regions: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of regions (key, ...) of 2 to `most` rows, and those of larger ones. Counted before they are moved, and the larger ones
    are taken out first, so no region's rows meet in one task."""
    counts = scratch.saved(regions.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "counts")
    large = scratch.saved(counts.where(F.col("size") > most).select("key", F.lit(True).alias("large")), "large")
    small = counts.where(F.col("size") <= most).select("key")
    if large.isEmpty():
        return scratch.saved(regions.join(small, "key", "left_semi"), "regions"), regions.limit(0)
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = regions.join(F.broadcast(large), "key", "left") if few else skew.lookup(regions, large, ["key"], F.col("node"))
    marked = marked if few else scratch.saved(marked, "marked")
    return scratch.saved(marked.where("large is null").drop("large").join(small, "key", "left_semi"), "regions"), scratch.saved(marked.where("large").drop("large"), "wide")


def depth_for(percent: int) -> int:
    """The deepest prefix at which a pair at the threshold misses all trees with a chance below 1e-6."""
    s = percent / 100
    return max([d for d in range(1, 17) if TREES * math.log1p(-min(s**d, 1 - 1e-12)) < math.log(1e-6)], default=1)


def classes(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", most: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    scratch.ship(spark)
    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    signed = scratch.saved(given.mapInArrow(_signer(n), "doc_id long, n long, h1 long, h2 long, sig binary"), "signed")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    copies = signed.where(linkable).groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    known = skew.lookup(signed, copies, ["n", "h1", "h2"], F.col("doc_id")).select("doc_id", "n", F.when(linkable, F.coalesce("first", "doc_id")).alias("node"), "sig")
    known = scratch.saved(known, "nodes")
    nodes = known.where("node = doc_id").groupBy("node").agg(F.max("sig").alias("sig"))
    depth = depth_for(percent)
    share = percent / 100
    least = math.floor(HASHES * (share - 4.5 * math.sqrt(share * (1 - share) / HASHES)))
    regions = nodes.mapInArrow(_keys(depth), "key long, tree int, node long, next long")
    crowded, wide = _crowded(scratch.saved(regions, "keys"), most)
    scratch.tidy(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signs = nodes.join(crowded.select("node").unionByName(wide.select("node")).distinct(), "node", "left_semi")
    signs = scratch.saved(signs, "signs")
    linked: DataFrame | None = None
    tried: DataFrame | None = None
    sets: DataFrame | None = None
    labels: DataFrame | None = None
    quota = 0
    any_wide = not wide.isEmpty()
    while True:
        found = []
        for table, large in ((crowded, False), (wide, True)):
            if large and (quota or not any_wide):  # what their spanning forests leave open is told by blocks
                continue
            if labels is not None:
                rows = table.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
                mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
                rows = rows.join(mixed, "key", "left_semi")
            else:
                rows = table.withColumn("comp", F.col("node"))
            rows = rows.join(signs, "node").select("key", "tree", "node", "comp", "sig", "next")
            # a large region spreads over as many tasks as it needs
            rows = rows.repartitionByRange(parts, "key", "next", "node") if large else rows.repartition(parts, "key")
            found.append(rows.sortWithinPartitions("key", "next", "node").drop("next").mapInArrow(_candidates(depth, least, quota, most), "a long, b long, more boolean"))
        pairs = scratch.saved(reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("more").alias("more")), "pairs")
        new = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        new = scratch.saved(new, "new")
        more = not new.isEmpty()
        if more:
            if sets is None:
                wanted = scratch.saved(new.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
                sets = _full_sets(given, wanted, n)
            judged = _confirmed(new, sets, percent)
            tried = judged.select("a", "b") if tried is None else scratch.saved(tried.unionByName(judged.select("a", "b")), "tried")
            near = judged.where("near").select("a", "b")
            linked = near if linked is None else linked.unionByName(near)
            labels = components(linked)
            scratch.tidy(spark)
        elif labels is None or pairs.where("more").isEmpty():
            break
        quota = 8 if not quota else quota * 8
    if any_wide:
        if labels is not None:
            wide = skew.lookup(wide, labels, ["node"], F.col("key"))
        else:
            wide = wide.withColumn("comp", F.lit(None).cast("long"))
        wide = scratch.saved(wide.withColumn("comp", F.coalesce("comp", "node")), "wide")
        mixed = wide.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        wide = scratch.saved(wide.join(mixed, "key", "left_semi").select("key", "node", "comp"), "wide")
        if not wide.isEmpty():
            members = scratch.saved(wide.select("node", "comp").distinct().join(_families(wide), "node"), "members")
            sets = _full_sets(given, members.select("node"), n)
            near = _family_links(sets, members, percent)
            if members.select("family").distinct().limit(2).count() > 1:
                pairs = _prefix_pairs(sets, members, percent, most)
                new = scratch.saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "new")
                near = near.unionByName(_confirmed(new, sets, percent).where("near").select("a", "b"))
            if not near.isEmpty():
                linked = near if linked is None else linked.unionByName(near)
                labels = components(linked)
        scratch.tidy(spark)
    out = known.drop("sig")
    if labels is not None:
        out = skew.lookup(out, labels, ["node"], F.col("doc_id"))
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    component = F.coalesce("comp", "node", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
