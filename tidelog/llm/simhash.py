"""SimHash near-duplicates: fingerprints sharded by a vantage-point tree, exact pairs, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, shuffle_partitions

SEED = 42
#: Fingerprints that one leaf of the tree should be home to, and those its upper part is fitted on.
LEAF_ROWS, SAMPLE = 8192, 1 << 16
#: Sampled fingerprints behind a leaf, and leaves at most: the tree is broadcast, at 19 bytes a node.
LEAF_SAMPLE, MOST_LEAVES = 16, 1 << 21
#: Entries of a leaf that one task compares at most; a fuller leaf is dealt into tiles.
HOME_ROWS, GUEST_ROWS = 1 << 14, 1 << 16
#: Vantage points tried at each node.
TRIED = 24
#: Rows compared at once with as many others.
CHUNK, TILE = 64, 1 << 14


# --- fingerprints ---------------------------------------------------------------------------


def normal_words(text: bytes) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased."""
    return text.translate(LOWER).split()


def shingle_hashes(found: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of `width` words joined by spaces; of all words if there are fewer; none without words."""
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of each document's word shingles as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(shingle_hashes(normal_words(t.as_buffer().to_pybytes()), width)) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


# --- the vantage-point tree -----------------------------------------------------------------


def distances(points: np.ndarray, to: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


class VantageTree:
    """Nodes (vantage point, radius, inner child, outer child); a child below 0 is the leaf -1 - child.

    Tasks get it as arrays(), which need no class of this package where they are unpacked.
    """

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 1):
        self.points: list[int] = []
        self.radii: list[int] = []
        self.children: list[list[int]] = []
        self.leaves, self.radius = 0, radius
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(1, math.ceil(len(sample) / max(1, leaves))), rng)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray, most: int, rng: np.random.Generator) -> int:
        if len(sample) <= most or len(sample) < 8:
            return self._leaf()
        best = None
        for vantage in rng.choice(sample, min(TRIED, len(sample)), replace=False):
            d = np.sort(distances(sample, vantage))
            for mu in set(np.quantile(d, (0.4, 0.5, 0.6), method="lower").tolist()):
                inner = int(np.searchsorted(d, mu, "right"))
                if not 0.2 <= inner / len(d) <= 0.8:
                    continue
                near = int(np.searchsorted(d, mu + self.radius, "right") - np.searchsorted(d, mu - self.radius, "right"))
                if best is None or near < best[0]:
                    best = (near, int(vantage), int(mu))
        if best is None:  # no sphere divides them, as in a ball of close fingerprints
            return self._leaf()
        node = len(self.points)
        self.points.append(best[1])
        self.radii.append(best[2])
        self.children.append([0, 0])
        inside = distances(sample, np.uint64(best[1])) <= best[2]
        self.children[node][0] = self._grow(sample[inside], most, rng)
        self.children[node][1] = self._grow(sample[~inside], most, rng)
        return node

    def arrays(self) -> tuple:
        """(vantage points, radii, children, root, radius)."""
        return np.array(self.points, np.uint64), np.array(self.radii, np.int16), np.array(self.children, np.int64).reshape(-1, 2), self.root, self.radius

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return route(self.arrays(), points)


def route(tree: tuple, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each point's home leaf, and the leaves that hold points within the radius of it.

    A point at distance d of the vantage point can be linked to one on the other
    side of the sphere only if d is within the radius of mu (triangle inequality).
    Of two points on either side, the inner one visits the outer one's leaf.
    """
    vantage, radii, children, root, r = tree
    rows, leaves, home = [], [], []
    todo = [(root, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, row, own = todo.pop()
        if not len(row):
            continue
        if node < 0:
            rows.append(row)
            leaves.append(np.full(len(row), -1 - node, np.int64))
            home.append(own)
            continue
        d, mu = distances(points[row], vantage[node]), int(radii[node])
        inner, outer = d <= mu, d > mu
        left = inner | (~own & (d <= mu + r))
        right = outer | (d > mu - r)
        todo.append((int(children[node][0]), row[left], own[left]))
        todo.append((int(children[node][1]), row[right], own[right] & outer[right]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(home)


def grafted(tree: tuple, below: dict[int, tuple]) -> tuple:
    """tree with trees in place of some of its leaves, all leaves numbered anew from 0."""
    parts, at, offset = [tree], {}, len(tree[0])
    for leaf, sub in below.items():
        at[leaf] = offset if sub[3] >= 0 else None  # a tree without a node is a leaf still
        offset += len(sub[0])
        parts.append(sub)
    children, start = [], 0
    for k, part in enumerate(parts):
        own = part[2].copy()
        inside = own >= 0
        own[inside] += start
        if not k:
            for i, j in zip(*np.nonzero(~inside), strict=True):
                if at.get(int(-1 - own[i, j])) is not None:
                    own[i, j] = at[int(-1 - own[i, j])]
        children.append(own)
        start += len(part[0])
    joined = np.concatenate(children)
    leaf = joined < 0
    joined[leaf] = -1 - np.arange(int(leaf.sum()))
    root = tree[3] if tree[3] >= 0 else at.get(-1 - tree[3])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), joined, -1 if root is None else root, tree[4]


def components(points: np.ndarray, home: np.ndarray, radius: int, sizes: np.ndarray | None = None, ratio: float = 0.0) -> np.ndarray:
    """For each point the first of its component. points: (rows, 64-bit lanes); links join a home point and any other.

    Rows are sorted by distance to a vantage point, so that those which the triangle
    inequality rules out are never compared; no list of pairs is made. sizes: linked
    points also have sizes at least `ratio` of each other.
    """
    n = len(points)
    key = np.bitwise_count(points ^ points[:1]).sum(1, dtype=np.int32)
    order = np.argsort(key, kind="stable")
    points, key, home = points[order], key[order], home[order]
    sizes = None if sizes is None else sizes[order]
    label = np.arange(n)
    mine = np.flatnonzero(home)
    for at in range(0, len(mine), CHUNK):
        rows = mine[at : at + CHUNK]
        low, high = np.searchsorted(key, key[rows[0]] - radius), np.searchsorted(key, key[rows[-1]] + radius, "right")
        near = np.empty((len(rows), high - low), bool)
        for left in range(low, high, TILE):
            right = min(left + TILE, high)
            apart = np.zeros((len(rows), right - left), np.uint16)
            for lane in range(points.shape[1]):
                apart += np.bitwise_count(points[rows, lane][:, None] ^ points[None, left:right, lane])
            close = apart <= radius
            if sizes is not None:
                a, b = sizes[rows][:, None], sizes[None, left:right]
                close &= np.minimum(a, b) >= ratio * np.maximum(a, b)
            near[:, left - low : right - low] = close
        for i in np.flatnonzero(near.sum(1) > 1).tolist():
            roots = np.unique(label[low:high][near[i]])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


# --- links and components in Spark ----------------------------------------------------------


def _arrow_columns(df: DataFrame, of, schema: str, step: int = 2000) -> DataFrame:
    """of(fingerprints) over the column fp, in pieces; of gives the columns of schema as arrays."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), step):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in of(fps[at : at + step])], names)

    return df.select("fp").mapInArrow(run, schema)


def fitted_tree(points: DataFrame, count: int, radius: int, leaf_rows: int) -> tuple:
    """A tree for `count` fingerprints fp, as arrays, with leaves for about leaf_rows each.

    Its upper part is fitted on about SAMPLE of them, chosen by hash, which come to the
    driver. If that part has too few leaves, each of them gets a tree of its own, fitted in a
    task on about LEAF_SAMPLE fingerprints a leaf; only nodes come to the driver, MOST_LEAVES at most.
    """
    leaves = min(MOST_LEAVES, math.ceil(count / leaf_rows))
    first = max(1, min(leaves, SAMPLE // LEAF_SAMPLE))
    scale = 1 << 20
    chosen = lambda n: points.where(F.pmod(F.xxhash64("fp"), F.lit(scale)) < min(scale, math.ceil(scale * n / max(1, count)))).select("fp")
    sample = np.array([r["fp"] for r in chosen(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = VantageTree(np.sort(sample), first, radius).arrays()
    if leaves <= first:
        return tree
    shared, each = points.sparkSession.sparkContext.broadcast(tree), math.ceil(leaves / first)

    def homes(fps: np.ndarray) -> tuple:
        row, leaf, home = route(shared.value, fps.view(np.uint64))
        return leaf[home], fps[row[home]]

    def grow(table: pa.Table) -> pa.Table:
        vantage, radii, children, root, _ = VantageTree(np.sort(table.column("fp").to_numpy().view(np.uint64)), each, radius).arrays()
        one = lambda x: pa.array([x], pa.list_(pa.int64()))
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "vantage": one(vantage.view(np.int64)), "radii": one(radii.astype(np.int64)), "children": one(children.ravel()), "root": pa.array([root], pa.int64())})

    grown = _arrow_columns(chosen(LEAF_SAMPLE * leaves), homes, "leaf long, fp long").groupBy("leaf").applyInArrow(grow, "leaf long, vantage array<long>, radii array<long>, children array<long>, root long")
    below = {r["leaf"]: (np.array(r["vantage"], np.int64).view(np.uint64), np.array(r["radii"], np.int16), np.array(r["children"], np.int64).reshape(-1, 2), r["root"], radius) for r in grown.collect()}
    return grafted(tree, below)


def leaf_links(points: DataFrame, radius: int, leaf_rows: int | None = None) -> DataFrame:
    """(a, b): links of distinct fingerprints fp that join what is within `radius` bits of each other.

    In each leaf every fingerprint is linked to one of its component there; all links
    follow from these. The tree is fitted on samples; every fingerprint is routed and compared. A leaf that
    holds more than a task should, such as a ball of close fingerprints that no sphere divides, is dealt into
    tiles: each part of its homes meets each part of all its entries.
    """
    tree = points.sparkSession.sparkContext.broadcast(fitted_tree(points, points.count(), radius, leaf_rows or LEAF_ROWS))

    def entries(fps: np.ndarray) -> tuple:
        row, leaf, home = route(tree.value, fps.view(np.uint64))
        return leaf, fps[row], home

    def weights(fps: np.ndarray) -> tuple:
        _, leaf, home = route(tree.value, fps.view(np.uint64))
        own, at, n = np.unique(leaf, return_inverse=True, return_counts=True)
        return own, n, np.bincount(at, home, len(own)).astype(np.int64)

    def link(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy()
        home = table.column("home").to_numpy()
        order = np.argsort(fps, kind="stable")
        fps, home = fps[order], home[order]
        first = components(fps.view(np.uint64)[:, None], home, radius)
        rest = first != np.arange(len(fps))
        return pa.table({"a": fps[rest], "b": fps[first[rest]]})

    held = _arrow_columns(points, weights, "leaf long, n long, homes long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("homes").alias("homes"))
    # a row a leaf at most, of which there are MOST_LEAVES
    full = held.where((F.col("homes") > HOME_ROWS) | (F.col("n") > GUEST_ROWS)).select("leaf", F.ceil(F.col("homes") / HOME_ROWS).alias("_tl_rows"), F.ceil(F.col("n") / GUEST_ROWS).alias("_tl_columns"))
    dealt = _arrow_columns(points, entries, "leaf long, fp long, home boolean").join(F.broadcast(full), "leaf", "left")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.greatest(F.col(c), F.lit(1).cast("long")) - 1)
    part = lambda c, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.greatest(F.col(c), F.lit(1).cast("long")))
    tile = lambda a, b, home: F.struct(a.alias("tile_a"), b.alias("tile_b"), home.alias("home"))
    as_home = F.when(F.col("home"), F.transform(upto("_tl_columns"), lambda j: tile(part("_tl_rows", 1), j, F.lit(True))))
    as_guest = F.transform(upto("_tl_rows"), lambda i: tile(i, part("_tl_columns", 2), F.lit(False)))
    alone = F.array(tile(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("home")))
    tiles = F.when(F.col("_tl_rows").isNull(), alone).otherwise(F.concat(F.coalesce(as_home, F.slice(as_guest, 1, 0)), as_guest))
    met = dealt.select("leaf", "fp", F.explode(tiles).alias("t")).select("leaf", "fp", "t.*")
    return met.groupBy("leaf", "tile_a", "tile_b").applyInArrow(link, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of links (a, b), for nodes that have links.

    Alternates the two steps of Kiveris et al. (2014): each node points its larger
    neighbours, then its smaller ones, to the smallest. Every round is a shuffle of
    the links; no node's neighbours are gathered, and only two numbers come to the driver.
    """
    least = lambda df: df.groupBy("a").agg(F.min("b").alias("m"))
    turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(turned(edges))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = large.join(least(large), "a")
        edges = checkpointed(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def with_components(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """rows with component_id, the smallest doc_id of the rows whose keys links (a, b) join, and group, their smallest key."""
    roots = connected(links)
    nodes = rows.groupBy(key).agg(F.min("doc_id").alias("_tl_min"))
    rooted = nodes.join(roots, nodes[key] == roots["node"], "left").select(key, "_tl_min", F.coalesce("root", key).alias("_tl_root"))
    smallest = rooted.groupBy("_tl_root").agg(F.min("_tl_min").alias("component_id"))
    named = rooted.join(smallest, "_tl_root").select(F.col(key).alias("_tl_key"), "component_id", F.col("_tl_root").alias("group"))
    return rows.join(named, rows[key] == named["_tl_key"]).drop("_tl_key")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document.

    Fingerprints are SimHashes of `width`-word shingles, repeats included; documents link at
    `radius` differing bits or fewer, and component_id is the smallest doc_id that
    links reach. Equal fingerprints count as one point from the start. A document
    without words, null or empty, has fingerprint 0 and links like any other. Null
    doc_ids don't name a component unless it has no other. An empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, width))
    links = leaf_links(rows.select("fp").distinct(), radius)
    out = with_components(rows, "fp", links)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by similarity, for pipelines -------------------------------------------

#: Multipliers of the lanes of a long fingerprint.
LANES = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Smallest shingle hashes that a text is known by; those by which it meets others, and how many it takes of its own if some of them are too common.
LOWEST, ANCHORS, RARE_ANCHORS = 16, 4, 8
#: Texts, and shingle hashes of candidates, that are compared in one task at once at most, as expected of a deal by hash;
#: fewer, but so many at least, where the average task has fewer.
TILE_ROWS, TILE_HASHES, LEAST_ROWS, LEAST_HASHES = 1 << 15, 1 << 21, 1 << 10, 1 << 16
#: Rows of a table that is broadcast at most, of some 32 bytes each.
MOST_BROADCAST = 1 << 20


def lanes(hashes: np.ndarray) -> list[int]:
    """A SimHash of 256 bits."""
    mixed = hashes[:, None] * LANES[None, :]
    mixed ^= mixed >> np.uint64(31)
    return [fingerprint(mixed[:, k]) for k in range(len(LANES))]


def bits_apart(similarity: float, bits: int, slack: float = 4.0) -> int:
    """Bits in which fingerprints of sets with that Jaccard similarity differ, plus `slack` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "whole", "size", "lowest", *(f"f{k}" for k in range(len(LANES)))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, size, lowest, prints = [], [], [], []
            for text in batch.column("text"):
                found = normal_words(text.as_buffer().to_pybytes()) if text.is_valid else []
                whole.append(xxhash.xxh64_intdigest(b" ".join(found), SEED))
                hashes = np.unique(shingle_hashes(found, width))
                size.append(len(hashes))
                lowest.append(hashes[:LOWEST].view(np.int64))
                prints.append(lanes(hashes) if len(hashes) else [0] * len(LANES))
            values = np.array(prints, np.uint64).reshape(-1, len(LANES)).view(np.int64)
            cells = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(lowest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cells, *(pa.array(values[:, k]) for k in range(len(LANES)))], names)

    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return read.mapInArrow(of, f"doc_id {kind}, text_hash long, whole long, size long, lowest array<long>, " + ", ".join(f"{n} long" for n in names[5:]))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows in tables of whole runs: of batches sorted by their first `keys` columns, only the last run is held back."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        last = int(np.flatnonzero(np.any([c != c[-1] for c in cells], 0))[-1]) + 1 if any((c != c[-1]).any() for c in cells) else 0
        goes_on = left and all(left[-1].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        if left and not goes_on:
            yield pa.Table.from_batches(left)
            left = []
        if last:
            yield pa.Table.from_batches([*left, batch.slice(0, last)])
            left = []
        left.append(batch.slice(last))
    if left:
        yield pa.Table.from_batches(left)


def cuts(table: pa.Table, keys: int) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values in the first `keys` columns."""
    cells = [table.column(k).to_numpy() for k in range(keys)]
    at = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cells], 0)) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), table.num_rows], strict=True))


def alike(hashes: np.ndarray, ends: np.ndarray, similarity: float, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the first of its component, where sets of Jaccard similarity `similarity` or more are linked.

    Set k is hashes[ends[k - 1] : ends[k]], without repeats. All that a set shares with the others is
    counted at once over lists of the sets that have a hash. side: only sets of different sides are linked.
    """
    n, starts = len(ends), np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    unique, token = np.unique(hashes, return_inverse=True)
    of = np.repeat(np.arange(n), sizes)[np.argsort(token, kind="stable")]
    upto = np.cumsum(np.bincount(token, minlength=len(unique)))
    label = np.arange(n)
    for i in range(n):
        open_ = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        if side is not None:
            open_ &= side != side[i]
        if not open_.any():
            continue
        own = token[starts[i] : ends[i]]
        low = np.where(own > 0, upto[own - 1], 0)
        shared = np.bincount(np.concatenate([of[a:b] for a, b in zip(low.tolist(), upto[own].tolist(), strict=True)]), minlength=n)
        near = open_ & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9)
        if near.any():
            roots = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, roots)] = roots[0]
    return label


def if_small(df: DataFrame) -> DataFrame:
    """df, kept, and broadcast only if it has MOST_BROADCAST rows at most."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def share_of_task(spark, total: int, least: int, most: int) -> int:
    """What a task may hold of one group: an average task's share, within bounds."""
    return min(most, max(least, total // shuffle_partitions(spark)))


def tiled(rows: DataFrame, keys: list[str], weight: Column, most: int) -> DataFrame:
    """rows with tile_a, tile_b and side: groups heavier than `most` are dealt into parts by `whole`, and each two parts meet in a tile.

    A tile (a, b) holds the rows of two parts, told apart by side, or those of one part if a = b; a lighter group is
    one tile. So no task holds more than `most`, and each pair of rows of a group is in one tile as a pair to compare.
    """
    heavy = if_small(rows.groupBy(*keys).agg(F.sum(weight).alias("_tl_weight")).where(F.col("_tl_weight") > most).select(*keys, F.ceil(2 * F.col("_tl_weight") / most).alias("_tl_parts")))
    parts = F.coalesce("_tl_parts", F.lit(1).cast("long"))
    dealt = rows.join(heavy, keys, "left").withColumn("_tl_part", F.pmod("whole", parts))
    met = dealt.withColumn("_tl_other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    own = F.least("_tl_part", "_tl_other").alias("tile_a"), F.greatest("_tl_part", "_tl_other").alias("tile_b")
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), *own, (F.col("_tl_part") >= F.col("_tl_other")).alias("side"))


def with_anchors(points: DataFrame, most: int) -> DataFrame:
    """points (whole, lowest, ...) with anchors, the hashes by which a text meets others.

    These are its ANCHORS smallest ones. If hashes among its LOWEST ones are in more than `most` texts, as those of a passage that
    a third of the corpus has, it takes the RARE_ANCHORS smallest of the others: half of it is then not that passage,
    and texts that are alike at 0.8 are so at 0.6 in what they have besides. If fewer are left, common
    passages are most of the text, and it meets others by all of its hashes that are rare and the smallest ones.
    """
    each = points.select("whole", F.explode("lowest").alias("h"))
    common = if_small(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h"))
    of_text = each.join(common, "h").groupBy("whole").agg(F.collect_set("h").alias("_tl_common"))
    rare = F.array_except("lowest", F.coalesce("_tl_common", F.array().cast("array<long>")))
    smallest = F.slice("lowest", 1, ANCHORS)
    chosen = F.when(F.col("_tl_common").isNull(), smallest).when(F.size(rare) >= RARE_ANCHORS, F.slice(rare, 1, RARE_ANCHORS)).otherwise(F.array_union(smallest, rare))
    return points.join(of_text, "whole", "left").withColumn("anchors", chosen).drop("_tl_common", "lowest")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(whole, hashes): the sorted shingle hashes of each text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [normal_words(t.as_buffer().to_pybytes()) for t in batch.column("text").slice(at, 500)]
                whole = np.array([xxhash.xxh64_intdigest(b" ".join(f), SEED) for f in found], np.uint64)
                sets = [np.unique(shingle_hashes(f, width)).view(np.int64) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["whole", "hashes"])

    return texts.select("text").mapInArrow(of, "whole long, hashes array<long>")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, whole, component_id, group): groups of documents whose sets of `width`-word shingles are alike.

    64 bits tell apart sets of similarity 0.8 only at a radius of about 14, where random
    fingerprints, 32 +- 4 bits apart, defeat a vantage-point tree. So documents are
    sharded by their smallest shingle hashes first, of which similar sets share some
    almost surely; in a shard, fingerprints of 256 bits are compared behind the
    triangle bound, at a radius wide enough for all but one in ten thousand alike pairs. That only finds candidates:
    the shingle sets of candidates meet again and are linked if their exact Jaccard similarity is `similarity` or more.
    Hashes that too many texts share are passed over where others will do, and large shards are dealt into tiles both times, so that no task holds one whole.
    whole is the hash of a document's words, group that of one member.
    Equal documents count once. Documents without words, null or empty, form one group; other columns are left out,
    long texts are compared whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prints = [f"f{k}" for k in range(len(LANES))]
    rows = checkpointed(_signatures(docs, width))
    points = checkpointed(rows.groupBy("whole").agg(F.first(F.struct("doc_id", "text_hash")).alias("one"), *(F.first(c).alias(c) for c in ("size", "lowest", *prints))))
    most = share_of_task(spark, ANCHORS * rows.count(), LEAST_ROWS, TILE_ROWS)
    radius = bits_apart(similarity, 64 * len(LANES))
    shards = ["anchor", "tile_a", "tile_b"]
    meets = checkpointed(with_anchors(points, most)).select("whole", "one", "size", *prints, F.explode("anchors").alias("anchor"))
    keys = len(shards)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            for start, end in cuts(table, keys):
                if end - start < 2:
                    continue
                own = table.slice(start, end - start)
                whole, size = (own.column(n).to_numpy() for n in ("whole", "size"))
                lane = np.stack([own.column(n).to_numpy() for n in prints], 1).view(np.uint64)
                home = own.column("side").to_numpy()  # of one part all
                first = components(lane, home, radius, size, similarity)
                stays = np.flatnonzero(np.bincount(first, minlength=len(own))[first] > 1)
                if len(stays):
                    got = own.take(pa.array(stays)).combine_chunks()
                    cells = [got.column(n).combine_chunks() for n in (*shards, "whole", "size", "doc_id", "text_hash")]
                    yield pa.RecordBatch.from_arrays([*cells[:keys], pa.array(whole[first[stays]]), *cells[keys:]], [*shards, "near", "whole", "size", "doc_id", "text_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = shuffle_partitions(spark)
    tiles = tiled(meets, ["anchor"], F.lit(1), most)
    dealt = tiles.select(*shards, "side", "whole", "size", *prints, "one.doc_id", "one.text_hash").repartition(parts, *shards).sortWithinPartitions(*shards)
    met = checkpointed(dealt.mapInArrow(candidates, f"anchor long, tile_a long, tile_b long, near long, whole long, size long, doc_id {kind}, text_hash long"))
    # one row of docs for each candidate text
    wanted = if_small(met.select(F.col("doc_id").alias("_tl_id"), F.col("text_hash").alias("_tl_hash")).distinct())
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("_tl_id")) & (F.col("text_hash") == F.col("_tl_hash")), "left_semi")
    sets = _sets(texts, width).dropDuplicates(["whole"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, len(groups)):
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, end in cuts(table, len(groups)):
                own = table.slice(start, end - start).combine_chunks()
                whole, lists = own.column("whole").to_numpy(), own.column("hashes").combine_chunks()
                side = own.column("side").to_numpy() if own.column("tile_a")[0] != own.column("tile_b")[0] else None
                first = alike(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy()), similarity, side)
                rest = first != np.arange(len(own))
                a.append(whole[rest])
                b.append(whole[first[rest]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    # candidates meet in tiles of their own, whose weight is that of their sets
    shard = met.select(F.xxhash64(*shards, "near").alias("shard"), "whole", "size").distinct()
    groups = ["shard", "tile_a", "tile_b"]
    weight = shard.agg(F.sum("size")).first()[0] or 0
    again = tiled(shard, ["shard"], F.col("size"), share_of_task(spark, weight, LEAST_HASHES, TILE_HASHES)).join(sets, "whole").select(*groups, "side", "whole", "hashes")
    found = again.repartition(parts, *groups).sortWithinPartitions(*groups).mapInArrow(links, "a long, b long")
    return with_components(rows.select("doc_id", "text_hash", "whole"), "whole", found)


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays, with the columns of docs.

    A null doc_id stays only if its group has no other. Of rows with that doc_id the one
    with the smallest text hash stays, of equal rows one. Equal ids of different groups don't meet.
    """
    groups = similar_groups(docs, width, similarity)
    # keys that are never null, so that rows are dealt once for the join and for the choice among equal ones
    key = lambda c: [F.col(c).isNull().alias("_tl_none"), F.coalesce(F.col(c), F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_tl_id")]
    first = F.min(F.struct(*key("doc_id"), F.col("text_hash").alias("_tl_text")))
    stays = groups.groupBy("group").agg(first.alias("x")).select("x.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*key("doc_id"), F.xxhash64("text").alias("_tl_text"), F.struct(*columns).alias("_tl_row"))
    at = ["_tl_none", "_tl_id", "_tl_text"]
    one = F.row_number().over(Window.partitionBy(*at).orderBy("_tl_text"))
    return rows.join(stays, at, "left_semi").withColumn("_tl_n", one).where("_tl_n = 1").select("_tl_row.*")
