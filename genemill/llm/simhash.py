"""SimHash near-duplicates with a Gray-order hierarchical index.

A text's words (ASCII letters lower-cased, split at space and U+0009 to U+000D) give 3-word shingles, repeats included;
a bit of the 64-bit fingerprint is set if more than half of the shingles' XXH64 (seed 42) have it. Fingerprints link
at `DISTANCE` or fewer differing bits, and documents fall into the connected components of the links.

Equal fingerprints are collapsed first. Two fingerprints within three bits agree in at least two of five blocks of
bits, so each is sent to the ten pairs of blocks; where the blocks agree, the fingerprints are sorted by Gray rank and
indexed: leaves of 32 in Gray order, upper nodes that factor out the bits all below share, each bit named once on the
way down. A search adds up differences from node to node and drops a whole group at the fourth. Of the links found in
one place only a spanning forest leaves it, so groups of near copies do not become pairs. A place with more than
`CROWD` fingerprints is dealt out again by five blocks of the bits that are left; bits run out before a place can
exceed the bound, so nothing is dropped.

Null, empty and wordless texts have fingerprint zero, linked like any other; fewer than three words are one shingle.
Repeated rows stay rows; equal ids are one node. Texts are hashed whole. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.llm.common import as_bytes, cut, sliced
from genemill.llm.components import components

DISTANCE = 3
SHINGLE, SEED = 3, 42
BLOCKS, AGREE = 5, 2  # of five blocks, at least two agree if at most three bits differ
LEAF = 32
CROWD = 1 << 15
U = np.uint64
_STEP = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    w = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    if len(w) < size:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(w[i:] for i in range(size)))), len(w) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), U, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        bits = np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(U)).sum(dtype=U)) if (2 * ones > n).any() else 0


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit numbers."""
    return sliced(lambda few: pa.array(np.array([fingerprint(t) for t in as_bytes(few)], U).view(np.int64)), texts)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the order of the Gray code: the prefix XOR of its bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all below share."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        size = LEAF
        mask, pattern = self._group(np.full(len(values), ~U(0)), self.values, LEAF)
        levels = [(mask, pattern, size)]
        while len(mask) > 1:
            mask, pattern = self._group(mask, pattern, 8)
            size *= 8
            levels.append((mask, pattern, size))
        # from the root down, a node keeps only the bits that its parent does not share
        self.levels = []
        above: np.ndarray | None = None
        for mask, pattern, size in reversed(levels):
            own = mask if above is None else mask & ~np.repeat(above, 8)[: len(mask)]
            self.levels.append((own, pattern, size))
            above = mask
        self.shared = above  # of the leaves: all bits named on the way down

    @staticmethod
    def _group(mask: np.ndarray, pattern: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(mask), size)
        first = np.repeat(pattern[starts], np.diff(np.append(starts, len(mask))))
        differ = np.bitwise_or.reduceat((pattern ^ first) & mask, starts)
        return np.bitwise_and.reduceat(mask, starts) & ~differ, pattern[starts]

    def links(self, distance: int = DISTANCE, step: int = 512):
        """Arrays (i, j) of places in Gray order with i < j, at most `distance` bits apart, a block of queries at a time."""
        n = len(self.values)
        for q0 in range(0, n, step):
            q = np.arange(q0, min(q0 + step, n))
            query, node, seen = q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for depth, (mask, pattern, size) in enumerate(self.levels):
                if depth:  # to the eight children of each node that is left
                    query, seen = np.repeat(query, 8), np.repeat(seen, 8)
                    node = (node[:, None] * 8 + np.arange(8)).ravel()
                    real = node < len(mask)
                    query, node, seen = query[real], node[real], seen[real]
                # only groups that end after the query: each pair is found once
                seen = seen + np.bitwise_count((self.values[query] ^ pattern[node]) & mask[node])
                near = (seen <= distance) & ((node + 1) * size > query)
                query, node, seen = query[near], node[near], seen[near]
            other = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            query = np.repeat(query, LEAF)
            real = (other < n) & (other > query)
            query, other = query[real], other[real]
            close = np.bitwise_count(self.values[query] ^ self.values[other]) <= distance
            if close.any():
                yield query[close], other[close]


class Forest:
    """Union-find that keeps the links which joined two groups."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        # most links of a dense group join what is joined: leave those out at once
        roots = np.array([self.find(i) for i in np.unique(np.concatenate([left, right])).tolist()])
        names = np.unique(np.concatenate([left, right]))
        a, b = roots[np.searchsorted(names, left)], roots[np.searchsorted(names, right)]
        new = a != b
        pairs = np.unique(np.stack([a[new], b[new]], 1), axis=0, return_index=True)[1]
        for i, j in zip(left[new][pairs].tolist(), right[new][pairs].tolist()):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.kept.append((i, j))


def _deal(values: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of blocks of the given bits: (key, number of the pair), flattened pair after pair."""
    blocks = np.array_split(np.array(bits, U), BLOCKS)
    keys = []
    for pair in combinations(range(BLOCKS), AGREE):
        mask = U(0)
        for k in pair:
            mask |= (U(1) << blocks[k]).sum(dtype=U)
        keys.append(values & mask)
    return np.concatenate(keys), np.repeat(np.arange(len(keys)), len(values))


def _bits_left(path: str) -> list[int]:
    """Bits that the block pairs on a path have not used yet."""
    bits, pairs = list(range(64)), list(combinations(range(BLOCKS), AGREE))
    for step in path.split("."):
        if step:
            blocks = np.array_split(np.array(bits), BLOCKS)
            used = {int(b) for k in pairs[int(step)] for b in blocks[k]}
            bits = [b for b in bits if b not in used]
    return bits


_DEALT = pa.schema([("path", pa.string()), ("key", pa.int64()), ("value", pa.int64()), ("node", pa.int64())])
_FOUND = pa.schema([("kind", pa.string()), ("path", pa.string()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _deal_out(batches):
    """(path, key, value, node) -> the same for each pair of blocks of the bits that the path leaves; key keeps the old bits."""
    for batch in batches:
        path, key, value, node = (batch.column(i) for i in range(4))
        key, value, node = (x.to_numpy(zero_copy_only=False) for x in (key, value, node))
        paths = np.array(path.to_pylist(), object)
        for p in sorted(set(paths.tolist())):
            at = np.flatnonzero(paths == p)
            keys, pair = _deal(value[at].view(U), _bits_left(p))
            times = len(keys) // len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{p}.{k}" for k in range(times)], pa.string()).take(pa.array(pair)),
                    pa.array(keys.view(np.int64) | np.tile(key[at], times)),
                    pa.array(np.tile(value[at], times)),
                    pa.array(np.tile(node[at], times)),
                ],
                schema=_DEALT,
            )


def _search(batches):
    """Sorted by (path, key): links of each place as a spanning forest, or the place's rows again if it is crowded."""
    held: list[tuple] = []
    n_held = 0

    def out(rows: list[tuple[str, str, int, int, int]]):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    def place(path: str, key: int, value: np.ndarray, node: np.ndarray):
        index, forest = GrayIndex(value.view(U)), None
        for left, right in index.links():
            forest = forest or Forest(len(value))
            forest.add(left, right)
        names = node[index.order]
        return [("link", "", 0, int(names[i]), int(names[j])) for i, j in forest.kept] if forest else []

    def done(path, key, value, node, crowded):
        if crowded:
            for i in range(0, len(value), 10_000):
                yield from out([("crowd", path, key, int(v), int(x)) for v, x in zip(value[i : i + 10_000], node[i : i + 10_000])])
        elif len(value) > 1:
            yield from out(place(path, key, value, node))

    current, crowded = None, False
    for batch in batches:
        paths, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        codes = paths.dictionary_encode()
        names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        value, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        new = np.flatnonzero((np.diff(code) != 0) | (np.diff(keys) != 0)) + 1
        bounds = np.concatenate([[0], new, [len(keys)]])
        # runs of one row inside a batch have no partner
        runs = np.flatnonzero(np.diff(bounds) > 1).tolist()
        edge = {0, len(bounds) - 2}
        links: list[tuple] = []
        for r in sorted(edge | set(runs)):
            s, e = int(bounds[r]), int(bounds[r + 1])
            this = (names[code[s]], int(keys[s]))
            if this != current:
                if current is not None and n_held:
                    yield from done(*current, *map(np.concatenate, zip(*held)), crowded)
                current, held, n_held, crowded = this, [], 0, False
            held.append((value[s:e], node[s:e]))
            n_held += e - s
            if n_held > CROWD:  # pass it on as it comes, to be dealt out again
                crowded = True
                yield from done(*current, *map(np.concatenate, zip(*held)), True)
                held, n_held = [], 0
            elif r != len(bounds) - 2 and not crowded:
                links += place(*current, *map(np.concatenate, zip(*held)))
                held, n_held = [], 0
                current = None
        yield from out(links)
    if current is not None and n_held:
        yield from done(*current, *map(np.concatenate, zip(*held)), crowded)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) that connect all nodes (columns value, node) as the links within DISTANCE bits do."""
    left = nodes.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("key"), "value", "node")
    edges = None
    while True:
        dealt = left.mapInArrow(_deal_out, "path string, key long, value long, node long")
        dealt = dealt.repartition("path", "key").sortWithinPartitions("path", "key")
        found = cut(dealt.mapInArrow(_search, "kind string, path string, key long, a long, b long"))
        new = found.where("kind = 'link'").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        left = found.where("kind = 'crowd'").select("path", "key", F.col("a").alias("value"), F.col("b").alias("node"))
        if left.isEmpty():
            return edges


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("value")))
    nodes = cut(prints.groupBy("value").agg(F.min("doc_id").alias("node")))
    # a fingerprint of rows without an id only has no node to link
    found = components(links(nodes.where("node IS NOT NULL")))
    classes = nodes.join(found, "node", "left").select("value", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(classes, "value")
    return out.select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")
