"""Repeated strings across documents, with suffix arrays by induced sorting in shards.

A byte goes if it lies in a string of `LENGTH` bytes that also starts anywhere else. Every string of that length has
one anchor: the leftmost smallest of the hashes of its `ANCHOR`-byte pieces, which depends on the string only. So equal
strings have equal anchors, and strings that share an anchor are compared in one place.

1. Per document, each anchor with the range of starts that it stands for, and a digest of the bytes these starts need.
2. Anchors that occur once are dropped. Equal stretches of text (anchor and digest) are collapsed to one with a count;
   where all occurrences of an anchor are equal, all of them are repeated and nothing is left to sort.
3. The other stretches go to shards by anchor, one copy of each. A shard cuts them into blocks of `BLOCK` bytes counted
   from the anchor, sorts the sequences of blocks by induced sorting, and reads off the permuted common prefixes which
   blocks begin a repeated run long enough to lie inside a repeated string. The starts around these are checked
   byte-exactly through the rolling digest of their whole string.
4. Repeated starts go back to their documents, which cut out what they cover.

An anchor with more than `WIDE_KINDS` different stretches is not gathered in a shard: its strings are compared by digest
in a grouped count, which is added up before it is shuffled. Matches never cross documents; repeated rows are
different documents. Null and empty texts have no bytes, and texts shorter than `LENGTH` nothing to remove. Long texts
are processed in pieces. Digests have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.llm.common import as_bytes, cut_table, in_slices, mix64
from genemill.llm.sais import permuted_lcp, suffix_array

LENGTH = 400
ANCHOR = 192
BLOCK = 16
PIECE = 1 << 17  # starts of a text at a time
CHUNK_BYTES = 1 << 19  # of stretches sorted together, whole anchors at a time
WIDE_KINDS = 1 << 12  # stretches of one anchor that a shard sorts: about 2 MB
U = np.uint64
_SPAN = LENGTH - ANCHOR + 1  # pieces of a string
_LOW = U((1 << 18) - 1)

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_VALUES = mix64(np.arange(1, 257, dtype=U) * U(_BASE)) | U(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(n - 1, base % (1 << 64), U)]), dtype=U)


_tables: list[np.ndarray] = []


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    return _tables[0], _tables[1]


class Digests:
    """Digests of any stretch of some bytes, from sums of their prefixes."""

    def __init__(self, data: np.ndarray):
        self.up, down = _tables_for(max(len(data) + 1, PIECE + 2 * LENGTH))
        self.sums = np.zeros(len(data) + 1, U)
        # in place: these are the largest arrays of a task
        own = self.sums[1:]
        np.take(_VALUES, data, out=own, mode="clip")
        own *= down[: len(data)]
        np.cumsum(own, out=own)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start])


def digests_at(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Digests of the strings of one length that begin at ascending places, from a piece of the data at a time."""
    out = np.empty(len(start), U)
    edges = np.searchsorted(start, np.arange(0, len(data) + PIECE, PIECE))
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        if low < high:
            own = start[low:high] - k * PIECE
            out[low:high] = Digests(data[k * PIECE : (k + 1) * PIECE + length]).of(own, own + length)
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def stretches(data: np.ndarray):
    """(anchor, digest, first start, place of the anchor, last start) of the strings of a text, a piece at a time."""
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        part = data[at : at + PIECE + LENGTH - 1]
        digests = Digests(part)
        n = len(part) - ANCHOR + 1
        places = np.arange(n)
        hashes = digests.of(places, places + ANCHOR)
        # the place in the low bits: the smallest is the leftmost of equal ones
        anchor = (_sliding_min((hashes & ~_LOW) | places.astype(U), _SPAN) & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        place = anchor[first]
        shape = ((place - first).astype(U) << U(16)) | (last - first).astype(U)
        digest = mix64(digests.of(first, last + LENGTH) ^ mix64(shape + U(1)))
        yield hashes[place], digest, first + at, place + at, last + at


def _packed(first: np.ndarray, place: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << 24) | ((place - first) << 12) | (last - first)


_ANCHORS = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("row", pa.int64()), ("where", pa.int64())])


def _anchors(batches):
    for batch in in_slices(batches):
        held, size = [], 0
        for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            for a, d, first, place, last in stretches(np.frombuffer(text, np.uint8)):
                held.append((a.view(np.int64), d.view(np.int64), np.full(len(a), row), _packed(first, place, last)))
                size += len(a)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=_ANCHORS)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=_ANCHORS)


# --- shards ------------------------------------------------------------------------------------------------------


def repeated_starts(parts: list[bytes], offset: np.ndarray, starts: np.ndarray, copies: np.ndarray, origin: np.ndarray):
    """For stretches that share anchors: which of their starts are repeated, as one mask over all starts in order.

    offset: of the anchor in its stretch; starts: how many starts it has; copies: how often the stretch occurs;
    origin: a number that tells where its first start is, so that one place in two stretches is not two places.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    # blocks counted from the anchor, so that equal strings are cut alike
    shift = offset % BLOCK
    blocks = (sizes - shift) // BLOCK
    owner = np.repeat(np.arange(len(parts)), blocks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begin[owner] + shift[owner] + rank * BLOCK
    _, symbols = np.unique(digests_at(data, at, BLOCK), return_inverse=True)
    # after each stretch a symbol of its own, so that no run goes on into the next
    total = len(owner) + len(parts)
    text = np.empty(total, np.int64)
    where = np.arange(len(owner)) + owner
    text[where] = symbols + len(parts)
    text[np.cumsum(blocks) + np.arange(len(parts))] = np.arange(len(parts))
    order = suffix_array(text, int(text.max()) + 1)
    prefix = permuted_lcp(text, order)
    # a string has this many whole blocks, wherever it starts
    need = (LENGTH - BLOCK + 1) // BLOCK
    by_order = prefix[order] >= need
    run = by_order.copy()
    run[:-1] |= by_order[1:]
    hit = np.zeros(total, bool)
    hit[np.array(order)] = run
    block = np.flatnonzero(hit[where])
    # the starts from which such a block is the first whole one
    mask = np.zeros(int(starts.sum()), bool)
    base = np.cumsum(starts) - starts
    local = (at - begin[owner])[block]
    for back in range(BLOCK):
        s = local - back
        ok = (s >= 0) & (s < starts[owner[block]])
        mask[base[owner[block]][ok] + s[ok]] = True
    mask |= np.repeat(copies > 1, starts)
    # exact check: the same string at another place
    chosen = np.flatnonzero(mask)
    part = np.repeat(np.arange(len(parts)), starts)[chosen]
    local = chosen - base[part]
    _, name, count = np.unique(digests_at(data, begin[part] + local, LENGTH), return_inverse=True, return_counts=True)
    place = mix64(origin[part].astype(U) + local.astype(U))
    ranks = np.argsort(name, kind="stable")
    at_name = np.cumsum(count) - count
    other = np.minimum.reduceat(place[ranks], at_name) != np.maximum.reduceat(place[ranks], at_name) if len(count) else count > 1
    many = np.maximum.reduceat(copies[part][ranks], at_name) > 1 if len(count) else count > 1
    out = np.zeros(len(mask), bool)
    out[chosen] = (other | many)[name]
    return out


def _runs(mask: np.ndarray) -> bytes:
    """First and last place of each run of true, as 16-bit numbers."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return np.stack([edges[::2], edges[1::2] - 1], 1).astype("<u2").tobytes()


def _origin(row: int, where: int) -> int:
    """A number that tells where the first start of a stretch is."""
    return ((row * 0x2545F4914F6CDD1D) + (where >> 24)) % (1 << 64)


_FOUND = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("runs", pa.binary())])


def _sort_shard(batches):
    """Stretches sorted by anchor -> runs of repeated starts of each, whole anchors at a time."""

    def done(held: list[tuple]):
        anchor, digest, copies, row, where, parts = zip(*held)
        where = np.array(where)
        starts = (where & 0xFFF) + 1
        origin = np.array([_origin(r, w) for r, w in zip(row, where.tolist())], U)
        mask = repeated_starts(list(parts), where >> 12 & 0xFFF, starts, np.array(copies), origin)
        pieces = np.split(mask, np.cumsum(starts)[:-1])
        rows = [(a, d, _runs(m)) for a, d, m in zip(anchor, digest, pieces) if m.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    held: list[tuple] = []
    size = 0
    for batch in in_slices(batches):
        for x in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if held and size >= CHUNK_BYTES and x[0] != held[-1][0]:
                yield from done(held)
                held, size = [], 0
            held.append(x)
            size += len(x[5])
    if held:
        yield from done(held)


_NAMED = pa.schema(
    [("anchor", pa.int64()), ("digest", pa.int64()), ("name", pa.int64()), ("start", pa.int32()), ("copies", pa.int64()), ("place", pa.int64())]
)


def _name_starts(batches):
    """Stretches -> a row for each start: the digest of its string, and where it is."""
    for batch in in_slices(batches):
        for a, d, copies, row, where, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
            n = (where & 0xFFF) + 1
            s = np.arange(n)
            names = Digests(np.frombuffer(part, np.uint8)).of(s, s + LENGTH).view(np.int64)
            places = mix64(U(_origin(row, where)) + s.astype(U)).view(np.int64)
            columns = [np.full(n, a), np.full(n, d), names, s.astype(np.int32), np.full(n, copies), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_NAMED)


@F.arrow_udf(T.BinaryType())
def _runs_of(starts: pa.Array) -> pa.Array:
    out = []
    for own in starts.to_pylist():
        mask = np.zeros(max(own) + 1, bool)
        mask[own] = True
        out.append(_runs(mask))
    return pa.array(out, pa.binary())


_CUT = ("n_bytes", "n_removed", "n_spans")


def _cut_out(batches):
    """(doc_id, text, repeated starts) -> doc_id, numbers of bytes, of removed ones and of removed runs, and the bytes that are left."""
    for batch in in_slices(batches):
        rows = [_cut_one(text, own) for text, own in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_CUT, "kept"])


def _cut_one(text: bytes, own: list[dict] | None) -> tuple[int, int, int, bytes]:
    if not own:
        return len(text), 0, 0, text
    edges = np.zeros(len(text) + 1, np.int64)
    for x in own:
        begin = x["where"] >> 24
        runs = [(0, x["where"] & 0xFFF)] if x["runs"] is None else np.frombuffer(x["runs"], "<u2").reshape(-1, 2).tolist()
        for first, last in runs:
            edges[begin + first] += 1
            edges[begin + last + LENGTH] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
    return len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


_TEXTS_OUT = pa.schema(
    [("anchor", pa.int64()), ("digest", pa.int64()), ("copies", pa.int64()), ("row", pa.int64()), ("where", pa.int64()), ("part", pa.binary())]
)


def _take_parts(batches):
    """(row, text, wanted stretches) -> a row for each stretch with its bytes."""
    for batch in in_slices(batches):
        rows, size = [], 0
        for row, text, wanted in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            for x in wanted:
                first, n = x["where"] >> 24, x["where"] & 0xFFF
                rows.append((x["anchor"], x["digest"], x["copies"], row, x["where"], text[first : first + n + LENGTH]))
                size += n + LENGTH
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXTS_OUT)], schema=_TEXTS_OUT)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXTS_OUT)], schema=_TEXTS_OUT)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left), a row for each row."""
    # written once: the number of a row must be the same in every later job, however its input is split there
    rows = cut_table(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    )
    anchors = rows.mapInArrow(_anchors, "anchor long, digest long, row long, where long")
    # 2. anchors that occur again; the counts are added up before they are shuffled
    # (written, so that both sides of the join are plain shuffles, which AQE splits where an anchor is frequent)
    times = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    times = cut_table(times.where("n > 1").select("anchor", F.expr("low = high").alias("alike")))
    again = cut_table(anchors.join(times, "anchor"))
    same = cut_table(
        again.groupBy("anchor", "digest", "alike").agg(F.count("*").alias("copies"), F.min(F.struct("row", "where")).alias("one"))
    )
    # anchors with many kinds: at most one for each WIDE_KINDS rows
    many = cut_table(
        same.where("NOT alike").groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > WIDE_KINDS).select("anchor")
    )
    any_wide = not many.isEmpty()
    # 3. the stretches to compare, with their bytes from one occurrence each
    def with_bytes(how: str) -> DataFrame:
        which = same.where("NOT alike")
        which = (which.join(many, "anchor", how) if any_wide else which).select("anchor", "digest", "copies", "one.row", "one.where")
        wanted = which.groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "copies", "where")).alias("wanted"))
        # the same columns as below, so that texts are shuffled once
        both = rows.join(wanted, "row").select("row", "text", "wanted", "doc_id")
        return both.mapInArrow(_take_parts, "anchor long, digest long, copies long, row long, where long, part binary")

    parts = with_bytes("left_anti").repartition("anchor").sortWithinPartitions("anchor")
    found = cut_table(parts.mapInArrow(_sort_shard, "anchor long, digest long, runs binary"))
    if any_wide:
        wide = with_bytes("left_semi").mapInArrow(
            _name_starts, "anchor long, digest long, name long, start int, copies long, place long"
        )
        # repeated: a string at two places, or in a stretch that occurs again
        names = wide.groupBy("anchor", "name").agg(
            F.max("copies").alias("most"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        names = names.where("most > 1 OR low <> high").select("anchor", "name")
        starts = wide.join(names, ["anchor", "name"]).groupBy("anchor", "digest").agg(F.collect_list("start").alias("starts"))
        found = found.unionByName(starts.select("anchor", "digest", _runs_of(F.col("starts")).alias("runs")))
    # 4. back to every occurrence; where all stretches of an anchor are equal, all starts are repeated (no runs given)
    verdicts = same.where("alike").select("anchor", "digest", F.lit(None).cast("binary").alias("runs"))
    known = again.join(verdicts.unionByName(found), ["anchor", "digest"])
    own = known.groupBy("row").agg(F.collect_list(F.struct("where", "runs")).alias("found"))
    out = rows.join(own, "row", "left").select("doc_id", "text", "found")
    longs = [T.StructField(c, T.LongType()) for c in _CUT]
    # rows leave Python a few at a time, and their texts don't wait in the JVM for what a UDF returns
    return out.mapInArrow(_cut_out, T.StructType([out.schema["doc_id"], *longs, T.StructField("kept", T.BinaryType())]))
