"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over whole texts.

Letters A-Z are lower-cased; words are runs of digits, a-z and everything beyond ASCII. A window is 13 consecutive
words of an item; an item of fewer words is one window, an item without words (or null) none. Windows are sent in
blocks of at most `BLOCK_WINDOWS`, whose size is bounded; a larger benchmark takes several blocks, each scanned over
all texts, and hits are joined word by word.

A document's word is hit if it lies in any occurrence of a window. A null or empty text has no words and no hits.
Equal windows of several items count for each item; repeated item rows count once. A null item_id counts as an item
with an empty name. Texts are scanned whole, one at a time; nothing is shuffled, so copies and hot sources do not
matter, and a lost task is run again.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.llm.common import as_bytes, cut, sliced

WINDOW = 13
BLOCK_WINDOWS = 200_000  # of a window's words some 100 bytes each: 20 to 60 MB at most in a task

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
NORMAL = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def item_windows(text: bytes, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class Windows:
    """One block of windows: word numbers, and window (as numbers) -> items."""

    def __init__(self, pairs: list[tuple[tuple[bytes, ...], str]]):
        self.ids: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = defaultdict(set)
        self.sizes: set[int] = set()
        for window, item in pairs:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in window]
            self.items[np.array(ids, np.int32).tobytes()].add(item)
            self.sizes.add(len(ids))
        self.items = dict(self.items)

    def scan(self, text: list[bytes], hit: np.ndarray) -> set[str]:
        """Mark the hit words; return the items that occur."""
        ids = np.fromiter(map(self.ids.get, text, _zeros()), np.int32, len(text))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        found: set[str] = set()
        for size in self.sizes:
            if len(ids) < size:
                continue
            # only places where every word is a word of the benchmark can hold a window
            for i in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                items = self.items.get(ids[i : i + size].tobytes())
                if items:
                    found |= items
                    hit[i : i + size] = True
        return found


def _zeros():
    while True:
        yield 0


def window_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW):
    """Blocks of (window, item) pairs, read from the benchmark a partition at a time."""
    held: list[tuple[tuple[bytes, ...], str]] = []
    yielded = False
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    for item, body in rows.toLocalIterator():
        for window in item_windows(body.encode(), size):
            held.append((window, item or ""))
            if len(held) >= BLOCK_WINDOWS:
                yield held
                held, yielded = [], True
    if held or not yielded:  # without any window there is one empty block
        yield held


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, out: str = "hits") -> DataFrame:
    """Add a struct: number of words, number and bits of the words that are hit, and the items that occur (sorted).

    Each block is one pass over the texts. A second block (beyond `BLOCK_WINDOWS` windows) goes on from the written
    result of the first, so that a task never holds more than one.
    """
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("bits", pa.binary()), ("items", pa.list_(pa.string()))])
    none = F.lit(None).cast("struct<n_words: bigint, n_hit: bigint, bits: binary, items: array<string>>")

    def scan(shared):
        made: list[Windows] = []

        def one(body: bytes, before: dict | None) -> dict:
            if not made:
                made.append(Windows(shared.value))
            w = words(body)
            hit, found = np.zeros(len(w), bool), set()
            if before and before["bits"]:
                hit = np.unpackbits(np.frombuffer(before["bits"], np.uint8), count=len(w)).astype(bool)
            found = made[0].scan(w, hit) | set(before["items"] if before else ())
            bits = np.packbits(hit).tobytes() if hit.any() else b""
            return {"n_words": len(w), "n_hit": int(hit.sum()), "bits": bits, "items": sorted(found)}

        def few(values: pa.Array, before: pa.Array) -> pa.Array:
            return pa.array([one(t, b) for t, b in zip(as_bytes(values), before.to_pylist())], type=kind)

        @F.arrow_udf("struct<n_words: bigint, n_hit: bigint, bits: binary, items: array<string>>")
        def column(values: pa.Array, before: pa.Array) -> pa.Array:
            return sliced(few, values, before)

        return column

    df = docs.withColumn(out, none)
    sc = docs.sparkSession.sparkContext
    for k, block in enumerate(window_blocks(benchmark, size=size)):
        if k:
            df = cut(df)
        df = df.withColumn(out, scan(sc.broadcast(block))(F.col(text), F.col(out)))
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """Add n_words, n_hit, n_items, items (sorted as strings) and contaminated (hit words at least 1 in `share`)."""
    new = ("hits", "n_words", "n_hit", "n_items", "items", "contaminated")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    hits = [F.col(f"hits.{c}").alias(c) for c in ("n_words", "n_hit", "items")]
    out = find_hits(docs, benchmark, text, size).select(*kept, *hits)
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )
