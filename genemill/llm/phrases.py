"""Phrases whose words stay together, from exact counts of all frequent n-grams.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?]` and line ends, and pieces into words at spaces and tabs. All
counts are kept for each language apart (null: `und`).

1. Words and n-grams are named by 64-bit hashes. The top bits of a hash choose its hash partition; partitions grow in
   number with the words, up to `MOST_PARTITIONS`. Tasks count hashes by partition, and each partition merges these counts
   into one Misra-Gries summary. Its capacity exceeds the mass of the partition divided by the threshold, so whatever
   occurs often enough is still in the summary at the end: subtractions take less than the threshold from it. Summaries
   are made for one and two words first; n-grams of three and four words are only summarised where all their word pairs
   survived, since a frequent n-gram has frequent pairs.
2. Survivors become a bit table of bounded size (`FILTER_BITS`), sent to every task. A second pass over the texts counts
   the n-grams that pass it, by their words and exactly. What passes wrongly, also where the table is full, has its own
   exact count and goes with the threshold; so the size of the table decides how much is shuffled, never the result.
3. Cuts are looked up by joins on (language, part), which Spark splits where a part is frequent, and scores are whole
   numbers in decimals. Longer candidates send their count to all phrases inside them; the highest one decides. The best of
   each language are taken in two steps, so no task orders all phrases of a language.

Null and empty texts have no words; repeated rows count again; ties go by count, then by phrase. Very long texts are cut at
the ends of pieces, a long piece with the next words in view, so that no n-gram is lost or counted twice. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genemill.llm.common import as_bytes, cut_table, mix64
from genemill.llm.suffix_dedup import Digests

MOST_WORDS = 4
THRESHOLD = 30
FACTOR = 2_000_000
INSIDE = (80, 100)  # a phrase goes if a longer one around it has this share of its occurrences
PARTITION_MASS = 1 << 21  # occurrences of n-grams in a hash partition
MOST_PARTITIONS = 1 << 16
FILTER_BITS = 1 << 28
BITS_OF_SURVIVOR = 16
CHUNK = 1 << 20  # bytes of text at a time
HELD = 1 << 22  # hashes of a task before they are counted
TOTALS_HELD = 1 << 21  # n-grams of a task in the exact count before they are sent
U = np.uint64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(_BREAKS)] = 2
_SEPARATOR = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_AHEAD = re.compile(rb"(?:[\x20\x09]*[^\x20\x09.,;:!?\x0a-\x0d]+){0,%d}" % (MOST_WORDS - 1))
_NEXT = U(0x9E3779B97F4A7C15)


def _pieces(text: bytes):
    """(bytes, limit): parts of a long text; n-grams begin before the limit of their part."""
    at = 0
    while len(text) - at > CHUNK:
        window = text[at : at + CHUNK]
        end = max(window.rfind(bytes([c])) for c in _BREAKS) + 1
        ahead = end
        if not end:
            end = max(window.rfind(b" "), window.rfind(b"\t"))
            if end <= 0:
                found = _SEPARATOR.search(text, at + CHUNK)
                if not found:
                    break
                end = found.start() - at
            ahead = _AHEAD.match(text, at + end).end() - at
        yield text[at : at + ahead], end
        at += end
    yield text[at:], len(text) - at


class Chunk:
    """The words of some texts: where they are, their hashes, and which n-grams there are."""

    def __init__(self, parts: list[tuple[bytes, int, int]]):
        self.bytes = b"\n".join([p for p, _, _ in parts])
        data = _LOWER[np.frombuffer(self.bytes, np.uint8)]
        self.data = data.tobytes()
        kind = _CLASS[data]
        word = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.start)
        sizes = np.array([len(p) for p, _, _ in parts]) + 1
        begin = np.cumsum(sizes) - sizes
        own = np.searchsorted(begin, self.start, "right") - 1
        self.lang = np.array([k for _, _, k in parts])[own]
        self.counted = self.start < begin[own] + np.array([n for _, n, _ in parts])[own]

    def hashes(self) -> np.ndarray:
        return Digests(np.frombuffer(self.data, np.uint8)).of(self.start, self.end) if len(self.start) else np.zeros(0, U)

    def ngrams(self, seeds: np.ndarray):
        """n, hashes of the n-grams by their first word, and which of them are there, for each n."""
        words = self.hashes()
        h = mix64(words ^ seeds[self.lang]) if len(words) else words
        for n in range(1, MOST_WORDS + 1):
            if n > 1:
                if len(words) < n:
                    return
                h = mix64(h[:-1] * _NEXT + words[n - 1 :])
            last = len(words) - n + 1
            yield n, h, self.counted[:last] & (self.piece[:last] == self.piece[n - 1 :])

    def phrase(self, at: int, n: int) -> str:
        """Words are single-spaced in a phrase, however they are spaced in the text."""
        whole = self.data[self.start[at] : self.end[at + n - 1]]
        if n > 1 and (b"\t" in whole or b"  " in whole):
            whole = b" ".join(self.data[s:e] for s, e in zip(self.start[at : at + n], self.end[at : at + n]))
        return whole.decode()


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U)


def _chunks(batches, langs: list[str], number: dict[str, int]):
    """Chunks of the (lang, text) rows of a task; languages are numbered as they come."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            few = batch.slice(i, 64)
            for lang, text in zip(few.column(0).to_pylist(), as_bytes(few.column(1))):
                if lang not in number:
                    number[lang] = len(langs)
                    langs.append(lang)
                for part, limit in _pieces(text):
                    if parts and size + len(part) > CHUNK:
                        yield Chunk(parts)
                        parts, size = [], 0
                    parts.append((part, limit, number[lang]))
                    size += len(part)
    if parts:
        yield Chunk(parts)


class Survivors:
    """Bit tables of the n-grams that a summary kept, for one or two lengths each."""

    def __init__(self, tables: dict[int, tuple[int, np.ndarray]]):
        self.tables = tables

    def has(self, n: int, h: np.ndarray) -> np.ndarray:
        bits, table = self.tables[n]
        place = h >> U(64 - bits)
        return (table[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 != 0

    def passed(self, n: int, h: np.ndarray, there: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
        """Which n-grams may be frequent; `pairs`: which word pairs may."""
        if n > 2 and pairs is not None:
            for k in range(n - 1):
                there = there & pairs[k : k + len(there)]
        if n in self.tables:
            there = there.copy()
            spots = np.flatnonzero(there)
            there[spots] = self.has(n, h[spots])
        return there


class Totals:
    """Counts of n-grams in one task: sorted hashes that point to rows in the order in which they came."""

    def __init__(self):
        self.keys, self.rows = np.zeros(0, U), np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)
        self.came: list[tuple[pa.Array, np.ndarray, int]] = []  # phrases, languages, number of words

    def add(self, chunk: Chunk, n: int, h: np.ndarray, at: np.ndarray) -> None:
        """Count the n-grams at some places of a chunk."""
        keys, first, counts = np.unique(h[at], return_index=True, return_counts=True)
        spot = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        inside = spot < len(self.keys)
        old[inside] = self.keys[spot[inside]] == keys[inside]
        self.counts[self.rows[spot[old]]] += counts[old]
        new = ~old
        places = at[first[new]]
        self.rows = np.insert(self.rows, spot[new], np.arange(len(self.counts), len(self.counts) + len(places), dtype=np.int32))
        self.keys = np.insert(self.keys, spot[new], keys[new])
        self.counts = np.concatenate([self.counts, counts[new]])
        self.came.append((pa.array([chunk.phrase(i, n) for i in places.tolist()], pa.string()), chunk.lang[places].astype(np.int32), n))

    def batches(self, langs: list[str]):
        at = 0
        names = pa.array(langs, pa.string())
        for phrases, lang, n in self.came:
            columns = [names.take(pa.array(lang)), phrases, pa.array(np.full(len(lang), n, np.int32)), pa.array(self.counts[at : at + len(lang)])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n_words", "f"])
            at += len(lang)


def _total_words(docs: DataFrame) -> DataFrame:
    """lang, n: words of each language."""

    def run(batches):
        langs: list[str] = []
        number: dict[str, int] = {}
        total = np.zeros(0, np.int64)
        for chunk in _chunks(batches, langs, number):
            own = np.bincount(chunk.lang[chunk.counted], minlength=len(langs))
            total = np.pad(total, (0, len(langs) - len(total))) + own
        total = np.pad(total, (0, len(langs) - len(total)))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(total, pa.int64())], names=["lang", "n"])

    return docs.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def merge_summary(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Add up equal keys; beyond the capacity, take the largest count that has no place from all. Also: what was taken."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys = keys[first]
    counts = np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    at = len(keys) - capacity - 1
    taken = int(np.partition(counts, at)[at])
    left = counts > taken
    return keys[left], counts[left] - taken, taken


def frequent_keys(blocks, mass: int, threshold: int):
    """Keys of all (keys, counts) blocks that may occur `threshold` times, by a Misra-Gries summary."""
    capacity = mass // threshold + 1
    keys, counts, lost = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        return merge_summary(np.concatenate([keys, *[k for k, _ in held]]), np.concatenate([counts, *[c for _, c in held]]), capacity)

    for k, c in blocks:
        held.append((k, c))
        size += len(k)
        if size > max(capacity, 1 << 16):
            keys, counts, taken = merged()
            lost, held, size = lost + taken, [], 0
    keys, counts, taken = merged()
    return keys[counts + lost + taken >= threshold]


_BLOCK = "part int, mass long, keys binary, counts binary"


def summarise(docs: DataFrame, sizes: tuple[int, ...], partitions: int, threshold: int, known=None) -> DataFrame:
    """part, keys: what may be frequent of the n-grams of the given sizes, by hash partition (its low 32 bits are the key)."""
    top = partitions.bit_length() - 1

    def count(batches):
        langs: list[str] = []
        number: dict[str, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def done():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            part = (h >> U(64 - top)).astype(np.int64) if top else np.zeros(len(h), np.int64)
            low = ((h << U(top)) >> U(32)).astype("<u4")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(h)]]) if len(h) else [0]
            rows = [
                (int(part[a]), int(n[a:b].sum()), low[a:b].tobytes(), n[a:b].astype("<u4").tobytes())
                for a, b in zip(edges[:-1], edges[1:])
            ]
            for i in range(0, len(rows), 1024):
                columns = list(zip(*rows[i : i + 1024]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                    names=["part", "mass", "keys", "counts"],
                )

        for chunk in _chunks(batches, langs, number):
            pairs = None
            for n, h, there in chunk.ngrams(_seeds(langs)):
                if known is not None:
                    there = known.value.passed(n, h, there, pairs)
                    pairs = there if n == 2 else pairs
                if n in sizes:
                    held.append(h[there])
                    size += len(held[-1])
            if size > HELD:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    def merge(batches):
        def blocks():
            for batch in batches:
                for row in range(batch.num_rows):
                    part, mass, keys, counts = (batch.column(i)[row].as_py() for i in range(4))
                    yield part, mass, np.frombuffer(keys, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64)

        rest = blocks()
        ahead = next(rest, None)
        while ahead is not None:
            part, mass = ahead[0], ahead[1]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == part:
                    yield ahead[2], ahead[3]
                    ahead = next(rest, None)

            kept = frequent_keys(own(), mass, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([kept.astype("<u4").tobytes()], pa.binary())], names=["part", "keys"]
            )

    counted = docs.mapInArrow(count, _BLOCK)
    # the mass of a hash partition is known to each of its rows, so its summary can be made in one pass
    counted = counted.withColumn("mass", F.sum("mass").over(Window.partitionBy("part")))
    return cut_table(counted.mapInArrow(merge, "part int, keys binary"))


def _table(kept: DataFrame, partitions: int) -> tuple[int, np.ndarray]:
    """A bit table of the survivors: its number of bits (as a power of two) and the bits."""
    top = partitions.bit_length() - 1
    n = kept.agg(F.sum(F.length("keys"))).first()[0] or 0
    bits = min(FILTER_BITS, max(1 << 16, BITS_OF_SURVIVOR * n // 4)).bit_length() - 1
    bits = max(bits, top + 3)

    def run(batches):
        for batch in batches:
            rows = []
            for keys in batch.column(1).to_pylist():
                own = np.zeros(1 << (bits - top), np.uint8)
                place = np.frombuffer(keys, "<u4").astype(U)
                own[(place >> U(32 - (bits - top))).astype(np.int64)] = 1
                rows.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["part", "bits"])

    table = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (bits - top - 3)
    for row in kept.mapInArrow(run, "part int, bits binary").toLocalIterator():
        table[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bits, table


def frequent_ngrams(docs: DataFrame, threshold: int = THRESHOLD, words: int | None = None) -> DataFrame:
    """lang, phrase, n_words, f: all n-grams of up to `MOST_WORDS` words with at least `threshold` occurrences, counted exactly.

    docs: lang, text without null languages; words: how many words there are, if known.
    """
    spark = docs.sparkSession
    if words is None:
        words = _total_words(docs).agg(F.sum("n")).first()[0] or 0
    partitions = 1 << min(MOST_PARTITIONS, max(8, 2 * words // PARTITION_MASS)).bit_length()
    partitions = min(partitions, MOST_PARTITIONS)
    tables: dict[int, tuple[int, np.ndarray]] = {}
    known = None
    for sizes in ((1, 2), tuple(range(3, MOST_WORDS + 1))):
        table = _table(summarise(docs, sizes, partitions, threshold, known), partitions)
        tables |= dict.fromkeys(sizes, table)
        known = spark.sparkContext.broadcast(Survivors(dict(tables)))

    def count(batches):
        langs: list[str] = []
        number: dict[str, int] = {}
        totals = Totals()
        for chunk in _chunks(batches, langs, number):
            pairs = None
            for n, h, there in chunk.ngrams(_seeds(langs)):
                there = known.value.passed(n, h, there, pairs)
                pairs = there if n == 2 else pairs
                totals.add(chunk, n, h, np.flatnonzero(there))
            if len(totals.keys) > TOTALS_HELD:
                yield from totals.batches(langs)
                totals = Totals()
        yield from totals.batches(langs)

    counted = docs.mapInArrow(count, "lang string, phrase string, n_words int, f long")
    return counted.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)


def _parts_of(df: DataFrame, least: int, most: str) -> DataFrame:
    """Add `part`: every contiguous part of a phrase with `least` words up to one word less than the phrase."""
    words = F.split("phrase", " ")
    df = df.withColumn("_w", words).withColumn("_n", F.explode(F.expr(f"sequence({least}, {most})")))
    df = df.withColumn("_s", F.explode(F.expr("sequence(1, n_words - _n + 1)")))
    return df.withColumn("part", F.array_join(F.expr("slice(_w, _s, _n)"), " "))


def score_phrases(freq: DataFrame, factor: int = FACTOR, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of (lang, phrase, n_words, f) that no longer one replaces."""
    found = freq.where("n_words > 1").withColumnRenamed("f", "a")
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, n_words - 1)"))).withColumn("_w", F.split("phrase", " "))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.expr("slice(_w, 1, k)"), " ").alias("head"),
        F.array_join(F.expr("slice(_w, k + 1, n_words - k)"), " ").alias("tail"),
    )
    left = freq.select(F.col("lang"), F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = freq.select(F.col("lang"), F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
    score = F.expr(f"(cast(a AS decimal(19,0)) * cast({factor} AS decimal(12,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = _parts_of(freq.where("n_words > 2"), 2, "n_words - 1").groupBy("lang", F.col("part").alias("phrase"))
    around = longer.agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(
        F.expr(f"around IS NULL OR cast(around AS decimal(19,0)) * {inside[1]} < cast(a AS decimal(19,0)) * {inside[0]}")
    )
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def best_of_each(df: DataFrame, top: int, salts: int) -> DataFrame:
    """Add `rank`; the first `top` of each language by score, count and phrase, first within salts, then of what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    few = few.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return few.where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def mine(
    docs: DataFrame, top: int | None = 2000, threshold: int = THRESHOLD, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language (all of them, without rank, if `top` is None)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    totals = cut_table(_total_words(rows))
    words = totals.agg(F.sum("n")).first()[0] or 0
    freq = cut_table(frequent_ngrams(rows, threshold, words))
    scored = score_phrases(freq)
    if top is not None:
        scored = best_of_each(scored, top, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = scored.join(totals, "lang")
    return out.select("lang", *(["rank"] if top is not None else []), "phrase", "a", "l", "r", "n", "score")
