"""Language-model scores from an n-gram trie with Elias-Fano levels.

Tokens are words (ASCII letters lower-cased, split at space and U+0009 to U+000D) and one end for each text. The model
is a trigram over a bigram over an add-one unigram, each smoothed with the one below:

    q(w)      = (c(w) + 1) / (N + V + 1)
    p(w|v)    = (c(v w) + M(v) q(w)) / (c(v) + M(v)),  M(v) = 4 c(v)^0.8
    p(w|u v)  = (c(u v w) + 30 p(w|v)) / (c(u v) + 30)

Every word is predicted by itself and is a context of its own, however rare. Words above a count (the least count that
leaves at most `CONTEXTS` of them) are broadcast with their counts and written as short ids; all others are written as
their 64-bit hashes. Their tokens go to the shard of the word, which counts it; for a pair of two such words a join with
the table of word counts tells the shard of the second the count of the first.

The logarithm of a text is a sum over its tokens, and each part of it needs counts that live in one place: an n-gram
goes to the shard of its last word and the word before (of one of them if that is not broadcast), c(u v) is known where `u v` itself lives. So tokens are shuffled
once, packed, to shards of about `SHARD_TOKENS`; a shard counts its training n-grams, builds its trie (symbols and
pointers as Elias-Fano sequences, quantised logarithms), maps it from a file, and answers all its tokens by successor
search among the children of a context. What goes back is one number for each document and shard.

A document sends an n-gram once, with its count there. Word pairs and triples that hold about as many tokens as half an
average shard (found from their shares of batches, then counted exactly) are broadcast with their counts: a frequent
triple is scored where it is read and not sent, and other triples of a frequent pair are dealt to shards one by one.
Words with such a share are broadcast whatever their count in training. So no task holds all tokens of a frequent word
or pair.

Null and empty texts are one end token. Repeated rows count and are scored each; a null id counts as an empty text for
`held_out` only. Without training rows every probability is that of q. Other columns are not read.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.llm.common import as_bytes, cut, mix64

CONTEXTS = 100_000  # words that are broadcast
NONE, BEGIN, FIRST = 0, 1, 2  # symbols: no context, begin of a text, first id of a broadcast word
STRENGTH, POWER, TRIGRAM_STRENGTH = 4.0, 0.8, 30.0
SHARD_TOKENS = 1 << 21
BATCH_TOKENS = 1 << 21
LEVELS = 1 << 16  # of a quantised logarithm: steps of about 0.0001
U = np.uint64
END = U(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line end


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, and the end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, U)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    out[-1] = END
    return out


# --- compact sequences -------------------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence: low bits as they are, high bits as gaps in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(U)
        high = (values >> U(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        unary[high] = 1
        low = np.zeros((n, 0), np.uint8)
        if bits:
            low = (values[:, None] >> np.arange(bits, dtype=U) & U(1)).astype(np.uint8) if n < 1 << 16 else cls._bits(values, bits)
        return cls(n, bits, np.packbits(low.ravel()), np.packbits(unary))

    @staticmethod
    def _bits(values: np.ndarray, bits: int) -> np.ndarray:
        raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8]
        return np.unpackbits(raw, axis=1, bitorder="little")[:, :bits]

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        out = (ones - np.arange(self.n)).astype(U) << U(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            raw = np.packbits(bits, axis=1, bitorder="little")
            whole = np.zeros((self.n, 8), np.uint8)
            whole[:, : raw.shape[1]] = raw
            out |= whole.view("<u8").ravel()
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8").view(np.uint8), self.low, self.high]


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value, value of each code): LEVELS equal steps between the extremes."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(0)
    low = values.min()
    step = (values.max() - low) / (LEVELS - 1) or 1.0
    return np.rint((values - low) / step).astype(np.uint16), low + step * np.arange(LEVELS)


class Trie:
    """Three levels: word; context word before it; word before that. A child's symbol follows its parent's number."""

    def __init__(self, buffer: np.ndarray):
        self._buffer, self._at = buffer, 0
        self.bits = U(self._take(8).copy().view("<u8")[0])
        self.words, self.word_starts = self._sequence().values(), self._sequence().values()
        self.pairs, self.pair_starts = self._sequence().values(), self._sequence().values()
        self.triples = self._sequence().values()
        self.pair_value, self.pair_cost, self.triple_value = (self._quantised() for _ in range(3))

    def _take(self, n: int) -> np.ndarray:
        self._at += n
        return self._buffer[self._at - n : self._at]

    def _sequence(self) -> EliasFano:
        n, bits, low, high = (int(x) for x in self._take(32).copy().view("<u8"))
        return EliasFano(n, bits, self._take(low), self._take(high))

    def _quantised(self) -> np.ndarray:
        n, size = (int(x) for x in self._take(16).copy().view("<u8"))
        code = self._take(2 * n).copy().view("<u2")
        return self._take(8 * size).copy().view("<f8")[code]

    @staticmethod
    def build(bits: int, word: np.ndarray, v: np.ndarray, u: np.ndarray, count: np.ndarray, probability) -> bytes:
        """Bytes of the trie of distinct (word, v, u) in order, symbols of so many bits, with their counts.

        `probability(word, v, pair count)` gives p(w|v) of pairs.
        """
        new_word = np.diff(word, prepend=word[:1] + U(1)) != 0
        pair_at = np.flatnonzero(new_word | (np.diff(v, prepend=v[:1] + U(1)) != 0))
        pair_n = np.add.reduceat(count, pair_at) if len(word) else count
        word_at = np.flatnonzero(new_word[pair_at])
        parent_of_pair = np.cumsum(new_word[pair_at]) - 1
        parent_of_triple = np.repeat(np.arange(len(pair_at)), np.diff(np.append(pair_at, len(word))))
        word, v = word[pair_at], v[pair_at]
        p = probability(word.astype(np.int64), v.astype(np.int64), pair_n)
        out: list[np.ndarray] = [np.array([bits], "<u8").view(np.uint8)]
        for values in (
            word[word_at],
            np.append(word_at, len(pair_at)),
            (parent_of_pair.astype(U) << U(bits)) | v,
            np.append(pair_at, len(u)),
            (parent_of_triple.astype(U) << U(bits)) | u,
        ):
            out += EliasFano.of(values.astype(U)).parts()
        for values in (
            np.log10(p),
            np.log10(pair_n + TRIGRAM_STRENGTH),
            np.log10(count + TRIGRAM_STRENGTH * p[parent_of_triple]) if len(u) else np.zeros(0),
        ):
            code, book = quantise(values)
            out += [np.array([len(code), len(book)], "<u8").view(np.uint8), code.astype("<u2").view(np.uint8)]
            out.append(book.astype("<f8").view(np.uint8))
        return b"".join(x.tobytes() for x in out)

    def _child(self, symbols: np.ndarray, starts: np.ndarray, parent: np.ndarray, known: np.ndarray, symbol: np.ndarray):
        """Successor of a symbol among the children of a parent: (place, whether it is the symbol itself)."""
        if not len(symbols):
            return np.zeros(len(parent), np.int64), np.zeros(len(parent), bool)
        target = (parent.astype(U) << self.bits) | symbol
        at = np.searchsorted(symbols, target)
        inside = known & (at < starts[parent + 1].astype(np.int64))
        at = np.minimum(at, len(symbols) - 1)
        return at, inside & (symbols[at] == target)

    def find(self, word: np.ndarray, v: np.ndarray, u: np.ndarray):
        """(pair place, known), (triple place, known)."""
        at, last = np.searchsorted(self.words, word), max(len(self.words) - 1, 0)
        at = np.minimum(at, last)
        known = (self.words[at] == word) if len(self.words) else np.zeros(len(word), bool)
        pair, has_pair = self._child(self.pairs, self.word_starts, at, known, v)
        triple, has_triple = self._child(self.triples, self.pair_starts, pair, has_pair, u)
        return (pair, has_pair), (triple, has_triple)


def _places(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(size, first token) of each text."""
    sizes = np.array([len(x) for x in hashes])
    return sizes, np.cumsum(sizes) - sizes


def contexts(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, u): symbols of the word before each, and of the one before that."""
    v, u = np.empty_like(word), np.empty_like(word)
    v[1:], v[first] = word[:-1], BEGIN
    u[1:], u[first] = v[:-1], NONE
    return v, u


def pair_key(word: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(word * U(0x9E3779B97F4A7C15) + v)


def find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a sorted table, whether it is there) of each key."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def often(key: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur so often, in order, and how often."""
    key = np.sort(key)
    at = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    n = np.diff(np.append(at, len(key)))
    return key[at[n >= least]], n[n >= least]


class Hot:
    """Frequent pairs (w, v) and triples (w, v, u) by the keys of their hashes, and their counts in training."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray):
        self.pairs, self.triples = np.unique(pairs), np.unique(triples)
        self.pair_n, self.triple_n = np.zeros(len(self.pairs)), np.zeros(len(self.triples))

    def places(self, w: np.ndarray, v: np.ndarray, u: np.ndarray):
        """(place of the pair, known, place of the triple, known)"""
        key = pair_key(w, v)
        pair, has_pair = find(self.pairs, key)
        triple, has_triple = find(self.triples, pair_key(key, u))
        return pair, has_pair, triple, has_pair & has_triple


# --- the table of frequent words ---------------------------------------------------------------------------------


class Vocabulary:
    """Totals, and the most frequent words: hashes in order, ids from `FIRST` on, and counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, texts: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.distinct, self.texts = total, distinct, texts
        self.whole = np.count_nonzero(counts) == distinct
        self.end = self.ids(np.array([END], U))[0]
        # how often each of these symbols stands before a word
        self.before = np.concatenate([[0.0, texts], self.counts])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words: the id of a frequent one, the hash of any other."""
        if not len(self.hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at.astype(U) + U(FIRST), hashes)

    def route(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Key of the shard of a token: of its pair, or of the word (else the context) that is not broadcast."""
        known = self.known(w)
        return np.where(known & self.known(v), pair_key(w, v), mix64(np.where(known, v, w)))

    def known(self, symbols: np.ndarray) -> np.ndarray:
        """Whether symbols are ids (or no word), not hashes."""
        return symbols < U(len(self.before))

    def parts(self, before: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(M(v) q(w), c(v) + M(v)) from c(v) and c(w)."""
        m = np.maximum(STRENGTH * before**POWER, 1.0)
        return m * self.unigram(c), before + m

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.total + self.distinct + 1.0)


def _batches(batches):
    """(hashes, whether learned) of the texts of about `BATCH_TOKENS` tokens."""
    held, train, size = [], [], 0
    for batch in batches:
        for flag, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            held.append(token_hashes(t))
            train.append(bool(flag))
            size += len(held[-1])
            if size >= BATCH_TOKENS:
                yield held, train
                held, train, size = [], [], 0
    if held:
        yield held, train


def count_words(rows: DataFrame, shards: int) -> DataFrame:
    """(hash, gram, n): gram is null for the training counts of words; empty for the number of all tokens; else the
    hashes of a word, pair or triple, with its tokens in the batches where it has at least 1 / (4 shards) of all.
    """
    schema = pa.schema([("hash", pa.int64()), ("gram", pa.binary()), ("n", pa.int64())])

    def count(batches):
        for held, train in _batches(batches):
            sizes, first = _places(held)
            w = np.concatenate(held)
            held.clear()
            h, n = often(w[np.repeat(np.array(train), sizes)], 1)
            for i in range(0, len(h), 100_000):
                part = slice(i, i + 100_000)
                nulls = pa.nulls(len(h[part]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), nulls, pa.array(n[part])], schema=schema)
            v, u = contexts(w, first)
            least, total = len(w) / (4 * shards), len(w)
            grams, keys, counts = [b""], [np.zeros(1, U)], [np.array([total])]
            key = w
            for level in range(1, 4):
                parts = (w, v, u)[:level]
                if level > 1:
                    key = pair_key(key, parts[-1])
                top, n = often(key, least)
                at, hit = find(top, key)
                one = np.zeros(len(top), np.int64)
                one[at[hit]] = np.flatnonzero(hit)
                grams += [x.tobytes() for x in np.stack([x[one] for x in parts], axis=1)]
                keys.append(top)
                counts.append(n)
                w, v, u, key = w[hit], v[hit], u[hit], key[hit]  # a triple is no more frequent than its pair, nor a pair than its word
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(grams, pa.binary()), pa.array(np.concatenate(counts))], schema=schema
            )

    counted = rows.select("train", "text").mapInArrow(count, "hash long, gram binary, n long")
    return counted.groupBy("hash", "gram").agg(F.sum("n").alias("n"))


def count_hot(rows: DataFrame, hot: Hot) -> None:
    """Set the counts of frequent pairs and triples in training."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)
    schema = pa.schema([("place", pa.int64()), ("n", pa.int64())])

    def count(batches):
        hot: Hot = shared.value
        for held, _ in _batches(batches):
            w = np.concatenate(held)
            pair, has_pair, triple, has_triple = hot.places(w, *contexts(w, _places(held)[1]))
            n = np.bincount(pair[has_pair], minlength=len(hot.pairs))
            n = np.append(n, np.bincount(triple[has_triple], minlength=len(hot.triples)))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], schema=schema)

    counted = rows.where("train").select("train", "text").mapInArrow(count, "place long, n long")
    for place, n in counted.groupBy("place").agg(F.sum("n")).collect():
        if place < len(hot.pairs):
            hot.pair_n[place] = n
        else:
            hot.triple_n[place - len(hot.pairs)] = n


def vocabulary(rows: DataFrame, shards: int) -> tuple[Vocabulary, DataFrame, Hot]:
    """What is broadcast, the counts of all words, and frequent pairs and triples."""
    spark = rows.sparkSession
    counted = cut(count_words(rows, shards))
    counts = counted.where("gram IS NULL").select("hash", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens = counted.where("length(gram) = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at least 1 / (2 shards) of all tokens means at least half of that in batches where the share is 1 / (4 shards)
    grams = counted.where("length(gram) > 0").where(F.col("n") * 4 * shards >= tokens).select("gram").collect()
    grams = [np.frombuffer(r[0], U) for r in grams]
    words, pairs, triples = (np.array([g for g in grams if len(g) == k], U).reshape(-1, k) for k in (1, 2, 3))
    hot = Hot(pair_key(*pairs.T), pair_key(pair_key(*triples.T[:2]), triples.T[2]))
    if len(pairs):
        count_hot(rows, hot)
    # sixteen steps for each doubling of a count: a thousand rows at most tell from which step on words are few enough
    step = F.floor(F.log2("n") * 16)
    room, least = CONTEXTS, None
    for k, n in sorted(counts.groupBy(step.alias("k")).count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = k
    top = {r[0]: r[1] for r in counts.where(step >= least).collect()} if least is not None else {}
    wanted = np.setdiff1d(np.append(words.ravel(), pairs.ravel()), np.array([NONE, BEGIN], U))
    more = [(x,) for x in wanted.view(np.int64).tolist() if x not in top]
    if more:  # frequent words and those of frequent pairs, however rare in training
        top |= {x: 0 for (x,) in more}
        top |= {r[0]: r[1] for r in counts.join(spark.createDataFrame(more, "hash long"), "hash").select("hash", "n").collect()}
    ends = counts.where(F.col("hash") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hashes = np.array(list(top), np.int64).view(U)
    return Vocabulary(hashes, np.array(list(top.values()), np.float64), total, distinct, ends), counts, hot


# --- packing -----------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as differences, byte plane by byte plane, compressed."""
    out = []
    for a in arrays:
        d = np.diff(a, prepend=U(0)) if a.dtype == U else a
        out.append(np.ascontiguousarray(d.view(np.uint8).reshape(len(d), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(data: bytes, n: int, kinds: tuple) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        a = planes.T.copy().view(kind).ravel()
        if kind == _CONTEXT:
            a["v"] = np.cumsum(a["v"], dtype=U)
        out.append(np.cumsum(a, dtype=U) if kind == U else a)
        at += n * size
    return out


_PACKED = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
PACKED_SQL = "shard long, batch long, n long, payload binary"
_WORD, _CONTEXT, _DOC, _TIMES = U, np.dtype([("v", U), ("u", U)]), np.uint32, np.uint32


class Sender:
    """Packs the tokens of a batch of documents for the shards."""

    def __init__(self, vocab: Vocabulary, shards: int, hot: Hot | None = None):
        self.vocab, self.shards, self.hot = vocab, shards, hot or Hot(np.zeros(0, U), np.zeros(0, U))
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.ids: list = []
        self.train: list[bool] = []
        self.size = 0

    def add(self, doc_id, train: bool, text: bytes) -> None:
        self.hashes.append(token_hashes(text))
        self.ids.append(doc_id)
        self.train.append(train)
        self.size += len(self.hashes[-1])

    def rows(self, batch: int):
        """(shard, batch, n, payload) for each shard, and the batch's own facts under shard -1 - batch."""
        vocab = self.vocab
        sizes, first = _places(self.hashes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        h = np.concatenate(self.hashes)
        w = vocab.ids(h)
        v, u = contexts(w, first)
        # what a frequent word adds to the base is known here
        known = vocab.known(w)
        n = vocab.before[np.where(known, w, U(NONE)).astype(np.int64)]
        base = np.bincount(doc, np.log10(n + 1), len(sizes))
        n_known = np.bincount(doc, known & (n > 0), len(sizes))
        shard = vocab.route(w, v)
        score, sent = np.zeros(len(sizes)), slice(None)
        if len(self.hot.pairs):
            pair, has_pair, triple, has_triple = self.hot.places(h, *contexts(h, first))
            score = self._score(doc, w, v, u, pair, triple, has_triple, len(sizes))
            shard = np.where(has_pair, pair_key(shard, u), shard)
            sent = ~has_triple
        facts = pa.table(
            {
                "doc_id": pa.array(self.ids, pa.int64()),
                "train": pa.array(self.train),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(n_known.astype(np.int64)),
                "base": pa.array(base),
                "score": pa.array(score),
            }
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, facts.schema) as f:
            f.write_table(facts)
        yield -1 - batch, batch, 0, sink.getvalue().to_pybytes()
        w, v, u, doc = w[sent], v[sent], u[sent], doc[sent]
        shard = (shard[sent] % U(self.shards)).astype(np.int64)
        mark = (doc.astype(np.uint32) << np.uint32(1)) | np.array(self.train, np.uint32)[doc]
        # stable, so that equal n-grams of a document follow each other
        order = np.lexsort((u, v, w, shard))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in (w, v, u, mark):
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
        new = np.flatnonzero(new)
        times = np.diff(np.append(new, len(order))).astype(_TIMES)
        order = order[new]
        starts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(starts)).tolist():
            at = order[starts[s] : starts[s + 1]]
            context = np.empty(len(at), _CONTEXT)
            context["v"], context["u"] = np.diff(v[at], prepend=U(0)), u[at]
            yield s, batch, len(at), _pack(w[at], context, mark[at], times[starts[s] : starts[s + 1]])

    def _score(self, doc, w, v, u, pair, triple, has_triple, texts: int) -> np.ndarray:
        """Sums of each text over its frequent triples."""
        vocab, at = self.vocab, np.flatnonzero(has_triple)
        c_w, c_v = (vocab.before[np.where(vocab.known(x[at]), x[at], U(NONE)).astype(np.int64)] for x in (w, v))
        own, whole = vocab.parts(c_v, c_w)
        n = self.hot.pair_n[pair[at]]
        p = (n + own) / whole
        p = np.where(u[at] == NONE, p, self.hot.triple_n[triple[at]] + TRIGRAM_STRENGTH * p)
        cost = np.where(w[at] == vocab.end, 1.0, n + TRIGRAM_STRENGTH)
        # without a frequent triple in the batch the sums would be integers, to which no answer can be added
        return np.bincount(doc[at], np.log10(p) - np.log10(cost), texts).astype(np.float64)


def _send(shared, shards: int):
    def send(batches):
        sender, part, k = Sender(shared.value[0], shards, shared.value[1]), TaskContext.get().partitionId(), 0

        def out():
            nonlocal k
            # the number depends on the partition and the order of rows only: a task that runs again gives the same
            for row in sender.rows((part << 24) + k):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED)], schema=_PACKED)
            k += 1
            sender.clear()

        for batch in batches:
            for doc_id, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                sender.add(doc_id, train, text)
                if sender.size >= BATCH_TOKENS:
                    yield from out()
        if sender.ids:
            yield from out()

    return send


_NEED_SQL = "hash long, shard long"


def _need(shared, shards: int):
    """(hash, shard) of the contexts outside the broadcast table that a shard holds before such a word.

    The words of frequent pairs are all in the table.
    """
    schema = pa.schema([("hash", pa.int64()), ("shard", pa.int64())])

    def need(batches):
        vocab: Vocabulary = shared.value[0]
        for held, _ in _batches(batches):
            w = vocab.ids(np.concatenate(held))
            v, _ = contexts(w, _places(held)[1])
            rare = ~(vocab.known(w) | vocab.known(v))
            rare = np.stack([v[rare], vocab.route(w[rare], v[rare]) % U(shards)])
            rare = rare[:, np.lexsort(rare)]
            rare = rare[:, (np.diff(rare, axis=1, prepend=~rare[:, :1]) != 0).any(axis=0)]
            for i in range(0, rare.shape[1], 100_000):
                part = rare[:, i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], schema=schema)

    return need


def rare_counts(rows: DataFrame, counts: DataFrame, shared, shards: int) -> DataFrame:
    """(shard, hash, n): counts of contexts outside the broadcast table, for each shard that cannot count them."""
    needs = rows.select("train", "text").mapInArrow(_need(shared, shards), _NEED_SQL).distinct()
    return needs.join(counts, "hash").select("shard", "hash", "n")


def answer_shard(vocab: Vocabulary, word: np.ndarray, context: np.ndarray, train: np.ndarray, rare=None, hot=None):
    """(score part, base part, known) of each token of a shard, from the shard's own training tokens.

    `rare` are hashes and counts of contexts outside the broadcast table that are counted elsewhere.
    Pairs in `hot` have their counts there, since their triples are in many shards.
    """
    last = len(vocab.before)
    hashes = np.unique(np.concatenate([x[~vocab.known(x)] for x in (word, context["v"], context["u"])]))
    before = np.concatenate([vocab.before, np.zeros(len(hashes))])
    if rare is not None and len(hashes):
        at = np.minimum(np.searchsorted(hashes, rare[0]), len(hashes) - 1)
        mine = hashes[at] == rare[0]
        before[last + at[mine]] = rare[1][mine]
    if len(hashes):  # a word outside the table has all its tokens here, or none
        own = np.flatnonzero(~vocab.known(word))
        own = np.bincount(np.searchsorted(hashes, word[own]), train[own], len(hashes))
        before[last:] = np.maximum(before[last:], own)

    def local(x: np.ndarray) -> np.ndarray:
        return np.where(vocab.known(x), x, np.searchsorted(hashes, x).astype(U) + U(last)) if len(hashes) else x

    low = U(32)
    key, u = (local(word) << low) | local(context["v"]), local(context["u"]).astype(np.uint32)
    del word, context
    pairs, number = np.unique(key, return_inverse=True)
    key = (number.astype(U) << low) | u
    del number, u
    keys, place = np.unique(key, return_inverse=True)
    place = place.astype(np.uint32)
    del key
    count = np.bincount(place, train, len(keys))
    seen = count > 0
    pair = pairs[(keys >> low).astype(np.int64)]
    w, v, u = pair >> low, pair & U(0xFFFFFFFF), keys & U(0xFFFFFFFF)

    names = np.concatenate([np.array([NONE, BEGIN], U), vocab.hashes, hashes])

    def hot_count(w, v):
        at, hit = find(hot.pairs, pair_key(names[w], names[v]))
        return hit, hot.pair_n[at] if len(hot.pairs) else 0.0

    def pair_probability(w, v, n):
        own, whole = vocab.parts(before[v], before[w])
        if hot is not None:
            n = np.where(*hot_count(w, v), n)
        return (n + own) / whole

    with tempfile.TemporaryFile() as file:
        file.write(Trie.build(len(before).bit_length(), w[seen], v[seen], u[seen], count[seen], pair_probability))
        file.flush()
        trie = Trie(np.memmap(file, np.uint8, "r"))
    (at, has_pair), (triple, has_triple) = trie.find(w, v, u)
    wi, vi = w.astype(np.int64), v.astype(np.int64)
    own, whole = vocab.parts(before[vi], before[wi])
    lower = np.log10(own / whole)
    cost = np.full(len(keys), np.log10(TRIGRAM_STRENGTH))
    if len(trie.pairs):
        lower = np.where(has_pair, trie.pair_value[at], lower)
        cost = np.where(has_pair, trie.pair_cost[at], cost)
    if hot is not None and len(hot.pairs):
        hit, n = hot_count(wi, vi)
        lower = np.where(hit, np.log10((n + own) / whole), lower)
        cost = np.where(hit, np.log10(n + TRIGRAM_STRENGTH), cost)
    high = np.log10(TRIGRAM_STRENGTH) + lower
    if len(trie.triples):
        high = np.where(has_triple, trie.triple_value[triple], high)
    # the token itself, and its part as the context (u v) of the next one
    end = vocab.known(vocab.end) or (hashes == vocab.end).any()
    is_end = (w == local(np.array([vocab.end], U))) if end else np.zeros(len(w), bool)
    score = np.where(u == NONE, lower, high) - np.where(is_end, 0.0, cost)
    n = np.where(w < last, 0.0, before[wi])
    return score[place], np.log10(n + 1)[place], (n > 0)[place]


_ANSWER = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])


def _answer(shared):
    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # a batch's own facts pass through
            return pa.table([table["batch"], pa.array([0] * len(table), pa.int32()), table["payload"]], schema=_ANSWER)
        vocab, hot = shared.value
        # counts of rare words come as rows without a payload, the hash in the place of the batch
        is_count = pc.is_null(table["payload"])
        told, table = table.filter(is_count), table.filter(pc.invert(is_count))
        rare = told["batch"].to_numpy().view(U), told["n"].to_numpy().astype(float)
        batch = pa.array(table["batch"].to_pylist(), pa.int64())
        parts = [
            _unpack(p, n, (_WORD, _CONTEXT, _DOC, _TIMES)) for p, n in zip(table["payload"].to_pylist(), table["n"].to_pylist())
        ]
        sizes = [len(part[0]) for part in parts]
        # nothing of a shard is held twice: its parts go, and its words and contexts belong to the call
        columns = [np.concatenate(x) for x in zip(*parts)]
        del parts, told, table
        times, mark = columns.pop(), columns.pop()
        train = ((mark & np.uint32(1)) * times).astype(np.float32)
        score, base, known = answer_shard(vocab, columns.pop(0), columns.pop(), train, rare, hot)
        score *= times
        base *= times
        known = known * times
        out, start = [], 0
        for size in sizes:
            own = slice(start, start + size)
            start = own.stop
            doc = (mark[own] >> np.uint32(1)).astype(np.int64)
            n = int(doc.max()) + 1
            sums = np.bincount(doc, score[own], n).astype("<f4")
            rare = np.flatnonzero(base[own])
            base_sums = np.bincount(doc[rare], base[own][rare], n)
            some = np.flatnonzero(base_sums)
            known_sums = np.bincount(doc, known[own], n)[some].astype("<u4")
            head = np.array([n, len(some)], "<u4").tobytes()
            out.append(head + sums.tobytes() + some.astype("<u4").tobytes() + base_sums[some].astype("<f8").tobytes() + known_sums.tobytes())
        return pa.table([batch, pa.array([1] * len(out), pa.int32()), pa.array(out, pa.binary())], schema=_ANSWER)

    return answer


_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("base", pa.float64()), ("score", pa.float64())]
)


def _combine(table: pa.Table) -> pa.Table:
    """All answers for one batch, added up for each document."""
    kinds, payloads = table["kind"].to_pylist(), table["payload"].to_pylist()
    facts = pa.ipc.open_stream(payloads[kinds.index(0)]).read_all()
    n = len(facts)
    score, base = facts["score"].to_numpy().copy(), facts["base"].to_numpy().copy()
    known = facts["n_known"].to_numpy().copy()
    for kind, data in zip(kinds, payloads):
        if kind:
            size, some = (int(x) for x in np.frombuffer(data, "<u4", 2))
            at = 8
            score[:size] += np.frombuffer(data, "<f4", size, at)
            at += 4 * size
            docs = np.frombuffer(data, "<u4", some, at)
            at += 4 * some
            base[docs] += np.frombuffer(data, "<f8", some, at)
            known[docs] += np.frombuffer(data, "<u4", some, at + 8 * some)
    return pa.table([facts["doc_id"], facts["train"], facts["n_tokens"], pa.array(known), pa.array(base), pa.array(score)], schema=_SCORED)


def score_documents(docs: DataFrame, train: str = "train", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score; the rows whose `train` is true are learned."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(train).alias("train"), F.col(text).alias("text"))
    # characters say how many tokens there are, near enough to size the shards
    tokens = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 5
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // SHARD_TOKENS + 1)
    vocab, counts, hot = vocabulary(rows, shards)
    shared = spark.sparkContext.broadcast((vocab, hot))
    sent = rows.mapInArrow(_send(shared, shards), PACKED_SQL)
    if not vocab.whole:
        told = rare_counts(rows, counts, shared, shards)
        sent = sent.unionByName(told.select("shard", F.col("hash").alias("batch"), "n", F.lit(None).cast("binary").alias("payload")))
    answers = sent.groupBy("shard").applyInArrow(_answer(shared), "batch long, kind int, payload binary")
    scored = answers.groupBy("batch").applyInArrow(
        _combine, "doc_id long, train boolean, n_tokens long, n_known long, base double, score double"
    )
    scale = float(np.log10(vocab.total + vocab.distinct + 1.0))
    return scored.select(
        "doc_id",
        "train",
        "n_tokens",
        "n_known",
        F.lit(int(vocab.total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * scale).alias("base_score"),
        "score",
    )
