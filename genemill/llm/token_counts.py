"""Edit-aware token counts.

A text is cut into pre-tokens by the pattern of a byte-level BPE vocabulary, and each is counted by itself. A document
keeps a segment tree over its pre-tokens: leaves of `LEAF` pre-tokens hold their lengths and token counts, upper nodes
hold sums of both. An edit (start, length, insert) is found by walking down the tree by length; cutting begins again
two pre-tokens' context before it and ends at the first boundary after it that the old cutting also had, since from
there on both are the same. Only the pre-tokens in between are encoded, and the sums above their leaves are updated.

Edits of a document are in code points of its original text. They are taken in order of start; one that begins inside
an earlier one, before the text or after its end is moved to the nearest place where it can be. Null and empty texts
count 0 tokens and can be inserted into; null edits are none. Repeated rows are independent, texts are whole, other
columns pass through. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.llm.bpe import read_ranks
from genemill.llm.common import add_by_slices, as_texts

LEAF = 64
CACHED_PARTS, CACHED_LENGTH = 200_000, 48
CONTEXT = 2  # characters before an edit that must lie in the part that is cut again


class Counter:
    """Pre-tokens and their token counts, in one task."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
        )
        self.cache: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        cache = self.cache
        new = set(parts).difference(cache)
        extra: dict[str, int] = {}
        if new:
            if len(cache) + len(new) > CACHED_PARTS:
                cache.clear()
                new = set(parts)
            for p in new:
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= CACHED_LENGTH and len(cache) < CACHED_PARTS:
                    cache[p] = n
                else:
                    extra[p] = n
        if extra:
            return [extra[p] if p in extra else cache[p] for p in parts]
        return list(map(cache.__getitem__, parts))


class SegmentTree:
    """Leaves of pre-tokens under a binary tree of (characters, tokens)."""

    def __init__(self, leaves: list[tuple[np.ndarray, np.ndarray]]):
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        for i, (lengths, tokens) in enumerate(leaves):
            self.sums[self.width + i] = lengths.sum(), tokens.sum()
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @classmethod
    def of(cls, lengths: np.ndarray, tokens: np.ndarray) -> SegmentTree:
        return cls([(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, max(len(lengths), 1), LEAF)])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def characters(self) -> int:
        return int(self.sums[1, 0])

    def find(self, place: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, where it starts) of the pre-token that holds a place; the end belongs to the last."""
        if place >= self.characters:
            last = max((i for i, x in enumerate(self.leaves) if len(x[0])), default=0)
            lengths = self.leaves[last][0]
            if not len(lengths):
                return last, 0, 0
            return last, len(lengths) - 1, self.characters - int(lengths[-1])
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        leaf = node - self.width
        ends = start + np.cumsum(self.leaves[leaf][0])
        k = int(np.searchsorted(ends, place, "right"))
        return leaf, k, int(ends[k] - self.leaves[leaf][0][k])

    def starts_from(self, leaf: int, k: int, start: int):
        """(leaf, pre-token, start) from a pre-token on, then the end."""
        while leaf < len(self.leaves):
            for j in range(k, len(self.leaves[leaf][0])):
                yield leaf, j, start
                start += int(self.leaves[leaf][0][j])
            leaf, k = leaf + 1, 0
        yield len(self.leaves), 0, start

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], tokens: list[int]) -> None:
        """Put pre-tokens in place of those from `first` up to `last` (leaf, pre-token), and update the sums above."""
        (a, i), (b, j) = first, last
        if b == len(self.leaves):
            b, j = b - 1, len(self.leaves[-1][0])
        head, tail = self.leaves[a], self.leaves[b]
        new = np.array(lengths, np.int64), np.array(tokens, np.int64)
        if a == b:
            self.leaves[a] = tuple(np.concatenate([h[:i], n, h[j:]]) for h, n in zip(head, new))
        else:
            self.leaves[a] = tuple(np.concatenate([h[:i], n]) for h, n in zip(head, new))
            for k in range(a + 1, b):
                self.leaves[k] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            self.leaves[b] = tuple(t[j:] for t in tail)
        for k in range(a, b + 1):
            self.sums[self.width + k] = self.leaves[k][0].sum(), self.leaves[k][1].sum()
        nodes = {(self.width + k) // 2 for k in range(a, b + 1)}
        while nodes and max(nodes) >= 1:
            for n in nodes:
                self.sums[n] = self.sums[2 * n] + self.sums[2 * n + 1]
            nodes = {n // 2 for n in nodes if n > 1}

    def tobytes(self) -> bytes:
        """Leaf sizes, then lengths and token counts; the sums are rebuilt from them."""
        sizes = np.array([len(x[0]) for x in self.leaves], "<u4")
        lengths = np.concatenate([x[0] for x in self.leaves]).astype("<u4")
        tokens = np.concatenate([x[1] for x in self.leaves]).astype("<u4")
        return np.array([len(sizes), len(lengths)], "<u4").tobytes() + sizes.tobytes() + lengths.tobytes() + tokens.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> SegmentTree:
        n, m = (int(x) for x in np.frombuffer(data, "<u4", 2))
        sizes = np.frombuffer(data, "<u4", n, 8)
        lengths = np.frombuffer(data, "<u4", m, 8 + 4 * n).astype(np.int64)
        tokens = np.frombuffer(data, "<u4", m, 8 + 4 * n + 4 * m).astype(np.int64)
        at = np.cumsum(sizes)[:-1]
        return cls(list(zip(np.split(lengths, at), np.split(tokens, at))))


def build(text: str, counter: Counter) -> SegmentTree:
    parts = counter.pattern.findall(text)
    tokens = np.array(counter.counts(parts), np.int64)
    return SegmentTree.of(np.fromiter(map(len, parts), np.int64, len(parts)), tokens)


def tidy(edits: list[dict] | None, size: int) -> list[tuple[int, int, str]]:
    """Edits by start that do not overlap and lie inside the text."""
    out, last = [], 0
    for e in sorted(edits or [], key=lambda e: (e["start"] or 0, e["length"] or 0, e["insert"] or "")):
        start = min(max(e["start"] or 0, last), size)
        end = max(start, min((e["start"] or 0) + max(e["length"] or 0, 0), size))
        out.append((start, end, e["insert"] or ""))
        last = end
    return out


def edit(text: str, tree: SegmentTree, edits: list[dict] | None, counter: Counter) -> tuple[str, int]:
    """(edited text, pre-tokens that were encoded again); the tree is updated in place.

    From the last edit to the first, so that places before an edit stay as they are in the original text.
    """
    again, tail = 0, ""
    todo = tidy(edits, len(text))
    after = len(text)  # the original text from here on has become `tail`
    for start, end, insert in reversed(todo):
        tail = insert + text[end:after] + tail
        after = start
        leaf, k, restart = tree.find(max(0, start - CONTEXT))
        old = tree.starts_from(leaf, k, restart)
        shift = len(insert) - (end - start)
        # cut from the restart until a boundary of the old cutting behind the edit comes up again
        window, lengths, tokens_of, place = text[restart:start] + tail, [], [], restart
        goal = next(old)
        for m in counter.pattern.finditer(window):
            while goal[2] + shift < place and goal[0] < len(tree.leaves):
                goal = next(old)
            if goal[2] >= end and goal[2] + shift == place and place >= start + len(insert):
                break
            tokens_of.append(m.group())
            lengths.append(len(m.group()))
            place += len(m.group())
        else:
            while goal[0] < len(tree.leaves):
                goal = next(old)
        tree.replace((leaf, k), goal[:2], lengths, counter.counts(tokens_of))
        again += len(lengths)
    return text[:after] + tail, again


def _counter(spark: SparkSession, vocabulary: str, pattern: str):
    shared = spark.sparkContext.broadcast((read_ranks(vocabulary), pattern))
    made: list[Counter] = []

    def get() -> Counter:
        if not made:
            made.append(Counter(*shared.value))
        return made[0]

    return get


_LONG, _BINARY, _STRING = T.LongType(), T.BinaryType(), T.StringType()


def build_trees(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "tree") -> DataFrame:
    """Add the segment tree of each text (binary) and its number of tokens (`n_tokens`)."""
    get = _counter(docs.sparkSession, vocabulary, pattern)

    def built(texts: pa.Array) -> list[pa.Array]:
        trees = [build(t, get()) for t in as_texts(texts)]
        return [pa.array([t.tobytes() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())]

    return add_by_slices(docs, [text], [T.StructField(out, _BINARY), T.StructField("n_tokens", _LONG)], built)


def apply_edits(trees: DataFrame, edits: str, vocabulary: str, pattern: str, text: str = "text", tree: str = "tree") -> DataFrame:
    """Apply the edits of each row: text, tree and n_tokens become those of the edited text; `n_encoded_again` is added."""
    get = _counter(trees.sparkSession, vocabulary, pattern)

    def edited(texts: pa.Array, built: pa.Array, counts: pa.Array, changes: pa.Array) -> list[pa.Array]:
        rows = []
        for t, b, n, e in zip(texts.to_pylist(), built.to_pylist(), counts.to_pylist(), changes.to_pylist()):
            if e:
                own = SegmentTree.frombytes(b)
                t, again = edit(t or "", own, e, get())
                rows.append((t, own.tobytes(), own.tokens, again))
            else:
                rows.append((t, b, n, 0))
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.binary(), pa.int64(), pa.int64()))]

    fields = [(text, _STRING), (tree, _BINARY), ("n_tokens", _LONG), ("n_encoded_again", _LONG)]
    return add_by_slices(trees, [text, tree, "n_tokens", edits], [T.StructField(*f) for f in fields], edited)


def edit_documents(
    docs: DataFrame, edits_of: Callable[[str], list[dict]], vocabulary: str, pattern: str, text: str = "text"
) -> DataFrame:
    """Trees and edits in one pass, for edits that follow from the text itself.

    text, `tree` and `n_tokens` are those of the edited text; `n_before`, `n_edits` and `n_encoded_again` are added.
    """
    get = _counter(docs.sparkSession, vocabulary, pattern)

    def edited(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for t in texts.to_pylist():
            own, changes = build(t or "", get()), edits_of(t or "")
            before, again = own.tokens, 0
            if changes:
                t, again = edit(t or "", own, changes, get())
            rows.append((t, own.tobytes(), own.tokens, before, len(changes), again))
        kinds = (pa.string(), pa.binary(), *[pa.int64()] * 4)
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    fields = [(text, _STRING), ("tree", _BINARY), *[(n, _LONG) for n in ("n_tokens", "n_before", "n_edits", "n_encoded_again")]]
    return add_by_slices(docs, [text], [T.StructField(*f) for f in fields], edited)


def with_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id", out: str = "edits") -> DataFrame:
    """Add the edits of a table (doc_id, start, length, insert) to their documents.

    The edits of one document meet in its row: against one text there are no more of use than it has places.
    """
    one = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("start", "int"), ("length", "int"), ("insert", "string"))])
    own = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(one)).alias(out))
    return docs.drop(out).join(own, F.col(doc_id) == F.col("__id"), "left").drop("__id")


_LONG_NUMBER = regex.compile(r"(?<![0-9])[0-9]{4,}+")


def number_edits(text: str) -> list[dict]:
    """Edits that put `[n]` in place of every number of four digits or more, and drop lines equal to the one before."""
    out = [{"start": m.start(), "length": len(m.group()), "insert": "[n]"} for m in _LONG_NUMBER.finditer(text)]
    at, last = 0, None
    for line in text.split("\n"):
        if last is not None and line == last and line:
            out.append({"start": at - 1, "length": len(line) + 1, "insert": ""})
        at, last = at + len(line) + 1, line
    return out

