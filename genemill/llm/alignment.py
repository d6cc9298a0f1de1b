"""Two tokenizers aligned by the byte offsets at which their tokens end.

Texts of a slice are encoded by a byte-level BPE (A) and by a piece model (B). From there on everything is Arrow: the id
lists are flattened with their parent indices, token lengths are added up per text to end offsets, and a full outer hash
join of the ends of A and B on (text, end) gives the stretches between neighbouring ends. A stretch lies in exactly one
token of A and one of B, and two tokens that overlap share exactly one stretch: the stretches are the links. Ends that
both have close a group.

How many texts hold an id pair is counted with `Table.group_by` in each task and added up by Spark. The counts of all
pairs, at most the product of the vocabularies and in no relation to the number of texts, come back to the tasks in
blocks of whole A ids of at most `BLOCK_BYTES`, one broadcast and one map over the links for each block; usually there is
one. Tasks need nothing from each other, so a lost one is run again by itself, and no key is hot.

Encoding works on units: a text is cut at each single space between two characters that are no white space. Neither
tokenizer has a token that goes over such a place (for B this is checked on its pieces), so units are encoded by
themselves, once for each task.

Texts are encoded once: the links of each text are written as a table, from which pairs are counted and looked up.

Null and empty texts, and texts whose tokens of A or B don't spell out a space and the text, have no tokens: zeros and no
groups. Repeated rows are texts of their own. Null ids and further columns pass through. Long texts are whole; a slice
has at most `SLICE_CHARS` characters or one text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from genemill.llm.bpe import byte_characters
from genemill.llm.common import MAX_BROADCAST_BYTES, as_texts, cut_table

SLICE_CHARS = 1 << 18
KEPT_UNITS = 300_000  # of the memory of one worker, about 90 MB; later ones are encoded each time
UNIT_CHARS = 48  # longer units are encoded each time
PAIRS_HELD = 1 << 20  # rows of partial counts in a task before they are added up
BLOCK_BYTES = 32 << 20
SPACE_MARK = "▁"
# fixed value: how byte-level tokenizers cut a text
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDER = re.compile("[^\x00-\u024f]").search
_CUT = re.compile(r"(?<=\S) (?=\S)").split
_WIDE = re.compile(r"\s\s").search
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_tokens(spec: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE, from its serialised form."""
    data = json.loads(spec)
    if data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
        raise ValueError("not a plain byte-level tokenizer")
    value = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * (max([*data["model"]["vocab"].values(), *[t["id"] for t in data["added_tokens"]]]) + 1)
    for token, i in data["model"]["vocab"].items():
        out[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
    return out


def piece_tokens(model: bytes) -> list[bytes]:
    """Bytes of each id of a piece model."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    if any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names):
        raise ValueError("a piece goes over the begin of a word")
    found = [(_BYTE.fullmatch(n) if pieces.is_byte(i) else None, n) for i, n in enumerate(names)]
    return [bytes([int(m[1], 16)]) if m else n.replace(SPACE_MARK, " ").encode() for m, n in found]


def units_of(text: str) -> list[str]:
    """The text cut at single spaces between two characters that are no white space."""
    if not text:
        return []
    # without two white spaces in a row and none at the ends, every space is such a place
    if _WIDE(text) or text[0].isspace() or text[-1].isspace():
        return _CUT(text)
    return text.split(" ")


def _cut_joined(encode, sizes: np.ndarray, units: list[str]) -> list[bytes]:
    """Ids of each unit with a space before it: all are encoded as one text, cut where the bytes of a unit end."""
    if not units:
        return []
    ids = np.array(encode(f" {' '.join(units)}"), "<i4")
    ends = np.cumsum([len(u) + 1 if u.isascii() else len(u.encode()) + 1 for u in units])
    upto = np.cumsum(sizes[ids])
    cuts = np.searchsorted(upto, ends)
    if not np.array_equal(upto[np.minimum(cuts, len(ids) - 1)], ends):
        raise ValueError("a token goes over the begin of a word")
    raw, cuts = ids.tobytes(), ((cuts + 1) * 4).tolist()
    return [raw[i:j] for i, j in zip([0, *cuts], cuts)]


class Pair:
    """Both tokenizers in one task; units that come again are kept."""

    def __init__(self, spec: str, model: bytes, a_tokens: list[bytes], b_tokens: list[bytes]):
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_tokens, self.b_tokens = a_tokens, b_tokens
        self.sizes = tuple(np.array([len(t) for t in tokens]) for tokens in (a_tokens, b_tokens))
        # the same merges in another implementation, for short units in characters that no Unicode version classes anew
        n = len(json.loads(spec)["model"]["merges"]) + 256
        ranks = {t: i for i, t in enumerate(a_tokens[:n])}
        self.quick = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = tuple(pa.array([len(t) for t in tokens], pa.int64()) for tokens in (a_tokens, b_tokens))
        self.names = tuple(pa.array([str(i) for i in range(len(tokens))]) for tokens in (a_tokens, b_tokens))
        self.kept: dict[str, tuple[bytes, bytes]] = {}

    def _a(self, units: list[str]) -> list[bytes]:
        """Ids of A of each unit with a space before it."""
        plain = [len(u) <= UNIT_CHARS and not _WIDER(u) for u in units]
        fast = iter(_cut_joined(self.quick.encode_ordinary, self.sizes[0], [u for u, p in zip(units, plain) if p]))
        whole = lambda t: self.a.encode(t, add_special_tokens=False).ids
        rest = iter(_cut_joined(whole, self.sizes[0], [u for u, p in zip(units, plain) if not p]))
        return [next(fast) if p else next(rest) for p in plain]

    def _b(self, units: list[str]) -> list[bytes]:
        """Ids of B of each unit after a space that B adds; none if they don't spell it."""
        plain = [SPACE_MARK not in u for u in units]
        joined = " ".join([u for u, p in zip(units, plain) if p])
        ids = self.b.encode(joined)
        if b"".join([self.b_tokens[i] for i in ids]) == f" {joined}".encode():
            fast = iter(_cut_joined(lambda _: ids, self.sizes[1], [u for u, p in zip(units, plain) if p]))
        else:
            plain = [False] * len(units)
            fast = iter(())
        out = []
        for unit, p in zip(units, plain):
            if p:
                out.append(next(fast))
            else:
                own = self.b.encode(unit)
                same = b"".join([self.b_tokens[i] for i in own]) == f" {unit}".encode()
                out.append(array("i", own).tobytes() if same else b"")
        return out

    def _encode(self, units: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of A and of B, none of either where B doesn't spell the unit; A always does."""
        return {u: (x if y else b"", y) for u, x, y in zip(units, self._a(units), self._b(units))}

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of A and of B of each text; none where one of them doesn't spell the text."""
        units = [units_of(t) for t in texts]
        each = pa.array([u for own in units for u in own], pa.string()).dictionary_encode()
        names = each.dictionary.to_pylist()
        kept = self.kept
        new = [u for u in names if u not in kept]
        found = self._encode(new) if new else {}
        coded = [kept[u] if u in kept else found[u] for u in names]
        room = max(0, KEPT_UNITS - len(kept))
        kept.update(islice(((u, f) for u, f in found.items() if len(u) <= UNIT_CHARS), room))
        which = each.indices.to_numpy()
        starts = np.concatenate([[0], np.cumsum([len(own) for own in units])]).astype(np.int64)
        # a text with a unit that isn't spelt has no tokens
        bad = np.array([not x for x, _ in coded] + [False])
        wrong = np.concatenate([[0], np.cumsum(bad[which])])
        wrong = wrong[starts[1:]] > wrong[starts[:-1]]
        lists = []
        for side in (0, 1):
            own = _lists([x[side] for x in coded]).take(each.indices)
            ends = own.offsets.to_numpy()[starts] - own.offsets[0].as_py()
            values = own.flatten()
            whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            if wrong.any():
                whole = pc.if_else(pa.array(wrong), pa.scalar([], whole.type), whole)
            lists.append(whole)
        return lists[0], lists[1]


def _lists(parts: list[bytes]) -> pa.ListArray:
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _ends(ids: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """(text, end, place of the token): the byte offset in its text at which each token ends."""
    text = pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(lengths.take(ids.flatten()))
    # a running sum for each text: less what the texts before have
    first = pc.cast(ids.offsets, pa.int64()).take(text)
    before = pc.if_else(pc.equal(first, 0), 0, upto.take(pc.max_element_wise(pc.subtract(first, 1), 0)))
    return pa.table({"text": text, "end": pc.subtract(upto, before), name: pa.array(np.arange(len(text)))})


def links(a: pa.ListArray, b: pa.ListArray, lengths: tuple[pa.Array, pa.Array]) -> pa.Table:
    """(text, a, b, shut) in order of the text: places of overlapping tokens, and whether both end there."""
    ends = _ends(a, lengths[0], "a"), _ends(b, lengths[1], "b")
    both = ends[0].join(ends[1], ["text", "end"], join_type="full outer", use_threads=False)
    both = both.sort_by([("text", "ascending"), ("end", "ascending")]).combine_chunks()
    shut = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    # a stretch lies in the token that ends next; both sides of a text end together
    filled = [pc.fill_null_backward(both[c]) for c in ("a", "b")]
    return pa.table({"text": both["text"], "a": filled[0], "b": filled[1], "shut": shut}).combine_chunks()


def _lists_of(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Values as lists that end after the given places."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 1]).astype(np.int32)), values)


def groups_text(found: pa.Table, a: pa.ListArray, b: pa.ListArray, names: tuple[pa.Array, pa.Array]) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each text; empty without tokens."""
    shut = found.filter(found["shut"])
    sides = [
        pc.binary_join(_lists_of(shut[c].to_numpy(), own.take(ids.flatten())), ",")
        for c, ids, own in (("a", a, names[0]), ("b", b, names[1]))
    ]
    groups = pc.binary_join_element_wise(*sides, "|")
    offsets = np.searchsorted(shut["text"].to_numpy(), np.arange(len(a) + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), groups), ";").to_pylist()


def _per_text(found: pa.Table, n: int, values: np.ndarray | None = None) -> np.ndarray:
    """Rows, or the sum of their values, of each text."""
    edges = np.searchsorted(found["text"].to_numpy(), np.arange(n + 1))
    sums = np.concatenate([[0], np.cumsum(np.ones(len(found), np.int64) if values is None else values)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _slices(texts: pa.Array):
    """(first, texts) of slices with a bounded number of characters."""
    held: list[str] = []
    first = size = 0
    for i in range(0, len(texts), 256):
        for k, t in enumerate(as_texts(texts.slice(i, 256)), i):
            if held and size + len(t) > SLICE_CHARS:
                yield first, held
                held, first, size = [], k, 0
            held.append(t)
            size += len(t)
    if held:
        yield first, held


_made: dict[str, Pair] = {}  # in a worker, which runs one task after another


def _shared(spark: SparkSession, a_path: str, b_path: str):
    """A function that gives a task its tokenizers, and the bytes of all ids of A."""
    with open(a_path, encoding="utf-8") as f:
        spec = f.read()
    with open(b_path, "rb") as f:
        model = f.read()
    tokens = byte_tokens(spec), piece_tokens(model)
    if len(spec) + len(model) > MAX_BROADCAST_BYTES:
        raise ValueError("the vocabularies are too large to send to every task")
    shared = spark.sparkContext.broadcast((spec, model, *tokens))
    name = hashlib.sha256(spec.encode() + model).hexdigest()

    def get() -> Pair:
        if name not in _made:
            _made.clear()
            _made[name] = Pair(*shared.value)
        return _made[name]

    return get


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def link_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """All columns but the text, with n_a, n_b, n_groups, n_links, groups (with `digest`, their SHA-256) and links.

    links: the id pair of each link in order, `a << 32 | b` in eight bytes. The table is written, so texts are encoded once.
    """
    get = _shared(docs.sparkSession, a_path, b_path)
    made = [*_COUNTS, "groups", "links"]
    kept = [c for c in docs.columns if c != text and c not in made]

    def run(batches):
        for batch in batches:
            for at, texts in _slices(batch.column(len(kept))):
                pair, part = get(), batch.slice(at, len(texts))
                a, b = pair.encode(texts)
                found = links(a, b, pair.lengths)
                ids = [x.flatten().take(found[c].combine_chunks()).to_numpy().astype("<i8") for x, c in ((a, "a"), (b, "b"))]
                groups = groups_text(found, a, b, pair.names)
                if digest:
                    groups = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in groups]
                shut = _per_text(found, len(texts), found["shut"].to_numpy(zero_copy_only=False).astype(np.int64))
                edges = np.searchsorted(found["text"].to_numpy(), np.arange(len(texts) + 1)) * 8
                raw = pa.py_buffer((ids[0] << 32 | ids[1]).tobytes())
                own = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), raw])
                sizes = [pc.cast(pc.list_value_length(x), pa.int64()) for x in (a, b)]
                new = [*sizes, pa.array(shut), pa.array(np.diff(edges) // 8), pa.array(groups, pa.string()), own]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + new, names=kept + made)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} long" for c in _COUNTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in [*kept, text]])
    return cut_table(rows.mapInArrow(run, ", ".join([*fields, "groups string", "links binary"])), "zstd")


def _few(batch: pa.RecordBatch, column: int):
    """(first row, number of rows, text of each link, pair of each link), some rows at a time."""
    held = batch.column(column).cast(pa.large_binary())
    ends = pc.cumulative_sum(pc.binary_length(held)).to_numpy()
    at = 0
    while at < len(held):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + 8 * SLICE_CHARS)))
        sizes = np.diff(ends[at:stop], prepend=before) // 8
        pairs = np.frombuffer(b"".join(held.slice(at, stop - at).to_pylist()), "<i8")
        yield at, stop - at, np.repeat(np.arange(stop - at), sizes), pairs
        at = stop


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, n_docs: how many rows of `link_documents` hold the ids a and b in overlapping tokens."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for _, _, text, pairs in _few(batch, 0):
                own = pa.table({"text": text, "pair": pairs}).group_by(["text", "pair"], use_threads=False).aggregate([])
                own = own.group_by("pair", use_threads=False).aggregate([([], "count_all")])
                held.append(own.rename_columns(["pair", "n_docs"]))
                size += len(own)
                if size > PAIRS_HELD:
                    held = [_added(held)]
                    size = 0
                    if len(held[0]) > PAIRS_HELD // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from _added(held).to_batches()

    counts = linked.select("links").mapInArrow(run, "pair long, n_docs long")
    counts = counts.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    return counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n_docs")


def _added(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n_docs", "sum")])
    return whole.rename_columns(["pair", "n_docs"])


def _blocks(counts: DataFrame, limit: int):
    """Arrays (pair, n_docs, most: whether it is the highest of its A id), sorted, of whole A ids; bounded by `limit` bytes."""
    per_a = counts.groupBy("a").agg(F.count("*").alias("n"), F.max("n_docs").alias("most")).orderBy("a")
    ids = per_a.toArrow()  # a row for each id of A's vocabulary at most
    a, n, most = (ids[c].to_numpy() for c in ("a", "n", "most"))
    block = np.cumsum(n) * 17 // limit
    for k in np.unique(block) if len(a) else [0]:
        own = a[block == k]
        rows = counts.where(F.col("a").between(int(own[0]), int(own[-1]))).toArrow() if len(own) else counts.limit(0).toArrow()
        pair = rows["a"].to_numpy() << 32 | rows["b"].to_numpy()
        order = np.argsort(pair)
        n_docs = rows["n_docs"].to_numpy()[order]
        yield pair[order], n_docs, n_docs == most[np.searchsorted(a, rows["a"].to_numpy()[order])]


def align(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """What `link_documents` gives without the links, and n_best and count_sum, for every row."""
    linked = link_documents(docs, a_path, b_path, text, digest)
    counts = cut_table(pair_counts(linked))
    names = [c for c in linked.columns if c not in ("links", "n_best", "count_sum")]
    out = linked.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "links")
    for block in _blocks(counts, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            pair, n_docs, best = shared.value
            for batch in batches:
                for at, n, text, own in _few(batch, len(names) + 2):
                    # every pair of the slice once, then back to its links
                    each, which = np.unique(own, return_inverse=True)
                    spot = np.minimum(np.searchsorted(pair, each), max(len(pair) - 1, 0))
                    there = pair[spot] == each if len(pair) else np.zeros(len(each), bool)
                    values = np.zeros((2, len(each)), np.int64)
                    values[:, there] = best[spot[there]], n_docs[spot[there]]
                    edges = np.searchsorted(text, np.arange(n + 1))
                    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, which], axis=1)], axis=1)
                    part = batch.slice(at, n)
                    columns = [part.column(i) for i in range(batch.num_columns)]
                    for k, own_sums in enumerate(sums[:, edges[1:]] - sums[:, edges[:-1]], len(names)):
                        columns[k] = pc.add(columns[k], pa.array(own_sums))
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.drop("links")
