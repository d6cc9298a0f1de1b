import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import clashing, documents, empty, multiset, prose, texts

from genemill.llm import simhash, suffix_dedup
from genemill.llm.components import components
from genemill.llm.sais import permuted_lcp, suffix_array

U = np.uint64


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    """Smallest place reachable for each of some numbers, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3).tolist():
            a, b = find(i), find(i + 1 + j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_classes(spark):
    rows = [(i, t) for i, t, _ in texts() if i is not None]
    got = simhash.near_duplicates(clashing(documents(spark).where("doc_id IS NOT NULL"), "value", "node", "fingerprint")).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    first = brute_components(np.array([prints[i] for i in ids], U))
    want = [(i, f"{prints[i]:016x}", ids[first[ids.index(i)]]) for i, _ in rows]
    assert multiset((r.doc_id, r.fingerprint, r.component_id) for r in got) == multiset(want)
    assert {r.component_id for r in got if r.doc_id in (30, 31, 32)} == {30}


def test_rows_without_an_id_and_empty_tables(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    assert len(got) == len(texts())
    assert {r.component_id for r in got if r.doc_id is None} == {3, None}  # a copy of document 3, and a text of its own
    assert simhash.near_duplicates(empty(spark)).count() == 0


def cloud(n, seed, flips=12):
    """Fingerprints around a few centres, so that many pairs are near and chains are long."""
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        x = int(rng.integers(0, 3)) * 0x123456789ABCDEF
        for b in rng.choice(flips, rng.integers(0, 5)):
            x ^= 1 << int(b) * 5
        out.add(x)
    return np.array(sorted(out), U)


@pytest.mark.parametrize("crowd", [1 << 15, 40])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    # with a small bound places are dealt out again, some of them twice
    values = np.concatenate([cloud(400, 1), np.random.default_rng(2).integers(0, 1 << 63, 300).astype(U)])
    values = np.unique(values)
    want = brute_components(values)
    if crowd == 40:
        import types

        # workers read the module afresh: give the bound to the function itself
        scope = dict(simhash._search.__globals__, CROWD=crowd, __name__="__main__")
        monkeypatch.setattr(simhash, "_search", types.FunctionType(simhash._search.__code__, scope))
        simhash._search.__module__ = "__main__"
    nodes = spark.createDataFrame([(int(v), i) for i, v in enumerate(values.view(np.int64).tolist()) for v in [v]], "value long, node long")
    found = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == want


def test_index_finds_every_pair():
    values = np.unique(np.concatenate([cloud(900, 3), np.random.default_rng(4).integers(0, 1 << 40, 500).astype(U)]))
    index = simhash.GrayIndex(values)
    got = {(int(index.values[i]), int(index.values[j])) for q, o in index.links() for i, j in zip(q, o)}
    want = set()
    for i, v in enumerate(index.values):
        for j in np.flatnonzero(np.bitwise_count(index.values[i + 1 :] ^ v) <= 3):
            want.add((int(v), int(index.values[i + 1 + j])))
    assert got == want
    assert (np.diff(simhash.gray_rank(index.values).astype(object)) > 0).all()


def test_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    hub = [(1000, i) for i in range(1001, 1400)] + [(1399, 1400)]
    edges = spark.createDataFrame(chain + hub + [(5, 5), (7, 6), (7, 6)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 100 for i in range(100, 401))
    assert all(got[i] == 1000 for i in range(1000, 1401))
    assert got[7] == got[6] == 6


def brute_repeats(rows, length=400):
    count = Counter(t[s : s + length] for t in rows for s in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        kept = bytes(x for x, y in zip(t, gone) if not y)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    return [
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in suffix_dedup.remove_repeats(df).collect()
    ]


def test_repeats_equal_brute_force(spark):
    rows = [(i, (t or "").encode()) for i, t, _ in texts()]
    want = [(i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows]))]
    assert multiset(removed(clashing(documents(spark), "row", "anchor", "cut"))) == multiset(want)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_in_a_table_from_a_shuffle(spark):
    """Rows keep their numbers although their order in a shuffled table isn't the same in every job."""
    docs = documents(spark).repartition(6, "source").dropDuplicates(["doc_id", "text"]).repartition(3)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows]))]
    assert multiset(removed(docs)) == multiset(want)


def edited_copies(n):
    """Texts that share long parts at other places, cut at every kind of border."""
    rng = random.Random(8)
    source = prose(77, n=500)
    out = []
    for i in range(n):
        a = rng.randrange(len(source) - 900)
        part = source[a : a + rng.choice([398, 399, 400, 401, 405, 600, 890])]
        if i % 3 == 0:
            at = rng.randrange(len(part))
            part = part[:at] + "#" + part[at + 1 :]
        out.append(prose(900 + i, n=rng.randrange(30)) + part + prose(950 + i, n=rng.randrange(30)))
    return out + ["ab" * 900, "a" * 1300, "a" * 401, "a" * 400, "a" * 399]


def test_borders_and_periods(spark):
    rows = edited_copies(60)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(brute_repeats([t.encode() for t in rows]))]
    assert multiset(removed(df)) == multiset(want)


def test_wide_anchors(spark, monkeypatch):
    rows = edited_copies(40)
    monkeypatch.setattr(suffix_dedup, "WIDE_KINDS", 3)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(brute_repeats([t.encode() for t in rows]))]
    assert multiset(removed(df)) == multiset(want)


def test_pieces_of_long_texts_and_small_chunks(spark, monkeypatch):
    import types

    rows = edited_copies(40)
    scope = dict(suffix_dedup.__dict__, CHUNK_BYTES=3000, PIECE=333, __name__="__main__")
    for name in ("_sort_shard", "_anchors", "stretches"):
        copy = types.FunctionType(getattr(suffix_dedup, name).__code__, scope, name)
        copy.__module__ = "__main__"
        scope[name] = copy
    for name in ("_sort_shard", "_anchors"):
        monkeypatch.setattr(suffix_dedup, name, scope[name])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(brute_repeats([t.encode() for t in rows]))]
    assert multiset(removed(df)) == multiset(want)


def traced_mb(batches):
    """The most that Python and numpy held while these were made."""
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in batches)
        return n, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tasks_hold_little():
    """A worker keeps the memory of its largest step: two of them and the JVM share what an executor has."""
    rng = np.random.default_rng(4)
    # as many stretches of one anchor as a shard sorts: 208 starts each, and the second half of all is equal
    n, tail = suffix_dedup.WIDE_KINDS, rng.integers(0, 256, 504, np.uint8).tobytes()
    parts = [rng.integers(0, 256, 104, np.uint8).tobytes() + tail for _ in range(n)]
    columns = [[7] * n, range(n), [1] * n, range(n), [(104 << 12) | 208] * n]
    shard = pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns] + [pa.array(parts)], names=["anchor", "digest", "copies", "row", "where", "part"]
    )
    found, most = traced_mb(suffix_dedup._sort_shard([shard]))
    assert found == n and most < 150
    held = pa.array([prose(i, n=400) for i in range(40)] * 200)
    size = held.nbytes / 1e6
    texts = pa.RecordBatch.from_arrays([pa.array(range(len(held))), held], names=["row", "text"])
    found, most = traced_mb(suffix_dedup._anchors([texts]))
    assert size > 15 and found > len(held) and most < size / 2


def test_digests_from_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000, np.uint8)
    whole = suffix_dedup.Digests(data)
    for n, length in ((4601, 400), (30, 16), (0, 16)):
        at = np.sort(rng.choice(len(data) - length + 1, n, replace=False))
        assert (suffix_dedup.digests_at(data, at, length) == whole.of(at, at + length)).all()


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, k = int(rng.integers(0, 40)), int(rng.integers(1, 5))
        text = rng.integers(0, k, n)
        s = text.tolist()
        want = sorted(range(n), key=lambda i: s[i:])
        got = suffix_array(text, k)
        assert got == want
        prefix = permuted_lcp(text, got)
        for a, b in zip(want, want[1:]):
            same = 0
            while max(a, b) + same < n and s[a + same] == s[b + same]:
                same += 1
            assert prefix[b] == same
