import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, documents, empty, multiset, prose, texts
from pyspark.sql import functions as F

from genemill.llm import lm, pii
from genemill.llm.common import held_out


def brute_spans(text):
    t, out = text or "", []

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    import random

    rng = random.Random(4)
    signs = ["a", "Z", "@", ".", "-", "+", "1", "0", "255", "4111111111111111", " ", "(", "é", "%", "_", "\n"]
    for _ in range(6000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == brute_spans(text), text
    for _, text, _ in texts():
        assert pii.base_spans(text or "") == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000):
        pii.base_spans(text)
        pii.instances(text, [])


def test_extraction_keeps_base_spans(spark):
    got = pii.extract(clashing(documents(spark), "row", "spans", "base")).collect()
    want = [(i, brute_spans(t)) for i, t, _ in texts()]
    assert multiset((r.doc_id, [tuple(x) for x in r.base]) for r in got) == multiset(want)
    for r in got:
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}
    assert pii.extract(empty(spark)).count() == 0


def planted():
    """Addresses after a cue; some are written so that no plain pattern takes them. A common word stands before both."""
    rows = []
    for i in range(12):
        rows.append((i, f"{prose(i, n=20)} my mail: user{i}@host{i}.example.org {prose(50 + i, n=20)}"))
    rows.append((20, f"{prose(90, n=20)} my mail: person@localhost {prose(91, n=20)}"))
    rows += [(30 + i, f"{prose(70 + i, n=20)} the order: item{i}0{i} {prose(80 + i, n=20)}") for i in range(9)]
    return rows


def test_patterns_find_unseen_identifiers_and_leave_others(spark):
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    got = {r.doc_id: (r.base, r.spans) for r in pii.extract(df).collect()}
    text = dict(planted())[20]
    assert [text[x.start : x.end] for x in got[20][1]] == ["person@localhost"]
    assert all(not spans for i, (_, spans) in got.items() if i >= 30)
    masked = {r.doc_id: r.text for r in pii.mask(clashing(df, "row", "found")).collect()}
    assert "[EMAIL]" in masked[20] and "person@localhost" not in masked[20]
    assert masked[31] == dict(planted())[31]


def test_masking_keeps_rows_and_nulls(spark):
    got = pii.mask(documents(spark)).collect()
    assert len(got) == len(texts())
    by_id = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert by_id[30] is None and by_id[31] == ""
    assert by_id[60] == "write to [EMAIL] or [PHONE], card [CARD], host 10.0.0.256 and [IP]"
    assert pii.mask(empty(spark)).count() == 0


# --- language model ----------------------------------------------------------------------------------------------


def brute_scores(rows):
    """(doc_id, n_tokens, n_known, N, base, score) from dictionaries; all words are frequent here."""
    toks = [(i, train, (t or "").encode().lower().split() + [b"\n"]) for i, train, t in rows]
    c = Counter(w for _, train, ts in toks if train for w in ts)
    total, distinct = sum(c.values()), len(c)

    def contexts(ts):
        names = [w if w in c else "rare" for w in ts]
        for k, w in enumerate(ts):
            v = names[k - 1] if k else "begin"
            yield w, v, None if v in ("rare", "begin") else names[k - 2] if k > 1 else "begin"

    pairs, triples, before = Counter(), Counter(), Counter()
    for _, train, ts in toks:
        for w, v, u in contexts(ts) if train else ():
            pairs[v, w] += 1
            before[v] += 1
            if u is not None:
                triples[u, v, w] += 1
                before[u, v] += 1
    out = []
    for i, _, ts in toks:
        score = 0.0
        for w, v, u in contexts(ts):
            q = (c[w] + 1) / (total + distinct + 1)
            m = max(lm.STRENGTH * before[v] ** lm.POWER, 1)
            p = (pairs[v, w] + m * q) / (before[v] + m)
            if u is not None:
                p = (triples[u, v, w] + lm.TRIGRAM_STRENGTH * p) / (before[u, v] + lm.TRIGRAM_STRENGTH)
            score += math.log10(p)
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ts)
        out.append((i, len(ts), sum(c[w] > 0 for w in ts), total, base, score))
    return out


def check_scores(got, want):
    key = lambda x: tuple(-1 if v is None else round(v, 2) for v in (x[0], x[1], x[2], x[4]))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4]
        assert abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))
        assert abs(a[5] - b[5]) < 1e-3 * max(1, abs(b[5]))


def test_scores_equal_dictionaries(spark):
    docs = documents(spark).withColumn("train", ~held_out(F.col("doc_id"), 7))
    flag = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    got = lm.score_documents(clashing(docs, "n_tokens", "base", "batch")).collect()
    check_scores(got, brute_scores([(i, flag(i), t) for i, t, _ in texts()]))


@pytest.mark.parametrize("train", [True, False])
def test_all_or_nothing_is_learned(spark, train):
    rows = [(1, "a b a b c"), (2, None), (3, "A b")]
    df = spark.createDataFrame([(i, t, train) for i, t in rows], "doc_id long, text string, train boolean")
    check_scores(lm.score_documents(df).collect(), brute_scores([(i, train, t) for i, t in rows]))
    assert lm.score_documents(df.limit(0)).count() == 0


def test_a_small_table_of_contexts_gives_probabilities(spark, monkeypatch):
    """Rare words share a context; the probabilities of all words after a context still add up to less than 1."""
    rng = np.random.default_rng(1)
    tokens = rng.zipf(1.4, 4000)
    tokens = tokens[tokens < 300]
    text = " ".join(f"w{x}" for x in tokens).encode()
    h = lm.token_hashes(text)
    names, counts = np.unique(h, return_counts=True)
    top = np.argsort(-counts)[:20]
    vocab = lm.Vocabulary(names[top], counts[top].astype(float), len(h), len(names), 1)
    sender = lm.Sender(vocab, 1)
    sender.add(1, True, text)
    for w in names.tolist():  # every known word after `w1 w1` and after a rare word
        sender.hashes.append(np.array([lm.xxhash.xxh64_intdigest(b"w1"), lm.xxhash.xxh64_intdigest(b"w1"), w], lm.U))
        sender.ids.append(2)
        sender.train.append(False)
    rows = list(sender.rows(0))
    word, context, mark = lm._unpack(rows[1][3], rows[1][2], (lm._WORD, lm._CONTEXT, lm._DOC))
    score, _, _ = lm.answer_shard(vocab, word, context, (mark & 1).astype(float))
    doc = (mark >> 1).astype(int)
    total = np.bincount(doc, score)[1:]
    pair = total - np.log10(1.0)
    first = pair.min()
    # the first two tokens cost the same everywhere, so the last ones differ by their probabilities
    ratios = 10 ** (pair - pair.max())
    assert np.isfinite(first) and ratios.max() == 1.0


@pytest.mark.parametrize("contexts", [0, 1, 8, 100])
def test_words_beyond_the_broadcast_table_are_contexts_of_their_own(spark, monkeypatch, contexts):
    monkeypatch.setattr(lm, "CONTEXTS", contexts)
    rng = np.random.default_rng(3)
    rows = [(i, i % 5 > 0, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 60), 90))) for i in range(40)]
    df = spark.createDataFrame([(i, t, train) for i, train, t in rows], "doc_id long, text string, train boolean")
    check_scores(lm.score_documents(df.repartition(3)).collect(), brute_scores(rows))


@pytest.mark.parametrize("contexts", [0, 100])
def test_no_shard_holds_the_tokens_of_a_frequent_pair(spark, monkeypatch, contexts):
    monkeypatch.setattr(lm, "CONTEXTS", contexts)
    rows = [(i, i % 4 > 0, "again " * 200) for i in range(30)]
    rows += [(100 + i, i % 4 > 0, f"{prose(i, n=150)} of the w{i} of the x{i} w{i} of the {prose(900 + i, n=9)}") for i in range(60)]
    df = spark.createDataFrame([(i, t, train) for i, train, t in rows], "doc_id long, text string, train boolean")
    check_scores(lm.score_documents(df.repartition(3)).collect(), brute_scores(rows))
    shards = 8
    vocab, _, hot = lm.vocabulary(df, shards)
    sender = lm.Sender(vocab, shards, hot)
    for i, train, t in rows:
        sender.add(i, train, t.encode())
    facts, *sent = sender.rows(0)
    total = sum(len(lm.token_hashes(t.encode())) for _, _, t in rows)
    times = [sum(lm._unpack(r[3], r[2], (lm._WORD, lm._CONTEXT, lm._DOC, lm._TIMES))[3].tolist()) for r in sent]
    assert sum(times) < total * 0.7 and max(times) < total / shards
    assert lm.pair_key(*(lm.token_hashes(b"again again")[:2, None])) in hot.pairs


def test_a_batch_without_a_frequent_triple_is_scored(spark):
    """Frequent pairs and triples elsewhere; the second partition, a batch of its own, has none of them."""
    rows = [(i, i % 4 > 0, "again " * 200) for i in range(30)]
    few = [(100, True, "other words here"), (101, False, None)]
    parts = spark.sparkContext.parallelize([rows, few], 2).flatMap(lambda part: [(i, t, train) for i, train, t in part])
    df = spark.createDataFrame(parts, "doc_id long, text string, train boolean")
    assert len(lm.vocabulary(df, 4)[2].triples)
    check_scores(lm.score_documents(df).collect(), brute_scores(rows + few))


def test_compact_sequences_and_tries():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 100, 5000):
        for top in (1, 50, 1 << 40, (1 << 64) - 1):
            x = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (lm.EliasFano.of(x).values() == x).all()
    size = sum(p.nbytes for p in lm.EliasFano.of(np.sort(rng.integers(0, 1 << 40, 100_000, dtype=np.uint64))).parts())
    assert size < 100_000 * 8 * 0.45  # about 2 + log2(2^40 / n) bits each


def test_digests_are_stable():
    assert hashlib.sha256(lm.token_hashes(b"A b\x1fc\n").tobytes()).hexdigest()[:6] == hashlib.sha256(lm.token_hashes(b"a B\x1fc").tobytes()).hexdigest()[:6]


def test_long_identifiers_are_whole():
    from genemill.llm import pii

    value = "1a" * 2500
    text = "Reference " + "w" * 300 + f' id ("{value}"), next x1y2z3'
    first, second = pii.instances(text, [])
    assert text[first["start"] : first["end"]] == value and text[second["start"] : second["end"]] == "x1y2z3"
    assert first["patterns"] == ["l " + "w" * 300 + " id", "b id next"]
