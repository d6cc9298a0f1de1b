"""Phrase mining, mixing and tokenizer alignment against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import DOC_SQL, clashing, documents, empty, multiset, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genemill.llm import alignment, mixing, phrases

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases -------------------------------------------------------------------------------------------------------


def plain_phrases(rows, threshold, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= threshold and len(p) > 1}
        inner = {
            p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
            if 100 * a >= 80 * c[p[i : i + k]]
        }
        scored = []
        for p, a in found.items():
            if p not in inner:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows(spark):
    rows = [(r.lang, r.text) for r in documents(spark).collect()]
    rows += [("en", "New  York\tcity, new york CITY. the new york city;" * 3), (None, "a a a a a a a"), ("und", "a a a"), ("en", None)]
    rows += [("de", "é é! É é " + "ß" * 50), ("abcdefghij", "x y x y"), ("abcdefghji", "x y x y")]
    return rows


@pytest.mark.parametrize("threshold,top", [(2, 50), (3, 2000)])
def test_phrases_equal_plain_counts(spark, threshold, top):
    rows = phrase_rows(spark)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = phrases.mine(clashing(df, "phrase", "n", "_w"), top, threshold)
    assert multiset(tuple(r) for r in got.collect()) == multiset(plain_phrases(rows, threshold, top))


def test_long_pieces_are_cut_without_loss(spark, monkeypatch):
    words = [f"w{i % 7}" for i in range(4000)]
    text = " ".join(words) + ". " + "\t".join(words[:900]) + " " + "z" * 300
    whole = Counter()
    monkeypatch.setattr(phrases, "CHUNK", 100)
    for part, limit in phrases._pieces(text.encode()):
        chunk = phrases.Chunk([(part, limit, 0)])
        for n, h, there in chunk.ngrams(np.zeros(1, np.uint64)):
            whole.update(chunk.phrase(i, n) for i in np.flatnonzero(there))
    expected = Counter()
    for piece in text.split("."):
        w = piece.split()
        expected.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert whole == expected


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(5)
    for threshold in (2, 5, 30):
        stream = np.concatenate([rng.zipf(1.3, 20_000) % 5000, np.repeat(np.arange(6000, 6010), threshold)]).astype(np.uint32)
        rng.shuffle(stream)
        blocks = [np.unique(b, return_counts=True) for b in np.array_split(stream, 40)]
        kept = set(phrases.frequent_keys(blocks, len(stream), threshold).tolist())
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= threshold].tolist()) <= kept
        assert len(kept) <= len(stream) // threshold + 1


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    freq = spark.createDataFrame([("x", "a", 1, big + 5), ("x", "b", 1, big + 2), ("x", "a b", 2, big)], "lang string, phrase string, n_words int, f long")
    row = phrases.score_phrases(freq).collect()[0]
    assert row.score == 2_000_000 * big // (2 * big + 7) and (row.l, row.r) == (big + 5, big + 2)


def test_phrases_of_nothing(spark):
    assert phrases.mine(empty(spark)).collect() == []
    assert phrases.mine(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).collect() == []


# --- mixing --------------------------------------------------------------------------------------------------------


def plain_mix(rows, weights=(5, 2, 1)):
    """rows: (doc_id, source, key, size) -> {source: target}, and taken words of each row, by the queue step by step."""
    size = Counter()
    for _, s, _, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, share, target = set(order), 1.5 * sum(size.values()), {}
    while left:
        level = share / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2.0 * size[s] for s in full}
        share -= sum(target[s] for s in full)
        left -= full
    entries = []
    for place, s in enumerate(order):
        own, queued = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[3])), 0
        for _ in range(2):
            for r in own:
                queued += r[3]
                if r[3]:
                    entries.append((queued / target[s], place, queued, r))
    budget, taken = 3 * sum(size.values()) // 2, Counter()
    for _, _, _, r in sorted(entries, key=lambda e: e[:3]):
        budget -= r[3]
        if budget < 0:
            break
        taken[r] += r[3]
    return target, taken


def mix_rows(spark):
    """Odd cases of the shared table, a null source, a source without words, one large document and a hot source."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents(spark).collect()]
    rows += [(900 + i, prose(i, n=20 + i), "en", "src0", 0) for i in range(60)]
    rows += [(2000, "a b c", "en", None, 5), (2001, None, "en", None, 0), (2002, " \n", "en", "void", 0), (2003, "one", "en", "é", 3)]
    return spark.createDataFrame(rows, DOC_SQL)


def test_mixture_equals_the_queue_step_by_step(spark):
    docs = mix_rows(spark)
    got = mixing.mix(clashing(docs, "place", "key", "target")).collect()
    rows = [(r.doc_id, r.source, r.key, r["size"]) for r in got]
    words = {(r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in docs.collect()}
    assert {(i, s, n) for i, s, _, n in rows} == words and len(rows) == docs.count()
    target, taken = plain_mix(rows)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r["size"]
    # rows that are equal in everything share what is taken of them
    mine = Counter()
    for r in got:
        mine[(r.doc_id, r.source, r.key, r["size"])] += r.taken
    assert +mine == +taken
    sizes = Counter()
    for _, s, _, n in rows:
        sizes[s] = max(sizes[s], n)
    for s, t in target.items():
        assert abs(sum(v for k, v in mine.items() if k[1] == s) - t) <= sizes[s]


def test_mixture_is_the_same_again_and_in_buckets(spark, monkeypatch):
    docs = mix_rows(spark)
    first = multiset(tuple(r) for r in mixing.mix(docs).collect())
    assert multiset(tuple(r) for r in mixing.mix(docs.repartition(7)).collect()) == first
    monkeypatch.setattr(mixing, "ROWS_OF_BUCKET", 3)
    assert multiset(tuple(r) for r in mixing.mix(docs).collect()) == first


def test_texts_of_the_mixture(spark):
    docs = mix_rows(spark)
    mixed = mixing.mix(docs).cache()
    out = mixing.mixture(docs, mixed)
    assert out.columns == docs.columns
    words = F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != "")).cast("long")
    assert out.agg(F.sum(words)).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_mixture_of_nothing(spark):
    assert mixing.mix(empty(spark)).collect() == []
    row = mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOC_SQL)).collect()[0]
    assert (row["size"], row.target, row.taken) == (0, 0.0, 0)


# --- alignment -----------------------------------------------------------------------------------------------------


def plain_alignment(texts):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_bytes = alignment.byte_tokens(open(A_PATH, encoding="utf-8").read())
    b_bytes = alignment.piece_tokens(open(B_PATH, "rb").read())

    def spans(ids, tokens):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(tokens[i]), i))
            at += len(tokens[i])
        return out

    found = []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or not b"".join(a_bytes[i] for i in x) == b"".join(b_bytes[i] for i in y) == f" {text}".encode():
            found.append(([], [], [], ""))
            continue
        x, y, k, pairs = spans(x, a_bytes), spans(y, b_bytes), 0, []
        for begin, end, i in x:
            while y[k][1] <= begin:
                k += 1
            j = k
            while j < len(y) and y[j][0] < end:
                pairs.append((i, y[j][2]))
                j += 1
        ends, groups, done = {e for _, e, _ in x} & {e for _, e, _ in y}, [], 0
        for e in sorted(ends):
            sides = [",".join(str(i) for s, t, i in side if done < t <= e) for side in (x, y)] if len(ends) < 400 else None
            groups.append("|".join(sides) if sides else None)
            done = e
        found.append((x, y, pairs, ";".join(groups) if None not in groups else len(ends)))
    counts = Counter(p for _, _, pairs, _ in found for p in set(pairs))
    most = Counter()
    for (i, _), c in counts.items():
        most[i] = max(most[i], c)
    return [
        (len(x), len(y), len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), groups)
        for x, y, pairs, groups in found
    ]


def alignment_docs(spark):
    odd = ["a▁b c", "x\x00y <s> </s> <unk> <|endoftext|> <0x41>", "  two  spaces \t\n tab é😀 𝒳 中文字 \xa0nb em ", " ", "q" * 2000, "I'm here, don't 123 456\x1c\x1d y"]
    rows = [(5000 + i, t, "en", "s", 0) for i, t in enumerate(odd)]
    return documents(spark).unionByName(spark.createDataFrame(rows, DOC_SQL))


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 4000])
def test_alignment_equals_plain_offsets(spark, block_bytes):
    docs = clashing(alignment_docs(spark), "n_a", "pair", "end", "links").withColumn("own", F.col("text"))
    got = alignment.align(docs, A_PATH, B_PATH, block_bytes=block_bytes).collect()
    expected = dict(zip([r.own for r in got], plain_alignment([r.own for r in got])))
    assert len(got) == docs.count()
    for r in got:
        *counts, groups = expected[r.own]
        assert [r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum] == counts, r.own and r.own[:50]
        if isinstance(groups, int):
            assert r.n_groups == groups == r.groups.count(";") + 1
        else:
            assert r.groups == groups and r.n_groups == (groups.count(";") + 1 if groups else 0)


def test_alignment_counts_copies_as_texts(spark):
    docs = spark.createDataFrame([(1, "red fish"), (1, "red fish"), (2, "red"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.doc_id, r.n_links, r.count_sum, r.groups == "") for r in alignment.align(docs, A_PATH, B_PATH, digest=True).collect()}
    assert {g for g in got if g[0] in (3, 4)} == {(3, 0, 0, True), (4, 0, 0, True)}
    assert (2, 1, 3, False) in got and (1, 2, 5, False) in got


def test_alignment_of_nothing(spark):
    assert alignment.align(empty(spark), A_PATH, B_PATH).collect() == []
