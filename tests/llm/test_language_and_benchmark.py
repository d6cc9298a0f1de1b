import random

import pytest
from helpers import DE, EN, clashing, documents, empty, multiset, prose, texts

from genemill.llm import decontaminate, lang_id


def test_language_of_held_out_texts(spark):
    rows = [(prose(i, EN if i % 3 else DE), "en" if i % 3 else "de") for i in range(120)]
    train = spark.createDataFrame(rows[:80], "text string, lang string")
    test = spark.createDataFrame(rows[80:], "text string, truth string")
    got = lang_id.predict(test, lang_id.fit(train)).collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 38
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_have_no_language(spark):
    docs = clashing(documents(spark), "score", "lang_pred", "__lid")
    got = {}
    for r in lang_id.predict(docs, lang_id.fit(docs)).collect():
        got.setdefault(r.doc_id, (r.lang_pred, r.score, r.source))
    assert {i for i, x in got.items() if x[0] == "und"} == {30, 31, 32, 33}
    assert got[30][1] == 0.0
    assert len(got) == len({i for i, _, _ in texts()})


def test_without_training_rows_nothing_is_told(spark):
    model = lang_id.fit(empty(spark))
    assert {r.lang_pred for r in lang_id.predict(documents(spark), model).collect()} == {"und"}
    assert lang_id.predict(empty(spark), model).count() == 0


def plain_naive_bayes(rows, text, buckets=1 << 16):
    """(language, posterior) from counts in dictionaries."""
    from collections import Counter
    from math import exp, log

    grams = lambda t: [b for part in lang_id.ngram_buckets(t, buckets) for b in part.tolist()]
    counts, texts = {}, Counter()
    for t, lang in rows:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
            texts[lang] += 1
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = {}
    for lang, c in counts.items():
        n = sum(c.values()) + 0.5 * buckets
        total[lang] = log(texts[lang] / sum(texts.values())) + sum(log((c[b] + 0.5) / n) for b in grams(text))
    best = max(sorted(total), key=total.get)
    return best, 1 / sum(exp(v - total[best]) for v in total.values())


@pytest.mark.parametrize("cells", [lang_id.MATRIX_CELLS, 1 << 17])
def test_predictions_equal_plain_counts(spark, monkeypatch, cells):
    monkeypatch.setattr(lang_id, "MATRIX_CELLS", cells)  # two languages a block in the second case
    kinds = {"de": DE, "en": EN, "xx": EN[:9] + DE[:9], "yy": EN[9:], "zz": DE[9:]}
    rows = [(prose(i, kinds[k], 9), k) for i, k in enumerate(sorted(kinds) * 5)] + [(None, "en"), ("stray", None), ("", "en")]
    model = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.blocks) == (1 if cells == 1 << 22 else 3)
    asked = [prose(500 + i, kinds[k], 4) for i, k in enumerate(sorted(kinds) * 3)] + ["²½", "x", "Ⅷ 12", "É", None, " "]
    got = lang_id.predict(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()
    for r in got:
        lang, score = plain_naive_bayes(rows, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3), r.text


def test_many_labels_keep_the_buckets_of_few(spark):
    few = [("aaa bbb", "a"), ("ccc ddd", "b")]
    many = few + [(f"{chr(0x4E00 + i)} {i}", f"l{i:03d}") for i in range(198)]
    model = lang_id.fit(spark.createDataFrame(many, "text string, lang string"))
    assert len(model.langs) == 200 and {b.shape[0] for b in model.blocks} == {lang_id.BUCKETS}
    got = lang_id.predict(spark.createDataFrame(few, "text string, lang string"), model).collect()
    assert [r.lang_pred for r in got] == [r.lang for r in got]


def test_pieces_of_a_long_text_give_the_same_ngrams(monkeypatch):
    import numpy as np

    text = prose(1, n=900)
    whole = np.sort(np.concatenate(list(lang_id.ngram_buckets(text, 1 << 12))))
    monkeypatch.setattr(lang_id, "STEP", 100)
    pieces = np.sort(np.concatenate(list(lang_id.ngram_buckets(text, 1 << 12))))
    assert whole.tolist() == pieces.tolist()


def brute_hits(text, items, size=13):
    """n_words, n_hit and items by looking for every window at every place."""
    import re

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    w, hit, found = words(text), set(), set()
    for name, body in items:
        b = words(body)
        for i in range(max(1, len(b) - size + 1)) if b else ():
            window = b[i : i + size]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark_rows():
    all_texts = {i: t for i, t, _ in texts()}
    return [
        (1, all_texts[0][:150]), (2, all_texts[50].upper()), (3, "One, TWO"), (4, None), (5, " . "), (10, all_texts[0][:150]),
        (10, all_texts[0][:150]), (6, "xé" + all_texts[24][:300]),
    ]


@pytest.mark.parametrize("block", [200_000, 7])
def test_hits_equal_brute_force(spark, benchmark_rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    if block == 7:  # several blocks go on from each other; few windows keep it short
        benchmark_rows = [(i, t and t[:110]) for i, t in benchmark_rows]
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    docs = clashing(documents(spark), "n_words", "items", "hits")
    got = decontaminate.contamination(docs, benchmark).collect()
    want = [(i, *brute_hits(t, benchmark_rows)) for i, t, _ in texts()]
    assert multiset((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == multiset(want)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_empty_tables(spark, benchmark_rows):
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert decontaminate.contamination(empty(spark), benchmark).count() == 0
    got = decontaminate.contamination(documents(spark), benchmark.limit(0)).collect()
    assert len(got) == len(texts()) and not any(r.n_hit or r.contaminated for r in got)


def test_random_short_windows(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 14])))) for i in range(5)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60))), None, None, None) for i in range(60)]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert multiset((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == multiset(
        (i, *brute_hits(t, items)) for i, t, *_ in docs
    )
