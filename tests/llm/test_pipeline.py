"""The pipeline against plain versions of its stages, and the contract of its module."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
from helpers import DOC_SQL, documents, empty, multiset, texts
from pyspark.sql import functions as F
from test_language_and_benchmark import brute_hits
from test_near_and_repeats import brute_components, brute_fingerprint
from test_pii_and_lm import brute_spans

import __spark_entry__ as entry
import corpus_pipeline


def masked(text):
    parts, at = [], 0
    for kind, start, end in brute_spans(text):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def brute(rows, items):
    """(doc_id, ids) of what all stages keep."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    named = sorted({(i, t) for i, t in rows if i is not None})
    ids = sorted({i for i, _ in named})
    prints = {i: brute_fingerprint(t) for i, t in named}
    first = brute_components(np.array([prints[i] for i in ids], np.uint64))
    stay = {i for k, i in enumerate(ids) if first[k] == k}
    rows = [(i, t) for i, t in named if i in stay] + sorted({(i, t) for i, t in rows if i is None})
    hits = {t: brute_hits(t, items) for _, t in rows}
    rows = [(i, t) for i, t in rows if hits[t][1] == 0 or 20 * hits[t][1] < hits[t][0]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [(i, encoding.encode_ordinary(masked(t))) for i, t in rows]


def tables(spark, tmp_path, docs):
    by_id = {i: t for i, t, _ in texts()}
    items = [(1, by_id[50][60:260]), (2, "One, TWO"), (3, None), (4, by_id[22])]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def test_run_equals_the_plain_stages(spark, tmp_path):
    folder, items = tables(spark, tmp_path, documents(spark).withColumn("extra", F.lit("more")))
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, folder).collect()]
    want = brute([(i, t) for i, t, _ in texts()], items)
    assert multiset(got) == multiset(want)
    kept = {i for i, _ in got}
    assert {1, 20, 40, None} <= kept and not kept & {10, 12, 30, 31, 33, 34, 50, 22}


def test_stages_in_turn(spark, tmp_path):
    folder, _ = tables(spark, tmp_path, documents(spark))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.schema.simpleString() == spark.createDataFrame([], DOC_SQL).schema.simpleString()
    assert docs.count() == corpus_pipeline.run(spark, folder).count()


def test_empty_documents(spark, tmp_path):
    folder, _ = tables(spark, tmp_path, empty(spark))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_everything_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert {x for x in entry.oracle_sql() if x.startswith("op")} == {"op4_quality_cascade", "op5_chat_round_trip", "op9_decontamination"}


def test_unlabelled_corpus_passes_the_language_stage(spark, tmp_path):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    lettered = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert multiset(kept.collect()) == multiset(lettered)
