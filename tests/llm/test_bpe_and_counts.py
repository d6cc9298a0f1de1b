import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import clashing, documents, empty, multiset, texts

from genemill.llm import bpe, token_counts

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_of_the_vocabulary_encodes_to_itself():
    codec = bpe.Codec(bpe.read_ranks(VOCABULARY), PATTERN)
    for i, token in enumerate(codec.tokens):
        assert codec.decode(np.array([i], "<u4").tobytes()) == token


def test_ids_equal_the_library_and_decode_to_the_text(spark, reference):
    got = bpe.round_trip(clashing(documents(spark), "ids", "decoded", "coded"), VOCABULARY, PATTERN).collect()
    want = [(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in texts()]
    assert multiset((r[0], np.frombuffer(r[1], "<u4").tolist(), bytes(r[2])) for r in got) == multiset(want)
    assert bpe.round_trip(empty(spark), VOCABULARY, PATTERN).count() == 0


def test_odd_characters(reference):
    codec = bpe.Codec(bpe.read_ranks(VOCABULARY), PATTERN)
    rng = random.Random(3)
    signs = "aé€\U0001f600▁  ­\x00\x01\t\n'1٣ſ<unk></s>"
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_cache_limit_does_not_change_ids(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PARTS", 5)
    codec = bpe.Codec(bpe.read_ranks(VOCABULARY), PATTERN)
    for _, text, _ in texts():
        assert np.frombuffer(codec.encode(text or ""), "<u4").tolist() == reference.encode_ordinary(text or "")


def test_edits_equal_a_whole_recount(reference):
    counter = token_counts.Counter(bpe.read_ranks(VOCABULARY), PATTERN)
    rng = random.Random(1)
    signs = "ab é 1'st\n  .,"

    def some(n):
        return "".join(rng.choice(signs) for _ in range(n))

    for _ in range(500):
        text = some(rng.choice([0, 1, 5, 30, 400]))
        tree = token_counts.build(text, counter)
        for _ in range(2):
            edits = [
                {"start": rng.randint(-1, len(text) + 1), "length": rng.choice([0, 1, 3, 20, 200]), "insert": some(rng.choice([0, 1, 4]))}
                for _ in range(rng.randint(0, 6))
            ]
            want, last = "", 0
            for start, end, insert in token_counts.tidy(edits, len(text)):
                want, last = want + text[last:start] + insert, end
            want += text[last:]
            tree = token_counts.SegmentTree.frombytes(tree.tobytes())
            text, _ = token_counts.edit(text, tree, edits, counter)
            assert text == want
            assert tree.tokens == len(reference.encode_ordinary(want))
            assert tree.characters == len(want)


def test_only_the_touched_part_is_encoded_again():
    counter = token_counts.Counter(bpe.read_ranks(VOCABULARY), PATTERN)
    text = "word " * 5000
    tree = token_counts.build(text, counter)
    _, again = token_counts.edit(text, tree, [{"start": 12_000, "length": 3, "insert": "x"}], counter)
    assert again < 6


def test_edits_of_documents(spark, reference):
    docs = clashing(documents(spark), "tree", "n_tokens", "edits")
    edits = spark.createDataFrame(
        [(0, 3, 5, "new words"), (0, 0, 0, "Begin "), (31, 0, 0, "filled"), (40, 20_000, 9, ""), (99, 0, 1, "none")],
        "doc_id long, start int, length int, insert string",
    )
    trees = token_counts.build_trees(docs, VOCABULARY, PATTERN)
    done = token_counts.apply_edits(token_counts.with_edits(trees, edits), "edits", VOCABULARY, PATTERN)
    rows = done.select("doc_id", "text", "n_tokens", "n_encoded_again", "source").collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert r.n_tokens == len(reference.encode_ordinary(r.text or ""))
        assert (r.n_encoded_again > 0) == (r.doc_id in (0, 31, 40))
    assert {r.text for r in rows if r.doc_id == 31} == {"filled"}
    assert next(r.text for r in rows if r.doc_id == 0).startswith("Begin ")
    assert token_counts.build_trees(empty(spark), VOCABULARY, PATTERN).count() == 0


def test_cleaning_edits_are_in_code_points():
    edits = token_counts.number_edits("é 12345 x\nsame\nsame\nend")
    assert [(e["start"], e["length"], e["insert"]) for e in edits] == [(2, 5, "[n]"), (14, 5, "")]
