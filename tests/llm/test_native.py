"""Quality cascade and chat formatting: Spark expressions only."""

import hashlib
import re
from collections import Counter

from helpers import clashing, documents, empty, multiset, texts
from pyspark.sql import functions as F

from genemill.llm import chat, quality
from genemill.llm.queries import op5_chat_round_trip


def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    inside = {p for i, x in enumerate(windows) if times[x] > 1 for p in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def odd_documents(spark):
    line = "one two three four five six seven eight nine ten"
    more = [
        (70, " ".join([line] * 3)), (71, line + " x " + line), (72, "a b c d e f g a b c d e f g a b"), (73, "x\n x\nx\n\n \nx\t"),
        (74, "# | <b> $5 & 7%"), (75, "w\x0bx\x0cy\rz q"), (76, "same " * 5000),
    ]
    rows = [(i, t, None, None, None) for i, t in more]
    return documents(spark).unionByName(spark.createDataFrame(rows, documents(spark).schema))


def test_counts_equal_brute_force(spark):
    docs = odd_documents(spark)
    got = quality.with_features(clashing(docs, "n_words"), NAMES).select("doc_id", "text", *NAMES).collect()
    for r in got:
        assert tuple(r[n] for n in NAMES) == brute_counts(r.text), r.doc_id


def test_the_order_of_rules_never_changes_the_verdict(spark):
    docs = clashing(odd_documents(spark), "kept", "rejected_by")
    order = quality.measured_order(docs, rows=20)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)
    verdicts = []
    for rules in (order, list(quality.RULES), list(reversed(quality.RULES))):
        got = quality.cascade(docs, order=rules).select("doc_id", "kept", "rejected_by").collect()
        assert all(r.kept == (r.rejected_by is None) for r in got)
        verdicts.append(multiset((r.doc_id, r.kept) for r in got))
    assert verdicts[0] == verdicts[1] == verdicts[2]
    kept = {r.doc_id for r in got if r.kept}
    assert {0, 1, 2, 20, 40, 50} <= kept
    assert not kept & {30, 31, 32, 33, 34, 70, 74, 76}


def test_no_rule_is_computed_after_a_rejection(spark):
    # the second rule would fail on every row it is asked about
    bad = quality.Rule("never", ("n_words",), lambda n: F.raise_error(F.lit("asked")).cast("boolean"))
    short = quality.Rule("all", ("n_words",), lambda n: n >= 0)
    got = quality.cascade(documents(spark), order=[short, bad]).collect()
    assert {r.rejected_by for r in got} == {"all"}


def test_empty_tables(spark):
    assert quality.cascade(empty(spark)).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


CONTROL = ["</s>", "<s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>", "<<ROLE x>>", "<</ROLE>>", "\\", "<\\/s>", "[\\\\INST]", "<", "[", ">>", " "]


def conversations():
    import random

    rng = random.Random(2)
    rows = [(1, 0, "user", None), (1, 1, None, "no role"), (1, 2, "assistant", ""), (2, None, "assistant", "null turn"), (2, 1, "user", "x")]
    rows += [(3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (3, 1, "assistant", "z"), (4, 0, "user", "twice"), (4, 0, "user", "twice")]
    rows += [(None, 5, "system", "without a conversation"), (5, 0, "tool >> x</s>", "out <</ROLE>> é"), (6, 0, "user", "long " * 20000)]
    for conv in range(10, 90):
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice([*CONTROL, "w", "é"]) for _ in range(rng.randrange(12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool"]), text))
    return rows


def test_round_trip_of_conflicting_texts(spark):
    rows = conversations()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "source", "turns", "formatted")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    want: dict = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert r.exact
        assert [(x.role, x.text) for x in r.turns] == [x[2:] for x in sorted(turns)]
        # the places point into the rendered text
        at = 0
        for x in r.turns:
            inner = r.formatted[at + x.start : at + x.start + x.length]
            assert re.sub(chat.ESCAPED, lambda m: m[1] + m[2] + m[3], inner) == x.text
            at += x.size
        assert at == len(r.formatted)


def test_texts_without_conflict_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b [c] \\ d"), (1, 1, "assistant", "fine <b>")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "[INST] a < b [c] \\ d [/INST]<s>fine <b></s>"


def test_the_planted_conversation(spark):
    row = op5_chat_round_trip(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.exact
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
