"""Quality rules as a short-circuit cascade, in Spark expressions only.

Each rule rejects a text by a few counts. On a sample of about `SAMPLE_ROWS` rows (a documented bound; it steers speed
only) every rule is timed and its rejections are counted; the cascade then asks the rules by rejections per cost, each
measured on what the rules before it let through, and stops at the first that rejects. The order never changes the
verdict: a text is kept if no rule rejects it.

Words are runs of anything but space and U+0009 to U+000D. Null and empty texts have no words and are rejected as
short. Texts are whole; repeated rows each get their verdict; other columns pass through. Nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
WINDOW = 8

BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, from 64-bit hashes of the windows; n log n in the words."""

    def covered(starts: Column) -> Column:
        # sorted starts: each covers a window, or up to the next start
        steps = F.transform(
            starts, lambda v, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - v, F.lit(window)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def among(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                            | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
                        ),
                        lambda e: e["i"],
                    )
                ),
                covered,
            ),
        )

    def windows(hashes: Column) -> Column:
        return F.when(
            F.size(hashes) >= window,
            F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window))),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            windows(h),
            # most texts repeat no window: a distinct count is all they cost
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(among(w)),
        ),
    ).cast("long")


def count_characters(text: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


#: What rules read, by name: a count from the text.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(word_list(t)).cast("long"),
    "word_chars": lambda t: F.length(F.regexp_replace(t, BLANK + "+", "")).cast("long"),
    "n_symbols": lambda t: count_characters(t, "#*$%&|<>"),
    "n_dup_lines": lambda t: let(filled_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_lines": lambda t: F.size(filled_lines(t)).cast("long"),
    "n_repeat_words": lambda t: repeat_words(word_list(t)),
    "n_marks": lambda t: count_characters(t, "!?"),
    "n_capitals": lambda t: count_characters(t, "A-Z"),
}


@dataclass(frozen=True)
class Rule:
    name: str
    reads: tuple[str, ...]
    rejects: Callable[..., Column]


RULES = (
    Rule("short", ("n_words",), lambda n: n < 20),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c > 12 * n) | (c < 2 * n)),
    Rule("lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > 30 * n),
    Rule("marks", ("n_marks", "n_words"), lambda m, n: 2 * m > n),
    Rule("capitals", ("n_capitals", "word_chars"), lambda u, c: 100 * u > 40 * c),
)
BASE_RULES = ("short", "repeats")


def with_features(docs: DataFrame, names: tuple[str, ...], text: str = "text") -> DataFrame:
    """Add counts as columns, for use beside the cascade."""
    return docs.withColumns({n: FEATURES[n](F.coalesce(F.col(text), F.lit(""))) for n in names})


def rejects(rule: Rule, ready: tuple[str, ...] = (), text: str = "text") -> Column:
    """The rule's verdict, from columns that are `ready` or else from the text."""
    return _rejects(rule, F.coalesce(F.col(text), F.lit("")), ready)


def _rejects(rule: Rule, text: Column, ready: tuple[str, ...]) -> Column:
    return rule.rejects(*[F.col(n) if n in ready else FEATURES[n](text) for n in rule.reads])


def measured_order(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Rules by rejections per second on a sample, each among the rows that the chosen ones leave."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(min(1.0, rows / total), seed=1).persist()
    try:
        sample.count()
        cost = {}
        for rule in rules:
            began = time.perf_counter()
            sample.select(F.count_if(_rejects(rule, F.col("t"), ()))).collect()
            cost[rule.name] = time.perf_counter() - began
        # which rules reject together: at most one row for each rejecting set that the sample shows
        flags = sample.select(*[_rejects(r, F.col("t"), ()).alias(r.name) for r in rules])
        sets = [(set(n for n in r.asDict() if n != "count" and r[n]), r["count"]) for r in flags.groupBy(*flags.columns).count().collect()]
    finally:
        sample.unpersist()
    order, left = [], list(rules)
    while left:
        gain = {r.name: sum(n for names, n in sets if r.name in names) / max(cost[r.name], 1e-6) for r in left}
        best = max(left, key=lambda r: (gain[r.name], -cost[r.name]))
        order.append(best)
        left.remove(best)
        sets = [(names, n) for names, n in sets if best.name not in names]
    return order


def cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    ready: tuple[str, ...] = (),
    order: list[Rule] | None = None,
    out: str = "kept",
    reason: str | None = "rejected_by",
) -> DataFrame:
    """Add the verdict, and the rule that rejected first.

    `ready` names features that are columns already; others are computed only where the cascade comes to them.
    """
    order = measured_order(docs, rules, text) if order is None else order
    body = F.coalesce(F.col(text), F.lit(""))
    first = F.lit(None).cast("string")
    for rule in reversed(order):
        first = F.when(_rejects(rule, body, ready), F.lit(rule.name)).otherwise(first)
    name = reason or "__rule"
    df = docs.withColumn(name, first).withColumn(out, F.col(name).isNull())
    return df if reason else df.drop(name)
