"""Small documents with every odd case, and plain versions of the operators."""

from __future__ import annotations

import random

DOC_SQL = "doc_id long, text string, lang string, source string, n_chars long"

EN = "the and that of to in is it was for on are with as his they be at one have this from".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es".split()


def prose(seed: int, words: list[str] = EN, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "er", "ing", "s", "ly"]) for _ in range(n)) + "."


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, lang): copies, near copies, null, empty, wordless, long, shared passages, repeated rows."""
    base = [prose(i) for i in range(8)]
    near = base[0].replace(" the ", " thee ", 1)
    shared = prose(99, n=160)
    rows: list[tuple[int | None, str | None, str | None]] = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(10, base[0], "en"), (11, near, "en"), (12, base[1], None)]
    rows += [(20 + i, prose(200 + i, DE), "de") for i in range(6)]
    rows += [(30, None, "en"), (31, "", "en"), (32, " \n\t ", None), (33, "12 34 !!", "en"), (34, "one two", "en")]
    rows += [(40, prose(7000, n=6000), "en"), (41, "x" * 3000, "en"), (42, "ab" * 700 + "é" * 300, None)]
    rows += [(50, prose(51) + " " + shared, "en"), (51, shared + " " + prose(52), "en"), (52, prose(53) + "\n" + shared[7:] + shared[:500], "en")]
    rows += [(60, "write to a.b+c@mail.example.org or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.256 and 10.20.30.40", "en")]
    rows += [(61, "a@b a@b.c@d.e .@x.y 1.2.3.4.5.6.7.8 +12 345 é€ +4412345678901", "en")]
    rows += [(2, base[2], "en"), (None, base[3], None), (None, prose(500), "en")]
    return rows


def documents(spark):
    rows = [(i, t, lang, f"src{k % 3}", None if t is None else len(t)) for k, (i, t, lang) in enumerate(texts())]
    return spark.createDataFrame(rows, DOC_SQL).repartition(3)


def clashing(df, *names: str):
    """The same table with columns that an operator might want to make."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})


def empty(spark):
    return spark.createDataFrame([], DOC_SQL)


def multiset(rows) -> list:
    return sorted(map(repr, rows))
