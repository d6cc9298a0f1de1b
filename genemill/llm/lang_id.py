"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (1 to 3 characters of the lower-cased text) come from every training row and are summed by
Spark; the log-probability matrix (languages x buckets) is sent to every task in blocks of languages of a fixed size
(`MATRIX_CELLS`), where numpy sums the rows of a text's n-grams. Buckets don't depend on the number of languages.

A text that is null, empty or without a letter (Unicode class L) is `und` with score 0. The score is the posterior of the prediction.
Ties go to the language that sorts first. Without training rows everything is `und`. Texts are used whole; repeated
rows count as often as they come; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.llm.common import SLICE, add_by_slices

BUCKETS = 1 << 16
MATRIX_CELLS = 1 << 22  # 16 MB of 32-bit floats; more languages go in blocks, one pass for each
SMOOTHING = 0.5
STEP = 1 << 20  # characters of a text at a time

_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and signs such as a raised 2, which are none
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def ngram_buckets(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of 1 to 3 characters, a piece of the text at a time."""
    lowered = text.lower()
    shift = np.uint32(33 - buckets.bit_length())
    for start in range(0, len(lowered), STEP):
        codes = np.frombuffer(lowered[start : start + STEP + 2].encode("utf-32-le"), np.uint32)
        n = min(STEP, len(lowered) - start)  # n-grams that begin in this piece
        one = codes * _A
        two = (one[:-1] ^ (codes[1:] * _B)) * _C
        three = (two[:-1] ^ (codes[2:] * _B)) * _A
        yield np.concatenate([((one[:n] ^ (one[:n] >> np.uint32(15))) * _C) >> shift, two[:n] >> shift, three[:n] >> shift])


def _counts(docs: DataFrame, langs: list[str], buckets: int) -> DataFrame:
    """(lang index, bucket, n) of every training text; bucket -1 counts texts."""
    index = {x: i for i, x in enumerate(langs)}
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums = np.zeros((len(langs), buckets), np.int64)
        texts = np.zeros(len(langs), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    i = index[lang]
                    texts[i] += 1
                    for ids in ngram_buckets(text, buckets):
                        sums[i] += np.bincount(ids, minlength=buckets)
        lang, bucket = np.nonzero(sums)
        lang, bucket, n = (
            np.concatenate(x)
            for x in ((lang, np.arange(len(langs))), (bucket, np.full(len(langs), -1)), (sums[lang, bucket], texts))
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], schema=schema
        )

    rows = docs.mapInArrow(count, "lang int, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their log priors, and the log-probabilities (buckets, languages) in blocks of languages."""

    def __init__(self, langs: list[str], prior: np.ndarray, blocks: list[np.ndarray]):
        self.langs, self.prior, self.blocks = langs, prior, blocks

    def parts(self) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        out, at = [], 0
        for weights in self.blocks:
            end = at + weights.shape[1]
            out.append((self.langs[at:end], self.prior[at:end], weights))
            at = end
        return out


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def _best(part: tuple[list[str], np.ndarray, np.ndarray], text: str | None) -> tuple[str | None, float, float]:
    """The best language of a block, its log-probability, and the sum of all relative to it."""
    langs, prior, weights = part
    if not text or not has_letter(text):
        return None, 0.0, 0.0
    total = prior.astype(np.float64)
    for ids in ngram_buckets(text, len(weights)):
        total = total + weights[ids].sum(axis=0, dtype=np.float64)
    best = int(np.argmax(total))
    return langs[best], float(total[best]), float(np.exp(total - total[best]).sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learn from all rows with a text and a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    step = max(1, MATRIX_CELLS // buckets)
    texts = np.zeros(len(langs))
    blocks = []
    for at in range(0, len(langs), step):
        own = langs[at : at + step]
        counts = np.zeros((buckets, len(own)))
        some = rows.where(F.col("lang").isin(own)) if len(langs) > step else rows
        for i, bucket, n in _counts(some, own, buckets).toLocalIterator():
            if bucket < 0:
                texts[at + i] = n
            else:
                counts[bucket, i] = n
        blocks.append(np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * buckets)).astype(np.float32))
    return Model(langs, np.log(np.maximum(texts, 1) / max(texts.sum(), 1)), blocks)


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its posterior; one pass over the texts for each block of languages."""
    df = docs
    fields = [T.StructField("__lang", T.StringType()), T.StructField("__top", T.DoubleType()), T.StructField("__sum", T.DoubleType())]
    for k, part in enumerate(model.parts()):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def predicted(values: pa.Array, *before: pa.Array, shared=shared) -> list[pa.Array]:
            out = [_best(shared.value, t) for t in values.to_pylist()]
            if before:
                out = [_better(x, y) for x, y in zip(zip(*[b.to_pylist() for b in before]), out)]
            lang, top, total = zip(*out) if out else ((), (), ())
            return [pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())]

        df = add_by_slices(df, [text, *[f.name for f in fields]] if k else [text], fields, predicted)
    if not model.blocks:
        df = df.withColumns({"__lang": F.lit(None).cast("string"), "__sum": F.lit(1.0), "__top": F.lit(0.0)})
    lang, posterior = F.coalesce("__lang", F.lit("und")), F.when(F.col("__lang").isNull(), 0.0).otherwise(1 / F.col("__sum"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (pred, score)]
    return df.select(*kept, lang.alias(pred), posterior.alias(score))


def _better(x: tuple[str | None, float, float], y: tuple[str | None, float, float]) -> tuple[str | None, float, float]:
    """Two blocks as one; ties go to the first, whose languages sort first."""
    if x[0] is None or y[0] is None:
        return y if x[0] is None else x
    if x[1] < y[1]:
        return y[0], y[1], y[2] + x[2] * float(np.exp(x[1] - y[1]))
    return x[0], x[1], x[2] + y[2] * float(np.exp(y[1] - x[1]))
