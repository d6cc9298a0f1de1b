"""Personal data: four plain formats as seeds, then bootstrapped contextual extraction.

Seeds are e-mail addresses, dotted addresses, card numbers (Luhn) and phone numbers, found in whole texts. Every seed
and every other identifier-like word (one with a digit or @) is an instance; the words around it are its lexical
patterns. The graph of patterns and instances is scored in rounds: a pattern is as good as the share of its distinct
instances that are known to be of a kind, an instance as good as its patterns together (noisy or). Patterns with
enough distinct known instances and a high share are accepted, and what stands in them and fits the kind is found.

Null and empty texts have no spans. Copies of a text count once, since a pattern's support is in distinct instances;
a pattern or instance that holds a third of all rows is collapsed to distinct pairs before anything meets. Texts of
any length are scanned in linear time. Places are code points, ends exclusive. Repeated ids are different rows.
Other columns are not read, but `mask` keeps them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.llm.common import as_texts, cut, sliced

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT, MIN_SHARE = 4, 0.8  # distinct known instances of a pattern, and their share of all its instances
PROMOTE = 0.75  # score from which an instance counts as known in the next round

_AT_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s")
_DIGITS = re.compile(r"[0-9]")
_OPENING, _CLOSING = frozenset("\"'([<{"), frozenset("\"')]>}.,;!?")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain; the local part starts where its characters start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _AT_LEFT:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    found = [("email", s, e) for s, e in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def shape(value: str) -> str:
    """Which kinds a word can be of: at, dots, digits, mixed, or none."""
    digits = len(_DIGITS.findall(value))
    if "@" in value:
        return "at" if len(value) > 2 else ""
    if digits == len(value.replace(".", "")) and value.count(".") == 3:
        return "dots"
    letters = any(c.isalpha() for c in value)
    if not letters:
        return "digits" if digits >= 7 else ""
    return "mixed" if digits >= 2 and len(value) >= 5 else ""


#: Kinds that a shape may turn out to be.
FITS = {"at": ("email",), "dots": ("ip",), "digits": ("card", "phone"), "mixed": KINDS}


def words_before(text: str, start: int) -> list[str]:
    """The last two whole words before a place, without brackets and quotes that open there."""
    while start and text[start - 1] in _OPENING:
        start -= 1
    out: list[str] = []
    while start and len(out) < 2:
        while start and text[start - 1].isspace():
            start -= 1
        end = start
        while start and not text[start - 1].isspace():
            start -= 1
        if start < end:
            out.append(text[start:end].lower())
    return out[::-1]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: two words on the left, and a word on each side."""
    left = words_before(text, start)
    while end < len(text) and text[end] in _CLOSING:
        end += 1
    right = _WORD.search(text, end)
    out = []
    if len(left) == 2:
        out.append("l " + " ".join(left))
    if left and right:
        out.append(f"b {left[-1]} {right.group().lower()}")
    return out


def instances(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds, and identifier-like words outside of them, with their patterns."""
    out = [{"kind": k, "shape": "", "start": s, "end": e, "value": text[s:e].lower()} for k, s, e in spans]
    taken, i, last = sorted((s, e) for _, s, e in spans), 0, -1
    for m in _DIGIT_OR_AT.finditer(text):
        at = m.start()
        if at < last:
            continue
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        start, end = at, at + 1
        # whole words, however long; what the last one took is not looked at again
        while start > max(last, 0) and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, end)
        end = space.start() if space else len(text)
        last = end
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end - start < 4 or any(s < end and start < e for s, e in taken[max(0, i - 4) : i + 5]):
            continue
        kind = shape(text[start:end])
        if kind:
            out.append({"kind": None, "shape": kind, "start": start, "end": end, "value": text[start:end].lower()})
    for x in out:
        x["patterns"] = patterns(text, x["start"], x["end"])
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_INSTANCE = pa.struct(
    [("kind", pa.string()), ("shape", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
     ("patterns", pa.list_(pa.string()))]
)
SPANS_SQL = "array<struct<kind: string, start: int, end: int>>"
_PLACE = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
_KIND = T.StructField("kind", T.StringType())
_SCANNED = T.StructType(
    [
        T.StructField("spans", T.ArrayType(T.StructType([_KIND, *_PLACE]))),
        T.StructField(
            "instances",
            T.ArrayType(
                T.StructType(
                    [_KIND, T.StructField("shape", T.StringType()), *_PLACE, T.StructField("value", T.StringType()),
                     T.StructField("patterns", T.ArrayType(T.StringType()))]
                )
            ),
        ),
    ]
)


def _scan(texts: pa.Array) -> pa.Array:
    spans, found = [], []
    for text in as_texts(texts):
        own = base_spans(text)
        spans.append([dict(zip(("kind", "start", "end"), x)) for x in own])
        found.append(instances(text, own))
    return pa.StructArray.from_arrays(
        [pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_INSTANCE))], ["spans", "instances"]
    )


@F.arrow_udf(_SCANNED)
def scan(texts: pa.Array) -> pa.Array:
    return sliced(_scan, texts)


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (a number of the row), spans (base) and instances; written once, without the texts."""
    out = docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("s"))
    return cut(out.select("doc_id", "s.spans", "s.instances").withColumn("row", F.monotonically_increasing_id()))


def occurrences(scanned: DataFrame) -> DataFrame:
    """A row for each place and pattern."""
    df = scanned.select("row", F.explode("instances").alias("x"))
    return df.select(
        "row", "x.kind", "x.shape", "x.start", "x.end", "x.value", F.explode("x.patterns").alias("pattern")
    )


def accepted_patterns(occ: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score) of the patterns that hold after `rounds` of scoring the graph."""
    edges = cut(occ.groupBy("pattern", "value", "shape").agg(F.max("kind").alias("seed")))
    per_kind = F.explode(F.array(*map(F.lit, KINDS))).alias("kind")
    fits = F.lit(False)
    for name, kinds in FITS.items():
        fits = fits | ((F.col("shape") == name) & F.col("kind").isin(*kinds))
    # seeds are known from the start
    known = edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("conf")).distinct()
    total = edges.groupBy("pattern").agg(F.count_distinct("value").alias("total"))
    for i in range(rounds):
        linked = edges.select("pattern", "value").distinct().join(known, "value")
        score = linked.groupBy("pattern", "kind").agg(F.sum("conf").alias("sum"), F.count("*").alias("support"))
        score = score.where(F.col("support") >= MIN_SUPPORT).join(total, "pattern")
        score = score.withColumn("score", F.col("sum") / F.col("total")).where(F.col("score") >= MIN_SHARE)
        score = cut(score.select("pattern", "kind", "score"))
        if i + 1 == rounds or score.isEmpty():
            return score
        # unseen instances of the accepted patterns, by noisy or over their patterns
        new = edges.where("seed IS NULL").select("pattern", "value", "shape", per_kind).where(fits)
        new = new.join(score, ["pattern", "kind"]).groupBy("value", "kind")
        new = new.agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("conf"))
        known = cut(known.where("conf = 1.0").unionByName(new.where(F.col("conf") >= PROMOTE)))
    return score


def discover(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(row, found): spans beyond the base ones, for the rows that have some."""
    occ = occurrences(scanned)
    accepted = accepted_patterns(occ, rounds)
    fits = F.lit(False)
    for name, kinds in FITS.items():
        fits = fits | ((F.col("shape") == name) & F.col("k").isin(*kinds))
    hits = occ.where("kind IS NULL").join(accepted.withColumnRenamed("kind", "k"), "pattern").where(fits)
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("score", "k")).alias("b"))
    span = F.struct(F.col("b.k").alias("kind"), "start", "end")
    return best.groupBy("row").agg(F.collect_list(span).alias("found"))  # places of one text


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["start"], F.array_position(kinds, x["kind"]).alias("k"), x["end"], x["kind"]))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base (spans of the plain formats) and spans (all, in order), a row for each row."""
    scanned = scan_documents(docs, doc_id, text)
    df = scanned.select("row", "doc_id", "spans").join(discover(scanned, rounds), "row", "left")
    found = F.coalesce("found", F.array().cast(SPANS_SQL))
    return df.select("doc_id", F.col("spans").alias("base"), in_order(F.concat("spans", found)).alias("spans"))


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return sliced(_mask, texts, spans)


def _mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None or not own:
            out.append(text)
            continue
        parts, at = [], 0
        for x in own:
            if x["start"] >= at:
                parts += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
            at = max(at, x["end"])
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets.

    Base spans are found again beside the text; only found ones are joined in, by the id and the text's hash, so that
    rows with the same id but other texts keep their own.
    """
    df = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text))).withColumn("__id", F.col(doc_id))
    scanned = scan_documents(df, "__key", text)
    new = discover(scanned, rounds).join(scanned.select("row", F.col("doc_id").alias("__key")), "row")
    new = new.groupBy("__key").agg(F.first("found").alias("__found"))  # equal rows have equal spans
    df = df.join(new, "__key", "left")
    spans = F.concat(scan(F.col(text)).getField("spans"), F.coalesce("__found", F.array().cast(SPANS_SQL)))
    df = df.withColumn("__spans", in_order(spans)).withColumn(text, _masked(F.col(text), F.col("__spans")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
