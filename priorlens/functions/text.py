"""Text functions: whitespace, normal forms, trigrams, tokens, sentences, signals, reversible maps."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentence ends, the closers that may follow them, and quotations.
SENTENCE_END = r"[.!?。！？]"
CLOSERS = "\"'”’)\\]」』》"
QUOTE = r'“[^”\n]{1,2000}”|"[^"\n]{1,2000}"|‘[^’\n]{1,1000}’'
# Generic signals; all but the quotations are patterns of our own (``claim_signals`` has the dictionaries that are fixed).
SIGNALS = {
    "quote": QUOTE,
    "number": r"[-+△▲]?\d[\d,]*(?:\.\d+)?",
    "number_unit": r"\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|조|억|만|천|원|달러|USD|KRW)",
    "period": r"(?:19|20)\d{2}(?:\s*년)?|[1-4]\s*분기|Q[1-4]",
    "attribution": r"(?:said|according to|announced|reported|밝혔다|말했다|전했다|설명했다)",
    "negation": r"(?:(?:^|[^\p{L}])(?:not|no|never)(?:[^\p{L}]|$)|않|없|아니)",
}


def compact(x: Column) -> Column:
    """Runs of white space (Unicode) become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def nonwhite_length(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"(?U)\s+", ""))


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Spark has no NFKC of its own."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normal_form(x: Column) -> Column:
    """NFKC, lower case, word characters only."""
    return F.regexp_replace(F.lower(nfkc(x)), r"(?U)[^\w]+", "")


def grams(x: Column, n: int = 3) -> Column:
    """The set of character n-grams, sorted; a shorter text has none. One pass of the regular expression engine, which looks
    ahead for a gram and steps on by a code point."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def tokens(*parts: Column) -> Column:
    """Runs of a-z and 0-9 in the joined, lower-cased parts."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *parts)), F.lit(r"[a-z0-9]+"), F.lit(0))


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])


@F.udf(T.ArrayType(SPAN), useArrow=True)
def chunks(x):
    """White-space chunks with code-point offsets."""
    return None if x is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", x)]


# What str.split takes for white space, as Java's expressions have it.
_BLANK = r"\s\x1c-\x1f"


def chunk_bounds(x: Column) -> Column:
    """struct(chunks, first_start, last_end) of ``chunks``, in Spark's own functions: no array of spans is made, so a batch of
    long texts takes no memory in Python. Null text gives null; a text without chunks has 0, its length and 0."""
    n = F.length(x)
    return F.when(x.isNotNull(), F.struct(
        F.regexp_count(x, F.lit(f"(?U)[^{_BLANK}]+")).alias("chunks"), (n - F.length(F.regexp_replace(x, f"(?U)\\A[{_BLANK}]+", ""))).alias("first_start"),
        F.length(F.regexp_replace(x, f"(?U)(?<![{_BLANK}])[{_BLANK}]++\\z", "")).alias("last_end"),
    ))


#: Whole texts that a batch to Python holds, in queries whose functions make arrays of spans there.
BATCH_ROWS = 256


def small_batches(spark) -> None:
    """Bound the Arrow batches of the session, unless it was set to less already: Spark's own default would hold the spans of
    10,000 whole texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_END = re.compile(f"{SENTENCE_END}+[{CLOSERS}]*(?=\\s|$)|\n+")


def sentence_spans(x: str) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for m in [*_END.finditer(x), None]:
        end = len(x) if m is None else m.end()
        piece = x[at:end]
        a = at + len(piece) - len(piece.lstrip())
        z = at + len(piece.rstrip())
        if a < z:
            out.append((a, z, x[a:z]))
        at = end
    return out


@F.udf(T.ArrayType(SPAN), useArrow=True)
def sentences(x):
    """Sentences with code-point offsets: an end mark with its closers before white space, or line ends."""
    return None if x is None else sentence_spans(x)


def sentence_texts(x: Column) -> Column:
    """The texts of the sentences, without offsets, in Spark's own functions."""
    marked = F.regexp_replace(x, f"({SENTENCE_END}+[{CLOSERS}]*)(\\s|$)|\\n+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


SIGNAL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])


@F.udf(T.ArrayType(SIGNAL), useArrow=True)
def signals(x):
    """Spans of all kinds; a number that lies in a number with unit or a period is not one by itself."""
    if x is None:
        return None
    out, held = [], []
    for kind in ("quote", "number_unit", "period", "attribution", "negation", "number"):
        for m in regex.finditer(SIGNALS[kind], x):
            a, z = m.span()
            if kind == "number" and any(s < z and a < e for s, e in held):
                continue
            if kind in ("number_unit", "period"):
                held.append((a, z))
            out.append((kind, a, z, m[0]))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def signal_counts(x: Column, kinds=tuple(SIGNALS)) -> list[Column]:
    """A count per kind, in Spark's own functions (no suppression of overlaps)."""
    return [F.regexp_count(x, F.lit(SIGNALS[k])).alias(k) for k in kinds]


@F.udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.ArrayType(T.ArrayType(T.IntegerType())))]), useArrow=True)
def collapse_with_map(x, origin):
    """Collapsed white space, and for each kept character the source interval that it stands for."""
    if x is None:
        return None
    origin, text, where = origin or 0, [], []
    for m in re.finditer(r"\s+|\S", x):
        blank = m[0].isspace()
        if blank and (not text or m.end() == len(x)):
            continue
        text.append(" " if blank else m[0])
        where.append([origin + m.start(), origin + m.end()])
    return "".join(text), where


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def hangul_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[가-힣]"))


def replacement_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit("\ufffd"))


# Number scales and their powers of ten.
SCALES = {"조": 12, "억": 8, "만": 4, "천": 3, "trillion": 12, "billion": 9, "million": 6, "thousand": 3}


def quantity(x: Column) -> Column:
    """``3조 2000억 원`` -> struct(value decimal(38,4), unit, compound): parts with scales are added up."""
    names = "|".join(SCALES)
    parts = F.regexp_extract_all(x, F.lit(rf"(\d[\d,]*(?:\.\d+)?)\s*({names})"), F.lit(0))
    power = F.create_map(*[F.lit(v) for k, p in SCALES.items() for v in (k, 10**p)])
    one = lambda p: F.regexp_replace(F.regexp_extract(p, r"[\d,.]+", 0), ",", "").try_cast("decimal(20,4)") * F.element_at(power, F.regexp_extract(p, rf"({names})$", 1)).cast("decimal(14,0)")
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,4)"), lambda a, p: (a + one(p)).cast("decimal(38,4)"))
    plain = F.regexp_replace(F.regexp_extract(x, r"\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("decimal(38,4)")
    unit = F.regexp_extract(x, r"(%|원|달러|USD|KRW|퍼센트|percent)\s*$", 1)
    return F.struct(F.when(F.size(parts) > 0, total).otherwise(plain).alias("value"), F.nullif(unit, F.lit("")).alias("unit"), (F.size(parts) > 1).alias("compound"))


def refs(x: Column) -> Column:
    """References split at ; or |, empty ones dropped."""
    return F.filter(F.transform(F.split(x, r"[;|]"), lambda r: F.trim(r)), lambda r: r != "")
