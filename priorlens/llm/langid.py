"""Language identification by cross-parsing entropy.

For each language, labelled text is compiled into a suffix automaton, which accepts exactly the substrings of that text.
A document is parsed greedily: from each phrase start, the longest match in the language's text is one phrase, and the next
phrase begins after it. The phrases per symbol estimate the cross entropy; the language that needs fewest wins, ties go to
the smaller label. Symbols are letters (lower case); any run of other characters is one blank. A text is parsed in
segments of ``SEGMENT`` symbols, each of which begins a phrase, so that many segments step through an automaton at once.

Learning reads labelled rows outside the held-out quarter (crc32 of the id as text, mod 4, is 2). The sample is bounded:
of the ``MAX_LANGUAGES`` labels with the most rows (ties: the smaller label), the first ``SAMPLE_DOCS`` rows in the order of
a seeded hash of id and text, the first ``TEXT_CHARS`` characters of each, up to ``SAMPLE_SYMBOLS`` symbols a language or
``ALL_SYMBOLS`` over all languages. A label that has a row always gets a sample, however its rows and ids repeat.
Prediction reads whole texts and nothing else.

A null text, and one without letters, is ``und`` with score 0; so is every text if nothing can be learned. Rows with a null
id aren't learned from and aren't held out. Repeated rows each get a row; only id, text and language are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_maps import mapped, resident, slices, small_batches
from .byte_bpe import _schema
from .common import pick

SAMPLE_SYMBOLS, SAMPLE_DOCS, TEXT_CHARS = 40_000, 128, 160_000
#: All automata together come from so many symbols at most; with more than 40 languages each gets less.
MAX_LANGUAGES, ALL_SYMBOLS = 500, 1_600_000
#: An automaton with more (state, symbol) places than this looks its transitions up in a sorted list instead of a full table.
MAX_PLACES = 8_000_000
SEGMENT = 256
#: How fast a lead of one phrase turns into certainty.
SHARPNESS = 0.5


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of every state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Automaton:
    """Moves of many readers at once. A missing transition ends the phrase: the reader goes on from the root, marked by a
    negative number; a symbol that the sample lacks is a phrase alone, after which any symbol begins a new one."""

    def __init__(self, sample: list[int], every: int):
        """``own`` maps the ``every`` symbols of the parser to the sample's; those it lacks are one symbol."""
        kept = sorted(set(sample))
        self.size = size = len(kept) + 1
        self.own = np.full(every, len(kept), np.min_scalar_type(size))
        self.own[kept] = np.arange(len(kept))
        step = suffix_automaton(self.own[sample].tolist() if sample else [])
        alone = len(step)
        root = np.full(size, alone, np.int32)
        for c, q in step[0].items():
            root[c] = q
        self.miss = -1 - root
        if (alone + 1) * size <= MAX_PLACES:
            table = np.tile(self.miss, (alone + 1, 1))
            table[0] = root
            for p, out in enumerate(step):
                for c, q in out.items():
                    table[p, c] = q
            self.table = table.ravel()
        else:
            moves = sorted((p * size + c, q) for p, out in enumerate(step) for c, q in out.items())
            self.table = None
            self.keys, self.to = np.array([k for k, _ in moves], np.int64), np.array([q for _, q in moves], np.int32)

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * self.size + symbol
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.where(state == 0, -1 - self.miss[symbol], self.miss[symbol])
        return np.where(self.keys[at] == key, self.to[at], np.where(state == 0, -1 - self.miss[symbol], self.miss[symbol]))


class Parser:
    """Automata of all languages over one alphabet: 0 is blank, the last symbol any letter that no sample has."""

    def __init__(self, samples: dict[str, list[str]]):
        letters = sorted({c for texts in samples.values() for x in texts for c in x.lower() if c.isalpha()})
        self.size = len(letters) + 2
        self.fold = np.zeros(0x110000, np.min_scalar_type(self.size))
        other = self.size - 1
        self.fold[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] == "L"]] = other
        for k, c in enumerate(letters, 1):
            self.fold[ord(c)] = k
            if len(u := c.upper()) == 1:
                self.fold[ord(u)] = k
        self.automata: dict[str, Automaton] = {}
        most = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(samples)))
        for lang in sorted(samples):
            sample: list[int] = []
            for x in samples[lang]:
                sample += self.symbols(x).tolist()
                if len(sample) >= most:
                    break
            self.automata[lang] = Automaton(sample[:most], self.size)

    @classmethod
    def load(cls, samples: dict[str, list[str]]) -> Parser:
        """One per worker process."""
        return resident(("languages", hash(tuple((k, *v) for k, v in sorted(samples.items())))), lambda: cls(samples))

    def symbols(self, text: str) -> np.ndarray:
        s = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s != 0
        if len(s) > 1:
            keep[1:] |= s[:-1] != 0
        return s[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and symbols by text."""
        parts = [self.symbols(x) for x in texts]
        n = np.array([len(p) if p.any() else 0 for p in parts])
        starts, ends, owner = [], [], []
        base = 0
        for i, p in enumerate(parts):
            if n[i]:
                at = np.arange(0, len(p), SEGMENT)
                starts.append(base + at)
                ends.append(base + np.minimum(at + SEGMENT, len(p)))
                owner.append(np.full(len(at), i))
            base += len(p)
        counts = np.zeros((len(texts), len(self.automata)), np.int64)
        if not starts:
            return counts, n
        every = np.concatenate(parts)
        start, end, own = map(np.concatenate, (starts, ends, owner))
        order = np.argsort(start - end, kind="stable")  # longest first, so that the live ones are a prefix
        start, length, own = start[order], (end - start)[order], own[order]
        live = len(length) - np.searchsorted(length[::-1], np.arange(int(length[0])), side="right")
        for k, automaton in enumerate(self.automata.values()):
            state, seen, local = np.zeros(len(start), np.int64), np.ones(len(start), np.int64), automaton.own[every]
            for t in range(int(length[0])):
                m = live[t]
                to = automaton.move(state[:m], local[start[:m] + t])
                ended = to < 0
                state[:m] = np.where(ended, -1 - to, to)
                seen[:m] += ended
            np.add.at(counts[:, k], own, seen)
        return counts, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and phrases per symbol."""
        langs = list(self.automata)
        counts, n = self.phrases([x or "" for x in texts])
        pred, score, rate = [], [], []
        for row, m in zip(counts.tolist(), n.tolist(), strict=True):
            if not m or not langs:
                pred.append("und"), score.append(0.0), rate.append(1.0)
                continue
            best = min(row)
            pred.append(langs[row.index(best)])
            score.append(1 / sum(math.exp(max(-700.0, SHARPNESS * (best - x))) for x in row))
            rate.append(min(1.0, best / m))
        return pred, score, rate


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", seed: int = 5) -> dict[str, list[str]]:
    """The bounded sample of labelled texts by language."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 40)) / float(1 << 40)
    best = Window.partitionBy("lang").orderBy("draw", "id", "text")

    def drawn(share: dict[str, float]) -> list:
        """The first rows of each language by the draw, until they hold SAMPLE_SYMBOLS characters: what reaches the driver is
        at most SAMPLE_SYMBOLS + TEXT_CHARS characters a language."""
        of = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
        some = rows.withColumn("draw", draw).where(F.col("draw") < F.element_at(of, F.col("lang")))
        some = some.select("lang", "draw", F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, TEXT_CHARS).alias("text"))
        some = some.withColumn("k", F.row_number().over(best)).where(F.col("k") <= SAMPLE_DOCS)
        before = F.sum(F.length("text")).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text")
        return some.withColumn("before", before).where(F.col("before") < SAMPLE_SYMBOLS).collect()

    # a share of a large language is enough; one whose rows repeat may come back short, and is drawn from all its rows then
    share = {lang: min(1.0, 4 * SAMPLE_DOCS / n) if n > 4 * SAMPLE_DOCS else 2.0 for lang, n in counts.items()}
    found = drawn(share)
    got, chars = Counter(r["lang"] for r in found), Counter()
    for r in found:
        chars[r["lang"]] += len(r["text"])
    short = {lang: 2.0 for lang in counts if got[lang] < SAMPLE_DOCS and chars[lang] < SAMPLE_SYMBOLS and share[lang] < 2.0}
    if short:
        found = [r for r in found if r["lang"] not in short] + drawn(short)
    out: dict[str, list[str]] = {}
    size: Counter = Counter()
    for r in sorted(found, key=lambda r: (r["lang"], r["k"])):
        if size[r["lang"]] < SAMPLE_SYMBOLS:
            out.setdefault(r["lang"], []).append(r["text"])
            size[r["lang"]] += len(r["text"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score, phrase_rate; the automata are built once per worker process from the samples."""

    def make():
        parser = Parser.load(samples)
        return lambda texts: dict(zip(("lang_pred", "score", "phrase_rate"), parser.predict(texts), strict=True))

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    schema = _schema(kind, lang_pred=pa.string(), score=pa.float64(), phrase_rate=pa.float64())
    return rows.mapInArrow(mapped(make, "text", schema, ["doc_id"]), f"doc_id {kind.simpleString()}, lang_pred string, score double, phrase_rate double")


def keep_identified(docs: DataFrame, samples: dict[str, list[str]], *, text_col="text", label_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language (is not ``und``); with ``label_col`` that
    string column holds the predicted language instead of what it held."""
    at = docs.columns.index(label_col) if label_col else None

    def run(batches):
        parser = Parser.load(samples)
        for batch in batches:
            for part in slices(batch, text_col):
                pred = pa.array(parser.predict(part.column(text_col).to_pylist())[0], pa.string())
                if at is not None:
                    part = part.set_column(at, part.schema.field(at), pred)
                yield part.filter(pc.not_equal(pred, "und"))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
