"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps every character to one character: letters lose case, accents and width, look-alikes of other
scripts become the Latin letter, digits and signs that stand for letters become those letters; invisible characters
go first.  The terms are stems: a match counts where a word begins with one, if it lies in no exception phrase.
A text's strength is the weighted number of its matches, normalised by its number of words, beside the
bare number; a logistic curve makes a score of both.

learn() finds the lexicon in labelled texts: the stems that toxic texts use much more often, word for word, and
of stems that begin with one another the best.  Exception phrases, a match with the word before or behind it, are learned beside
the given ones: those that other texts use and toxic ones hardly.  It reads at most SAMPLE labelled texts, the first by hash of
their ids, once.

Cases: null and empty texts have no matches and get the score of such texts; very long texts are matched whole, in time that
grows with their length; null labels are not learned from, and of a text with several labels the highest counts; stems of equal
weight come longest first, then in alphabetical order; if no toxic text is labelled, the given seed terms are the lexicon; other
columns, whatever their names, are neither read nor returned (reject() returns them); repeated rows are scored one by one; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import forget, held_out, stored, table, text_batches

#: Labelled texts that a lexicon is learned from, at most; also the exceptions and the curve.
SAMPLE = 10_000
#: A stem's least share of the toxic texts, least log ratio of its rates, and the most stems of a lexicon.
SUPPORT, RATIO, TERMS = 0.015, 1.4, 500
#: Letters of a stem; a rate is log(1 + uses in a thousand words), and RATE is added to each mean.
STEMS, RATE = range(4, 11), 0.05
#: Signs and digits read as letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l", "+": "t"}
#: Letters of other scripts that look like a Latin letter.
ALIKE = {
    "а": "a", "в": "b", "е": "e", "ԁ": "d", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ø": "o", "đ": "d", "ł": "l",
}
#: Phrases in which a term is no insult, beside those that are learned.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "idiot proof", "idiot light", "pond scum", "soap scum", "stupid question")
#: Texts, none of them toxic, that a learned exception needs, and how many times its rate there is that in toxic ones.
SPARED, RARER = 5, 4.0
#: Terms that stand in for a lexicon where nothing was learned.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting")
WORD = re.compile(r"[^\W\d_]+")
BEFORE, BEHIND = re.compile(r"[^\W\d_]{2,20} $"), re.compile(r"[^\W\d_]+ [^\W\d_]{2,20}")
#: Characters that do not show by themselves; combining accents too, as letters lose theirs.
_INVISIBLE = dict.fromkeys([0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)])


@cache
def folding() -> dict[int, str]:
    """One character for one character."""
    out = {}
    for code in [*range(0x80, 0x250), *range(0x370, 0x530), *range(0x1D00, 0x2000), *range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        base = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        base = ALIKE.get(base, base)
        if base and len(base) == 1:
            out[code] = SIGNS.get(base, base) if code < 0x2460 or code >= 0xFF01 else base
    for code in range(128):
        low = chr(code).lower()
        out[code] = SIGNS.get(low, low)
    return out


def visible(text: str) -> str:
    return text if text.isascii() else text.translate(_INVISIBLE)


def folded(text: str) -> str:
    """As many characters as the text has."""
    return text.translate(folding())


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 4.0, 1.0)
    _trees: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_trees": {}}

    def tree(self):
        if "own" not in self._trees:
            import ahocorasick

            own = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                own.add_word(folded(term), (len(term), weight))
            for phrase in self.exceptions:
                own.add_word(folded(phrase), (len(phrase), 0.0))
            own.make_automaton()
            self._trees["own"] = own
        return self._trees["own"]

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that count, in visible(text)."""
        if not len(self.tree()):
            return []
        hits, spared = [], []
        for last, (length, weight) in self.tree().iter(folded(text)):
            start, end = last + 1 - length, last + 1
            if start == 0 or not text[start - 1].isalnum():
                (hits if weight else spared).append((start, end, weight))
        if not spared:
            return hits
        spared.sort()
        starts, reach = [s for s, _, _ in spared], list(accumulate((e for _, e, _ in spared), max))  # how far those that begin so early go
        place = [bisect_right(starts, s) - 1 for s, _, _ in hits]
        return [h for h, i in zip(hits, place, strict=True) if i < 0 or reach[i] < h[1]]

    def strength(self, text: str, spans: list[tuple[int, int, float]] | None = None) -> tuple[float, float]:
        """Weighted matches, and those in a thousand words; both as log(1 + x)."""
        total = sum(w for _, _, w in (self.spans(visible(text)) if spans is None else spans))
        return math.log1p(total), math.log1p(1000.0 * total / (text.count(" ") + text.count("\n") + 1)) if total else 0.0

    def score(self, text: str, spans: list[tuple[int, int, float]] | None = None) -> float:
        a, b = self.strength(text, spans)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def sample(df: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(text, y) of the labelled texts that are not held out, `limit` of them at most, the first by hash of their ids."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(limit)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id").select("text", "y")


def labelled(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    """(text, y) of a batch, a few texts in memory at once."""
    for at, texts in text_batches(batch.column(0)):
        yield from zip(texts, batch.column(1).slice(at, len(texts)).to_pylist(), strict=True)


def phrases(text: str, lexicon: Lexicon) -> set[str]:
    """Matches with the word before, and with the word behind them."""
    shown = visible(text)
    spans, flat, out = lexicon.spans(shown), folded(shown), set()
    for start, _, _ in spans:
        if whole := WORD.match(flat, start):
            if before := BEFORE.search(flat, max(0, start - 21), start):
                out.add(flat[before.start() : whole.end()])
            if behind := BEHIND.match(flat, start):
                out.add(behind.group())
    return out


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, texts, toxic_rate, other_rate): toxic texts of a batch with the stem, and its damped rates in both kinds, summed."""
    for batch in batches:
        rates, texts = {0: Counter(), 1: Counter()}, Counter()
        for text, y in labelled(batch):
            words = WORD.findall(folded(visible(text)))
            own: Counter = Counter()
            for word, n in Counter(words).items():
                for k in STEMS:
                    if len(word) >= k:
                        own[word[:k]] += n
            for stem, n in own.items():
                rates[int(y > 0)][stem] += math.log1p(1000.0 * n / len(words))
            if y > 0:
                texts.update(own.keys())
        stems = list(rates[0].keys() | rates[1].keys())
        yield pa.RecordBatch.from_pydict({"stem": pa.array(stems, pa.string()), "texts": pa.array([texts[t] for t in stems], pa.int64()), **{name: pa.array([float(rates[y][t]) for t in stems], pa.float64()) for name, y in (("toxic_rate", 1), ("other_rate", 0))}})


def learn(df: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The lexicon and its curve."""
    rows = stored(sample(df, labels, label, id_col, text_col, SAMPLE), "sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, other = n.get(True, 0), n.get(False, 0)
    if not toxic:
        return Lexicon(dict.fromkeys(SEED, 1.0))
    rates = rows.mapInArrow(_stems, "stem string, texts bigint, toxic_rate double, other_rate double").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("texts", "toxic_rate", "other_rate")])
    ratio = F.log((F.col("toxic_rate") / toxic + RATE) / (F.col("other_rate") / max(1, other) + RATE))
    best = rates.where(F.col("texts") >= max(3, math.ceil(SUPPORT * toxic))).withColumn("w", F.round(ratio, 9)).where(F.col("w") >= RATIO)
    weights: dict[str, float] = {}
    for r in best.orderBy(F.desc(F.round(F.col("w") * F.sqrt("texts"), 6)), F.desc(F.length("stem")), "stem").limit(20 * TERMS).collect():
        if len(weights) < TERMS and not any(t.startswith(r["stem"]) or r["stem"].startswith(t) for t in weights):
            weights[r["stem"]] = r["w"]
    if not weights:
        return Lexicon(dict.fromkeys(SEED, 1.0))
    lexicon = Lexicon({t: w / max(weights.values()) for t, w in weights.items()})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(p, int(y > 0)) for t, y in labelled(batch) for p in phrases(t, lexicon)]
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in pairs], pa.string()), "toxic": pa.array([y for _, y in pairs], pa.int32())})

    uses = rows.mapInArrow(found, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    spared = uses.where((F.col("good") >= SPARED) & (F.col("good") * toxic >= RARER * F.col("bad") * max(1, other)) & (F.col("bad") * max(1, other) < F.col("good") * toxic))
    lexicon = Lexicon(lexicon.weights, (*EXCEPTIONS, *[r["phrase"] for r in spared.orderBy(F.desc("good"), "phrase").limit(TERMS).collect()]))

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [lexicon.strength(t) for t, _ in labelled(batch)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.float64()), "b": pa.array([p[1] for p in pairs], pa.float64()), "y": batch.column(1)})

    seen = rows.mapInArrow(strengths, "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])
    lexicon.curve = logistic(seen[["a", "b"]].to_numpy(), seen["y"].to_numpy() > 0)
    forget(rows)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[float, ...]:
    """Intercept and slopes; slopes are not negative."""
    weight = np.ones(len(y))
    rows, penalty = np.column_stack([np.ones(len(x)), x]), ridge * np.diag([0.0, *[1.0] * x.shape[1]])
    beta = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + penalty + 1e-9 * np.eye(len(beta)), gradient)
        beta += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0]), *(max(0.0, float(b)) for b in beta[1:]))


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, matches): matches are the (start, end, term) that count, by place in the visible text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
        for batch in batches:
            for at, texts in text_batches(batch.column(1)):
                shown = [visible(t) for t in texts]
                spans = [lexicon.spans(v) for v in shown]
                found = [[{"start": s, "end": e, "term": folded(v[s:e])} for s, e, _ in x] for v, x in zip(shown, spans, strict=True)]
                scores = [lexicon.score(v, x) for v, x in zip(shown, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["id", "score", "matches"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, matches array<struct<start:int,end:int,term:string>>").withColumnRenamed("id", id_col)


def reject(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text scores below 0.5."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([lexicon.score(t) for _, texts in text_batches(batch) for t in texts], pa.float64())

    return df.where(run(F.col(text_col)) < 0.5)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a lexicon learned from labels of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
