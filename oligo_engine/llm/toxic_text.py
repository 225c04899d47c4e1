"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding takes letters to plain lower-case Latin (accents, wide forms, Cyrillic and Greek
look-alikes), digits and signs inside words to the letters they stand for, drops invisible
characters, and makes everything else a blank. The lexicon has whole words and beginnings
of words; it starts from ``BASE`` and is learned from labelled rows: a term enters where
its documents are toxic with confidence, and weighs the logarithm of its odds. Exception
phrases cover matches inside them. A logistic curve over the matched weight and the weight
per word gives the score.

The learning sample is at most ``sample_rows`` labelled documents, those with the smallest
hashes of their ids; candidate terms are counted in Spark. A term needs four toxic documents
of the sample, more than clean ones, and the ``MAX_TERMS`` that tell most (toxic documents
times weight) are learned, which bounds what is broadcast. Scoring reads every whole text.

Defined results: a null, empty or wordless text matches nothing and gets the curve's lowest
score; ids may be null or repeat (labels of one id: the largest); without labels the base
lexicon decides; an empty table gives no rows. Further columns are carried; ``held_out``,
``score`` and ``predicted`` are the operator's own and take the place of columns so named.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from oligo_engine.llm.common import map_arrow

#: The lexicon before learning: common English insults.
BASE = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "imbecile", "dumbass", "retard", "filth", "vermin")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown")
#: Letters that look like Latin ones, by what they look like.
ALIKE = {
    "a": "аαɑ", "b": "вβ", "c": "сϲ", "e": "еεё", "h": "нһ",
    "i": "іιıӏ", "j": "јϳ", "k": "кκ", "m": "м", "n": "ηռ", "o": "оοσօ",
    "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ѡω", "x": "хχ", "y": "уγ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
PREFIXES = range(4, 8)
MAX_TERMS = 4000


class Fold(dict):
    """Translation by code point, worked out when a character first comes up."""

    def __init__(self):
        super().__init__({ord(c): plain for plain, others in ALIKE.items() for c in others})
        self.update({ord(c): v for c, v in DIGITS.items()})

    def __missing__(self, code: int):
        char = unicodedata.normalize("NFKD", chr(code)).lower()
        kept = "".join(c for c in char if not unicodedata.combining(c))
        if unicodedata.category(chr(code)) in ("Cf", "Mn"):
            out = ""
        elif kept and all(c.isalnum() for c in kept):
            out = "".join(dict.get(self, ord(c), c) if len(kept) > 1 or kept != chr(code) else c for c in kept)
        else:
            out = " "
        self[code] = out
        return out


INSIDE = re.compile(r"(?<=\w)[@$!|](?=\w)|[@$](?=[^\W\d_]{2})")
NUMBER = re.compile(r"(?<!\w)\d+(?!\w)")


def folded(text: str, table: Fold) -> str:
    """The folded text with a blank at both ends; plain numbers are no words."""
    if INSIDE.search(text):
        text = INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return f" {NUMBER.sub(' ', text).translate(table)} "


def terms_in(text: str) -> set[str]:
    """Candidate terms: `` word `` and `` beginn`` as the automaton will match them."""
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def automaton(lexicon: dict[str, float], exceptions: Sequence[str], table: Fold):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        found.add_word(term, (len(term), weight))
    for phrase in exceptions:
        phrase = f" {' '.join(folded(phrase, table).split())} "
        found.add_word(phrase, (len(phrase), None))
    found.make_automaton()
    return found


def matched_weight(text: str, found) -> float:
    """Sum over matched places of the strongest term there, exceptions left out."""
    hits, covered = {}, []
    for end, (length, weight) in found.iter(text):
        start = end - length + 1
        if weight is None:
            covered.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    return sum(w for at, w in hits.items() if not any(a <= at < b for a, b in covered))


def features(texts: Iterator[str | None], lexicon: dict[str, float], exceptions: Sequence[str]) -> np.ndarray:
    """(log of the weight, log of the weight per hundred words) of every text."""
    table = Fold()
    found = automaton(lexicon, exceptions, table)
    out = []
    for text in texts:
        plain = folded(text or "", table)
        weight = matched_weight(plain, found)
        words = len(plain.split()) if weight else 0
        out.append((math.log1p(weight), math.log1p(100 * weight / (words + 20))))
    return np.array(out).reshape(len(out), 2)


def confident_share(positive: float, n: float, z: float = 2.2) -> float:
    """Lower end of Wilson's interval."""
    if n <= 0:
        return 0.0
    p = positive / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a little ridge, by Newton's steps; without rows of both
    labels a curve that any matched weight takes above one half."""
    if len(set(y.tolist())) < 2:
        return np.array([-3.0, 2.0, 1.0])
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out(identity: Column) -> Column:
    return F.crc32(F.coalesce(identity.cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int, exceptions: Sequence[str]) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, curve) from the labelled rows that are not held out."""
    marked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    # at most sample_rows rows: their bound makes the broadcast safe
    chosen = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("text", F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = Fold(), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                seen[toxic > 0].update(terms_in(folded(text or "", table)))
                seen[toxic > 0][""] += 1  # documents in all
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield counted(seen)
                seen = (Counter(), Counter())
        yield counted(seen)

    def counted(seen):
        names = list(set(seen[0]) | set(seen[1]))
        return pa.record_batch(
            [pa.array(names, pa.string()), pa.array([seen[1][n] for n in names], pa.int64()), pa.array([seen[0][n] for n in names], pa.int64())],
            ["term", "toxic", "clean"],
        )

    counts = map_arrow(rows, count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    listed = counts.filter((F.col("term") == "") | (F.col("toxic") >= 4) & (F.col("toxic") > F.col("clean"))).collect()
    toxic, clean = next(((r["toxic"], r["clean"]) for r in listed if r["term"] == ""), (0, 0))
    lexicon = {f" {w} ": 4.0 for w in BASE}
    rated = []
    for r in listed:
        if r["term"] and confident_share(r["toxic"], r["toxic"] + r["clean"]) >= 0.5:
            weight = math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1))
            rated.append((r["toxic"] * weight, r["term"], weight))
    lexicon |= {term: weight for _, term, weight in sorted(rated, reverse=True)[:MAX_TERMS] if weight > 0}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(iter(batch.column(0).to_pylist()), lexicon, exceptions)
            yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["a", "b", "toxic"])

    seen = map_arrow(rows, describe, "a double, b double, toxic int").collect()
    x = np.array([(r["a"], r["b"]) for r in seen]).reshape(len(seen), 2)
    return lexicon, fitted(x, np.array([float(r["toxic"] > 0) for r in seen]))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    sample_rows: int = 20_000,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted, in place of any of ``docs``
    that have these names."""
    docs = docs.drop("held_out", "score", "predicted")
    lexicon, curve = learn(docs, labels, sample_rows, exceptions)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, curve))
    own = docs.columns
    at = own.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w = shared.value
        table = Fold()
        found = automaton(terms, exceptions, table)
        for batch in batches:
            out = []
            for value in batch.column(at):
                plain = folded(value.as_py() or "", table)
                weight = matched_weight(plain, found)
                words = len(plain.split()) if weight else 0
                z = w[0] + w[1] * math.log1p(weight) + w[2] * math.log1p(100 * weight / (words + 20))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.float64())], [*own, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return map_arrow(docs, score, schema).withColumns(
        {"held_out": is_held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")}
    )
