"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import ROW, hash60, packed, unpacked

#: The bound of the labelled sample: so many labelled keys of smallest seeded hash. Half teach the lexicon, a quarter the trees, a quarter the calibration.
LABELLED_KEYS = 20_000
#: A word joins the lexicon if so many toxic documents hold it and its log odds exceed a tier's by two standard errors.
LEAST_TOXIC = 3
TIERS = (2.0, 0.7)
LEXICON_WORDS = 4_000
#: Words between a lexicon word and a second person at most.
NEAR_WORDS = 5
TREES, DEPTH, STEP = 30, 3, 0.2
#: A word that is met again is looked up; the table of looked-up words starts anew at this size.
KNOWN_WORDS = 200_000

#: Second-person words of the corpus languages (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves du dich dir dein deine deiner deinen euch euer eure ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters in disguised words (fixed values).
DISGUISE = str.maketrans("013457@$!|", "oieastasil")

FEATURES = [
    "strong_density", "strong_kinds", "mild_density", "weight_density", "second_person_density", "proximity",
    "capitals", "shouted_words", "exclamations", "symbols", "obfuscated_words", "obfuscated_strong", "log_words",
]
OUTPUTS = ["score", "predicted"]

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_REPEATS = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_EXCLAIMED = re.compile(r"[!?]")
_SYMBOLS = re.compile(r"[#*$%&|<>@^~]")


def squeezed(word: str) -> str:
    """The word without disguise: look-alike characters as letters, other non-letters and repeated letters gone."""
    return _REPEATS.sub(r"\1", _NOT_LETTERS.sub("", word.translate(DISGUISE)))


@dataclass
class Lexicon:
    """Words and their weights of evidence; `strong` is the first tier. Disguised forms meet the lexicon as `squeezed` words."""

    weights: dict[str, float]

    def __post_init__(self):
        self.disguised = {squeezed(w): w for w in sorted(self.weights, key=lambda w: (self.weights[w], w)) if len(squeezed(w)) > 3}
        self.known: dict[str, tuple[str | None, bool, bool]] = {}

    def look(self, word: str) -> tuple[str | None, bool, bool]:
        """The lexicon word that a written word stands for, whether it is disguised, and whether a second person is meant."""
        got = self.known.get(word)
        if got is None:
            core = _EDGES.sub("", word.lower())
            plain = core if core in self.weights else None
            odd = bool(core) and not core.isalpha()
            hidden = None
            if plain is None and (odd or _REPEATS.search(core)):
                hidden = self.disguised.get(squeezed(core)) or self.disguised.get(squeezed(word.lower()))
            got = (plain or hidden, hidden is not None or (odd and any(c.isalpha() for c in core)), core in SECOND_PERSON)
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = _WORDS.findall(text)
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        strong, mild, weight, obfuscated, hidden, persons, kinds, hits = 0, 0, 0.0, 0, 0, [], set(), []
        for i, word in enumerate(words):
            found, odd, second = self.look(word)
            if found is not None:
                worth = self.weights[found]
                weight += worth
                if worth >= TIERS[0]:
                    strong += 1
                    kinds.add(found)
                    hits.append(i)
                    hidden += odd
                else:
                    mild += 1
            if odd:
                obfuscated += 1
            if second:
                persons.append(i)
        for spaced in _SPACED.findall(text):
            found = self.disguised.get(squeezed(spaced.lower()))
            if found is not None and self.weights[found] >= TIERS[0]:
                strong += 1
                hidden += 1
                kinds.add(found)
        near = 0
        if hits and persons:
            places = np.array(persons)
            spots = np.searchsorted(places, hits)
            before = np.abs(np.array(hits) - places[np.maximum(spots - 1, 0)])
            after = np.abs(places[np.minimum(spots, len(places) - 1)] - np.array(hits))
            near = int((np.minimum(before, after) <= NEAR_WORDS).sum())
        chars = len(text)
        shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
        return [
            100 * strong / n, math.log1p(len(kinds)), 100 * mild / n, 100 * weight / n, 100 * len(persons) / n, near / max(1, len(hits)),
            100 * len(_CAPITALS.findall(text)) / chars, 100 * shouted / n, 100 * len(_EXCLAIMED.findall(text)) / chars,
            100 * len(_SYMBOLS.findall(text)) / chars, 100 * obfuscated / n, 100 * hidden / n, math.log1p(n),
        ]


@dataclass
class ToxicityModel:
    """`trees` is None where a class was missing: then every text scores `share`. `curve` is None where none could be fitted."""

    lexicon: Lexicon
    share: float
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The columns of `docs` and `__x`, the vector of `FEATURES` of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.weights)

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Lexicon(shared.value)
        for texts in batches:
            yield pd.Series([words.features(t) for t in texts])

    return docs.withColumn("__x", array_to_vector(F.pandas_udf(measure, "array<double>")(F.col(f"`{text}`"))))


def fit_lexicon(sample: DataFrame) -> Lexicon:
    """Words (of three letters or more) that toxic documents hold more often than others: by documents, not occurrences."""
    words = sample.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("word"))
    sizes = sample.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    n_toxic, n_clean = sizes["t"] or 0, sizes["c"] or 0
    counts = words.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(F.col("t") >= LEAST_TOXIC)
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (n_toxic - F.col("t") + 0.5)) - F.log(c / (n_clean - F.col("c") + 0.5))
    error = F.sqrt(1 / t + 1 / (n_toxic - F.col("t") + 0.5) + 1 / c + 1 / (n_clean - F.col("c") + 0.5))
    chosen = counts.withColumn("weight", odds - 2 * error).where(F.col("weight") >= TIERS[1]).orderBy(F.desc("weight"), "word").limit(LEXICON_WORDS)
    return Lexicon({r["word"]: r["weight"] for r in chosen.collect()})


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: str = "toxic-1") -> ToxicityModel:
    """Lexicon, trees and calibration from the labelled documents, each from documents of its own.

    Labels other than 0 and 1 and null keys teach nothing; contradicting labels of a key count as 1, and of documents with the same key the
    smallest text teaches. At most `LABELLED_KEYS` keys are read, those of smallest seeded hash; the trees train on rows in that
    order in one partition, so the same rows give the same trees. A class without rows gives no trees (every score is the share of 1 among
    the labels, 0 without any) or no calibration (the score is the trees' probability).
    """
    order = hash60(F.concat(F.lit(f"{seed}:"), F.col("__k").cast("string")))
    told = labels.where(F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{key}`").alias("__k"), F.col(f"`{label}`").cast("int").alias("label"))
    told = told.where("__k is not null").groupBy("__k").agg(F.max("label").alias("label")).withColumn("h", order)
    keys = F.broadcast(told.orderBy("h", "__k").limit(LABELLED_KEYS))
    texts = docs.select(F.col(f"`{key}`").alias("__k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sample = stage(texts.join(keys, "__k").groupBy("__k", "label", "h").agg(F.min("text").alias("text")), "labelled")
    share = sample.agg(F.avg("label")).first()[0] or 0.0
    lexicon = fit_lexicon(sample.where(F.col("h") % 4 < 2))
    rows = stage(with_features(sample.where(F.col("h") % 4 > 1), lexicon).select("h", "label", "__x"), "features").coalesce(1).sortWithinPartitions("h", "label")
    seen = {(r["f"], r["label"]) for r in rows.select((F.col("h") % 4).alias("f"), "label").distinct().collect()}
    if not {(2, 0), (2, 1)} <= seen:
        return ToxicityModel(lexicon, share, None, None)
    trees = GBTClassifier(featuresCol="__x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, minInstancesPerNode=4, seed=1).fit(
        rows.where(F.col("h") % 4 == 2))
    if not {(3, 0), (3, 1)} <= seen:
        return ToxicityModel(lexicon, share, trees, None)
    judged = _raw(rows.where(F.col("h") % 4 == 3), trees)
    return ToxicityModel(lexicon, share, trees, IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="score").fit(judged))


def _raw(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    trees.setFeaturesCol("__x").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__v")
    return trees.transform(rows).withColumn("__p", vector_to_array("__v")[1]).drop("__v")


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` (1 from 0.5 on). Only the text is read; null, empty and blank texts have features of 0.

    Whole texts are measured, equal texts score alike, and every row gets a score.
    """
    rows = docs.select(packed(docs, carry), F.col(f"`{text}`").alias("__t"))
    if model.trees is None:
        scored = rows.withColumn("score", F.lit(float(model.share)))
    else:
        scored = _raw(with_features(rows, model.lexicon, "__t").drop("__t"), model.trees)
        scored = model.curve.setFeaturesCol("__p").setPredictionCol("score").transform(scored) if model.curve else scored.withColumn("score", F.col("__p"))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return unpacked(scored.withColumn("score", bounded).withColumn("predicted", (F.col("score") >= 0.5).cast("int")), OUTPUTS)
