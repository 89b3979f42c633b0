"""Quality rules whose cutoffs are chosen on labelled holdouts with exact binomial bounds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage
from .common import ROW, packed, unpacked

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
KIND = ", ".join(f"{m} long" for m in MEASURES)
# The symbols counted, the white space between words, the length of repeated windows.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5

#: Of the good documents of a stratum, the share that all rules together may reject, and the probability that this fails anywhere.
MOST_REJECTED = 0.05
FAILURE = 0.05
#: A rejected good document counts as much as so many bad ones when a cutoff is chosen among the certified ones.
GOOD_COST = 10

OUTPUTS = [*MEASURES, "base_failed", "kept", "reasons"]


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose measure per base, times `scale` and rounded down, is over a cutoff; `cutoffs` run from mild to strict."""

    name: str
    measure: str
    base: str
    scale: int
    cutoffs: tuple[int, ...]

    def value(self) -> Column:
        return F.expr(f"cast(({self.scale} * {self.measure}) div nullif({self.base}, 0) as long)")


RULES = (
    Rule("symbols", "n_symbols", "n_words", 1000, (2000, 1500, 1000, 700, 500, 300, 200, 150, 100, 70, 50, 30, 20, 10)),
    Rule("repeats", "n_repeat_words", "n_words", 1000, (180, 150, 120, 100, 80, 60, 40, 20)),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1000, (900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 50)),
    Rule("word_length", "word_chars", "n_words", 100, (3000, 2000, 1500, 1300, 1200, 1100, 1000, 900)),
)


def measure(text: str | None) -> tuple[int, ...]:
    """Words are runs of anything but ASCII white space; see `MEASURES`."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    chars = len(text or "") - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            often = {w for w, times in Counter(windows).items() if times > 1}
            end = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeated += i + WINDOW - max(end, i)
                    end = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Carried columns in one struct beside the measures of the whole text; a null text has no words."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")

    return docs.select(packed(docs, carry), F.pandas_udf(run, KIND)(F.col(f"`{text}`")).alias("__m")).select(ROW, "__m.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(Bin(n, p) <= k), by the continued fraction of the incomplete beta function: the exact one-sided test of a rate under p."""

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        total = d
        for m in range(1, 100_000):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + top * d), 1 + top / c
                total *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return float(front * total / a)

    return np.array([1.0 if a >= b else beta(b - a, a + 1, 1 - p) for a, b in zip(k, n)])


def stratum_key(column: str) -> Column:
    return F.when(F.col(f"`{column}`").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(f"`{column}`").cast("string")))


def choose_cutoffs(labelled: DataFrame, rules: Sequence[Rule] = RULES, most_rejected: float = MOST_REJECTED, failure: float = FAILURE, good_cost: int = GOOD_COST) -> DataFrame:
    """One row per stratum (`stratum`) and rule (`rule`) whose chosen `cutoff` is certified, with the counts it rests on.

    `labelled` has `stratum`, `good` (boolean) and the measures of the holdout. For each stratum and rule, cutoffs are tested from mild to
    strict: the exact binomial test must reject that the rule loses more than `most_rejected` / rules of the good documents, at level
    `failure` / (strata * rules). The sequence stops at the first cutoff that isn't certified, which keeps the error of the whole sequence
    at its level; the division over strata and rules (Bonferroni) keeps all of them at `failure`. Of the certified cutoffs, the one
    that rejects the largest share of bad documents less `good_cost` times the share of good ones is chosen, the mildest of equals; a rule
    without a gain rejects nothing. A stratum with too few good documents has no certified cutoff, and its documents are rejected by no rule.

    Holdout rows meet as counts per stratum, so their number doesn't matter.
    """
    counts = [F.count("*").alias("n")] + [
        F.sum((F.col(f"v{r}") > c).cast("long")).alias(f"r{r}_{i}") for r, rule in enumerate(rules) for i, c in enumerate(rule.cutoffs)]
    values = labelled.select("stratum", "good", *[rule.value().alias(f"v{r}") for r, rule in enumerate(rules)])
    summed = values.groupBy("stratum", "good").agg(*counts)
    cells = F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.lit(i).alias("strictness"), F.lit(c).cast("long").alias("cutoff"), F.coalesce(F.col(f"r{r}_{i}"), F.lit(0)).alias("k"))
        for r, rule in enumerate(rules) for i, c in enumerate(rule.cutoffs)])
    long = summed.select("stratum", "good", "n", F.inline(cells))
    good = F.col("good")
    tested = long.groupBy("stratum", "rule", "strictness", "cutoff").agg(
        *[F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(f"{c}_{name}") for c in ("n", "k") for name, side in (("good", good), ("bad", ~good))])
    tested = stage(tested, "tested")
    n_strata = max(1, tested.where("n_good > 0").select("stratum").distinct().count())
    level = failure / (n_strata * len(rules))

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(binomial_tail(k.to_numpy(), n.to_numpy(), most_rejected / len(rules)))

    milder = Window.partitionBy("stratum", "rule").orderBy("strictness").rowsBetween(Window.unboundedPreceding, 0)
    certified = tested.withColumn("p_value", tail("k_good", "n_good")).withColumn("worst", F.max("p_value").over(milder)).where(F.col("worst") <= level)
    gain = F.col("k_bad") * F.col("n_good") - good_cost * F.col("k_good") * F.col("n_bad")
    pick = certified.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(
        F.max_by(F.struct("cutoff", "n_good", "k_good", "n_bad", "k_bad", "p_value"), F.struct("gain", -F.col("strictness"))).alias("c"))
    return pick.select("stratum", "rule", "c.*")


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    rules: Sequence[Rule] = RULES,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the measures, `base_failed`, `kept` and `reasons` (names of the rules that reject).

    The holdout is every labelled document that passes the base checks; label 1 is good, 0 bad, a null label or key teaches nothing. A
    document labelled both ways counts as both; repeated equal labels count once, repeated documents each. A null stratum is a stratum of
    its own. Null and empty texts fail the base. With no labels, nothing is certified and only the base rejects. Ties at a cutoff stay.
    """
    rows = docs.select(packed(docs, carry), F.col(f"`{key}`").alias("__k"), stratum_key(stratum).alias("__s"), F.col(f"`{text}`").alias("__text"))
    known = stage(measured(rows, "__text", [ROW, "__k", "__s"]).select(
        F.col(f"{ROW}.{ROW}").alias(ROW), F.col(f"{ROW}.__k").alias("__k"), F.col(f"{ROW}.__s").alias("__s"), *MEASURES), "measured")
    told = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("__k"), (F.col(f"`{label}`") == 1).alias("good")).distinct()
    holdout = known.where(~base_failed()).join(told, "__k").select(F.col("__s").alias("stratum"), "good", *MEASURES)
    chosen = choose_cutoffs(holdout, rules)
    wide = stage(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"__c_{r.name}") for r in rules]), "cutoffs")
    over = [F.when(r.value() > F.col(f"__c_{r.name}"), F.lit(r.name)) for r in rules]
    judged = known.join(wide, F.col("__s") == F.col("stratum"), "left").withColumn("base_failed", base_failed()).withColumn(
        "reasons", F.array_compact(F.array(*over)))
    return unpacked(judged.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)), OUTPUTS)
