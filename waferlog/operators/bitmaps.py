"""Keyword results as bitmaps over timeline positions, so that combinations of known words need no text.

A bitmap table has rows (term, word, bits): bit b of `bits` stands for the entry at position 64 * word + b. Words without a bit are left
out. The term NULL stands for every entry, which is what an exclusion alone starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_keywords, normalize_sxfy, strip
from ..schema import shown
from .search import match_terms

WORD_BITS = 64
INDEX = "timeline_index"


def _bitmaps(positions: DataFrame) -> DataFrame:
    """`positions(term, timeline_index)` as bitmaps; aggregation starts before the shuffle."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(INDEX) % WORD_BITS).cast("int"))
    return positions.groupBy("term", F.floor(F.col(INDEX) / WORD_BITS).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _terms(keywords: DataFrame) -> DataFrame:
    """Words as the search takes them: trimmed, SxFyW as SxFy, in small letters."""
    return keywords.select(F.lower(normalize_sxfy(strip(F.col("keyword")))).alias("term")).filter("term <> ''").distinct()


def build(indexed: DataFrame, keywords: DataFrame) -> DataFrame:
    """Bitmaps of a `keywords(keyword)` table of any size over an indexed timeline; literal, any case. Words that no entry holds have one
    row with no bit, so that they count as known."""
    terms = _terms(keywords)
    hits = match_terms(indexed, [INDEX], [normalize_sxfy(shown(indexed))], terms).select("term", INDEX)
    every = indexed.select(F.lit(None).cast("string").alias("term"), INDEX)
    known = terms.select("term", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"))
    maps = _bitmaps(hits.unionByName(every)).unionByName(known)
    return maps.groupBy("term", "word").agg(F.bit_or("bits").alias("bits"))


def extend(bitmaps: DataFrame, indexed: DataFrame, keywords: DataFrame) -> DataFrame:
    """The rows that a stored table lacks for these words: texts are read only for words that it doesn't know."""
    new = _terms(keywords).join(bitmaps.select("term").distinct(), "term", "left_anti").withColumnRenamed("term", "keyword")
    return build(indexed, new).filter("term IS NOT NULL")


def write(bitmaps: DataFrame, path: str) -> None:
    """Sorted by term, so that a read of some terms skips the row groups of others."""
    bitmaps.repartitionByRange("term", "word").sortWithinPartitions("term", "word").write.mode("append").parquet(path)


def combine(bitmaps: DataFrame, keywords=(), or_keywords=(), exclude_keywords=(), *, match_all: bool = True) -> DataFrame:
    """(word, bits) of the entries that a search for these words finds: (all AND) OR (any OR), then no excluded one.

    One list alone decides if the other is empty; no word at all finds nothing. A word that the table doesn't know is an error, since
    its entries can't be told from the bitmaps.
    """
    lists = [[_plain(w) for w in clean_keywords(words)] for words in (keywords, or_keywords, exclude_keywords)]
    must, may, never = lists
    wanted = sorted({w for words in lists for w in words})
    if not wanted:
        return bitmaps.select("word", "bits").limit(0)
    unknown = set(wanted) - {r["term"] for r in bitmaps.filter(F.col("term").isin(wanted)).select("term").distinct().collect()}
    if unknown:
        raise KeyError(f"no bitmap of {sorted(unknown)}; extend the table first")
    from_all = not (must or may)
    chosen = F.col("term").isin(wanted) | F.col("term").isNull() if from_all else F.col("term").isin(wanted)
    of = {w: F.coalesce(F.bit_or(F.when(F.col("term") == w, F.col("bits"))), F.lit(0).cast("long")) for w in wanted}
    every = F.coalesce(F.bit_or(F.when(F.col("term").isNull(), F.col("bits"))), F.lit(0).cast("long"))

    def fold(words: list[str], both: bool) -> Column:
        out = of[words[0]]
        for w in words[1:]:
            out = out.bitwiseAND(of[w]) if both else out.bitwiseOR(of[w])
        return out

    keep = [fold(words, both) for words, both in ((must, match_all), (may, False)) if words]
    bits = keep[0].bitwiseOR(keep[-1]) if keep else every
    for w in never:
        bits = bits.bitwiseAND(F.bitwise_not(of[w]))
    return bitmaps.filter(chosen).groupBy("word").agg(bits.alias("bits")).filter("bits <> 0")


def _plain(word: str) -> str:
    """As `_terms`, for a word of the driver; `clean_keywords` has trimmed it and settled SxFyW."""
    return word.lower()


def positions(combined: DataFrame) -> DataFrame:
    """The timeline positions of set bits."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(WORD_BITS - 1))).alias("bit")
    spread = combined.select("word", "bits", bit).filter(F.getbit("bits", F.col("bit")) == 1)
    return spread.select((F.col("word") * WORD_BITS + F.col("bit")).alias(INDEX))


def count(combined: DataFrame) -> DataFrame:
    """How many entries a combination has, without making positions."""
    return combined.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("entries"))
