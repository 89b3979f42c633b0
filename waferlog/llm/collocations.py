"""Collocations: exact phrase counts from windows cut where they turn rare, and the scores of phrases by their weakest cut."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

#: Characters that end a piece, and those that separate words inside one.
PIECE_ENDS = ".,;:!?\x0A\x0B\x0C\x0D"
WORD_GAPS = "\x20\x09"
#: Copies of a part's count, among which the cuts that ask for it are dealt.
SALTS = 4
#: Bits of the filter of frequent pairs: for each of them, in one of its rows, and at most (32 MB).
BITS_EACH, ROW_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

OUTPUTS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def padded_windows(docs: DataFrame, longest: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row per word: it and the `longest` - 1 words that follow in its piece (`w1`, `w2`, ...), padded with empty strings.

    The lead columns are the piece's word array shifted by one, two, ... places, so no row leaves its task.
    """
    plain = F.translate(
        F.coalesce(F.col(f"`{text}`"), F.lit("")),
        string.ascii_uppercase + PIECE_ENDS + WORD_GAPS, string.ascii_lowercase + "\n" * len(PIECE_ENDS) + " " * len(WORD_GAPS))
    pieces = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    words = pieces.select("lang", F.array_remove(F.split("piece", " "), "").alias("ws")).where(F.size("ws") > 0)
    shifted = [F.slice("ws", i, F.size("ws")).alias(f"w{i}") for i in range(1, longest + 1)]
    leads = words.select("lang", F.inline(F.arrays_zip(*shifted)))
    return leads.select("lang", *[F.coalesce(f"w{i}", F.lit("")).alias(f"w{i}") for i in range(1, longest + 1)])


def frequent_pairs(windows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """`row`, `bits` (array of long): a bit is set for every two words that occur `least` times or more in a language; and the number of bits.

    Only hashes are counted, and hashes may share a bit: some rarer pairs have theirs set as well, but no frequent pair lacks its own. A
    filter has `BITS_EACH` bits for each frequent pair, `MOST_BITS` at most; beyond that it lets more of the rare pairs through.
    """
    counted = windows.where("w2 <> ''").groupBy(F.hash("lang", "w1", "w2").alias("h")).agg(F.count("*").alias("f"))
    frequent = stage(counted.where(F.col("f") >= least).select("h"), "pairs")
    total = min(max(ROW_BITS, 1 << (BITS_EACH * frequent.count()).bit_length()), MOST_BITS)
    ones = frequent.select(F.shiftright(_place(F.col("h"), total), 6).cast("long").alias("id"), F.expr("shiftleft(1L, h & 63)").alias("bits"))
    none = windows.sparkSession.range(total // 64).withColumn("bits", F.lit(0).cast("long"))
    longs = ones.unionByName(none).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("id", "bits")))["bits"]
    return longs.groupBy((F.col("id") * 64 / ROW_BITS).cast("int").alias("row")).agg(in_order.alias("bits")), total


def cut_windows(windows: DataFrame, longest: int, least: int) -> DataFrame:
    """`key`: the language's hex digits and each window's words, joined by spaces, up to the first word that makes a rare pair with the one before."""
    rows, total = frequent_pairs(windows, least)
    on, words = F.lit(True), [F.hex("lang"), F.col("w1")]
    for i in range(2, longest + 1):
        place = _place(F.hash("lang", f"w{i - 1}", f"w{i}"), total)
        windows = windows.withColumn(f"p{i}", place).withColumn(f"r{i}", (F.col(f"p{i}") / ROW_BITS).cast("int"))
        windows = windows.join(F.broadcast(rows.select(F.col("row").alias(f"r{i}"), F.col("bits").alias(f"b{i}"))), f"r{i}")
        within = F.shiftright(F.col(f"p{i}").bitwiseAND(ROW_BITS - 1), 6)
        on = on & (F.col(f"w{i}") != "") & (F.getbit(F.get(f"b{i}", within), F.col(f"p{i}").bitwiseAND(63)) == 1)
        words.append(F.when(on, F.col(f"w{i}")))
    # One string per window takes half a shuffle's bytes of four columns. The language's hex digits and the words hold no space.
    return windows.select(F.concat_ws(" ", *words).alias("key"))


def _place(h: Column, total: int) -> Column:
    return h.bitwiseAND(total - 1)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """`lang`, `k`, `phrase`, `f`: every phrase of 1 to `longest` words that occurs `least` times or more, and each language's total (k = 0).

    Only padded windows are counted, each cut before the first word that makes a rare pair with the one before: no phrase that holds a rare
    pair is frequent. Summed over their last words, they give the shorter phrases: a frequent phrase of k words occurs as often as windows
    start with it, since a window that the piece ends early is padded rather than left out.
    """
    counted = cut_windows(padded_windows(docs, longest, text, lang), longest, least).groupBy("key").agg(F.count("*").alias("f"))
    # One condition over key and count stays above the aggregation, so that both branches read one exchange.
    whole = counted.where(F.when(F.col("f") >= least, F.size(F.split("key", " "))).otherwise(0) > longest)
    shorter = counted.groupBy(F.substring_index("key", " ", longest).alias("key")).agg(F.sum("f").alias("f")).withColumn("ws", F.split("key", " "))
    # The longest prefix has its sum already; ROLLUP sums those before it, down to the language.
    levels = [f"p{i}" for i in range(longest - 1)]
    rolled = shorter.select("f", *[F.get("ws", F.lit(i)).alias(p) for i, p in enumerate(levels)]).rollup(*levels).agg(
        F.sum("f").alias("f"), F.grouping_id().alias("g"))
    # It sums over the last columns, so the grouping id is a row of ones at the low end; a word's padding is null.
    k = F.lit(longest - 2) - F.bit_count("g")
    summed = rolled.where((k == 0) | ((k > 0) & (F.col("f") >= least))).select(F.concat_ws(" ", *levels).alias("key"), "f", k.alias("k"))
    real = summed.where(F.size(F.split("key", " ")) == F.col("k") + 1).select("key", "f")
    pairs = shorter.where(F.when(F.size("ws") == longest, F.col("f")).otherwise(0) >= least).select("key", "f")
    found = whole.unionByName(pairs).unionByName(real).withColumn("ws", F.split("key", " "))
    return found.select(
        F.decode(F.unhex(F.col("ws")[0]), "UTF-8").alias("lang"), (F.size("ws") - 1).alias("k"),
        F.array_join(F.slice("ws", 2, longest), " ").alias("phrase"), "f")


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    first: int = 2000,
    covered_percent: int = 50,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Each language's `first` phrases of 2 to `longest` words by score, with the counts that give it.

    A phrase that occurs a >= `least` times scores floor(1000000 a a / (l r)) at a cut into parts that occur l and r times; its weakest
    cut counts, ties go to the smaller first part. A phrase inside a longer candidate that has `covered_percent` of its occurrences or
    more is dropped. Texts count whole, a null text is empty, a null language is `und`; repeated rows count each. Arithmetic is in decimals
    of 38 digits, exact for corpora of up to 10^15 words. No word at all gives no rows. The tables past the counts hold frequent
    phrases only, and those that many cuts ask for are dealt over `SALTS` copies.
    """
    counts = stage(phrase_counts(docs, longest, least, text, lang), "phrases")
    candidates = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    return _ranked(counts, _uncovered(candidates, longest, covered_percent), first)


def _uncovered(candidates: DataFrame, longest: int, percent: int) -> DataFrame:
    inside = [
        F.array_join(F.slice("ws", i, k), " ")
        for n in range(3, longest + 1) for k in range(2, n) for i in range(1, n - k + 2)
    ]
    if not inside:
        return candidates
    fits = [(n, k, i) for n in range(3, longest + 1) for k in range(2, n) for i in range(1, n - k + 2)]
    parts = F.array(*[F.when(F.col("k") == n, part) for (n, _, _), part in zip(fits, inside)])
    covers = (
        candidates.where("k > 2").select("lang", "a", F.explode(parts).alias("phrase")).where("phrase is not null")
        .groupBy("lang", "phrase").agg((F.max("a") * 100).alias("longer"))
    )
    return candidates.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a") * percent)).drop("longer")


def _ranked(counts: DataFrame, candidates: DataFrame, first: int) -> DataFrame:
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cuts = salted.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", "salt",
        F.array_join(F.slice("ws", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("ws", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    parts = counts.where("k > 0").select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = parts.select("lang", "salt", F.col("part").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", "salt", F.col("part").alias("right"), F.col("f").alias("r"))
    exact = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    numerator = F.lit(1000000).cast("decimal(7,0)") * (exact["a"] * exact["a"])
    told = (
        cuts.join(left, ["lang", "salt", "left"]).join(right, ["lang", "salt", "right"])
        .withColumn("top", numerator).withColumn("bottom", exact["l"] * exact["r"])
    )
    weakest = told.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "cut", "l", "r")).alias("w"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = weakest.select("lang", "phrase", "a", "w.l", "w.r", "w.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select(*[F.col(c).cast("long") if c not in ("lang", "phrase") else F.col(c) for c in OUTPUTS])
