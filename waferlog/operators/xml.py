"""Complete XML pieces embedded in messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .search import highlight_spans

#: Item tags of host messages, which are no XML.
SECS_ITEMS = ("L", "A", "B", "BOOLEAN", "I1", "I2", "I4", "I8", "U1", "U2", "U4", "U8", "F4", "F8")

#: A comment, a CDATA section, or a tag; an attribute's value holds no `<` or `>`.
_MARK = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|</?[A-Za-z_][A-Za-z0-9_:.-]*(?:\s[^<>]*)?/?>"
_NAME = r"^</?([A-Za-z_][A-Za-z0-9_:.-]*)"


def tags(messages: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, start, end, name, step): tags in their messages, by character offsets; step is 1 for a start tag, -1 for an end tag, 0 for one that is both.

    Comments, CDATA sections and item tags are left out. Messages without a `</` or `/>` have none that could close and are not searched.
    """
    closing = F.contains(F.col(text), F.lit("</")) | F.contains(F.col(text), F.lit("/>"))
    spans = highlight_spans(F.col(text), [_MARK], case_sensitive=True, use_regex=True)
    found = messages.filter(closing).select(*key, text, F.explode(spans).alias("s"))
    tag = F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    step = F.when(F.startswith("tag", F.lit("</")), -1).when(F.endswith("tag", F.lit("/>")), 0).otherwise(1)
    rows = found.select(*key, F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), tag.alias("tag"))
    named = rows.select(*key, "start", "end", F.regexp_extract("tag", _NAME, 1).alias("name"), step.alias("step"))
    return named.filter((F.col("name") != "") & ~F.upper("name").isin(*SECS_ITEMS))


def xml_pieces(messages: DataFrame, key: list[str], text: str = "message") -> DataFrame:
    """(key, start, end, name, tags): the outermost well-formed `<name ...>...</name>` and `<name/>` of each message; `key` is unique.

    Depth is a running sum over a message's tags. A start tag meets the next tag at its own depth, which is the end tag that closes it if the
    names agree; a piece is well-formed if that holds for every tag inside it. `tags` counts its start tags, its own included. Offsets
    are of characters, the end exclusive. Empty and NULL messages have no pieces. A window holds one message's tags.
    """
    # All windows are over the message first, so one shuffle of slim rows serves them.
    order = Window.partitionBy(*key).orderBy("start")
    same_depth = Window.partitionBy(*key, "_depth").orderBy("start")

    def following(name: str) -> Column:
        return F.lead(name).over(same_depth)

    def preceding(name: str) -> Column:
        return F.lag(name).over(same_depth)

    # A start tag and the end tag that closes it have the same depth; a tag that is both has a depth of its own, beside no other.
    depth = F.sum("step").over(order) + F.when(F.col("step") == -1, 1).otherwise(0)
    placed = tags(messages, key, text).withColumn("_depth", F.when(F.col("step") != 0, depth))
    opens = (F.col("step") == 1) & (following("step") == -1) & (following("name") == F.col("name"))
    closes = (F.col("step") == -1) & (preceding("step") == 1) & (preceding("name") == F.col("name"))
    single = F.col("step") == 0
    paired = placed.withColumns({
        "_good": F.coalesce(opens | closes, F.lit(False)) | single,
        "_close": F.when(single, F.col("end")).when(F.coalesce(opens, F.lit(False)), following("end")),
    })
    counted = paired.withColumns({
        "_bad": F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(order),
        "_starts": F.sum(F.when(F.col("step") >= 0, 1).otherwise(0)).over(order),
    })
    # At its end tag, a piece must have seen no more tags that lack a partner than at its start tag.
    whole = counted.withColumns({
        "_clean": F.col("_close").isNotNull() & (single | (following("_bad") == F.col("_bad"))),
        "tags": F.when(single, F.lit(1).cast("long")).otherwise(following("_starts") - F.col("_starts") + 1),
    })
    reach = F.max(F.when(F.col("_clean"), F.col("_close"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = whole.withColumn("_reach", reach).filter(F.col("_clean") & (F.col("_reach").isNull() | (F.col("_reach") <= F.col("start"))))
    return outer.select(*key, "start", F.col("_close").alias("end"), "name", "tags")


def with_texts(pieces: DataFrame, messages: DataFrame, key: list[str], text: str = "message") -> DataFrame:
    """Adds `piece`, the piece's text: pieces of a message gather first, so its text meets them once."""
    own = pieces.select(*key, F.struct(*[c for c in pieces.columns if c not in key]).alias("p"))
    joined = own.groupBy(*key).agg(F.collect_list("p").alias("_pieces")).join(messages.select(*key, text), key)
    piece = F.substring(F.col(text), (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int"))
    return joined.select(*key, text, F.explode("_pieces").alias("p")).select(*key, "p.*", piece.alias("piece"))
