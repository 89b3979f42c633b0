"""SECS-II message bodies: event ids, and the item tree that indentation spells out.

The tree comes from array functions on the lines of a message: nothing is shuffled to learn a line's parent, and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import bind, cut, positions

_ITEM = r"(?s)^([ \t]*)<([A-Z0-9]+)\s+\[(\d+)\](?:\s+(.*?))?\s*>"
_SECOND_NUMBER = r"(?s)<[A-Z0-9]+\s+\[\d+\]\s+\d+\s*>.*?<[A-Z0-9]+\s+\[\d+\]\s+(\d+)\s*>"
_INLINE_CEID = r"(?iuU)\bCEID\s*=\s*(\d+)\b"

def inline_ceid(text: Column) -> Column:
    # The plain test spares most texts the case-insensitive pattern.
    hinted = F.contains(F.lower(text), F.lit("ce"))
    return F.when(hinted, F.regexp_extract(text, _INLINE_CEID, 1).try_cast("long"))


def second_number(text: Column) -> Column:
    """The second numeric item of a body; in an event report that is the event id."""
    return F.regexp_extract(text, _SECOND_NUMBER, 1).try_cast("long")


def message_ceid(message: Column) -> Column:
    """Inline `CEID = n` wins; otherwise the second number of an S6F11 body."""
    return F.coalesce(inline_ceid(message), F.when(F.contains(message, F.lit("S6F11")), second_number(message)))


def _items(message: Column) -> Column:
    """The `<TYPE [n] value>` lines of a message, in order."""
    lines = F.transform(F.split(message, "\n"), lambda text, line: F.struct(line.alias("line"), text.alias("text")))

    def fields(found: Column) -> Column:
        indent, kind, count, value = (F.regexp_extract(found["text"], _ITEM, group) for group in range(1, 5))
        return F.struct(
            found["line"].alias("line"), F.length(indent).alias("indent"), kind.alias("type"), count.alias("count"), value.alias("value")
        )

    return F.transform(F.filter(lines, lambda x: x["text"].rlike(_ITEM)), fields)


def _with_parents(items: Column) -> Column:
    """Items with the line of their parent, the nearest earlier item with a smaller indent (-1: none).

    Cut before every item that is shallower than a level, the items of that level belong to the head of their slice. The slices of a
    level are disjoint, so the work grows with items times distinct indents.
    """
    ground = F.struct(
        F.lit(-1).alias("line"), F.lit(-1).alias("indent"), F.lit("").alias("type"), F.lit("").alias("count"), F.lit("").alias("value")
    )

    def of_section(section: Column, level: Column) -> Column:
        return F.transform(
            F.filter(section, lambda x: x["indent"] == level),
            lambda x: F.struct(F.get(section, F.lit(0))["line"].alias("up1"), x["line"], x["indent"], x["type"], x["count"], x["value"]),
        )

    def of_level(rows: Column, level: Column) -> Column:
        shallower = positions(rows, lambda x, _: x["indent"] < level)
        sections = bind(shallower, lambda starts: cut(rows, starts))
        return F.flatten(F.transform(sections, lambda section: of_section(section, level)))

    levels = F.array_distinct(F.transform(items, lambda x: x["indent"]))
    return bind(
        F.concat(F.array(ground), items), lambda rows: F.flatten(F.transform(levels, lambda level: of_level(rows, level)))
    )


def _families(children: Column) -> Column:
    """Children by parent, in the order of lines, each with its place among its siblings."""

    def by_parent(rows: Column) -> Column:
        first = positions(rows, lambda x, i: ~x["up1"].eqNullSafe(F.get(rows, i - 1)["up1"]))
        return bind(first, lambda starts: cut(rows, starts))

    return F.transform(
        bind(F.sort_array(children), by_parent),
        lambda family: F.transform(
            family,
            lambda x, i: F.struct(
                x["line"], x["indent"], x["type"], x["count"], x["value"], F.when(x["up1"] >= 0, i + 1).alias("ord"), x["up1"]
            ),
        ),
    )


def item_nodes(message: Column) -> Column:
    """All `<TYPE [n] value>` lines of a message with their place in the tree; NULL for a NULL message.

    `line` is the 0-based line, `ord` the 1-based position among its siblings, `up1` and `up2` the lines of its parent and
    grandparent (NULL at the top). An item's parent is the nearest earlier item with a smaller indent.
    """

    def attach(families: Column) -> Column:
        # An item followed by a deeper one is a parent; in the order of lines, parents and families go in step. Family 0 has no parent.
        ordered = F.sort_array(F.flatten(families))
        parents = bind(
            ordered, lambda rows: F.filter(rows, lambda x, i: F.coalesce(F.get(rows, i + 1)["indent"] > x["indent"], F.lit(False)))
        )

        def with_parent(family: Column, parent: Column) -> Column:
            return F.transform(
                family,
                lambda x: F.struct(
                    x["line"], x["indent"], x["type"], x["count"], x["value"], x["ord"], F.nullif(x["up1"], F.lit(-1)).alias("up1"),
                    parent["type"].alias("up1_type"), parent["ord"].alias("up1_ord"), F.nullif(parent["up1"], F.lit(-1)).alias("up2"),
                ),
            )

        def all_families(parents: Column) -> Column:
            return F.flatten(
                F.transform(families, lambda family, m: bind(F.get(parents, m - 1), lambda parent: with_parent(family, parent)))
            )

        return F.sort_array(bind(parents, all_families))

    return bind(_items(message), lambda items: bind(_families(_with_parents(items)), attach))


def body_line(nodes: Column) -> Column:
    """Line of the body: the first L item with at least three children, i.e. the smallest parent of a third child."""
    thirds = F.filter(nodes, lambda n: (n["ord"] == 3) & (n["up1_type"] == "L"))
    return F.array_min(F.transform(thirds, lambda n: n["up1"]))


def int_value(node: Column) -> Column:
    """First integer inside an item's value."""
    return F.regexp_extract(node["value"], r"(-?\d+)", 1).try_cast("long")


def report_ids(nodes: Column, body: Column) -> Column:
    """(report line, RPTID, id line) of every report of the body's report list that has at least two children."""
    listing = F.get(F.filter(nodes, lambda n: (n["up1"] == body) & (n["ord"] == 3)), F.lit(0))["line"]

    def from_parts(parts: Column) -> Column:
        complete = F.transform(F.filter(parts, lambda n: n["ord"] == 2), lambda n: n["up1"])
        return bind(
            complete,
            lambda reports: F.transform(
                F.filter(
                    parts,
                    lambda n: (n["ord"] == 1) & F.array_contains(reports, n["up1"]) & int_value(n).isNotNull(),
                ),
                lambda n: F.struct(n["up1"].alias("report"), int_value(n).alias("rptid"), n["line"].alias("id_line")),
            ),
        )

    # `parts` are the first and second children of the listed reports.
    return bind(
        listing,
        lambda at: bind(
            F.filter(nodes, lambda n: (n["up2"] == at) & (n["up1_type"] == "L") & (n["ord"] <= 2)), from_parts
        ),
    )


_OPEN = "array<struct<at:int,indent:int,list:boolean,n:int>>"


def _first_numbers(message: Column) -> Column:
    """The ids that `report_ids` finds, in one walk over the items that keeps the open ones, their children counted, and the body so far.

    The body is the first list with a third child, so an earlier list that gets its third child later takes its place.
    """
    texts = F.filter(F.split(message, "\n"), lambda text: text.rlike(_ITEM))
    items = F.transform(
        texts,
        lambda text, i: F.struct(
            i.alias("at"), (F.length(text) - F.length(F.ltrim(text, F.lit(" \t")))).alias("indent"), text.rlike(r"^[ \t]*<L\s").alias("list"),
            text.alias("text")),
    )
    none, no_id = F.array().cast("array<bigint>"), F.lit(None).cast("long")

    def state(stack: Column, body: Column, listing: Column, first: Column, ids: Column) -> Column:
        return F.struct(stack.alias("stack"), body.alias("body"), listing.alias("listing"), first.alias("first"), ids.alias("ids"))

    def step(s: Column, x: Column) -> Column:
        def under(above: Column) -> Column:
            depth = F.size(above)
            parent, grand = F.get(above, depth - 1), F.get(above, depth - 2)
            counted = F.transform(
                above, lambda o, i: F.struct(o["at"], o["indent"], o["list"], F.when(i == depth - 1, o["n"] + 1).otherwise(o["n"]).alias("n")))
            stack = F.concat(counted, F.array(F.struct(x["at"], x["indent"], x["list"], F.lit(0).alias("n")))).cast(_OPEN)
            third = parent["list"] & (parent["n"] == 2) & F.coalesce(parent["at"] < s["body"], F.lit(True))
            reported = parent["list"] & (grand["at"] == s["listing"])
            value = F.struct(F.regexp_extract(x["text"], _ITEM, 4).alias("value"))
            return (
                F.when(third, state(stack, parent["at"], x["at"], no_id, none))
                .when(reported & (parent["n"] == 0), state(stack, s["body"], s["listing"], int_value(value), s["ids"]))
                .when(
                    reported & (parent["n"] == 1) & s["first"].isNotNull(),
                    state(stack, s["body"], s["listing"], no_id, F.concat(s["ids"], F.array(s["first"]))))
                .otherwise(state(stack, s["body"], s["listing"], s["first"], s["ids"]))
            )

        return bind(F.filter(s["stack"], lambda o: o["indent"] < x["indent"]), under)

    start = state(F.array().cast(_OPEN), F.lit(None).cast("int"), F.lit(None).cast("int"), no_id, none)
    return F.aggregate(items, start, step, lambda s: s["ids"])


def message_rptids(message: Column) -> Column:
    """Sorted distinct report ids of an S6F11 message; an empty array for any other message."""
    none = F.array().cast("array<bigint>")
    ids = F.sort_array(F.array_distinct(_first_numbers(message)))
    return F.coalesce(F.when(F.contains(message, F.lit("S6F11")), ids), none)
