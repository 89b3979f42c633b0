"""Arrays inside a row: cutting, and running sums."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Numbers whose running sums are appended one by one; longer arrays are summed in chunks of so many, or of the root of their number.
CHUNK = 8


def bind(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use`; a plain Column would be evaluated at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def positions(rows: Column, test) -> Column:
    """0-based positions of the rows that pass `test(row, position)`."""
    return F.filter(F.transform(rows, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def cut(rows: Column, starts: Column) -> Column:
    """Slices of `rows`, one from each position in `starts` to the next."""
    return F.transform(starts, lambda at, m: F.slice(rows, at + 1, F.coalesce(F.get(starts, m + 1), F.size(rows)) - at))


def sums_before(numbers: Column) -> Column:
    """For each of the numbers (no NULLs), the sum of those before it.

    Appending copies an array, so sums are taken inside chunks and then moved by the sums of the chunks before.
    """

    def running(values: Column) -> Column:
        return F.aggregate(
            values, F.array(F.lit(0).cast("long")), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x.cast("long"))
        )

    def moved(chunks: Column) -> Column:
        return bind(
            running(F.transform(chunks, lambda sums: F.element_at(sums, -1))),
            lambda base: F.flatten(
                F.transform(
                    chunks, lambda sums, m: F.transform(F.slice(sums, 1, F.size(sums) - 1), lambda x: x + F.get(base, m))
                )
            ),
        )

    def chunked(values: Column) -> Column:
        last = F.size(values) - 1
        return bind(
            F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(values))).cast("int")),
            lambda size: F.transform(
                F.when(last >= 0, F.sequence(F.lit(0), last, size)).otherwise(F.array().cast("array<int>")),
                lambda at: running(F.slice(values, at + 1, size)),
            ),
        )

    return bind(numbers, lambda values: bind(chunked(values), moved))
