"""Aligned differences, against a plain version of the rule on lists."""

from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from waferlog.operators import align


def plain(left, right):
    """(left_no, right_no) of equal lines."""
    out = []

    def gap(a, b, c, d):
        """Lines a to b - 1 of the left side against c to d - 1 of the right one."""
        if a >= b or c >= d:
            return
        found, low, high = [], 0, 0
        while a + low < b and c + low < d and left[a + low] == right[c + low]:
            found.append((a + low, c + low))
            low += 1
        while high < min(b - a, d - c) - low and left[b - 1 - high] == right[d - 1 - high]:
            found.append((b - 1 - high, d - 1 - high))
            high += 1
        ls, rs = left[a + low : b - high], right[c + low : d - high]
        nl, nr = Counter(ls), Counter(rs)
        words = [w for w in nl if nl[w] == nr[w] == 1] or [w for w in nl if w in nr]
        anchors = sorted((a + low + ls.index(w), c + low + rs.index(w)) for w in words)
        by_right = sorted(anchors, key=lambda x: x[1])
        runs = []
        for i, x in enumerate(anchors):
            j = by_right.index(x)
            if i and j and anchors[i - 1] == by_right[j - 1]:
                runs[-1].append(x)
            else:
                runs.append([x])
        kept = []
        for run in sorted(runs, key=lambda r: (-len(r), r[0])):
            if all((run[0][0] < k[0][0]) == (run[0][1] < k[0][1]) for k in kept):
                kept.append(run)
        found = sorted(found + [x for run in kept for x in run])
        if not found:
            return
        out.extend(found)
        edges = [(a - 1, c - 1), *found, (b, d)]
        for (l, r), (m, s) in zip(edges, edges[1:]):
            gap(l + 1, m, r + 1, s)

    gap(0, len(left), 0, len(right))
    return sorted((l + 1, r + 1) for l, r in out)


def marks(equal, nl, nr):
    out, edges = [("equal", l, r) for l, r in equal], [(0, 0), *equal, (nl + 1, nr + 1)]
    for (l, r), (m, s) in zip(edges, edges[1:]):
        a, b = list(range(l + 1, m)), list(range(r + 1, s))
        for i in range(max(len(a), len(b))):
            mark = "delete" if i >= len(b) else "insert" if i >= len(a) else "replace"
            out.append((mark, a[i] if i < len(a) else None, b[i] if i < len(b) else None))
    return sorted(out, key=repr)


def check(spark, cases, block_rows):
    pairs = spark.createDataFrame(
        [(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(cases)], "pair_id long, left string, right string")
    got = {i: [] for i in range(len(cases))}
    for r in align.aligned_diff(align.lines_of(pairs, "left"), align.lines_of(pairs, "right"), block_rows).collect():
        got[r["pair_id"]].append((r["mark"], r["left_no"], r["right_no"]))
    for i, (a, b) in enumerate(cases):
        a, b = "\n".join(a).split("\n"), "\n".join(b).split("\n")
        equal = plain(a, b)
        assert sorted(got[i], key=repr) == marks(equal, len(a), len(b)), (a, b)
        assert all(a[l - 1] == b[r - 1] for l, r in equal) and all(x[1] < y[1] for x, y in zip(equal, equal[1:]))


CASES = [
    ("abc", "abc"), ("abc", "axc"), ("abc", "ac"), ("ac", "abc"), ("ab", "ba"), ("abcdef", "defabc"), ("abcdxyz", "xyzabcd"),
    ("aaa", "aaaa"), ("ababa", "bababa"), ("", ""), ("", "a"), ("a", ""), ("abc", "xyz"), ("abcde", "edcba"),
    ("abcabc", "cbacba"), ("1a2b3c4", "5c6a7b8"), ("abxcdyef", "efxabycd"), ("a" * 40 + "b", "b" + "a" * 40),
    ("qwertyuiop", "qwxrtpuioy"),
]


def test_cases(spark):
    check(spark, CASES, 2)


def test_moved_lines_are_not_equal(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "b\na\nc")], "pair_id long, left string, right string")
    rows = align.aligned_diff(align.lines_of(pairs, "left"), align.lines_of(pairs, "right")).collect()
    assert sorted(tuple(r)[1:] for r in rows if r["mark"] == "equal") == [("equal", 1, 2), ("equal", 3, 3)]
    assert sorted(r["mark"] for r in rows if r["mark"] != "equal") == ["delete", "insert"]


def test_nulls_and_empty_tables(spark):
    pairs = spark.createDataFrame([(1, None, "a"), (None, "a", "a"), (2, None, None)], "pair_id long, left string, right string")
    sides = [align.lines_of(pairs, n) for n in ("left", "right")]
    assert [tuple(r) for r in align.aligned_diff(*sides).collect()] == [(1, "insert", None, 1)]
    assert align.aligned_diff(*[s.filter("false") for s in sides]).count() == 0


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdefghij"), max_size=14), st.permutations("abcdefghijkl")), min_size=60, max_size=60))
def test_random_lines(spark, cases):
    check(spark, [(a, b) for a, b in cases] + [(sorted(b), b) for _, b in cases], 3)
