"""Text expressions. Everything here is a Column built from JVM-side functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters that count as white space when text is trimmed.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SXFY = r"(?iuU)\b(S\d+F\d+)W?\b"
_SXFY_W = r"(?iuU)\b(S\d+F\d+)W\b"
# What any match holds, told faster than by those patterns: letters that fold to S and F (and W) around digits.
_SXFY_HINT = r"(?U)[Ss\u017f]\d+[Ff]\d"
_SXFY_W_HINT = _SXFY_HINT + r"+[Ww]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """`regexp_extract` that yields NULL, not '', when nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_millis(ts: Column) -> Column:
    """TIMESTAMP_NTZ to epoch milliseconds, independent of the session zone."""
    seconds = (ts - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)")
    return F.floor(seconds * 1000).cast("long")


def from_millis(ms: Column) -> Column:
    """Epoch milliseconds to TIMESTAMP_NTZ, independent of the session zone."""
    seconds = (ms.cast("decimal(18,0)") / 1000).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds)


def moment(value) -> Column:
    """A datetime as a TIMESTAMP_NTZ literal; a datetime literal of Spark's own would be moved by the session zone."""
    return value if isinstance(value, Column) else F.lit(value.isoformat(" ")).cast("timestamp_ntz")


def display_time(ts: Column, with_date: bool = True) -> Column:
    """`yyyy-MM-dd HH:mm:ss:SSS`, cut (not rounded) to milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss:SSS" if with_date else "HH:mm:ss:SSS")


def parse_time(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss:SSS` to TIMESTAMP_NTZ; NULL for an impossible date."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss:SSS")).cast("timestamp_ntz")


# ---------------------------------------------------------------- SxFy


def normalize_sxfy(text: Column) -> Column:
    """`S6F11W` and `S6F11` read alike: the reply-wanted `W` is dropped."""
    return F.when(text.rlike(_SXFY_W_HINT), F.regexp_replace(text, _SXFY_W, "$1")).otherwise(text)


def normalize_sxfy_word(keyword: str) -> str:
    return re.sub(r"\b(S\d+F\d+)W\b", r"\1", keyword, flags=re.I)


def sxfy_type(message: Column) -> Column:
    """First SxFy of a message, upper case, without the W."""
    return F.when(message.rlike(_SXFY_HINT), F.upper(extract(message, SXFY)))


def all_sxfy(message: Column) -> Column:
    return F.transform(F.regexp_extract_all(message, F.lit(SXFY), F.lit(1)), F.upper)


# ---------------------------------------------------------------- keywords


def clean_keywords(keywords) -> list[str]:
    """Trimmed, SxFyW-normalised, blanks removed, order kept."""
    return [normalize_sxfy_word(k.strip()) for k in keywords or [] if k.strip()]


def _touches_sxfy_w(keyword: str) -> bool:
    # A dropped W changes the outcome of a literal test only for keywords that either contain a W
    # that could be the dropped one, or span the place where it stood (digit, then non-word).
    return re.search(r"(?:^|\d)w(?:\W|$)|\d\W", keyword, re.I) is not None


def valid_regex(pattern: str) -> bool:
    """Checked once on the driver with the engine that will run it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


# Named groups and their back-references, beside what only looks like them (escapes and character classes).
_GROUPS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)", re.S)


def java_groups(pattern: str) -> str:
    """Named groups as Java spells them. Java's names have no underscore, so groups are named by their order."""
    names: dict[str, str] = {}

    def rename(match: re.Match) -> str:
        if match[1]:
            return f"(?<{names.setdefault(match[1], f'g{len(names)}')}>"
        if match[2]:
            return rf"\k<{names.get(match[2], match[2])}>"
        return match[0]

    return _GROUPS.sub(rename, pattern)


def java_pattern(keyword: str, case_sensitive: bool, use_regex: bool, strict: bool = False) -> str:
    """Java pattern of a keyword; an invalid regex turns into a literal unless `strict`."""
    flags = "(?U)" if case_sensitive else "(?iuU)"
    if use_regex:
        body = java_groups(keyword)
        if valid_regex(flags + body):
            return flags + body
        if strict:
            raise ValueError(f"invalid regular expression: {keyword}")
    return flags + re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", keyword)


def keyword_predicate(
    text: Column, keyword: str, case_sensitive: bool = False, use_regex: bool = False, strict: bool = False
) -> Column:
    """Does the text hold the (already cleaned) keyword? A blank keyword holds nowhere."""
    if not keyword:
        return F.lit(False)
    if use_regex and (strict or valid_regex("(?U)" + java_groups(keyword))):
        return F.coalesce(normalize_sxfy(text).rlike(java_pattern(keyword, case_sensitive, True, strict)), F.lit(False))
    haystack = normalize_sxfy(text) if _touches_sxfy_w(keyword) else text
    if case_sensitive:
        hit = F.contains(haystack, F.lit(keyword))
    else:
        hit = F.contains(F.lower(haystack), F.lit(keyword.lower()))
    return F.coalesce(hit, F.lit(False))


def keyword_first_match(text: Column, keyword: str, case_sensitive: bool = False, use_regex: bool = False) -> Column:
    """The first matched substring, as written in the (normalised) text."""
    return F.regexp_extract(normalize_sxfy(text), java_pattern(keyword, case_sensitive, use_regex), 0)


# ---------------------------------------------------------------- time gaps


def gap_text(ms: Column) -> Column:
    """`+12ms`, `+3.4s`, `+2m 10s`, `+1h 2m 3s`; whole seconds carry no decimals. NULL gap gives ''."""
    sign = F.when(ms < 0, "-").otherwise("+")
    a = F.abs(ms)
    secs = F.floor(a / 1000)
    minutes = F.floor(secs / 60)
    text = (
        F.when(a < 1000, F.concat(a.cast("string"), F.lit("ms")))
        .when((a < 60_000) & (a % 1000 == 0), F.concat(secs.cast("string"), F.lit("s")))
        .when(a < 60_000, F.concat(_one_decimal(a), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), (secs % 60).cast("string"), F.lit("s")))
        .otherwise(
            F.concat(
                F.floor(minutes / 60).cast("string"),
                F.lit("h "),
                (minutes % 60).cast("string"),
                F.lit("m "),
                (secs % 60).cast("string"),
                F.lit("s"),
            )
        )
    )
    return F.when(ms.isNull(), "").otherwise(F.concat(sign, text))


def report_gap_text(ms: Column) -> Column:
    """Report style: one decimal with trailing zeros cut, minutes never roll into hours."""
    sign = F.when(ms < 0, "-").otherwise("+")
    a = F.abs(ms)
    secs = F.floor(a / 1000)
    text = (
        F.when(a < 1000, F.concat(a.cast("string"), F.lit("ms")))
        .when(a < 60_000, F.concat(F.regexp_replace(_one_decimal(a), r"\.0$", ""), F.lit("s")))
        .otherwise(F.concat(F.floor(secs / 60).cast("string"), F.lit("m "), (secs % 60).cast("string"), F.lit("s")))
    )
    return F.when(ms.isNull(), "").otherwise(F.concat(sign, text))


# 2**52, 2**51, ... 2**47 modulo 1000, for seconds below 2, 4, ... 64.
_SCALE = ((2_000, 496), (4_000, 248), (8_000, 624), (16_000, 312), (32_000, 656), (64_000, 328))


def _one_decimal(ms: Column) -> Column:
    """Seconds with one decimal, rounded as the binary quotient ms / 1000 rounds when printed.

    Only x.x5 is in doubt: whether its nearest binary number lies above or below follows from the remainder of the
    scaled numerator; a number that is exact rounds to the even digit.
    """
    scale = F.lit(_SCALE[-1][1])
    for limit, factor in reversed(_SCALE[:-1]):
        scale = F.when(ms < limit, factor).otherwise(scale)
    down = F.floor(ms / 100)
    rest = (ms % 1000) * scale % 1000
    tie = F.when(rest == 0, down + down % 2).when(rest > 500, down + 1).otherwise(down)
    tenths = F.when(ms % 100 == 50, tie).otherwise(F.floor((ms + 50) / 100))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def short_message(message: Column, limit: int = 120) -> Column:
    """White-space runs become one blank; longer text is cut with an ellipsis."""
    flat = strip(F.regexp_replace(message, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(rstrip(F.substring(flat, 1, limit - 3)), F.lit("..."))
    )
