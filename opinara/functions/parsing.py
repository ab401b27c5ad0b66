"""Scalar parsers: ratings, scales, dates, links, keys and display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.text import rint

_NUM = "(\\d+(?:[.,]\\d+)?)"
FRACTION = f"(?i){_NUM}\\s*(?:/|out\\s+of|of)\\s*{_NUM}"
RATING_SHAPE = "(?i)^\\s*(?:\\d+(?:[.,]\\d+)?\\s*(?:stars?|/\\s*\\d+(?:[.,]\\d+)?|out\\s+of\\s+\\d+(?:[.,]\\d+)?)?|[★⭐☆\\s]+)\\s*$"
DATE_SHAPE = "\\d{1,4}[-/.]\\d{1,2}[-/.]\\d{1,4}|[A-Za-z]{3,9}\\.? \\d{1,2},? \\d{2,4}|\\d{1,2} [A-Za-z]{3,9}\\.? \\d{2,4}|\\d{4}-\\d{2}"
#: Tried in order: ISO, then month first, then day first.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM")


def _shape(form: str) -> str:
    """What any text of a date format looks like: a cheap test before the format is tried."""
    signs = {"y": "\\d", "M": "\\d", "d": "\\d", "H": "\\d", "m": "\\d", "s": "\\d"}
    tokens = [m[0] for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", form)]
    told = ["[A-Za-z]+" if t.startswith("MMM") else "(?:Z|[+-]\\d\\d:\\d\\d)" if t[0] == "X" else signs[t[0]] + "+" if t[0] in signs else re.escape(t.strip("'")) for t in tokens]
    return "^" + "".join(told) + "$"


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def rating(text: Column) -> Column:
    """Star signs where there is no digit; a fraction on five, to 2 places; else the first number."""
    a, b = number(F.regexp_extract(text, FRACTION, 1)), number(F.regexp_extract(text, FRACTION, 2))
    stars = F.regexp_count(text, F.lit("[★⭐]"))
    plain = number(F.regexp_extract(text, _NUM, 1))
    starred = ~text.rlike("\\d") & (stars > 0)
    return F.when(starred, stars.cast("double")).when(b > 0, rint(a / b * 5, 2)).otherwise(plain)


def scale(low: Column, high: Column) -> Column:
    """The rating scale that a file's least and largest rating suggest."""
    return (
        F.when((high <= 5) & (low == 0), "0-5")
        .when(high <= 5, "1-5")
        .when((high <= 10) & (low < 1), "0-10")
        .when(high <= 10, "1-10")
        .when(high <= 100, "0-100")
        .otherwise("unknown")
    )


def to_five(value: Column, scale_: Column) -> Column:
    moved = F.when(scale_ == "1-10", 1 + (value - 1) * 4 / 9).when(scale_ == "0-10", 1 + value * 4 / 10).when(scale_ == "0-100", 1 + value * 4 / 100)
    return F.coalesce(rint(moved, 1), value)


def timestamp(text: Column) -> Column:
    """Unix seconds, Unix milliseconds, or a date in one of DATE_FORMATS; null otherwise. UTC."""
    n = text.try_cast("double")
    seconds = F.when((n >= 1e9) & (n <= 2.2e9), F.timestamp_seconds(n))
    millis = F.when((n >= 1e12) & (n <= 2.2e12), F.timestamp_millis(n.cast("long")))
    return F.coalesce(seconds, millis, *[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS])


def estimated_rating(score: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.rint(3 + 2 * score)))


def youtube_id(url: Column) -> Column:
    """The 11-character id of a video link of the known hosts and paths, else null."""
    bare = F.regexp_replace(F.trim(url), "^(?i)https?://", "")
    host = F.lower(F.regexp_extract(bare, "^(?:www\\.|m\\.|music\\.)?([^/?#:]+)", 1))
    rest = F.regexp_replace(bare, "^[^/?#]*", "")
    found = (
        F.when(host == "youtu.be", F.regexp_extract(rest, "^/([^/?#]+)", 1))
        .when(host.isin("youtube.com", "youtube-nocookie.com") & rest.rlike("^/watch/?\\?"), F.regexp_extract(rest, "[?&]v=([^&#]+)", 1))
        .when(host.isin("youtube.com", "youtube-nocookie.com"), F.regexp_extract(rest, "^/(?:shorts|embed|live|v)/([^/?#]+)", 1))
    )
    return F.when(found.rlike("^[A-Za-z0-9_-]{11}$"), found)


def short_key(text: Column, size: int = 8) -> Column:
    return F.upper(F.substring(F.sha1(text), 1, size))


def views_label(n: Column) -> Column:
    short = lambda by, sign: F.concat(F.regexp_replace(F.format_string("%.1f", n / by), "\\.0$", ""), F.lit(sign))
    told = F.when(n >= 1_000_000_000, short(1e9, "B")).when(n >= 1_000_000, short(1e6, "M")).when(n >= 1000, short(1e3, "K")).otherwise(n.cast("long").cast("string"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").otherwise(F.concat(told, F.lit(" views")))


def seconds_label(s: Column) -> Column:
    whole = s.cast("long")
    hours, minutes, seconds = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, seconds)).otherwise(F.format_string("%d:%02d", minutes, seconds))


def star_signs(value: Column) -> Column:
    full = F.rint(value).cast("int")
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), 5 - full))


def excerpt(text: Column, focus: Column | None = None, limit: int = 420) -> Column:
    """The text; a long one as a window of ``limit`` characters around ``focus``, or its start up to a word's end."""
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", ""), F.lit(" …"))
    if focus is not None:
        at = F.instr(text, focus) - 1
        begin = F.greatest(F.lit(0), at - limit // 3)
        window = F.concat(F.when(begin > 0, "… ").otherwise(""), F.substring(text, begin + 1, F.lit(limit)), F.when(begin + limit < F.length(text), " …").otherwise(""))
        cut = F.when((at >= 0) & (F.length(focus) > 0), window).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlighted(text: Column, clauses: Column) -> Column:
    """HTML of the text with the first place of each praise or complaint marked; ``clauses``: array of clause, polarity."""

    def step(html: Column, c: Column) -> Column:
        target = escaped(c["clause"])
        at = F.instr(html, target)
        mark = F.concat(F.substring(html, F.lit(1), at - 1), F.lit('<mark class="'), c["polarity"], F.lit('">'), target, F.lit("</mark>"), F.substring(html, at + F.length(target), F.length(html)))
        return F.when(c["polarity"].isin("praise", "complaint") & (target != "") & (at > 0), mark).otherwise(html)

    return F.aggregate(clauses, escaped(text), step)


def md_to_html(text: Column) -> Column:
    """HTML of simple Markdown: bold parts, and line breaks."""
    bold = F.regexp_replace(escaped(text), "\\*\\*(.+?)\\*\\*", "<strong>$1</strong>")
    return F.replace(bold, F.lit("\n"), F.lit("<br>"))
