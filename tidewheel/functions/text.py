"""Text, HTML and number functions of built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities in the order they are decoded; `&amp;` before `&lt;`, so that `&amp;lt;` ends as `<`.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
# White space of the callers' language, as in a class: Unicode's, and U+FEFF.
WHITE = r"\t-\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANK = f"[{WHITE}]+"

PARSED = T.ArrayType(
    T.StructType(
        [
            T.StructField("date", T.StringType()),
            T.StructField("start_time", T.StringType()),
            T.StructField("end_time", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("mentioned_bjs", T.ArrayType(T.StringType())),
        ]
    )
)


def filled(value: Column, *others: Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    *first, last = (value, *others)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in first], last)


def truthy(value: Column) -> Column:
    """Neither null nor empty, as a plain boolean."""
    return F.coalesce(value != "", F.lit(False))


def compact(items: Column) -> Column:
    """An array without null and empty items."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def strip_html(html: Column) -> Column:
    """Tags to blanks, entities decoded, white space to single blanks, trimmed; null gives ''."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " ")
    decoded = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, bare)
    return F.trim(F.regexp_replace(decoded, BLANK, " "))


def image_urls(html: Column, most: int = 5) -> Column:
    """The first `most` http addresses of img tags, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.slice(F.filter(found, lambda u: F.startswith(u, F.lit("http"))), 1, most)


# Rules of the HTML sanitiser, in order: what is matched, and what stands in its place.
SANITISE = (
    (r"(?i)<script[\s\S]*?</script>", ""),
    (rf"(?i)[{WHITE}]+on\w+[{WHITE}]*=[{WHITE}]*(\"[^\"]*\"|'[^']*'|[^{WHITE}>]*)", ""),
    (rf"(?i)href[{WHITE}]*=[{WHITE}]*[\"']javascript:[^\"']*[\"']", 'href="#"'),
    (rf"(?i)src[{WHITE}]*=[{WHITE}]*[\"']data:(?!image/)[^\"']*[\"']", 'src=""'),
    (r"(?i)<iframe[\s\S]*?</iframe>", ""),
    (r"(?i)<(object|embed|form|input|button|textarea|select)[\s\S]*?</\1>", ""),
    (r"(?i)<(object|embed|form|input|button|textarea|select)[^>]*/?>", ""),
    (rf"(?i)expression[{WHITE}]*\([^)]*\)", ""),
    (rf"(?i)style[{WHITE}]*=[{WHITE}]*[\"'][^\"']*url[{WHITE}]*\([^)]*\)[^\"']*[\"']", ""),
)


def sanitize_html(html: Column) -> Column:
    """HTML without scripts, event handlers, script addresses, non-image data sources, frames, form parts and style tricks; null
    gives ''."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), SANITISE, F.coalesce(html, F.lit("")))


def escape_html(text: Column, quotes: bool = True) -> Column:
    """& < > and, if asked, " as entities; null gives ''."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES if quotes else ESCAPES[:3], F.coalesce(text, F.lit("")))


def has_keyword(title: Column, text: Column, words: list[str]) -> Column:
    """Whether title and text, joined by a blank, contain one of the words; case counts."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(whole, F.lit(w)) for w in words], F.lit(False))


def long_enough(text: Column, least: int = 5) -> Column:
    return F.length(text) >= least


def parse_items(json: Column) -> Column:
    """The items of a parse result; null, empty or malformed JSON gives none, as does an object that is no array."""
    is_list = F.startswith(F.ltrim(F.coalesce(json, F.lit(""))), F.lit("["))
    return F.coalesce(F.when(is_list, F.from_json(json, PARSED)), F.array().cast(PARSED))


def to_int(text: Column) -> Column:
    """The whole number that a text starts with, or null."""
    return F.regexp_extract(text, rf"^[{WHITE}]*([+-]?\d+)", 1).try_cast("int")


def grouped_int(text: Column) -> Column:
    """to_int of a text without its thousands commas."""
    return to_int(F.replace(text, F.lit(","), F.lit("")))


def grouped(number: Column) -> Column:
    return F.format_number(number, 0)


def tokens(text: Column, most: int | None = None) -> Column:
    """Items of a comma list without empty ones, the first `most`."""
    items = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda t: t != "")
    return F.slice(items, 1, most) if most else items


def span_text(title: Column, start: Column, end: Column) -> Column:
    """`title: start~end`, with ? for a missing end."""
    return F.concat(title, F.lit(": "), start, F.lit("~"), filled(end, F.lit("?")))


def media_type(header: Column) -> Column:
    return F.trim(F.split_part(header, F.lit(";"), F.lit(1)))


def url(template: str, **values: Column) -> Column:
    """A template with {name} places."""
    return reduce(lambda c, item: F.replace(c, F.lit("{" + item[0] + "}"), item[1].cast("string")), values.items(), F.lit(template))


def tag_of(choice: str) -> str | None:
    """The tag of a `tag:X` choice."""
    return choice[4:] if choice.startswith("tag:") else None
