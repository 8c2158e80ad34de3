"""Scalar rules of the metadata and of lexical search, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[\[\]().,?\x22\x27]"
LEVELS = {
    "INTERNET STANDARD": "std", "DRAFT STANDARD": "std", "PROPOSED STANDARD": "std", "BEST CURRENT PRACTICE": "bcp",
    "INFORMATIONAL": "info", "EXPERIMENTAL": "exp", "HISTORIC": "hist", "UNKNOWN": "unkn",
}


def clean_token(x: Column) -> Column:
    """Lower case without [ ] ( ) . , ? " and '; hyphens, slashes and colons stay."""
    return F.regexp_replace(F.lower(x), PUNCTUATION, "")


def doc_number(x: Column) -> Column:
    """The leading number of a document name, with or without its prefix; null if there is none."""
    return F.expr("cast(null as int)") if x is None else F.regexp_extract(x, r"(?i)^\s*(?:RFC)?(\d+)", 1).try_cast("int")


def doc_name(x: Column) -> Column:
    """The canonical name: prefix, number without leading zeros."""
    n = doc_number(x)
    return F.when(n.isNotNull(), F.concat(F.lit("RFC"), n.cast("string")))


def strip_unicode(x: Column) -> Column:
    """Both ends without white space of any kind (trim() removes blanks only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def level(x: Column, levels: Mapping[str, str] = LEVELS) -> Column:
    """The short code of a level; an unknown level is an error."""
    table = F.create_map(*[F.lit(y) for pair in levels.items() for y in pair])
    return F.coalesce(F.try_element_at(table, x), F.raise_error(F.concat(F.lit("unknown level: "), F.coalesce(x, F.lit("null")))).cast("string"))


def attribute(values: Column, key: Column, default: Column) -> Column:
    """The value of a key in a map, or the default where the map, the key or the value is missing."""
    return F.coalesce(F.try_element_at(values, key), default)


def string_hash(x: Column) -> Column:
    """32-bit h = 31 h + c over the characters, unsigned. Of the characters beyond 16 bits the code point counts as one."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def hash_colour(x: Column) -> Column:
    """#rrggbb from the three low bytes of string_hash, the lowest first."""
    h = string_hash(x)
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.shiftright(h, 8 * i).bitwiseAND(F.lit(255)))), 2, "0") for i in range(3)])


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    parts = []
    for i, weight in enumerate((0.2126, 0.7152, 0.0722)):
        c = F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("double") / 255
        parts.append(F.lit(weight) * F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    return parts[0] + parts[1] + parts[2]


def text_colour(colour: Column) -> Column:
    """Black or white, whichever contrasts more; white on ties."""
    lum = luminance(colour)
    return F.when((lum + 0.05) / 0.05 > 1.05 / (lum + 0.05), F.lit("#000000")).otherwise(F.lit("#ffffff"))


def pad_left(x: Column, width: int, fill: str = "0") -> Column:
    """Padded, never cut (lpad() cuts)."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def human_bytes(n: Column) -> Column:
    out, size = None, n.cast("double")
    for unit, power in (("GiB", 3), ("MiB", 2), ("KiB", 1)):
        value = F.concat(F.format_number(size / 1024**power, 1), F.lit(f" {unit}"))
        out = F.when(size >= 1024**power, value) if out is None else out.when(size >= 1024**power, value)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def build_id(iso: Column) -> Column:
    """yyyymmddThhmmssZ of an ISO time in UTC; anything else is an error."""
    s = F.regexp_replace(F.regexp_replace(iso, r"\.\d+", ""), "[^0-9TZ]", "")
    return F.when(s.rlike(r"^\d{8}T\d{6}Z$"), s).otherwise(F.raise_error(F.concat(F.lit("not a build time: "), iso)).cast("string"))


def deep_link(doc: Column, section: Column, title: Column) -> tuple[Column, Column]:
    """(url, label) of a hit: the section's anchor or the whole document."""
    url = F.concat(F.lit("/doc/"), F.lower(doc), F.coalesce(F.concat(F.lit("#section-"), section), F.lit("")))
    label = F.coalesce(F.concat(F.lit("§"), section, F.coalesce(F.concat(F.lit(" "), title), F.lit(""))), title, F.lit("Abstract"))
    return url, label


def title_overlap(query: str | Column, title: Column) -> Column:
    """The share of a query's words (longer than 2) that the title contains; 0 if it has none."""
    q = F.lit(query) if isinstance(query, str) else query
    words = F.filter(F.split(F.lower(q), r"\s+"), lambda w: F.length(w) > 2)
    hit = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(title, F.lit(""))), w)))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hit / F.size(words))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def heading_key(x: Column) -> Column:
    """Lower case, without apostrophes, other signs as blanks, blanks collapsed."""
    s = F.regexp_replace(F.lower(strip_unicode(x)), "['’‘ʼ`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), " +", " "))
