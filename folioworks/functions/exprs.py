"""Scalar functions of the archive model, as Column expressions (operators F1-F30)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Medium categories in display order, and the ordered (needle, category) rules of which the first match decides.
MEDIUM_CATEGORIES = ("letter", "telegram", "memo", "transaction record", "financial statement", "inventory", "artifact photograph", "other")
MEDIUM_RULES = (
    ("letter", "letter"),
    ("telegram", "telegram"),
    ("cable", "telegram"),
    ("memo", "memo"),
    ("memorandum", "memo"),
    ("note", "memo"),
    ("inventory", "inventory"),
    ("financial statement", "financial statement"),
    ("account statement", "financial statement"),
    ("expense account", "financial statement"),
    ("expenditure report", "financial statement"),
    ("invoice", "transaction record"),
    ("receipt", "transaction record"),
    ("bill of sale", "transaction record"),
    ("purchase record", "transaction record"),
    ("purchase", "transaction record"),
    ("acquisition form", "transaction record"),
    ("photograph", "artifact photograph"),
    ("photo", "artifact photograph"),
)
# Media types by file suffix; fixed values.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp", ".html": "text/html"}
LONG_FIELDS = ("description", "transcription", "annotation", "raw_extraction", "context")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def blank(c: Column) -> Column:
    """NULL or nothing but white space."""
    return c.isNull() | (F.trim(c) == "")


def normalized_name(c: Column) -> Column:
    """lower case, white space runs as one space, trimmed; NULL as ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def effective_date(depicted: Column, start: Column) -> Column:
    """F2"""
    return F.coalesce(depicted, start)


def scrubbed_date(c: Column) -> Column:
    """the sentinel for an unknown date is NULL."""
    return F.when(F.lower(F.trim(c)) == "date unknown", None).otherwise(c)


def medium_category(c: Column) -> Column:
    """the first rule whose needle is in the medium."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return reduce(lambda otherwise, rule: F.when(low.contains(rule[0]), rule[1]).otherwise(otherwise), reversed(MEDIUM_RULES), F.lit("other"))


def chosen_category(given: Column, medium: Column) -> Column:
    """a given category counts if it is one."""
    return F.when(given.isin(*MEDIUM_CATEGORIES), given).otherwise(medium_category(medium))


def tokens(c: Column) -> Column:
    """CJK characters one by one, then Latin words in lower case."""
    text = F.coalesce(c, F.lit(""))
    cjk = F.regexp_extract_all(text, F.lit("([一-鿿㐀-䶿])"), F.lit(1))
    return F.concat(cjk, F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9À-ɏ]+)"), F.lit(1)), F.lower))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def transaction_score(seller: Column, buyer: Column, date: Column, price: Column, house: Column) -> Column:
    """how many of the five are there."""
    return sum((F.when(~blank(c.cast("string")), 1).otherwise(0) for c in (seller, buyer, date, price, house)), F.lit(0)).cast("int")


def score_band(score: Column) -> Column:
    """F10"""
    return F.when(score >= 3, "green").when(score == 2, "amber").otherwise("red")


def transaction_label(seller: Column, buyer: Column, price: Column, currency: Column, house: Column) -> Column:
    """house, parties and price, as far as known."""
    s, b = (F.when(~blank(c), c) for c in (seller, buyer))
    parties = F.when(s.isNotNull() & b.isNotNull(), F.concat(s, F.lit(" → "), b)).when(s.isNotNull(), F.concat(F.lit("Sold by "), s)).when(b.isNotNull(), F.concat(F.lit("Acquired by "), b))
    money = F.when(F.coalesce(price, F.lit(0.0)) != 0, F.concat_ws(" ", F.nullif(currency, F.lit("")), F.format_number(price, 0)))
    return F.coalesce(F.nullif(F.concat_ws(" · ", F.nullif(house, F.lit("")), parties, money), F.lit("")), F.lit("Transaction"))


def price(c: Column) -> Column:
    """'1,200' as a number; NULL if it is none."""
    bare = F.regexp_replace(c.cast("string"), "[, ]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare).cast("double")


def lot_number(c: Column) -> Column:
    """F13"""
    return F.nullif(c.cast("string"), F.lit(""))


def embed_text(*parts: Column) -> Column:
    """the parts that aren't empty, joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def audit_value(field: str, c: Column) -> Column:
    """long fields are cut at 1000 characters and say so."""
    text = c.cast("string")
    if field not in LONG_FIELDS:
        return text
    note = F.concat(F.lit("… [truncated, original length "), F.length(text), F.lit("]"))
    return F.when(F.length(text) > 1000, F.concat(F.substring(text, 1, 1000), note)).otherwise(text)


def audit_json(field: str, c: Column, kind: str) -> Column:
    """a value of any kind as an audit row has it: NULL stays, strings are `audit_value`, others are JSON."""
    if kind == "string":
        return audit_value(field, c)
    nested = kind.startswith(("array", "map", "struct"))
    return audit_value(field, F.to_json(c) if nested else c.cast("string"))


def citations(c: Column) -> Column:
    """distinct numbers cited as [Doc #n]."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[Doc #(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))))


def confidence(answer: Column) -> Column:
    """By distinct citations, then by the phrase that says nothing was found."""
    n = F.size(citations(answer))
    return F.when(n >= 3, "high").when(n >= 1, "medium").when(F.lower(answer).contains("do not contain"), "none").otherwise("low")


def suffix(c: Column) -> Column:
    """lower-cased file suffix."""
    return F.lower(F.regexp_extract(c, r"(\.[A-Za-z0-9]+)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*?)(\.[A-Za-z0-9]+)?$", 1)


def safe_name(c: Column) -> Column:
    """a name to save a file by: underscores for spaces, forty characters."""
    return F.left(F.replace(c, F.lit(" "), F.lit("_")), F.lit(40))


def label(title: Column, otherwise: Column) -> Column:
    """the title, or what stands for it where there is none."""
    return F.coalesce(F.nullif(title, F.lit("")), otherwise)


def display_date(c: Column) -> Column:
    """a date without its time."""
    return F.substring_index(c, "T", 1)


def valid_question(c: Column) -> Column:
    """not blank, and at most 2000 characters."""
    return (F.trim(c) != "") & (F.length(c) <= 2000)


def media_type(c: Column) -> Column:
    """F28"""
    pairs = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, suffix(c)), F.lit("image/jpeg"))


def percent(part: Column, whole: Column) -> Column:
    """rounded half to even."""
    return F.when(whole > 0, F.bround(part / whole * 100, 0)).otherwise(0).cast("long")


def contains_either(a: Column, b: Column) -> Column:
    """F24"""
    return F.contains(a, b) | F.contains(b, a)


# Fragments that are no single place, qualifiers around one, and words of institutions.
PLACE_STOPS = (
    "", "usa", "u.s.a.", "u.s.", "us", "united states", "unknown", "n/a", "na", "none", "not specified", "various", "region", "area", "etc", "the", "city",
    "east", "west", "north", "south", "northeast", "northwest", "southeast", "southwest", "central", "written from", "written", "sent to", "sent from", "sent", "from", "to",
)
PLACE_SEPARATORS = r"(?i)[,;/()&]|\band\b"
PLACE_PREFIX = r"(?i)^(likely|probably|possibly|near|in|the)\s+"
PLACE_SUFFIX = r"(?i)\s+(region|area)$"
PLACE_INSTITUTION = r"(?i)\b(university|museum|gallery|institute|college|library|school|society|company|co\.|corp|inc|ltd|department|collection)\b"


def places(c: Column) -> Column:
    """the single places that a location names."""

    def bare(x: Column) -> Column:
        inner = F.regexp_replace(F.trim(x), r"^\.+|\.+$", "")
        return F.trim(F.regexp_replace(F.regexp_replace(F.trim(inner), PLACE_PREFIX, ""), PLACE_SUFFIX, ""))

    def single(x: Column) -> Column:
        name = normalized_name(x)
        abbreviation = (F.length(x) <= 3) & (F.upper(x) == x) & (F.lower(x) != x)
        return (F.length(name) >= 3) & ~name.isin(*PLACE_STOPS) & ~abbreviation & ~x.rlike(PLACE_INSTITUTION)

    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), PLACE_SEPARATORS, -1), bare), single)


def hash_slot(token: Column, dims: int = 512) -> tuple[Column, Column]:
    """the token's dimension and sign, from the low bits of its MD5."""
    low = F.conv(F.right(F.md5(token), F.lit(3)), 16, 10).cast("int")
    return low % dims, F.when(F.shiftright(low, 9).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)
