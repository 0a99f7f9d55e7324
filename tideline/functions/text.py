"""Text expressions: all are Column to Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits, joined by single apostrophes or hyphens inside a word (fixed value).
TOKEN = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"
#: Signed numbers with thousands commas and decimals, not right after a letter (fixed value).
NUMBER = r"(?<![A-Za-z])[-+]?\d[\d,]*(?:\.\d+)?"


def folded(c) -> Column:
    """Lower case with the sharp s written out, as case folding does."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0))


def normalized(c, trim: bool = True) -> Column:
    """White-space runs as one space, folded; trimmed unless told otherwise."""
    out = folded(F.regexp_replace(c, r"\s+", " "))
    return F.trim(out) if trim else out


def verified_excerpt(excerpt, text) -> Column:
    return (F.length(normalized(excerpt)) > 0) & F.contains(normalized(text), normalized(excerpt))


def truncated(c, n: int) -> Column:
    """The original prose through its n-th token; the whole text if there are fewer."""
    return F.when(F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))) > n, F.regexp_extract(c, rf"(?s)^(?:.*?{TOKEN}(?!['-]?[\p{{L}}\p{{N}}])){{{n}}}", 0)).otherwise(c)


def numbers(c) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def plain_number(c) -> Column:
    """Six decimals at most, without trailing zeros; ``null`` for nulls."""
    return F.coalesce(F.rtrim(F.rtrim(F.format_string("%.6f", c), F.lit("0")), F.lit(".")), F.lit("null"))


def context(text, anchor, before: int = 700, after: int = 1900) -> Column:
    """The part of the text around the first place of the anchor; null if absent."""
    p = F.expr("0") + F.instr(text, anchor) if isinstance(anchor, str) else F.locate(anchor, text)
    return F.when(p > 0, F.substring(text, F.greatest(F.lit(1), p - before), p - F.greatest(F.lit(1), p - before) + after))


def jaccard(a, b) -> Column:
    """Similarity of two arrays as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def hmac_sha256(key: bytes, c) -> Column:
    """Hexadecimal HMAC-SHA256 of a text, from two nested hashes with the padded key."""
    block = (key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
