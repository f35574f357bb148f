"""Byte- and ASCII-oriented text functions of the data-quality layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the data layer: ASCII only.
BLANKS = " \t\n\r\x0b\x0c"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def upper_ascii(c: Column) -> Column:
    return F.translate(c, _LOWER, _LOWER.upper())


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _LOWER.upper(), _LOWER)


def replace_all(c: Column, needle: str, replacement: str) -> Column:
    if not needle:
        raise ValueError("the text to replace is empty")
    return F.replace(c, F.lit(needle), F.lit(replacement))


def byte_view(c: Column) -> Column:
    """One character for each UTF-8 byte, for functions that count characters."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def match_normal(c: Column, trim_ends: bool = True, collapse: bool = True, drop_punctuation: bool = False, lower: bool = True) -> Column:
    """Normal form for record matching; punctuation goes before blanks collapse."""
    out = c
    if trim_ends and not collapse:
        out = trim(out)
    if drop_punctuation:
        out = F.regexp_replace(out, r"\p{Punct}", "")
    if collapse:
        out = trim(F.regexp_replace(out, "[ \t\n\r\x0b\x0c]+", " "))
    return lower_ascii(out) if lower else out


def block_key(normal: Column, kind: str = "whole", size: int = 0) -> Column:
    """`whole`, the first `size` bytes (`prefix`) or those of the first word (`token_prefix`)."""
    if kind == "whole":
        return normal
    if size <= 0:
        raise ValueError("a prefix needs a size of one byte at least")
    if kind == "prefix":
        return F.substring(byte_view(normal), 1, size)
    if kind == "token_prefix":
        return F.substring(byte_view(F.split_part(normal, F.lit(" "), F.lit(1))), 1, size)
    raise ValueError(f"unknown block key {kind}")


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance of bytes, null above `most`."""
    found = F.levenshtein(byte_view(a), byte_view(b), most)
    return F.when(found >= 0, found)


def is_email(c: Column) -> Column:
    """A character before the first at sign and a dot after it."""
    at = F.instr(c, "@")
    return (at > 1) & (F.instr(F.substr(c, at + 1), ".") > 0)


PATTERNS = {
    "email": is_email,
    "phone_e164": lambda c: c.rlike(r"\A\+[0-9]{7,15}\z"),
    "date_iso": lambda c: c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
    "uuid": lambda c: c.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"),
    "url": lambda c: (c.startswith("http://") & (F.octet_length(c) > 7)) | (c.startswith("https://") & (F.octet_length(c) > 8)),
}


def posix_regex(pattern: str) -> str:
    """A POSIX extended expression as a Java one: bracket classes, dot over newlines, strict end."""
    if len(pattern.encode()) > 1024:
        raise ValueError("the pattern is longer than 1024 bytes")
    classes = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit", "blank": "Blank", "cntrl": "Cntrl", "print": "Print", "graph": "Graph"}
    for name, java in classes.items():
        pattern = pattern.replace(f"[:{name}:]", rf"\p{{{java}}}")
    if pattern.endswith("$") and not pattern.endswith(r"\$"):
        pattern = pattern[:-1] + r"\z"
    return "(?s)" + pattern


def matches_regex(c: Column, pattern: str) -> Column:
    """Unanchored search; texts over one MiB don't match."""
    return (F.octet_length(c) <= 1 << 20) & c.rlike(posix_regex(pattern))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID of `name` in lower-case hex with dashes."""
    space = namespace.replace("-", "")
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
