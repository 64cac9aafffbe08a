"""Cleaning, masking and value patterns of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the cleaning keeps, and value patterns by name.
NON_PRINTABLE = r"[^\x20-\x7E\xA0-\xFF]"
CONTROL_ONLY = r"\p{Cntrl}"
PATTERNS = {
    "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    "aadhaar": r"^\d{12}$",
    "email": r"^[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[+]?\d{10,13}$",
    "credit_card": r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
    "ipv4": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "uuid": r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
}
#: Shapes of dates, and how the first ten characters are read.
DATE_SHAPES = {r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd", r"^\d{2}/\d{2}/\d{4}$": "dd/MM/yyyy", r"^\d{2}-\d{2}-\d{4}$": "dd-MM-yyyy", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}": "yyyy-MM-dd"}
#: What an e-mail address looks like inside running text.
EMAIL_IN_TEXT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def holds(column: Column, pattern: str) -> Column:
    """Whether a text holds a pattern; null does not. Texts without an @ are not searched for what needs one."""
    found = column.rlike(pattern)
    return F.coalesce(column.contains("@") & found if "@" in pattern else found, F.lit(False))


def _strings(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string" and not c.startswith("_")]


def strip_non_printable(df: DataFrame, pattern: str = NON_PRINTABLE) -> DataFrame:
    """Removes characters from all string columns whose names do not begin with an underscore."""
    return df.withColumns({c: F.regexp_replace(c, pattern, "") for c in _strings(df)})


def trim_all(df: DataFrame, upper: tuple[str, ...] = ()) -> DataFrame:
    """Trims string columns; those in upper become upper case."""
    return df.withColumns({c: F.upper(F.trim(c)) if c in upper else F.trim(c) for c in _strings(df)})


def mask(column: Column, how: str) -> Column:
    """A masked column; null stays null.

    sha256 or hash: its digest. tokenise: two characters, ***, eight of its digest. last_4: all but the last four
    characters as *. email: the first letter, ***, and the domain. year_only: the year of a date. redact: a constant.
    """
    text = column.cast("string")
    digest = F.sha2(text, 256)
    said = {
        "sha256": digest,
        "hash": digest,
        "tokenise": F.concat(F.substring(text, 1, 2), F.lit("***"), F.substring(digest, 1, 8)),
        "last_4": F.concat(F.repeat(F.lit("*"), F.greatest(F.char_length(text) - 4, F.lit(0))), F.right(text, F.lit(4))),
        "email": F.regexp_replace(text, r"^(.)[^@]*(@.*)$", "$1***$2"),
        "year_only": F.year(F.try_to_timestamp(text)).cast("string"),
        "redact": F.when(column.isNotNull(), F.lit("REDACTED")),
    }
    if how not in said:
        raise ValueError(f"unknown masking {how!r}")
    return said[how]


def apply_masking(df: DataFrame, masking: dict[str, str]) -> DataFrame:
    return df.withColumns({c: mask(F.col(c), how) for c, how in masking.items() if c in df.columns})


def encrypt(column: Column, key: Column) -> Column:
    """Reversible AES, as text. The key comes from the caller and is in no table."""
    return F.base64(F.aes_encrypt(column.cast("string"), key))


def decrypt(column: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(column), key).cast("string")


def to_iso_date(column: Column) -> Column:
    """Dates of the four known shapes as yyyy-MM-dd; others null."""
    tried = [F.when(column.rlike(shape), F.try_to_timestamp(F.substring(column, 1, 10), F.lit(form))) for shape, form in DATE_SHAPES.items()]
    return F.date_format(F.coalesce(*tried), "yyyy-MM-dd")
