"""Rule predicates: each returns a boolean Column that is true when the value FAILS.

A null result means "not failed" (a `when` sends it to `otherwise`), exactly like
the three-valued masks of the original engine.  Type masks and conditions are
applied by the compiler, not here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibra import constants as K
from calibra.functions.text import as_text, norm_token, not_empty_text, utrim


NUMBER_PATTERN = r"^[ \t]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[ \t]*\z"
NUMBER_WORDS = ("nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def to_number(col: Column) -> Column:
    """Non-strict number: unparsable or missing -> 0.0.

    Text is a number only when it is spelled like one: the cast alone would also take
    Java literals such as '1d' or '5f'.  Outer blanks are allowed.
    """
    text = as_text(col)
    spelled = text.rlike(NUMBER_PATTERN) | F.lower(F.trim(text)).isin(*NUMBER_WORDS)
    return F.when(spelled, F.coalesce(col.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def is_blank(col: Column) -> Column:
    """R1 `nulo`: null, or lower-cased trimmed text in the blank tokens."""
    return col.isNull() | utrim(F.lower(as_text(col))).isin(*K.BLANK_TOKENS)


def not_greater_than(col: Column, value: float = 0) -> Column:
    """R3 `mayor_a`: number (unparsable -> 0) <= value, value present."""
    return (to_number(col) <= F.lit(float(value))) & col.isNotNull()


def not_in_catalog(col: Column, codes: Sequence[str]) -> Column:
    """R4 `catalogo`: upper-cased (untrimmed) text not in the code list."""
    return ~F.upper(as_text(col)).isin(*list(codes)) & not_empty_text(col)


def not_in_catalog_column(col: Column, matched: Column) -> Column:
    """R4 for code lists too long for literals: `matched` is a join-produced marker."""
    return matched.isNull() & not_empty_text(col)


def bad_email(col: Column) -> Column:
    """R5 `formato_correo`."""
    return not_empty_text(col) & ~as_text(col).rlike(K.EMAIL_PATTERN)


def unicode_pattern(pattern: str) -> str:
    """A user pattern with Unicode character classes switched on and a final `$` that
    means the end of the text (Java's also matches before a last line break)."""
    body = pattern[:-1]
    if pattern.endswith("$") and (len(body) - len(body.rstrip("\\"))) % 2 == 0:
        pattern = body + r"\z"
    return pattern if pattern.startswith("(?U)") else "(?U)" + pattern


def not_matching(col: Column, pattern: str) -> Column:
    """R6 `regex_custom`: pattern not found anywhere in the text (search semantics)."""
    if pattern == "":
        return F.lit(False)
    return not_empty_text(col) & ~as_text(col).rlike(unicode_pattern(pattern))


def bad_phone(col: Column, country: Column | None = None) -> Column:
    """R7 `telefono_colombia` with a country column, R7n without one."""
    spaced = F.replace(as_text(col), F.lit(" "), F.lit(""))
    if country is None:
        return not_empty_text(col) & ~spaced.rlike(K.PHONE_OTHER_PATTERN)
    tel = F.replace(spaced, F.lit(K.PHONE_HOME_PREFIX), F.lit(""))
    code = as_text(country)
    home = (code == F.lit(K.PHONE_HOME_COUNTRY)) & ~tel.rlike(K.PHONE_HOME_PATTERN)
    other = (code != F.lit(K.PHONE_HOME_COUNTRY)) & ~tel.rlike(K.PHONE_OTHER_PATTERN)
    return not_empty_text(col) & (home | other)


def bad_length(col: Column, length: int = 0) -> Column:
    """R8 `longitud_exacta`: a trailing '.0' is cut, then the character count is compared."""
    s = F.regexp_replace(as_text(col), K.LENGTH_STRIP_PATTERN, "")
    return (s != F.lit("nan")) & (s != F.lit("")) & (F.char_length(s) != F.lit(int(length)))


def less_than_column(col: Column, ref: Column) -> Column:
    """R9 `mayor_o_igual_columna`: number < number of the reference column."""
    return (to_number(col) < to_number(ref)) & col.isNotNull()


def in_list(col: Column, values: Sequence) -> Column:
    """Normalised membership used by white and black lists."""
    return norm_token(col).isin(*[str(v).strip().upper() for v in values])


def condition(col: Column, value) -> Column:
    """The condition column, as text, equals the text of the value."""
    return as_text(col) == F.lit(str(value))
