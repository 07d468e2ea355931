"""Plain forms of written ids and names.

An identity is the number in the text, without leading zeros; null, blank and -1 are nobody. An image is its
``digits_digits`` part. Names compare without letter case and outer white space. A value without the expected
digits stays as its stripped text, so that it is still reported as what it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTER_BLANKS = r"(?U)^[\s\x00]+|[\s\x00]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_BLANKS, "")


def plain_identity(c: Column) -> Column:
    text, digits = stripped(c), F.regexp_extract(c, r"(\d+)", 1)
    return (
        F.when(c.isNull() | text.isin("", "-1"), F.lit(None).cast("string"))
        .when(digits == "", text)
        .otherwise(F.regexp_replace(digits, r"^0+(?=\d)", ""))
    )


def plain_image(c: Column) -> Column:
    text, core = stripped(c), F.regexp_extract(c, r"(\d+_\d+)", 1)
    return F.when(c.isNull() | (text == ""), F.lit(None).cast("string")).when(core == "", text).otherwise(core)


def plain_name(c: Column) -> Column:
    return F.lower(stripped(c))


def plain_case(c: Column) -> Column:
    return F.upper(stripped(c))
