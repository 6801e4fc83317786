"""Scalar functions of the domain, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkveil.functions import patterns as P
from sparkveil.functions.spans import let

# The tables of the Verhoeff check digit (the dihedral group D5 and its permutation).
_D5 = [[(j + i) % 5 if j < 5 else 5 + (j + i) % 5 for j in range(10)] if i < 5 else [5 + (i - j) % 5 if j < 5 else (i - j) % 5 for j in range(10)] for i in range(10)]
_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _permutations() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([_STEP[x] for x in rows[-1]])
    return rows


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits, not all the same, with a valid Luhn sum."""
    return let(digits(value), lambda d: F.char_length(d).between(13, 19) & ~d.rlike(r"^(.)\1*$") & F.call_function("luhn_check", d))


def verhoeff_ok(value: Column) -> Column:
    """At least one digit, and the Verhoeff sum is 0."""
    table = F.array(*[F.lit(x) for row in _D5 for x in row])
    perm = F.array(*[F.lit(x) for row in _permutations() for x in row])

    def check(d: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.char_length(d) - 1, F.lit(0)))
        total = F.aggregate(places, F.lit(0), lambda c, i: F.get(table, c * 10 + F.get(perm, F.pmod(i, F.lit(8)) * 10 + F.substring(d, i + 1, F.lit(1)).cast("int"))))
        return (F.char_length(d) > 0) & (total == 0)

    return let(F.reverse(digits(value)), check)


def canonical_ifsc(value: Column) -> Column:
    """Upper case without separators, if that is an IFSC; else null."""
    return let(F.regexp_replace(F.upper(F.trim(value)), P.ID_SEPARATORS, ""), lambda compact: F.when(compact.rlike(P.IFSC_CANONICAL), compact))


def normal_value(kind: Column, value: Column) -> Column:
    """The form in which two values of a type are compared."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    number = digits(low)
    numeric = F.when(number != "", number).otherwise(low)
    text = F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w@.+#'\- ]", " "), r"(?U)\s+", " "))
    return (
        F.when(kind.isin("PHONE", "AADHAAR", "CARD", "ACCOUNT_NUMBER", "OTP", "CVV", "PINCODE"), numeric)
        .when(kind.isin("PAN", "IFSC", "PASSPORT", "VOTER_ID", "DRIVING_LICENSE"), F.regexp_replace(low, "[^a-z0-9]", ""))
        .when(kind.isin("EMAIL", "UPI", "USERNAME", "API_KEY", "AUTH_TOKEN", "PASSWORD"), F.regexp_replace(low, r"(?U)\s+", ""))
        .otherwise(text)
    )


def masked(kind: Column, value: Column, partial: bool = False, hide: Column | None = None) -> Column:
    """``[TYPE REDACTED]``; in partial mode the last four digits, or an address's provider, stay,
    unless ``hide``."""
    full = F.concat(F.lit("["), kind, F.lit(" REDACTED]"))
    if not partial:
        return full
    d = digits(value)
    out = (
        F.when(kind.isin("PHONE", "CARD", "ACCOUNT_NUMBER", "AADHAAR") & (F.char_length(d) >= 4), F.concat(F.lit("["), kind, F.lit(" ••••"), F.right(d, F.lit(4)), F.lit("]")))
        .when((kind == "EMAIL") & value.contains("@"), F.concat(F.lit("["), kind, F.lit(" "), F.substring(value, 1, 1).alias("f"), F.lit("***@"), F.regexp_extract(value, r"(?s)^[^@]*@(.*)$", 1), F.lit("]")))
        .otherwise(full)
    )
    out = F.when((kind == "EMAIL") & value.startswith("@"), F.concat(F.lit("["), kind, F.lit(" ***@"), F.substring(value, F.lit(2), F.char_length(value)), F.lit("]"))).otherwise(out)
    return out if hide is None else F.when(hide, full).otherwise(out)


def due_date(expression: Column, call_date: Column) -> Column:
    """The day that a due expression means, seen from the day of the call. A weekday is the next one
    after it; two-digit years turn at 69."""
    low = F.lower(expression)
    parts = F.regexp_extract(expression, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", 4)
    year = F.when(F.char_length(parts) == 4, parts.cast("int")).when(parts.cast("int") >= 69, parts.cast("int") + 1900).otherwise(parts.cast("int") + 2000)
    day, month = (F.regexp_extract(expression, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", g) for g in (1, 3))
    exact = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    weekday = low.isin("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    return (
        F.when(low == "today", call_date)
        .when(low == "tomorrow", F.date_add(call_date, 1))
        .when(low == "day after tomorrow", F.date_add(call_date, 2))
        .when(weekday, F.call_function("next_day", call_date, low))
        .when(parts != "", exact)
    )
