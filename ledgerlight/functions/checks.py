"""Check digits, formats and entropy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplication and permutation tables of the Verhoeff check digit.
VERHOEFF_MULTIPLY = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_PERMUTE = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def luhn(raw: Column) -> Column:
    """Card check: 13 to 19 digits with a valid Luhn sum."""
    digits = digits_of(raw)
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def verhoeff(raw: Column) -> Column:
    """Twelve digits, the first of them 2 to 9, with a valid Verhoeff check digit."""
    digits = digits_of(raw)
    multiply = F.array(*[F.array(*[F.lit(x) for x in row]) for row in VERHOEFF_MULTIPLY])
    permute = F.array(*[F.array(*[F.lit(x) for x in row]) for row in VERHOEFF_PERMUTE])
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    paired = F.transform(reverse, lambda d, i: F.get(F.get(permute, i % 8), d))
    checksum = F.aggregate(paired, F.lit(0), lambda acc, p: F.get(F.get(multiply, acc), p))
    return digits.rlike("^[2-9][0-9]{11}$") & (F.when(digits.rlike("^[2-9][0-9]{11}$"), checksum) == 0)


def iban97(raw: Column) -> Column:
    """IBAN: country, two digits, 11 to 30 characters, remainder 1 modulo 97."""
    iban = F.upper(F.regexp_replace(raw, r"\s", ""))
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    def fold(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        number = c.cast("int")
        return F.when(letter >= 10, (acc * 100 + letter) % 97).otherwise((acc * 10 + number) % 97)
    valid = iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return valid & (F.when(valid, F.aggregate(F.split(moved, ""), F.lit(0), fold)) == 1)


def valid_ipv4(raw: Column) -> Column:
    return raw.rlike(IPV4)


def past_date(raw: Column, as_of: Column) -> Column:
    """A date that can be read and is not in the future."""
    parsed = F.coalesce(*[F.to_date(F.try_to_timestamp(raw, F.lit(f))) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy")])
    return F.coalesce(parsed <= F.to_date(as_of), F.lit(False))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(token, "")
    size = F.size(chars)
    def add(acc: Column, c: Column) -> Column:
        share = F.size(F.filter(chars, lambda x: x == c)) / size
        return acc - share * F.log2(share)
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), add)


def softmax3(a: Column, b: Column, c: Column, temperature: float = 1.6) -> tuple[Column, Column, Column]:
    scaled = [x / F.lit(temperature) for x in (a, b, c)]
    top = F.greatest(*scaled)
    exps = [F.exp(x - top) for x in scaled]
    total = exps[0] + exps[1] + exps[2]
    return exps[0] / total, exps[1] / total, exps[2] / total
