"""Column expressions that the operators share: money, content ids, exact medians, digests, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Fixed value: the URL namespace of name-based UUIDs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def money(value: Column | str) -> Column:
    """An amount as exact decimal with two places; doubles are rounded once, here."""
    return (F.col(value) if isinstance(value, str) else value).cast(MONEY)


def ratio(numerator: Column, denominator: Column) -> Column:
    """A double quotient; null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def unit_price(spend: Column, quantity: Column) -> Column:
    """Spend over quantity to the cent, halves up, in whole numbers; both have two places, quantity is positive."""
    cents, hundredths = (spend * 100).cast("bigint"), (quantity * 100).cast("bigint")
    return (F.floor((cents * 200 + hundredths) / (hundredths * 2)).cast("decimal(20,0)") / 100).cast(MONEY)


def content_id(*parts: Column | str) -> Column:
    """A version 5 UUID of the parts joined by colons: equal parts, equal id. Null if any part is."""
    name = F.concat(*[x for part in parts for x in (F.lit(":"), F.col(part) if isinstance(part, str) else part)][1:])
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def exact_median(values: Column) -> Column:
    """The median of an array of decimals or doubles, exactly: the mean of the two middle ones. Null for an empty array."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / F.lit(2)


def nearest_rank(values: Column, share: float) -> Column:
    """The nearest-rank percentile of an array: the ceil(share * n)-th value in order."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.greatest(F.lit(0), F.ceil(F.lit(share) * F.size(ordered)).cast("int") - 1))


def normal_name(name: Column) -> Column:
    """A name for comparing: trimmed, white space runs made one space, lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r"(?U)\s+", " "))


def tolerance(precision: Column) -> Column:
    """10 to the power of -precision, as an exact decimal, for 0 to 6 digits."""
    steps = F.when(precision <= 0, F.lit("1"))
    for digits in range(1, 7):
        steps = steps.when(precision == digits, F.lit("0." + "0" * (digits - 1) + "1"))
    return steps.otherwise(F.lit("0.000001")).cast("decimal(18,6)")


def amount_text(amount: Column, currency: Column) -> Column:
    """"INR 12.30": two places, halves to even."""
    return F.concat(currency, F.lit(" "), F.bround(amount, 2).cast(MONEY).cast("string"))


def sorted_set(values: Column | str) -> Column:
    """Aggregate: the distinct values of a group in order."""
    return F.array_sort(F.collect_set(values))


def lines_digest(line: Column) -> Column:
    """Aggregate: SHA-256 over a group's lines in order, so the digest doesn't depend on row order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)


def prefix_vector(vector: Column, size: int) -> Column:
    """The first `size` numbers of a vector, brought to length 1; null for a zero or shorter vector."""
    head = F.transform(F.slice(vector, 1, size), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((F.size(vector) >= size) & (norm > 0), F.transform(head, lambda x: x / norm))


def dot(left: Column, right: Column) -> Column:
    """The inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
