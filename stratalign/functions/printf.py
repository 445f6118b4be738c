"""``%.12g`` of doubles as a Column expression: correctly rounded, without a Python worker.

The JVM's own text of a double is within a unit in the last place of it. Its digits settle the rounding to
``DIGITS`` digits unless those that follow are about one half. Such values, and the smallest ones, whose
text may be short of digits, are written out exactly: the double is a whole number times a power of
two, a power of two is a power of five times one of ten, and the product of whole number and power is
formed in limbs of nine decimal digits. Rounding is then a comparison of digits, with ties to even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12
LIMB = 1_000_000_000
#: Below this the JVM's text may have too few digits to round.
TINY = 1e-290
#: Distance from one half, in millionths of the last digit, within which the digits of the JVM's text don't decide.
NEAR = 2_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _whole(c: Column) -> Column:
    return c.try_cast("long")


def _over(n: Column) -> Column:
    """A whole number divided by the size of a limb, rounded down."""
    return F.call_function("div", n, F.lit(LIMB).cast("long"))


def _times(limbs: Column, factor: Column) -> Column:
    """Limbs, lowest first, times a factor below 2**30."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(acc: Column, limb: Column) -> Column:
        return let(limb * factor + acc["carry"], lambda p: F.struct(_over(p).alias("carry"), F.concat(acc["out"], F.array(p % LIMB)).alias("out")))

    return F.aggregate(limbs, start, step, lambda acc: F.when(acc["carry"] > 0, F.concat(acc["out"], F.array(acc["carry"]))).otherwise(acc["out"]))


def exact_digits(x: Column) -> Column:
    """(digits, exponent of the first) of a positive finite double, all of them."""
    q = F.greatest(F.floor(F.log2(x)) - 54, F.lit(-1074)).cast("int")

    def scaled(q: Column) -> Column:
        half = (q / 2).cast("int")
        return (x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - q)).cast("long")

    def digits(q: Column) -> Column:
        down = q < 0
        base, run = F.when(down, 5).otherwise(2).cast("long"), F.when(down, 12).otherwise(28)
        power = F.abs(q)
        chunk = lambda n: F.round(F.pow(base.cast("double"), n)).cast("long")
        factors = F.concat(F.array_repeat(chunk(run), (power / run).cast("int")), F.array(chunk(power % run)))
        limbs = let(scaled(q), lambda m: F.array(m % LIMB, _over(m)))
        grown = F.aggregate(factors, limbs, _times)
        return F.ltrim(F.array_join(F.transform(F.reverse(grown), lambda v: F.lpad(v.cast("string"), 9, "0")), ""), F.lit("0"))

    return let(q, lambda q: let(digits(q), lambda d: F.struct(d.alias("digits"), (F.length(d) - 1 + F.least(q, F.lit(0))).alias("exponent"))))


def _written(x: Column) -> Column:
    """(digits, exponent) as the JVM writes a positive finite double."""

    def parts(s: Column) -> Column:
        body = F.substring_index(s, "E", 1)
        power = F.when(F.contains(s, F.lit("E")), F.substring_index(s, "E", -1)).otherwise("0").cast("int")
        whole = F.substring_index(body, ".", 1)
        every = F.concat(whole, F.substring_index(body, ".", -1))
        return let(F.ltrim(every, F.lit("0")), lambda d: F.struct(d.alias("digits"), (F.length(whole) - 1 - (F.length(every) - F.length(d)) + power).alias("exponent")))

    return let(x.cast("string"), parts)


def _rounded(at: Column, x: Column) -> Column:
    """(n, exponent): the first ``DIGITS`` digits, rounded, as a number."""

    def settle(n: Column, up: Column, exponent: Column) -> Column:
        more = n + up.cast("long")
        over = more >= 10**DIGITS
        return F.struct(F.when(over, 10 ** (DIGITS - 1)).otherwise(more).cast("long").alias("n"), (exponent + over.cast("int")).cast("int").alias("exponent"))

    head = lambda d: _whole(F.substring(F.rpad(d, DIGITS, "0"), 1, DIGITS))

    def exact(full: Column) -> Column:
        rest = F.rtrim(F.substring(full["digits"], DIGITS + 1, 2000), F.lit("0"))
        return let(head(full["digits"]), lambda n: settle(n, (rest > "5") | ((rest == "5") & (n % 2 == 1)), full["exponent"]))

    rest = _whole(F.substring(F.rpad(F.substring(at["digits"], DIGITS + 1, 6), 6, "0"), 1, 6))
    unsure = (x < TINY) | (F.abs(rest - 500_000) <= NEAR)
    return F.when(unsure, let(exact_digits(x), exact)).otherwise(settle(head(at["digits"]), rest > 500_000, at["exponent"]))


def _laid_out(r: Column) -> Column:
    """Plain notation for exponents from -4 to ``DIGITS`` - 1, scientific beyond; no zeros at the end."""
    digits, e = r["n"].cast("string"), r["exponent"]
    trim = lambda s: F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))
    point = lambda d, at: F.concat(F.substring(d, 1, at), F.lit("."), F.substring(d, at + 1, F.lit(DIGITS)))
    sign = F.when(e < 0, "e-").otherwise("e+")
    power = F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0"))
    return (
        F.when((e < -4) | (e >= DIGITS), F.concat(trim(point(digits, F.lit(1))), sign, power))
        .when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.rtrim(digits, F.lit("0"))))
        .otherwise(trim(point(digits, e + 1)))
    )


def g12(x: Column) -> Column:
    """``'%.12g' % x``; null stays null."""
    size = F.abs(x)
    body = let(_written(size), lambda at: let(_rounded(at, size), _laid_out))
    minus = (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))
    return F.when(x.isNull(), None).when(F.isnan(x), "nan").otherwise(
        F.concat(F.when(minus, "-").otherwise(""), F.when(size == float("inf"), "inf").when(x == 0, "0").otherwise(body))
    )
