"""Small text and number helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _visible(char: Column) -> Column:
    """Whether a text begins with a visible ASCII character."""
    return (char >= "!") & (char < "\x7f")


def blank_to_null(text: Column) -> Column:
    """Stripped text, null for a blank one.  Most texts have nothing to strip, and seeing
    that by their first and last character costs far less than stripping them."""
    whole = _visible(text) & _visible(F.substring(text, -1, 1))
    return F.when(whole, text).otherwise(F.nullif(strip(text), F.lit("")))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extract(text: Column, pattern: str, group: int) -> Column:
    """``regexp_extract`` with null instead of the empty text."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def iso_text(ts: Column) -> Column:
    """ISO text of a timestamp; the fraction is left out when it is zero."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    head = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, head).otherwise(
        F.concat(head, F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )


def half_even(value: Column, digits: int) -> Column:
    """``value * 10**digits`` rounded to a whole number, exact on the binary value.

    ``format_string`` and ``bround`` round the shortest decimal form, so 2.675
    becomes 2.68 although the stored double is below it.  The rounding error of
    the product (Dekker's product) decides the cases that look like ties.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    error = (high * scale - product) + (value - high) * scale
    low = F.floor(product)
    rest = product - low
    up = (
        F.when(rest > 0.5, 1)
        .when(rest < 0.5, 0)
        .when(error > 0, 1)
        .when(error < 0, 0)
        .otherwise(F.pmod(low, F.lit(2)))
    )
    return low + up


def fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded half-even on the exact value."""
    value = value.cast("double")
    whole = half_even(F.abs(value), digits).cast("bigint")
    unit = F.lit(10**digits).cast("bigint")
    return F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(whole / unit).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((whole % unit).cast("string"), digits, "0"),
    )


def rounded(value: Column, digits: int) -> Column:
    value = value.cast("double")
    whole = half_even(F.abs(value), digits) / F.lit(float(10**digits))
    return F.when(value < 0, -whole).otherwise(whole)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0.0 where the whole is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def present(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def first_match(rules, default) -> Column:
    """Ordered decision table: ``[(condition, value)]`` then ``default``."""
    head, *tail = rules
    chain = F.when(head[0], F.lit(head[1]) if not isinstance(head[1], Column) else head[1])
    for condition, value in tail:
        chain = chain.when(condition, F.lit(value) if not isinstance(value, Column) else value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def text(*parts) -> Column:
    """Concatenate literals and columns into one text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A filter on a plain computed column is pushed below it and repeats its
    expression for every use; it is not pushed through a generator.  The value is
    made before the generator, which would interpret an expression with a lambda
    in it as a whole.
    """
    made = df.withColumn("_once", value)
    return made.select("*", F.explode(F.array("_once")).alias(name)).drop("_once")
