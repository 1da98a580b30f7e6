"""Text expressions: blanks, labels, keys, identifiers and number formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.fixed_values import NA_TOKENS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null to blank text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def blank_missing(c: Column | str, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Missing tokens and null to blank text."""
    return F.when(col(c).isNull() | col(c).isin(*tokens), F.lit("")).otherwise(col(c))


def first_nonblank(*columns: Column | str) -> Column:
    """First value that is neither null nor blank, as text; blank if none."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in columns], F.lit(""))


def attribute_value(attributes: Column | str, name: str) -> Column:
    """Value of the first (name, value) item whose name matches, ignoring case; blank if none."""
    matches = F.filter(col(attributes), lambda item: F.lower(item["name"]) == name.lower())
    return text(F.get(matches, F.lit(0))["value"])


def pair_key(left: Column | str, right: Column | str, fallback: Column | str | None = None) -> Column:
    """Order-free key of two ids, blanks dropped."""
    ids = F.array_distinct(F.filter(F.array(text(left), text(right)), lambda x: x != ""))
    joined = F.array_join(F.array_sort(ids), "|")
    return first_nonblank(joined, fallback if fallback is not None else left)


def token_label(c: Column | str, tokens: Sequence[tuple[str, str]], fallback: Column) -> Column:
    """Label of the first token contained in the lower-cased text, else the fallback."""
    lowered = F.lower(text(c))
    chain = None
    for token, label in tokens:
        hit = lowered.contains(token)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return fallback if chain is None else chain.otherwise(fallback)


def truth(c: Column | str) -> Column:
    """Text 'true' in any case and with outer spaces is true; everything else is false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))) == "true", F.lit(False))


def list_has_any(c: Column | str, values: Sequence[str], sep: str = ";") -> Column:
    """Does the separated list hold any of the values?"""
    return F.arrays_overlap(F.split(text(c), sep, -1), F.array(*[F.lit(v) for v in values]))


def split_numeric_suffix(c: Column | str, pattern: str = r"_(\d+)$") -> tuple[Column, Column]:
    """(container, index) of an id with a numeric suffix; (whole id, -1) without one."""
    value = col(c)
    has = value.rlike(pattern)
    container = F.when(has, F.regexp_replace(value, pattern, "")).otherwise(value)
    index = F.when(has, F.regexp_extract(value, pattern, 1).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return container, index


def count_of(value: Column, characters: str) -> Column:
    """How many of the given characters the text holds (plain replacement is the fastest way)."""
    left = value
    for ch in characters:
        left = F.replace(left, F.lit(ch), F.lit(""))
    return (F.length(value) - F.length(left)).cast("bigint")


def first_token(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^\s*(\S*)", 1)


def mate_key(c: Column | str) -> Column:
    """First token of a record name without its /1 or /2 mate suffix."""
    return F.regexp_replace(first_token(c), r"/[12]$", "")


def prefixed_name(prefix: Column | str, name: Column | str) -> Column:
    """'@name' becomes '@prefix|name'."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(F.lit("@"), head, F.lit("|"), F.substring(F.rtrim(col(name)), 2, 2**31 - 1))


def joined_labels(c: Column | str, sep: str = ";") -> Column:
    """Aggregate: distinct labels, sorted and joined. For bounded vocabularies only."""
    return F.array_join(F.array_sort(F.collect_set(col(c))), sep)


def _exact_side(x: Column, places: Column, odd: Column) -> Column:
    """Sign of x * 2 * 10**places - odd, exactly: the product's rounding error is recovered."""
    factor = F.lit(2.0) * F.pow(F.lit(10.0), F.greatest(places, F.lit(0)))
    goal = odd.cast("double") * F.pow(F.lit(10.0), F.greatest(-places, F.lit(0)))

    def halves(value: Column) -> tuple[Column, Column]:
        shifted = value * F.lit(134217729.0)
        high = shifted - (shifted - value)
        return high, value - high

    product = x * factor
    (xh, xl), (fh, fl) = halves(x), halves(factor)
    error = ((xh * fh - product) + xh * fl + xl * fh) + xl * fl
    return F.signum(F.when(product == goal, error).otherwise(product - goal))


def add_three_digits(df: DataFrame, c: str, name: str) -> DataFrame:
    """Add a double as text with three significant digits, short form; infinity as 'Inf'.

    Correctly rounded (half to even only on exact ties). Plain notation for exponents -4 to 2, else
    'd.dde+XX'; trailing zeros are dropped. Steps are columns of their own to keep the plan small.
    """
    x = F.col(c)
    shown = df.withColumn("_shown", F.format_string("%.17e", F.abs(x)))
    split = shown.withColumns(
        {
            "_exp": F.regexp_extract("_shown", r"e([+-]\d+)$", 1).try_cast("int"),
            "_digits": F.replace(F.regexp_extract("_shown", r"^([0-9.]+)e", 1), F.lit("."), F.lit("")),
        }
    ).withColumns({"_kept": F.substring("_digits", 1, 3).try_cast("int"), "_rest": F.substring("_digits", 4, 40)})
    sided = split.withColumn("_side", _exact_side(F.abs(x), F.lit(2) - F.col("_exp"), F.col("_kept") * 2 + 1))
    tie_up = (F.col("_side") > 0) | ((F.col("_side") == 0) & (F.col("_kept") % 2 == 1))
    up = F.when(F.col("_rest").rlike("^50*$"), tie_up).otherwise(F.col("_rest") >= "5")
    rounded = sided.withColumn("_int", F.col("_kept") + up.cast("int")).withColumns(
        {
            "_number": F.when(F.col("_int") == 1000, F.lit(100.0)).otherwise(F.col("_int").cast("double")),
            "_power": F.when(F.col("_int") == 1000, F.col("_exp") + 1).otherwise(F.col("_exp")),
        }
    )
    plain = F.when(F.col("_power") == 2, F.format_string("%.0f", "_number"))
    for p in range(1, -5, -1):
        value = F.col("_number") / F.lit(float(10 ** (2 - p)))
        plain = plain.when(F.col("_power") == p, F.format_string(f"%.{2 - p}f", value))
    mantissa = F.format_string("%.2f", F.col("_number") / 100.0)
    tail = F.concat(F.when(F.col("_power") < 0, F.lit("e-")).otherwise(F.lit("e+")), F.format_string("%02d", F.abs("_power")))
    written = rounded.withColumns(
        {
            "_body": F.when(F.col("_power").between(-4, 2), plain).otherwise(mantissa),
            "_tail": F.when(F.col("_power").between(-4, 2), F.lit("")).otherwise(tail),
        }
    )
    short = F.when(F.col("_body").contains("."), F.regexp_replace("_body", r"\.?0+$", "")).otherwise(F.col("_body"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    out = (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("Inf"))
        .when(x == float("-inf"), F.lit("-Inf"))
        .when(x == 0.0, F.lit("0"))
        .otherwise(F.concat(sign, short, F.col("_tail")))
    )
    return written.select(*df.columns, out.alias(name))
