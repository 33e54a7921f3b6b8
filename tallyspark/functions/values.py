"""Column helpers for text, numbers, dates and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyspark.functions import fixed_values as fv

_MONTH_NAME = (
    "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    "(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust|(?<=sep)t(?:ember)?|(?<=oct)ober|"
    "(?<=nov)ember|(?<=dec)ember)?"
)
_DAY, _YEAR, _REST = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})", r"((?:[T ].*)?)$"
# Shapes and their ISO order. `~` marks month first by number, which may turn out to be day first; `#` marks a month name.
_SHAPES = [
    (r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", ""),
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_REST}", "$1-$2-$3$4"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.]{_YEAR}{_REST}", "~$3-$1-$2$4"),
    (rf"^{_DAY}[- ]{_MONTH_NAME}\.?,?[- ]{_YEAR}{_REST}", "~$3-#$2-$1$4"),
    (rf"^{_MONTH_NAME}\.?[- ]{_DAY},?[- ]{_YEAR}{_REST}", "~$3-#$1-$2$4"),
    (r"^~(?<y>[0-5]\d|6[0-8])-", "~20${y}-"),
    (r"^~(?<y>\d\d)-", "~19${y}-"),
]
_HALF_DAY = r"^(.*?)[t ]+(\d{1,2})(:\d{2})?(:\d{2}(?:\.\d+)?)? *([ap])\.?m\.?$"


def strip_text(c: Column) -> Column:
    """Remove all Unicode white space at both ends (`trim` alone knows only blanks)."""
    return F.btrim(c, F.lit(fv.WHITE_SPACE))


def guard_formula(c: Column) -> Column:
    """Prefix a quote to a cell that a spreadsheet would run as a formula."""
    quote = F.when(F.substring(c, 1, 1).isin(fv.FORMULA_PREFIXES), "'").otherwise("")
    return F.concat(quote, c)


def is_null_token(c: Column) -> Column:
    """For a stripped cell; false where it is already NULL."""
    return F.coalesce(F.lower(c).isin(fv.CLEAN_NULL_TOKENS), F.lit(False))


def looks_numeric(c: Column) -> Column:
    return strip_text(c).rlike(fv.NUMERIC_PATTERN)


def looks_date(c: Column) -> Column:
    """Parses as a date; no number does, so numbers are not tried."""
    return F.when(looks_numeric(c), False).otherwise(parse_date(c).isNotNull())


def parse_number(c: Column) -> Column:
    """Money text to double: `($5)` is negative, `$ , %` are dropped, the rest is NULL."""
    s = strip_text(c)
    bare = strip_text(F.translate(F.btrim(s, F.lit("()")), "$,%", ""))
    number = F.when(bare.rlike(fv.PLAIN_FLOAT_PATTERN), bare.try_cast("double"))
    return F.when(s.startswith("(") & s.endswith(")"), -number).otherwise(number)


def parse_date(c: Column) -> Column:
    """Mixed-format date text to TIMESTAMP_NTZ, month first, day first where month first fails.

    Year first with `-`, `/` or `.`; day and month with `-`, `/` or `.`; months by name before or after the day; a
    weekday before it; a time of day after it, also with AM or PM. Two-digit years up to 68 are in this century.
    Every shape is rewritten to ISO text, each pattern at most once, and cast; nothing throws per value.
    """
    iso = F.lower(reduce(lambda text, shape: F.regexp_replace(text, *shape), _SHAPES, strip_text(c)))
    for number, name in enumerate(fv.MONTHS, 1):
        iso = F.replace(iso, F.lit(f"#{name}"), F.lit(str(number)))
    bound = F.transform(F.array(iso), _cast_iso)  # evaluates the text once
    return F.get(bound, 0)


def _cast_iso(text: Column) -> Column:
    part = lambda n: F.regexp_extract(text, _HALF_DAY, n)
    hour = part(2).try_cast("int")
    shifted = F.lpad((hour % 12 + F.when(part(5) == "p", 12).otherwise(0)).cast("string"), 2, "0")
    minutes = F.when(part(3) == "", ":00").otherwise(part(3))
    whole_day = F.when(
        text.rlike(_HALF_DAY), F.when(hour.between(1, 12), F.concat(part(1), F.lit(" "), shifted, minutes, part(4)))
    ).otherwise(text)
    month_first = F.upper(F.ltrim(whole_day, F.lit("~"))).try_cast("timestamp_ntz")
    day_first = F.upper(F.regexp_replace(whole_day, r"^~(\d+)-(\d+)-(\d+)", "$1-$3-$2")).try_cast("timestamp_ntz")
    shaped = text.rlike(r"^~?\d{4}-\d{1,2}-\d{1,2}(?:[t ].*)?$")
    return F.when(shaped, F.coalesce(month_first, day_first))


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from start to end."""
    return F.extract(F.lit("DAY"), end - start).cast("int")


def day_number(at: Column) -> Column:
    """Days since 1970-01-01 as an integer."""
    return F.unix_date(at.cast("date"))


def number_text(c: Column) -> Column:
    """A double written without exponent and with at least one decimal, e.g. `500.0`."""
    plain = F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.coalesce(plain, c.cast("string"))


def display_text(df: DataFrame, name: str) -> Column:
    """Any column as the text shown to a reader."""
    c = F.col(f"`{name}`")
    return number_text(c) if is_numeric(df, name) else c.cast("string")


def exact_parts(c: Column) -> tuple[Column, Column]:
    """Aggregates of a sum: exact as a decimal, NULL where some value has no exact place in one, and as a double.

    Eight decimals and thirty digits before them are exact, so totals do not depend on the order of rows; other
    values are added as doubles. Nothing throws.
    """
    fits = c.try_cast("decimal(38,8)")
    odd = F.count_if(c.isNotNull() & ~F.coalesce(fits.cast("double") == c.cast("double"), F.lit(False)))
    return F.when(odd == 0, F.try_sum(fits)), F.sum(c.cast("double"))


def merged_parts(exact: Column, loose: Column) -> tuple[Column, Column]:
    """Aggregates that add sums from `exact_parts` once more."""
    odd = F.count_if(loose.isNotNull() & exact.isNull())
    return F.when(odd == 0, F.try_sum(exact)), F.sum(loose)


def either_part(exact: Column, loose: Column) -> Column:
    return F.coalesce(exact.cast("double"), loose)


def exact_sum(c: Column) -> Column:
    """Order-independent money sum as a double; see `exact_parts`."""
    return either_part(*exact_parts(c))


def exact_mean(c: Column) -> Column:
    """Mean from the exact sum, so it does not depend on the order of rows."""
    return F.try_divide(exact_sum(c), F.count(c))


_LIMB = 36  # digits of the lower half of a long number


def _halves(a: Column) -> tuple[Column, Column]:
    high = F.coalesce(F.nullif(F.substring(a, F.lit(1), F.greatest(F.length(a) - _LIMB, F.lit(0))), F.lit("")), F.lit("0"))
    return high.try_cast("decimal(37,0)"), F.right(a, F.lit(_LIMB)).try_cast("decimal(37,0)")


def _combined(a: Column, b: Column, sign: int) -> Column:
    (a_high, a_low), (b_high, b_low) = _halves(a), _halves(b)
    limb = F.lit(f"1{'0' * _LIMB}").cast("decimal(37,0)")
    low = (a_low + b_low if sign > 0 else a_low - b_low).cast("decimal(38,0)")
    over = (low >= limb) if sign > 0 else (low < 0)
    low = F.when(over, low - sign * limb).otherwise(low).cast("decimal(38,0)")
    carry = sign * F.when(over, 1).otherwise(0)
    high = (a_high + b_high + carry if sign > 0 else a_high - b_high + carry).cast("decimal(38,0)")
    exact = F.when(high == 0, low.cast("string")).otherwise(F.concat(high.cast("string"), F.lpad(low.cast("string"), _LIMB, "0")))
    return F.coalesce(exact, (a.cast("double") + sign * b.cast("double")).cast("string"))


def plus(a: Column, b: Column) -> Column:
    """Sum of whole numbers as text: exact to 72 digits, as a rounded number beyond, never NULL."""
    return _combined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """Difference of whole numbers as text, `a` not smaller than `b`; exact to 72 digits, rounded beyond."""
    return _combined(a, b, -1)


def exceeds(c: Column, limit: float) -> Column:
    """abs(c) > limit, written as ranges so that Parquet row groups can be skipped."""
    return (c > float(limit)) | (c < -float(limit))


def has_columns(df: DataFrame, names: list[str]) -> bool:
    return set(names) <= set(df.columns)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def column_kind(df: DataFrame, name: str) -> str:
    """date, numeric or text."""
    return "date" if is_time(df, name) else "numeric" if is_numeric(df, name) else "text"


def severity_rank(c: Column) -> Column:
    return lookup(fv.SEVERITY_RANK, c, F.lit(0))


def lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = list(table.items())
    first = F.when(key == pairs[0][0], F.lit(pairs[0][1]))
    return reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), pairs[1:], first).otherwise(default)


def chi_square_tail_8df(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with 8 degrees of freedom (closed form)."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)
