"""Column expressions shared by the result and dataset operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names, labels and tokens that results are compared by.
UNIFORM_TOKEN = "UniformSynthesizer"
MODEL_SUFFIX = "Synthesizer"
TIMEOUT_ERROR = "Synthesizer Timeout"
DEADLINE_ERROR = "Instance Deadline Error"
KNOWN_ERRORS = {"timeout": "Synthesizer Timeout", "memory_error": "MemoryError"}
# The label of the first family is a caller's choice.
LIBRARY_TOKENS = {
    "In-house": ["ctgan", "copulagan", "gaussiancopula", "tvae", "hma1", "par"],
    "YData": ["dragan", "vanillagan", "wgan"],
}

# strftime directives and the Spark datetime pattern letters of the same meaning.
STRFTIME_PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
    "%p": "a", "%j": "DDD", "%z": "xx",
}


def plain_name(name: Column) -> Column:
    """Drop a trailing run number such as ` (2)`."""
    return F.trim(F.regexp_replace(name, r"\s*\(\d+\)\s*$", ""))


def short_name(name: Column) -> Column:
    return F.replace(name, F.lit(MODEL_SUFFIX), F.lit(""))


def is_uniform(name: Column) -> Column:
    return F.coalesce(F.contains(name, F.lit(UNIFORM_TOKEN)), F.lit(False))


def library_of(name: Column, libraries: dict[str, list[str]] | None = None) -> Column:
    """First library with a token inside the lower-cased name, else `Other`."""
    found = None
    for library, tokens in (libraries or LIBRARY_TOKENS).items():
        test = F.lower(name).rlike("|".join(tokens))
        found = F.when(test, library) if found is None else found.when(test, library)
    return found.otherwise("Other")


def known_error(error: Column, message: str) -> Column:
    return F.coalesce(F.contains(error, F.lit(message)), F.lit(False))


def unknown_error(error: Column) -> Column:
    """The error text, null where it is one of the known errors."""
    known = F.lit(False)
    for message in KNOWN_ERRORS.values():
        known = known | known_error(error, message)
    return F.when(~known, error)


def safe_log10(value: Column) -> Column:
    return F.when(value > 0, F.log10(value)).otherwise(F.lit(0.0))


def short_error(error: Column, width: int = 30) -> Column:
    return F.when(F.length(error) > width, F.concat(F.substring(error, 1, width), F.lit("..."))).otherwise(error)


def safe_double(text: Column) -> Column:
    return no_nan(text.try_cast("double"))


def safe_int(text: Column) -> Column:
    return text.try_cast("int")


def no_nan(value: Column) -> Column:
    """NaN to null: Spark orders NaN above every number, the result rules treat it as missing."""
    return F.when(~F.isnan(value), value)


def clean_nans(df):
    """Apply `no_nan` to every floating point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: no_nan(F.col(c)) for c in floats}) if floats else df


def run_date(folder: Column) -> Column:
    """Date of a run folder ending in MM_DD_YYYY; null for any other name."""
    text = F.regexp_extract(folder, r"(\d{2}_\d{2}_\d{4})$", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("MM_dd_yyyy")))


def run_folder(iso_date: Column, prefix: str) -> Column:
    """`YYYY-MM-DD` to `<prefix>MM_DD_YYYY`."""
    return F.concat(F.lit(prefix), F.date_format(F.to_date(iso_date), "MM_dd_yyyy"))


def run_id(date: Column, number: Column) -> Column:
    return F.concat(F.lit("run_"), F.date_format(date, "MM_dd_yyyy"), F.lit("_"), number.cast("string"))


def spark_pattern(strftime_format: str) -> str:
    """Translate a strftime format to Spark's pattern letters; literal letters get quoted."""
    out, i = [], 0
    while i < len(strftime_format):
        two = strftime_format[i : i + 2]
        if two in STRFTIME_PATTERNS:
            out.append(STRFTIME_PATTERNS[two])
            i += 2
            continue
        char = strftime_format[i]
        out.append(f"'{char}'" if char.isalpha() else char)
        i += 1
    return "".join(out)


def _epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def to_micros(value: Column, strftime_format: str | None = None) -> Column:
    """Datetime to micros since 1970 on the wall clock, whatever the session's time zone.

    Text that does not parse becomes null.
    """
    if strftime_format:
        value = F.try_to_timestamp(value, F.lit(spark_pattern(strftime_format)))
    return F.timestamp_diff("MICROSECOND", _epoch(), value.cast("timestamp_ntz"))


def from_micros(micros: Column, strftime_format: str | None = None) -> Column:
    value = F.timestamp_add("MICROSECOND", micros.cast("bigint"), _epoch())
    return F.date_format(value, spark_pattern(strftime_format)) if strftime_format else value


def coverage_text(solved: Column, total: Column) -> Column:
    return F.concat(solved.cast("string"), F.lit(" / "), total.cast("string"))


def past_deadline(now: Column, launched: Column, timeout_seconds: Column) -> Column:
    """One day of grace after launch plus timeout."""
    return now >= launched + F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), timeout_seconds.cast("decimal(18,6)"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows holding both values; null where either does not vary.

    The built-in aggregate divides by zero on constant columns.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def slope(y: Column, x: Column) -> Column:
    """Slope of y over x; null where x does not vary."""
    x = F.when(y.isNotNull(), x)
    return F.covar_pop(y, x) / F.nullif(F.var_pop(x), F.lit(0.0))
