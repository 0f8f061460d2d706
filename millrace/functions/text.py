"""Scalar functions over untrusted spreadsheet text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
_EDGE = r"^[\s ]+|[\s ]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def clean_text(c: Column) -> Column:
    """Trimmed text; empty becomes null."""
    return F.nullif(trimmed(c), F.lit(""))


def identifier(c: Column) -> Column:
    """Text of an id; ``123.0`` becomes ``123``."""
    return F.regexp_replace(clean_text(c), r"^(\d+)\.0$", "$1")


def strict_integer(c: Column) -> Column:
    """Integer value of a number text without fraction (``2.0`` is 2); else null, also beyond 64 bits."""
    exact = F.when(trimmed(c).rlike(NUMBER), trimmed(c)).try_cast("decimal(38,10)")
    return F.when(exact == F.floor(exact), exact).try_cast("bigint")


def finite_decimal(c: Column) -> Column:
    """Exact decimal of a number text; null for anything else, infinities and more than 22 digits before the point included."""
    return F.when(trimmed(c).rlike(NUMBER), trimmed(c)).try_cast("decimal(38,16)")


def repaired_number(c: Column) -> Column:
    """Number behind blanks, thousands commas, accounting brackets and $ £ € signs."""
    bare = F.regexp_replace(trimmed(c), ",", "")
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return finite_decimal(trimmed(F.regexp_replace(signed, "[$£€]", "")))


def iso_timestamp(c: Column) -> Column:
    """Local timestamp of an ISO text without zone, else null."""
    return F.when(trimmed(c).rlike(ISO_TIME), trimmed(c)).try_cast("timestamp_ntz")


def slash_timestamp(c: Column, month_first: bool = False) -> Column:
    """Local timestamp of a ``d/M/yyyy H:mm`` text (or month first), one or two digits each; else null."""
    form = "M/d/yyyy H:mm" if month_first else "d/M/yyyy H:mm"
    read = F.try_to_timestamp(F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"), c), F.lit(form))
    return read.cast("timestamp_ntz")


def slug(c: Column) -> Column:
    """Lower-case words joined by underscores; ``unknown`` where nothing is left."""
    joined = F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def path_month(path: Column) -> Column:
    """The reporting month of a path: its folder's name if that is one, else the month between underscores or ends in the file's name, else the folder's name whatever it is."""
    folder = F.regexp_extract(path, r"(?:^|/)([^/]*)/[^/]*$", 1)
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = F.regexp_extract(stem, r"(?:^|_)(\d{4}-\d{2})(?:_|$)", 1)
    return F.when(folder.rlike(r"^\d{4}-\d{2}$"), folder).otherwise(F.coalesce(F.nullif(named, F.lit("")), folder))


def file_named(path: Column, country: Column, month: Column) -> Column:
    """Whether a file's name is its country's slug and month, alone or with more after an underscore."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    want = F.concat_ws("_", slug(country), month)
    return F.when(month.isNotNull(), (stem == want) | F.startswith(stem, F.concat(want, F.lit("_"))))


def formula_like(c: Column) -> Column:
    """Text that a spreadsheet would run: it starts with a tab or return, or behind these with = + @, or with - unless it is a number."""
    inner = F.regexp_replace(c, r"^[\t\r]+", "")
    negative = inner.startswith("-") & ~trimmed(inner).rlike(NUMBER) & ~trimmed(inner).rlike(r"(?i)^-inf(inity)?$")
    return F.coalesce(c.rlike(r"^[\t\r]") | inner.rlike("^[=+@]") | negative, F.lit(False))


# fixed values: what a formula has that reaches outside its workbook
OUTSIDE = (r"https?://", r"file://", r"\\\\[^\\]+", r"\|[^!]+!", r"\b(?:WEBSERVICE|RTD|CALL|EXEC|REGISTER\.ID)\s*\(", r"\[[^\]]+\.(?:xlsx|xlsm|xlsb|xls|csv)\]")
# fixed values: phrases that address a model
ADDRESSED = (
    r"ignore (?:all )?(?:previous|prior) instructions", r"system prompt", r"\bact as (?:an? |the )?(?:system|assistant|developer)\b", r"\bcall (?:a |the )?tool\b",
    r"\bexecute (?:this|the) (?:command|code|script|tool)\b", r"\breveal (?:credentials|secrets|the prompt)\b",
)


def external_formula(c: Column) -> Column:
    """Formula that reaches outside the workbook: web, file, share, DDE, another workbook or a function that runs or fetches."""
    return F.coalesce(c.rlike("(?i)" + "|".join(OUTSIDE)), F.lit(False))


def instruction_like(c: Column) -> Column:
    """Text that tells a model what to do instead of being data."""
    return F.coalesce(c.rlike("(?i)" + "|".join(ADDRESSED)), F.lit(False))


def safe_ratio(numerator: Column, denominator: Column, places: int = 6) -> Column:
    """Ratio at so many places, half to even; zero for a zero denominator."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.bround(numerator.cast("double") / denominator, places))
