"""Input and output guards. A bad row becomes a status, never an exception."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions.text import py_strip

# The longest text that is scored, and the messages for refused texts.
MAX_SCORED_CHARS = 2000
NOT_A_STRING = "Invalid input: text must be a string."
EMPTY = "Text cannot be empty."
TOO_LONG = ("Text is too long (", f" characters). Maximum allowed size is {MAX_SCORED_CHARS} characters.")

# A web address as browsers read it: control characters and spaces around it are ignored, the
# slashes after the scheme may be missing or reversed, user info is allowed, the host may not be
# empty or hold forbidden characters, a port has digits only.
HTTP_URL = (
    r"^[\x00-\x20]*[hH][tT][tT][pP][sS]?:[/\\]*"
    r"([^/\\?#]*@)?"
    r"(\[[0-9a-fA-F:.]+\]|[^\x00-\x20\x7f#/:<>?@\[\\\]^|%]+)"
    r"(:[0-9]{0,5})?"
    r"([/\\?#](.|\n)*)?[\x00-\x20]*$"
)


def is_web_url(c: Column) -> Column:
    """True for a well-formed address whose protocol is http or https; null counts as false."""
    return F.coalesce(c.rlike(HTTP_URL), F.lit(False))


def scoring_guard(text: Column) -> Column:
    """``struct(status, detail)`` of a text offered to the scorer."""
    n = F.length(text)
    too_long = F.concat(F.lit(TOO_LONG[0]), n.cast("string"), F.lit(TOO_LONG[1]))
    return F.struct(
        F.when(n.isNull() | (n == 0) | (n > MAX_SCORED_CHARS), "error").otherwise("ok")
        .alias("status"),
        F.when(n.isNull(), NOT_A_STRING)
        .when(n == 0, EMPTY)
        .when(n > MAX_SCORED_CHARS, too_long).alias("detail"))


def extraction_guard(title: Column, text: Column) -> Column:
    return F.when(title.isNull() | text.isNull(), "missing").otherwise("ok")


def is_blank(c: Column) -> Column:
    return c.isNull() | (py_strip(c) == "")


def summary_guard(summary: Column) -> Column:
    return F.when(is_blank(summary), "invalid").otherwise("ok")


def blank_to_empty(text: Column, otherwise: Column) -> Column:
    """``""`` for blank input, ``otherwise`` for the rest."""
    return F.when(is_blank(text), F.lit("")).otherwise(otherwise)
