"""Mathematical answers in text: the last box, and equality up to notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What notation is replaced by what, in this order.
NOTATIONS = (
    ("\n", ""),
    ("\\!", ""),
    ("\\\\", "\\"),
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("^{\\circ}", ""),
    ("^\\circ", ""),
    ("\\$", ""),
)
# The same, once units at the right are cut.
AFTER_UNITS = (("\\%", ""), (" .", " 0."), ("{.", "{0."))


def boxed(text: Column) -> Column:
    """What the last \\boxed or \\fbox holds, to the matching brace; null if there is none."""
    marked = F.replace(text, F.lit("\\fbox"), F.lit("\\boxed"))
    tail = F.when(F.contains(marked, F.lit("\\boxed")), F.substring_index(marked, "\\boxed", -1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        closed = (s["end"] == 0) & (depth == 0) & (c == "}")
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])
    return F.when(F.startswith(tail, F.lit("{")) & (end > 0), F.substr(tail, F.lit(2), end - 2))


def notation(text: Column) -> Column:
    """One spelling of equal notations."""
    for old, new in NOTATIONS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(?s)\\text\{ .*\z", "")
    for old, new in AFTER_UNITS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"\A\.", "0.")
    text = F.regexp_replace(text, r"(?s)\A[^=]{0,2}=([^=]*)\z", "$1")
    text = F.regexp_replace(text, r"\\sqrt([^{])", r"\\sqrt{$1}")
    text = F.replace(text, F.lit(" "), F.lit(""))
    text = F.regexp_replace(text, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    text = F.regexp_replace(text, r"\\frac([^{])\{", r"\\frac{$1}{")
    text = F.when(text == "0.5", "\\frac{1}{2}").otherwise(text)
    return F.regexp_replace(text, r"\A(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")


def equal(left: Column, right: Column) -> Column:
    """Equal notation, or equal numbers within a ten-thousandth, also as percentages."""
    same = notation(left) == notation(right)
    a, b = (F.regexp_replace(x, "[,$]", "").try_cast("double") for x in (left, right))
    close = F.lit(False)
    for scale in (0.01, 1.0, 100.0):
        close = close | (F.abs(a - b * scale) <= 1e-4 * F.abs(b * scale))
    return F.coalesce(same, F.lit(False)) | F.coalesce(close, F.lit(False))
