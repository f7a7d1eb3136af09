"""Grading of free-text answers: marker cascades, normal forms of quantities, tuples, test statuses and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.answers import qa_normal
from granary.functions.math_text import boxed, equal

# What a final answer's spelling is reduced by, in this order.
SPELLINGS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
# What is dropped from it afterwards, in this order.
DROPPED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes",
    "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ",
    "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
# TeX wrappers whose content stays; the last one takes the longest match.
UNWRAPPED = (r"\\text\{(.*?)\}", r"\\textbf\{(.*?)\}", r"\\overline\{(.*?)\}", r"\\boxed\{(.*)\}")
# Phrases before an answer, phrases behind it, and what may still stand before it.
BEFORE = ("answer:", "answer is", "answers are")
BEHIND = ("is answer", "is the answer", "are answers", "are the answers")
LEADS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")
# Units and powers of ten in quantities.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
POWERS = (("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))


def final_normal(text: Column) -> Column:
    """What follows the last '=', without units and TeX wrappers, fractions and roots in braces, numbers without commas."""
    text = F.substring_index(text, "=", -1)
    for old, new in (*SPELLINGS, *((token, "") for token in DROPPED)):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(?d).*?\$(.*?)\$.*", r"\$$1\$")
    for wrapper in UNWRAPPED:
        text = F.regexp_replace(text, "(?d)" + wrapper, "$1")
    text = F.regexp_replace(text, r"(?d)frac([^{])(.)", "frac{$1}{$2}")
    text = F.replace(F.regexp_replace(text, r"sqrt([^{])", "sqrt{$1}"), F.lit("$"), F.lit(""))
    return F.trim(F.when(text.rlike(r"\A,*[0-9][0-9,]*\z"), F.replace(text, F.lit(","), F.lit(""))).otherwise(text))


def strict_box(text: Column, truth: Column, last: int = 100) -> Column:
    """1 if the last box within the last characters holds exactly the truth, else -1."""
    return F.when(boxed(F.right(text, F.lit(last))) == truth, 1).otherwise(-1)


def searched_answer(text: Column) -> Column:
    """The last answer block, trimmed; null if there is none."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def searched_score(text: Column, golden: Column, within: bool = False, score: float = 1.0, form: float = 0.0, most: int = 10) -> Column:
    """The score if the last answer block equals (or, ``within``, contains) any golden answer in normal form.

    More than ``most`` opening or closing tags divide an exact match's score by four.
    """
    found = qa_normal(searched_answer(text))
    hit = F.exists(golden, lambda g: F.contains(found, qa_normal(g)) if within else found == qa_normal(g))
    tags = [(F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t) for t in ("<answer>", "</answer>")]
    good = F.lit(score) if within else F.when((tags[0] > most) | (tags[1] > most), score / 4).otherwise(score)
    return F.when(found.isNull(), 0.0).when(hit, good).otherwise(form)


def marked_answer(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add a struct (matched, answer): what the cascade of answer phrases, box, last sentence and leads leaves.

    Matched means that a phrase, box or lead was there and the rest holds a digit. Each step
    names its input once, so that the plan stays linear in the steps.
    """
    behind = lambda x, marker: F.regexp_replace(x, rf"(?is)\A.*{marker}\s*(.*?)\s*\z", "$1")
    before = lambda x, marker: F.regexp_replace(x, rf"(?is)\A\s*(.*){marker}.*\z", "$1")
    head = reduce(before, BEHIND, reduce(behind, BEFORE, F.col(text)))
    df = df.withColumn("_head", head).withColumn("_box", F.nullif(F.trim(boxed(F.col("_head"))), F.lit("")))
    df = df.withColumn("_rest", F.coalesce("_box", "_head"))
    df = df.withColumn("_last", F.when(F.contains("_rest", F.lit(". ")), F.trim(F.regexp_replace("_rest", r"(?s)\A(.*)\. .*\z", "$1"))).otherwise(F.col("_rest")))
    df = df.withColumn("_answer", reduce(behind, LEADS, F.col("_last")))
    matched = (F.length("_rest") < F.length(text)) | (F.length("_answer") < F.length("_last"))
    answer = F.struct((matched & F.col("_answer").rlike(r"(?U)\d")).alias("matched"), F.trim("_answer").alias("answer"))
    return df.withColumn(out, answer).drop("_head", "_box", "_rest", "_last", "_answer")


def quantity(text: Column) -> Column:
    """A quantity without units, currency and wrappers, in lower case; whole numbers without point or commas.

    TeX that isn't a wrapper stays as it is written.
    """
    text = F.regexp_replace(text, r"\A\\text\{(.+?)\}\z", "$1")
    text = F.regexp_replace(text, r"\\?[%$]", "")
    text = F.regexp_replace(text, " (or|and) ", " , ")
    for word, power in POWERS:
        text = F.replace(text, F.lit(word), F.lit(power))
    for unit in UNITS:
        text = F.regexp_replace(text, rf"{unit}(es)?(s)? *(\^[0-9]+)?", "")
    text = F.regexp_replace(text, r"\^ *\\circ", "")
    text = F.regexp_replace(text, r"(?s)\A\{(.*)\}\z", "$1")
    text = F.regexp_replace(text, r",\\! *", "")
    number = F.trim(text).try_cast("double")
    whole = (F.abs(number - F.rint(number)) <= 1e-7) & (F.abs(number) < 1e37) & ~F.trim(text).rlike(r"[dDfF]\z")
    text = F.when(whole, F.rint(number).cast("decimal(38,0)").cast("string")).otherwise(text)
    text = F.regexp_replace(text, "- *", "-")
    text = F.lower(F.regexp_replace(text, "([0-9]) +([0-9])", "$1+$2"))
    return F.when(text.rlike(r"\A\s*-?[0-9]{1,3}(,[0-9]{3})+\s*\z"), F.trim(F.replace(text, F.lit(","), F.lit("")))).otherwise(text)


def tuple_parts(text: Column) -> Column:
    """The trimmed elements of a bracketed list; of anything else the text alone; none of an empty text."""
    whole = F.regexp_replace(text, r"([0-9]),([0-9]{3})(?![0-9])", "$1$2")
    bracketed = whole.rlike(r"(?s)\A[\[(][^\[\]()]+[\])]\z")
    parts = F.transform(F.split(F.substr(whole, F.lit(2), F.length(whole) - 2), ","), lambda x: F.trim(x))
    return F.when(bracketed, parts).when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))


def tuple_equal(left: Column, right: Column) -> Column:
    """Element by element equal, with the same brackets."""
    a, b = tuple_parts(left), tuple_parts(right)
    ends = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(equal(x, y), F.lit(False)))
    shape = F.when(F.size(a) > 1, ends(left) == ends(right)).otherwise(F.lit(True))
    return (F.size(a) == F.size(b)) & shape & F.forall(pairs, lambda x: x)


def boxed_format(text: Column) -> Column:
    """1.0 if a think block comes before a box, else 0.0."""
    return F.when(text.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"), 1.0).otherwise(0.0)


def case_status(error: Column, api: Column, compiled: Column, compile_code: Column, ran: Column, run_code: Column, stdout: Column, expected: Column) -> Column:
    """A test's outcome: 1 right, 0 wrong, -1 unknown, -2 runtime error, -3 timeout, -4 compile error.

    Null statuses mean that the phase gave no result.
    """
    fails = lambda status, code: status.isin("Error", "TimeLimitExceeded") | ((status == "Finished") & ~code.eqNullSafe(F.lit(0)))
    cut = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\n+\z", "")
    failed = F.when(fails(compiled, compile_code), -4).when(ran == "TimeLimitExceeded", -3).when(fails(ran, run_code), -2).otherwise(-1)
    passed = F.when(ran == "Finished", (cut(stdout) == cut(expected)).cast("int")).otherwise(-1)
    return F.when(error.isNotNull(), -1).when(api == "Failed", failed).when(api == "Success", passed).otherwise(-1)


def spread_compile_errors(rows: DataFrame, group: str, order: str, status: str) -> DataFrame:
    """All cases behind a program's first compile error count as compile errors."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.coalesce(F.max(F.col(status) == -4).over(before), F.lit(False))
    return rows.withColumn(status, F.when(broken, -4).otherwise(F.col(status)))


def logged_value(line: Column, metric: str) -> Column:
    """A metric of a console line 'step:N - name:value - ...'; minus infinity if it can't be read."""
    parts = F.filter(F.split(line, " - "), lambda x: F.substring_index(x, ":", 1) == metric)
    return F.coalesce(F.substring_index(F.try_element_at(parts, F.lit(1)), ":", -1).try_cast("double"), F.lit(float("-inf")))


def pass_rate(status: Column, first: int | None = None) -> Column:
    """The share of test cases that passed (status 1), of all or of the ``first`` ones; null without cases."""
    taken = status if first is None else F.slice(status, F.lit(1), F.lit(first))
    return F.aggregate(taken, F.lit(0.0), lambda n, s: n + F.when(s == 1, 1.0).otherwise(0.0)) / F.nullif(F.size(taken), F.lit(0))
