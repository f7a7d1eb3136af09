"""Scoring of text answers: extraction, normalisation and the composite reward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats in which answers are given, as patterns.
LIST = r'\[[\s\S]*?\]'
VALUE = LIST + r'|"[\s\S]*?"|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?'
BARE = r'(\{\s*"answer"\s*:\s*(?:' + VALUE + r")\s*\})"
FENCED = r"```json\s*" + BARE + r"\s*```"
FENCED_LIST = r'```json\s*(\{\s*"answer"\s*:\s*(?:' + LIST + r")\s*\})\s*```"
BLOCK = r"(?s)<answer>(.*?)</answer>"
WHOLE = r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z"
NUMBER = r"\A[+-]?(?:(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z"


def plain(text: Column) -> Column:
    """Letters and digits of ASCII, lower-cased."""
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]", ""))


def _parsed(json: Column) -> Column:
    """The answer of a JSON object as a variant; null if there is none."""
    return F.try_variant_get(F.try_parse_json(json), "$.answer", "variant")


def _candidate(text: Column) -> Column:
    """Fenced JSON if there is any, valid or not; else the first bare object."""
    fenced = F.regexp_extract(text, FENCED, 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(F.regexp_extract(text, BARE, 1), F.lit("")))


def with_answers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the answer's normalised elements: of the first answer block, else of the whole text.

    In steps, so that every pattern and parse runs once a row.
    """
    df = df.withColumn("_block", F.nullif(F.regexp_extract(text, BLOCK, 1), F.lit("")))
    df = df.withColumn("_own", _parsed(_candidate(F.col("_block"))))
    df = df.withColumn("_answer", F.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(_parsed(_candidate(F.col(text)))))
    df = df.withColumn("_kind", F.schema_of_variant("_answer"))
    listed = F.when(F.col("_kind").startswith("ARRAY"), F.try_variant_get("_answer", "$", "array<variant>")).when(F.col("_answer").isNotNull() & ~F.col("_kind").startswith("VOID"), F.array("_answer"))
    df = df.withColumn("_list", listed)
    pairs = F.transform("_list", lambda v: F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")))
    return df.withColumn("_pairs", pairs).withColumn(out, normalised(F.col("_pairs"))).drop("_block", "_own", "_answer", "_kind", "_list", "_pairs")


def normalised(elements: Column) -> Column:
    """array<struct<num, str>> of elements (kind, text): numbers and number-like strings as doubles, other strings plain.

    Any other element empties the whole list; null stays null.
    """

    def one(e: Column) -> Column:
        kind, text = e["kind"], e["text"]
        bare = F.regexp_replace(text, ",", "")
        number = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double")).when((kind == "STRING") & text.rlike(NUMBER), bare.try_cast("double"))
        known = kind.rlike("^(BOOLEAN|BIGINT|DECIMAL|DOUBLE|FLOAT|STRING)")
        return F.when(known, F.struct(number.alias("num"), F.when(number.isNull(), plain(text)).alias("str")))

    made = F.transform(elements, one)
    return F.when(F.exists(made, lambda x: x.isNull()), F.slice(made, 1, 0)).otherwise(made)


def well_formed(text: Column) -> Column:
    """One think block, then one answer block with fenced JSON that holds a list."""
    once = F.lit(True)
    for tag in ("<think>", "</think>", "<answer>", "</answer>"):
        once = once & (F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit(""))) == len(tag))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.nullif(F.regexp_extract(F.regexp_extract(text, BLOCK, 1), FENCED_LIST, 1), F.lit(""))), "$.answer", "variant"))
    return F.coalesce(text.rlike(WHOLE) & once & kind.startswith("ARRAY"), F.lit(False))


def partial_match(found: Column, truth: Column) -> Column:
    """Whether any element equals any true one: numbers within 0.01, texts exactly."""
    return F.exists(found, lambda a: F.exists(truth, lambda b: F.coalesce(F.abs(a["num"] - b["num"]) < 1e-2, a["str"] == b["str"], F.lit(False))))


def gsm8k(text: Column, strict: bool) -> Column:
    """The final number: behind '####', or the last number that isn't a lone point."""
    if strict:
        return F.nullif(F.regexp_replace(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), "[,$]", ""), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def gsm8k_score(text: Column, truth: Column, strict: bool = True, form: float = 0.0, score: float = 1.0) -> Column:
    """0 without an answer, ``score`` if it is the truth, else ``form``."""
    answer = gsm8k(text, strict)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(F.lit(float(form)))


def qa_normal(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces, in this order."""
    bare = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def choice(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)), F.lit(""))


def last_answer_line(text: Column) -> Column:
    """The last 'Answer: ...' among the last 300 characters."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def cleaned_activity(text: Column) -> Column:
    """Trimmed, '[title]' turned to a full stop, other brackets dropped, double spaces halved once."""
    return F.replace(F.regexp_replace(F.replace(F.trim(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def code_block(text: Column) -> Column:
    """The last python fence's code; else the first fence's without its language word; else the text."""
    last = F.split(F.element_at(F.split(text, "```python"), -1), "```")[0]
    first = F.try_element_at(F.split(text, "```"), F.lit(2))
    bare = F.when(first.rlike(r"\A[A-Za-z]+\n"), F.regexp_replace(first, r"\A[A-Za-z]+\n", "")).otherwise(first)
    return F.when(F.contains(text, F.lit("```python")), last).when(F.contains(text, F.lit("```")), bare).otherwise(text)
