"""Personal data by boosted candidate scoring, in DataFrame expressions.

Strict patterns give the base spans, which always stand. High-recall generators
propose further spans, overlapping each other and the base ones: numbers inside
a run that a strict pattern took and dropped, addresses written with ``[at]`` or
``[.]``, numbers without a country code. Boosted trees score each candidate by
its format and context.

Labels: a candidate that overlaps a base span of its kind is personal data (1);
one that overlaps only another kind's, or whose digits can't be of its kind (the
Luhn test, a part above 255, too few digits), is not (0); what is neither has no
label and is what the model decides on. No feature repeats those tests. As base
spans are never added themselves, each labelled candidate also trains in a
rewritten form that no strict pattern takes (:func:`rewritten`), so that such
forms are learned and held out as well. A logistic curve fitted on the held-out
third turns margins into probabilities (:func:`calibrated`), and each kind's
threshold is the margin at which that probability is ``PRECISION``.

A candidate is added if it reaches the threshold, overlaps no base span and
overlaps no better candidate that does both.

Everything that touches documents is SQL. Matches become one row each, placed by
running sums of the lengths between them; overlaps are running maxima, so that
the work is linear in a document's spans. The driver fits the trees on at most
``2 * sample`` rows of numbers a kind.

All repetitions in the patterns are possessive or bounded, so that matching
neither recurses nor backtracks over very long texts.

Defined results: null and empty texts have no spans; a repeated row has the
same spans; rows are kept one to one; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import boosting
from granary.session import pinned

KINDS = ("email", "ip", "card", "phone")

# The strict patterns. `\G` allows a start right behind the match before, inside a run of the
# class; other starts inside a run can't match where its first character doesn't.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?(?:\(at\)|\[at\]) ?)[A-Za-z0-9-]{1,63}+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|\[\.\]| \. )[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])",
}
# A text without a match of this can't match either pattern of the kind.
HINT = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9](?:\.|\[\.\]| \. )[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"[0-9][ ).-]{1,2}[0-9]{2}|\+[0-9]"}
CUES = {
    "email": r"(?i)mail|contact|write|reach|send",
    "ip": r"(?i)\bip\b|addr|host|server|node|ping",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell|contact",
}
CONTEXT = 24
LONGEST = 420  # no loose pattern takes more characters
SAMPLE = 12_000
PRECISION = 0.9
FEATURES = 11


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    turned = F.split(F.reverse(digits), "")
    doubled = F.transform(turned, lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def by_kind(choose) -> Column:
    """``choose(kind)`` by the column ``kind``."""
    chosen = F.lit(None)
    for kind in reversed(KINDS):
        chosen = F.when(F.col("kind") == kind, choose(kind)).otherwise(chosen)
    return chosen


def passes(kind: str, match: Column) -> Column:
    """The strict pattern's further test of a match."""
    digits = only_digits(match)
    if kind == "ip":
        parts = F.transform(F.split(match, r"[^0-9]+"), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits) <= 19, luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(pattern: str, hint: str) -> Column:
    """The pattern's leftmost non-overlapping matches in the column ``text``: how long what lies before each is, and its edges."""
    hit = F.col("text").rlike(hint)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    left = F.split("text", pattern, -1)
    n = F.size(found)
    zipped = F.arrays_zip(F.slice(left, F.lit(1), n).alias("p"), found.alias("m"), F.slice(left, F.lit(2), n).alias("q"))
    short = F.transform(zipped, lambda x: F.struct(F.length(x["p"]).alias("gap"), x["m"].alias("match"), F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["q"], F.lit(CONTEXT)).alias("after")))
    return F.when(hit & (n > 0), short)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: row_id, doc_id, and each pattern's matches."""
    df = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    strict = [_matches(STRICT[k], HINT[k]).alias(f"strict_{k}") for k in KINDS]
    return df.select("row_id", "doc_id", *strict, *[_matches(LOOSE[k], HINT[k]).alias(f"loose_{k}") for k in KINDS])


def _listed(name: str, kind: str, strict: bool) -> Column:
    named = F.transform(name, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("base"), i.alias("number"), x["gap"].alias("gap"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after")))
    return F.coalesce(named, F.array().cast("array<struct<kind:string,base:boolean,number:int,gap:int,match:string,before:string,after:string>>"))


def placed(found: DataFrame) -> DataFrame:
    """A row per base span and candidate: row_id, kind, base, start, end (code points), match, before, after, and of which kinds a base span overlaps it."""
    every = F.concat(*[_listed(f"strict_{k}", k, True) for k in KINDS], *[_listed(f"loose_{k}", k, False) for k in KINDS])
    rows = found.select("row_id", F.explode(every).alias("s")).select("row_id", "s.*").repartition("row_id")
    along = Window.partitionBy("row_id", "kind", "base").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(along).cast("int")).withColumn("start", F.col("end") - F.length("match"))
    rows = rows.where(~F.col("base") | by_kind(lambda k: passes(k, F.col("match"))))
    first = F.desc("base")  # base spans before candidates that begin at the same place
    up = Window.partitionBy("row_id").orderBy("start", first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row_id").orderBy(F.desc("start"), first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda k, edge: F.when(F.col("base") & (F.col("kind") == k), F.col(edge))
    rows = rows.withColumns({f"end_{k}": F.max(of(k, "end")).over(up) for k in KINDS}).withColumns({f"start_{k}": F.min(of(k, "start")).over(down) for k in KINDS})
    meets = {f"meets_{k}": F.coalesce(F.col(f"end_{k}") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"start_{k}") < F.col("end"), F.lit(False)) for k in KINDS}
    return rows.select("row_id", "kind", "base", "start", "end", "match", "before", "after", *[c.alias(n) for n, c in meets.items()])


def rewritten(kind: str, match: Column) -> Column:
    """The match in a form that the strict pattern of its kind doesn't take, or takes otherwise."""
    if kind == "email":
        return F.replace(match, F.lit("@"), F.lit(" [at] "))
    if kind == "ip":
        return F.regexp_replace(match, r"[^0-9]+", "[.]")
    if kind == "card":
        return F.regexp_replace(only_digits(match), r"([0-9]{4})(?=[0-9])", "$1-")
    return F.regexp_replace(match, r"^\+[0-9]{1,3}[ .-]?", "")


def features(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    digits = only_digits(match)
    near = lambda edge: F.when(edge == "", 0).when(edge.rlike(r"^\s$"), 1).when(edge.rlike(r"^[A-Za-z0-9]$"), 2).otherwise(3)
    found = [
        F.length(match),
        F.length(digits),
        F.size(F.split(match, r"[0-9]+")) - 1,  # groups of digits
        F.length(F.regexp_replace(match, r"[A-Za-z0-9]", "")),
        F.length(F.regexp_replace(match, r"[^ ]", "")),
        F.length(F.regexp_replace(match, r"[^().\[\]-]", "")),
        F.size(F.array_distinct(F.split(digits, ""))),
        near(F.right(before, F.lit(1))),
        near(F.left(after, F.lit(1))),
        before.rlike(CUES[kind]).cast("int"),
        F.length(F.element_at(F.split(match, r"[^A-Za-z0-9]+"), -1)),
    ]
    return [x.cast("double") for x in found]


def calibrated(margins: np.ndarray, truth: np.ndarray, wanted: float = PRECISION) -> float:
    """The margin from which a logistic curve fitted to held-out rows reaches the wanted probability; infinite if none does.

    The targets are smoothed (Platt), so that few rows give no certainty; where all have
    one label the curve is flat at their smoothed share.
    """
    ones, n = truth.sum(), len(truth)
    if ones in (0, n):
        return -math.inf if (ones + 1) / (n + 2) >= wanted else math.inf
    goal = np.where(truth > 0, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    x = np.stack([margins, np.ones(n)], axis=1)
    line = np.array([0.0, math.log((ones + 1) / (n - ones + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (goal - p))
        line += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float((math.log(wanted / (1 - wanted)) - line[1]) / line[0]) if line[0] > 1e-6 else math.inf


def fit(spans: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[boosting.Boosted, float]]:
    """For each kind the trees and the threshold on their margin.

    Of each kind's labelled candidates the first ``sample`` by a hash train and
    calibrate, each as found and rewritten; a third is held out, both forms together.
    """
    models = {}
    for kind in KINDS:
        other = F.greatest(*[F.col(f"meets_{k}") for k in KINDS if k != kind])
        label = F.when(F.col(f"meets_{kind}"), 1).when(other | ~passes(kind, F.col("match")), 0)
        own = spans.where(~F.col("base") & (F.col("kind") == kind)).select(F.xxhash64("row_id", "start", "match").alias("key"), label.alias("y"), "match", "before", "after")
        chosen = own.where("y is not null").orderBy("key", "y", "match").limit(sample)
        forms = [F.array(*features(kind, m, F.col("before"), F.col("after"))) for m in (F.col("match"), rewritten(kind, F.col("match")))]
        rows = chosen.select("key", "y", *[f.alias(n) for f, n in zip(forms, ("found", "other"), strict=True)]).collect()
        x = np.array([r[form] for form in ("found", "other") for r in rows], float).reshape(2 * len(rows), FEATURES)
        y, held = np.array([r["y"] for r in rows] * 2, float), np.array([r["key"] % 3 == 0 for r in rows] * 2, bool)
        model = boosting.fit(x[~held], y[~held])
        models[kind] = model, calibrated(model.margins(x[held]), y[held])
    return models


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The documents (row_id, doc_id), and a row per span: row_id, kind, start, end, base (strict, else added)."""
    found = pinned(matches(docs, id_col, text_col))
    rows = pinned(placed(found))
    models = fit(rows, sample)
    free = rows.where(~F.col("base")).where(~F.greatest(*[F.col(f"meets_{k}") for k in KINDS]))
    scored = []
    for kind, (model, bar) in models.items():
        own = free.where(F.col("kind") == kind)
        x = [f.alias(f"x{i}") for i, f in enumerate(features(kind, F.col("match"), F.col("before"), F.col("after")))]
        margin = model.expression([F.col(f"x{i}") for i in range(FEATURES)])
        scored.append(own.select("row_id", "kind", "start", "end", *x).select("row_id", "kind", "start", "end", margin.alias("margin")).where(F.col("margin") >= F.lit(bar)))
    free = scored[0].unionByName(scored[1]).unionByName(scored[2]).unionByName(scored[3])
    around = Window.partitionBy("row_id").orderBy("start").rangeBetween(-LONGEST, LONGEST)
    rank = F.struct(F.col("margin"), -F.col("start"), F.col("kind"))
    near = F.collect_list(F.struct("start", "end", rank.alias("rank"))).over(around)
    beaten = F.exists("near", lambda n: (n["start"] < F.col("end")) & (F.col("start") < n["end"]) & (n["rank"] > F.col("rank")))
    added = free.withColumns({"rank": rank, "near": near}).where(~beaten).select("row_id", "kind", "start", "end", F.lit(False).alias("base"))
    return found.select("row_id", "doc_id"), rows.where("base").select("row_id", "kind", "start", "end", "base").unionByName(added)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, counts of base spans, their digest, and all spans as text."""
    rows, found = spans(docs, id_col, text_col, sample)
    place = by_kind(lambda k: F.lit(KINDS.index(k))).cast("int")
    one = F.struct(place.alias("place"), "start", "end", "kind")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    listed = found.groupBy("row_id").agg(*counts, F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("strict"), F.sort_array(F.collect_list(one)).alias("every"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    listed = listed.select("row_id", *[f"n_{k}" for k in KINDS], text("strict").alias("strict"), text("every").alias("every"))
    out = rows.join(listed, "row_id", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select("doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(known("strict"), 256).alias("base_sha256"), known("every").alias("spans"))
