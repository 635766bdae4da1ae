"""Weak supervision for quality: rules vote or abstain, expectation-maximisation estimates how far each
rule can be trusted, and the posterior probability of good quality decides.

All work is DataFrame and SQL functions. The votes of a row take 3 values for each rule, so the table of
vote patterns that EM runs over has at most 3^rules rows however large the corpus is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import SPACES, saved, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_odd_ends", "n_stops"]

#: Frequent function words of English, German, French and Spanish.
STOPS = ["the", "of", "and", "to", "in", "is", "that", "for", "with", "this",
         "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht",
         "le", "la", "les", "de", "des", "du", "et", "que", "un", "en",
         "el", "los", "las", "y", "del", "se", "por", "con", "para", "su"]


def found(text: Column, pattern: str) -> Column:
    """How often the pattern is in the text."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


@dataclass(frozen=True)
class Rule:
    """good, bad: SQL conditions over the measures; neither holds: the rule abstains."""

    name: str
    good: str
    bad: str


#: Rules on damage vote bad or abstain, rules on form vote either way; no rule reads a label. Each can vary among the rows that
#: pass the base test, which are the ones that it judges.
RULES = [
    Rule("line_length", "n_words >= 8 * n_lines", "n_words < 3 * n_lines"),
    Rule("function_words", "n_stops >= 3", "n_stops < 2"),
    Rule("word_length", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("clean_ends", "n_odd_ends * 50 <= n_words", "n_odd_ends * 5 > n_words"),
    Rule("symbols", "false", "n_symbols * 10 > n_words"),
    Rule("repeated_lines", "false", "n_dup_lines * 3 > n_lines"),
    Rule("repeated_words", "n_repeat_words * 20 <= n_words", "n_repeat_words * 3 > n_words"),
    Rule("capitals", "false", "n_upper * 2 > word_chars"),
    Rule("shouting", "false", "n_shouts * 10 > n_words"),
]


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) as a struct ``_row``, and the measures.

    A null or blank text measures as zeros. ``n_repeat_words``: the words in a 3-word window that the text
    holds at least twice, first ones included. Windows are hashed to longs, and only texts in which two hashes
    meet go on: theirs are sorted inside the row, by hash and then by the words themselves, and equal neighbours
    compared. So no row leaves its task, the work is n log n in the words of a text, and words decide."""
    keep = docs.columns if keep is None else keep
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size("_w")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), body.alias("_text"))
    rows = rows.select("*", words(F.col("_text")).alias("_w"),
                       F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"))
    word = lambda p: F.get("_w", p)
    rows = rows.select("*", F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda p: F.xxhash64(word(p), word(p + 1), word(p + 2)))).alias("_h"))
    windows = F.arrays_zip(F.col("_h").alias("h"), F.slice("_w", 1, n - 2).alias("a"), F.slice("_w", 2, n - 2).alias("b"), F.slice("_w", 3, n - 2).alias("c"),
                           F.sequence(F.lit(0), n - 3).alias("p"))
    rows = rows.select("_row", "_text", "_w", "_l", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(windows)).alias("_o"))
    pairs = F.arrays_zip(F.slice("_o", 1, n - 3).alias("x"), F.slice("_o", 2, n - 3).alias("y"))
    same = F.filter(pairs, lambda r: (r["x"]["h"] == r["y"]["h"]) & (r["x"]["a"] == r["y"]["a"]) & (r["x"]["b"] == r["y"]["b"]) & (r["x"]["c"] == r["y"]["c"]))
    rows = rows.select("_row", "_text", "_w", "_l", F.transform(same, lambda r: F.array(r["x"]["p"], r["y"]["p"])).alias("_s"))
    spots = F.array_distinct(F.flatten("_s"))
    rows = rows.select("_row", "_text", "_w", "_l", spots.alias("_s"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_s", lambda p: F.array(p, p + 1, p + 2)))))
    named = {
        "n_words": n, "word_chars": F.length(F.array_join("_w", "")), "n_symbols": found(F.col("_text"), r"[#*$%&|<>]"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")), "n_repeat_words": F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0)),
        "n_lines": F.size("_l"), "n_upper": F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", "")),
        "n_shouts": found(F.col("_text"), "!"), "n_odd_ends": found(F.col("_text"), r"[^\p{L}\p{N}.,;:?)\"'\x20\x09-\x0D](?=[\x20\x09-\x0D]|$)"),
        "n_stops": F.size(F.array_intersect(F.col("_w"), F.array(*[F.lit(x) for x in STOPS])))}
    return rows.select("_row", *[named[m].cast("long").alias(m) for m in MEASURES])


def vote(rule: Rule) -> Column:
    """1 good, -1 bad, 0 abstains."""
    return F.expr(f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END").cast("int")


#: Start of EM: what a rule says of good and of bad rows. Rules are taken to be mostly right.
START = {"good": {-1: 0.02, 0: 0.3, 1: 0.68}, "bad": {-1: 0.5, 0: 0.3, 1: 0.2}}


def posterior(model: dict, rules: list[Rule]) -> Column:
    """P(good | votes) over the columns v_<rule>: the prior odds times each vote's likelihood ratio."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r in rules:
        good, bad = model["votes"][r.name]["good"], model["votes"][r.name]["bad"]
        v, w = F.col(f"v_{r.name}"), {x: math.log(good[x] / bad[x]) for x in good}
        odds = odds + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def accuracy(model: dict, rule: str) -> float:
    """The chance that the rule's vote is right, given that it votes."""
    p, v = model["prior"], model["votes"][rule]
    right, wrong = p * v["good"][1] + (1 - p) * v["bad"][-1], p * v["good"][-1] + (1 - p) * v["bad"][1]
    return right / (right + wrong)


def estimate(patterns: DataFrame, rules: list[Rule], rounds: int = 25, tolerance: float = 1e-6) -> dict:
    """EM over the table (v_<rule>..., n) of vote patterns: the share of good rows and, for either kind of
    row, how often each rule votes good, bad or abstains (so also its accuracy).

    E: the posterior of each pattern. M: expected shares, with half a row added to each. Each round is one
    aggregation that returns one row of 2 + 6 x rules numbers. An empty table keeps the start values."""
    model = {"prior": 0.8, "votes": {r.name: START for r in rules}}
    for _ in range(rounds):
        p, n = posterior(model, rules), F.col("n")
        sums = [F.sum(n * p).alias("good"), F.sum(n).alias("rows")]
        for r in rules:
            for x in (-1, 0, 1):
                hit = F.when(F.col(f"v_{r.name}") == x, n).otherwise(0)
                sums += [F.sum(hit * p).alias(f"good_{r.name}_{x}"), F.sum(hit * (1 - p)).alias(f"bad_{r.name}_{x}")]
        row = patterns.agg(*sums).first()
        if not row["rows"]:
            break
        of = {"good": row["good"], "bad": row["rows"] - row["good"]}
        new = {"prior": (of["good"] + 1) / (row["rows"] + 2), "votes": {
            r.name: {k: {x: (row[f"{k}_{r.name}_{x}"] + 0.5) / (of[k] + 1.5) for x in (-1, 0, 1)} for k in of} for r in rules}}
        moved = max(abs(new["votes"][r.name][k][x] - model["votes"][r.name][k][x]) for r in rules for k in of for x in (-1, 0, 1))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """``_row`` (struct of the columns ``keep``), the measures, a vote ``v_<rule>`` of each rule, ``p_good``,
    ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated windows. ``kept``: not that,
    and p_good >= threshold; EM learns from the rows that do not fail. Null and blank texts fail; repeated rows
    are judged alike; very long texts are measured whole; an empty table gives an empty result. No column name
    of ``docs`` can clash because they stay inside ``_row``. The measures are taken once and written to the
    shared folder; EM and the verdicts read them there."""
    rules = RULES if rules is None else rules
    flat = measured(docs, text, keep)
    flat = saved(flat.select("*", *[vote(r).alias(f"v_{r.name}") for r in rules]), "measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    patterns = flat.where(~failed).groupBy(*[f"v_{r.name}" for r in rules]).agg(F.count(F.lit(1)).alias("n"))
    model = estimate(saved(patterns, "patterns"), rules)
    out = flat.withColumn("p_good", posterior(model, rules)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return judge(docs, text).where("kept").select("_row.*")
