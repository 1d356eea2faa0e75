"""Operator 1: quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition over measures of a text. On a bounded sample, chosen by a hash of the rows and written once, each
rule's cost (seconds to evaluate it alone with the measures that it needs, above those of reading the texts) and its
selectivity (share of rows that it rejects) are measured, and the rules are ordered by rejection per cost. A row is tested
in that order inside one nested conditional expression: a later rule, and a measure that only it needs, is evaluated only
where all earlier ones passed. The order changes the work and the name of the first failed rule, never the verdict.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import drop, stored

#: Fixed values of the contract: white space between words, and the symbol characters.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
#: Words in a window that counts as a repeat when it comes again in the text.
WINDOW = 5
#: Rows of the sample on which the rules are measured, at most, and how often each is timed.
SAMPLE_ROWS, ROUNDS = 2_000, 3

Measures = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """Rejects a row where ``reject`` of its measures is true."""

    name: str
    reject: Callable[[Measures], Column]


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    """Characters in words."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def n_symbols(text: Column) -> Column:
    """Symbol characters."""
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))


def n_upper(text: Column) -> Column:
    """Letters A to Z."""
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return F.size(lines) - F.size(F.array_distinct(lines))


def grams(w: Column) -> Column:
    """The hash of each window of words: equal windows have equal hashes."""
    at = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    return F.when(F.size(w) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(WINDOW)))))


def n_repeat_words(w: Column, hashes: Column) -> Column:
    """Words in windows that come twice or more, the first included. Where no two hashes are equal there are none; else
    the windows themselves are sorted, so that only equal words count."""
    at = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    rows = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))

    def twice(rows: Column) -> Column:
        near = F.transform(rows, lambda x, k: F.when((F.get(rows, k - 1)["g"] == x["g"]) | (F.get(rows, k + 1)["g"] == x["g"]), x["i"]))
        starts = F.array_sort(F.filter(near, lambda x: x.isNotNull()))
        return F.transform(F.array(starts), lambda s: F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")))["n"])[0]

    # The one-element array binds the sorted windows to a name, so that they are made once.
    heavy = F.transform(F.array(rows), twice)[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), heavy).otherwise(0)


def measures(text: Column, w: Column, hashes: Column) -> dict[str, Column]:
    """What rules may ask of a text, of its words and of the hashes of its windows of words."""
    found = {"n_words": F.size(w), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(w, hashes), "n_upper": n_upper(text)}
    return {k: x.cast("long") for k, x in found.items()}


#: Measures that the contract returns for every row, whatever the rules need.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame) -> DataFrame:
    """doc_id and text, and of each text the measures that are returned, long.

    A null text has no words and counts as empty; so does an empty one: all measures are 0.
    """
    out = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.select("doc_id", "text", words(F.col("text")).alias("_w"))
    out = out.select("doc_id", "text", "_w", grams(F.col("_w")).alias("_g"))
    found = measures(F.col("text"), F.col("_w"), F.col("_g"))
    return out.select("doc_id", "text", *(found[k].alias(k) for k in RETURNED))


def base_failed() -> Column:
    """The contract's base verdict over the measures."""
    n = F.col("n_words")
    return (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)


def rules() -> list[Rule]:
    """The rules beyond the base: shares of symbols, of capitals and of repeated lines, and the length of words."""
    return [
        Rule("symbols", lambda m: 100 * m["n_symbols"] > 8 * m["word_chars"]),
        Rule("capitals", lambda m: 100 * m["n_upper"] > 50 * m["word_chars"]),
        Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 3 * m["n_words"]),
        Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    ]


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """So many rows (doc_id, text) at most, those that hash lowest; a share by hash is taken first, so that few are sorted."""
    share = min(1.0, 2 * rows / max(1, df.count()))
    mark = F.xxhash64("doc_id", "text")
    return df.where(F.pmod(mark, F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).orderBy(mark).limit(rows)


def order_rules(sample: DataFrame, candidates: list[Rule], rounds: int = ROUNDS) -> list[tuple[Rule, float, float]]:
    """The rules with their seconds and rejected share on ``sample`` (text), best rejection per second first. A rule's
    seconds are the median of some rounds, from the texts on, less those of reading the texts alone."""
    # Words and windows are columns of their own, so that they are made once a row, and only for a rule that reads them.
    texts = sample.select(F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("text", words(F.col("text")).alias("_w"))
    texts = texts.select("text", "_w", grams(F.col("_w")).alias("_g"))
    m = measures(F.col("text"), F.col("_w"), F.col("_g"))

    def seconds(condition: Column) -> tuple[float, int]:
        took = []
        for _ in range(rounds):
            began = time.perf_counter()
            n = texts.agg(F.count_if(condition)).first()[0]
            took.append(time.perf_counter() - began)
        return statistics.median(took), n

    read, n = seconds(F.octet_length("text") >= 0)
    timed = [(r, *seconds(r.reject(m))) for r in candidates]
    out = [(r, max(took - read, 1e-4), rejected / max(1, n)) for r, took, rejected in timed]
    return sorted(out, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(ordered: list[Rule], m: Measures) -> Column:
    """Name of the first rule that rejects the row, null if none: one conditional, evaluated from left to right."""
    out = F.lit(None).cast("string")
    for r in reversed(ordered):
        out = F.when(r.reject(m), F.lit(r.name)).otherwise(out)
    return out


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``df``: doc_id, the measures, base_failed, kept and failed_rule.

    The returned measures are made for every row; what else a rule needs (n_upper) is made inside the cascade, where the
    rule is reached. Null and empty texts have no words, so they fail the base. Rows are judged alone: repeated rows and
    null keys give one row each; other columns are not read, so their names don't matter. An empty table gives an empty
    table. sample_rows: the bound of the sample that only sets the order of the rules.
    """
    extra = rules() if extra is None else extra
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sample = stored(sampled(slim, sample_rows), "quality-sample")
    ordered = [r for r, _, _ in order_rules(sample, extra)]
    drop(sample)
    own = {k: F.col(k) for k in RETURNED} | {"n_upper": n_upper(F.col("text")).cast("long")}
    out = measure(slim).withColumn("base_failed", base_failed())
    out = out.select("doc_id", *RETURNED, "base_failed", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered, own)).alias("failed_rule"))
    return out.withColumn("kept", F.col("failed_rule").isNull())
