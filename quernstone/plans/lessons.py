"""Synthetic lessons: templates times values, repetitions, and their pairing with base rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions.text import persian_digits
from quernstone.operators import matching, selection


def number_lessons(values: DataFrame, a: str, b: str, templates: list[tuple[str, str]]) -> DataFrame:
    """For each row of values and each (input, output) template: the two numbers filled in, in Persian digits on both sides."""
    fill = lambda t: F.replace(F.replace(t, F.lit("{a}"), persian_digits(F.col(a).cast("string"))), F.lit("{b}"), persian_digits(F.col(b).cast("string")))
    rows = values.withColumn("t", F.explode(F.array(*(F.struct(F.lit(i).alias("template"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(templates)))))
    return rows.select(*values.columns, "t.template", fill(F.col("t.x")).alias("input"), fill(F.col("t.y")).alias("output"))


def repetition_lessons(tokens: DataFrame, token: str, most: int) -> DataFrame:
    """Each token one to ``most`` times in a row; the output keeps all of them."""
    rows = tokens.withColumn("times", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return rows.withColumn("input", F.array_join(F.array_repeat(F.col(token), F.col("times")), " "))


def mixed_in(lessons: DataFrame, base: DataFrame, key: str, before: Column, seed: int = 7) -> DataFrame:
    """Each lesson inserted into the middle of one base row's text, chosen by hash."""
    from quernstone.functions.guards import inject

    both = matching.paired_by_hash(lessons, base, key, seed)
    return both.withColumn("mixed", inject(before, F.col("input"), 0.5))


def seeded_sample(rows: DataFrame, key: Column, n: int, seed: int = 7) -> DataFrame:
    """A repeatable sample without replacement: the n rows of least hash."""
    return rows.orderBy(selection.seeded_order(key, seed), key).limit(n)
