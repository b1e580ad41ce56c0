"""Offline edits of tables of texts: the mode's register, lexicon, connectors, opener and closer are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions import lexicon as lx, text as t
from quernstone.plans.modes import DEFAULT_MODE, MODES


def edit_table(texts: DataFrame, settings: dict[str, dict] | None = None, modes: list[str] | None = None, compat: bool = False) -> DataFrame:
    """(.., mode, text) with edited = struct(output, changed, notes); unknown modes are edited as the default one.

    ``settings`` gives connectors, opener, closer or lexicon by mode; ``modes`` are those to be edited as such, all by default.
    """
    given = settings or {}
    registers = {m: r for m, r, _, _ in MODES if modes is None or m in modes or m == DEFAULT_MODE}
    named = lambda values: F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("mode")], F.lit(values[DEFAULT_MODE]))
    own = {m: f"mode {m}" if "lexicon" in given.get(m, {}) else r for m, r in registers.items()}
    lexicons = lx.REGISTERS | {f"mode {m}": s["lexicon"] for m, s in given.items() if "lexicon" in s}

    def by_mode(keys: tuple[str, ...], build):
        """A function of a text that takes each mode's settings where it has some; None where no mode has."""
        some = {m: given[m] for m in registers if any(given.get(m, {}).get(k) for k in keys)}
        if not some:
            return None
        mode = F.when(F.col("mode").isin(*registers), F.col("mode")).otherwise(DEFAULT_MODE)

        def chosen(text: Column) -> Column:
            chain = text
            for m, s in some.items():
                chain = F.when(mode == m, build(text, *(s.get(k) for k in keys))).otherwise(chain)
            return chain

        return chosen

    weave = by_mode(("connectors",), lambda text, c: t.weave_connectors(text, list(c)))
    return t.with_edit(texts, "text", named(registers), {n: lexicons[n] for n in own.values()}, named(own), weave, by_mode(("opener", "closer"), t.wrap), compat)
