"""Deterministic repair of Persian text, each function a Column expression.

Lengths count code points. Digits of the Arabic layout become Persian digits. Verbal prefixes are joined only at a word's
start by default; ``compat=True`` joins them inside words too, as the loose rule does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicon as lx
from .chars import ARABIC_DIGITS, ASCII_DIGITS, PERSIAN, PERSIAN_DIGITS, PERSIAN_OR_ZWNJ, SPACE, ZWNJ, bind, replace, replace_with, trim

#: Letters of the Arabic layout and what replaces them; marks and invisible characters that go.
ARABIC_LETTERS, PERSIAN_LETTERS = "أإيكة", "اایکه"
MARKS = "".join(map(chr, range(0x064B, 0x0653))) + "ٰ" + "ـ" + "​‎‏"
#: Present stems and endings of everyday verbs.
STEMS = ["خواه", "رو", "شو", "کن", "ده", "دان", "گوی", "گیر", "آ", "آور", "توان", "خور", "بین", "رس", "خواب", "نشین", "فهم", "زن", "انداز", "پرس", "نویس", "خوان", "گذار", "شمار", "خند", "تاب", "بند", "شکن"]
ENDINGS = ["م", "ی", "د", "یم", "ید", "ند"]
SENTENCE_GAP = r"(?<=[.!؟…]) +"


def fold_chars(text: Column) -> Column:
    """Arabic-layout letters and digits to Persian ones; marks, tatweel and invisible characters deleted."""
    return F.translate(text, ARABIC_LETTERS + ARABIC_DIGITS + MARKS, PERSIAN_LETTERS + PERSIAN_DIGITS)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def persian_digits(text: Column) -> Column:
    return F.translate(text, ASCII_DIGITS, PERSIAN_DIGITS)


def join_half_spaces(text: Column, compat: bool = False) -> Column:
    """Half-space repair: stray ones collapse; verbal prefixes and plural or comparative suffixes are joined by one."""
    start = "" if compat else r"(?<![\p{L}\x{200C}])"
    forms = "|".join(sorted((s + e for s in STEMS for e in ENDINGS), key=len, reverse=True))
    t = replace_with(text, (ZWNJ * 2,), r"\x{200C}{2,}", ZWNJ)
    t = replace_with(t, (f"{ZWNJ} ",), r"\x{200C} +", " ")
    t = replace_with(t, (f" {ZWNJ}",), rf" +\x{{200C}}(?={PERSIAN})", " ")
    t = replace_with(t, ("می",), rf"(?=ن?می){start}(می|نمی) ?({forms})(?![\p{{L}}\x{{200C}}])", rf"$1{ZWNJ}$2")
    t = replace_with(t, ("می ",), rf"(?=ن?می ){start}(می|نمی) +(?![وکه])(?=\p{{L}})", rf"$1{ZWNJ}")
    # A run of letters is tried from its start, or from where the last match ended, not from each of its letters.
    return replace_with(t, (" ها", " تر"), rf"(?:(?<!{PERSIAN})|\G)({PERSIAN}++) (ها|های|تر|ترین)(?=[.،؛؟!…]|{SPACE}|\z)", rf"$1{ZWNJ}$2")


def fix_punctuation(text: Column) -> Column:
    """Ellipses, doubled marks, Latin marks after Persian, and straight quotes around Persian."""
    t = replace_with(text, ("...",), r"\.{3,}", "…")
    for mark in "…؟!،":
        t = replace_with(t, (mark * 2,), f"{mark}{{2,}}", mark)
    t = replace_with(t, ("?",), rf"({PERSIAN}){SPACE}*\?", "$1؟")
    t = replace_with(t, (";",), rf"({PERSIAN}){SPACE}*;", "$1؛")
    t = replace_with(t, (",",), rf"({PERSIAN}),", "$1،")
    for q in ("\"", "'"):
        t = replace_with(t, (q,), rf"{q}([^{q}\n]*{PERSIAN}[^{q}\n]*){q}", "«$1»")
    return t


def fix_spacing(text: Column) -> Column:
    """No space before marks and one after, but none inside decimals; guillemets hug; runs collapse; trimmed."""
    t = replace_with(text, tuple(f" {mark}" for mark in "،؛؟!…"), r" +([،؛؟!…])", "$1")
    t = replace_with(t, (" .",), r" +\.", ".")
    t = replace(t, rf"([،؛؟!.…])(?={PERSIAN})(?![۰-۹٠-٩])", "$1 ")
    t = replace_with(t, ("« ",), "« +", "«")
    t = replace_with(t, (" »",), " +»", "»")
    return trim(replace_with(t, ("  ", "\t"), r"[ \t]{2,}", " "))


def replace_words(text: Column, entries: lx.Lexicon) -> Column:
    """Whole words, one pass for each entry, longest key first, so later passes see what earlier ones wrote."""
    return lx.replacing({"": entries})(text, F.lit(""))["text"]


def replaced_words(text: Column, entries: lx.Lexicon) -> Column:
    """How many replacements replace_words makes; an entry whose value is its key counts too."""
    return lx.replacing({"": entries})(text, F.lit(""))["n"]


def count_persian_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"{PERSIAN}{PERSIAN_OR_ZWNJ}*"))


def has_persian(text: Column) -> Column:
    return text.rlike(PERSIAN_OR_ZWNJ)


def lacks_final_mark(text: Column) -> Column:
    return (F.length(text) > 0) & ~F.substring(text, -1, 1).isin(*".!؟…»\"'")


def final_mark(text: Column) -> Column:
    return F.when(lacks_final_mark(text), F.concat(text, F.lit("."))).otherwise(text)


#: Words after which a sentence needs no connector, and openers without a place in formal text.
CONNECTED = "امّا|اما|ولی|بنابراین|هم‌چنین|از این‌رو|از این رو|لیکن|پس|و|گویی|چون|خب|بابا|واقعاً|واقعا|بازم|فرموده|مقتضی است|خواهشمند است|به استحضار می‌رساند|بدین‌سان|به‌طور کلی|لطفا|لطفاً|خواهش|ممنون|خواهشمندم"
INTERJECTIONS = "ای بابا|آخه|بابا|وای|خب|عجب|بیخیال"


def weave_connectors(text: Column, connectors: list[str]) -> Column:
    """At most two connectors, into plain sentences of three words or more that don't open with one; never the first."""
    if not connectors:
        return text
    words = F.array(*map(F.lit, connectors))

    def plain(sentence: Column) -> Column:
        return bind(trim(sentence), lambda x: (F.length(x) > 0) & ~x.rlike(rf"\A({CONNECTED})(?!{PERSIAN_OR_ZWNJ})") & ~x.rlike(r"[؟!…]\z") & (F.size(F.split(x, rf"{SPACE}+")) >= 3))

    def woven(s: Column) -> Column:
        chosen = F.slice(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: plain(F.get(s, i))), 1, F.least(F.lit(2), F.size(s) - 2))
        said = lambda c, x, i: F.concat(F.lit(" "), F.get(words, ((F.array_position(c, i) - 1) % len(connectors)).cast("int")), F.lit("، "), trim(x))
        return bind(chosen, lambda c: F.array_join(F.transform(s, lambda x, i: F.when(F.array_contains(c, i), said(c, x, i)).otherwise(x)), " "))

    return bind(F.split(text, SENTENCE_GAP), lambda s: F.when(F.size(s) < 3, text).otherwise(woven(s)))


def strip_interjections(text: Column) -> Column:
    """Sentences lose an opening interjection; those without Persian go."""
    s = F.transform(F.split(text, SENTENCE_GAP), lambda x: replace(x, rf"\A({INTERJECTIONS})[،,]?{SPACE}*", ""))
    return F.array_join(F.filter(s, lambda x: x.rlike(PERSIAN)), " ")


def wrap(text: Column, opener: str | None, closer: str | None) -> Column:
    """Opener and closer, each only where the text doesn't have it yet."""
    t = text
    if opener:
        t = F.when(t.startswith(opener), t).otherwise(F.concat(F.lit(f"{opener}؛ "), t))
    if closer:
        closed = F.concat(F.when(lacks_final_mark(t), final_mark(t)).otherwise(trim(t)), F.lit(f" {closer}."))
        t = F.when(t.endswith(closer), t).otherwise(closed)
    return t


def word_changes(before: Column, after: Column, most: int | None = None) -> Column:
    """Positions at which the words of two texts differ, over the longer one."""
    a, b = F.split(before, rf"{SPACE}+"), F.split(after, rf"{SPACE}+")
    n = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return F.least(n, F.lit(most)) if most is not None else n


def new_words(before: Column, after: Column) -> Column:
    """For each word of after, whether before lacks it; marks at its place don't count."""
    bare = lambda x: replace(x, "[.,!؟،؛]", "")
    known = F.array_distinct(F.transform(F.split(before, rf"{SPACE}+"), bare))
    return bind(known, lambda k: F.transform(F.split(after, rf"{SPACE}+"), lambda x: F.struct(x.alias("word"), (~F.array_contains(k, bare(x))).alias("is_new"))))


NOTES = {
    "none": "no Persian text found",
    "half_space": "half-spaces repaired",
    "punctuation": "punctuation repaired",
    "interjections": "opening interjections removed",
    "words": "words replaced",
    "connectors": "sentences connected",
    "final": "final mark added",
    "clean": "already clean",
}


FORMAL_REGISTERS = ("formal", "academic", "admin")


def with_edit(rows: DataFrame, text: str, register: Column, lexicons: dict[str, lx.Lexicon], lexicon: Column, weave=None, frame=None, compat: bool = False) -> DataFrame:
    """Adds edited = struct(output, changed, notes): the whole rule-based edit of a text for its register.

    ``lexicon`` names the row's lexicon; ``weave`` and ``frame`` are functions of a text, for connectors and for opener and
    closer. Each stage is a column of its own, so that none is computed twice, and the register is data: the plan has the
    same size for one mode as for all.
    """
    entries = lx.replacing({k: lx.with_joined_prefixes(v) for k, v in lexicons.items()})
    c = F.col
    t = rows.withColumns({"_register": register, "_lexicon": lexicon}).withColumn("_folded", fold_chars(c(text)))
    t = t.withColumn("_joined", join_half_spaces(c("_folded"), compat)).withColumn("_marked", fix_punctuation(c("_joined")))
    t = t.withColumn("_stripped", F.when(c("_register").isin(*FORMAL_REGISTERS), strip_interjections(c("_marked"))).otherwise(c("_marked")))
    t = t.withColumn("_said", entries(c("_stripped"), c("_lexicon")))
    t = t.withColumn("_woven", weave(c("_said")["text"]) if weave else c("_said")["text"])
    t = t.withColumn("_spaced", fix_spacing(join_half_spaces(frame(c("_woven")) if frame else c("_woven"), compat)))
    t = t.withColumn("_ended", final_mark(c("_spaced")))
    notes = F.filter(
        F.array(
            F.when(c("_joined") != c("_folded"), NOTES["half_space"]),
            F.when(c("_marked") != c("_joined"), NOTES["punctuation"]),
            F.when(c("_stripped") != c("_marked"), NOTES["interjections"]),
            F.when(c("_said")["n"] > 0, NOTES["words"]),
            F.when(c("_woven") != c("_said")["text"], NOTES["connectors"]),
            F.when(lacks_final_mark(c("_spaced")), NOTES["final"]),
        ),
        lambda n: n.isNotNull(),
    )
    t = t.withColumn("_notes", notes)
    changed = F.when(c(text) == c("_ended"), 0).otherwise(word_changes(c(text), c("_ended"), 999))
    done = {"output": c("_ended"), "changed": changed, "notes": F.when(F.size("_notes") == 0, F.array(F.lit(NOTES["clean"]))).otherwise(c("_notes"))}
    none = {"output": trim(c("_folded")), "changed": F.lit(0), "notes": F.array(F.lit(NOTES["none"]))}
    # A choice for each field, so that a query which takes one of them computes no other.
    return t.select(*rows.columns, F.struct(*(F.when(has_persian(c("_folded")), done[k]).otherwise(none[k]).alias(k) for k in done)).alias("edited"))


def polish_quick(text: Column) -> Column:
    """The small keyboard variant: three letters folded, prefixes and suffixes joined at word boundaries, no space before marks, one after, and a final stop.

    A text that already ends with a mark isn't trimmed.
    """
    word = r"[\p{L}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]"
    t = replace(F.translate(text, "يك", "یک"), "ۀ", f"ه{ZWNJ}ی")
    t = replace_with(t, ("می ",), rf"(?=ن?می )(?<!{word})(می|نمی) ", rf"$1{ZWNJ}")
    t = replace_with(t, (" ها", " تر"), rf" (ها|های|تر|ترین)(?!{word})", rf"{ZWNJ}$1")
    t = replace_with(t, tuple(f" {mark}" for mark in "،؛:!؟."), r" +([،؛:!؟.])", "$1")
    t = replace(t, r"([،؛:!؟])([^ \n])", "$1 $2")
    ended = lambda t, x: F.when((F.length(x) > 0) & ~F.substring(x, -1, 1).isin(*".!؟:"), F.concat(x, F.lit("."))).otherwise(t)
    return bind(t, lambda t: bind(trim(t), lambda x: ended(t, x)))


def version_parts(version: Column) -> Column:
    return F.transform(F.split(replace(version, r"\A[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"\A(\d+)", 1).try_cast("int"), F.lit(0)))


def is_newer(version: Column, than: Column) -> Column:
    """Part by part; a missing part counts 0."""
    pairs = F.filter(F.zip_with(version_parts(version), version_parts(than), lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))), lambda d: d != 0)
    return F.coalesce(F.get(pairs, 0) > 0, F.lit(False))


def title(text: Column, fallback: str = "بدون عنوان", length: int = 32) -> Column:
    t = trim(replace(text, rf"{SPACE}+", " "))
    return F.when(F.length(t) == 0, fallback).when(F.length(t) > length, F.concat(F.substring(t, 1, length), F.lit("…"))).otherwise(t)
