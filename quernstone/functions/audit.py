"""Measures of audits: normalisation, tokens, overlap, repetition, ratios, traps, hashes.

Profiles differ in stop words, stemming, least lengths and the measure of overlap; they are parameters.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .chars import ARABIC_EXTENDED, SPACE, bind, replace, replace_with, trim
from .guards import ECHO, NUMBER, foreign_letter, repeated_fragment
from .text import ascii_digits


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def audit_normal(text: Column) -> Column:
    t = F.translate(nfkc(text), "يىكۀ‌‍", "ییکه")
    return trim(replace(t, rf"[^{ARABIC_EXTENDED}\p{{N}}]+", " "))


@dataclass(frozen=True)
class Profile:
    """How a profile cuts texts into tokens and measures their overlap."""

    script: str = ARABIC_EXTENDED
    least: int = 2
    stop: tuple[str, ...] = ()
    #: Suffixes of the later profiles.
    suffixes: tuple[str, ...] = ("ها", "های", "هایی", "تر", "ترین", "ام", "ات", "اش", "مان", "تان", "شان")
    contained_from: int = 4
    over_smaller: bool = True  # matched over the smaller set, 1 if either is empty; or over the first, 1 if it is empty
    weak_below: float = 0.14
    fields: dict = field(default_factory=dict, hash=False)


#: Stop words of the gate's profile, and what the longer one adds.
STOP = tuple("از به در با را که و یا این آن یک برای تا اما اگر چون روی زیر بعد قبل خود شده شود کرد کرده می ما من تو او شما آنها ایشان است بود هست نیست چه فقط هم هر خیلی باید شاید درباره مورد متن".split())
#: Stop words of the first audit.
STOP_FIRST = tuple("این آن اون یک یه برای از به با در روی زیر تا که و یا اما ولی اگر اگه چون هم را رو من ما تو شما او ایشان خود خودم خودش همه هر هیچ خیلی فقط هنوز دیگر دوباره امروز فردا دیروز حالا بعد قبل وقت شد شده بود بوده است هست نیست شود کرد کرده کنم کنید کنه میخوام میخواهم باید میشه میشود میتوان لطفا خواهشمند درخواست اطلاع استحضار".split())
PROFILES = {
    "gate": Profile(stop=STOP),
    "v4": Profile(),
    "v3": Profile(least=3, stop=(*STOP, "پیام", "موضوع"), contained_from=5, over_smaller=False, weak_below=0.16),
}


def tokens(text: Column, profile: Profile) -> Column:
    """Distinct runs of the profile's script, folded, without a suffix, of its least length, without its stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"([{profile.script}]{{{profile.least},}})"), 1)
    folded = F.transform(runs, lambda t: F.translate(t, "يىك", "ییک"))
    if profile.suffixes:
        folded = F.transform(folded, lambda t: replace(t, rf"({'|'.join(profile.suffixes)})\z", ""))
    kept = F.filter(folded, lambda t: (F.length(t) >= profile.least) & (~t.isin(*profile.stop) if profile.stop else F.lit(True)))
    return F.array_distinct(kept)


#: Suffixes in the order in which the first audit tries them.
STEM_SUFFIXES = ("ترین", "هایی", "های", "ها", "شان", "مان", "تان", "ان", "ات", "تر")


def stem(token: Column, suffixes: tuple[str, ...] = STEM_SUFFIXES) -> Column:
    """Without a verbal prefix, and without the first suffix in order that leaves more than three letters."""

    def cut(t: Column) -> Column:
        chain = F.when(F.lit(False), t)
        for s in suffixes:
            chain = chain.when(t.endswith(s) & (F.length(t) > len(s) + 3), F.substring(t, F.lit(1), F.length(t) - len(s)))
        return chain.otherwise(t)

    return bind(replace_with(token, ("می",), r"\A(ن?می)", ""), cut)


def audit_tokens(text: Column, stop: tuple[str, ...] = STOP_FIRST) -> Column:
    words = F.filter(F.split(audit_normal(text), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*stop))
    return F.array_distinct(F.filter(F.transform(words, lambda t: stem(t)), lambda t: F.length(t) >= 3))


#: Comparisons of two tokens that are made directly; beyond, grams say which tokens to compare.
FEW = 400


def matched_of(a: list[str], b: list[str], least: int) -> int:
    """How many of a's tokens equal one of b's, or contain one or lie in one, both of the least length or more.

    A token that contains another holds that one's first ``least`` characters as a gram, so grams and beginnings say which
    tokens can; only those are compared.
    """
    known = set(b)
    rest = [x for x in a if x not in known and len(x) >= least]
    if len(rest) * len(known) <= FEW:
        long = [y for y in known if len(y) >= least] if rest else []
        return sum(x in known for x in a) + sum(any(x in y or y in x for y in long) for x in rest)
    grams: dict[str, list[str]] = {}
    begins: dict[str, list[str]] = {}
    for y in known:
        if len(y) >= least:
            begins.setdefault(y[:least], []).append(y)
            for g in {y[i : i + least] for i in range(len(y) - least + 1)}:
                grams.setdefault(g, []).append(y)

    def contained(x: str) -> bool:
        return any(x in y for y in grams.get(x[:least], ())) or any(y in x for i in range(len(x) - least + 1) for y in begins.get(x[i : i + least], ()))

    return sum(x in known for x in a) + sum(map(contained, rest))


def matched_tokens(a: Column, b: Column, least: int) -> Column:
    """struct(matched, a, b): matched_of by batches, null where either is null, and the numbers of tokens, so that these aren't cut again."""
    n = lambda x: None if x is None else len(x)

    @F.pandas_udf("matched int, a int, b int")
    def matched(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [(None if x is None or y is None else matched_of(list(x), list(y), least), n(x), n(y)) for x, y in zip(left, right)]
        return pd.DataFrame(rows, columns=["matched", "a", "b"], dtype="Int32")

    return matched(a, b)


def overlap_of(a: Column, b: Column, contained_from: int, over_smaller: bool) -> Column:
    """Share of a's tokens that equal one of b's, or contain one or lie in one, both of the given length or more."""
    found = matched_tokens(a, b, contained_from)
    if over_smaller:
        return F.when((found["a"] == 0) | (found["b"] == 0), 1.0).otherwise(found["matched"] / F.least(found["a"], found["b"]))
    return F.when(found["a"] == 0, 1.0).otherwise(found["matched"] / found["a"])


def overlap(before: Column, output: Column, profile: Profile) -> Column:
    return overlap_of(tokens(before, profile), tokens(output, profile), profile.contained_from, profile.over_smaller)


def with_audit_overlap(rows: DataFrame, before: str, output: str, name: str = "overlap") -> DataFrame:
    """Adds the first audit's overlap: its own tokens, over the input's, parts of words from five places on.

    Tokens are columns of their own, since a function over them can't hold the Python function that composes them.
    """
    cut = rows.withColumns({"_a": audit_tokens(F.col(before)), "_b": audit_tokens(F.col(output))})
    return cut.withColumn(name, overlap_of(F.col("_a"), F.col("_b"), 5, False)).drop("_a", "_b")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"(?<=[.!؟!]){SPACE}+"), trim), lambda s: F.length(s) > 0)


def repeated_sentence(text: Column) -> Column:
    s = F.filter(F.transform(F.split(text, r"[.!؟؛\n]+"), trim), lambda s: F.length(s) > 0)
    return F.size(F.array_distinct(s)) < F.size(s)


def repeated_line(text: Column, least: int = 12) -> Column:
    s = F.filter(F.transform(F.split(text, "\n"), trim), lambda s: F.length(s) >= least)
    return F.size(F.array_distinct(s)) < F.size(s)


def length_ratio(before: Column, output: Column) -> Column:
    return F.length(output) / F.greatest(F.lit(1), F.length(before))


#: Fixed value: words and beginnings that negate, sought in normalised text.
NEGATION = r"(^|\s)(نه|هیچ|نیست|نبود|نشد|نشده|ندار|نخواه|نمی|نتوان|فاقد|عدم|بدون|بیرون|بی‌آنکه|بی‌هیچ|نرسید|نکرد|نرفت|نگرفت|نماند|نیامد|نداد|نگفت|نپذیرفت|نخواند|نپرسید|نچرخید|نزد|ناقص|ناموفق|نامناسب|محدود|متوقف|لغو|رد|حذف|کسر|اختلال|معیوب|خطا|اشتباه|بسته|تمام|منقضی|بازماند|دریغ|خالی|سکوت|سرگردان|بپرهیز|خودداری|صرفاً|تنها|اولویت)"


def negation_lost(before: Column, output: Column, pattern: str = NEGATION) -> Column:
    return audit_normal(before).rlike(pattern) & ~audit_normal(output).rlike(pattern)


#: Colloquial tokens that don't belong in formal registers, and these.
COLLOQUIAL = r"می‌خوام|نمی‌خوام|می‌تون|نمی‌تون|اگه|واسه|(^|\s)یه\s|خونه|بگید|کنسل|اوکی|(^|\s)رو(\s|$)"
FORMAL_MODES = ("rasmi", "daneshgahi", "edari")


def colloquial_in_formal(mode: Column, output: Column) -> Column:
    return mode.isin(*FORMAL_MODES) & output.rlike(COLLOQUIAL)


def coverage(before: Column, output: Column, least: float = 0.45, most: float = 2.4) -> Column:
    """Which bound of the lengths' ratio an output breaks, or an empty string."""
    return F.when(F.length(output) < F.length(before) * least, "short").when(F.length(output) > F.length(before) * most, "long").otherwise("")


def sentence_bounds(before: Column, output: Column) -> Column:
    """array: 'long-input' for an input outside 3 to 8 sentences, 'coverage' for an output under three."""
    n = lambda x: F.size(sentences(x))
    return F.filter(F.array(F.when(~n(before).between(3, 8), "long-input"), F.when(n(output) < 3, "coverage")), lambda x: x.isNotNull())


#: What makes an input a trap.
TRAPS = {"meta": r"\Aاین چند جمله رو", "mixed_script": "[A-Za-z]", "ambiguous": "همون قبلی", "refusal": "نمی‌تونم مسئولیت", "nested": "می‌خوام اول .* بعد .*؛ اگر"}


def trap_counts(rows: DataFrame, by: str, before: Column, least: int = 20) -> DataFrame:
    """(by, trap, n, too_few): inputs of each kind of trap in each group."""
    counts = rows.groupBy(by).agg(*(F.count_if(before.rlike(p)).alias(k) for k, p in TRAPS.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("trap"), F.col(k).alias("n")) for k in TRAPS))).alias("t")
    return counts.select(by, each).select(by, "t.trap", "t.n", (F.col("t.n") < least).alias("too_few"))


def marked(output: Column, marker: Column, poetry: Column) -> Column:
    """The register's marker occurs; poetry may show by its form instead: more lines than one, or two marks in a line."""
    return F.coalesce(output.rlike(marker) if isinstance(marker, str) else F.regexp_like(output, marker), F.lit(False)) | (poetry & (F.contains(output, F.lit("\n")) | output.rlike("[؛،].*[؛،]")))


def voiced(mode: Column, output: Column, markers: dict[str, str], poetic: tuple[str, ...] = ()) -> Column:
    """Whether an output shows its mode's marker, by one profile's table of patterns; false for modes without one."""
    chain = F.lit(False)
    for m, pattern in markers.items():
        chain = F.when(mode == m, marked(output, pattern, F.lit(m in poetic))).otherwise(chain)
    return chain


OFFSET, PRIME = 2166136261, 16777619
#: Code points that are hashed together: 32 MB of codes.
HASHED_CHARS = 1 << 22


def fnv1a_of(texts: list[str | None]) -> np.ndarray:
    """FNV-1a of 32 bits over the code points of each text, one position of many texts at a time; a null text's place holds the empty text's.

    Texts are taken by blocks of HASHED_CHARS code points or one text, so memory doesn't follow how long a batch's texts are.
    """
    out, start, size = [np.zeros(0, dtype=np.int64)], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > HASHED_CHARS:
            out.append(_fnv1a_block(texts[start:i]))
            start, size = i, 0
        size += len(t or "")
    return np.concatenate([*out, _fnv1a_block(texts[start:])])


def _fnv1a_block(texts: list[str | None]) -> np.ndarray:
    encoded = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(e) // 4 for e in encoded], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else lengths
    codes, starts, longest = np.frombuffer(b"".join(encoded), dtype="<u4"), starts[order], lengths[order]
    del encoded
    h = np.full(len(texts), OFFSET, dtype=np.uint64)
    prime, mask, at = np.uint64(PRIME), np.uint64(0xFFFFFFFF), 0
    active = np.searchsorted(-longest, 0)  # texts longer than ``at``
    while active >= 8:
        h[:active] = ((h[:active] ^ codes[starts[:active] + at]) * prime) & mask
        at += 1
        active = np.searchsorted(-longest, -at)
    for i in range(active):  # the few longest on their own
        x = int(h[i])
        for c in codes[starts[i] + at : starts[i] + longest[i]].tolist():
            x = (x ^ c) * PRIME & 0xFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of 32 bits over code points; Spark has no function for it, and an expression for each character is slow."""
    return pd.Series(fnv1a_of(text.tolist()), index=text.index, dtype="Int64").mask(text.isna())


def stable_hash(key: Column, text: Column) -> Column:
    return fnv1a(F.concat(key, F.char(F.lit(0)), text))


def record_digest(mode: Column, before: Column, output: Column, system: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(c, F.lit("")) for c in (mode, before, output, system))), 256)


def gate_issues(before: Column, teacher: Column, output: Column, mode: Column, voiced: Column, profile: Profile, least: int = 12, fragments: bool = True) -> Column:
    """array of struct(category, detail, severity): every issue of an evaluated output."""
    letter = foreign_letter(output, profile.script)
    anchor = F.greatest(overlap(before, output, profile), overlap(teacher, output, profile))
    repeated = repeated_line(output) | (repeated_fragment(output, least) if fragments else F.lit(False))
    issue = lambda holds, category, detail, severity="hard": F.when(holds, F.struct(F.lit(category).alias("category"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"), F.lit(severity).alias("severity")))
    folded = ascii_digits(output)
    lost = F.filter(F.regexp_extract_all(ascii_digits(before), F.lit(f"({NUMBER})"), 1), lambda n: ~F.contains(folded, n))
    single = F.array(
        issue(F.length(output) == 0, "empty-output", "output is empty"),
        issue(~output.rlike(f"[{profile.script}]"), "no-persian", "output has no character of the native script"),
        issue(letter != "", "foreign-script", F.concat(F.lit("foreign letter "), letter)),
        issue(output.rlike("[0-9]"), "ascii-digit", "output contains an ASCII digit"),
        issue(output.rlike(ECHO["v4"]), "prompt-echo", "output repeats the instruction"),
        issue(repeated, "repetition", "output repeats a long line or fragment"),
        issue(anchor < profile.weak_below, "meaning-review", F.concat(F.lit("overlap "), F.format_number(anchor, 3)), "metric"),
        issue((mode != "tashih") & (output == before), "unchanged-register", "output is identical to input"),
        issue(~voiced, "register-review", "no register marker found", "metric"),
    )
    numbers = F.transform(lost, lambda n: F.struct(F.lit("lost-number").alias("category"), F.concat(F.lit("missing "), n).alias("detail"), F.lit("hard").alias("severity")))
    return F.concat(F.filter(single, lambda x: x.isNotNull()), numbers)


def schema_flag(fields: Column, expected: list[str], ordered: bool = False) -> Column:
    """Whether a record's field names (in the order of its line) are not the expected ones."""
    want = F.array(*map(F.lit, expected))
    return fields != want if ordered else F.array_sort(fields) != F.array_sort(want)


def rebuilt(messages: Column, system: Column, before: Column, output: Column) -> Column:
    """Whether the messages are one user turn of system and input and one assistant turn of the output."""
    user = (F.get(messages, 0)["role"] == "user") & (F.get(messages, 0)["content"] == F.concat(system, F.lit("\n\n"), before))
    answer = (F.get(messages, 1)["role"] == "assistant") & (F.get(messages, 1)["content"] == output)
    return F.coalesce((F.size(messages) == 2) & user & answer, F.lit(False))


