"""Guards over rewritten texts: predicates and ordered reasons, each a Column expression."""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .chars import ARABIC_EXTENDED, PERSIAN, SPACE, ascii_bounded, letters_outside, replace, replace_with, trim
from .text import ascii_digits, bind, has_persian

NUMBER = r"\d+(?:[.,]\d+)?"
#: Phrases that show an instruction echoed into an output, by profile.
ECHO = {
    "v2": "از نو بساز|بازسازی کن|توضیح نده|یک ویراستار حرفه‌ای باش|متن را به زبان .* بازنویسی کن",
    "v4": "متن را به زبان|بازنویسی کن|یک ویراستار حرفه‌ای|ویرایشگر حرفه‌ای|توضیح نده|فقط متن نهایی",
    "edit": "برگردان؛ توضیح نده|قوانین اکید|فقط متن بازنویسی‌شده را برگردان",
    "v1": "از نو بساز|بازسازی کن|توضیح نده|فقط متن (بازنویسی|ویرایش|اصلاح)[‌\\- ]?شده|متن را به زبان .* بازنویسی کن|یک ویراستار حرفه‌ای باش|متن (اصلی|موردنظر|ارسالی) را .* (بفرست|ارسال)|برای (ویرایش|بازنویسی) به من",
    "v3": "این چند جمله رو|متن اصلی رو بفرستم|بازنویسی کن|متن را به زبان|یک ویراستار حرفه‌ای|توضیح نده|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]",
}
#: What each version of the quarantine calls its reasons, in order.
REASONS = {
    "v2": ["no Persian output", None, "ASCII digit in output", "prompt echo", "placeholder output", "repeated long fragment", "extreme output length"],
    "v3": ["no Persian output", "foreign-script letter", "ASCII digit", "prompt echo", "placeholder", "repetition", "extreme expansion"],
}
#: Replies that dodge the edit, and template placeholders.
DODGES = [
    "متن (اصلی|کامل|مورد نظر|خود) را (برای من |جهت )?(ارسال|بفرستید)",
    "برای (ویرایش|بازنویسی) به من ارسال",
    "متنی برای (ویرایش|بازنویسی) ارائه نشده",
    "لطفاً متن (خود|مورد نظر) را",
    r"\[(نام|عنوان|موضوع|تاریخ|نام کارفرما|محل امضا|نام استاد)[^\]\n]*\]",
    r"【[^】\n]{2,}】",
]
PLACEHOLDER = r"\[[^\]\n]{2,}\]|【[^】\n]{2,}】"
CORRUPT = r"[\p{IsCyrillic}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsDevanagari}]"


def first_of(*cases: tuple[Column, str | Column]) -> Column:
    """The reason of the first case that holds, or an empty string."""
    chain = reduce(lambda c, x: c.when(*x) if c is not None else F.when(*x), cases, None)
    return chain.otherwise("")


def every_of(*cases: tuple[Column, str | Column]) -> Column:
    """The reasons of all cases that hold, in order."""
    return F.filter(F.array(*(F.when(c, r) for c, r in cases)), lambda x: x.isNotNull())


def foreign_lenient(output: Column, before: Column, most: int = 25) -> Column:
    """Letters of another script; Latin ones only if the input has none and the output more than ``most``."""
    latin = F.regexp_count(output, F.lit("[a-zA-Z]"))
    return output.rlike(CORRUPT) | (~before.rlike("[a-zA-Z]") & (latin > most))


def foreign_letter(text: Column, native: str = ARABIC_EXTENDED) -> Column:
    """The first letter outside the native script, or an empty string."""
    return F.regexp_extract(text, f"({letters_outside(native)})", 1)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(ascii_digits(text), F.lit(f"({NUMBER})"), 1)


def numbers_kept(before: Column, output: Column, exact: bool = False) -> Column:
    """Every number of the input occurs in the output, digits folded: as a part of it, or (exact) as a number of it."""
    if exact:
        return F.size(F.array_except(numbers(before), numbers(output))) == 0
    folded = ascii_digits(output)
    return F.forall(numbers(before), lambda n: F.contains(folded, n))


def has_markdown(text: Column) -> Column:
    return text.rlike(r"(?m)\*\*|^#{1,6}\s|\n\s*[-*]\s+")


def broken_reasons(output: Column, before: Column, correction: Column) -> Column:
    """Why a rewrite is not to be used; empty if it is."""
    dodge = first_of(*((output.rlike(p), f"broken-pattern:{p}") for p in DODGES))
    return every_of(
        (has_persian(before) & ~has_persian(output), "no-persian"),
        (foreign_lenient(output, before), "foreign-letter"),
        (~numbers_kept(before, output), "numbers"),
        (~correction & (trim(output) == trim(before)), "unchanged"),
        (output.rlike(ECHO["edit"]), "prompt-echo"),
        (dodge != "", dodge),
    )


#: Longest text whose multiples are looked up in a table, of a million pairs.
TABLED = 1 << 17


@cache
def multiples(least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(k * p, (k + 1) * p) of all lengths p from ``least`` to a third of the size, by the second place up to the size."""
    lengths = range(least, size // 3 + 1)
    first = np.concatenate([np.zeros(0, dtype=np.int32), *(np.arange(0, size - p + 1, p, dtype=np.int32) for p in lengths)])
    second = np.concatenate([np.zeros(0, dtype=np.int32), *(np.arange(p, size + 1, p, dtype=np.int32) for p in lengths)])
    order = np.argsort(second, kind="stable")
    return first[order], second[order]


def periods(x: np.ndarray, least: int) -> list[int]:
    """Lengths p of at most a third of x at which some multiple of p begins ``least`` values that come again p further on; by chance others."""
    base, h, of = np.uint64(0x9E3779B97F4A7C15), None, {1: x.astype(np.uint64)}
    for bit in (1 << i for i in range(least.bit_length())):
        if bit > 1:
            half = of[bit // 2]
            of[bit] = half[: len(half) - bit // 2] * base ** np.uint64(bit // 2) + half[bit // 2 :]
        if least & bit:  # values of so many more places before those so far
            own, after = of[bit], h
            h = own if after is None else own[: len(after) - bit] * base ** np.uint64(least & (bit - 1)) + after[bit:]
    if len(x) > TABLED:
        return [p for p in range(least, len(x) // 3 + 1) if (h[:-p:p] == h[p::p]).any()]
    a, b = multiples(least, max(64, 1 << (len(x) - 1).bit_length()))
    n = int(np.searchsorted(b, len(h) - 1, "right"))
    a, b = a[:n], b[:n]
    same = h[a] == h[b]
    return [p for p in np.unique((b - a)[same]).tolist() if p <= len(x) // 3] if same.any() else []


def tripled(text: str, least: int) -> bool:
    """Whether some fragment of ``least`` code points or more stands three times in a row.

    For every length p it does if 2 * p characters in a row equal those p further on. Some multiple of p then begins
    ``least`` characters that equal those p further on; hashes of so many characters say at which lengths that is so, for
    all lengths at once. Of these, sampled at eighths of p such a run shows as 16 hits in a row or so; only then are all
    characters compared, so the work is near n log n.
    """
    if len(text) < 3 * least:
        return False
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def in_a_row(hits: np.ndarray, n: int) -> bool:
        misses = np.flatnonzero(~hits)
        return int(np.diff(np.r_[-1, misses, len(hits)]).max()) - 1 >= n

    for p in periods(x, least):
        step = max(1, p // 8)
        if in_a_row(x[:-p:step] == x[p::step], 2 * p // step) and (step == 1 or in_a_row(x[:-p] == x[p:], 2 * p)):
            return True
    return False


def repeated_fragment(text: Column, least: int) -> Column:
    """tripled() over a column: a backreference does the same in time quadratic in a text's length."""

    @F.pandas_udf(T.BooleanType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tripled(t, least), na_action="ignore")

    return F.coalesce(found(text), F.lit(False))


def poison_reason(output: Column, before: Column, least: int | None = None, native: str = ARABIC_EXTENDED, version: str = "v2") -> Column:
    """The first reason to quarantine a training record; a native script other than Persian can be given.

    Version v3 has other names, doesn't say which letter is foreign, and looks for fragments of 16 places instead of 12.
    """
    letter = foreign_letter(output, native)
    none, foreign, digit, echo, placeholder, repeated, long = REASONS[version]
    return first_of(
        (~output.rlike(f"[{native}]"), none),
        (letter != "", foreign or F.concat(F.lit('foreign-script letter "'), letter, F.lit('"'))),
        (output.rlike("[0-9]"), digit),
        (output.rlike(ECHO["v2"]), echo),
        (output.rlike(PLACEHOLDER), placeholder),
        (repeated_fragment(output, least or (12 if version == "v2" else 16)), repeated),
        (F.length(output) > F.greatest(F.lit(600), F.length(before) * 6), long),
    )


def reject_reason(output: Column, before: Column, correction: Column, overlap: Column, least: int = 16, native: str = ARABIC_EXTENDED) -> Column:
    """The stricter ordered reasons, with the measure of common tokens given."""
    ratio = F.length(output) / F.greatest(F.lit(1), F.length(before))
    cases = [
        (output.isNull() | ~output.rlike(f"[{native}]"), "empty-or-no-Persian-output"),
        (foreign_letter(output, native) != "", "foreign-script-letter"),
        (output.rlike("[0-9]"), "ASCII-digit"),
        (output.rlike(ECHO["v4"]), "prompt-echo"),
        (~correction & (trim(output) == trim(before)), "unchanged-register"),
        (~numbers_kept(before, output), "lost-number"),
        (overlap < 0.14, "weak-meaning-anchor"),
        ((ratio < 0.2) | (ratio > 4), "extreme-length-change"),
        (repeated_fragment(output, least), "repetition"),
    ]
    return first_of(*cases)


def candidate_reason(candidate: Column, before: Column, marked: Column) -> Column:
    """Why a regenerated candidate is not accepted, numbers checked on the candidate itself."""
    return first_of(
        (F.coalesce(F.length(trim(candidate)), F.lit(0)) == 0, "empty"),
        (~has_persian(candidate), "no-persian"),
        (foreign_letter(candidate) != "", "foreign"),
        (~marked, "no-marker"),
        (trim(candidate) == trim(before), "unchanged"),
        (~numbers_kept(before, candidate), "lost-number"),
    )


def is_correction_pair(source: Column, target: Column) -> Column:
    s, t = trim(source), trim(target)
    return (F.length(s) > 0) & (F.length(t) > 0) & (s != t) & has_persian(s) & has_persian(t) & F.length(s).between(10, 300)


def admission(method: Column, content_type: Column, user_text: Column, origin: Column, allowed: list[str]) -> Column:
    """The first reason to refuse an edit request."""
    return first_of(
        (method != "POST", "method"),
        (origin.isNotNull() & ~origin.isin(allowed), "origin"),
        (~F.contains(F.coalesce(content_type, F.lit("")), F.lit("application/json")), "content-type"),
        (F.length(trim(F.coalesce(user_text, F.lit("")))) == 0, "empty"),
        (F.length(user_text) > 20_000, "too-long"),
    )


def clean_output(text: Column) -> Column:
    """Model output without fences, markdown, alternatives, framing quotes, or a glued or repeated second version."""
    t = trim(F.coalesce(text, F.lit("")))
    t = replace(t, r"(?s)\A```[a-z]*\n(.*?)\n```\z", "$1")
    t = replace(t, rf"(?s)\A«««{SPACE}*(.*?){SPACE}*»»»\z", "$1")
    t = replace(t, r"\*\*(.*?)\*\*", "$1")
    t = replace(t, r"\*(.*?)\*", "$1")
    t = replace(t, rf"(?m)^#{{1,6}}{SPACE}*", "")
    t = replace(t, rf"(?m)^{SPACE}*[-*]{SPACE}+", "")
    t = trim(replace(t, rf"(?m)^{SPACE}*>{SPACE}?", ""))
    option = lambda t: trim(F.regexp_extract(t, rf"(?s)\A(?:نسخه|گزینه|حالت){SPACE}*(?:۱|1|اول)[:\-\s]+(.+?)(?=\n*(?:نسخه|گزینه|حالت){SPACE}*(?:۲|2|دوم)|\z)", 1))
    quoted = lambda t: trim(F.regexp_extract(t, r"(?s)\A[«\"“]([^»\"”]+)[»\"”].+\z", 1))
    t = bind(t, lambda t: F.when(F.length(option(t)) > 0, option(t)).otherwise(t))
    t = bind(t, lambda t: F.when(F.length(quoted(t)) > 10, quoted(t)).otherwise(t))
    t = trim(replace(replace(t, rf"\A(?:[«\"“'»]|{SPACE})+", ""), rf"(?:[«\"”'»]|{SPACE})+\z", ""))
    return bind(t, lambda t: trim(_cut_restart(t)))


def _cut_restart(text: Column) -> Column:
    """Cut where word 0 comes back inside a word, or words 0, 1 (and 2) come back in a row; from word 3 on, of 8 or more."""

    def bare(w: Column, i: int) -> Column:
        return replace(F.get(w, F.lit(i)), r"\A[«\"“']", "")

    def cut_at(w: Column, b: Column) -> Column:
        zero, one, two = b["zero"], b["one"], b["two"]
        at = lambda i: F.instr(F.get(w, i), zero)  # noqa: E731  1 at the start, 0 nowhere
        again = lambda i: (at(i) == 1) & (F.length(one) > 0) & F.coalesce(F.get(w, i + 1) == one, F.lit(False)) & ((F.length(two) == 0) | F.coalesce(F.get(w, i + 2) == two, F.lit(False)))

        def joined(first: Column) -> Column:
            inside = F.when(at(first) > 1, F.array(F.substring(F.get(w, first), F.lit(1), at(first) - 1))).otherwise(F.array().cast("array<string>"))
            cut = trim(F.array_join(F.concat(F.slice(w, F.lit(1), first), inside), " "))
            stopped = bind(cut, lambda c: F.when(c.rlike(r"[.!?؟،؛]\z"), c).otherwise(F.concat(c, F.lit("."))))
            return F.when((F.size(w) >= 8) & (F.length(zero) > 0) & first.isNotNull(), stopped).otherwise(text)

        return bind(F.array_min(F.filter(F.sequence(F.lit(3), F.greatest(F.size(w) - 1, F.lit(3))), lambda i: (at(i) > 1) | again(i))), joined)

    return bind(F.split(text, rf"{SPACE}+"), lambda w: bind(F.struct(bare(w, 0).alias("zero"), bare(w, 1).alias("one"), bare(w, 2).alias("two")), lambda b: cut_at(w, b)))


def strip_corrupt(text: Column) -> Column:
    return replace(text, CORRUPT, "")


def strip_html(html: Column, native: str = PERSIAN) -> Column:
    """Declarations deleted, tags and entities to spaces, white space collapsed, stray short Latin between native text removed.

    Bodies of scripts and styles stay, as in the rule this follows; entities are not decoded.
    """
    t = replace_with(html, ("<!",), r"<![^>]*>", "")
    t = replace(t, r"<[^>]+>", " ")
    t = replace_with(t, ("&",), r"&[a-zA-Z]+;", " ")
    t = replace_with(t, ("&#",), r"&#[0-9]+;", " ")
    t = replace(t, rf"{SPACE}{{2,}}|[{SPACE}&&[^ ]]", " ")
    t = replace(t, rf"(?<={native}){SPACE}*{ascii_bounded('[a-z]{1,4}')}{SPACE}*(?={native})", " ")
    return trim(replace_with(t, ("  ",), " {2,}", " "))


def word_count(text: Column) -> Column:
    """Parts between spaces; a pattern to split by would be compiled again for each text."""
    return F.regexp_count(text, F.lit(rf"{SPACE}+")) + 1


def sentences_of(text: Column) -> Column:
    return F.transform(F.split(text, r"(?<=[.!؟…]) +"), trim)


def chunks(text: Column, most: int = 32, merge_to: int = 28, least: int = 3, native: str = PERSIAN) -> Column:
    """Native sentences of at most ``most`` words, each merged into the chunk before it while both have at most ``merge_to``; chunks of ``least`` words or more."""
    counted = F.transform(sentences_of(text), lambda s: F.struct(s.alias("s"), word_count(s).alias("n")))  # words are counted once: those of merged sentences add up
    kept = F.filter(counted, lambda x: x["s"].rlike(native) & (x["n"] <= most))
    start = F.array().cast("array<struct<s: string, n: int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        fits = F.when(F.size(done) == 0, False).otherwise(last["n"] + x["n"] <= merge_to)
        both = F.struct(F.concat_ws(" ", last["s"], x["s"]).alias("s"), (last["n"] + x["n"]).alias("n"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.transform(F.filter(F.aggregate(kept, start, step), lambda x: x["n"] >= least), lambda x: x["s"])


def clean_seed(text: Column) -> Column:
    t = replace(text, rf"{SPACE}*\n{SPACE}*", " ")
    t = replace(t, r"[«\"“']+|[»\"”']+\z", "")
    t = replace(t, rf"{SPACE}{{2,}}", " ")
    return trim(replace(t, rf"(?<={PERSIAN}){ascii_bounded('[a-z]{1,3}')}(?={PERSIAN})", ""))


def unwrap_quotes(text: Column) -> Column:
    """The text inside quotes that frame the whole of a one-line text."""
    pattern = r"\A[«\"“']+(.*?)[»\"”']\z"
    return trim(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def inject(text: Column, token: Column, fraction: float) -> Column:
    """The token inserted at a fraction of the words."""
    w = F.split(text, " ")
    at = F.floor(F.size(w) * F.lit(fraction)).cast("int")
    return F.array_join(F.concat(F.slice(w, F.lit(1), at), F.array(token), F.slice(w, at + 1, F.size(w))), " ")


#: A judge's verdicts and their synonyms; scores where none is given.
VERDICTS = {"PASS": ["قبول", "درست"], "FAIL": ["رد", "نادرست"], "UNCERTAIN": ["نامشخص", "نامطمئن"]}


def parse_verdict(reply: Column) -> Column:
    """struct(verdict, score, reason, lost_points) from a judge's reply, null where it has no valid verdict.

    Takes what lies between the first and the last brace; scores stay within 0 and 100 and default by verdict.
    """
    said = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "verdict string, score string, reason string, lost_points array<string>")
    word = F.upper(F.coalesce(said["verdict"], F.lit("")))
    verdict = first_of(*((said["verdict"].isin(*v) | (word == k), k) for k, v in VERDICTS.items()))
    standard = F.when(verdict == "PASS", 100.0).when(verdict == "FAIL", 0.0).otherwise(50.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(said["score"].try_cast("double"), standard)))
    reason = F.coalesce(F.nullif(trim(said["reason"]), F.lit("")), F.lit("no reason given"))
    return F.when(verdict != "", F.struct(verdict.alias("verdict"), score.alias("score"), reason.alias("reason"), F.coalesce(said["lost_points"], F.array().cast("array<string>")).alias("lost_points")))


def judge_prompt(before: Column, reference: Column, candidate: Column, vote: Column) -> Column:
    """The judge's request; odd votes look at it from the other side."""
    angle = F.when(vote % 2 == 0, "Look for meaning that was lost.").otherwise("Look for meaning that was added.")
    return F.concat_ws("\n\n", angle, F.concat(F.lit("INPUT: "), before), F.concat(F.lit("REFERENCE: "), reference), F.concat(F.lit("CANDIDATE: "), candidate))


def echoes(output: Column, version: str, instruction: Column | None = None) -> Column:
    """Whether an instruction shows in the output: by a version's phrases, by a placeholder in v1, or by the first 24 code points of the instruction."""
    found = output.rlike(ECHO[version])
    if version == "v1":
        found = found | output.rlike(PLACEHOLDER)
    return found if instruction is None else found | F.contains(output, F.substring(instruction, 1, 24))


#: Fixed value: letters that a clean row has none of.
UNCLEAN = r"[A-Za-z\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{0E00}-\x{0E7F}\x{0900}-\x{097F}\x{0400}-\x{04FF}]"


def clean_pair(before: Column, output: Column) -> Column:
    return ~before.rlike(UNCLEAN) & ~output.rlike(UNCLEAN)


def voice_positive(before: Column, output: Column, voiced: Column) -> Column:
    """A clean pair in its register's voice that keeps its numbers."""
    return clean_pair(before, output) & voiced & numbers_kept(before, output)


def needs_regeneration(mode: Column, voiced: Column, required: list[str]) -> Column:
    return mode.isin(*required) & ~voiced


def seed_fits(text: Column, least: int = 8, most: int = 400) -> Column:
    """Whether a seed has a fitting length after its cleanup."""
    return F.length(clean_seed(text)).between(least, most)


def fold_prompt(system: Column, user: Column) -> Column:
    """Fixed value: the template of the model that is evaluated, whose system text is part of the user's turn."""
    return F.concat(F.lit("<start_of_turn>user\n"), system, F.lit("\n\n"), user, F.lit("<end_of_turn>\n<start_of_turn>model\n"))


#: Tokens for each word, tokens besides, least and most, by service.
BUDGETS = {"online": (8, 512, 2048, 8192), "hosted": (4, 120, 256, 4096), "browser": (3, 60, 240, 420)}


def token_budget(text: Column, service: str = "online") -> Column:
    factor, more, least, most = BUDGETS[service]
    return F.least(F.lit(most), F.greatest(F.lit(least), word_count(trim(text)) * factor + more)).cast("int")
