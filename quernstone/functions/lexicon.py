"""Ordered lexicons: merged and expanded once, when a query is built; replaced longest key first.

A lexicon is a list of (key, value) pairs in order. The entries here are our own small sets with the structure that
replacement has to handle: keys of several words, prefixed verbs, and values that are keys themselves. Lexicons of real
size come from a table.

Replacement is one pass over the text for each entry, longest key first, so a pass sees what earlier ones wrote. Most
entries don't occur in a text: an automaton over all keys finds those that do in one scan, only their passes run, and
after each pass the places that it wrote are scanned for keys of later passes that they formed. So the work follows the
text and its replacements, not the number of entries, and a plan has one node for all lexicons.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .chars import ZWNJ

Lexicon = list[tuple[str, str]]

STANDARD: Lexicon = [
    ("آخه", "چون"), ("چون", "زیرا"), ("یه", "یک"), ("اینه که", "این است که"), ("خونه", "خانه"), ("نون", "نان"), ("میخوام", "میخواهم"),
    ("میرم", "میروم"), ("نمیدونم", "نمیدانم"), ("بهش", "به او"), ("اگه", "اگر"), ("دیگه", "دیگر"), ("واسه", "برای"), ("برای اینکه", "تا"),
]
FORMAL: Lexicon = [("سلام", "درود"), ("زیرا", "از آن رو که"), ("کمک", "مساعدت"), ("خیلی ممنون", "سپاس فراوان"), ("بگو", "بفرمایید")]
ACADEMIC: Lexicon = [("فکر میکنم", "گمان میرود"), ("نشون میده", "نشان میدهد")]
ADMIN: Lexicon = [("میفرستم", "ارسال میگردد"), ("امروز", "در تاریخ امروز")]
LEGAL: Lexicon = [("قول داد", "تعهد نمود"), ("دادگاه رفت", "به دادگاه مراجعه نمود")]
CASUAL: Lexicon = [("یک", "یه"), ("خانه", "خونه"), ("اگر", "اگه"), ("دیگر", "دیگه")]
STREET: Lexicon = [("دوست", "رفیق"), ("خوب", "ردیف")]
GENZ: Lexicon = [("جالب", "خفن"), ("شگفت", "خفن")]
LITERARY: Lexicon = [("خورشید", "مهر"), ("شب", "شام"), ("ماه", "ماهتاب")]
COURT: Lexicon = [("نوشتم", "مرقوم داشتم"), ("زیرا", "چه آنکه")]
COURTESY: Lexicon = [("بیا", "تشریف بیاورید"), ("گفت", "فرمود")]
FLATTERY: Lexicon = [("شما", "جناب عالی"), ("نظر", "رای صائب")]
POETIC: Lexicon = [("دل", "جان و دل"), ("باد", "نسیم")]


def merged(*parts: Lexicon) -> Lexicon:
    """Later values win; a key keeps its first place."""
    out: dict[str, str] = {}
    for part in parts:
        out.update(part)
    return list(out.items())


#: Entries that a query's lexicons hold, at most: a dimension that the driver collects and sends to every executor.
MOST_ENTRIES = 200_000


def from_table(rows: DataFrame) -> dict[str, Lexicon]:
    """Lexicons by register from a table (register, pos, k, v): a dimension of at most MOST_ENTRIES rows, refused if larger."""
    found = rows.select("register", "pos", "k", "v").limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} lexicon entries")
    out: dict[str, Lexicon] = {}
    for r in sorted(found, key=lambda r: (r["register"], r["pos"])):
        out.setdefault(r["register"], []).append((r["k"], r["v"]))
    return {register: merged(entries) for register, entries in out.items()}


def with_joined_prefixes(lexicon: Lexicon, prefixes: tuple[str, ...] = ("نمی", "می")) -> Lexicon:
    """Adds the half-space spelling of every key that starts with a verbal prefix; it overrides an entry of that key."""
    out = dict(lexicon)
    for key, value in lexicon:
        for p in prefixes:
            if key.startswith(p) and len(key) > len(p) and "؀" <= key[len(p)] <= "ۿ" and ZWNJ not in key:
                out[p + ZWNJ + key[len(p) :]] = value
                break
    return list(out.items())


def longest_first(lexicon: Lexicon) -> Lexicon:
    return sorted(lexicon, key=lambda e: -len(e[0]))


class Replacer:
    """The passes of one lexicon over a text. A key counts where no letter and no half-space touches it."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.entries = [(k, v) for k, v in longest_first(merged(lexicon)) if k]
        self.lengths = [len(k) for k, _ in self.entries]
        self.longest = len(self.entries[0][0]) if self.entries else 0
        self.automaton = ahocorasick.Automaton()
        for i, (k, _) in enumerate(self.entries):
            self.automaton.add_word(k, i)
        self.automaton.make_automaton()
        inside = {part for k, _ in self.entries for part in self.parts(k)}
        touch = lambda x: x.isalpha() or x == ZWNJ
        #: Whether what an entry's pass writes can be a part of a key, whole words of both; else no key can form there.
        self.forms = [not v or touch(v[0]) != touch(k[0]) or touch(v[-1]) != touch(k[-1]) or not inside.isdisjoint(self.parts(v)) for k, v in self.entries]

    @staticmethod
    def parts(text: str) -> set[str]:
        """What lies between two places of a text where a key could begin and end."""
        bound = [not (x.isalpha() or x == ZWNJ) for x in text]
        starts = [i for i in range(len(text)) if i == 0 or bound[i - 1]]
        ends = [i for i in range(1, len(text) + 1) if i == len(text) or bound[i]]
        return {text[a:b] for a in starts for b in ends if a < b}

    @staticmethod
    def alone(text: str, start: int, end: int) -> bool:
        before, after = text[start - 1 : start] if start else "", text[end : end + 1]
        return not (before.isalpha() or after.isalpha() or before == ZWNJ or after == ZWNJ)

    def occurring(self, text: str, start: int, end: int) -> set[int]:
        """Entries whose keys stand alone within a range of the text."""
        found, size = set(), len(text)
        for last, i in self.automaton.iter(text, start, end):
            if last + 1 < size and ((x := text[last + 1]).isalpha() or x == ZWNJ):  # most keys found are beginnings of words
                continue
            if i not in found and self.alone(text, last + 1 - self.lengths[i], last + 1):
                found.add(i)
        return found

    def one_pass(self, text: str, i: int) -> tuple[str, list[tuple[int, int]]]:
        """The text after an entry's pass, and the ranges that it wrote."""
        key, value = self.entries[i]
        out, ranges, done, length, at = [], [], 0, 0, text.find(key)
        while at >= 0:
            if self.alone(text, at, at + len(key)):
                out += [text[done:at], value]
                length += at - done + len(value)
                ranges.append((length - len(value), length))
                done = at + len(key)
            at = text.find(key, max(done, at + 1))
        return "".join([*out, text[done:]]), ranges

    def __call__(self, text: str) -> tuple[str, int]:
        """The text after all passes, and the number of replacements; an entry whose value is its key counts too."""
        if not self.entries:
            return text, 0
        waiting, n, last = list(self.occurring(text, 0, len(text))), 0, -1
        heapq.heapify(waiting)
        while waiting:
            i = heapq.heappop(waiting)
            if i == last:
                continue
            text, ranges = self.one_pass(text, i)
            n, last = n + len(ranges), i
            for start, end in ranges if self.forms[i] else ():
                for j in self.occurring(text, max(0, start - self.longest - 1), min(len(text), end + self.longest + 1)):
                    if j > i:
                        heapq.heappush(waiting, j)
        return text, n


def replacing(lexicons: dict[str, Lexicon]) -> Callable[[Column, Column], Column]:
    """A function of text and name of lexicon that gives struct(text, n): the text after the passes, and how many words were replaced.

    A text whose lexicon is unknown stays as it is. The lexicons are sent once to each executor.
    """
    sent = SparkSession.active().sparkContext.broadcast(lexicons)

    @F.pandas_udf("text string, n int")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        built: dict[str, Replacer | None] = {}
        for texts, names in batches:
            out = []
            for text, name in zip(texts, names):
                if name not in built:
                    built[name] = Replacer(sent.value[name]) if name in sent.value else None
                out.append((text, 0) if text is None or built[name] is None else built[name](text))
            yield pd.DataFrame(out, columns=["text", "n"])

    return replaced


#: Register to lexicon; the clean registers fix colloquial spellings first.
REGISTERS: dict[str, Lexicon] = {
    "standard": STANDARD,
    "formal": merged(STANDARD, FORMAL),
    "academic": merged(STANDARD, FORMAL, ACADEMIC),
    "admin": merged(STANDARD, FORMAL, ADMIN),
    "legal": merged(STANDARD, FORMAL, LEGAL),
    "casual": CASUAL,
    "literary": merged(STANDARD, LITERARY),
    "divani": merged(STANDARD, LITERARY, COURT),
    "street": STREET,
    "genz": GENZ,
    "taarof": merged(STANDARD, COURTESY),
    "flattery": merged(STANDARD, FLATTERY),
    "poetic": merged(STANDARD, LITERARY, POETIC),
}
