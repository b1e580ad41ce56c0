"""Hand-derived cases of the Persian rules."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import audit as q, guards as g, lexicon as lx, text as t
from quernstone.plans import edits

Z = "‌"


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    got = row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return got[0] if len(columns) == 1 else tuple(got)


CASES = [
    (t.fold_chars, "٥٦ كي أإة", "۵۶ کی ااه"),
    (t.fold_chars, "سـلامً​", "سلام"),
    (t.join_half_spaces, "می رفت", f"می{Z}رفت"),
    (t.join_half_spaces, "می کرد", "می کرد"),
    (t.join_half_spaces, "میخواهم", f"می{Z}خواهم"),
    (t.join_half_spaces, "رسمی است", "رسمی است"),
    (t.join_half_spaces, "کتاب ها", f"کتاب{Z}ها"),
    (t.join_half_spaces, f"a{Z}{Z}b", f"a{Z}b"),
    (t.fix_punctuation, "صبر....", "صبر…"),
    (t.fix_punctuation, "چرا ?", "چرا؟"),
    (t.fix_punctuation, 'گفت "سلام"', "گفت «سلام»"),
    (t.fix_spacing, "سلام ، خوبی", "سلام، خوبی"),
    (t.fix_spacing, "۳.۵", "۳.۵"),
    (t.fix_spacing, " « کلمه » ", "«کلمه»"),
    (t.final_mark, "سلام", "سلام."),
    (t.final_mark, "سلام؟", "سلام؟"),
    (t.final_mark, "", ""),
    (t.ascii_digits, "۱۲٣", "123"),
    (t.strip_interjections, "خب، بیا. ای بابا. رفت.", "بیا. رفت."),
    (g.strip_html, "<!DOCTYPE html><p>a&amp;b &#12; c</p>", "a b c"),
    (g.strip_html, "رهبر d کشور", "رهبر کشور"),
    (g.clean_output, "```text\nسلام\n```", "سلام"),
    (g.clean_output, "**سلام** دوست", "سلام دوست"),
    (g.clean_output, "سرور پاسخ داد و بعد از کار افتادسرور پاسخ داد و بعد", "سرور پاسخ داد و بعد از کار افتاد."),
    (g.clean_output, "a b c d e f a b c d e f", "a b c d e f."),
    (g.unwrap_quotes, "«سلام»", "سلام"),
    (q.stem, "می‌کتابها".replace(Z, ""), "کتاب"),
]


@pytest.mark.parametrize("function, given, wanted", CASES)
def test_case(spark, function, given, wanted):
    assert one(spark, function(F.col("x")), x=given) == wanted


def test_loose_join_is_a_switch(spark):
    assert one(spark, t.join_half_spaces(F.col("x"), compat=True), x="رسمی است") == f"رسمی{Z}است"


def test_replacement_cascades_and_counts(spark):
    entries = [("آخه", "چون"), ("چون", "زیرا"), ("یه", "یک")]
    assert one(spark, t.replace_words(F.col("x"), entries), t.replaced_words(F.col("x"), entries), x="آخه یه روز") == ("زیرا یک روز", 3)
    assert one(spark, t.replace_words(F.col("x"), entries), x="پایه") == "پایه"


def test_prefixed_keys_get_a_joined_form():
    assert dict(lx.with_joined_prefixes([("میخوام", "x")]))[f"می{Z}خوام"] == "x"
    assert lx.merged([("a", "1"), ("b", "2")], [("a", "3")]) == [("a", "3"), ("b", "2")]


def test_edit(spark):
    texts = spark.createDataFrame([("tashih", "من كتاب را می خواهم ,آخه یه روز"), ("tashih", " abc "), ("other", None)], "mode string, text string")
    got = [r["edited"] for r in edits.edit_table(texts).collect()]
    assert got[0]["output"] == f"من کتاب را می{Z}خواهم ,زیرا یک روز." and got[0]["notes"] == [t.NOTES["half_space"], t.NOTES["words"], t.NOTES["final"]]
    assert got[1]["output"] == "abc" and got[2]["output"] is None
    woven = one(spark, t.weave_connectors(F.col("x"), ["پس"]), x="این یک است. آن دو شد امروز. و سه هم آمد. چهار هم رفت خانه.")
    assert woven.count("پس،") == 2


def test_foreign_letters(spark):
    assert one(spark, g.foreign_letter(F.col("x")), x="سلـام API") == "A"
    assert one(spark, g.foreign_letter(F.col("x")), x="سلام ۱۲.") == ""


def test_numbers_kept(spark):
    assert one(spark, g.numbers_kept(F.col("a"), F.col("b")), a="۱۲ و 3.5", b="12 3.5")
    assert one(spark, g.numbers_kept(F.col("a"), F.col("b")), a="5", b="15")
    assert not one(spark, g.numbers_kept(F.col("a"), F.col("b"), exact=True), a="5", b="15")


@pytest.mark.parametrize("text, least, wanted", [("ab" * 30, 12, True), ("abcdefghijkl" * 3, 12, True), ("abcdefghijk" * 3, 12, False), ("abcdefghijkl" * 2, 12, False), ("x" + "abcdefghijklmno\n" * 3 + "y", 12, True), ("", 12, False)])
def test_tripled(text, least, wanted):
    import re

    assert g.tripled(text, least) is wanted
    assert bool(re.search(rf"(?s)(.{{{least},}})\1\1", text)) is wanted


def test_tripled_like_the_backreference():
    import random
    import re

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        assert g.tripled(text, 5) is bool(re.search(r"(?s)(.{5,})\1\1", text))


def test_fnv(spark):
    assert one(spark, q.fnv1a(F.col("x")), x="hello") == 1335831723


def test_versions(spark):
    assert one(spark, t.is_newer(F.col("a"), F.col("b")), a="1.10.0", b="1.9")
    assert not one(spark, t.is_newer(F.col("a"), F.col("b")), a="1.9", b="1.9.0")


def test_words_and_title(spark):
    assert one(spark, t.count_persian_words(F.col("x")), x=f"می{Z}روم خانه. abc") == 2
    assert one(spark, t.title(F.col("x")), x="  ") == "بدون عنوان"


def test_verdicts(spark):
    got = one(spark, g.parse_verdict(F.col("x")), x='```json\n{"verdict": "قبول", "score": 140, "reason": " "}\n```')
    assert (got["verdict"], got["score"]) == ("PASS", 100.0)
    assert one(spark, g.parse_verdict(F.col("x")), x="no json") is None


def test_chunks(spark):
    text = "یک دو سه. چهار پنج. شش هفت هشت نه."
    assert one(spark, g.chunks(F.col("x"), merge_to=5), x=text) == ["یک دو سه. چهار پنج.", "شش هفت هشت نه."]


def test_nulls_pass_through(spark):
    rows = spark.createDataFrame([(None,)], "x string")
    got = rows.select(t.fold_chars(F.col("x")), t.fix_spacing(F.col("x")), g.strip_html(F.col("x"))).first()
    assert list(got) == [None, None, None]


def test_small_variants(spark):
    assert one(spark, t.polish_quick(F.col("x")), x="می روم ، خانه ها") == f"می{Z}روم، خانه{Z}ها."
    assert [tuple(w) for w in one(spark, t.new_words(F.col("a"), F.col("b")), a="سلام، دوست", b="سلام رفیق")] == [("سلام", False), ("رفیق", True)]
    assert one(spark, t.word_changes(F.col("a"), F.col("b"), 2), a="a b c", b="x y z w") == 2
    assert one(spark, t.wrap(F.col("x"), "با سلام", "سپاس"), x="متن") == "با سلام؛ متن. سپاس."
    assert one(spark, t.persian_digits(F.col("x")), x="v1.2") == "v۱.۲"
    assert one(spark, g.inject(F.col("x"), F.lit("!"), 0.5), x="a b c d") == "a b ! c d"
    assert one(spark, g.clean_seed(F.col("x")), x="«سلام\n دوست»") == "سلام دوست"
    assert [one(spark, g.token_budget(F.col("x"), k), x="abc") for k in ("online", "hosted", "browser")] == [2048, 256, 240]
    assert [one(spark, g.token_budget(F.col("x"), k), x="abc " * 300) for k in ("online", "hosted", "browser")] == [2912, 1320, 420]


def test_guards_in_order(spark):
    reasons = one(spark, g.broken_reasons(F.col("a"), F.col("b"), F.lit(False)), a="hello 7", b="سلام ۵")
    assert reasons == ["no-persian", "numbers"]
    assert one(spark, g.poison_reason(F.col("a"), F.col("b")), a="سلام [نام کارفرما]", b="x") == "placeholder output"
    assert one(spark, g.poison_reason(F.col("a"), F.col("b")), a="سلام دوستان خوبم" * 3, b="x") == "repeated long fragment"
    assert one(spark, g.admission(F.col("m"), F.col("c"), F.col("u"), F.lit(None).cast("string"), []), m="POST", c="application/json", u=" ") == "empty"
    assert one(spark, g.candidate_reason(F.col("a"), F.col("b"), F.lit(True)), a="سلام", b="سلام ۵") == "lost-number"


def test_overlap_profiles(spark):
    both = {"a": "کتابخانه بزرگ شهر", "b": "کتاب بزرگ"}
    assert one(spark, q.overlap(F.col("a"), F.col("b"), q.PROFILES["gate"]), **both) == 1.0
    assert one(spark, q.overlap(F.col("a"), F.col("b"), q.PROFILES["v3"]), **both) == pytest.approx(1 / 3)
    assert one(spark, q.audit_tokens(F.col("x")), x="ﻛﺘﺎﺑﻬﺎ و ۱۲") == ["کتاب"]


def test_passes_in_order_like_plain_replacement():
    """Random lexicons over few letters, with cascades, keys within keys and values that touch their neighbours."""
    import random

    import regex

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    for case in range(400):
        phrase = lambda: rng.choice([" ", "-", Z, ""]).join(word() for _ in range(rng.randint(1, 2)))
        entries = lx.merged([(phrase(), rng.choice([phrase(), phrase(), "", f" {word()}", f"{word()}!"])) for _ in range(rng.randint(1, 12))])
        text = "".join(rng.choice(["a", "b", "ab", "ba", " ", " ", "-", "!", Z]) for _ in range(rng.randint(0, 40)))
        want, n = text, 0
        for k, v in lx.longest_first(entries):
            want, some = regex.subn(rf"(?<![\p{{L}}{Z}]){regex.escape(k)}(?![\p{{L}}{Z}])", lambda m: v, want)  # noqa: B023
            n += some
        assert lx.Replacer(entries)(text) == (want, n), (case, entries, text)


def test_five_thousand_entries_are_one_node(spark):
    key = lambda i: "ک" + str(i).translate(str.maketrans("0123456789", "ابپتثجچحخد"))
    entries = [(key(i), key(i + 1)) for i in range(5000)]
    rows = spark.createDataFrame([(f"{key(4998)} و {key(12)} ساده ک",)], "x string").select(t.replace_words(F.col("x"), entries).alias("y"))
    assert rows.first()["y"] == f"{key(5000)} و {key(100)} ساده ک"  # the passes of longer keys are over
    assert len(rows._jdf.queryExecution().executedPlan().toString()) < 2000
    table = spark.createDataFrame([("r", i, k, v) for i, (k, v) in enumerate(entries)], "register string, pos int, k string, v string")
    assert lx.from_table(table.repartition(4)) == {"r": entries}


def test_passes_that_form_no_key():
    """Only what can be a part of a key is looked at again; the result is that of all passes in order."""
    import random

    rng = random.Random(9)
    words = ["a", "b", "c", "ab", "b c", "c a b", "می" + lx.ZWNJ + "b", "-a", "b-"]
    for _ in range(400):
        entries = [(rng.choice(words), rng.choice([*words, "", "zz", "b zz"])) for _ in range(rng.randint(1, 6))]
        text = "".join(rng.choice([*words, " ", " ", "-", lx.ZWNJ]) for _ in range(12))
        replacer = lx.Replacer(entries)
        want, n = text, 0
        for i in range(len(replacer.entries)):
            want, ranges = replacer.one_pass(want, i)
            n += len(ranges)
        assert replacer(text) == (want, n), (entries, text)
    plain = lx.Replacer([("one two", "five"), ("six", "one")])
    assert plain.forms == [False, True]  # "five" is a part of no key, "one" of the first


def test_edit_computes_only_what_is_taken(spark):
    rows = spark.createDataFrame([("می روم ?", "x")], "text string, mode string")
    plan = edits.edit_table(rows).select("edited.output")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan  # the count of changed words


def test_fragments_are_quick():
    import random
    import time

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(12_000))
    g.tripled(text, 12)
    began = time.perf_counter()
    assert not g.tripled(text, 12)
    assert time.perf_counter() - began < 0.25  # 6 ms; a step for each length took half a second and more
    assert g.tripled(text[:30_000] + text[500:560] * 3 + text[30_000:], 12)
    assert g.tripled(text * 2 + "-" + text[500:560] * 3, 12)  # longer than the table


def test_tokens_are_cut_once(spark):
    rows = spark.createDataFrame([("کتاب‌های خوب", "کتاب خوبی"), ("", "کتاب"), (None, "")], "a string, b string")
    both = q.with_audit_overlap(rows, "a", "b")
    assert [r["overlap"] for r in both.collect()][1] == 1.0
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") <= 4  # once for each text, in the function's input and its plan node


def test_hashes_by_blocks(monkeypatch):
    import tracemalloc

    texts = [None, "", "é😀", *("x" * (n % 700) for n in range(300)), "y" * 5000]
    want = q.fnv1a_of(texts).tolist()
    monkeypatch.setattr(q, "HASHED_CHARS", 900)
    assert q.fnv1a_of(texts).tolist() == want
    monkeypatch.undo()
    long = ["x" * 3000] * 10_000
    tracemalloc.start()
    q.fnv1a_of(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # 480 MB for all texts at once


def test_words_of_chunks_are_counted_once(spark):
    text = " ".join(f"<p>Word {i} of some sentence.</p>" for i in range(60))
    df = spark.createDataFrame([(text,)], "html string").select(g.chunks(g.strip_html(F.col("html")), native="[A-Za-z]").alias("c"))
    got = df.collect()[0]["c"]
    assert got == [" ".join(f"Word {i} of some sentence." for i in range(k, k + 5)) for k in range(0, 60, 5)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1


def test_keyboard_polish_computes_the_text_once(spark):
    df = spark.createDataFrame([("می روم  ؟خوب",)], "t string").select(t.polish_quick(F.col("t")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
