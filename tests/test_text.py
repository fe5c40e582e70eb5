import re

import pytest
from pyspark.sql import functions as F

from seamline.config import MARKDOWN, PREAMBLE, Config, Segment, from_mapping
from seamline.functions import text as tx
from seamline.functions.markup import copy_error, strip_markup
from seamline.functions.segment import Segmenter, register


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def each(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("x"))
    return [r["x"] for r in sorted(df.collect(), key=lambda r: r["i"])]


ODD = ["", " ", "a b", " a b c\x1cd\x85e ", "one  two", "﻿x", "tab\tnew\nline", None, "a​b"]


def test_words(spark):
    assert each(spark, tx.word_count, ODD) == [len((t or "").split()) for t in ODD]
    assert each(spark, tx.task_words, ["", "a  b", "a\nb c", " "]) == [t.split(" ") for t in ["", "a  b", "a\nb c", " "]]
    assert each(spark, tx.tokenless, ["", " \t", "a", " "]) == [True, True, False, True]
    assert each(spark, tx.strip, ["　 a \x1f", "b"]) == ["a", "b"]


def test_ratios(spark):
    texts = ["", "123 !?", "abc", "සිංහල", "ab සිං 12", "²½x"]
    letters = re.compile(r"[^\W\d_]")
    want = []
    for t in texts:
        found = letters.findall(t)
        want.append(sum("඀" <= c <= "෿" for c in found) / len(found) if found else 0.0)
    assert each(spark, tx.sinhala_ratio, texts) == pytest.approx(want)
    assert each(spark, tx.latin_ratio, texts[:3]) == [0, 0, 1]


def test_numbers(spark):
    assert each(spark, tx.numeric_tokens, ["1,250 and 3.14.", "no", "12, 5,", None, "٣٤ 7٫5"]) == [["1250", "3.14"], [], ["12", "5"], [], ["٣٤", "7٫5"]]


def test_ngrams(spark):
    assert one(spark, lambda c: tx.word_ngrams(c, 3), "A b  c\nd a B c") == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, lambda c: tx.word_ngrams(c, 8), "seven words are not enough for one") == []
    assert len(one(spark, lambda c: tx.word_ngrams(c, 8), "nine words make just two runs of eight words")) == 2


def test_surface(spark):
    cases = {"a‍ b": "a‍ b.", "a​b﻿": "ab.", "“q” ‘x’": "\"q\" 'x'.", "end .": "end.", "what ?": "what?", "": "", "done… ": "done…", "x ,y": "x,y."}
    assert each(spark, tx.normalize_surface, list(cases)) == list(cases.values())


def test_clean_output(spark):
    cases = {
        "```text\nhello there\n```": "hello there",
        '"quoted answer"': "quoted answer",
        "“not the same”": "“not the same”",
        "---\nbody\n---": "body",
        "a  b\n\n\n\nc": "a b\n\nc",
        "unchanged": "unchanged",
        "'a' and \"b'": "a' and \"b",
        None: "",
        '""': '""',
    }
    assert each(spark, tx.clean_output, list(cases)) == list(cases.values())


def test_paragraphs_and_truncation(spark):
    assert one(spark, lambda c: tx.drop_short_paragraphs(c, 5), "abc\n\nlong enough\n\n x \n\nalso long") == "long enough\n\nalso long"
    text = "One two three. Four five six.  Seven eight! Nine"
    for n, want in ((3, "One two three."), (5, "One two three. Four five six."), (8, "One two three. Four five six.  Seven eight!"), (50, text), (1, "One two three.")):
        assert one(spark, lambda c, n=n: tx.truncate_at_sentence(c, F.lit(n)), text) == want


def test_patterns_agree_with_python(spark):
    texts = ["Sure, here", "Here's the text", "# head", "- item", "**bold** x", "1. one", "> quote", "[a](b)", "plain", "```x", "Output: y", "okay then", "  - item"]
    for patterns in (PREAMBLE, MARKDOWN):
        got = each(spark, lambda c, p=patterns: tx.first_of(c, p), texts)
        assert got == [next((p for p in patterns if re.search(p, t)), None) for t in texts]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("The cat sat down here. The dog ran away.", ["The cat sat down here.", "The dog ran away."]),
        ("Is it so? Yes! Good.", ["Is it so?", "Yes!", "Good."]),
        ("Sentence with mark෴ Another one here…", ["Sentence with mark෴", "Another one here…"]),
        ("Pi is 3.14 today. Price 1,250.50 paid.", ["Pi is 3.14 today.", "Price 1,250.50 paid."]),
        ("Dr. Silva came home. Prof. Perera left.", ["Dr. Silva came home.", "Prof. Perera left."]),
        ("ක්‍රි.ව. 1815 දී සිදු විය. ඉන් පසු නිම විය.", ["ක්‍රි.ව. 1815 දී සිදු විය.", "ඉන් පසු නිම විය."]),
        ("A. B. Silva wrote it. It sold.", ["A. B. Silva wrote it.", "It sold."]),
        ("Wait... then it ended.", ["Wait...", "then it ended."]),
        ("", []),
        ("   ", []),
        ("no end at all", ["no end at all"]),
        ("First line is long enough here\nSecond line is long enough too", ["First line is long enough here", "Second line is long enough too"]),
        ("Head\nA sentence that is long enough.", ["Head A sentence that is long enough."]),
        ("A sentence that is long enough.\nTail", ["A sentence that is long enough. Tail"]),
        ("Something is here now. ... !", ["Something is here now. ... !"]),
        ('He said "go now." and left. Then it rained.', ['He said "go now." and left.', "Then it rained."]),
        ('An open " quote here. Next one is here.', ['An open " quote here.', "Next one is here."]),
        ("(It ended here.) Then more came.", ["(It ended here.)", "Then more came."]),
        ("ඔහු ගුරුවරයෙක් ය. ඇය ගායිකාවක් ය.", ["ඔහු ගුරුවරයෙක් ය.", "ඇය ගායිකාවක් ය."]),
        ("e.g.this stays whole. Next sentence is here.", ["e.g.this stays whole.", "Next sentence is here."]),
        ("What?! Really now!! Yes.", ["What?!", "Really now!!", "Yes."]),
    ],
)
def test_segments(text, parts):
    got = Segmenter()(text)
    assert got == parts
    assert " ".join(got).split() == text.split(), "no word is lost"


def test_segment_rules_and_sql(spark):
    assert Segmenter(Segment(terminators=("|",), min_chars=2))("ab| cd|") == ["ab|", "cd|"]
    register(spark)
    assert spark.sql("select sentences_of('One is here. Two is here.') s").first()["s"] == ["One is here.", "Two is here."]
    rows = spark.sql("select * from sentence_rows('One is here. Two is here.')").collect()
    assert [(r["idx"], r["sentence"]) for r in rows] == [(0, "One is here."), (1, "Two is here.")]


@pytest.mark.parametrize(
    ("raw", "prose"),
    [
        ("[[target|label]] and [[plain]]", "label and plain"),
        ("a <!-- no\nno --> b", "a b"),
        ("x<ref name=a>no</ref> y<ref name=b /> z", "x y z"),
        ("{{t|{{u|v}}}} kept {{ open", "kept open"),
        ("{| class=x\n| cell {{t}}\n|} after", "after"),
        ("[[File:a.png|thumb|see [[b|c]] too]] text", "text"),
        ("[[ගොනුව:a.png|100px]] text", "text"),
        ("[[Category:x]] a\nCategory:y\nb", "a\n\nb"),
        ("[[en:Title]] a [[zh-min-nan:b]]", "a"),
        ("[[WP:Page]] a [[Talk about: this]]", "a Talk about: this"),
        ("[http://x.y label here] and [http://x.y] end", "label here and end"),
        ("see https://x.y/z?a=b now", "see now"),
        ("a\n== Head ==\nb", "a\n\nb"),
        ("'''bold''' ''it'' don't", "bold it don't"),
        ("__NOTOC__ a\n----\nb", "a\n\nb"),
        ("<b>a</b> 1 < 2 <br/>", "a 1 < 2"),
        ("a&nbsp;b &amp;lt; &quot;c&quot;", 'a b < "c"'),
        ("wrap\nped line\n\nnew para", "wrap ped line\n\nnew para"),
        ("* one\n# two\ntext", "one\n\ntwo\n\ntext"),
        ("<nowiki>[[x]]</nowiki><math>y</math>", "x"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(raw, prose):
    assert strip_markup(raw) == prose


def test_copies():
    assert copy_error("Hello, World!", "hello world", 0.92) == "copy: output identical to original span"
    assert copy_error("a b c d e f g h i j", "a b c d e f g h i k", 0.92).startswith("copy: similarity")
    assert copy_error("quite different", "nothing alike here", 0.92) is None and copy_error("x", "", 0.92) is None


def test_config():
    c = from_mapping({"seed": 7, "clean": {"min_chars": 1, "stub": ["s"]}, "generators": {"g": {"slug": "v/g", "role": "seen"}}})
    assert c.seed == 7 and c.clean.min_chars == 1 and c.clean.stub == ("s",) and list(c.generators) == ["g"] and c.clean.min_words == Config().clean.min_words
