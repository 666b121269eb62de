"""Entities, encoding repair, folding and the stage trace against Python's own rules."""

from __future__ import annotations

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as X


def through(text, page="cp1252", times=1):
    """Text as it shows after its UTF-8 was read with a code page."""
    for _ in range(times):
        text = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode())
    return text


def each(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(4)
    return [r[1] for r in sorted(df.select("i", expr.alias("v")).collect())]


def test_references_are_read_as_html5_does(spark):
    draw = random.Random(4)
    parts = ["&", "&&", "#", ";", "x", "&#", "&#x", "copy", "&copy", "&amp", "&amp;", "&notin;", "&notit;", "&AMP;", "&hearts;", "150", "&#150;", "&#10;", "&#9;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#xFFFE;", "&#x80", "&#X41;", "&nbsp;", "&zzz;", " ", "é", "<", "&lt&gt", "&NotEqualTilde;", "\n"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 9))) for _ in range(1500)] + [f"a&#{n};b&#x{n:x}" for n in range(300)] + ["", None]
    assert each(spark, texts, X._unescape_once(F.col("t"))) == [t if t is None else html.unescape(t) for t in texts]


WORDS = "Příliš žluťoučký kůň úpěl; naïve Straße, l’été “über” ¿qué? – 20 € año… Größe šťáva Ødegård São Tomé 😀 “ÀÉ” привет мир κόσμος 日本語 ½ ©".split(" ")


@pytest.mark.parametrize(("page", "times"), [("cp1252", 1), ("cp1252", 2), ("cp1250", 1)])
def test_texts_that_went_through_a_page_come_back(spark, page, times):
    draw = random.Random(6)
    texts = [" ".join(draw.choices(WORDS[:17] if page == "cp1250" else WORDS, k=9)) for _ in range(200)]
    texts = [t for t in texts if "\xa0" not in through(t, page, times)]
    shown = [through(t, page, times) for t in texts]
    got = each(spark, shown, X.repair_mojibake(F.col("t")))
    own = [g == t for g, t in zip(got, texts, strict=True)]
    assert [(g, t) for g, t in zip(got, texts, strict=True) if g != t][:3] == [] if page == "cp1252" else sum(own) > 0.8 * len(own)
    assert not any(re.search(r"[Â-Å][\u0080-¿]", g) for g in got)


def test_sound_texts_stay(spark):
    texts = [*WORDS, " ".join(WORDS), "AÇÃO É BOM", "„ACASĂ” sound", "Å i åa ä e ö", "Ã voi", "à la carte", "¡Olé!", "Ελλάδα", "ÀÈÌ", "100 °C ± 5", "x\x1ay"]
    assert each(spark, texts, X.repair_mojibake(F.col("t"))) == texts


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a&#150;b", "a–b"), ("a&#10;b", "a\nb"), ("a&#9;b", "a b"), ("&copy y", "© y"), ("&amp y", "& y"), ("donâ€™t", "don’t"), ("donâ€�t Ã©", "dont é"), ("voilÃ  lÃ©", "voilà lé"), ("\x93Hi\x94", "“Hi”"),
        ("\x1b[31mred\x1b[0m", "red"), ("it&acirc;&euro;&trade;s", "it’s"), ("Ã©tÃ© et été", "été et été"), ("itÃ¢â‚¬â„¢s", "it’s"),
    ],
)
def test_cleaned(spark, raw, clean):
    assert each(spark, [raw], X.clean_text(F.col("t"))) == [clean]


def test_no_sequence_that_can_be_decoded_stays(spark):
    draw = random.Random(9)
    chars = [*map(chr, range(0xC2, 0xF5)), *X.PAGES[0].chars[:64], *"ab "]
    for got in each(spark, ["".join(draw.choices(chars, k=9)) for _ in range(2000)], X.repair_mojibake(F.col("t"))):
        for _, follow in re.findall(r"([Â-Å])(.)", got):
            assert follow not in X.PAGES[0].chars[:64], got


def test_fold_equals_decomposition(spark):
    texts = ["Žofie Größe ğüşïöç ȘȚșț ﬁn ① ½ ǆ Ĳ ｆｕｌｌ ﷺ x²", "", None, "".join(map(chr, range(0xA0, 0x2FF))), "".join(map(chr, range(0x1E00, 0x1EFF)))]
    plain = lambda t: re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", t).lower())
    assert each(spark, texts, X.ascii_fold(F.col("t"))) == [t if t is None else plain(t) for t in texts]


def test_stage_trace_counts_and_shows(spark):
    rows = [(1, "fine"), (2, "a&nbsp;b &amp;#160; c"), (3, "x​y Ã© and​"), (4, None)]
    got = {(r["stage"], r["class"]): (r["n"], r["key"], r["example"]) for r in X.stage_trace(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got["raw", "HTMLENT"] == (2, 2, "a&nbsp;b &amp;#160; c") and got["raw", "ZW"] == (2, 3, "x​y Ã© and​")
    assert got["unescaped", "NBSP"][0] == 2 and got["raw", "MOJI"][0] == 1
    assert not any(stage == "clean" for stage, _ in got)
