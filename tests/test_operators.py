"""Operators on small literal inputs with known results."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions import identifiers as I
from tidewell.functions import text as X
from tidewell.operators import changes as H
from tidewell.operators import customer as C
from tidewell.operators import evaluate as E
from tidewell.operators import fullrank
from tidewell.operators import messages as M
from tidewell.operators import pii as A
from tidewell.operators import purchases as P
from tidewell.operators import recommend as R
from tidewell.operators import sampling as S


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(expr).first()[0]


@pytest.mark.parametrize(
    ("recency", "frequency", "stage"),
    [(800, 5.0, "churned"), (500, 1.0, "win_back_candidate"), (500, 0.2, "churned"), (200, 3.0, "at_risk"), (90, 3.0, "active"), (10, 2.0, "loyal_active"), (10, 0.5, "active"), (45, 0.5, "acquisition")],
)
def test_lifecycle(spark, recency, frequency, stage):
    assert one(spark, C.lifecycle(F.col("r"), F.col("f")), r=float(recency), f=frequency) == stage


def test_rfm_of_three_orders(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    orders = spark.createDataFrame([(1, day(0)), (1, day(2)), (1, day(6))], "user long, ts timestamp")
    got = C.rfm(orders, spark.createDataFrame([(day(36),)], "reference timestamp")).first()
    assert (got["recency_days"], got["frequency"], got["n"]) == (30.0, 3.0, 3)


ARENA = [
    (1, 1, 5, "2013-01-01"), (1, 2, 4, "2013-02-01"), (1, 3, 5, "2013-03-01"), (1, 4, 3, "2013-04-01"),
    (2, 1, 4, "2013-01-05"), (2, 2, 5, "2013-02-05"), (2, 4, 4, "2013-03-05"), (2, 5, 5, "2013-03-05"),
    (3, 2, 5, "2013-01-10"), (3, 3, 4, "2013-02-10"), (3, 6, 2, "2013-05-10"), (4, 1, 3, "2013-01-15"), (4, 4, 4, "2013-02-15"), (5, 7, 5, "2013-01-20"),
]


@pytest.fixture(scope="module")
def arena(spark):
    rows = [(u, i, dt.datetime.fromisoformat(d), n, 1, 9.9, r) for n, (u, i, r, d) in enumerate(ARENA)]
    return spark.createDataFrame(rows, "user long, item long, ts timestamp, order_id long, line_no int, price double, rating int")


def test_leave_one_out_hides_the_last_of_the_last_day(arena):
    split = P.leave_one_out(arena)
    assert {r["user"]: r["item"] for r in P.hidden(split).collect()} == {1: 4, 2: 5, 3: 6, 4: 4}


def test_popularity_counts_histories_only(arena):
    scores = {r["item"]: r["score"] for r in R.popularity(P.history(P.leave_one_out(arena))).collect()}
    assert scores == {1: 3.0, 2: 3.0, 3: 2.0, 4: 1.0}


def test_full_rank_counts_scored_and_unscored(spark, arena):
    split = P.leave_one_out(arena)
    scores = spark.createDataFrame([(1, 4, 9.0), (1, 5, 8.0), (2, 3, 5.0), (2, 5, 4.0), (2, 6, 9.0)], "user long, item long, score double")
    n = spark.createDataFrame([(8,)], "n long")
    ranks = {r["user"]: r["rank"] for r in E.full_ranks(P.hidden(split), P.history(split), scores, n).collect()}
    assert ranks[1] == 1 and ranks[2] == 3 and 1 <= ranks[3] <= 6 and 1 <= ranks[4] <= 7


def test_candidates_hold_no_history_and_the_hidden_item(spark, arena):
    split = P.leave_one_out(arena)
    items = spark.createDataFrame([(i,) for i in range(1, 41)], "item long")
    got = S.sampled_candidates(split, items, n=5)
    owned = {(r["user"], r["item"]) for r in P.history(split).collect()}
    rows = got.collect()
    assert not owned & {(r["user"], r["item"]) for r in rows}
    assert sum(r["hidden"] for r in rows) == 4 and len(rows) == 24


def test_quota_larger_than_group_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k long, g string")
    with pytest.raises(Exception, match="quota"):
        S.quota_sample(df, "g", "k", F.lit(False), 2, "s").collect()


def test_paired_comparison_and_misalignment(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "user int, rank int")
    first, second = ranks([(1, 1), (2, 20), (3, 5), (4, None)]), ranks([(1, 3), (2, 2), (3, 30), (4, None)])
    got = E.paired_comparison(first, second).first()
    assert (got["n"], got["hits_first"], got["hits_second"], got["only_first"], got["only_second"], got["p_value"]) == (4, 2, 2, 1, 1, 1.0)
    with pytest.raises(Exception, match="different users"):
        E.paired_comparison(first, ranks([(1, 3)])).collect()


def test_sign_test(spark):
    assert one(spark, E.sign_test(F.lit(9), F.lit(1)), x="a") == pytest.approx(22 / 1024, abs=1e-6)
    assert one(spark, E.sign_test(F.lit(0), F.lit(0)), x="a") == 1.0


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("wide\u200bopen\ufeff door", "wideopen door"), ("\u202eleft\u2069 right", "left right"), ("bell\x07 and\x1e tape", "bell and tape"), ("one\u00a0two\u2028three\x0bfour\tfive", "one two three four five"),
        ("so\u0085 it ends", "so… it ends"), ("first_x000D_second", "first second"), ("&amp;amp;lt;tea &amp;amp; milk", "<tea & milk"), ("&#xFFFD;&#65533;", None), ("", None), (" \u200b\t ", None), (None, None),
        ("&Lambda; &nsupe; &hearts; &nosuchname; &copy;", "Λ ⊉ ♥ &nosuchname; ©"), ("Ã¼ber â\u0080\u0094 gut", "über — gut"), ("naÃ¯ve “quote” und Ã¶l", "naïve “quote” und öl"), ("Â é alone Ã", "Â é alone Ã"), ("&#88;&#x59;&Zcaron;", "XYŽ"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, X.clean_text(F.col("t")), t=raw) == clean


def test_strip_html_and_classes(spark):
    assert one(spark, X.clean_text(F.col("t"), html=True), t="<div>Two <i>red</i></div><style>p {}</style> lamps<script>x()</script>") == "Two red lamps"
    counts = one(spark, X.class_counts(F.col("t")), t="q\u200b\u200b\u200br\u00a0s &lt;t Ã¶ u<hr>v")
    assert counts == {"ZW": 3, "NBSP": 1, "HTMLENT": 1, "MOJI": 1, "HTMLTAG": 1}


def test_clean_nested_keeps_keys(spark):
    df = spark.sql("SELECT named_struct('a', array('p  &lt; q'), 'm', map('r  s', ' t&amp;u ')) AS s")
    row = X.clean_nested(df, "s").first()["s"]
    assert row["a"] == ["p < q"] and row["m"] == {"r  s": "t&u"}


@pytest.mark.parametrize(("text", "ok"), [("12345679", True), ("12345670", False), ("1234567", False), ("123456790", False)])
def test_company_number(spark, text, ok):
    assert one(spark, I.ico_ok(F.col("t")), t=text) is ok


def own_iban(account):
    """The account number with the check digits that make it valid."""
    return f"CZ{98 - int(account + '123500') % 97:02d}{account}"


def test_iban(spark):
    good = own_iban("03000000000987654321")
    spaced = " ".join(good[k : k + 4] for k in range(0, 24, 4))
    assert one(spark, I.iban_ok(F.col("t")), t=good) is True and one(spark, I.iban_ok(F.col("t")), t=spaced) is True
    assert one(spark, I.iban_ok(F.col("t")), t=good[:-1] + "2") is False


@pytest.mark.parametrize(("text", "ok"), [("530229/123", True), ("531301/123", False), ("530230/123", False), ("900229/0001", False), ("abc", False)])
def test_birth_number(spark, text, ok):
    assert one(spark, I.birth_number_ok(F.col("t")), t=text) is ok


def spans_of(spark, text):
    return [(s["pii_type"], s["surface"]) for s in one(spark, A.rule_spans(F.col("t")), t=text)]


def test_rule_spans(spark):
    got = spans_of(spark, "Dotazy na sklad@priklad.test, telefon +420 777 111 222, firma 12345679 a ne 12345670.")
    assert {t for t, _ in got} == {"EMAIL", "PHONE", "ICO"} and ("ICO", "12345679") in got
    assert spans_of(spark, "Adresa je 612 00 v centru.") == [("PSC", "612 00")]
    iban = own_iban("03000000000987654321")
    assert spans_of(spark, f"Plaťte na {iban} dnes.") == [("IBAN_CZ", iban)]
    assert spans_of(spark, "Narozen 530229/123.") == [("RC", "530229/123")]


def mask(spark, text):
    texts = spark.createDataFrame([(1, text)], "k int, text string")
    spans = A.exploded(texts.select("k", A.rule_spans(F.col("text")).alias("spans")), "k")
    return A.masked(texts, A.tokens_for(spans, texts, "k"), "k").withColumn("again", A.restored(F.col("masked"), F.col("back"))).first()


@pytest.mark.parametrize("text", ["Dotazy: sklad@priklad.test!", "x@y.test x@y.test z@y.test +420 777 111 222", "zde je <EMAIL_1> i x@y.test", "beze slov", ""])
def test_mask_restores(spark, text):
    assert mask(spark, text)["again"] == text


def test_mask_numbers(spark):
    assert mask(spark, "Z 35-9876543210/0300 na 35-9876543210/0300!")["masked"] == "Z <BBAN_1> na <BBAN_1>!"
    assert mask(spark, "zde je <EMAIL_1> i x@y.test")["masked"] == "zde je <EMAIL_1> i <EMAIL_2>"


def test_person_forms_share_an_entity(spark):
    text = "Dopis napsal Petr Havran, Havranovi odepsala Havranová."
    at = lambda w: (text.index(w), text.index(w) + len(w))
    texts = spark.createDataFrame([(1, text)], "k int, text string")
    found = ["Petr Havran", "Havranovi", "Havranová"]
    spans = spark.createDataFrame([(1, *at(w), "PERSON", w) for w in found], "k int, start int, stop int, pii_type string, surface string")
    assert A.masked(texts, A.tokens_for(spans, texts, "k"), "k").first()["masked"] == "Dopis napsal <PERSON_1>, <PERSON_1b> odepsala <PERSON_2>."


def test_model_spans_yield_to_rules_and_beat_postal_codes(spark):
    rows = [(1, 0, 12, "ADDRESS", "model", 0.9), (1, 4, 10, "PSC", "rule", None), (1, 20, 30, "EMAIL", "rule", None), (1, 20, 25, "PERSON", "model", 0.99), (1, 40, 46, "PSC", "rule", None)]
    got = A.merge_by_precedence(spark.createDataFrame(rows, "k int, start int, stop int, pii_type string, source string, confidence double"), "k")
    assert sorted((r["start"], r["pii_type"]) for r in got.collect()) == [(0, "ADDRESS"), (20, "EMAIL"), (40, "PSC")]


def test_name_match(spark):
    score = lambda w, n: one(spark, I.name_match(F.col("w"), F.col("n")), w=w, n=n)
    assert score("eva", "Eva") == 4 and score("nov", "Novák") == 3 and score("Novákovi", "Novák") == 2 and score("Novákové", "Novák") == 0 and score("Evě", "Eva") == 1


def test_prefix_search(spark):
    docs = spark.createDataFrame([(1, "Lampa a stůl, elektrotechnický"), (2, "lampička"), (3, "stoly")], "k int, text string")
    index = M.term_index(docs, "k", "text")
    found = lambda *words: sorted(r["k"] for r in M.search(index, "k", spark.createDataFrame([("q", w) for w in words], "query string, word string")).collect())
    assert found("lamp*", "stul") == [1] and found("l*") == [1, 2] and found("s*") == [1, 3]
    assert found("elektrotechn*") == [1] and found("elektrotechnicky*", "lampa") == [1] and found("lamp*") == [1, 2] and found("lamp") == []


@pytest.mark.parametrize(("evidence", "state"), [('"red lamp", "old"', "found"), ('"red lamp", "new"', "missing"), ("none given", "n/a"), ('" "', "n/a"), (None, "n/a")])
def test_evidence(spark, evidence, state):
    assert one(spark, M.evidence_status(F.col("e"), F.lit("an old table and a red lamp")), e=evidence) == state


def test_partial_matches_are_one_to_one_by_overlap(spark):
    span = "k int, start int, stop int, pii_type string"
    gold = spark.createDataFrame([(1, 0, 10, "A"), (1, 12, 20, "A"), (1, 30, 35, "PSC"), (1, 50, 60, "B"), (2, 0, 5, "A")], span)
    pred = spark.createDataFrame([(1, 2, 14, "A"), (1, 13, 18, "A"), (1, 28, 40, "ADDRESS"), (1, 50, 60, "B"), (1, 51, 61, "B"), (2, 0, 5, "B")], span)
    got = E.partial_matches(gold, pred, "k").first()
    assert (got["strict"], got["partial"], got["gold"], got["predicted"]) == (1, 3, 5, 6)


def test_planted_values_and_snapping(spark):
    got = one(spark, A.located(F.col("t"), ("summer house", "house", "s.e")), t="a summer house, a house, s.e house")
    assert [(s["start"], s["surface"]) for s in got] == [(2, "summer house"), (18, "house"), (25, "s.e"), (29, "house")]
    for lo, hi, want in ((6, 9, (4, 10)), (4, 12, (4, 10)), (4, 10, (4, 10)), (13, 18, (12, 21)), (12, 15, (12, 15))):
        df = spark.createDataFrame([("the Lamond, St. James", lo, hi)], "t string, a int, b int")
        assert tuple(df.select(*A.snapped(F.col("t"), F.col("a"), F.col("b"))).first()) == want, (lo, hi)


def test_nearest_controls_are_found_however_far(spark):
    import itertools

    rows = [(k, "xy"[k % 2], (k * k * 37) % 5000, k % 9 == 0) for k in range(90)] + [(200, "x", 900_000, True), (201, "z", 5, True), (202, "z", 70_000, False), (203, None, 1, True)]
    got = C.nearest_controls(spark.createDataFrame(rows, "id long, kind string, size long, flagged boolean"), "flagged", "kind", "size", "id").collect()
    want = set()
    for i, kind, size, flagged in rows:
        if flagged:
            others = sorted((abs(size - s), j) for j, k, s, f in rows if k == kind and not f and k is not None)
            want |= {(i, j) for _, j in itertools.islice(others, 3)}
    assert {(r["dirty"], r["clean"]) for r in got} == want and len(got) == len(want)


def test_walks_never_fall_short(spark):
    split = spark.createDataFrame([(u, i, i == 9) for u in range(5) for i in range(10)], "user long, item long, hidden boolean")
    items = spark.createDataFrame([(i,) for i in range(60)], "item long")
    for n, want in ((50, 50), (7, 7), (200, 50)):
        rows = S.sampled_candidates(split, items, n=n).where("NOT hidden").collect()
        assert len(rows) == 5 * want == len({(r["user"], r["item"]) for r in rows}) and all(r["item"] >= 10 for r in rows)
    candidates = S.sampled_candidates(split, items, n=10)
    drawn = S.training_negatives(split, items, candidates, per_item=2).collect()
    kept = {(r["user"], r["item"]) for r in candidates.collect()}
    assert len(drawn) == 5 * 18 and not kept & {(r["user"], r["item"]) for r in drawn}


def test_positions_number_every_row_once(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    assert sorted(r["pos"] for r in S.positions(df, "id").collect()) == list(range(500))
    by = {}
    for r in S.positions(df, "id", "g").collect():
        by.setdefault(r["g"], []).append(r["pos"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_change_outcomes(spark):
    current = spark.createDataFrame([(1, "city", "Brno", 5)], "key long, field string, old string, stamp long")
    changes = spark.createDataFrame([(1, 1, "city", "Praha", 5), (2, 1, "city", "Zlín", 4), (3, 1, "name", "x", 5), (4, 1, "city", "1", 5), (5, 2, "city", "Olomouc", 5)], "change_id long, key long, field string, value string, expected long")
    judged = H.judge_changes(changes, current, {"city": "^[^0-9]+$"})
    assert [r["outcome"] for r in judged.orderBy("change_id").collect()] == ["applied", "stale", "bad_field", "bad_value", "missing"]
    assert H.apply_changes(current, judged.drop("old", "stamp")).first()["value"] == "Praha"


def test_chain_reports_the_first_break(spark):
    import hashlib

    rows, prev = [], "0" * 64
    for k in range(5):
        own = hashlib.sha256(f"{k}|t|{prev}".encode()).hexdigest()
        rows.append((1, k, "t" if k != 3 else "forged", prev, own))
        prev = own
    log = spark.createDataFrame(rows, "chain int, seq long, tool string, prev_hash string, this_hash string")
    assert tuple(H.verify_chain(log, "chain", ("seq", "tool")).first()) == (1, 5, 3, "hash")
    verdict = lambda df: tuple(H.verify_chain(df, "chain", ("seq", "tool")).first())[2:]
    assert verdict(log.where("seq < 3")) == (None, None)
    assert verdict(log.where("seq <> 1")) == (2, "sequence") and verdict(log.where("seq < 3").union(log.where("seq = 2"))) == (2, "sequence")
    assert verdict(log.where("seq < 3").withColumn("this_hash", F.when(F.col("seq") < 2, F.col("this_hash")))) == (2, "hash")


def test_leaks_are_whole_known_values_however_many(spark, tmp_path):
    from tidewell import catalog

    head = "the same opening of sixty characters that several passages share, "
    values = [head + "first end", head + "second end", " ab ", "x", "", None, "straße 😀 öl", *[f"number {i} of many values {i * 7919}" for i in range(10_500)]]
    texts = [None, "", head, head + "first", "so " + head + "second end.", "cab", "a b", "1x", "Straße 😀 öl", "in der straße 😀 öl", "y" * 5000 + "number 10499 of many values 83141581", "number 10499 of many values 8314158", "cab"]
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    known = [v.strip() for v in values if v and v.strip()]
    want = sum(any(v in (t or "") for v in known) for t in texts)
    (row,) = catalog.queries()["ev12_leak_rate"](spark, f"file://{tmp_path}").collect()
    assert (row["payloads"], row["leaks"]) == (len(texts), want)


def test_character_errors_count_beyond_sixty_characters(spark, tmp_path):
    from tidewell import catalog

    urls = ["http://a/" + "b" * 70 + "XYZ", "ab", None]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["cer"] for r in catalog.queries()["ev13_character_error_rate"](spark, f"file://{tmp_path}").collect()}
    assert got == {0: round(5 / 80, 6), 1: 0.0, 2: None}


def test_many_spans_of_one_text_are_chosen_like_one_by_one(spark):
    draw = random.Random(7)
    rows = [(draw.randrange(6000), draw.choice((0, 1, 2, 5, 9, 30)), draw.choice("AB")) for _ in range(3000)]
    spans = [(a, a + n, t, f"{a}") for a, n, t in rows]
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2], s)):
        if not any(k[0] < s[1] and s[0] < k[1] for k in kept):
            kept.append(s)
    df = spark.createDataFrame([(spans,)], f"spans {A.SPAN}")
    got = df.select(A.without_overlap(F.col("spans"), "longest", "earliest", "type")).first()[0]
    assert [tuple(s) for s in got] == sorted(kept)


def test_fifty_thousand_spans_of_one_text(spark):
    df = spark.range(50_000).select(F.lit(1).alias("doc"), (F.col("id") * 7).cast("int").alias("start"), (F.col("id") * 7 + 5 + F.col("id") % 4).cast("int").alias("stop"), F.lit("PSC").alias("pii_type"), F.lit("model").alias("source"), F.lit(0.5).alias("confidence"))
    began = time.perf_counter()
    assert A.merge_by_precedence(df, "doc").count() > 25_000
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("blocks", [(2048, 4096), (3, 5)])
def test_full_ranks_by_blocks_equal_sorting(spark, monkeypatch, blocks):
    monkeypatch.setattr(fullrank, "USER_BLOCK", blocks[0])
    monkeypatch.setattr(fullrank, "ITEM_BLOCK", blocks[1])
    draw = random.Random(12)
    items = {i: [draw.choice((0.0, 0.5, 1.0)), draw.choice((0.0, 1.0))] for i in range(23)}
    users = {u: [draw.choice((0.5, 1.0)), draw.choice((0.0, 1.0))] for u in range(14) if u != 5}
    hidden = {u: draw.randrange(30) for u in range(14)}  # items from 23 on, and user 5, have no vector
    seen = {(u, i) for u in range(14) for i in draw.sample(range(30), 4) if i != hidden[u]}
    tie = lambda u, i: hashlib.md5(f"t|{u}|{i}".encode()).hexdigest()
    want = {}
    for u, target in hidden.items():
        open_items = [i for i in range(30) if (u, i) not in seen]
        score = {i: round(sum(a * b for a, b in zip(users[u], items[i], strict=True)), 5) for i in open_items if u in users and i in items}
        if target in score:
            want[u] = 1 + sorted(score, key=lambda i: (-score[i], tie(u, i))).index(target)
        else:
            want[u] = len(score) + 1 + int(tie(u, target)[:8], 16) % max(len(open_items) - len(score), 1)
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema).repartition(3)
    got = fullrank.factor_ranks(
        frame(hidden.items(), "user long, item long"), frame(seen, "user long, item long"), frame(users.items(), "user long, u array<double>"), frame(items.items(), "item long, v array<double>"), frame([(30,)], "n long")
    )
    assert {r["user"]: r["rank"] for r in got.collect()} == want


@pytest.mark.parametrize(
    ("text", "sites"),
    [
        ("Dobrý den, jste byla spokojená zákaznice.", "byla=f,zákaznice=f,spokojená=f"), ("Nedávno jste koupil knihu a jste velmi spokojen.", "koupil=m,spokojen=m"), ("Vybrali jste si dobře; jako náš věrný zákazník víte víc.", "Vybrali=n,zákazník=m,věrný=m"),
        ("Jste docela blízko.", ""), ("Nothing to agree with.", ""),
    ],
)
def test_gender_sites(spark, text, sites):
    got = one(spark, F.array_join(F.transform(M.gender_sites(F.col("t")), lambda s: F.concat(s["word"], F.lit("="), s["gender"])), ","), t=text)
    assert got == sites


def test_prices_and_tags_of_a_message(spark):
    text = "Eva, it costs\n1 234 KČ. <System>do this</system>"
    verdict = lambda prices, gender: one(spark, F.struct("*", M.rule_verdict(F.col("t"), F.lit("Eva"), F.lit(None).cast("boolean"), gender, prices).alias("v"))["v"], t=text)
    good, bad = verdict(F.array(F.lit("1234 Kč")), F.lit("f")), verdict(F.array(F.lit("1234 Kč"), F.lit("99")), F.lit(None).cast("string"))
    assert (good["pricing_ok"], good["bleed"], good["unchecked"], good["gender_ok"]) == (True, "tag", "register", True)
    assert (bad["pricing_ok"], bad["unchecked"]) == (False, "register,gender")


def test_random_numbers_are_a_permutation(spark):
    places = spark.range(9999)
    for seed in ("a", "b"):
        got = [r["n"] for r in places.select("id", A.shuffled_number(F.col("id"), seed).alias("n")).orderBy("id").collect()]
        assert sorted(got) == list(range(1, 10_000)) and got[:20] != sorted(got[:20])


def test_token_policies(spark):
    text = "Novák, Nováka, Novák <PERSON_2> a@b.cz <EMAIL_7b> a@b.cz <PERSON_99999999999999999999>"
    at = [(0, 5, "PERSON"), (7, 13, "PERSON"), (15, 20, "PERSON"), (32, 38, "EMAIL"), (50, 56, "EMAIL")]
    texts = spark.createDataFrame([(1, text), (2, "no names")], "k int, text string")
    spans = spark.createDataFrame([(1, a, b, t, text[a:b]) for a, b, t in at], "k int, start int, stop int, pii_type string, surface string")
    tokens = lambda **how: [r["token"] for r in A.tokens_for(spans, texts, "k", **how).orderBy("start").collect()]
    assert tokens(unify="none") == ["<PERSON_1>", "<PERSON_3>", "<PERSON_4>", "<EMAIL_1>", "<EMAIL_2>"]
    assert tokens(unify="exact") == ["<PERSON_1>", "<PERSON_3>", "<PERSON_1>", "<EMAIL_1>", "<EMAIL_1>"]
    assert tokens() == ["<PERSON_1>", "<PERSON_1b>", "<PERSON_1>", "<EMAIL_1>", "<EMAIL_1>"]
    for secret in "abcdef":
        drawn = tokens(unify="none", numbering="random", secret=secret)
        numbers = [int(t.strip("<>").split("_")[1]) for t in drawn]
        assert len(set(numbers)) == 5 and not {2, 7} & set(numbers) and all(1 <= n <= 9999 for n in numbers)
        assert drawn == tokens(unify="none", numbering="random", secret=secret)
    masked = A.masked(texts, A.tokens_for(spans, texts, "k", numbering="random", secret="a"), "k")
    assert all(r["again"] == r["text"] for r in masked.withColumn("again", A.restored(F.col("masked"), F.col("back"))).collect())
    with pytest.raises(ValueError):
        A.tokens_for(spans, texts, "k", unify="all")


def test_random_numbers_run_out(spark):
    texts = spark.createDataFrame([(1, "x")], "k int, text string")
    spans = spark.range(9999).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("start"), (F.col("id") + 1).cast("int").alias("stop"), F.lit("PERSON").alias("pii_type"), F.lit("x").alias("surface"))
    assert A.tokens_for(spans, texts, "k", unify="none", numbering="random").select("token").distinct().count() == 9999
    tagged = spark.createDataFrame([(1, "x <PERSON_5>")], "k int, text string")
    with pytest.raises(Exception, match="no free token number"):
        A.tokens_for(spans, tagged, "k", unify="none", numbering="random").collect()


def test_vault_gives_out_and_resolves(spark):
    rows = [(1, "PERSON", "novak", "Novák", 3), (1, "PERSON", "novak", "Nováka", 5), (1, "PERSON", "cerny", "Černý", 4), (1, "EMAIL", "a", "a@b.cz", 9), (2, "PERSON", "cerny", "Černý", 1)]
    vault = A.session_vault(spark.createDataFrame(rows, "s int, pii_type string, entity string, surface string, at int"), "s", "at")
    assert {(r["s"], r["surface"], r["token"]) for r in vault.collect()} == {(1, "Novák", "<PERSON_1>"), (1, "Nováka", "<PERSON_1b>"), (1, "Černý", "<PERSON_2>"), (1, "a@b.cz", "<EMAIL_1>"), (2, "Černý", "<PERSON_1>")}
    asked = spark.createDataFrame([(1, "<PERSON_1b>"), (2, "<PERSON_1b>"), (1, "<person_1>"), (1, None), (3, "<EMAIL_1>")], "s int, token string")
    got = {(r["s"], r["token"]): (r["surface"], r["status"]) for r in A.resolved(asked, vault, "s").collect()}
    assert got == {(1, "<PERSON_1b>"): ("Nováka", "ok"), (2, "<PERSON_1b>"): (None, "unknown"), (1, "<person_1>"): (None, "malformed"), (1, None): (None, "malformed"), (3, "<EMAIL_1>"): (None, "unknown")}


def test_stored_index_reads_ranges_and_finds_the_newest(spark, tmp_path):
    rows = [(i, i % 3, i * 7 % 50, f"Kabel č. {i}" if i % 2 else "Kabelka", "Žlutý" if i % 5 == 0 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, who int, at int, title string, body string")
    M.write_term_index(docs, "id", ("title", "body"), ("who", "at"), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    asked = {"a": ("Kabel*", None), "b": ("kabel žlutý", None), "c": ("kabel* kabel*", 1), "d": ("", None), "e": ("kabe", None)}
    found = M.search_index(index, "id", asked, "at", "who", limit=7)
    want = set()
    for q, keep in (("a", lambda r: True), ("b", lambda r: r[0] % 2 and r[0] % 5 == 0), ("c", lambda r: r[1] == 1)):
        want |= {(q, r[0], k + 1) for k, r in enumerate(sorted(filter(keep, rows), key=lambda r: (-r[2], -r[0]))[:7])}
    assert {(r["query"], r["id"], r["rank"]) for r in found.collect()} == want
    assert M.search_index(index, "id", {"d": ("", None)}, "at", "who").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,kabel)" in plan
