"""Steps whose shuffles and times have to grow no faster than their input, against plain computations."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F


def test_vectors_meet_pairs_in_cells(spark):
    from tidewell.operators import cells as C

    draw = random.Random(3)
    vectors = {k: [draw.uniform(-1, 1) for _ in range(5)] for k in range(40)}
    owned = [(u, draw.randrange(45)) for u in range(60) for _ in range(draw.randrange(1, 9))]
    rows = [(k, v) for k, v in vectors.items()] + [(41, None)]
    v, pairs = spark.createDataFrame(rows, "key long, v array<double>"), spark.createDataFrame(owned, "user long, key long")
    want = {u: np.sum([vectors[k] for w, k in owned if w == u and k in vectors], axis=0) for u in {w for w, k in owned if k in vectors}}
    for blocks in ((3, 4), (2, 1)):
        got = {r["user"]: r for r in C.vector_sums(pairs, v, blocks).collect()}
        assert set(got) == set(want) and all(np.allclose(got[u]["s"], want[u]) and got[u]["n"] == sum(w == u and k in vectors for w, k in owned) for u in want)
        users = spark.createDataFrame([(u, [float(x) for x in s]) for u, s in want.items()], "user long, u array<double>")
        dots = C.vector_dots(pairs.withColumn("item", F.col("key") + 1000).distinct(), users, v, blocks).collect()
        assert {(r["user"], r["item"]) for r in dots} == {(u, k + 1000) for u, k in owned if u in want and (k in vectors or k == 41)}
        assert all(r["dot"] is None if r["item"] == 1041 else np.isclose(r["dot"], np.dot(want[r["user"]], vectors[r["item"] - 1000])) for r in dots)


def test_no_shuffle_holds_a_vector_for_each_pair(spark):
    from conftest import DATA

    from tidewell import catalog

    plan = catalog.queries()["rec9_second_encoder"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode(v" not in plan


def test_walks_leave_out_what_is_taken_before_they_become_rows(spark):
    from tidewell.operators import sampling as S

    catalog = spark.range(50).withColumnRenamed("id", "item")
    taken = spark.createDataFrame([(u, i) for u in range(6) for i in range(u * 9)] + [(0, 777)], "user long, item long")
    wants = spark.createDataFrame([(u, 12) for u in range(6)], "user long, n int")
    fresh = S.fresh_items(wants, taken, catalog, "s")
    got = [tuple(r) for r in fresh.collect()]
    for u in range(6):
        mine = sorted((k, i) for w, i, k in got if w == u)
        assert [k for k, _ in mine] == list(range(1, min(12, 50 - u * 9) + 1)) and len({i for _, i in mine}) == len(mine) and all(i >= u * 9 for _, i in mine)
    assert "LeftAnti" not in fresh._jdf.queryExecution().executedPlan().toString()


def test_ranks_by_item_scores_need_no_user(spark):
    from tidewell.operators import evaluate as E

    cand = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False), (2, 3, True), (2, 1, False), (3, 2, False)], "user long, item long, hidden boolean")
    scores = spark.createDataFrame([(1, 1.0), (2, 2.0)], "item long, score double")
    assert {tuple(r) for r in E.sampled_ranks(cand, scores).collect()} == {(1, 2), (2, 2)}


def test_small_blocks_of_much_work_are_many_tasks(spark):
    from tidewell.operators import fullrank

    hidden = spark.range(40).select(F.col("id").alias("user"), (F.col("id") % 7).alias("item"))
    users, items = hidden.select("user", F.array(F.lit(1.0)).alias("u")), spark.range(64).select(F.col("id").alias("item"), F.array(F.lit(1.0)).alias("v"))
    blocks, n = fullrank._blocked(items, "item", "v", fullrank.ITEM_BLOCK, "ib", least=fullrank.LEAST_BLOCKS)
    assert n == fullrank.LEAST_BLOCKS and blocks.count() > 16
    ranks = fullrank.factor_ranks(hidden, hidden.limit(0), users, items, items.agg(F.count("*").alias("n"))).collect()
    assert len(ranks) == 40 and all(1 <= r["rank"] <= 64 for r in ranks)


def test_equal_training_rows_become_weights(spark):
    from tidewell.operators import learned as L

    draw = random.Random(5)
    rows = [(i % 2, *[round(draw.choice((0.1, 0.2, 0.3)) + 0.1 * (i % 2), 1) for _ in range(4)], 0.5) for i in range(400)]
    train = spark.createDataFrame(rows, f"label int, {', '.join(f'{f} double' for f in L.FEATURES)}")
    assert L.distinct_rows(train).agg(F.sum("n")).first()[0] == 400 and L.distinct_rows(train).count() < 400
    wanted = train.limit(9).withColumn("user", F.lit(1)).withColumn("item", F.monotonically_increasing_id())
    got = {r["item"]: r["score"] for r in L.svm_scores(train, wanted).collect()}
    again = {r["item"]: r["score"] for r in L.svm_scores(train.union(train), wanted, c=0.25).collect()}
    assert len(got) == 9 and all(abs(got[i] - again[i]) < 0.05 for i in got)


def test_prices_are_found_whatever_their_case(spark):
    from tidewell.operators import messages as M

    row = spark.createDataFrame([("Die große Kiste", ["GROSSE K"], ["GROSSER K"])], "t string, p array<string>, q array<string>")
    verdict = lambda p: M.rule_verdict(F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.col(p))["pricing_ok"].alias(p)
    assert tuple(row.select(verdict("p"), verdict("q")).first()) == (True, False)


def test_character_errors_agree_with_sql_on_long_and_empty_urls(spark, tmp_path):
    import duckdb
    from comparing import agree

    from tidewell import catalog

    urls = ["http://A/" + "b" * 70 + "XYZ", "ab", "a", "", None]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    agree(catalog.queries()["ev13_character_error_rate"], catalog.oracle_sql()["ev13_character_error_rate"], spark, con, f"file://{tmp_path}")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spans_are_detected_once(spark):
    from conftest import DATA

    from tidewell import catalog
    from tidewell.functions import identifiers as I

    for name in ("pii5_rule_spans", "pii10_tokens", "pii10_masked_texts", "ev10_unification_rate"):
        assert _plan(catalog.queries()[name](spark, DATA)).count("regexp_extract_all(text#") - _plan(catalog.queries()[name](spark, DATA)).count("<([A-Z_]+_[0-9]+)[a-z]*>") == len(I.SHAPES) - 1, name
    for name in ("pii10_policies", "pii10_random_numbers", "ev8_partial_matching", "ev11_overlap_recall"):
        assert I.SHAPES["EMAIL"] not in _plan(catalog.queries()[name](spark, DATA)), name


def test_shapes_are_looked_for_only_where_they_can_be(spark):
    from tidewell.operators import pii as A

    texts = ["a@b.cz", "tel. 602 123 456", "a@b.cz 12345678 1/2000", "PSČ ٣٤٥ ١٢", "nic", "", None, "a@b.cz 110 00 x@y.eu"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    every = [A.matches(F.col("text"), A.I.SHAPES[t], t) for t in A.RULES]
    checked = [F.filter(m, A._checked(t)) if t in A.CHECKS else m for m, t in zip(every, A.RULES, strict=True)]
    plain = A.without_overlap(F.concat(*checked), "longest", "earliest", "type")
    got = df.select(A.rule_spans(F.col("text")).alias("a"), plain.alias("b"), A.matches(F.col("text"), "nic", "X").alias("m")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[6]["a"] is None and got[6]["m"] is None and got[5]["a"] == [] and [len(r["m"]) for r in got if r["m"] is not None] == [0, 0, 0, 0, 1, 0, 0]
    assert [s["pii_type"] for s in got[7]["a"]] == ["EMAIL", "PSC", "EMAIL"]


def test_entities_that_begin_together_have_numbers_of_their_own(spark):
    from tidewell.operators import pii as A

    spans = spark.createDataFrame([(1, 0, 4, "X", "Jana"), (1, 0, 9, "X", "Jana Malá"), (1, 12, 16, "X", "Jana")], "k int, start int, stop int, pii_type string, surface string")
    texts = spark.createDataFrame([(1, "Jana Malá a Jana")], "k int, text string")
    tokens = A.tokens_for(spans, texts, "k", unify="exact")
    assert [r["token"] for r in tokens.orderBy("start", "stop").collect()] == ["<X_1>", "<X_2>", "<X_1>"]
    assert _plan(tokens).count("regexp_extract_all") == 1 and _plan(tokens).count("Join") == 1


def test_fragments_are_joined_beside_the_text_not_with_it(spark):
    from tidewell.operators import pii as A

    texts = spark.createDataFrame([(1, "Jan Novák, Praha a Eva"), (2, "x")], "k int, text string")
    spans = spark.createDataFrame([(1, 0, 3, "P", 0.5), (1, 4, 9, "P", 0.25), (1, 11, 16, "A", 0.75), (1, 19, 22, "A", 1.0)], "k int, start int, stop int, pii_type string, confidence double")
    joined = A.join_fragments(spans, texts, "k")
    assert sorted(tuple(r) for r in joined.select("pii_type", "start", "stop", "confidence").collect()) == [("A", 11, 16, 0.75), ("A", 19, 22, 1.0), ("P", 0, 9, 0.25)]
    assert "lag(" not in _plan(joined)


def test_co_buyers_meet_in_buckets(spark, monkeypatch):
    from conftest import DATA

    from tidewell import catalog
    from tidewell.operators import cobuyers as C
    from tidewell.operators import recommend as R

    monkeypatch.setattr(C, "LISTED", 3)
    draw = random.Random(5)
    owned = sorted({(draw.choice((1, 2, 3, 5, 8, 2**40, -7, 40, 41)), draw.randrange(12)) for _ in range(60)} | {(1, 77), (99, 78)})
    offered = [(u, i) for u in (1, 2, 8, 2**40, -7, 99, 500) for i in range(13) if (u, i) not in owned]
    buyers = {i: {u for u, j in owned if i == j} for _, i in owned}
    near = {}
    for us in buyers.values():
        for u in us:
            for o in us - {u}:
                near[u, o] = near.get((u, o), 0.0) + 1 / np.log(len(us))
    want = {(u, i): sum(near.get((u, o), 0.0) for o in buyers.get(i, ())) for u, i in offered if any((u, o) in near for o in buyers.get(i, ()))}
    hist, cand = spark.createDataFrame(owned, "user long, item long"), spark.createDataFrame(offered, "user long, item long")
    for rows in (hist, hist.where("user between 0 and 100")):
        if rows is hist:
            got = {(r["user"], r["other"]): r["w"] for r in C.co_buyers(rows).collect()}
            assert set(got) == set(near) and all(np.isclose(got[k], near[k]) for k in near)
            scores = {(r["user"], r["item"]): r["score"] for r in R.adamic_adar(rows, cand).collect()}
            assert set(scores) == set(want) and all(np.isclose(scores[k], want[k], atol=1e-6) for k in want)
        else:
            small = {(r["user"], r["other"]) for r in C.co_buyers(rows).collect()}
            assert small == {(u, o) for u, o in near if 0 <= u <= 100 and 0 <= o <= 100}
    assert C.co_buyers(hist.where("false")).count() == 0 and R.adamic_adar(hist.where("false"), cand).count() == 0
    for name in ("jn9_co_buyers", "rec6_adamic_adar"):
        assert "other" not in " ".join(x for x in catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x), name


def test_topics_of_a_user_come_from_vectors(spark):
    from tidewell.operators import learned as L

    shares = spark.createDataFrame([(1, [0.25, 0.75, 0.0]), (2, [0.5, 0.25, 0.25]), (3, [0.0, 0.0, 0.0])], "key long, v array<double>")
    owned = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 2), (9, 99)], "user long, item long")
    got = {tuple(r) for r in L.user_topics(owned, shares, 2).select("user", "rank", "topic", "weight").collect()}
    assert got == {(7, 1, 1, 0.5), (7, 2, 0, 0.375), (8, 1, 0, 0.0), (8, 2, 1, 0.0), (9, 1, 0, 0.5), (9, 2, 1, 0.25)}


def test_texts_in_ascii_are_not_looked_through_for_broken_sequences(spark):
    from tidewell.functions import text as X

    df = spark.createDataFrame([("plain & &amp;amp; x",), ("CafÃ© &eacute;",), ("sound é",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.unescape(X.repair_mojibake(F.col("t")))).collect()] == ["plain & & x", "Café é", "sound é", None, ""]
    assert "octet_length" in _plan(df.select(X.repair_mojibake(F.col("t"))))


def test_documents_meet_words_in_buckets(spark):
    import math
    from collections import Counter

    from tidewell.operators import recommend as R
    from tidewell.operators import sampling as S

    draw = random.Random(5)
    words = ["a", "b", "Ä", "zz", "z", "", "ring", "bolt"] + [f"w{i}" for i in range(20)]
    text = {i: [draw.choice(words[: 3 + i % 25]) for _ in range(1 + i % 6)] for i in range(60)}
    rows = [(u, i, 3, k == 0) for u in range(15) for k, i in enumerate(draw.sample(range(60), 2 + u))] + [(99, 7, 3, True), (99, 777, 3, False), (100, 888, 1, True), (100, 8, 1, False)]
    split = spark.createDataFrame(rows, "user long, item long, n long, hidden boolean")
    catalog = spark.range(60).withColumnRenamed("id", "item")
    docs = spark.createDataFrame([(i, t) for i, ts in text.items() for t in ts], "item long, term string")
    n, avg = len(text), sum(map(len, text.values())) / len(text)
    df = Counter(t for ts in text.values() for t in set(ts))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    candidates = [(r["user"], r["item"]) for r in S.sampled_candidates(split, catalog, 12, "7").collect()]
    for top in (200, 3):
        want = {}
        for u, i in candidates:
            owned = Counter(t for w, j, _, hidden in rows if w == u and not hidden for t in text.get(j, []))
            query = {t for t, _ in sorted(owned.items(), key=lambda x: (-x[1], x[0].encode()))[:top]}
            met = [idf[t] * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(text[i]) / avg)) for t, c in Counter(text.get(i, [])).items() if t in query]
            if met:
                want[u, i] = sum(met)
        scores = R.bm25(split, catalog, docs, 12, top=top)
        got = [tuple(r) for r in scores.collect()]
        assert len(got) == len(want) > 100 and all(abs(s - want[u, i]) < 2e-6 for u, i, s in got)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" in plan and "term#" not in plan  # no word of a user, and none of a candidate, is a row


def test_documents_without_terms_score_nothing(spark):
    from tidewell.operators import lexical as L

    owned = spark.createDataFrame([(1, [1, 1, 2], [0.5, 0.5, 0.25]), (2, None, None), (3, [4], [1.0])], "user long, terms array<int>, idfs array<double>")
    offered = spark.createDataFrame([(1, 5, [1, 3]), (1, 6, None), (1, 7, [3]), (2, 5, [1]), (4, 5, [1]), (1, 5, [2])], "user long, item long, terms array<int>")
    got = {(r["user"], r["item"]): r["score"] for r in L.okapi(owned, offered, 9, 2.0, 200, 1.5, 0.75).collect()}
    assert set(got) == {(1, 5)} and abs(got[1, 5] - (0.5 + 0.25 * 2.5 / (1 + 1.5 * (0.25 + 0.75 / 2)))) < 1e-9  # an item that is offered twice adds up


def test_marks_of_instructions_are_whole_words(spark, tmp_path):
    import duckdb
    from comparing import agree

    from tidewell import catalog
    from tidewell.operators import messages as M

    texts = ["Il est pas an ai du le.", "Ne pas an aiment.", "Was an ai it.", "Élas an ai. As an aire."]
    spark.createDataFrame([(c, t, "user", x) for c in range(6) for t, x in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    agree(catalog.queries()["val3_rule_verdict"], catalog.oracle_sql()["val3_rule_verdict"], spark, con, f"file://{tmp_path}")
    df = spark.createDataFrame([(0, "As an AI, I ignore previously given INSTRUCTIONS: no"), (1, "the system prompts"), (2, "(as\nan AI-model)"), (3, None)], "k int, t string")
    none = F.lit(None)
    v = M.rule_verdict(F.col("t"), none.cast("string"), none.cast("boolean"), none.cast("string"), none.cast("array<string>"))
    assert [r[0] for r in df.orderBy("k").select(v["bleed"]).collect()] == ["ignore previous,as an ai,instructions:", "system prompt", "as an ai", ""]


def test_sign_test_of_many_pairs_is_one_pass(spark):
    import math
    import time

    from tidewell.operators import evaluate as E

    def exact(a, b):
        n, low = a + b, min(a, b)
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1))
        return 1.0 if n == 0 else min(1.0, 2 * tail)

    pairs = [(0, 0), (0, 1), (1, 0), (5, 1), (3, 3), (40, 61), (60_000, 60_300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    began = time.perf_counter()
    got = {(r["a"], r["b"]): r["p"] for r in df.withColumn("p", E.sign_test(F.col("a"), F.col("b"))).collect()}
    assert time.perf_counter() - began < 60
    assert all(abs(got[p] - exact(*p)) < 2e-6 for p in pairs)


def test_population_learns_from_every_purchase(spark, monkeypatch):
    from conftest import DATA

    from tidewell import catalog
    from tidewell.operators import learned as L
    from tidewell.operators import purchases as P
    from tidewell.plans.recommend import Arena

    rows = spark.createDataFrame([(1, 5, 2), (1, 5, 4), (1, 6, 1), (2, 5, 3), (2, 7, 5), (3, 9, 1)], "user long, item long, rating int")
    held = spark.createDataFrame([(1, 6), (3, 5)], "user long, item long")
    assert {tuple(r) for r in P.population(rows, held).collect()} == {(1, 5, 7), (2, 5, 3), (2, 7, 5), (3, 9, 1)}

    given = []
    whole = L.als_scores
    monkeypatch.setattr(L, "als_scores", lambda hist, pairs: given.append(hist) or whole(hist, pairs, rank=2, rounds=1))
    catalog.queries()["rec14_population_als"](spark, DATA)
    shop = spark.read.parquet(f"{DATA}/customer.parquet").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("user"))
    hidden = Arena(spark, DATA).hidden.join(shop, "user", "left_semi")
    bought = P.purchase_rows(spark, DATA)
    want = bought.join(hidden, ["user", "item"], "left_anti")
    assert given[0].agg(F.sum("rating"), F.count("*"), F.countDistinct("user")).first()[1:] == want.agg(F.countDistinct("user", "item"), F.countDistinct("user")).first()[:]
    assert given[0].agg(F.sum(F.col("rating") + 1)).first()[0] == want.agg(F.sum(F.col("rating") + 1)).first()[0]


def test_ties_are_hashed_together_and_meet_no_other_users(spark, monkeypatch):
    import hashlib

    from tidewell.operators import fullrank
    from tidewell.operators import md5

    digest = lambda u, i: hashlib.md5(f"t|{u}|{i}".encode()).digest()
    draw = random.Random(9)
    monkeypatch.setattr(md5, "FEW", 5)
    keys = sorted({draw.choice((draw.randrange(10), draw.randrange(10**6), draw.randrange(2**60), -draw.randrange(1000))) for _ in range(900)})
    held = md5.Keys(np.array(keys))
    assert len(held.by_length) > 4 and held.few
    for u in (7, 42, 123, 9999, 10**15, -5):
        for target in (keys[0], keys[-1], 77):
            assert held.ahead(b"t|%d|" % u, digest(u, target)) == sum(digest(u, k) < digest(u, target) for k in keys)

    score = {i: float(draw.choice((1, 2, 3, 5))) for i in range(60)}
    hidden = {u: draw.randrange(70) for u in range(30)}
    seen = {(u, i) for u in range(30) if u != 3 for i in draw.sample(range(70), 6) if i != hidden[u]}
    want = {}
    for u, target in hidden.items():
        open_ = [i for i in score if (u, i) not in seen]
        left = 70 - sum(w == u for w, _ in seen)
        if target in score:
            want[u] = 1 + sorted(open_, key=lambda i: (-score[i], digest(u, i))).index(target)
        else:
            want[u] = len(open_) + 1 + int(digest(u, target).hex()[:8], 16) % max(left - len(open_), 1)
    monkeypatch.setattr(fullrank, "TIED_USERS", 3)
    monkeypatch.setattr(fullrank, "TIED_ITEMS", 4)
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    ranks = fullrank.item_ranks(frame(hidden.items(), "user long, item long"), frame(seen, "user long, item long"), frame(score.items(), "item long, score double"), frame([(70,)], "n long"))
    assert {r["user"]: r["rank"] for r in ranks.collect()} == want


def test_full_ranks_hold_no_vector_for_each_purchase(spark, monkeypatch):
    from tidewell.operators import fullrank

    draw = random.Random(4)
    vectors = {k: [round(draw.uniform(-1, 1), 1) for _ in range(3)] for k in range(5)}
    users = {u: [round(draw.uniform(-1, 1), 1) for _ in range(3)] for u in range(25)}
    hidden, key = {u: draw.randrange(40) for u in users}, {i: i % 5 for i in range(40)}
    seen = {(u, i) for u in users for i in draw.sample(range(40), 6) if i != hidden[u]}
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    given = [frame(hidden.items(), "user long, item long"), frame(seen, "user long, item long"), frame(users.items(), "user long, u array<double>")]
    n, v = frame([(40,)], "n long"), "v array<double>"
    monkeypatch.setattr(fullrank, "ITEM_BLOCK", 3)
    plain = fullrank.factor_ranks(*given, frame([(i, vectors[k]) for i, k in key.items()], f"item long, {v}"), n)
    shared = fullrank.factor_ranks(*given, frame(key.items(), "item long, key long"), n, vectors=frame(vectors.items(), f"key long, {v}"))
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in shared.collect()}
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_factors_meet_pairs_in_cells_and_shuffles_are_freed(spark):
    from tidewell.operators import learned as L
    from tidewell.session import shuffles_freed

    draw = random.Random(8)
    hist = spark.createDataFrame([(u, i, draw.randrange(1, 6)) for u in range(12) for i in draw.sample(range(15), 5)], "user long, item long, rating int")
    pairs = spark.createDataFrame([(u, i) for u in range(14) for i in range(0, 17, 2)], "user long, item long")
    model = L._als(hist, 4, 3, 0.01)
    want = {(r["user"], r["item"]): r["prediction"] for r in model.transform(pairs).collect()}
    scores = L.als_scores(hist, pairs, 4, 3)
    got = {(r["user"], r["item"]): r["score"] for r in scores.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert "FlatMapCoGroupsInArrow" in scores._jdf.queryExecution().executedPlan().toString()
    collections = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = collections()
    with shuffles_freed(spark, 0.05):
        spark.range(10).repartition(3).count()
        import time

        time.sleep(0.5)
    assert collections() > before


def test_decomposition_collects_no_factors(spark, monkeypatch):
    from pyspark.mllib.linalg.distributed import SingularValueDecomposition as Decomposition

    from tidewell.operators import learned as L

    draw = random.Random(6)
    rating = {(u, i): draw.randrange(1, 6) for u in range(20) for i in draw.sample(range(14), 6)}
    matrix = np.zeros((20, 14))
    for (u, i), r in rating.items():
        matrix[u, i] = r
    u, s, v = np.linalg.svd(matrix)
    want = (u[:, :3] * s[:3]) @ v[:3]

    def collected(_):
        raise AssertionError("V came to the driver's Python process")

    monkeypatch.setattr(Decomposition, "V", property(collected))
    hist = spark.createDataFrame([(u, i, r) for (u, i), r in rating.items()], "user long, item long, rating int")
    pairs = spark.createDataFrame([(u, i) for u in range(21) for i in range(14)], "user long, item long")
    got = {(r["user"], r["item"]): r["score"] for r in L.svd_scores(hist, pairs, 3).collect()}
    assert len(got) == 20 * 14 and all(abs(got[p] - want[p]) < 1e-6 for p in got)


def test_boosting_runs_all_rounds_over_bins(spark, monkeypatch):
    from tidewell.operators import learned as L
    from tidewell.plans import learned as plans

    draw = random.Random(7)
    rows = [(draw.randrange(2), *[draw.random() for _ in L.FEATURES[:2]], draw.choice((0.1, 0.2)), 0.5, draw.randrange(40) / 10) for _ in range(600)]
    train = spark.createDataFrame(rows, "label int, " + ", ".join(f"{f} double" for f in L.FEATURES))
    cuts = L._cuts(L.distinct_rows(train))
    assert [len(cuts[f]) for f in L.FEATURES[2:4]] == [1, 0] and all(0 < len(cuts[f]) < L.BINS for f in (*L.FEATURES[:2], L.FEATURES[4]))
    sizes = [r["count"] for r in L._binned(train, cuts).groupBy(L.FEATURES[0]).count().collect()]
    assert len(sizes) == L.BINS and max(sizes) <= 2 * 600 / L.BINS

    seen = []
    fit = L.GBTClassifier.fit

    def short(self, df):
        seen.append((self.getMaxIter(), df.count()))
        return fit(self.setMaxIter(1), df)

    monkeypatch.setattr(L.GBTClassifier, "fit", short)
    from conftest import DATA

    assert plans.area.queries["rec12_boosted_metrics"](spark, DATA).count() == 1
    assert seen[0][0] == 200


def test_ranked_answers_meet_candidates_as_lists(spark):
    from conftest import DATA

    from tidewell import catalog
    from tidewell.operators import recommend as R

    candidates = spark.createDataFrame([(u, i) for u in (1, 2, 3, 4, 5) for i in (30, 10, 20)], "user long, item long")
    answers = spark.createDataFrame([(1, [20, 10]), (2, [20, 20]), (3, [20, 99]), (4, [30, 10, 20]), (6, [10])], "user long, ids array<long>")
    got = {tuple(r) for r in R.ranked_list_scores(answers, candidates).collect()}
    assert got == {(1, 20, 2.0, True), (1, 10, 1.0, True), (1, 30, 0.0, True), (4, 30, 2.0, False), (4, 10, 1.0, False), (4, 20, 0.0, False)}
    assert R.ranked_list_scores(spark.createDataFrame([(1, [])], "user long, ids array<long>"), candidates).count() == 0
    assert "Window" not in catalog.queries()["rec16_ranked_answers"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_keys_of_vectors_come_along_with_candidates(spark):
    from tidewell.operators import sampling as S

    items = spark.range(50).select(F.col("id").alias("item"), (F.col("id") % 7).alias("key"))
    split = spark.createDataFrame([(u, i, i == u * 3) for u in range(6) for i in (u * 3, u + 20, u + 30)] + [(9, 777, True), (9, 4, False)], "user long, item long, hidden boolean")
    plain = {tuple(r) for r in S.sampled_candidates(split, items, 12).collect()}
    kept = S.sampled_candidates(split, items, 12, keep=("key",)).collect()
    assert {(r["user"], r["item"], r["hidden"]) for r in kept} == plain and len(kept) == len(plain)
    assert all(r["key"] == (r["item"] % 7 if r["item"] < 50 else None) for r in kept)
