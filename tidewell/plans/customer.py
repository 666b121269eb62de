"""Queries on customers, orders and purchases: aggregates, windows, top-k, joins and sets."""

from __future__ import annotations

import inspect

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import customer as C
from tidewell.operators import purchases as P
from tidewell.operators import sampling as S
from tidewell.plans import sql as Q
from tidewell.plans.registry import Registry
from tidewell.session import table

area = Registry()


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("order_id"), "o_orderpriority", "o_orderstatus", "o_totalprice")


def _names(spark, d):
    """Purchases with the product's title, as reviews with a headline."""
    return P.purchase_rows(spark, d).join(P.catalog(spark, d).select("item", "title", "category"), "item")


NAMED = Q.ROWS + ", named AS (SELECT r.*, p_name AS title, p_type AS category FROM rows_ r JOIN part ON p_partkey = item)"


# ---- aggregates


@area.query(f"WITH {NAMED} SELECT user, count(DISTINCT item) AS items, sum(len(string_split(title, ' ')))::BIGINT AS words FROM named GROUP BY user")
def agg1_reviewer_stats(spark, d):
    return _names(spark, d).groupBy("user").agg(F.countDistinct("item").alias("items"), F.sum(F.size(F.split("title", " "))).alias("words"))


RFM_SQL = """ref AS (SELECT max(o_orderdate) AS reference FROM orders),
per AS (SELECT o_custkey AS user, epoch(min(o_orderdate)) AS f, epoch(max(o_orderdate)) AS l, count(*) AS n FROM orders {where} GROUP BY 1),
rfm AS (SELECT user, round((epoch(reference) - l) / 86400, 6) AS recency_days, round(n / greatest(greatest(l - f, 1) / (86400 * 30.4::DOUBLE), 1.0::DOUBLE), 6) AS frequency, n FROM per, ref)"""
STAGE_SQL = """CASE WHEN recency_days IS NULL THEN 'prospect' WHEN recency_days > 730 THEN 'churned'
WHEN recency_days > 365 THEN CASE WHEN frequency > 0.5 THEN 'win_back_candidate' ELSE 'churned' END
WHEN recency_days > 180 THEN 'at_risk' WHEN recency_days > 60 THEN 'active' WHEN frequency > 1 THEN 'loyal_active'
WHEN recency_days < 30 AND frequency > 0.3 THEN 'active' ELSE 'acquisition' END"""


def _reference(spark, d):
    return table(spark, d, "orders").agg(F.max("o_orderdate").alias("reference"))


@area.query("WITH " + RFM_SQL.format(where="") + " SELECT user, recency_days, frequency, n FROM rfm")
def agg2_rfm(spark, d):
    return C.rfm(_orders(spark, d), _reference(spark, d))


@area.query(
    "WITH " + RFM_SQL.format(where="WHERE o_orderdate < TIMESTAMP '1999-01-01'")
    + f" SELECT c_custkey AS user, {STAGE_SQL} AS stage FROM customer LEFT JOIN rfm ON user = c_custkey"
)
def agg3_lifecycle(spark, d):
    known = C.rfm(_orders(spark, d).where("ts < timestamp'1999-01-01'"), _reference(spark, d))
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return everyone.join(known, "user", "left").select("user", C.lifecycle(F.col("recency_days"), F.col("frequency")).alias("stage"))


STOP = ["the", "and", "der", "die", "und", "les", "des", "que", "los", "una"]


@area.query(
    f"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{{3,}}')) AS word FROM documents),
c AS (SELECT source, word, count(*) AS n_word FROM w WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP)}) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_word DESC, word) AS rank FROM c) WHERE rank <= 20"""
)
def agg4_frequent_words(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    return C.frequent_words(table(spark, d, "documents"), "source", "text", stop)


@area.query(
    """WITH e AS (SELECT source, doc_id // 2 AS k FROM documents WHERE doc_id % 2 = 0), t AS (SELECT doc_id // 2 AS k FROM documents WHERE doc_id % 2 = 1 AND lang <> 'fr'),
j AS (SELECT e.source, count(*) AS n_en, count(t.k) AS n_tr FROM e LEFT JOIN t ON e.k = t.k GROUP BY 1)
SELECT source, n_en, n_tr, n_en - n_tr AS lost, round((n_en - n_tr) / n_en::DOUBLE, 4) AS loss_ratio FROM j"""
)
def agg5_translation_coverage(spark, d):
    docs = table(spark, d, "documents").withColumn("k", F.floor(F.col("doc_id") / 2))
    en, tr = docs.where("doc_id % 2 = 0").select("source", "k"), docs.where("doc_id % 2 = 1 AND lang <> 'fr'").select("k", F.lit(1).alias("has"))
    counts = en.join(tr, "k", "left").groupBy("source").agg(F.count("*").alias("n_en"), F.count("has").alias("n_tr"))
    lost = F.col("n_en") - F.col("n_tr")
    return counts.withColumn("lost", lost).withColumn("loss_ratio", F.round(lost / F.col("n_en"), 4))


@area.query(
    f"""WITH {Q.SPLIT}, per AS (SELECT item, count(*) AS c FROM inter GROUP BY item),
hb AS (SELECT h.item, count(t.user) AS c FROM hid h LEFT JOIN hist t ON t.item = h.item GROUP BY h.item, h.user),
u AS (SELECT user, count(*) AS n FROM hist GROUP BY user),
last_ AS (SELECT user, count(*) FILTER (ts = mx) AS k FROM (SELECT user, ts, max(ts) OVER (PARTITION BY user) AS mx FROM inter) GROUP BY user)
SELECT round(100.0::DOUBLE * (SELECT count(*) FROM inter) / ((SELECT count(DISTINCT user) FROM inter) * (SELECT count(*) FROM part)), 6) AS density,
 (SELECT count(*) FROM per WHERE c = 1) AS single_buyer_items, (SELECT quantile_cont(c, 0.5) FROM per)::DOUBLE AS median_buyers,
 (SELECT count(*) FROM hb WHERE c = 0) AS cold, (SELECT count(*) FROM hb WHERE c = 1) AS one, (SELECT count(*) FROM hb WHERE c BETWEEN 2 AND 4) AS few, (SELECT count(*) FROM hb WHERE c >= 5) AS many,
 (SELECT count(*) FROM last_ WHERE k > 1) AS last_day_ties, (SELECT min(n) FROM u) AS history_min, (SELECT quantile_cont(n, 0.5) FROM u)::DOUBLE AS history_median, (SELECT max(n) FROM u) AS history_max"""
)
def agg6_data_facts(spark, d):
    inter = P.interactions(spark, d)
    split = P.leave_one_out(inter)
    hist, hid = P.history(split), P.hidden(split)
    buyers = inter.groupBy("item").agg(F.count("*").alias("c"))
    sold = hist.groupBy("item").agg(F.count("*").alias("c"))
    bucket = hid.join(sold, "item", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    sizes = hist.groupBy("user").agg(F.count("*").alias("n"))
    newest = inter.groupBy("user", "ts").agg(F.count("*").alias("k")).groupBy("user").agg(F.max_by("k", "ts").alias("k"))
    rows = inter.agg(F.count("*").alias("rows"), F.countDistinct("user").alias("users"))
    parts = table(spark, d, "part").agg(F.count("*").alias("parts"))
    one = rows.crossJoin(parts).select(F.round(100.0 * F.col("rows") / (F.col("users") * F.col("parts")), 6).alias("density"))
    for facts in (
        buyers.agg(F.count_if(F.col("c") == 1).alias("single_buyer_items"), F.expr("percentile(c, 0.5)").alias("median_buyers")),
        bucket.agg(F.count_if(F.col("c") == 0).alias("cold"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c").between(2, 4)).alias("few"), F.count_if(F.col("c") >= 5).alias("many")),
        newest.agg(F.count_if(F.col("k") > 1).alias("last_day_ties")),
        sizes.agg(F.min("n").alias("history_min"), F.expr("percentile(n, 0.5)").alias("history_median"), F.max("n").alias("history_max")),
    ):
        one = one.crossJoin(facts)  # one row each
    return one


@area.query(
    f"""WITH {Q.SPLIT}, s AS (SELECT item, count(*) AS c FROM hist GROUP BY item), b AS (SELECT coalesce(s.c, 0) AS c FROM hid LEFT JOIN s USING (item))
SELECT CASE WHEN c = 0 THEN '0' WHEN c < 5 THEN '1-4' ELSE '5+' END AS bucket, count(*) AS n FROM b GROUP BY 1"""
)
def agg7_population_buckets(spark, d):
    split = P.leave_one_out(P.interactions(spark, d))
    sold = P.history(split).groupBy("item").agg(F.count("*").alias("c"))
    c = F.coalesce("c", F.lit(0))
    return P.hidden(split).join(sold, "item", "left").groupBy(F.when(c == 0, "0").when(c < 5, "1-4").otherwise("5+").alias("bucket")).agg(F.count("*").alias("n"))


@area.query(
    """SELECT coalesce(c_mktsegment, 'all') AS grp, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi
FROM customer GROUP BY ROLLUP (c_mktsegment)"""
)
def agg8_trait_summary(spark, d):
    x = F.col("c_acctbal")
    rolled = table(spark, d, "customer").rollup("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return rolled.withColumn("grp", F.coalesce("c_mktsegment", F.lit("all"))).drop("c_mktsegment")


@area.query(
    """WITH p AS (SELECT o_custkey AS user, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT count(*) AS n, round(avg(abs(a - r)), 4) AS mean_abs, round(avg(a - r), 4) AS mean_diff, round(max(abs(a - r)), 4) AS max_abs FROM p WHERE a IS NOT NULL AND r IS NOT NULL"""
)
def agg9_profile_drift(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    side = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy("o_custkey").agg(F.avg("l_quantity").alias(flag))
    diff = F.col("A") - F.col("R")
    return side("A").join(side("R"), "o_custkey").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(diff)), 4).alias("mean_abs"), F.round(F.avg(diff), 4).alias("mean_diff"), F.round(F.max(F.abs(diff)), 4).alias("max_abs")
    )


@area.query(
    """SELECT o_orderpriority AS level, count(*) AS requested, count(*) FILTER (o_orderstatus = 'F') AS generated, count(*) FILTER (o_orderstatus = 'O') AS skipped_open,
count(*) FILTER (o_orderstatus = 'P') AS skipped_pending, round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0)::DOUBLE, 4) AS acceptance FROM orders GROUP BY 1"""
)
def agg10_run_summary(spark, d):
    done = F.col("o_orderstatus") == "F"
    return _orders(spark, d).groupBy(F.col("o_orderpriority").alias("level")).agg(
        F.count("*").alias("requested"),
        F.count_if(done).alias("generated"),
        F.count_if(F.col("o_orderstatus") == "O").alias("skipped_open"),
        F.count_if(F.col("o_orderstatus") == "P").alias("skipped_pending"),
        F.round(F.try_divide(F.count_if(done & (F.col("o_totalprice") > 100000)).cast("double"), F.count_if(done).cast("double")), 4).alias("acceptance"),
    )


JUDGES_SQL = """v AS (SELECT lang, quality = 1 AS a, n_chars > 1000 AS b FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, CASE WHEN a AND b THEN 'VALID' WHEN a OR b THEN 'PARTIAL' ELSE 'HUMAN' END AS state FROM v)"""


@area.query(
    f"""WITH {JUDGES_SQL} SELECT coalesce(lang, 'total') AS level, count(*) AS n, count(*) FILTER (state = 'VALID') AS valid, count(*) FILTER (state = 'PARTIAL') AS part, count(*) FILTER (state = 'HUMAN') AS human,
count(*) FILTER (a = b) AS agree, round(avg((a = b)::INT), 4) AS agree_rate FROM s GROUP BY ROLLUP (lang)"""
)
def agg11_judge_summary(spark, d):
    v = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("a"), (F.col("n_chars") > 1000).alias("b"))
    a, b = F.col("a"), F.col("b")
    rolled = v.rollup("lang").agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("valid"), F.count_if(a != b).alias("part"), F.count_if(~a & ~b).alias("human"),
        F.count_if(a == b).alias("agree"), F.round(F.avg((a == b).cast("int")), 4).alias("agree_rate"),
    )
    return rolled.withColumn("level", F.coalesce("lang", F.lit("total"))).drop("lang")


@area.query("SELECT lang AS level, count(quality) AS n, round(avg(quality), 4) AS mean_quality, round(avg(n_chars), 4) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg12_metrics_per_level(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy(F.col("lang").alias("level")).agg(F.count("quality").alias("n"), F.round(F.avg("quality"), 4).alias("mean_quality"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@area.query(
    """WITH s AS (SELECT event_type AS grp, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT grp, any_value(n) AS n, sum(x * greatest(0, 1 - abs(k - least(greatest(0.1::DOUBLE * (n + 1), 1), n)))) AS p10, sum(x * greatest(0, 1 - abs(k - least(greatest(0.9::DOUBLE * (n + 1), 1), n)))) AS p90,
 avg(x) AS mean, median(x) AS median, min(x) AS lo, max(x) AS hi, avg((x < 10)::INT) AS low FROM s GROUP BY grp)
SELECT grp, n, round(mean, 4) AS mean, round(median, 4) AS median, round(p10, 4) AS p10, round(p90, 4) AS p90, lo, hi, round(low, 4) AS low_share FROM q"""
)
def agg13_score_distribution(spark, d):
    """Exclusive quantiles: position p (n + 1), interpolated; the two neighbours of a position share its weight."""
    w = Window.partitionBy("event_type").orderBy("value")
    s = table(spark, d, "events").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("event_type")))
    at = lambda p: F.sum(F.col("value") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("k") - F.least(F.greatest(F.lit(p) * (F.col("n") + 1), F.lit(1.0)), F.col("n").cast("double")))))
    return s.groupBy(F.col("event_type").alias("grp")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.expr("percentile(value, 0.5)"), 4).alias("median"), F.round(at(0.1), 4).alias("p10"), F.round(at(0.9), 4).alias("p90"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg((F.col("value") < 10).cast("int")), 4).alias("low_share"),
    )


@area.query("SELECT count(*) AS n, round(avg(abs(n_chars - length(text))), 4) AS mean_abs, max(abs(n_chars - length(text))) AS max_abs, count(*) FILTER (abs(n_chars - length(text)) > 0.01) AS differ FROM documents JOIN labels USING (doc_id)")
def agg14_score_check(spark, d):
    diff = F.abs(F.col("n_chars") - F.length("text"))
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id").agg(
        F.count("*").alias("n"), F.round(F.avg(diff), 4).alias("mean_abs"), F.max(diff).alias("max_abs"), F.count_if(diff > 0.01).alias("differ")
    )


@area.query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def agg15_latency(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.expr("percentile(value, 0.5)"), 4).alias("p50"), F.round(F.expr("percentile(value, 0.95)"), 4).alias("p95")
    )


@area.query("SELECT c_nationkey AS voice, c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median FROM customer GROUP BY GROUPING SETS ((), (c_nationkey), (c_mktsegment))")
def agg16_segment_statistics(spark, d):
    c = table(spark, d, "customer").withColumnsRenamed({"c_nationkey": "voice", "c_mktsegment": "segment"})
    grouped = c.groupingSets([[], [F.col("voice")], [F.col("segment")]], F.col("voice"), F.col("segment"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.expr("percentile(c_acctbal, 0.5)"), 4).alias("median"))


@area.query("SELECT p_type AS subtype, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS accepted, count(*) FILTER (l_returnflag = 'R') AS rejected, count(*) FILTER (l_returnflag = 'N') AS open_ FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def agg18_calibration(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    wide = joined.groupBy(F.col("p_type").alias("subtype")).pivot("l_returnflag", ["A", "R", "N"]).count().na.fill(0)
    return wide.select("subtype", (F.col("A") + F.col("R") + F.col("N")).alias("n"), F.col("A").alias("accepted"), F.col("R").alias("rejected"), F.col("N").alias("open_"))


@area.query(
    """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS c FROM orders GROUP BY 1 HAVING count(*) >= 200), l AS (SELECT max(y) AS y FROM y)
SELECT o_orderpriority AS priority, o_orderstatus AS status, any_value(l.y) AS year, count(*) AS n FROM orders JOIN l ON year(o_orderdate) = l.y GROUP BY 1, 2"""
)
def agg19_latest_full_year(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    latest = orders.groupBy("year").count().where("count >= 200").agg(F.max("year").alias("year"))
    return orders.join(F.broadcast(latest), "year", "left_semi").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "year").agg(F.count("*").alias("n"))


@area.query(
    """WITH n AS (SELECT n_nationkey, n_regionkey, regexp_extract(n_name, '_([0-9]+)$', 1) AS code FROM nation), s AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1),
r AS (SELECT n_regionkey, max(c) AS c FROM n JOIN s ON s_nationkey = n_nationkey GROUP BY 1)
SELECT code, r_name AS region, coalesce(s.c, r.c, 0) AS suppliers, s.c IS NULL AS fallback FROM n JOIN region ON r_regionkey = n_regionkey LEFT JOIN s ON s_nationkey = n_nationkey LEFT JOIN r ON r.n_regionkey = n.n_regionkey"""
)
def agg20_hierarchy_with_fallback(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.regexp_extract("n_name", "_([0-9]+)$", 1).alias("code"))
    own = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("own"))
    region = nation.join(own, "n_nationkey").groupBy("n_regionkey").agg(F.max("own").alias("region_most"))
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    joined = nation.join(names, "n_regionkey").join(own, "n_nationkey", "left").join(region, "n_regionkey", "left")
    return joined.select("code", "region", F.coalesce("own", "region_most", F.lit(0)).alias("suppliers"), F.col("own").isNull().alias("fallback"))


@area.query("SELECT p_brand || '/' || p_type AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 30")
def agg21_category_vocabulary(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "category").limit(30)


@area.query(
    f"""WITH {NAMED}, c AS (SELECT user, category, count(*) AS n FROM named GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY n DESC, category) AS k FROM c) WHERE k <= 3),
m AS (SELECT user, round(avg(rating), 4) AS mean_rating FROM named GROUP BY user)
SELECT c_custkey AS user, coalesce(string_agg(category, ',' ORDER BY k), '') AS top_categories, coalesce(any_value(mean_rating), 3.0) AS mean_rating FROM customer LEFT JOIN t ON t.user = c_custkey LEFT JOIN m ON m.user = c_custkey GROUP BY 1"""
)
def agg22_top_categories(spark, d):
    named = _names(spark, d)
    counts = named.groupBy("user", "category").agg(F.count("*").alias("n"))
    top = C.top_per(counts, "user", [F.col("n").desc(), F.col("category")], 3, "k")
    joined = top.groupBy("user").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "category"))), lambda x: x["category"]), ",").alias("top_categories"))
    rating = named.groupBy("user").agg(F.round(F.avg("rating"), 4).alias("mean_rating"))
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return everyone.join(joined, "user", "left").join(rating, "user", "left").select("user", F.coalesce("top_categories", F.lit("")).alias("top_categories"), F.coalesce("mean_rating", F.lit(3.0)).alias("mean_rating"))


CUES_SQL = r"""w AS (SELECT conv_id, lower(regexp_extract(text, '^[A-Za-zÀ-ÿ]{2,}')) AS w, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS c FROM conversations),
m AS (SELECT conv_id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL), b AS (SELECT conv_id, w FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, w) AS k FROM m) WHERE k = 1),
x AS (SELECT conv_id, sum(len(list_filter(c, lambda y: y = 'the')))::BIGINT AS cue_m, sum(len(list_filter(c, lambda y: y = 'die')))::BIGINT AS cue_f FROM w GROUP BY 1),
g AS (SELECT x.conv_id, CASE WHEN ends_with(w, 'e') THEN 'f' WHEN ends_with(w, 'n') THEN 'm' END AS by_name, CASE WHEN cue_m > cue_f THEN 'm' WHEN cue_f > cue_m THEN 'f' END AS by_cue, cue_m, cue_f FROM x LEFT JOIN b ON b.conv_id = x.conv_id)"""


def _gender(spark, d):
    """Modal first word against name lists (here by ending), cue counts, and the two verdicts side by side."""
    conv = table(spark, d, "conversations").select("conv_id", F.lower(F.regexp_extract("text", "^[A-Za-zÀ-ÿ]{2,}", 0)).alias("w"), F.lower("text").alias("t"))
    modal = conv.where("w <> ''").groupBy("conv_id", "w").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "w")).alias("best"))
    said = F.regexp_extract_all("t", F.lit("[a-zà-ÿ]+"), 0)
    often = lambda cue: F.sum(F.size(F.filter(said, lambda w: w == cue))).cast("long")
    cues = conv.groupBy("conv_id").agg(often("the").alias("cue_m"), often("die").alias("cue_f"))
    w = F.col("best.w")
    return cues.join(modal, "conv_id", "left").select(
        "conv_id", F.when(w.endswith("e"), "f").when(w.endswith("n"), "m").alias("by_name"),
        F.when(F.col("cue_m") > F.col("cue_f"), "m").when(F.col("cue_f") > F.col("cue_m"), "f").alias("by_cue"), "cue_m", "cue_f",
    )


@area.query(f"WITH {CUES_SQL} SELECT conv_id, by_name, by_cue, cue_m, cue_f, CASE WHEN by_name <> by_cue THEN NULL ELSE coalesce(by_name, by_cue) END AS gender FROM g")
def agg23_gender_inference(spark, d):
    return _gender(spark, d).withColumn("gender", F.when(F.coalesce(F.col("by_name") != F.col("by_cue"), F.lit(False)), None).otherwise(F.coalesce("by_name", "by_cue")))


@area.query(f"WITH {CUES_SQL} SELECT count(*) AS n, count(*) FILTER (by_name IS NOT NULL AND by_cue IS NOT NULL) AS both_known, count(*) FILTER (by_name = by_cue) AS agree, count(*) FILTER (by_name <> by_cue) AS conflict FROM g")
def agg24_gender_counts(spark, d):
    a, b = F.col("by_name"), F.col("by_cue")
    return _gender(spark, d).agg(F.count("*").alias("n"), F.count_if(a.isNotNull() & b.isNotNull()).alias("both_known"), F.count_if(a == b).alias("agree"), F.count_if(a != b).alias("conflict"))


@area.query("SELECT kind, count(*) AS n FROM (SELECT 'rs' AS kind FROM lineitem UNION ALL SELECT 'rt' FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT 'pt' FROM (SELECT DISTINCT l_partkey FROM lineitem)) GROUP BY kind")
def agg25_queue_statistics(spark, d):
    lines = table(spark, d, "lineitem")
    kinds = lines.select(F.lit("rs").alias("kind")).union(lines.where("l_quantity > 10").select(F.lit("rt"))).union(lines.select("l_partkey").distinct().select(F.lit("pt")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@area.query("SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors, round(avg((get_first <= 10)::INT), 4) AS first_try, round(avg(get_first), 4) AS attempts FROM (SELECT *, (props->>'k')::INT AS get_first FROM events)")
def agg26_live_check(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    bad = F.col("event_type") == "error"
    return e.agg(F.count("*").alias("n"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("errors"), F.round(F.avg((F.col("k") <= 10).cast("int")), 4).alias("first_try"), F.round(F.avg("k"), 4).alias("attempts"))


@area.query("SELECT defect, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'old_segment' END, CASE WHEN c_custkey % 10 = 0 THEN 'round_key' END], lambda x: x IS NOT NULL)) AS defect FROM customer) GROUP BY 1")
def agg27_defect_profile(spark, d):
    flags = F.array(F.when(F.col("c_acctbal") < 0, "negative_balance"), F.when(F.col("c_mktsegment") == "MACHINERY", "old_segment"), F.when(F.col("c_custkey") % 10 == 0, "round_key"))
    return table(spark, d, "customer").select(F.explode(F.array_compact(flags)).alias("defect")).groupBy("defect").agg(F.count("*").alias("n"))


@area.query("SELECT c_mktsegment AS grp, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS position, c_custkey AS user, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS profile, CASE WHEN c_acctbal >= 0 THEN 'own' ELSE 'missing' END AS origin FROM customer")
def agg28_profile_projection(spark, d):
    ok = F.col("c_acctbal") >= 0
    position = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), position.alias("position"), F.col("c_custkey").alias("user"), F.when(ok, F.col("c_acctbal")).alias("profile"), F.when(ok, "own").otherwise("missing").alias("origin"))


@area.query(
    """WITH a AS (SELECT l_returnflag AS arm, count(*) AS n, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median, stddev_pop(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1)
SELECT arm, n, round(mean, 2) AS mean, round(median, 4) AS median, round(sd, 2) AS sd, lo, hi, round((SELECT max(mean) FILTER (arm = 'A') - max(mean) FILTER (arm = 'R') FROM a), 2) AS delta FROM a"""
)
def agg29_two_arms(spark, d):
    x = F.col("l_extendedprice")
    arms = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy(F.col("l_returnflag").alias("arm")).agg(
        F.count("*").alias("n"), F.avg(x).alias("m"), F.round(F.expr("percentile(l_extendedprice, 0.5)"), 4).alias("median"), F.round(F.stddev_pop(x), 2).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )
    delta = arms.agg(F.round(F.max(F.when(F.col("arm") == "A", F.col("m"))) - F.max(F.when(F.col("arm") == "R", F.col("m"))), 2).alias("delta"))
    return arms.crossJoin(F.broadcast(delta)).withColumn("mean", F.round("m", 2)).drop("m")  # two rows and one


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id"}


@area.query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, sum(('0x' || substr(md5({k}::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest FROM {t}" for t, k in KEYS.items()))
def agg30_table_manifest(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n"), F.sum(S.draw(F.col(k).cast("string"))).alias("digest")).select(F.lit(t).alias("table_name"), "n", "digest") for t, k in KEYS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# ---- windows and top-k


@area.query(f"WITH {Q.SPLIT} SELECT user, item, n, hidden FROM split_")
def win1_leave_one_out(spark, d):
    return P.leave_one_out(P.interactions(spark, d)).select("user", "item", "n", "hidden")


NEWEST = "ORDER BY ts DESC, order_id DESC, line_no DESC, item DESC, price DESC, rating DESC"


def _newest():
    return [F.desc(c) for c in ("ts", "order_id", "line_no", "item", "price", "rating")]


@area.query(
    f"""WITH {NAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY user {NEWEST}) AS pos FROM named)
SELECT user, string_agg('[' || rating || '] ' || title, ';' ORDER BY pos) AS headlines FROM k WHERE pos <= 6 AND category <> 'ECONOMY' GROUP BY user"""
)
def win2_last_headlines(spark, d):
    """Blank headlines (here: of one category) are dropped after the cut to six."""
    last = C.top_per(_names(spark, d), "user", _newest(), 6, "pos").where("category <> 'ECONOMY'")
    line = F.struct("pos", F.concat(F.lit("["), F.col("rating").cast("string"), F.lit("] "), "title").alias("line"))
    return last.groupBy("user").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), ";").alias("headlines"))


@area.query("SELECT source, substr(arg_max(text, {'n': length(text), 'd': -doc_id}), 1, 600) AS body, arg_max(doc_id, {'n': length(text), 'd': -doc_id}) AS doc_id FROM documents WHERE NOT regexp_matches(text, '[|#]') GROUP BY source")
def win3_longest_text(spark, d):
    best = F.struct(F.length("text"), -F.col("doc_id"))
    return table(spark, d, "documents").where("NOT text RLIKE '[|#]'").groupBy("source").agg(F.substring(F.max_by("text", best), 1, 600).alias("body"), F.max_by("doc_id", best).alias("doc_id"))


@area.query(
    f"""WITH {NAMED}, k AS (SELECT user, title, row_number() OVER (PARTITION BY user {NEWEST}) AS pos FROM named),
u AS (SELECT *, sum(length(title) + 1) OVER (PARTITION BY user ORDER BY pos) AS used FROM k)
SELECT user, pos, CASE WHEN used <= 100 THEN title ELSE substr(title, 1, (100 - used + length(title) + 1)::BIGINT) END AS title FROM u WHERE used - length(title) - 1 < 100"""
)
def win4_character_budget(spark, d):
    return C.character_budget(_names(spark, d), "user", _newest(), "title", 100).select("user", "pos", "title")


@area.query(f"WITH {NAMED} SELECT user, printf('H%02d', row_number() OVER (PARTITION BY user {NEWEST})) AS line_id, title FROM named QUALIFY row_number() OVER (PARTITION BY user {NEWEST}) <= 20")
def win5_history_lines(spark, d):
    return C.top_per(_names(spark, d), "user", _newest(), 20, "k").select("user", F.format_string("H%02d", "k").alias("line_id"), "title")


@area.query(f"WITH {Q.INTER}, m AS (SELECT user, ts, max(ts) OVER (PARTITION BY user) AS mx FROM inter) SELECT count(*) AS users_with_ties FROM (SELECT user FROM m WHERE ts = mx GROUP BY user HAVING count(*) > 1)")
def win6_last_day_ties(spark, d):
    per_day = P.interactions(spark, d).groupBy("user", "ts").agg(F.count("*").alias("k"))
    return per_day.groupBy("user").agg(F.max_by("k", "ts").alias("k")).agg(F.count_if(F.col("k") > 1).alias("users_with_ties"))


@area.query(f"WITH {Q.INTER} SELECT user, item FROM inter QUALIFY row_number() OVER (PARTITION BY user ORDER BY ts DESC, order_id DESC, line_no DESC, item DESC) = 1")
def win7_latest_item(spark, d):
    return P.interactions(spark, d).groupBy("user").agg(F.max_by("item", F.struct("ts", "order_id", "line_no", "item")).alias("item"))


@area.query(
    f"""WITH {Q.INTER}, m AS (SELECT user, item, price, min(price) OVER (PARTITION BY user) AS lo, max(price) OVER (PARTITION BY user) AS hi FROM inter)
SELECT user, item, round((price - lo) / CASE WHEN hi - lo <= 1e-9 THEN 1 ELSE hi - lo END, 6) AS scaled FROM m"""
)
def win8_minmax(spark, d):
    w = Window.partitionBy("user")
    lo, hi = F.min("price").over(w), F.max("price").over(w)
    return P.interactions(spark, d).select("user", "item", F.round((F.col("price") - lo) / F.when(hi - lo <= 1e-9, 1.0).otherwise(hi - lo), 6).alias("scaled"))


@area.query(
    """WITH u AS (SELECT c_custkey AS user, CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END AS grp FROM customer), p AS (SELECT s_suppkey AS partner, s_nationkey AS grp FROM supplier),
ku AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(user::VARCHAR), user) AS k FROM u WHERE grp IS NOT NULL), kp AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(partner::VARCHAR), partner) AS k FROM p),
a AS (SELECT user, partner, 'group' AS how FROM ku JOIN kp USING (grp, k)),
u2 AS (SELECT user, row_number() OVER (ORDER BY md5(user::VARCHAR), user) AS k FROM u WHERE grp IS NULL), p2 AS (SELECT partner, row_number() OVER (ORDER BY md5(partner::VARCHAR), partner) AS k FROM p WHERE partner NOT IN (SELECT partner FROM a)),
b AS (SELECT user, partner, 'unknown' AS how FROM u2 JOIN p2 USING (k)), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
u3 AS (SELECT user, row_number() OVER (ORDER BY md5(user::VARCHAR), user) AS k FROM u WHERE user NOT IN (SELECT user FROM ab)), p3 AS (SELECT partner, row_number() OVER (ORDER BY md5(partner::VARCHAR), partner) AS k FROM p WHERE partner NOT IN (SELECT partner FROM ab))
SELECT * FROM ab UNION ALL SELECT user, partner, 'left over' FROM u3 JOIN p3 USING (k)"""
)
def win9_pairing(spark, d):
    """Three passes: by group, then users of unknown group, then whoever is left over; a fifth of the groups is unknown."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")).alias("grp"))
    partners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("partner"), F.col("s_nationkey").alias("grp"))
    done = C.pair_within(users.where("grp IS NOT NULL"), partners, "user", "partner", "grp").select("user", "partner", F.lit("group").alias("how"))
    for left, how in ((users.where("grp IS NULL"), "unknown"), (users, "left over")):
        rest = left.join(done, "user", "left_anti").select("user")
        free = partners.join(done, "partner", "left_anti").select("partner")
        done = done.union(C.pair_within(rest, free, "user", "partner").select("user", "partner", F.lit(how)))
    return done


@area.query(
    """WITH c AS (SELECT c_custkey AS user, c_mktsegment AS cell, c_acctbal >= 0 AS linked FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY cell, linked ORDER BY user % 2 DESC, user) AS k FROM c)
SELECT cell, linked, user FROM k WHERE k <= CASE WHEN linked THEN 3 ELSE 1 END"""
)
def win10_cell_pick(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("cell"), (F.col("c_acctbal") >= 0).alias("linked"))
    ranked = users.withColumn("k", F.row_number().over(Window.partitionBy("cell", "linked").orderBy((F.col("user") % 2).desc(), "user")))
    return ranked.where(F.col("k") <= F.when(F.col("linked"), 3).otherwise(1)).select("cell", "linked", "user")


@area.query("SELECT event_type AS method, arg_max(event_id, {'v': value, 'i': event_id}) AS run_of_record, max(value) AS completeness FROM events WHERE (props->>'k')::INT >= 10 GROUP BY 1")
def win11_run_of_record(spark, d):
    runs = table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("int") >= 10)
    return runs.groupBy(F.col("event_type").alias("method")).agg(F.max_by("event_id", F.struct("value", "event_id")).alias("run_of_record"), F.max("value").alias("completeness"))


@area.query(
    f"""WITH {NAMED}, u AS (SELECT user, count(DISTINCT item) AS items, sum(len(string_split(title, ' ')))::BIGINT AS words FROM named GROUP BY user),
a AS (SELECT *, 'A' AS grp FROM u WHERE items >= 5 ORDER BY items DESC, user LIMIT 50), l AS (SELECT * FROM u WHERE user NOT IN (SELECT user FROM a)),
b AS (SELECT *, 'B' AS grp FROM l WHERE items >= 5 AND words > 100 ORDER BY words DESC, user LIMIT 40), m AS (SELECT * FROM l WHERE user NOT IN (SELECT user FROM b)),
c AS (SELECT *, 'C' AS grp FROM m ORDER BY items, user LIMIT 30) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""
)
def top1_stratification(spark, d):
    return C.stratify(agg1_reviewer_stats(spark, d), 50, 40, 30)


@area.query("SELECT user, order_id FROM (SELECT o_custkey AS user, o_orderkey AS order_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 10")
def top2_newest_orders(spark, d):
    return C.top_per(_orders(spark, d), "user", [F.desc("ts"), F.desc("order_id")], 10).select("user", "order_id")


@area.query("SELECT source, doc_id, substr(text, 1, 600) AS body FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 15")
def top3_most_helpful(spark, d):
    return C.top_per(table(spark, d, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 15).select("source", "doc_id", F.substring("text", 1, 600).alias("body"))


@area.query(f"WITH {Q.CANDIDATES} SELECT user, item, hidden FROM cand")
def top5_sampled_negatives(spark, d):
    return S.sampled_candidates(P.leave_one_out(P.interactions(spark, d)), P.catalog(spark, d))


@area.query("SELECT c_mktsegment AS grp, c_custkey AS user FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey % 50 <> 0), CASE WHEN c_custkey % 50 = 0 THEN c_custkey END, md5('s|' || c_custkey), c_custkey) AS k FROM customer) WHERE k <= 20")
def top6_quota_sample(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("grp"))
    return S.quota_sample(users, "grp", "user", F.col("user") % 50 == 0, 20, "s").select("grp", "user")


@area.query(f"WITH {Q.CANDIDATES} SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY md5('p|' || user || '|' || item), item) AS position FROM cand")
def top8_candidate_shuffle(spark, d):
    candidates = S.sampled_candidates(P.leave_one_out(P.interactions(spark, d)), P.catalog(spark, d))
    return S.shuffled(candidates, "user", "item", "p").select("user", "item", "position")


@area.query(
    f"""WITH {Q.CANDIDATES}, s AS (SELECT avg(n)::DOUBLE AS n FROM (SELECT user, count(*) AS n FROM cand GROUP BY user))
SELECT k, round(k / (SELECT count(*) FROM part)::DOUBLE, 6) AS full_floor, round(k / n, 6) AS sampled_floor FROM (VALUES (5), (10)) t(k), s"""
)
def top9_random_floor(spark, d):
    """Hit rate of guessing, over the catalogue and over the candidates that the sampler draws by default, the hidden item among them."""
    n = P.catalog(spark, d).agg(F.count("*").alias("n"))
    ks = spark.createDataFrame([(5,), (10,)], "k int").crossJoin(n)
    drawn = inspect.signature(S.sampled_candidates).parameters["n"].default + 1
    return ks.select("k", F.round(F.col("k") / F.col("n"), 6).alias("full_floor"), F.round(F.col("k") / F.least(F.col("n"), F.lit(float(drawn))), 6).alias("sampled_floor"))


@area.query("SELECT doc_id FROM documents d WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def top10_judging_queue(spark, d):
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").where("text <> ''").join(done, "doc_id", "left_anti").select("doc_id")


@area.query(
    """WITH e AS (SELECT event_id, ('0x' || substr(md5('hot|' || event_id), 1, 8))::BIGINT % 1000 AS p, ('0x' || substr(md5('hot-pick|' || event_id), 1, 8))::BIGINT AS x FROM events)
SELECT event_id, CASE WHEN p < 450 THEN x % 8 WHEN p < 800 THEN 8 + x % 25 ELSE x % 100 END AS target, CASE WHEN p < 450 THEN 'hot' WHEN p < 800 THEN 'warm' ELSE 'any' END AS tier FROM e"""
)
def top11_skewed_assignment(spark, d):
    return S.hot_warm_assignment(table(spark, d, "events").select("event_id"), "event_id", 100)


# ---- joins


@area.query(f"WITH {NAMED} SELECT user, item, title, rating, strftime(ts, '%Y-%m-%d') AS day FROM named JOIN customer ON c_custkey = user")
def jn1_reviews(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return _names(spark, d).join(users, "user").select("user", "item", "title", "rating", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@area.query(
    "WITH " + RFM_SQL.format(where="WHERE o_orderdate < TIMESTAMP '1999-01-01'")
    + f" SELECT c_custkey AS user, c_name AS name, n_name AS employer, {STAGE_SQL} AS stage FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN rfm ON user = c_custkey"
)
def jn2_contact_360(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    employer = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("employer"))
    return users.join(employer, "n_nationkey", "left").join(agg3_lifecycle(spark, d), "user", "left").select("user", "name", "employer", "stage")


@area.query("SELECT c_custkey AS user, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS notes, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
def jn3_contact_summary(spark, d):
    notes = table(spark, d, "events").groupBy(F.col("user_id").alias("user")).agg(F.count("*").alias("n"))
    last = _orders(spark, d).groupBy("user").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_order"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return users.join(notes, "user", "left").join(last, "user", "left").select("user", F.coalesce("n", F.lit(0)).alias("notes"), "last_order")


@area.query("SELECT e.doc_id // 2 AS k, e.doc_id AS en_id, t.doc_id AS tr_id, t.n_chars AS tr_chars FROM documents e LEFT JOIN documents t ON t.doc_id = e.doc_id + 1 AND t.lang <> 'fr' WHERE e.doc_id % 2 = 0")
def jn4_two_layers(spark, d):
    docs = table(spark, d, "documents").withColumn("k", F.floor(F.col("doc_id") / 2))
    en = docs.where("doc_id % 2 = 0").select("k", F.col("doc_id").alias("en_id"))
    tr = docs.where("doc_id % 2 = 1 AND lang <> 'fr'").select("k", F.col("doc_id").alias("tr_id"), F.col("n_chars").alias("tr_chars"))
    return en.join(tr, "k", "left")


@area.query("SELECT page_id, coalesce(nullif(l.lang, 'fr'), nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), ''), 'none') AS title, l.doc_id IS NOT NULL AS has_document FROM pages LEFT JOIN documents l ON l.doc_id = page_id * 3")
def jn5_fallback_chain(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), "lang")
    pages = table(spark, d, "pages").withColumn("doc_id", F.col("page_id") * 3)
    own = F.nullif(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit(""))
    has = F.col("lang").isNotNull()
    return pages.join(docs, "doc_id", "left").select("page_id", F.coalesce(F.nullif("lang", F.lit("fr")), own, F.lit("none")).alias("title"), has.alias("has_document"))


@area.query("SELECT u.c_custkey AS user, k::INT AS rank, w AS value FROM (SELECT user_id, unnest(string_split(string_agg(event_type, ',' ORDER BY event_id), ',')) AS w, generate_subscripts(string_split(string_agg(event_type, ',' ORDER BY event_id), ','), 1) AS k FROM events WHERE value > 20 GROUP BY user_id) JOIN customer u ON u.c_custkey = user_id")
def jn6_rekey(spark, d):
    lists = table(spark, d, "events").where("value > 20").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("values"))
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return lists.join(owners, F.col("user") == F.col("user_id")).select("user", F.posexplode("values").alias("pos", "value")).select("user", (F.col("pos") + 1).alias("rank"), "value")


@area.query("SELECT s_name AS name, n_nationkey AS nation_id, n_nationkey IS NULL AS unknown FROM supplier LEFT JOIN nation ON n_name = 'NATION_' || s_nationkey")
def jn7_resolve_names(spark, d):
    nations = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("nation_id"))
    wanted = table(spark, d, "supplier").withColumn("n_name", F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")))
    return wanted.join(nations, "n_name", "left").select(F.col("s_name").alias("name"), "nation_id", F.col("nation_id").isNull().alias("unknown"))


@area.query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def jn8_semi_join(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@area.query(
    """WITH w AS (SELECT n_nationkey, greatest(count(s_suppkey), 0) AS weight FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
r AS (SELECT n_nationkey, sum(weight) OVER (ORDER BY md5(n_nationkey::VARCHAR), n_nationkey) - weight AS lo, sum(weight) OVER (ORDER BY md5(n_nationkey::VARCHAR), n_nationkey) AS hi, sum(weight) OVER () AS total FROM w),
u AS (SELECT c_custkey AS user, ('0x' || substr(md5('w|' || c_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM customer)
SELECT user, n_nationkey FROM u JOIN r ON u.u * total >= lo AND u.u * total < hi"""
)
def jn10_weighted_draw(spark, d):
    weights = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("weight"))
    draws = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), (S.draw("w", F.col("c_custkey").cast("string")) / F.lit(4294967296.0)).alias("u"))
    return S.weighted_draws(draws, weights, "weight", "n_nationkey", "16").select("user", "n_nationkey")


@area.query(
    """WITH g AS (SELECT doc_id, lang, n_chars, toxic FROM documents JOIN labels USING (doc_id)), t AS (SELECT * FROM g WHERE toxic = 1), c AS (SELECT * FROM g WHERE toxic = 0)
SELECT t.doc_id AS dirty, c.doc_id AS clean FROM t JOIN c ON c.lang = t.lang QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY abs(c.n_chars - t.n_chars), c.doc_id) <= 3"""
)
def jn11_nearest_controls(spark, d):
    """For each flagged document the three clean ones of its language with the nearest length, however far."""
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"), (F.col("toxic") == 1).alias("flagged"))
    return C.nearest_controls(g, "flagged", "lang", "n_chars", "doc_id")


@area.query("SELECT d.doc_id, l.quality, l.toxic, b.item_id IS NOT NULL AS benchmark, p.url IS NOT NULL AS page FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id")
def jn12_verdict_assembly(spark, d):
    has = lambda t, k, name: table(spark, d, t).select(F.col(k).alias("doc_id"), F.lit(True).alias(name))
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").join(has("benchmark", "item_id", "b"), "doc_id", "left").join(has("pages", "page_id", "p"), "doc_id", "left")
    return joined.select("doc_id", "quality", "toxic", F.coalesce("b", F.lit(False)).alias("benchmark"), F.coalesce("p", F.lit(False)).alias("page"))


@area.query(
    """WITH s AS (SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS chars FROM documents GROUP BY 1), q AS (SELECT lang, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT s.lang, n, chars, good, toxic FROM s LEFT JOIN q ON q.lang = s.lang"""
)
def jn13_report_rows(spark, d):
    docs = table(spark, d, "documents")
    style = docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"))
    verdicts = docs.join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return style.join(verdicts, "lang", "left")


@area.query(
    f"""WITH {NAMED}, p AS (SELECT user, count(*) AS purchases, round(avg(rating), 4) AS mean_rating, string_agg(title, ',' ORDER BY title) FILTER (pos <= 3) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user {NEWEST}) AS pos FROM named) GROUP BY user),
e AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1)
SELECT c_custkey AS user, c_mktsegment AS role, n_name AS employer, purchases, mean_rating, recent, kinds FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN p ON p.user = c_custkey LEFT JOIN e ON e.user_id = c_custkey"""
)
def jn14_enrichment_bundle(spark, d):
    ranked = _names(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("user").orderBy(*_newest())))
    bought = ranked.groupBy("user").agg(F.count("*").alias("purchases"), F.round(F.avg("rating"), 4).alias("mean_rating"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("pos") <= 3, F.col("title")))), ",").alias("recent"))
    kinds = table(spark, d, "events").groupBy(F.col("user_id").alias("user")).agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("employer"))
    return users.join(nations, "n_nationkey").join(bought, "user", "left").join(kinds, "user", "left").drop("n_nationkey")


# ---- sets, checks and filters


@area.query("SELECT 'only rebuilt' AS side, doc_id AS id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'only frozen', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set1_coverage(spark, d):
    a, b = table(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct(), table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return a.join(b, "id", "left_anti").select(F.lit("only rebuilt").alias("side"), "id").union(b.join(a, "id", "left_anti").select(F.lit("only frozen"), "id"))


RULES = {"large": "o_totalprice > 400000", "urgent": "o_orderpriority = '1-URGENT' AND o_totalprice > 300000", "open": "o_orderstatus = 'P' AND o_totalprice > 350000"}


@area.query("WITH r AS (" + " UNION ALL ".join(f"SELECT DISTINCT o_custkey AS user, '{k}' AS reason FROM orders WHERE {v}" for k, v in RULES.items()) + ") SELECT user, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY user")
def set2_target_union(spark, d):
    orders = table(spark, d, "orders")
    parts = [orders.where(v).select(F.col("o_custkey").alias("user"), F.lit(k).alias("reason")) for k, v in RULES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("user").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


@area.query("SELECT doc_id AS id, count(*) AS copies FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def set3_merge_with_duplicates(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return docs.where("id % 3 = 0").unionByName(docs.where("id % 5 = 0")).groupBy("id").agg(F.count("*").alias("copies"))


@area.query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def set4_unique_index(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@area.query(
    """WITH o AS (SELECT page_id AS k, md5(url) AS h FROM pages WHERE page_id % 7 <> 0), n AS (SELECT page_id AS k, md5(CASE WHEN page_id % 5 = 0 THEN lower(url) || '!' ELSE url END) AS h FROM pages WHERE page_id % 11 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'missing' WHEN o.h = n.h THEN 'ok' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.k = n.k"""
)
def set5_manifest_diff(spark, d):
    pages = table(spark, d, "pages")
    old = pages.where("page_id % 7 <> 0").select(F.col("page_id").alias("k"), F.md5("url").alias("a"))
    new = pages.where("page_id % 11 <> 0").select(F.col("page_id").alias("k"), F.md5(F.when(F.col("page_id") % 5 == 0, F.concat(F.lower("url"), F.lit("!"))).otherwise(F.col("url"))).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "ok").otherwise("changed")
    return old.join(new, "k", "full_outer").select("k", state.alias("state"))


CHECKS = {
    "order without customer": "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "line without part": "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    "duplicate order": "SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)",
    "duplicate line": "SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)",
    "discount out of range": "SELECT count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09",
    "null price": "SELECT count(*) FROM part WHERE p_retailprice IS NULL",
}


@area.query(" UNION ALL ".join(f"SELECT '{k}' AS rule, ({v}) AS violations" for k, v in CHECKS.items()))
def dq1_integrity(spark, d):
    orders, lines, parts = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    keys = parts.select(F.col("p_partkey").alias("l_partkey"))
    found = (
        orders.join(users, "o_custkey", "left_anti"),
        lines.join(keys, "l_partkey", "left_anti"),
        orders.groupBy("o_orderkey").count().where("count > 1"),
        lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        lines.where("NOT l_discount BETWEEN 0 AND 0.09"),
        parts.where("p_retailprice IS NULL"),
    )
    counted = [f.agg(F.count("*").alias("violations")).select(F.lit(k).alias("rule"), "violations") for k, f in zip(CHECKS, found, strict=True)]
    out = counted[0]
    for c in counted[1:]:
        out = out.union(c)
    return out


@area.query("SELECT c_custkey AS user, count(o_orderkey) > 0 AS linked FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1")
def flt1_linked_or_prospect(spark, d):
    early = _orders(spark, d).where("ts < timestamp'1995-06-01'").select("user").distinct().withColumn("linked", F.lit(True))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user")).join(early, "user", "left").select("user", F.coalesce("linked", F.lit(False)).alias("linked"))


@area.query("SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
def flt2_substring_search(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike("%license%")).select("doc_id")


@area.query("SELECT conv_id, turn FROM conversations JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = conv_id WHERE text <> '' AND role = 'assistant'")
def flt7_judgeable(spark, d):
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"))
    return table(spark, d, "conversations").where("text <> '' AND role = 'assistant'").join(wanted, "conv_id", "left_semi").select("conv_id", "turn")


@area.query("SELECT u.conv_id, u.turn, length(u.text) AS n_user, length(a.text) AS n_assistant FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def flt8_pairs(spark, d):
    conv = table(spark, d, "conversations")
    ask = conv.where("role = 'user'").select("conv_id", "turn", F.length("text").alias("n_user"))
    answer = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("n_assistant"))
    return ask.join(answer, ["conv_id", "turn"])
