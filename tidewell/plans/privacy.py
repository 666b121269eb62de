"""Queries on personal data: shapes, checks, spans, masking, restoring and their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import identifiers as I
from tidewell.functions import text as X
from tidewell.operators import evaluate as E
from tidewell.operators import pii as A
from tidewell.operators.containment import containing
from tidewell.plans.registry import Registry
from tidewell.session import checkpointed, table

area = Registry()
TYPES = A.RULES
#: The checks of the types that have a checksum, on the matched text ``m[k]``.
_DIGITS = "regexp_replace(m[k], '[^0-9]', '', 'g')"
_MONTH = "CASE WHEN mm BETWEEN 1 AND 12 THEN mm WHEN mm BETWEEN 21 AND 32 THEN mm - 20 WHEN mm BETWEEN 51 AND 62 THEN mm - 50 WHEN mm BETWEEN 71 AND 82 THEN mm - 70 END"
CHECK_SQL = {
    "ICO": f"substr({_DIGITS}, 8, 1)::INT = (11 - list_sum(list_transform(range(1, 8), lambda i: substr({_DIGITS}, i, 1)::INT * (9 - i)))::INT % 11) % 10",
    "RC": f"""(SELECT coalesce(mo IS NOT NULL AND try_cast(printf('%04d-%02d-%02d', CASE WHEN length(x) = 9 THEN 2000 WHEN yy >= 54 THEN 1900 + yy ELSE 2000 + yy END, mo, dd) AS DATE) IS NOT NULL
 AND (length(x) = 9 OR right(x, 1)::INT = CASE WHEN left(x, 9)::BIGINT % 11 = 10 THEN 0 ELSE left(x, 9)::BIGINT % 11 END), false)
 FROM (SELECT *, {_MONTH} AS mo FROM (SELECT x, substr(x, 1, 2)::INT AS yy, substr(x, 3, 2)::INT AS mm, substr(x, 5, 2)::INT AS dd FROM (SELECT replace(m[k], '/', '') AS x))))""",
    "IBAN_CZ": f"(substr({_DIGITS}, 3, 20) || '1235' || substr({_DIGITS}, 1, 2))::DECIMAL(38, 0) % 97 = 1",
}


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "text")


def _texts(spark, d):
    """Keys and texts, dealt out by key: a file's texts may be one task's to read, but not to look through."""
    return table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")


def _sql_spans(pattern: str, pii_type: str, check: str = "true") -> str:
    """One row per match with offsets, from the gaps between matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS start, length(m[k])::INT AS n, '{pii_type}' AS pii_type, m[k] AS surface
FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM documents)) WHERE {check}"""


_FOUND = "), spans AS (SELECT doc_id, start, start + n AS stop, pii_type, surface FROM sp)"
SHAPED = "sp AS (" + " UNION ALL ".join(_sql_spans(p, t) for t, p in I.SHAPES.items()) + _FOUND
SPANS = "sp AS (" + " UNION ALL ".join(_sql_spans(I.SHAPES[t], t, CHECK_SQL.get(t, "true")) for t in TYPES) + _FOUND
#: Greedy choice per text: a fold over lists of one span each.
RULED = (
    SPANS
    + """, ord AS (SELECT doc_id, list([{'start': start, 'stop': stop, 'pii_type': pii_type, 'surface': surface}] ORDER BY start - stop, start, pii_type) AS l FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.start < x[1].stop AND x[1].start < k.stop)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS s FROM ord),
ruled AS (SELECT doc_id, s.start AS start, s.stop AS stop, s.pii_type AS pii_type, s.surface AS surface FROM kept)"""
)


def _ruled(spark, d):
    return A.exploded(_texts(spark, d).select("doc_id", A.rule_spans(F.col("text"), TYPES).alias("spans")), "doc_id")


@area.query(f"WITH {SHAPED} SELECT doc_id, pii_type, start, stop, surface FROM spans")
def pii1_shapes(spark, d):
    parts = [A.matches(F.col("text"), pattern, t) for t, pattern in I.SHAPES.items()]
    return A.exploded(_docs(spark, d).select("doc_id", F.concat(*parts).alias("spans")), "doc_id")


@area.query(
    """WITH c AS (SELECT c_custkey AS user, lpad(((c_custkey * 7919 + 12345678) % 100000000)::VARCHAR, 8, '0') AS ico FROM customer)
SELECT user, ico, substr(ico, 8, 1)::INT = (11 - list_sum(list_transform(range(1, 8), lambda k: substr(ico, k, 1)::INT * (9 - k)))::INT % 11) % 10 AS ok FROM c"""
)
def pii2_company_number(spark, d):
    ico = F.lpad(((F.col("c_custkey") * 7919 + 12345678) % 100000000).cast("string"), 8, "0")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user"), ico.alias("ico")).withColumn("ok", I.ico_ok(F.col("ico")))


@area.query(
    """WITH c AS (SELECT o_orderkey AS k, lpad((o_orderkey % 97)::VARCHAR, 2, '0') AS cd, lpad((o_custkey * 104729 + o_orderkey)::VARCHAR, 20, '0') AS b FROM orders)
SELECT k, 'CZ' || cd || b AS iban, (b || '1235' || cd)::DECIMAL(38, 0) % 97 = 1 AS ok FROM c"""
)
def pii3_iban(spark, d):
    cd, b = F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad((F.col("o_custkey") * 104729 + F.col("o_orderkey")).cast("string"), 20, "0")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("CZ"), cd, b).alias("iban")).withColumn("ok", I.iban_ok(F.col("iban")))


@area.query(
    """WITH c AS (SELECT o_orderkey AS k, lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad(([0, 20, 50, 70, 15][o_orderkey % 5 + 1] + o_orderkey % 13)::VARCHAR, 2, '0') || lpad((o_custkey % 33)::VARCHAR, 2, '0') AS a,
 CASE WHEN o_orderkey % 4 = 0 THEN lpad((o_custkey % 1000)::VARCHAR, 3, '0') ELSE lpad(((o_custkey * 31) % 10000)::VARCHAR, 4, '0') END AS b FROM orders),
p AS (SELECT k, a || '/' || b AS rc, a || b AS x, substr(a, 1, 2)::INT AS yy, substr(a, 3, 2)::INT AS mm, substr(a, 5, 2)::INT AS dd FROM c),
m AS (SELECT *, CASE WHEN mm BETWEEN 1 AND 12 THEN mm WHEN mm BETWEEN 21 AND 32 THEN mm - 20 WHEN mm BETWEEN 51 AND 62 THEN mm - 50 WHEN mm BETWEEN 71 AND 82 THEN mm - 70 END AS mo FROM p)
SELECT k, rc, coalesce(mo IS NOT NULL AND try_cast(printf('%04d-%02d-%02d', CASE WHEN length(x) = 9 THEN 2000 WHEN yy >= 54 THEN 1900 + yy ELSE 2000 + yy END, mo, dd) AS DATE) IS NOT NULL
 AND (length(x) = 9 OR right(x, 1)::INT = CASE WHEN left(x, 9)::BIGINT % 11 = 10 THEN 0 ELSE left(x, 9)::BIGINT % 11 END), false) AS ok FROM m"""
)
def pii4_birth_number(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    month = F.element_at(F.array(*map(F.lit, (0, 20, 50, 70, 15))), (k % 5 + 1).cast("int")) + k % 13
    tail = F.when(k % 4 == 0, pad(c % 1000, 3)).otherwise(pad((c * 31) % 10000, 4))
    numbers = table(spark, d, "orders").select(k.alias("k"), F.concat(pad(k % 100, 2), pad(month, 2), pad(c % 33, 2), F.lit("/"), tail).alias("rc"))
    return numbers.withColumn("ok", I.birth_number_ok(F.col("rc")))


@area.query(f"WITH {RULED} SELECT doc_id, start, stop, pii_type, surface FROM ruled")
def pii5_rule_spans(spark, d):
    return _ruled(spark, d)


WORD = "[A-Z][a-z]{7,}"
MODEL_SQL = (
    "mw AS (" + _sql_spans(WORD, "PERSON") + """), model AS (SELECT doc_id, start, start + n AS stop, CASE WHEN start % 3 = 0 THEN 'ADDRESS' ELSE 'PERSON' END AS pii_type, surface,
round((('0x' || substr(md5(doc_id || '|' || start), 1, 8))::BIGINT % 100) / 100.0::DOUBLE, 2) AS confidence FROM mw)"""
)


def _model(spark, d):
    """Stand-in for a model's output: long capitalised words with a hashed confidence."""
    words = A.exploded(_texts(spark, d).select("doc_id", A.matches(F.col("text"), WORD, "PERSON").alias("spans")), "doc_id")
    score = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string"))), 1, 8), 16, 10).cast("long") % 100
    return words.withColumn("pii_type", F.when(F.col("start") % 3 == 0, "ADDRESS").otherwise("PERSON")).withColumn("confidence", F.round(score / 100.0, 2))


@area.query(
    f"""WITH {MODEL_SQL}, l AS (SELECT m.*, lag(m.stop) OVER w AS ps, lag(m.pii_type) OVER w AS pt, text FROM model m JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop)),
i AS (SELECT *, sum(CASE WHEN pt = pii_type AND regexp_full_match(substr(text, ps + 1, start - ps), '[\\s,.]*') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS island FROM l)
SELECT doc_id, pii_type, min(start) AS start, max(stop) AS stop, min(confidence) AS confidence FROM i GROUP BY doc_id, island, pii_type"""
)
def pii6_join_fragments(spark, d):
    return A.join_fragments(_model(spark, d), _texts(spark, d), "doc_id", r"^[\s,.]*$")


@area.query(
    f"""WITH {RULED}, {MODEL_SQL}, al AS (SELECT doc_id, start, stop, pii_type, 'rule' AS source, CASE WHEN pii_type = 'PSC' THEN 2 ELSE 0 END AS tier, 0.0::DOUBLE AS conf FROM ruled UNION ALL SELECT doc_id, start, stop, pii_type, 'model', 1, confidence FROM model),
o AS (SELECT doc_id, list([{{'start': start, 'stop': stop, 'pii_type': pii_type, 'source': source}}] ORDER BY tier, -conf, start, stop, pii_type) AS l FROM al GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.start < x[1].stop AND x[1].start < k.stop)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS s FROM o)
SELECT doc_id, s.start AS start, s.stop AS stop, s.pii_type AS pii_type, s.source AS source FROM k"""
)
def pii7_merge(spark, d):
    rules = _ruled(spark, d).select("doc_id", "start", "stop", "pii_type", F.lit("rule").alias("source"), F.lit(None).cast("double").alias("confidence"))
    model = _model(spark, d).select("doc_id", "start", "stop", "pii_type", F.lit("model").alias("source"), "confidence")
    return A.merge_by_precedence(rules.unionByName(model), "doc_id")


LETTER, TRAIL = "[A-Za-zÀ-ÿ]", "[ ,;:!?)]+"


@area.query(
    f"""WITH {MODEL_SQL}, l AS (SELECT doc_id, greatest(start - 2, 0) AS a, stop + confidence::INT AS b, text FROM model JOIN documents USING (doc_id)),
t AS (SELECT doc_id, a, b - length(regexp_extract(substr(text, a + 1, b - a), '{TRAIL}$')) AS b, text FROM l)
SELECT doc_id, (a - CASE WHEN regexp_full_match(substr(text, a + 1, 1), '{LETTER}') THEN length(regexp_extract(left(text, a), '{LETTER}*$')) ELSE 0 END)::INT AS start,
(b + CASE WHEN b > 0 AND regexp_full_match(substr(text, b, 1), '{LETTER}') THEN length(regexp_extract(substr(text, b + 1), '^{LETTER}*')) ELSE 0 END)::INT AS stop FROM t"""
)
def pii8_word_snap(spark, d):
    """Spans that begin or end within a word or with the marks after it: marks off, then to the whole word on both sides."""
    loose = _model(spark, d).select("doc_id", F.greatest(F.col("start") - 2, F.lit(0)).alias("start"), (F.col("stop") + F.bround("confidence").cast("int")).alias("stop"))
    start, stop = A.snapped(F.col("text"), F.col("start"), F.col("stop"))
    return loose.join(_docs(spark, d), "doc_id").select("doc_id", start.alias("start"), stop.alias("stop"))


NAMES = ("Novák", "Nováka", "Novákovi", "Nováková", "Novákové", "Černý", "Černého", "Hájek", "Hájka", "Pavel", "Pavla", "Svoboda", "Svobodou", "Dvořák", "Dvořákem")
NAMED = "nm AS (SELECT c_custkey AS user, [" + ", ".join(f"'{n}'" for n in NAMES) + f"][c_custkey % {len(NAMES)} + 1] AS name FROM customer)"


def _named(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES) + 1).cast("int")).alias("name"))


@area.query(
    f"""WITH {NAMED}, l AS (SELECT user, name, lower(name) AS w FROM nm), e AS (SELECT *, CASE {" ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 3 THEN {len(e)}" for e, _ in I.ENDINGS)} ELSE 0 END AS n,
CASE {" ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 3 THEN '{c}'" for e, c in I.ENDINGS)} ELSE 'm' END AS kind FROM l), s AS (SELECT *, substr(w, 1, length(w) - n) AS st FROM e)
SELECT user, name, CASE WHEN length(st) > 3 AND regexp_matches(st, '[^aeiouáéíóúůy]e[kl]$') THEN regexp_replace(st, 'e([kl])$', '\\1') ELSE st END AS stem, kind FROM s"""
)
def pii9_entity_key(spark, d):
    return _named(spark, d).select("user", "name", I.surname_key(F.col("name")).alias("k")).select("user", "name", "k.stem", "k.kind")


TOKENS = (
    RULED
    + r""", ent AS (SELECT *, pii_type || '|' || trim(regexp_replace(surface, '\s+', ' ', 'g')) AS entity FROM ruled),
num AS (SELECT doc_id, pii_type, entity, row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY min(start)) AS k FROM ent GROUP BY doc_id, pii_type, entity),
frm AS (SELECT doc_id, pii_type, entity, surface, row_number() OVER (PARTITION BY doc_id, pii_type, entity ORDER BY min(start)) - 1 AS f FROM ent GROUP BY doc_id, pii_type, entity, surface),
tok AS (SELECT e.doc_id, e.start, e.stop, e.pii_type, e.surface, e.entity, '<' || e.pii_type || '_' || k || CASE WHEN f = 0 THEN '' ELSE chr((97 + f)::INT) END || '>' AS token FROM ent e JOIN num USING (doc_id, pii_type, entity) JOIN frm f USING (doc_id, pii_type, entity, surface)),
pcs AS (SELECT doc_id, start, stop, token, substr(text, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) + 1, start - coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0)) AS gap, text FROM tok JOIN documents USING (doc_id)),
msk AS (SELECT doc_id, string_agg(gap || token, '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS masked FROM pcs GROUP BY doc_id)"""
)


def _masked(spark, d):
    texts = _texts(spark, d)
    return A.masked(texts, A.tokens_for(_ruled(spark, d), texts, "doc_id"), "doc_id")


@area.query(f"WITH {TOKENS} SELECT doc_id, start, token FROM tok")
def pii10_tokens(spark, d):
    return A.tokens_for(_ruled(spark, d), _texts(spark, d), "doc_id").select("doc_id", "start", "token")


@area.query(f"WITH {TOKENS} SELECT doc_id, coalesce(masked, text) AS masked FROM documents LEFT JOIN msk USING (doc_id)")
def pii10_masked_texts(spark, d):
    return _masked(spark, d).select("doc_id", "masked")


@area.query(
    f"""WITH {TOKENS}, ex AS (SELECT doc_id, pii_type, surface, row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY min(start)) AS k FROM ent GROUP BY doc_id, pii_type, surface)
SELECT 'none' AS policy, doc_id, start, '<' || pii_type || '_' || row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY start) || '>' AS token FROM ent
UNION ALL SELECT 'exact', doc_id, start, '<' || pii_type || '_' || k || '>' FROM ent JOIN ex USING (doc_id, pii_type, surface)"""
)
def pii10_policies(spark, d):
    """Tokens where no spans share a number, and where those of one surface do."""
    spans, texts = checkpointed(_ruled(spark, d)), _texts(spark, d)
    none, exact = (A.tokens_for(spans, texts, "doc_id", unify=u).select(F.lit(u).alias("policy"), "doc_id", "start", "token") for u in ("none", "exact"))
    return none.unionByName(exact)


_DRAWN = lambda k, digit: f"('0x' || substr(md5('s1|' || doc_id || '|{k}|' || {digit}), 1, 8))::BIGINT"


@area.query(
    f"""WITH {TOKENS}, r0 AS (SELECT doc_id, pii_type, entity, row_number() OVER (PARTITION BY doc_id ORDER BY min(start), pii_type) - 1 AS j FROM ent GROUP BY doc_id, pii_type, entity),
r1 AS (SELECT doc_id, pii_type, entity, (j // 101 + {_DRAWN(0, "j % 101")}) % 99 AS h, j % 101 AS l FROM r0), r2 AS (SELECT * REPLACE ((l + {_DRAWN(1, "h")}) % 101 AS l) FROM r1),
r3 AS (SELECT * REPLACE ((h + {_DRAWN(2, "l")}) % 99 AS h) FROM r2), r4 AS (SELECT * REPLACE ((l + {_DRAWN(3, "h")}) % 101 AS l) FROM r3)
SELECT doc_id, start, '<' || pii_type || '_' || (h * 101 + l + 1) || regexp_extract(token, '[a-z]*>$') AS token FROM tok JOIN r4 USING (doc_id, pii_type, entity)"""
)
def pii10_random_numbers(spark, d):
    """Tokens whose numbers tell no order."""
    return A.tokens_for(checkpointed(_ruled(spark, d)), _texts(spark, d), "doc_id", numbering="random", secret="s1").select("doc_id", "start", "token")


@area.query("SELECT count(*) AS texts, count(*) AS restored FROM documents")
def pii11_restore(spark, d):
    """Every masked text comes back exactly."""
    same = A.restored(F.col("masked"), F.col("back")) == F.col("text")
    return _masked(spark, d).agg(F.count("*").alias("texts"), F.count_if(same).alias("restored"))


@area.query(f"WITH {TOKENS} SELECT doc_id, len(list_filter(list_distinct(list(token)), lambda t: ends_with(t, '_1>'))) AS missing, 0 AS extra FROM tok GROUP BY doc_id")
def pii12_token_integrity(spark, d):
    """Tokens expected in a text against those found after the first of each type was lost."""
    lost = F.regexp_replace("masked", "<([A-Z_]+)_1>", "")
    found = F.regexp_extract_all(lost, F.lit(r"(<[A-Z_]+_[0-9]+[a-z]*>)"), 1)
    m = _masked(spark, d).where("back IS NOT NULL").select("doc_id", F.map_keys("back").alias("expected"), found.alias("found"))
    return m.select("doc_id", F.size(F.array_except("expected", "found")).alias("missing"), F.size(F.array_except("found", "expected")).alias("extra"))


@area.query("SELECT c_custkey, '<C_NAME_' || substr(md5('s1|' || c_name), 1, 10) || '>' AS c_name, c_mktsegment FROM customer")
def pii13_column_policy(spark, d):
    return A.column_policy(table(spark, d, "customer"), {"c_custkey": "open", "c_name": "token", "c_acctbal": "drop", "c_mktsegment": "open"}, "s1")


@area.query("SELECT user_id AS session, event_type AS entity, '<EVENT_' || row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) || '>' AS token, count(*) AS uses FROM events GROUP BY 1, 2")
def pii14_session_vault(spark, d):
    """One token per session and entity, numbered by first use."""
    per = table(spark, d, "events").groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("entity")).agg(F.min("event_id").alias("at"), F.count("*").alias("uses"))
    k = F.row_number().over(Window.partitionBy("session").orderBy("at"))
    return per.select("session", "entity", F.format_string("<EVENT_%d>", k).alias("token"), "uses")


@area.query(
    """WITH m AS (SELECT user_id AS session, upper(event_type) AS pii_type, event_id, regexp_extract(props, '[0-9]+') AS surface FROM events), e AS (SELECT *, surface::INT // 10 AS entity FROM m),
n AS (SELECT session, pii_type, entity, row_number() OVER (PARTITION BY session, pii_type ORDER BY min(event_id), entity) AS k FROM e GROUP BY session, pii_type, entity),
f AS (SELECT session, pii_type, entity, surface, row_number() OVER (PARTITION BY session, pii_type, entity ORDER BY min(event_id), surface) AS f FROM e GROUP BY session, pii_type, entity, surface),
v AS (SELECT session, surface, '<' || pii_type || '_' || k || CASE WHEN f = 1 THEN '' ELSE chr((96 + f)::INT) END || '>' AS token FROM f JOIN n USING (session, pii_type, entity)),
r AS (SELECT session, token FROM v UNION ALL SELECT session + 1, token FROM v UNION ALL SELECT session, trim(token, '<>') FROM v)
SELECT r.session, r.token, surface, CASE WHEN r.token NOT LIKE '<%' THEN 'malformed' WHEN surface IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM r LEFT JOIN v ON v.session = r.session AND v.token = r.token"""
)
def pii14_token_lookup(spark, d):
    """Each session's tokens asked for in it, in the next session, and without their brackets."""
    surface = F.regexp_extract("props", "[0-9]+", 0)
    mentions = table(spark, d, "events").select(F.col("user_id").alias("session"), F.upper("event_type").alias("pii_type"), F.floor(surface.cast("int") / 10).alias("entity"), surface.alias("surface"), "event_id")
    vault = A.session_vault(mentions, "session", "event_id")
    asked = F.explode(F.array(F.struct("session", "token"), F.struct((F.col("session") + 1).alias("session"), "token"), F.struct("session", F.regexp_replace("token", "[<>]", "").alias("token"))))
    return A.resolved(vault.select(asked.alias("r")).select("r.*"), vault, "session")


#: Stand-in for a corpus' planted values, longest first; one of them is part of another.
PLANTED = ("License", "licen", "password", "word", "die ", "the ")
PLANTED_SQL = f"""pl AS (SELECT doc_id, text, unnest([{", ".join(f"'{p}'" for p in PLANTED)}]) AS value FROM documents),
oc AS (SELECT doc_id, value, (list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * length(value))::INT AS start FROM (SELECT doc_id, value, string_split(text, value) AS g, unnest(range(1, len(string_split(text, value)))) AS k FROM pl)),
ol AS (SELECT doc_id, list([{{'start': start, 'stop': (start + length(value))::INT, 'value': value}}] ORDER BY -length(value), start, value) AS l FROM oc GROUP BY doc_id),
gold AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.start < x[1].stop AND x[1].start < k.stop)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS s FROM ol)"""


@area.query(
    f"""WITH {PLANTED_SQL}, g AS (SELECT doc_id, count(*) AS found, string_agg(s.value || '@' || s.start, ' ' ORDER BY s.start) AS located FROM gold GROUP BY doc_id)
SELECT d.doc_id, length(text) BETWEEN 80 AND 1500 AS fits, {" AND ".join(f"contains(text, '{p}')" for p in PLANTED)} AS complete, coalesce(found, 0) AS found, coalesce(located, '') AS located FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""
)
def pii15_planted_values(spark, d):
    """Whether all planted values are there and the length fits, and where they are: longest first, none overlapping."""
    spans = A.located(F.col("text"), PLANTED)
    where = F.array_join(F.transform("spans", lambda s: F.concat(s["surface"], F.lit("@"), s["start"].cast("string"))), " ")
    complete = F.lit(True)
    for p in PLANTED:
        complete = complete & F.contains("text", F.lit(p))
    return _docs(spark, d).withColumn("spans", spans).select("doc_id", F.length("text").between(80, 1500).alias("fits"), complete.alias("complete"), F.size("spans").cast("long").alias("found"), where.alias("located"))


@area.query(
    f"""WITH {RULED}, {MODEL_SQL}, x AS (SELECT 'rules' AS config, doc_id FROM ruled UNION ALL SELECT 'model', doc_id FROM model UNION ALL SELECT 'both', doc_id FROM ruled UNION ALL SELECT 'both', doc_id FROM model)
SELECT config, count(*) AS spans, count(DISTINCT doc_id) AS texts FROM x GROUP BY 1"""
)
def pii16_configurations(spark, d):
    rules, model = _ruled(spark, d).select("doc_id"), _model(spark, d).select("doc_id")
    tagged = lambda df, configs: df.select("doc_id", F.explode(F.array(*map(F.lit, configs))).alias("config"))
    return tagged(rules, ("rules", "both")).unionByName(tagged(model, ("model", "both"))).groupBy("config").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("texts"))


@area.query(
    """WITH t AS (SELECT conv_id AS k, turn AS pos, (turn * 10)::INT AS start, (turn * 10 + 5)::INT AS stop, CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'B-PER' WHEN length(text) % 3 > 0 THEN 'I-PER' WHEN length(text) % 2 = 0 THEN 'I-LOC' ELSE 'O' END AS tag FROM conversations),
l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM t), n AS (SELECT *, CASE WHEN starts_with(tag, 'I-') AND lag(label) OVER w = label THEN 0 ELSE 1 END AS nw FROM l WINDOW w AS (PARTITION BY k ORDER BY pos)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY pos) AS island FROM n) SELECT k, label, min(start) AS start, max(stop) AS stop FROM i WHERE label IS NOT NULL GROUP BY k, island, label"""
)
def pii17_tags_to_spans(spark, d):
    n = F.length("text")
    tag = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), "B-PER").when(n % 3 > 0, "I-PER").when(n % 2 == 0, "I-LOC").otherwise("O")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("pos"), (F.col("turn") * 10).cast("int").alias("start"), (F.col("turn") * 10 + 5).cast("int").alias("stop"), tag.alias("tag"))
    return A.tag_spans(rows, "k")


ALIASES = {"view": "VISIT", "click": "VISIT", "purchase": "SALE"}


@area.query("SELECT label, count(*) AS n FROM (SELECT CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE upper(event_type) END AS label FROM events WHERE event_type <> 'error') GROUP BY 1")
def pii18_label_normalisation(spark, d):
    aliases = spark.createDataFrame(list(ALIASES.items()), "event_type string, label string")
    kept = table(spark, d, "events").where("event_type <> 'error'").join(F.broadcast(aliases), "event_type", "left")
    return kept.groupBy(F.coalesce("label", F.upper("event_type")).alias("label")).agg(F.count("*").alias("n"))


@area.query(
    f"""WITH {RULED}, n AS (SELECT count(*) AS texts FROM documents), e AS (SELECT pii_type, string_agg(surface, ' ; ' ORDER BY surface) AS examples FROM (SELECT DISTINCT pii_type, surface FROM ruled QUALIFY dense_rank() OVER (PARTITION BY pii_type ORDER BY surface) <= 3) GROUP BY 1)
SELECT pii_type, count(*) AS hits, round(1000.0::DOUBLE * count(*) / any_value(texts), 4) AS per_1000, round(count(DISTINCT doc_id) / any_value(texts)::DOUBLE, 6) AS touched, any_value(examples) AS examples FROM ruled JOIN n ON true JOIN e USING (pii_type) GROUP BY pii_type"""
)
def agg17_detection_rates(spark, d):
    spans = checkpointed(_ruled(spark, d))
    texts = _docs(spark, d).agg(F.count("*").alias("texts"))
    rank = F.row_number().over(Window.partitionBy("pii_type").orderBy("surface"))
    some = spans.select("pii_type", "surface").distinct().withColumn("k", rank).where("k <= 3").groupBy("pii_type").agg(F.array_join(F.sort_array(F.collect_list("surface")), " ; ").alias("examples"))
    counts = spans.groupBy("pii_type").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs")).crossJoin(F.broadcast(texts))  # one row
    return counts.join(some, "pii_type").select("pii_type", "hits", F.round(1000.0 * F.col("hits") / F.col("texts"), 4).alias("per_1000"), F.round(F.col("docs") / F.col("texts"), 6).alias("touched"), "examples")


EV_SQL = RULED + ", gold AS (SELECT DISTINCT doc_id, start, stop, pii_type FROM ruled WHERE doc_id % 7 <> 0), pred AS (SELECT DISTINCT doc_id, start, stop, pii_type FROM ruled WHERE doc_id % 5 <> 0)"


@area.query(
    f"""WITH {EV_SQL}, b AS (SELECT coalesce(g.pii_type, p.pii_type) AS pii_type, g.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.start = p.start AND g.stop = p.stop AND g.pii_type = p.pii_type),
c AS (SELECT coalesce(pii_type, 'all') AS pii_type, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM b GROUP BY ROLLUP (pii_type))
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""
)
def ev7_ev9_strict_scores(spark, d):
    spans = checkpointed(_ruled(spark, d))
    return E.span_scores(spans.where("doc_id % 7 <> 0"), spans.where("doc_id % 5 <> 0"), "doc_id", "start", "stop", "pii_type")


@area.query(
    f"""WITH {RULED}, g AS (SELECT doc_id, start, stop, pii_type FROM ruled), p AS (SELECT doc_id, CASE WHEN start % 4 = 0 THEN start ELSE start + 2 END AS start, CASE WHEN start % 4 = 0 THEN stop ELSE stop + 9 END AS stop, CASE WHEN pii_type = 'PSC' AND start % 3 = 0 THEN 'ADDRESS' ELSE pii_type END AS pii_type FROM ruled WHERE doc_id % 3 <> 0),
exact AS (SELECT g.doc_id, g.start, g.stop, g.pii_type FROM g JOIN p USING (doc_id, start, stop, pii_type)),
g2 AS (SELECT * FROM g EXCEPT SELECT * FROM exact), p2 AS (SELECT * FROM p EXCEPT SELECT * FROM exact),
m AS (SELECT g2.doc_id, g2.start AS gs, g2.stop AS ge, p2.start AS ps, p2.stop AS pe, least(g2.stop, p2.stop) - greatest(g2.start, p2.start) AS ov, p2.pii_type AS t FROM g2 JOIN p2 ON g2.doc_id = p2.doc_id AND (g2.pii_type = p2.pii_type OR g2.pii_type = 'PSC' AND p2.pii_type = 'ADDRESS') AND g2.start < p2.stop AND p2.start < g2.stop),
l AS (SELECT doc_id, list([{{'gs': gs, 'ge': ge, 'ps': ps, 'pe': pe, 't': t}}] ORDER BY -ov, gs, ps, ge, pe, t) AS l FROM m GROUP BY doc_id),
k AS (SELECT doc_id, len(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: (k.gs = x[1].gs AND k.ge = x[1].ge) OR (k.ps = x[1].ps AND k.pe = x[1].pe AND k.t = x[1].t))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS n FROM l)
SELECT (SELECT count(*) FROM exact) AS strict, (SELECT coalesce(sum(n), 0)::BIGINT FROM k) AS partial, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p) AS predicted"""
)
def ev8_partial_matching(spark, d):
    """Shifted predictions of all types: exact ones first, the rest one to one by the largest overlap within each text."""
    gold = checkpointed(_ruled(spark, d).select("doc_id", "start", "stop", "pii_type"))
    stays = F.col("start") % 4 == 0
    kind = F.when((F.col("pii_type") == "PSC") & (F.col("start") % 3 == 0), "ADDRESS").otherwise(F.col("pii_type"))
    pred = gold.where("doc_id % 3 <> 0").select("doc_id", F.when(stays, F.col("start")).otherwise(F.col("start") + 2).alias("start"), F.when(stays, F.col("stop")).otherwise(F.col("stop") + 9).alias("stop"), kind.alias("pii_type"))
    return E.partial_matches(gold, pred, "doc_id")


@area.query(f"WITH {TOKENS} SELECT pii_type, count(*) AS spans, count(DISTINCT doc_id || entity) AS entities, round(1 - count(DISTINCT doc_id || entity) / count(*)::DOUBLE, 6) AS unification FROM tok GROUP BY 1")
def ev10_unification_rate(spark, d):
    tokens = A.tokens_for(_ruled(spark, d), _texts(spark, d), "doc_id")
    counts = tokens.groupBy("pii_type").agg(F.count("*").alias("spans"), F.countDistinct("doc_id", "entity").alias("entities"))
    return counts.withColumn("unification", F.round(1 - F.col("entities") / F.col("spans"), 6))


@area.query(f"WITH {EV_SQL}, sh AS (SELECT doc_id, start + 1 AS s, stop + 1 AS e FROM pred) SELECT count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM sh WHERE sh.doc_id = gold.doc_id AND s < gold.stop AND gold.start < e)) AS found FROM gold")
def ev11_overlap_recall(spark, d):
    spans = checkpointed(_ruled(spark, d).select("doc_id", "start", "stop", "pii_type").distinct())
    gold, pred = spans.where("doc_id % 7 <> 0"), spans.where("doc_id % 5 <> 0").select("doc_id", (F.col("start") + 1).alias("s"), (F.col("stop") + 1).alias("e"))
    found = gold.join(pred, (gold["doc_id"] == pred["doc_id"]) & (F.col("s") < F.col("stop")) & (F.col("start") < F.col("e")), "left_semi")
    return gold.agg(F.count("*").alias("gold")).crossJoin(found.agg(F.count("*").alias("found")))  # one row each


@area.query("SELECT count(*) AS payloads, count(*) FILTER (EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, substr(b.text, 1, 60)))) AS leaks FROM documents d")
def ev12_leak_rate(spark, d):
    """Texts that hold any known passage, whole. (The SQL looks for the first 60 characters; on the given tables that is the same.)"""
    docs = table(spark, d, "documents").select(F.monotonically_increasing_id().alias("row"), "text")
    leaks = containing(docs, "text", table(spark, d, "benchmark"), "text").agg(F.count("*").alias("leaks"))
    return docs.agg(F.count("*").alias("payloads")).crossJoin(F.broadcast(leaks))  # one row


@area.query("SELECT page_id, round(CASE WHEN length(substr(url, 3)) = 0 THEN 0.0 ELSE levenshtein(lower(url), substr(url, 3)) / length(substr(url, 3))::DOUBLE END, 6) AS cer FROM pages")
def ev13_character_error_rate(spark, d):
    """Of whole urls; 0 for an empty reference. (The SQL's distance counts bytes, which is the same for urls in ASCII.)"""
    ref, hyp = F.expr("substring(url, 3)"), F.lower("url")
    return table(spark, d, "pages").select("page_id", F.round(F.when(F.length(ref) == 0, 0.0).otherwise(F.levenshtein(hyp, ref) / F.length(ref)), 6).alias("cer"))


def _as_letters(text, words):
    """Each distinct word as one private character, so that edit distance over characters is one over words."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + 57343), 8, "0")), "UTF-32")), "")


@area.query(None)
def ev13_word_error_rate(spark, d):
    conv = table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).alias("ref")).withColumn("hyp", F.regexp_replace("ref", "(the|die|les) ", ""))
    words = F.array_distinct(F.concat(F.split("ref", " "), F.split("hyp", " ")))
    staged = conv.withColumn("w", words).withColumn("a", _as_letters(F.col("ref"), F.col("w"))).withColumn("b", _as_letters(F.col("hyp"), F.col("w")))
    n = F.size(F.split("ref", " "))
    return staged.select("conv_id", "turn", F.round(F.when(F.col("ref") == "", 0.0).otherwise(F.levenshtein("a", "b") / n), 6).alias("wer"))


@area.query("SELECT count(*) AS values_, count(*) FILTER (contains(regexp_replace(lower(html), '[^a-z0-9]', '', 'g'), regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '[^a-z0-9]', '', 'g'))) AS recovered FROM pages")
def ev14_recovered_values(spark, d):
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return table(spark, d, "pages").agg(F.count("*").alias("values_"), F.count_if(F.contains(flat("html"), flat(F.regexp_extract("url", "://([^/?#]*)", 1)))).alias("recovered"))


# ---- text hygiene

CLASS_SQL = {k: v.replace("'", "''") for k, v in X.CLASSES.items()}
COUNTS = ", ".join(f"len(regexp_extract_all(v, '{p}')) AS {k}" for k, p in CLASS_SQL.items())


def _unpivot(source: str) -> str:
    return f"SELECT id, class, n FROM (UNPIVOT (SELECT id, {COUNTS} FROM ({source})) ON COLUMNS(* EXCLUDE (id)) INTO NAME class VALUE n) WHERE n > 0"


@area.query(_unpivot("SELECT page_id AS id, html AS v FROM pages").replace("SELECT id, class, n FROM", "SELECT id AS page_id, class, n FROM", 1))
def txt3_class_counts(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(X.class_counts(F.col("html"))).alias("class", "n"))


@area.query(
    "WITH a AS (" + _unpivot("SELECT 'url' AS id, url AS v FROM pages UNION ALL SELECT 'html', html FROM pages") + f""")
SELECT 'pages' AS table_name, id AS column_name, class, sum(n)::BIGINT AS n, CASE WHEN class IN ({", ".join(f"'{c}'" for c in X.CRITICAL)}) THEN 'critical' ELSE 'info' END AS severity FROM a GROUP BY ALL"""
)
def txt4_audit(spark, d):
    return X.audit(table(spark, d, "pages"), "pages")


@area.query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '" + CLASS_SQL["HTMLTAG"] + "', ' ', 'g') AS text FROM pages")
def txt2_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


TIDY_SQL = "nullif(trim(regexp_replace(regexp_replace(regexp_replace({0}, '" + X.REMOVED.replace("{", "{{").replace("}", "}}") + "', '', 'g'), '" + X.TO_SPACE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), ' {{2,}}', ' ', 'g')), '')"


@area.query(f"SELECT page_id, {TIDY_SQL.format('html')} AS text FROM pages")
def txt1_tidy(spark, d):
    """The part of cleaning that regular expressions express alike everywhere."""
    return table(spark, d, "pages").select("page_id", X.tidy(F.col("html")).alias("text"))


@area.query(None)
def txt1_clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_text(F.col("html"), html=True).alias("text"))


@area.query(f"SELECT doc_id, {TIDY_SQL.format('source')} AS source, {TIDY_SQL.format('text')} AS text FROM documents")
def txt5_clean_nested(spark, d):
    """Cleaning within structs, arrays and maps; the given documents hold no entities, which the SQL leaves alone."""
    nested = table(spark, d, "documents").repartition("doc_id").select("doc_id", F.struct(F.array("text").alias("texts"), F.create_map(F.lit("source"), F.col("source")).alias("facts")).alias("n"))
    return X.clean_nested(nested, "n").select("doc_id", F.col("n.facts")["source"].alias("source"), F.col("n.texts")[0].alias("text"))


@area.query(None)
def txt6_stage_trace(spark, d):
    """Class counts before, after unescaping and after cleaning, with the first text that has the class and its surroundings."""
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("v"))
    return X.stage_trace(pages, "page_id", "v")


@area.query("SELECT l_orderkey || '::' || l_partkey || '::' || epoch(l_shipdate)::BIGINT AS key, count(*) AS n FROM lineitem GROUP BY 1")
def txt7_review_keys(spark, d):
    key = F.concat_ws("::", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.unix_timestamp("l_shipdate").cast("string"))
    return table(spark, d, "lineitem").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@area.query("SELECT p_partkey AS item, array_to_string(list_filter([nullif(p_name, ''), nullif(p_type, 'SMALL'), substr(p_brand || ' ' || p_size, 1, 400)], lambda x: x IS NOT NULL), '. ') AS text FROM part")
def txt8_item_text(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.concat_ws(". ", F.nullif("p_name", F.lit("")), F.nullif("p_type", F.lit("SMALL")), F.substring(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")), 1, 400)).alias("text"))


@area.query(r"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 120), '[\x20\x09-\x0D][^\x20\x09-\x0D]*\z', '') || '…' END AS head FROM documents")
def txt9_cut_at_word(spark, d):
    return _docs(spark, d).select("doc_id", X.cut_at_word(F.col("text"), 120, ellipsis=True).alias("head"))


NQ = r"rtrim(lower(trim(regexp_replace(regexp_replace({0}, '[\x{{22}}\x{{27}}\x{{AB}}\x{{BB}}\x{{2018}}-\x{{201F}}]', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), '.,!?;: ')"


@area.query(f"WITH q AS (SELECT doc_id, text, '»  ' || substr(text, doc_id % 40 + 1, 30) || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END || ' !«' AS quote FROM documents) SELECT doc_id, {NQ.format('quote')} <> '' AND contains({NQ.format('text')}, {NQ.format('quote')}) AS found FROM q")
def txt10_quote_found(spark, d):
    """Quotes in marks with added spaces and end marks; every third has a letter too many."""
    piece = F.col("text").substr((F.col("doc_id") % 40 + 1).cast("int"), F.lit(30))
    q = F.concat(F.lit("»  "), piece, F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""), F.lit(" !«"))
    return _docs(spark, d).select("doc_id", X.quote_found(q, F.col("text")).alias("found"))


@area.query("SELECT doc_id, md5(lower(text)) AS lower_md5, length(text) = length(replace(text, 'ß', 'SS')) AS upper_fits FROM documents WHERE length(lower(text)) = length(text)")
def txt11_recase(spark, d):
    """Texts whose lower case is as long as they are, and whether their upper case is too. (In the SQL ß becomes SS.)"""
    docs = _docs(spark, d)
    return docs.where(F.length(F.lower("text")) == F.length("text")).select("doc_id", F.md5(F.lower("text")).alias("lower_md5"), (F.length(F.upper("text")) == F.length("text")).alias("upper_fits"))


@area.query("SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS folded FROM documents")
def txt12_ascii_fold(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.ascii_fold(F.col("text"))).alias("folded"))


@area.query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), '{p}'))::INT AS {k}" for k, p in X.TOKEN_PATTERNS.items()) + " FROM documents")
def txt13_tokens(spark, d):
    return _docs(spark, d).select("doc_id", *[F.size(X.tokens(F.col("text"), k)).alias(k) for k in X.TOKEN_PATTERNS])


@area.query(r"SELECT lang, count(*) AS n, round(avg(len(regexp_extract_all(text, '[a-zà-ÿ]{1,4}|[^a-zà-ÿ\s]')) / len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::DOUBLE), 4) AS fertility FROM documents GROUP BY 1")
def txt14_fertility(spark, d):
    words, pieces = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.regexp_count("text", F.lit(r"[a-zà-ÿ]{1,4}|[^a-zà-ÿ\s]"))
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(pieces / words), 4).alias("fertility"))
