"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, exact_dedup, langid, mixing, packing, prefix_trie, quality, secrets, simhash, spelling, token_count, token_files, url_filter
from tidewell.session import table

# The rules that the query judges by, as (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.round_trip_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, pattern)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), shared_heads=True)
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id,
        op2_byte_bpe,
        op3_token_counts,
        op4_simhash,
        op5_exact_dedup,
        op6_quality_rules,
        op7_url_filters,
        op8_mixing,
        op9_token_files,
        op10_secret_scan,
        op11_prefix_trie,
        op12_spelling_variants,
        op13_packing,
    )}


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def _op6_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for x in quality.STOP_WORDS for w in (x, x.capitalize())}))
    tests = " AND ".join(
        f"({t.denominator} = 0 OR ({t.numerator}::DOUBLE >= {t.denominator} * {t.low}::DOUBLE AND {t.numerator}::DOUBLE <= {t.denominator} * {t.high}::DOUBLE))"
        for t in quality.THRESHOLDS
    )
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
      len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN v ON v.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept FROM b
"""


OP7_SQL = """
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
      FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, m.rule, coalesce(m.rv, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id
"""

OP8_SQL = r"""
WITH q AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM p),
l AS (SELECT *, (coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before,
      (sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest, (sum(source_size) OVER ())::BIGINT AS budget FROM w),
c AS (SELECT *, (budget - before)::DOUBLE / rest AS share FROM l),
k AS (SELECT min(share) FILTER (share * weight <= source_size * 3) AS lowest,
      arg_min(share, source_size * 3 / weight) FILTER (share * weight <= source_size * 3) AS common FROM c),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, coalesce(common * weight, (source_size * 3)::DOUBLE)) AS target FROM c, k),
b AS (SELECT q.*, t.source_size, t.target,
      (sum(size) OVER (PARTITION BY q.source ORDER BY h ROWS UNBOUNDED PRECEDING))::BIGINT - size AS begin
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, begin + epoch * source_size AS ahead, unnest(range(0, size, 256)) AS done FROM (SELECT *, unnest([0, 1, 2]) AS epoch FROM b WHERE size > 0)),
f AS (SELECT doc_id, source, least(256, size - done) AS words, ahead + done + least(256, size - done) AS position, target FROM e),
o AS (SELECT doc_id, words, (sum(words) OVER (ORDER BY position::DOUBLE / target, source NULLS LAST, position ROWS UNBOUNDED PRECEDING))::BIGINT AS until FROM f),
s AS (SELECT doc_id, sum(greatest(0, least(words, (SELECT sum(size) FROM q)::BIGINT - until + words))) AS served FROM o GROUP BY doc_id)
SELECT b.doc_id, size, source_size, target, coalesce(served, 0)::BIGINT AS taken FROM b LEFT JOIN s ON s.doc_id = b.doc_id
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    byte = "list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, d: {byte}), 4294967295)"


OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, count(*) OVER (PARTITION BY conv_id) AS m,
           coalesce(role, '') || chr(1) || coalesce(text, '') AS v, length(coalesce(text, ''))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, any_value(m) AS m, {_crc32_sql("c::VARCHAR")} % 6 AS h FROM t GROUP BY c),
k AS (SELECT s.*, least(s.h, coalesce(o.m, 0)) AS n FROM s LEFT JOIN s o ON o.c = s.c - s.c % 100),
r AS (SELECT k.c, t.i, v, size FROM k JOIN t ON t.c = k.c - k.c % 100 AND t.i <= k.n
      UNION ALL SELECT k.c, t.i - k.h + k.n, v, size FROM k JOIN t ON t.c = k.c AND t.i > k.h),
q AS (SELECT k.c, coalesce(list(v ORDER BY i) FILTER (v IS NOT NULL), []) AS vs, coalesce(list(size ORDER BY i) FILTER (v IS NOT NULL), []) AS sizes
      FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
p AS (SELECT c, vs, d, vs[1:d] AS node, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(vs) + 1)) AS d FROM q)),
v AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, count(*) FILTER (len(vs) = d) AS n_ends,
      coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(vs) = d), '') AS ends FROM p GROUP BY node, d),
e AS (SELECT d, node[1:d - 1] AS above, node FROM v WHERE d > 0),
x AS (SELECT above, count(*) AS n_children FROM e GROUP BY above),
u AS (SELECT node, d, n_convs = n_ends AS leaf, (n_convs - 1) * size AS saved FROM v),
b AS (SELECT node[1:j] AS node, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM u) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, coalesce(x.n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN b ON b.node = v.node LEFT JOIN v o ON v.d > 0 AND o.node = v.node[1:v.d - 1] LEFT JOIN x ON x.above = v.node
"""

OP12_SQL = rf"""
WITH t AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM t GROUP BY doc_id, run),
h AS (SELECT run, n, {{crc}} AS h FROM g),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS cut FROM (SELECT *, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.cut UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.cut),
f AS (SELECT v.word, v.n, count(near) AS n_near, first(near ORDER BY near_n DESC, near) AS best, first(near_n ORDER BY near_n DESC, near) AS best_n
      FROM v LEFT JOIN p ON p.word = v.word GROUP BY v.word, v.n),
o AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f)
"""


def _op12_sql() -> str:
    bytes_of = "list_transform(string_split(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), ''), lambda x: strpos('0123456789ABCDEF', x) - 1)"
    half = "list_reduce([xor(c, d), 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
    swapped = f"flatten(list_transform(range(1, len({bytes_of}), 2), lambda i: [({bytes_of})[i + 1], ({bytes_of})[i]]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {swapped}), lambda c, d: {half}), 4294967295)"
    return (
        OP12_SQL.replace("{crc}", crc).replace("WITH t AS", "WITH RECURSIVE t AS").rstrip()
        + """,
r AS (SELECT word, word AS root, form AS ahead FROM o UNION ALL SELECT r.word, o.word, o.form FROM r JOIN o ON o.word = r.ahead)
SELECT o.word, o.form, r.root, o.n, o.n_near, o.form_n FROM o JOIN r ON r.word = o.word AND r.ahead IS NULL
"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": OP5_SQL,
        "op6_quality_rules": _op6_sql(),
        "op7_url_filters": OP7_SQL,
        "op8_mixing": OP8_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_spelling_variants": _op12_sql(),
    }
