"""SQL fragments shared by the oracles of the registered queries."""

ROWS = """rows_ AS (SELECT o_custkey AS user, l_partkey AS item, o_orderdate AS ts, l_orderkey AS order_id, l_linenumber AS line_no,
  l_extendedprice AS price, 1 + (l_quantity::INT % 5) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

INTER = (
    ROWS
    + """,
inter AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user, item ORDER BY ts DESC, order_id DESC, line_no DESC, price DESC, rating DESC) AS rn FROM rows_) WHERE rn = 1)"""
)

SPLIT = (
    INTER
    + """,
split_ AS (SELECT user, item, rating, ts, n, pos = 1 AS hidden FROM (SELECT *, count(*) OVER (PARTITION BY user) AS n,
  row_number() OVER (PARTITION BY user ORDER BY ts DESC, order_id DESC, line_no DESC, item DESC) AS pos FROM inter) WHERE n >= 2),
hist AS (SELECT user, item, rating, ts FROM split_ WHERE NOT hidden),
hid AS (SELECT user, item FROM split_ WHERE hidden)"""
)

#: 100 sampled negatives of each user by a walk over the catalogue in hash order; see operators.sampling.fresh_items.
WALK = """items_ AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR), p_partkey) - 1 AS pos FROM part), n_items AS (SELECT count(*) AS c FROM part),
prime AS (SELECT min(p) AS p FROM (SELECT unnest(range(c, 2 * c + 3)) AS p FROM n_items) WHERE p > 1 AND len(list_filter(range(2, sqrt(p)::BIGINT + 1), lambda d: p % d = 0 AND d < p)) = 0)"""


def walked(name: str, wants: str, taken: str, seed: str) -> str:
    """The first n items of each user's walk outside ``taken``, as a table (user, item, k)."""
    word = lambda what: f"('0x' || substr(md5('{seed}|' || user || '|{what}'), 1, 8))::BIGINT"
    return f"""{name}_w AS (SELECT w.user, n, unnest(range(0, least(n + coalesce(held, 0) + p - c, p)::BIGINT)) AS j, {word("start").replace("user", "w.user")} % p AS start, {word("step").replace("user", "w.user")} % (p - 1) + 1 AS step, p
  FROM {wants} w LEFT JOIN (SELECT user, count(*) AS held FROM {taken} GROUP BY user) h ON h.user = w.user CROSS JOIN prime CROSS JOIN n_items),
{name} AS (SELECT user, item, k FROM (SELECT user, item, n, row_number() OVER (PARTITION BY user ORDER BY j) AS k FROM {name}_w JOIN items_ ON pos = (step * j + start) % p
  WHERE NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.user = {name}_w.user AND t.item = items_.item)) WHERE k <= n)"""


CANDIDATES = f"""{SPLIT}, {WALK}, wants_ AS (SELECT user, 100 AS n FROM hid), {walked("negs", "wants_", "split_", "7")},
cand AS (SELECT user, item, false AS hidden FROM negs UNION ALL SELECT user, item, true FROM hid)"""


def ranked(scores: str) -> str:
    """Rank of the hidden item among the candidates, from a table of scores (user, item, score)."""
    return f"""scored AS (SELECT c.user, c.item, c.hidden, s.score FROM cand c LEFT JOIN {scores} s ON s.user = c.user AND s.item = c.item),
ranks AS (SELECT user, rank FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC NULLS LAST, md5('t|' || user || '|' || item)) AS rank FROM scored) WHERE hidden)"""
