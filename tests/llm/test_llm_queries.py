"""The registered queries against their SQL, and the pipeline against its own stages."""

from __future__ import annotations

import base64
import os
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from comparing import agree  # noqa: E402
from conftest import DATA  # noqa: E402

from brute import brute_components, brute_fingerprint, brute_prediction, brute_queue  # noqa: E402

from tidewell.llm import langid  # noqa: E402
from tidewell.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(name, spark, duck):
    agree(Q.queries()[name], Q.oracle_sql()[name], spark, duck, DATA)


def test_all_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in Q.queries()] == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    start = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, ids = start, [{r["doc_id"] for r in start.select("doc_id").collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == start.columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    texts = spark.read.parquet(f"file://{tmp_path}/1")
    assert texts.count() == texts.select("text").distinct().count()
    assert docs.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def corpus():
    """Documents of two languages with copies, near copies, an unlearned language, nulls and sources of unequal size."""
    draw = np.random.default_rng(11)
    words = {"en": "the of and river stone winter garden letter people house under about never always again morning".split(), "de": "der die und nicht garten winter stein brief leute haus unter immer wieder morgen niemals strasse".split()}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        text = " ".join(draw.choice(words[lang], draw.integers(20, 90)))
        rows.append((i, text, lang if i % 7 else None, "big" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 4}"))
    for k, i in enumerate((3, 8, 8, 40)):
        rows.append((200 + k, rows[i][1], "en", "copies"))
    for k, i in enumerate((5, 12, 33)):
        rows.append((300 + k, rows[i][1].upper() + (" indeed" if k else ""), "de", "near"))
    rows += [(400, None, "en", "big"), (401, "", None, "big"), (402, "12 34 !!", "en", "s1"), (403, "один два три четыре пять " * 9, None, "s1"), (404, "the river " * 3000, "en", "s2")]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["round_trip"]) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())

    model = langid.fit(spark.read.parquet(f"file://{tmp_path}/documents.parquet"))
    rows = [r for r in corpus() if not brute_prediction(model, r[1])[2]]
    assert {400, 401, 402, 403}.isdisjoint(r[0] for r in rows) and len(rows) > 80
    largest = {}
    for r in rows:
        largest[r[1]] = max(largest.get(r[1], r), r)
    rows = list(largest.values())
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    group = brute_components(set(prints.values()))
    least = {}
    for i, f in prints.items():
        least[group[f]] = min(least.get(group[f], i), i)
    assert len(least) < len(rows)
    rows = [r for r in rows if r[0] in set(least.values())]
    _, _, copies = brute_queue([(r[0], r[3], r[1]) for r in rows], 256)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for k, _ in copies:
        ids = tuple(library.encode_ordinary(rows[k][1]))
        want[rows[k][0], ids, len(ids), True] += 1
    assert got == want


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
