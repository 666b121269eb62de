"""Prefix trie, spelling variants and packing against brute force: nulls, empty and long inputs, ties, repeats, hot groups,
empty tables and columns with clashing names."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from brute import brute_spelling, brute_trie

from tidewell.llm import exact_dedup, langid, mixing, packing, prefix_trie, queries, spelling

VOCABULARY = P.path("word_bpe_49k.json")
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    """Few distinct turns, so that prefixes are shared; lengths around the edges of blocks; one conversation that many repeat."""
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 140), *range(295, 330), -250, -5, 10**12, 10**12 + 7]:
        length = draw.choice([1, 2, 6, 7, 8, 9, 15, 16, 17, 24, 33])
        same = draw.random() < 0.4
        for k in range(length):
            rows.append((c, k, "user" if k % 2 == 0 else "bot", f"turn {k}" if same else f"turn {k} {draw.randrange(2)}"))
    rows += [(500, None, "user", "first"), (500, 0, None, None), (500, 0, "user", ""), (500, 0, "user", ""), (501, 0, "", ""), (502, 3, None, None), (503, 1, "a", "b|c"), (504, 1, "a|b", "c")]
    return rows + [(None, 0, "user", "nowhere"), (505, 0, "user", "ünïcode 😀" * 3000), (506, 0, "user", "ünïcode 😀" * 3000)]


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv long, t string, block string").repartition(5)


def trie(df, **how):
    return sorted((tuple(r[c] for c in TRIE) for r in prefix_trie.prefix_trie(df, **how).collect()), key=repr)


@pytest.mark.parametrize("shared", [False, True])
def test_trie_equals_brute_force(spark, shared):
    rows = conversations()
    assert trie(as_frame(spark, rows), shared_heads=shared) == brute_trie(rows, shared)


def test_trie_of_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLAB", 5)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, k, "user", "hello" if c < 40 else f"{k % 3}") for c in range(41) for k in range(2 if c < 40 else 150)]
    assert trie(as_frame(spark, rows)) == brute_trie(rows, False)


def test_nodes_name_their_parents(spark):
    rows = prefix_trie.prefix_trie(as_frame(spark, conversations())).collect()
    node = {r["node"]: r for r in rows}
    assert len(node) == len(rows)
    for r in rows:
        assert (r["parent"] is None) == (r["depth"] == 0) == (r["turn_id"] is None)
        if r["parent"]:
            assert node[r["parent"]]["conv_id"] == r["parent_conv_id"] and node[r["parent"]]["depth"] == r["depth"] - 1


def test_trie_of_no_conversations(spark):
    assert trie(as_frame(spark, conversations()).limit(0)) == []
    assert trie(as_frame(spark, conversations()).where("conv_id IS NULL"), shared_heads=True) == []


# ---- spelling


def misspelt():
    draw = random.Random(3)
    words = ["garden", "gardens", "garten", "window", "windows", "winter", "Straße", "naïveté", "a" * 40, "a" * 41, "gardne", "gardeñ", "×÷×÷×÷", "ganter", "wintar", "wincer", "windem", "gardén"]
    weights = [400, 30, 20, 300, 20, 90, 25, 25, 30, 6, 7, 7, 9, 7, 5, 18, 6, 6]
    rows = [(i if i % 9 else None, " ".join(draw.choices(words, weights, k=12)) + draw.choice([". ", "", "\n", "9x"])) for i in range(400)]
    return rows + [(1, None), (2, ""), (3, "short words only"), (4, "Garden," * 400), (4, "Garden," * 400)]


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "y") for r in rows], "doc_id long, text string, word string, n long, root string").repartition(4)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("one_in", [199, 7, 2])
def test_spelling_equals_brute_force(spark, one_in):
    got = spelling.spelling_variants(docs_frame(spark, misspelt()), one_in=one_in)
    assert got.columns == COLUMNS
    want = brute_spelling(misspelt(), one_in)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and any(r[1] for r in want)


def test_signatures_find_every_pair_of_random_words(spark):
    draw = random.Random(8)
    words = {"".join(draw.choices("abcé", k=draw.randint(6, 9))) for _ in range(1500)}
    got = {frozenset(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    cuts = {}
    for w in words:
        for k in range(len(w)):
            cuts.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    want = {frozenset((a, b)) for group in cuts.values() for a in group for b in group if a != b}
    want |= {frozenset((a + b, w)) for (a, b), group in cuts.items() if a + b in words for w in group}
    assert got == want and len(want) > 500


def test_forms_of_forms_end_in_a_root(spark):
    chain = [(f"word{'x' * k}ing", 5 ** (k + 1)) for k in range(7)]
    rows = [(w, n, chain[k + 1][0] if k + 1 < len(chain) else None) for k, (w, n) in enumerate(chain)]
    got = spelling.with_roots(spark.createDataFrame(rows, "word string, n long, form string"), chain[-1][1], 5).collect()
    assert {r["root"] for r in got} == {chain[-1][0]} and len(got) == 7


def test_spelling_of_no_texts(spark):
    assert spelling.spelling_variants(docs_frame(spark, misspelt()).limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs_frame(spark, misspelt()), ratio=1)


# ---- packing


def packed(df, **how):
    return [r.asDict() for r in packing.pack(df, VOCABULARY, **how).collect()]


def check_packing(rows, pieces, length=packing.LENGTH):
    """Every ID is in one piece, at its place, and no sequence needs padding."""
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t, *_ in rows)
    sequences = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append(p)
    for group in sequences.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length and at & at - 1 == 0
    by = {}
    for p in pieces:
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    ids = []
    for (_, total), group in by.items():  # rows that repeat an identifier and its length are equal in these tests
        copies = sum(p["length"] for p in group) // total
        assert sum(p["length"] for p in group) == copies * total
        if copies == 1:
            group.sort(key=lambda p: p["start"])
            assert [p["start"] for p in group] == [0, *np.cumsum([p["length"] for p in group])[:-1]]
            ids.append(b"".join(p["ids"] for p in group))
    assert set(ids) <= set(want) and len(ids) >= len({r[0] for r in rows}) - 2
    return sequences


def texts():
    draw = random.Random(2)
    words = "the of and stone River winter, Garden. people naïve 漢字 can't <|endoftext|> x9".split()
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([1, 5, 40, 300, 900])))) for i in range(180)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "stone " * 40_000), (1004, "x" * 30_000), (None, "no identifier"), (7000, "twice"), (7000, "twice")]


@pytest.mark.parametrize("partitions, windows", [(1, 64), (5, 4), (70, 2)])
def test_packing_loses_nothing_and_pads_nothing(spark, partitions, windows):
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in texts()], "doc_id long, text string, sequence_id long, ids string, part string").repartition(partitions)
    pieces = packed(df, windows=windows)
    sequences = check_packing(texts(), pieces)
    assert sum(sum(p["length"] for p in g) == packing.LENGTH for g in sequences.values()) >= len(sequences) - 11
    again = packed(df, windows=windows)
    assert sorted(map(repr, pieces)) == sorted(map(repr, again))


def test_documents_that_fit_stay_whole():
    packer, full = packing.Packer(length=8, windows=2), []
    piece = lambda key, n: (key, 0, n, np.arange(n, dtype="<u4").tobytes())
    for key, n in [("a", 5), ("b", 6), ("c", 2), ("d", 3)]:  # c fits best beside b, d beside a
        full += packer.add(piece(key, n))
    assert [[p[0] for p in w] for w in full] == [["b", "c"], ["a", "d"]] and not packer.open
    full = [w for key, n in [("e", 5), ("f", 6), ("g", 4)] for w in packer.add(piece(key, n))]
    assert [[(p[0], p[1], len(p[3]) // 4) for p in w] for w in full] == [[("f", 0, 6), ("g", 0, 2)]]  # the fullest goes
    assert [(p[0], p[1]) for w in packer.left() for p in w] == [("e", 0), ("g", 2)]  # the rest of g fits beside e
    assert [sum(len(p[3]) // 4 for p in w) for w in packer.close()] == [4, 2, 1]


def test_long_documents_fill_windows_of_their_own():
    packer = packing.Packer(length=8, windows=1)
    full = list(packer.add(("a", 0, 21, np.arange(21, dtype="<u4").tobytes())))
    assert [[(p[1], len(p[3]) // 4) for p in w] for w in full] == [[(0, 8)], [(8, 8)]]
    assert [(p[1], len(p[3]) // 4) for w in packer.left() for p in w] == [(16, 5)]


def test_packing_of_no_texts_and_of_odd_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packed(none) == []
    with pytest.raises(ValueError):
        packing.pack(none, VOCABULARY, length=1000)


def test_packing_query_on_the_given_table(spark):
    data = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(VOCABULARY)
    texts_of = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op13_packing(spark, data).collect()
    seen = dict.fromkeys(texts_of, 0)
    for r in rows:
        ids = np.array([*library.encode(texts_of[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        if seen[r["doc_id"]] == r["doc_tokens"]:
            seen[r["doc_id"]] = True
    assert all(v is True for v in seen.values())
    sums = {}
    for r in rows:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 2048 and n & n - 1 == 0 for n in sums.values())


# ---- columns named like the operators' own helpers


def test_helper_names_do_not_clash_with_columns(spark):
    rows = [(1, "the river and the house of stone", "en", "a"), (1, "the river and the house of stone", "en", "a"), (2, "der fluss und das haus aus stein", "de", "b"), (3, "the garden and a letter", "en", "a")] * 3
    own = ["_language", "_digest", "_mix_key", "_mix_times", "_mix_finish", "_MIX_KEY_"]
    df = spark.createDataFrame([(*r, *own) for r in rows], ["doc_id", "text", "lang", "source", *own])
    for stage in (langid.accepted, exact_dedup.drop_exact_duplicates, mixing.mixed_documents):
        got = stage(df)
        assert got.columns == df.columns
        found = got.collect()
        assert found and all([r[c] for c in own] == own for r in found)
    assert exact_dedup.drop_exact_duplicates(df).count() == 3
