"""Whitening, exact dedup and the filter audit against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SF_CHECK, SF_SMALL  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pricelab.llm import exact_dedup, filter_audit, whitening  # noqa: E402
from pricelab.llm.queries import ORACLES, QUERIES  # noqa: E402
from pricelab.testing import compare, duck_connection  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __dd_row string, part int"
LABELS = "doc_id long, quality int, toxic int, mask string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{k % 9973}" for k in range(300_000))
    rows = [(1, "The cat sat", "en", "a", 3, "x", 1), (1, "The cat sat", "en", "a", 3, "x", 1), (9, "The  cat\tsat", "en", "a", 3, "x", 1),
            (8, "Thecat sat \x0b", None, "b", 3, None, 1), (2, "", "en", "a", 0, None, 2), (3, None, "fr", None, None, None, None),
            (7, " \t\n\x0c\r ", "fr", "c", 2, None, 7), (None, "The cat sat", "fr", "b", 9, "z", 4), (None, "The cat sat", "fr", "b", 9, "z", 4),
            (None, "nobody has an id here $", "", "c", 2, None, 8), (5, long, "en", "c", 7, "q", 5), (6, long + " ", "en", None, 1, "", 6),
            (4, long.replace(" ", "\n"), "zz", None, 1, "", 6), (10, "SHOUT " * 300, "zz", None, None, None, None),
            (11, "汉字与表情😀" * 900, "zh", "c", 1, None, 1), (12, "汉字 与表情😀" * 900, "zh", "c", 1, None, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("key", ["op12_exact_dedup", "op13_filter_audit"])
@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_equals_sql(spark, key, sf):
    assert compare(QUERIES[key](spark, sf), duck_connection(sf).sql(ORACLES[key])) == []


# --- whitening ---------------------------------------------------------------------------------------


def _plain_whitening(vectors):
    """(n, sums, covariance in exact fractions) of x = floor(64 c) + 1000000."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    apart = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in apart), n ** 3)) for j in range(d)] for i in range(d)])
    return n, apart, cov


def test_whitening_equals_a_plain_one(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(6, 6)) * np.array([3.0, 1, 0.7, 0.5, 0.2, 0.1])
    vectors = [tuple(float(v) for v in row) for row in rng.normal(size=(150, 6)) @ mixed + 5]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5),
           (905, [1.0, 2.0]), (906, [1e300] * 6)]
    rows = [(i if i != 3 else None, list(v), 1, "n") for i, v in enumerate(vectors)] + [(7, list(vectors[7]), 2, "again")]
    rows += [(i, v, 0, None) for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, whitened string").repartition(5)
    got = whitening.whiten_rows(df, k=4)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, apart, cov = _plain_whitening([r[1] for r in rows[:151]])
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1], units[:, ::-1]
    found = got.collect()
    assert len(found) == 151 * 4 and {r.n for r in found} == {151} and found[0].identity_error < 1e-9
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(sum(v * v for v in a) for a in apart)
    for k in range(4):
        own = [r for r in found if r.component == k + 1]
        assert all(abs(r.explained / (values[k] / np.trace(cov)) - 1) < 1e-10 for r in own)
        want = {i: float(np.dot(apart[i], units[:, k]) / n / math.sqrt(values[k])) for i in range(150) if i != 3}
        mine = {r.vec_id: r.whitened for r in own if r.vec_id is not None}
        sign = 1 if mine[0] * want[0] > 0 else -1
        assert mine.keys() == want.keys() and max(abs(mine[i] - sign * want[i]) for i in want) < 1e-8


def test_whitening_of_entries_beyond_doubles_and_longs(spark):
    """Products of large entries need whole numbers of any size; deviations beyond a long are null."""
    rng = np.random.default_rng(6)
    for size, null in ((1e4, False), (1e12, True)):
        vectors = [[float(c) for c in v] for v in rng.normal(size=(40, 3)) * size + 3 * size]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
        n, apart, cov = _plain_whitening(vectors)
        model = whitening.fit(df)
        assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(cov)[::-1], rtol=1e-9)
        got = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
        assert got == {i: (None if null else sum(v * v for v in a)) for i, a in enumerate(apart)}
        assert whitening.identity_error(df, model) < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_whitening_without_spread_is_empty(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten_rows(df)
    assert got.count() == 0 and got.columns[0] == "vec_id"


def test_flat_dimensions_are_left_out(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 5.0, float(i % 3)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fit(df)
    assert len(model.eigenvalues) == 2 and sum(model.explained) == pytest.approx(1)
    assert whitening.identity_error(df, model) < 1e-9


def test_factor_and_rotations():
    rng = np.random.default_rng(7)
    for d, rank in ((1, 1), (2, 2), (7, 4), (64, 64), (33, 33)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        a = a @ a.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, atol=1e-13 * np.abs(a).max())
        values, units = whitening.components(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-6, atol=1e-13 * values[0])  # eigvalsh is exact to that only
        assert np.allclose(units.T @ units, np.eye(rank), atol=1e-10)
        assert np.allclose(units * values @ units.T, a, atol=1e-12)


# --- exact dedup -------------------------------------------------------------------------------------


def _plain_groups(rows):
    held = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        held[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for key, own in held.items():
        best = min((n, none, x) for n, none, x, _ in own)
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(None if none else x, None if best[1] else best[2], len(own), sha) for _, none, x, _ in own]
    return Counter(out)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_equal_a_plain_dedup(odd, bits):
    """With three bits nearly every number stands for several chunks, so ordinals tell them apart."""
    got = exact_dedup.groups(odd, bits=bits).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == _plain_groups(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and kept.keys() == {r.text_sha256 for r in got}
    assert all(r.kept is not None and (not r.kept or r.doc_id == r.keep_id) for r in got)


def test_kept_rows_are_whole(odd):
    kept = exact_dedup.keep_one(odd)
    assert kept.schema == odd.schema
    before, after = Counter(map(tuple, odd.collect())), Counter(map(tuple, kept.collect()))
    assert not after - before and len(after) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in before})


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0
    assert filter_audit.audit_documents(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_chunks_follow_the_content(spark):
    """Chunks concatenate to the text; a character put in front changes the chunks near it only."""
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöü汉字.,"), 200_000))
    texts = [text, "x" + text, text[:100_000] + "y" + text[100_000:], "ab" * 20_000, "", "k"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [bytes(c) for c in r.c] for r in df.select("i", exact_dedup.chunks(F.col("t")).alias("c")).collect()}
    assert all(b"".join(got[i]).decode() == t for i, t in enumerate(texts))
    assert all(exact_dedup.MIN_CHUNK <= len(c) <= exact_dedup.MAX_CHUNK for own in got.values() for c in own[:-1])
    for other in (1, 2):
        assert len(set(got[0]) - set(got[other])) <= 5 < 50 < len(got[0])


def test_passages_share_chunks_and_move_once(spark):
    rng = np.random.default_rng(9)
    passage = " ".join("".join(rng.choice(list("etaoinshrdlucmfw"), rng.integers(2, 9))) for _ in range(5000))
    df = spark.createDataFrame([(i, f"own start {i} " * 50 + passage + f" own end {i}" * 50) for i in range(20)], "doc_id long, text string")
    cut = exact_dedup.cut_texts(df, "text", {"__id": F.col("doc_id")})
    total = cut.select(F.explode("__chunks").alias("c")).agg(F.sum(F.length("c"))).first()[0]
    distinct = cut.select(F.explode("__chunks").alias("c")).distinct().agg(F.sum(F.length("c"))).first()[0]
    assert distinct < total / 4


# --- filter audit ------------------------------------------------------------------------------------


def _plain_audit(docs, labels):
    """The metrics by walking every order over every document."""
    first, good, toxic = {}, set(), set()
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, q, t in labels:
        good |= {doc_id} if q == 1 and doc_id is not None else set()
        toxic |= {doc_id} if t == 1 and doc_id is not None else set()
    rows = []
    for doc_id, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, c in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                                             bool(re.search(r"[#$%&*|]", t)), doc_id is not None and doc_id > first[t]]) if c}
        rows.append((part or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                own = [r for r in rows if r[0] == part]
                gone = set(order[:k])
                removed = [r for r in own if x in r[1] and not r[1] & gone]
                shapley[part, x] += len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & (gone | {x}) for r in own), len(removed), sum(x in r[1] and bool(r[1] & gone) for r in own),
                    sum(r[1] == {x} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_a_walk_over_all_orders(spark, odd):
    labels = [(1, 1, 0, "m"), (1, 0, 1, None), (None, 1, 1, None), (10, 1, None, None), (10, 1, 1, None), (4, None, 1, None), (77, 1, 1, None), (9, 2, 0, None)]
    got = filter_audit.audit_documents(odd, spark.createDataFrame(labels, LABELS)).collect()
    want = _plain_audit([(r.doc_id, r.text, r.lang) for r in odd.collect()], [x[:3] for x in labels])
    mine = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(got) == len(mine) == 5 * 120 * 5 and mine == want


def test_enumeration_takes_any_letters(spark):
    masks = spark.range(8).withColumnRenamed("id", "mask")
    got = filter_audit.enumerate_orders(spark, masks, "XYZ").collect()
    assert {r.filter_order for r in got} == {"".join(p) for p in permutations("XYZ")} and len(got) == 6 * 3 * 8
    assert all(r.letter == r.filter_order[r.step - 1] for r in got)
