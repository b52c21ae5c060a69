"""Near-dedup, hash forest, fingerprints, license scan, URL filter, perspectives and the pipeline
against brute-force versions."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SF_CHECK, SF_SMALL  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pricelab.llm import hash_forest, license_scan, near_dedup, order_minhash, perspectives, url_filter  # noqa: E402
from pricelab.llm.queries import ORACLES, QUERIES  # noqa: E402
from pricelab.session import release_unused  # noqa: E402
from pricelab.testing import compare, duck_connection  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, node int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{k % 9973}" for k in range(40_000))
    rows = [(1, "The cat sat on the mat today.", "en", "a", 3, "x", 1), (1, "The cat sat on the mat today.", "en", "a", 3, "x", 1),
            (2, "", "en", "a", 0, None, 2), (3, None, "fr", None, None, None, None), (4, "two words", None, "b", 5, "y", 3),
            (None, "THE CAT sat on the mat today.", "fr", "b", 9, "z", 4), (5, long, "en", "c", 7, "q", 5),
            (6, "x " + long, "en", None, 1, "", 6), (7, " \t\n ", "fr", "c", 2, None, 7), (8, "Two  words", "en", "c", 2, None, 8),
            (None, "nobody has an id here", "en", "c", 2, None, 8)]
    return spark.createDataFrame(rows, DOCS)


# --- op9 -------------------------------------------------------------------------------------------


def _rounds(spark, links):
    """The components of ``links`` (a, b), and how many checkpoints they took."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    frame = spark.createDataFrame(links, "a long, b long")
    before = set(os.listdir(folder))
    found = {r.node: r.root for r in near_dedup.components(frame).collect()}
    return found, len([p for p in set(os.listdir(folder)) - before if p.startswith("rdd-")])


def test_components_of_stars_need_no_round(spark):
    # each round of a small table costs its tasks and files over all partitions: check_h ran out of disk
    found, kept = _rounds(spark, [(1, 2), (3, 1), (1, 3), (5, 9), (8, 5), (7, 7)])
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 8: 5, 9: 5}
    assert kept == 1


def test_components_of_paths_hubs_and_random_links(spark):
    rng = np.random.default_rng(7)
    names = rng.permutation(1000).tolist()
    path = [(names[i], names[i + 1]) for i in range(60)]
    line = [(k, k + 1) for k in range(2000, 2040)]
    hub = [(4000, k) for k in range(3000, 3050)] + [(3010, 3011), (3011, 3010)]
    mixed = [(int(a) + 5000, int(b) + 5000) for a, b in rng.integers(0, 120, (90, 2))]
    links = path + line + hub + mixed
    root = {n: n for e in links if e[0] != e[1] for n in e}
    for _ in range(len(root)):
        was = dict(root)
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if was == root:
            break
    found, kept = _rounds(spark, links)
    assert found == root
    assert kept <= 9
    assert _rounds(spark, [])[0] == {}


def test_shuffle_files_of_earlier_rounds_are_let_go(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        all_files = disk.getAllFiles()
        return sum(all_files.apply(i).getName().startswith("shuffle_") for i in range(all_files.size()))

    near_dedup.components(spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long"))
    made, end = files(), time.time() + 20
    release_unused(spark)
    while files() > 40 and time.time() < end:
        time.sleep(0.5)
    assert files() <= 40, made


def _shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def _components(texts, k):
    """Component number of each text, by all pairs that share a shingle."""
    sets = [_shingles(t, k) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter(p for own in holders.values() for p in combinations(own, 2))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def _expected(rows, k):
    sets, root = _components([t for _, t in rows], k)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i is None, i or 0, len(s), least.get(r), i is not None and i == least[r]) for (i, _), s, r in zip(rows, sets, root)), key=str)


def _found(out):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert _found(QUERIES["op9_near_dedup"](spark, SF_CHECK)) == _expected(rows, 4)


def test_near_duplicates_equal_sql(spark):
    assert compare(QUERIES["op9_near_dedup"](spark, SF_SMALL), duck_connection(SF_SMALL).sql(ORACLES["op9_near_dedup"])) == []


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert _found(near_dedup.near_duplicates(odd, 0.8, 4)) == _expected(rows, 4)
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    kept = near_dedup.keep_one(odd, 0.8, 4)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, None]))


def test_large_region_of_near_copies(spark, monkeypatch):
    """One family of near copies, cut into small regions: still one component, with few pairs tried."""
    monkeypatch.setattr(near_dedup, "REGION", 64)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.integers(0, 200, 2):
            own[at] = f"z{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 150))) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(near_dedup.near_duplicates(table, 0.8, 4)) == _expected(rows, 4)


def test_unlinked_template_family(spark, monkeypatch):
    """Texts that share a template, too unlike to be linked, with some pairs at the similarity among them."""
    monkeypatch.setattr(near_dedup, "REGION", 256)
    rng = np.random.default_rng(11)
    template = [f"t{x}" for x in range(160)]
    rows = [(i, template + [f"o{i}x{k}" for k in range(int(rng.integers(30, 44)))]) for i in range(2000)]
    for i in range(60):  # a text's own words with some replaced, on both sides of the similarity
        own = list(rows[i * 7][1])
        for at in range(160, 160 + 6 + i % 20):
            own[at] = f"n{i}x{at}"
        rows.append((2000 + i, own))
    rng.shuffle(order := np.arange(len(rows)))
    rows = [(int(k), " ".join(rows[i][1])) for k, i in enumerate(order)]
    sets, column = [_shingles(t, 4) for _, t in rows], {}
    held = np.zeros((len(rows), 160), np.float32)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            if all(w[:1] == b"t" for w in x):
                held[i, column.setdefault(x, len(column))] = 1
            else:
                holders[x].append(i)
    common = (held @ held.T).astype(int)
    for own in holders.values():
        for a, b in combinations(own, 2):
            common[a, b] += 1
            common[b, a] += 1
    n = np.array([len(s) for s in sets])
    linked = np.argwhere(np.triu(100 * common >= 80 * (n[:, None] + n - common), 1))
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        before = root.copy()
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
        if (root == before).all():
            break
    assert 20 < len(linked) and len(set(root)) > 1000
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, 0.8, 4).collect()}
    assert got == dict(enumerate(root.tolist()))


# --- op6 -------------------------------------------------------------------------------------------


def _brute(rows, k=5):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


@pytest.mark.parametrize("sf", [SF_CHECK, "/root/testdata/sf0.1"])
def test_forest_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    right = _brute(rows)
    got = defaultdict(dict)
    vectors = dict(rows)
    for r in QUERIES["op6_hash_forest"](spark, sf).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(right)
    hits = sum(len({x for x, _ in right[q]} & {x for x, _ in got[q].values()}) for q in right)
    assert hits / sum(map(len, right.values())) >= 0.9
    for q, found in got.items():
        assert sorted(found) == list(range(1, 6))
        order = [found[r] for r in range(1, 6)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        for i, s in order:
            a, b = np.array(vectors[q]), np.array(vectors[i])
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_forest_candidates_share_a_prefix():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << hash_forest.BITS, (4, 200)).astype(np.uint64)
    asked = codes[:, :10]
    for q, found in hash_forest.candidates(codes, asked, 0.2):
        depth = next(d for d in range(hash_forest.BITS, -1, -1) if (
            (codes >> np.uint64(hash_forest.BITS - d)) == (asked[:, q: q + 1] >> np.uint64(hash_forest.BITS - d))).sum() >= 40)
        share = ((codes >> np.uint64(hash_forest.BITS - depth)) == (asked[:, q: q + 1] >> np.uint64(hash_forest.BITS - depth))).any(0)
        assert found.tolist() == np.flatnonzero(share).tolist()


def test_forest_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (50, [2.0, 0.0], 1), (50, [2.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [0.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (100, [0.0, 0.0], 2),
            (9, [1e300, 1e300], 1), (10, [1e-300, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = [tuple(r) for r in hash_forest.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in out] == [(0, 1, 10), (0, 2, 50), (0, 3, 9), (0, 4, 7), (50, 1, 0), (50, 2, 10), (50, 3, 9), (50, 4, 7)]
    assert [round(s, 12) for *_, s in out] == [1, 1, round(0.5 ** 0.5, 12), 0] * 2
    assert hash_forest.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- op7 -------------------------------------------------------------------------------------------


def _edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        out.append((i is None, i or 0, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("range_rows", [7, 4096])
def test_edited_texts_equal_brute_force(spark, odd, monkeypatch, range_rows):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", range_rows)
    for table in (spark.read.parquet(f"{SF_SMALL}/documents.parquet"), odd):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        out = order_minhash.fingerprints(table).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in out) == _edited(rows)
        for r in out:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert order_minhash.fingerprints(odd.limit(0)).count() == 0
    one = order_minhash.fingerprints(odd.filter("doc_id = 4")).first()
    assert one.near_next == 1.0


def _parts(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.p for r in order_minhash.with_elements(table, "t", "p").orderBy("i").collect()]


def test_elements_equal_a_plain_order_minhash(spark):
    """The selection by a plain implementation from the same numbered k-mer hashes."""
    texts = ["a b a b a b c", "one", "one two", "x y z x y z w " * 9, "lorem ipsum dolor sit amet " * 3 + "q",
             "of sixteen chars: abcdefghijklmnop, seventeen abcdefghijklmnopq end", "中文没有空格的文本也要按字符切开来比较" * 2]
    got = _parts(spark, texts)
    n = order_minhash.ELEMENTS
    for text, parts in zip(texts, got):
        tokens = [x for w in text.split() for x in ([w] if len(w) <= order_minhash.TOKEN else
                                                    [w[i: i + order_minhash.GRAM] for i in range(len(w))])]
        kmers = [tuple(tokens[i: i + 2]) for i in range(max(1, len(tokens) - 1))]
        bits = order_minhash.HASH_BITS
        high = f"shiftright({{}} & {(1 << 62) - 1}, {62 - bits}) as h"
        table = spark.createDataFrame([(i, *(k + ("",))[:2]) for i, k in enumerate(kmers)], "i int, a string, b string")
        keys = [r.h for r in table.selectExpr("i", high.format("xxhash64(a, b)")).orderBy("i").collect()]
        nth = [keys[:i].count(k) for i, k in enumerate(keys)]
        table = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(zip(keys, nth))], "i int, k long, nth int")
        hashes = table.selectExpr("i", high.format("xxhash64(k, nth)")).collect()
        assert all(0 <= r.h < 1 << bits for r in hashes)
        want = []
        for j in range(n):
            start = j * ((1 << bits) // n)
            picked = sorted(hashes, key=lambda r: ((r.h - start) % (1 << bits), r.i))[: order_minhash.PICK]
            want.append([r.h for r in sorted(picked, key=lambda r: r.i)])
        asked = spark.createDataFrame([(j, w) for j, w in enumerate(want)], "j int, w array<long>")
        assert [r.x for r in asked.select("j", F.xxhash64("w").alias("x")).orderBy("j").collect()] == list(parts)


def test_elements_do_not_depend_on_the_number_of_tokens(spark):
    """Texts on both sides of a power of two share their elements, and both forms of the numbers give the same ones."""
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 3000, 520)]
    texts = [" ".join(words[:n]) for n in (7, 8, 127, 128, 511, 513)] + ["", "one", "a b a b a b c"]
    got = _parts(spark, texts)
    like = lambda x, y: sum(p == q for p, q in zip(x, y)) / order_minhash.ELEMENTS
    assert like(got[0], got[1]) > 0.3 and like(got[2], got[3]) > 0.9 and like(got[4], got[5]) > 0.9
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for packed_tokens in (0, 127):
        other = order_minhash.with_elements(table, "t", "p", packed_tokens).orderBy("i").collect()
        assert [r.p for r in other] == got


def test_likeness_of_texts_without_spaces(spark):
    """One character put in front or in the middle changes little, an other text nearly all."""
    rng = np.random.default_rng(4)
    chinese, other = ("".join(chr(0x4E00 + x) for x in rng.integers(0, 3000, 2000)) for _ in range(2))
    code = "".join("ABCDEFGHabcdefgh01234567+/"[x] for x in rng.integers(0, 26, 2000))
    parts = _parts(spark, [chinese, "一" + chinese, chinese[:900] + "一" + chinese[900:], other, code, "x" + code, "y " + code])
    like = lambda x, y: sum(p == q for p, q in zip(x, y)) / order_minhash.ELEMENTS
    assert min(like(parts[0], parts[i]) for i in (1, 2)) > 0.9 and min(like(parts[4], parts[i]) for i in (5, 6)) > 0.9
    assert like(parts[0], parts[3]) < 0.1


def test_likeness_follows_edits(spark):
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 3000, 400)]
    little, much = list(words), list(words)
    for at in rng.integers(0, 400, 8):
        little[at] = "changed"
    much[100:] = [f"v{x}" for x in rng.integers(0, 3000, 300)]
    moved = words[200:] + words[:200]
    a, same, b, c, d = _parts(spark, [" ".join(x) for x in (words, words, little, much, moved)])
    like = lambda x, y: sum(p == q for p, q in zip(x, y)) / order_minhash.ELEMENTS
    assert a == same and like(a, b) > like(a, c) and like(a, b) > 0.7 and like(a, c) < 0.4
    assert like(a, d) < 0.95  # the same k-mers in another order


# --- op8 -------------------------------------------------------------------------------------------


def _license_base(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i: i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_labels_equal_brute_force(spark, odd):
    extra = spark.createDataFrame([(20, "MIT license, mit-License! (Apache License) GNU general public\nlicense", "en", "a", 1, None, 1),
                                   (21, "the mit licenseé and general public", "en", "a", 1, None, 1)], DOCS)
    for table in (spark.read.parquet(f"{SF_CHECK}/documents.parquet"), odd.unionByName(extra)):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        out = license_scan.scan(table).collect()
        assert sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str) == sorted(
            ((i or -1, *_license_base(t)) for i, t in rows), key=str)
        for r in out:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert license_scan.scan(odd.limit(0)).count() == 0


def test_diagonals_find_edited_templates(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 9999, n)]
    rows, want = [], {}
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        words = text.split()
        edited = words[: len(words) // 2] + ["added"] + words[len(words) // 2:] if len(words) > 20 else words
        rows.append((k, " ".join(noise(50) + edited + noise(50))))
        want[k] = label
        rows.append((100 + k, " ".join(noise(30) + words[:2] + noise(30))))  # too little of it
    rows.append((200, " ".join(noise(500))))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.scan(table).collect()}
    for k, label in want.items():
        assert label in out[k].labels.split(",")
        assert out[100 + k].labels == out[100 + k].base_labels
    assert out[200].labels == "" and out[200].score == 0


# --- op10 ------------------------------------------------------------------------------------------


def _rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_equal_brute_force(spark):
    odd = [(None, "http://a.org/"), (1, None), (2, ""), (3, "no scheme.org/x"), (4, "HTTP://Sub.EXAMPLE.org/en/12?x"), (4, "HTTP://Sub.EXAMPLE.org/en/12?x"),
           (5, "x://example.org"), (6, "x://notexample.org/es/#f"), (7, "a://b://com/fr/"), (8, "ftp://com/de/é?"), (9, "q://?x"), (10, "z://" + "long/" * 2000)]
    table = spark.createDataFrame([(i, u, "h", "rule") for i, u in odd], "page_id long, url string, html string, rule string")
    for pages in (spark.read.parquet(f"{SF_CHECK}/pages.parquet"), table):
        rows = [(r.page_id, r.url) for r in pages.collect()]
        out = url_filter.judge(pages).collect()
        assert len(out) == len(rows)
        want = sorted(((i is None, i or 0, *_rule(u)) for i, u in rows), key=str)
        got = sorted(((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in out), key=str)
        assert got == want
        assert {r.verdict for r in out} <= {"allow", "block"}
    assert url_filter.judge(table.limit(0)).count() == 0


def _markov(urls, order):
    """Plain dictionaries of the smoothed model; returns a function url -> log-likelihood."""
    counts = Counter()
    for u in urls:
        p = url_filter.START * order + u
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts[p[i - k: i + 1]] += 1
    follow, kinds = Counter(), Counter()
    for s, n in counts.items():
        follow[s[:-1], len(s)] += n
        kinds[s[:-1], len(s)] += 1

    def log_p(context, c):
        if context is None:
            return -np.log(url_filter.ALPHABET)
        less = log_p(context[1:] if context else None, c)
        n, d = follow[context, len(context) + 1], kinds[context, len(context) + 1]
        if not n:
            return less
        return np.log((counts[context + c] + d * np.exp(less)) / (n + d))

    return lambda u: sum(log_p((url_filter.START * order + u)[i: i + order], u[i]) for i in range(len(u)))


@pytest.mark.parametrize("hot", [2, url_filter.HOT])
def test_scores_equal_plain_markov_models(spark, monkeypatch, hot):
    """With next to no frequent strings, too: all others meet in the plain join."""
    monkeypatch.setattr(url_filter, "HOT", hot)
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet").limit(120)
    rows = {r.page_id: r for r in url_filter.judge(pages).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    held = {r.page_id: r.x for r in pages.select("page_id", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("x")).collect()}
    sides = [[u for i, u in urls.items() if _rule(u)[3] == v and not held[i]] for v in ("allow", "block")]
    accepted, rejected = (_markov(s, url_filter.ORDER) for s in sides)
    for i in list(urls)[:25]:
        u = urls[i]
        assert abs(rows[i].score - (accepted(u) - rejected(u)) / len(u)) < 1e-6


# --- op5 -------------------------------------------------------------------------------------------


def test_perspectives_equal_sql(spark):
    assert compare(QUERIES["op5_perspectives"](spark, SF_SMALL), duck_connection(SF_SMALL).sql(ORACLES["op5_perspectives"])) == []


@pytest.mark.parametrize("block,chars", [(2, 40), (256, 1 << 20)])
def test_perspectives_of_odd_rows(spark, monkeypatch, block, chars):
    monkeypatch.setattr(perspectives, "BLOCK", block)
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "hé\U0001f600"), (1, 2, "cy", None), (1, 1, "bob", "hé\U0001f600"), (1, None, "ann", "start"),
            (1, 7, None, "who?"), (2, 0, "ann", ""), (None, 3, "x", "lost"), (None, 1, "y", "too"), (1, 300, "ann", "late")]
    table = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, own int, perspective string")
    parts = perspectives.rotate(table, chars).collect()
    got = defaultdict(list)
    for r in sorted(parts, key=lambda r: r.part):
        assert r.start == sum(len(x.rendered) for x in got[r.conv_id, r.perspective])
        got[r.conv_id, r.perspective].append(r)
    for conv in (1, 2, None):
        own = sorted(((t is not None, t or 0, s or "unknown", x or "") for c, t, s, x in rows if c == conv))
        people = {s for _, _, s, _ in own}
        assert {p for c, p in got if c == conv} == people
        for p in people:
            text, masks = "", []
            for _, _, s, x in own:
                text += "<|im_start|>assistant\n" if s == p else f"<|im_start|>user name={s}\n"
                if s == p:
                    masks.append(f"{len(text)}-{len(text) + len(x) + len('<|im_end|>')}")
                text += x + "<|im_end|>\n"
            assert "".join(r.rendered for r in got[conv, p]) == text
            assert ",".join(r.masks for r in got[conv, p] if r.masks) == ",".join(masks)
            assert sum(r.n_turns for r in got[conv, p]) == len(own)
    assert perspectives.rotate(table.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    clean = cp.language_id(spark, docs, SF_SMALL)
    assert clean.columns == docs.columns
    found = clean.count()
    assert found >= 0.95 * docs.count()
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = cp.dedup(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    want = {i for (_, i, _, _, keep) in _expected(texts, 5) if keep}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    out = cp.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_ids", "round_trip", "parity"]
    assert out.filter("not round_trip or not parity").count() == 0 and {r.doc_id for r in out.collect()} <= want
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
        assert stage(spark, odd.select(*docs.columns), SF_SMALL).count() > 0
