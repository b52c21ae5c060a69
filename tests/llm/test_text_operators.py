"""Context mixing, mixing of sources, language ID and SentencePiece against brute-force versions."""

from __future__ import annotations

import math
import os
import random
import struct
import sys
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SF_CHECK, SF_SMALL  # noqa: E402

from pricelab.llm import context_mixing, langid, mixing, sentencepiece_codec, textbytes  # noqa: E402
from pricelab.llm.queries import QUERIES, SENTENCEPIECE_MODEL  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, size int"


def _words(text):
    return (text or "").encode().lower().split()


def _held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{k % 97}" for k in range(60_000))
    rows = [(1, "The cat sat on the mat.", "en", "a", 3, "x", 1), (1, "The cat sat on the mat.", "en", "a", 3, "x", 1),
            (2, "", "en", "a", 0, None, 2), (3, None, "fr", None, None, None, None), (4, "12 34 !?", None, "b", 5, "y", 3),
            (None, "le chat est sur la table", "fr", "b", 9, "z", 4), (5, long, "en", "c", 7, "q", 5),
            (6, "\x00\x01 odd bytes \U0001f600", "en", None, 1, "", 6), (7, " \t\n ", "fr", "c", 2, None, 7)]
    return spark.createDataFrame(rows, DOCS)


# --- bytes -----------------------------------------------------------------------------------------


def test_a_worker_gives_up_what_other_operators_left():
    """Near-dedup, which keeps nothing itself, and an operator with a key of its own free the tables and powers before theirs."""
    import pyarrow as pa

    from pricelab.llm import near_dedup

    rows = pa.RecordBatch.from_pydict({"rid": [1, 2], "doc_id": [1, 2], "text": ["a b c d e f", None]})
    for run in (near_dedup._signatures(5), near_dedup._involved_sets(5, type("B", (), {"value": bytes(near_dedup.BITMAP_BITS // 8)}))):
        textbytes.kept("large", lambda: np.zeros(9))
        list(run(iter([rows])))
        assert "large" not in textbytes._SLOT
    textbytes.powers(3, 10)
    textbytes.kept("other", lambda: None)
    assert not textbytes._POWERS and list(textbytes._SLOT) == ["other"]


def test_words_are_the_contract_words():
    import pyarrow as pa

    texts = ["a b  c", None, "", " x\x0b\x0cy z ", "Été\tété", "a"]
    buf, offsets = textbytes.column_bytes(pa.array(texts))
    h, n = textbytes.words(textbytes.lower(buf), offsets)
    assert n.tolist() == [len(_words(t)) for t in texts]
    flat = [w for t in texts for w in _words(t)]
    assert len({int(x) for x in h}) == len(set(flat))
    assert [int(x) for x in h].count(int(h[0])) == flat.count(b"a")


# --- op1 -------------------------------------------------------------------------------------------


def _base(rows):
    counts = Counter()
    for i, text in rows:
        if i is None or not _held(i, 7, 2):
            counts.update([*_words(text), None])
    n, v = sum(counts.values()), len(counts)
    return n, {r: (len(_words(r[1])) + 1, sum(counts[w] > 0 for w in [*_words(r[1]), None]),
                   sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*_words(r[1]), None])) for r in set(rows)}


def test_base_score_equals_brute_force(spark, docs, odd):
    for table, path in ((docs, None), (odd, "odd")):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        n, right = _base(rows)
        out = context_mixing.score_documents(table, "crc32(cast(doc_id as string)) % 7 <> 2").collect()
        assert len(out) == len(rows) and {r.train_tokens for r in out} == {n}
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out))
        want = sorted(((i is None, i or 0, right[i, t][0], right[i, t][1], round(right[i, t][2], 6)) for i, t in rows))
        assert got == want, path
        assert all(r.score < 0 and r.held_out == (r.doc_id is not None and _held(r.doc_id, 7, 2)) for r in out)


def test_rare_words_are_found_in_a_join(spark, docs, monkeypatch):
    monkeypatch.setattr(context_mixing, "HOT", 50)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    _, right = _base(rows)
    out = {r.doc_id: r for r in context_mixing.score_documents(docs, "crc32(cast(doc_id as string)) % 7 <> 2").collect()}
    for i, t in rows:
        assert out[i].n_known == right[i, t][1] and abs(out[i].base_score - right[i, t][2]) < 1e-6 * abs(right[i, t][2])


def test_mixing_is_a_probability_and_learns_online():
    """Over all one-byte texts the probabilities sum to one; a repeated pattern gets cheaper."""
    rng = np.random.default_rng(1)
    tables = [context_mixing.predictions(rng.integers(0, 20, 1 << 18)) for _ in context_mixing.ORDERS]
    every = np.arange(256, dtype=np.uint8)
    bits = context_mixing.code_lengths(tables, every, np.arange(257))
    assert abs(np.exp2(-bits).sum() - 1) < 1e-3
    once = np.frombuffer(b"abcdefgh" * 64, np.uint8)
    twice = np.concatenate([once] * 8)
    a = context_mixing.code_lengths(tables, once, np.array([0, len(once)]))[0]
    b = context_mixing.code_lengths(tables, twice, np.array([0, len(twice)]))[0]
    assert b < 8 * a
    # a text's score doesn't depend on the texts beside it
    both = context_mixing.code_lengths(tables, np.concatenate([once, twice]), np.array([0, len(once), len(once) + len(twice)]))
    assert np.allclose(both, [a, b], rtol=1e-5)


def _plain_mixer(tables, text):
    """Bits of a text, a bit at a time."""
    cm, whole = context_mixing, 2**64
    weights = [[w / cm.STRETCH for _ in range(8)] for w in cm.START_WEIGHTS]
    refine = [[1 / (1 + math.exp(cm.LIMIT - 2 * cm.LIMIT * c / (cm.REFINE - 1))) for c in range(cm.REFINE)] for _ in range(8)]
    bits, steps, seen = 0.0, [[0.0] * 8 for _ in weights], {}
    for i, byte in enumerate(text):
        past = bytes(cm.REACH + 2) + text[:i]
        word = 0
        while word < i and (97 <= text[i - 1 - word] <= 122 or text[i - 1 - word] >= 128):
            word += 1
        start = i - word - 1  # the byte before the word; in front of a text stand zeros
        since = ([text[start]] if start >= 0 else [0]) + list(text[i - word: i])
        numbers = [int.from_bytes(past[-order:], "little") for order in cm.ORDERS[:-1]]
        numbers.append(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, whole) for k, b in enumerate(since)) % whole)
        for b in range(8):
            bit, nibble, inside = byte >> (7 - b) & 1, byte >> 4 if b < 4 else byte & 15, b & 3
            node = (1 << inside) | nibble >> (4 - inside)
            inputs = []
            for table, number in zip(tables, numbers):
                spread = number * 0xD6E8FEB86659FD93 % whole
                line = spread >> (64 - (len(table).bit_length() - 5))
                if b >= 4:
                    line = (line >> 8 << 8) | ((spread + (byte >> 4)) * 0xA0761D6478BD642F % whole) >> 56
                inputs.append(float(table[line * 16 + node]))
            x = min(max(sum(w[b] * s for w, s in zip(weights, inputs)), -cm.LIMIT), cm.LIMIT)
            cell = int((x + cm.LIMIT) * (cm.REFINE - 1) / (2 * cm.LIMIT) + 0.5)
            p = 1 / (1 + math.exp(-x))
            mean = (p + refine[b][cell]) / 2
            bits -= math.log2(mean if bit else 1 - mean)
            for step, s in zip(steps, inputs):
                step[b] += (bit - p) * s
            n, ones = seen.get((b, cell), (0, 0))
            seen[b, cell] = (n + 1, ones + bit)
        if (i + 1) % cm.BLOCK == 0:
            for w, step in zip(weights, steps):
                for b in range(8):
                    w[b] += cm.RATE / cm.STRETCH**2 * step[b]
            for (b, cell), (n, ones) in seen.items():
                refine[b][cell] += (ones - n * refine[b][cell]) / (n + 12)
            steps, seen = [[0.0] * 8 for _ in weights], {}
    return bits


def test_score_equals_a_plain_mixer(docs, monkeypatch):
    """Texts of all sizes side by side, more than there are lanes, against one text and one bit at a time."""
    monkeypatch.setattr(context_mixing, "LANES", 5)
    rng = np.random.default_rng(7)
    tables = [context_mixing.predictions(rng.integers(0, 9, 1 << b) ** 2) for b in (13, 14, 16, 16)]
    texts = [r.text for r in docs.select("text").filter("length(text) > 0").limit(12).collect()]
    texts = [t.lower().encode()[:900] + b"\0" for t in texts] + [b"\0", bytes(range(256)) * 2, b"a" * 127 + b"\0", b"a" * 128 + b"\0"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    got = context_mixing.code_lengths(tables, buf, np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got, [_plain_mixer(tables, t) for t in texts], rtol=2e-3)


def test_scores_of_no_documents(spark, docs):
    assert context_mixing.score_documents(docs.limit(0), "true").count() == 0
    untrained = context_mixing.score_documents(docs, "false").agg(F.min("train_tokens"), F.max("score"), F.count("*")).first()
    assert untrained[0] == 0 and untrained[1] < 0 and untrained[2] == docs.count()


def test_scoring_holds_little_memory():
    cm = context_mixing
    bits = cm.table_bits(0)
    table = np.random.default_rng(5).integers(-3, 4, sum(1 << b for b in bits)).astype(np.int8)
    folded = cm._folded(table)
    assert len(folded) < 0.6 * table.nbytes and np.array_equal(cm._unfolded(folded, bits), table)
    text = pa.array(["some words that come again " * 300] * 600)
    columns = [pa.array(range(600)), pa.array(range(600)), pa.array([False] * 600), text]
    batch = pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "held_out", "text"])
    run = cm._score(SimpleNamespace(value=folded), bits, SimpleNamespace(value=(b"", b"")), (10, 10))
    tracemalloc.start()
    try:
        assert sum(len(b) for b in run(iter([batch]))) == 600 * 7  # a text's finished parts and its six rare words, one of them its end
        assert tracemalloc.get_traced_memory()[1] < 90e6  # 134 MB when 2 MB were scored at a time and words found in all of them
    finally:
        tracemalloc.stop()
        textbytes.forget()


def test_tables_grow_with_the_training_text():
    sizes = [sum(context_mixing.table_bits(10**k)) for k in range(5, 8)]
    assert sizes == sorted(set(sizes))
    assert max(context_mixing.table_bits(10**15)) == context_mixing.MAX_BITS


def test_held_out_texts_are_compressed(spark):
    """Well under the entropy of single bytes (about 4.1 bits in these texts), and under that of trained texts by little."""
    out = QUERIES["op1_context_mixing"](spark, SF_CHECK).filter("n_tokens > 20")
    bits = {r.held_out: r.b for r in out.groupBy("held_out").agg(F.avg("bits_per_byte").alias("b")).collect()}
    assert bits[True] < 2.6 and bits[False] < bits[True] < bits[False] + 0.6


# --- op2 -------------------------------------------------------------------------------------------


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = dict(zip(names, (w for _ in names for w in (3, 1, 2))))
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = budget - sum(fixed.values())
        total = sum(weight[s] for s in rest)
        made = {s: share * weight[s] / total for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if made[s] > 2 * sizes[s]}
        if not over:
            return fixed | made
        fixed |= over


def test_mix_targets_and_fit(spark, docs, odd):
    for table in (spark.read.parquet(f"{SF_CHECK}/documents.parquet"), docs, odd):
        out = mixing.mix_table(table).collect()
        rows = [(r.doc_id, r.source, len(_words(r.text))) for r in table.select("doc_id", "source", "text").collect()]
        assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((i or -1, n) for i, _, n in rows)
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        right = _targets(dict(sizes))
        by_id = {i: s for i, s, _ in rows}
        taken, longest = Counter(), Counter()
        for r in out:
            s = by_id[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - right[s]) < 1e-6 * max(1, right[s])
            assert r.taken in (0, r.size, 2 * r.size)
            taken[s] += r.taken
            longest[s] = max(longest[s], r.size)
        for s in sizes:
            assert right[s] - longest[s] - 1 <= taken[s] <= right[s] + 1
        again = mixing.mix_table(table.repartition(5)).collect()
        assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("window", [1, 8, mixing.WINDOW])
def test_budget_fit_equals_brute_force(window):
    """The best sum of all choices, whatever the window that the programme starts with."""
    rng = random.Random(3)
    for _ in range(300):
        lengths = rng.sample(range(0, 40), rng.randint(1, 5))
        counts = [rng.randint(0, 4) for _ in lengths]
        rest = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)) + 2)
        take = mixing.fit_counts(lengths, counts, rest, window)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        sums = {0}
        for a, c in zip(lengths, counts):
            sums = {s + a * k for s in sums for k in range(c + 1)}
        assert sum(a * b for a, b in zip(lengths, take)) == max(s for s in sums if s <= rest)


def test_budget_fit_of_long_documents():
    """More words left than the first window holds."""
    assert mixing.fit_counts([70_000, 100_000], [1, 1], 100_000) == [0, 1]
    rng = random.Random(5)
    lengths = rng.sample(range(20, 60_000), 600)
    counts = [rng.randint(1, 50) for _ in lengths]
    rest = sum(a * b for a, b in zip(lengths, counts)) * 37 // 100
    assert sum(a * b for a, b in zip(lengths, mixing.fit_counts(lengths, counts, rest))) == rest
    # two lengths that fit no sum well: the best sum found, not a crash
    take = mixing.fit_counts([999_983, 1_000_003], [10**6] * 2, 10**11 + 12_345)
    assert 0 <= 10**11 + 12_345 - take[0] * 999_983 - take[1] * 1_000_003 < 999_983


def test_mix_of_one_large_group(spark):
    """A third of all rows with one source and length: the cut through hash ranges takes the right number."""
    rows = [(i, "a b c", "s0") for i in range(3000)] + [(10_000 + i, "x " * (i % 50 + 1), f"s{i % 3}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_table(table).collect()
    taken = Counter()
    for r in out:
        taken[r.target] += r.taken
    assert all(abs(t - n) <= 2 for t, n in taken.items())
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    assert mixed.count() == sum(r.times for r in out)


def test_mix_of_an_empty_table(spark, docs):
    assert mixing.mix_table(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0


# --- op3 -------------------------------------------------------------------------------------------


def test_code_lengths_equal_a_plain_context_tree(spark, docs):
    """Exact code lengths against dictionaries of counts."""
    rows = [(r.lang, r.text) for r in docs.limit(40).collect()]
    order = 3
    model = langid.fit(spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string"), max_order=order)
    trees = {x: Counter() for x in model.languages}
    for x, t in rows:
        b = b"\n" * (2 * order) + t.encode().lower()
        for at in range(order, len(b)):
            for k in range(order + 1):
                trees[x][b[at - k: at + 1]] += 1

    def cost(tree, context, c):
        if not len(context) and False:
            return 8.0
        following = [n for s, n in tree.items() if len(s) == len(context) + 1 and s.startswith(context)]
        n, d = sum(following), len(following)
        if tree.get(context + c):
            return math.log2((n + d) / tree[context + c])
        escape = math.log2((n + d) / d) if n else 0.0
        return escape + (cost(tree, context[1:], c) if context else 8.0)

    text = rows[0][1][:60] + " Zq9ü中"
    b = text.encode().lower()
    padded = b"\n" * order + b
    got = langid.code_lengths(model, np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
    for j, x in enumerate(model.languages):
        want = sum(cost(trees[x], padded[i: i + order], padded[i + order: i + order + 1]) for i in range(len(b)))
        assert abs(got[j] - want) < 0.01


def test_pieces_of_a_long_text_add_up(monkeypatch, spark, docs):
    model = langid.fit(docs)
    buf = np.frombuffer("\n".join(r.text for r in docs.limit(30).collect()).encode().lower(), np.uint8)
    offsets = np.array([0, len(buf) // 3, len(buf)])
    whole = langid.code_lengths(model, buf, offsets)
    monkeypatch.setattr(textbytes, "STEP_BYTES", 1000)
    assert np.allclose(langid.code_lengths(model, buf, offsets), whole, rtol=1e-6)


def test_groups_of_languages(spark, docs, monkeypatch):
    """Any number of languages: code lengths don't depend on how the languages are grouped."""
    texts = [r.text for r in docs.limit(150).collect()]
    rows = [(i, f"l{i:03}", t) for i, t in enumerate(texts + [t[::-1] for t in texts])]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    whole = langid.fit(table)
    assert len(whole.languages) == len(rows) == 300 and len(whole.groups) == 2
    monkeypatch.setattr(langid, "GROUP", 70)
    parts = langid.fit(table)
    assert len(parts.groups) == 5 and parts.languages == whole.languages
    buf = np.frombuffer("".join(t for _, _, t in rows[:5]).encode().lower() + b"Zq9", np.uint8)
    offsets = np.array([0, len(buf) // 2, len(buf)])
    assert np.allclose(langid.code_lengths(whole, buf, offsets), langid.code_lengths(parts, buf, offsets), rtol=1e-5)
    own = {r.doc_id: r.lang_pred for r in langid.identify(table.withColumnRenamed("lang", "label"), parts).collect()}
    assert sum(own[i] == x for i, x, _ in rows) > 250


def test_held_out_accuracy(spark):
    out = QUERIES["op3_language_id"](spark, SF_CHECK)
    truth = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang", "n_chars")
    right, n = out.filter("held_out").join(truth.filter("n_chars >= 100"), "doc_id").selectExpr(
        "avg(cast(lang_pred = lang as int))", "count(*)").first()
    assert n > 200 and right > 0.97


def test_language_of_odd_rows(spark, odd):
    model = langid.fit(odd)
    out = langid.identify(odd, model)
    assert set(out.columns) == {*odd.columns, "score", "bits_per_byte"}
    rows = out.collect()
    assert len(rows) == 9
    for r in rows:
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == "und" if not letters else r.lang_pred in ("en", "fr")
    nothing = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


# --- op4 -------------------------------------------------------------------------------------------


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _unigram_model():
    """A small hand-written unigram model with byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    words = ["▁", "▁the", "the", "th", "e", "t", "h", "a", "▁a", "s", "▁s", "at", "▁at", "sat", "▁sat", "c", "▁c", "m", "n", "o", "on", "▁on", "é"]
    pieces += [(w, -1.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    trainer = _field(3, 1) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2)
    normalizer = _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1)
    return body + _field(2, trainer) + _field(3, normalizer)


TEXTS = ["", " ", "  a", "the cat sat on a mat", "the  cat\nsat", "été \U0001f600 漢字", "▁the▁ cat", "a" * 500, "<s> </s> <unk> <0x0A>",
         "x\ty\x00z", "The thé at", "tab\t\tend ", "the " * 50]


@pytest.mark.parametrize("model", ["file", "unigram"])
def test_parity_with_the_reference_library(docs, model):
    import sentencepiece

    data = open(SENTENCEPIECE_MODEL, "rb").read() if model == "file" else _unigram_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepiece_codec.codec_of(data)
    lookup = sentencepiece_codec._Lookup(codec.spec)
    texts = TEXTS + [r.text for r in docs.limit(60).collect()]
    for text, ids, right in zip(texts, codec.encode(texts), reference.encode(texts)):
        assert ids.tolist() == right, text[:80]
        assert lookup.decode(ids).decode("utf-8", "replace") == reference.decode(right), text[:80]
    some = codec.encode(texts[3:5])
    assert codec.decode(some) == [reference.decode(x.tolist()) for x in some]


def test_parity_is_false_where_the_reference_differs():
    """A part that is encoded wrongly makes every text that holds it differ, and no other; so does a wrong byte table."""
    import sentencepiece

    data = open(SENTENCEPIECE_MODEL, "rb").read()
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepiece_codec.codec_of(data)
    lookup = sentencepiece_codec._Lookup(codec.spec)
    texts = [*TEXTS, "wrong here", "right there", "there", "wrong", ""]
    made = [codec.parts(t) for t in texts]
    doubts: set[str] = set()
    assert all(sentencepiece_codec.parity(texts, made, codec.encode_parts(made), codec, lookup, reference, doubts))
    wrong = codec.parts("wrong")[0]
    codec.known[wrong] = np.array([5, 6], np.int32).tobytes()
    codec.fresh = [wrong, *codec.parts("there")]
    for _ in range(2):  # what differs isn't taken for right the next time
        ids = [np.frombuffer(b"".join(codec.known[w] for w in ws), np.int32) for ws in made]
        same = sentencepiece_codec.parity(texts, made, ids, codec, lookup, reference, doubts)
        assert same == [True] * len(TEXTS) + [False, True, True, False, True]
        codec.fresh = []
    codec = sentencepiece_codec.codec_of(data)
    lookup.bytes = lookup.bytes[::-1]
    ids = codec.encode_parts(made)
    assert not any(s for s, x in zip(sentencepiece_codec.parity(texts, made, ids, codec, lookup, reference, set()), ids) if len(x))


def test_parts_that_come_again_stay_in_a_full_cache(monkeypatch):
    """The parts that every call brings are encoded once, however many others come between; parts encoded side by side
    have the ids that each has alone."""
    monkeypatch.setattr(sentencepiece_codec, "CACHE_WORDS", 40)
    monkeypatch.setattr(sentencepiece_codec, "JOINED", 7)
    codec = sentencepiece_codec.codec_of(open(SENTENCEPIECE_MODEL, "rb").read())
    every = codec.parts("these words come in every text")
    encoded: list[str] = []
    for k in range(30):
        some = codec.parts(" ".join(f"word{k}x{i}" for i in range(11)) + "  two été \U0001f600 ")
        ids = codec.encode_parts([every, some])
        encoded += codec.fresh
        alone = [np.array(codec._tokenizer.encode(w, add_special_tokens=False).ids, np.int32) for w in [*every, *some]]
        assert np.concatenate(ids).tolist() == np.concatenate(alone).tolist()
        assert len(codec.known) + len(codec.older) <= 2 * 40 + len(every) + len(some)
    assert all(encoded.count(w) == 1 for w in every)


def test_encode_and_decode_round_trip(spark, odd):
    data = open(SENTENCEPIECE_MODEL, "rb").read()
    out = sentencepiece_codec.encode(odd, data)
    back = sentencepiece_codec.decode(out, data).collect()
    assert len(back) == 9 and all(r.round_trip and r.parity for r in back)
    for r in back:
        assert r.decoded == (r.text or "") and r.n_ids == len(r.ids)
    assert sentencepiece_codec.encode(odd.limit(0), data).count() == 0


def test_rare_words_meet_in_a_plain_join(spark, monkeypatch):
    """No bucket of words goes whole into one task, and the scores are the same whether words are hot or rare."""
    rows = [(k, " ".join(f"v{(k * 7 + x * x) % 211}" for x in range(40)) + " novel" * (k % 5)) for k in range(60)] + [(None, None), (3, "v1 v1 zz")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    order = ["doc_id", "n_tokens", "n_known", "base_score"]
    hot = context_mixing.score_documents(table, "doc_id % 5 = 0").orderBy(order).collect()
    monkeypatch.setattr(context_mixing, "HOT", 0)
    rare = context_mixing.score_documents(table, "doc_id % 5 = 0")
    assert "CoGroup" not in rare._jdf.queryExecution().executedPlan().toString()
    rare = rare.orderBy(order).collect()
    assert len(hot) == len(rows)
    for a, b in zip(hot, rare, strict=True):
        assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens, a.score) == (b.doc_id, b.held_out, b.n_tokens, b.n_known, b.train_tokens, b.score)
        assert abs(a.base_score - b.base_score) < 1e-9
