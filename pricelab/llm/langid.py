"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language:

* counts of every (k+1)-byte string, k = 0 .. ``max_order``, per language, are summed by Spark over a
  bounded sample of labelled documents (``docs_per_language`` documents of each language in expectation,
  chosen by a hash of their id; whole texts). Only these sums come to the driver;
* in a context seen n times with d different next bytes, a byte seen c times has probability c / (n + d)
  and the escape to the next shorter context d / (n + d); a context that a language has not seen costs
  it nothing, and below order 0 every byte costs 8 bits. The statistics are then frozen;
* a text's exact code length under each language is the sum over all of its bytes. Lookups are chained:
  the number of the longest known string that ends at a byte follows from that of the byte before.

Prediction: the language with the shortest code length (ties: the smallest name); ``score`` is its
posterior probability under equal priors. A text that is null or has no letter is ``und`` with score 0,
as is every text when nothing was learned. Texts are used whole, in pieces of ``STEP_BYTES``
with the bytes before them as context, so memory does not grow with a text's length. Repeated rows give
repeated result rows; an empty table gives an empty result. Columns of the input that have the names of
the result's columns are replaced; all others pass through. Any number of languages: their tables are made and
looked up by ``GROUP`` of them, and a text's cost under one language depends on no other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab.llm import textbytes as tb
from pricelab.session import ensure_checkpoint_dir

if TYPE_CHECKING:  # workers of this module don't need pandas, which would add to each one's memory
    import pandas as pd

UNDETERMINED = "und"
#: Languages whose tables are dense in one another; further languages get tables of their own.
GROUP = 256
PAD = 0x0A
#: Bytes of text that one step looks up; its tables of numbers take about a hundred times as much.
STEP_BYTES = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _pieces(buf: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces of texts: (text number, buffer, begin, end), each piece led by ``order`` bytes of context."""
    pad = np.full(order, PAD, np.uint8)
    doc, parts, begin, end, size = [], [], [], [], 0
    for d in range(len(offsets) - 1):
        for a in range(int(offsets[d]), int(offsets[d + 1]), STEP_BYTES):
            b = min(a + STEP_BYTES, int(offsets[d + 1]))
            parts += [pad if a == offsets[d] else buf[a - order: a], buf[a:b]]
            doc.append(d)
            begin.append(size + order)
            size += order + b - a
            end.append(size)
            if size >= STEP_BYTES:
                yield np.array(doc), np.concatenate(parts), np.array(begin), np.array(end)
                doc, parts, begin, end, size = [], [], [], [], 0
    if doc:
        yield np.array(doc), np.concatenate(parts), np.array(begin), np.array(end)


def _count(max_order: int):
    """Rows (lang, k, gram, n) of the texts of each batch; grams are big-endian numbers of k + 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang = np.unique(np.asarray(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            buf, offsets = tb.column_bytes(batch.column("text"))
            # twice the pad: strings of pad bytes alone are counted too, so that every string's prefix is known
            for doc, flat, begin, end in _pieces(tb.lower(buf), offsets, 2 * max_order):
                inside = np.concatenate([np.arange(b - max_order, e) for b, e in zip(begin, end)])
                owner = np.repeat(lang[doc], end - begin + max_order)
                gram = np.zeros(len(inside), np.uint64)
                for k in range(max_order + 1):
                    gram |= flat[inside - k].astype(np.uint64) << np.uint64(8 * k)
                    keys, n = np.unique(gram * np.uint64(len(names)) + owner.astype(np.uint64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[(keys % np.uint64(len(names))).astype(np.int64)].tolist(), pa.string()),
                         pa.array(np.full(len(keys), k, np.int32)),
                         pa.array((keys // np.uint64(len(names))).view(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "k", "gram", "n"])

    return run


@dataclass
class Tables:
    """Frozen statistics of some languages. ``grams[k]``: sorted strings of k + 1 bytes; ``costs[k]``: bits of each one's
    last byte per language; ``escapes[k]``: bits of the escape from context ``grams[k - 1]``."""

    n_languages: int
    grams: list[np.ndarray]
    costs: list[np.ndarray]
    escapes: list[np.ndarray]

    def steps(self) -> list[np.ndarray]:
        """next[k][number of the string before * 256 + byte]: the number of the string with that byte added,
        or one past the last number if it isn't known."""
        out, before = [], np.zeros(1, np.uint64)
        for k, gram in enumerate(self.grams):
            step = np.full((len(before) + (k > 0)) * 256, len(gram), np.int32)
            parent = np.searchsorted(before, gram >> np.uint64(8)) if k else np.zeros(len(gram), np.int64)
            step[parent * 256 + (gram & np.uint64(255)).astype(np.int64)] = np.arange(len(gram), dtype=np.int32)
            out.append(step)
            before = gram
        return out


@dataclass
class Model:
    """The languages by name, and the tables of each ``GROUP`` of them."""

    languages: list[str]
    max_order: int
    groups: list[Tables]
    key: str


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        docs_per_language: int = 1000, max_order: int = 3, seed: int = 17) -> Model:
    """Learn from the rows of ``labelled`` that have a language and a text."""
    rows = (labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
                            F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 30)).alias("h"))
            .filter("lang is not null and text is not null"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).toPandas()  # a row for each language, as in the model
    languages = sorted(sizes["lang"])
    if not languages:
        return Model([], max_order, [], uuid.uuid4().hex)
    cuts = [(x, min(1 << 30, int(docs_per_language / n * (1 << 30)) + 1)) for x, n in zip(sizes["lang"], sizes["n"].tolist())]
    cuts = labelled.sparkSession.createDataFrame(cuts, "lang string, cut long")
    sample = rows.join(F.broadcast(cuts), "lang").filter("h < cut").select("lang", "text")
    counts = (sample.mapInArrow(tb.frugal(_count(max_order)), "lang string, k int, gram long, n long")
              .groupBy("k", "gram", "lang").agg(F.sum("n").alias("n")))
    parts = [languages[i: i + GROUP] for i in range(0, len(languages), GROUP)]
    if len(parts) > 1:
        ensure_checkpoint_dir(labelled.sparkSession)
        counts = counts.checkpoint()
    groups = [_tables(part, (counts if len(parts) == 1 else counts.filter(F.col("lang").isin(part))).toPandas(), max_order)
              for part in parts]
    return Model(languages, max_order, groups, uuid.uuid4().hex)


def _tables(languages: list[str], counts: pd.DataFrame, max_order: int) -> Tables:
    """The tables of ``languages`` from the counts (k, gram, lang, n) of their strings."""
    number = {x: i for i, x in enumerate(languages)}
    grams, costs, escapes = [], [], []
    for k in range(max_order + 1):
        own = counts[counts["k"] == k]
        values = own["gram"].to_numpy(np.int64).view(np.uint64)
        gram, at = np.unique(values, return_inverse=True)
        c = np.zeros((len(gram), len(languages)))
        np.add.at(c, (at, own["lang"].map(number).to_numpy(np.int64)), own["n"].to_numpy(np.float64))
        context = gram >> np.uint64(8)
        if k:
            parent = np.searchsorted(grams[k - 1], context)
            total = np.zeros((len(grams[k - 1]) + 1, len(languages)))
            kinds = np.zeros_like(total)
        else:
            parent, total, kinds = np.zeros(len(gram), np.int64), np.zeros((1, len(languages))), np.zeros((1, len(languages)))
        np.add.at(total, parent, c)
        np.add.at(kinds, parent, (c > 0).astype(float))
        known = total > 0
        escape = np.where(known, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
        if k:
            shorter = costs[k - 1][np.searchsorted(grams[k - 1], gram & np.uint64((1 << (8 * k)) - 1))]
        else:
            shorter = np.full((len(gram), len(languages)), 8.0)
        seen = np.log2(np.maximum((total + kinds)[parent], 1)) - np.log2(np.maximum(c, 1))
        grams.append(gram)
        costs.append(np.where(c > 0, seen, escape[parent] + shorter))
        escapes.append(escape)
    as32 = lambda xs: [np.ascontiguousarray(x.T.astype(np.float32)) for x in xs]
    return Tables(len(languages), grams, as32(costs), as32(escapes))


def code_lengths(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    steps = tb.kept(("langid", model.key), lambda: [g.steps() for g in model.groups])
    none = [np.zeros((len(offsets) - 1, 0))]
    return np.hstack([*none, *(_group_lengths(g, s, model.max_order, buf, offsets) for g, s in zip(model.groups, steps))])


def _group_lengths(model: Tables, tables: list[np.ndarray], order: int, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language of one group."""
    n_langs = model.n_languages
    bits = np.zeros((len(offsets) - 1, n_langs))
    for doc, flat, begin, end in _pieces(buf, offsets, order):
        byte = flat.astype(np.int32)
        ids = [tables[0][byte]]
        for k in range(1, order + 1):
            # bytes before the buffer's first one matter to its context alone, which is not scored
            step = byte.copy()
            step[1:] += ids[-1][:-1] * 256
            step[0] += len(model.grams[k - 1]) * 256
            ids.append(tables[k][step])
        scored = np.zeros(len(flat), bool)
        for b, e in zip(begin, end):
            scored[b:e] = True
        missing = np.flatnonzero(scored & (ids[order] == len(model.grams[order])))
        extra = np.zeros((n_langs, len(missing)))
        left = np.arange(len(missing))
        for k in range(order, -1, -1):
            at = missing[left]
            context = ids[k - 1][at - 1] if k else np.zeros(len(at), np.int32)
            extra[:, left] += model.escapes[k][:, context]
            now = ids[k - 1][at] if k else None
            found = now < len(model.grams[k - 1]) if k else np.zeros(len(at), bool)
            if k:
                extra[:, left[found]] += model.costs[k - 1][:, now[found]]
            else:
                extra[:, left] += 8.0
            left = left[~found]
            if not len(left):
                break
        bounds = np.stack([begin, end], 1).ravel()
        for lang in range(n_langs):
            cost = np.append(model.costs[order][lang], np.float32(0))[ids[order]].astype(np.float64)
            cost[missing] += extra[lang]
            sums = np.add.reduceat(np.append(cost, 0.0), bounds)[::2]
            np.add.at(bits[:, lang], doc, sums)
    return bits


def _has_letter(column: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    for i, j in tb.steps(offsets, STEP_BYTES):
        letters = np.zeros(int(offsets[j] - offsets[i]) + 1, np.int32)
        np.cumsum(_LETTER[buf[offsets[i]: offsets[j]]], out=letters[1:])
        own = offsets[i: j + 1] - offsets[i]
        out[i:j] = letters[own[1:]] > letters[own[:-1]]
    for d in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[d] = any(c.isalpha() for c in column[int(d)].as_py() or "")
    return out


def _predict(model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            column = batch.column(text).cast(pa.string())
            buf, offsets = tb.column_bytes(column)
            n = len(column)
            named = _has_letter(column, buf, offsets) & bool(m.languages)
            best, score, rate = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if m.languages and n:
                bits = code_lengths(m, tb.lower(buf), offsets)
                best = bits.argmin(1)
                least = bits[np.arange(n), best]
                score = np.where(named, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0.0)
                rate = least / np.maximum(np.diff(offsets), 1)
            names = np.array([*m.languages, UNDETERMINED], dtype=object)[np.where(named, best, len(m.languages))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rate)],
                [*keep, "lang_pred", "score", "bits_per_byte"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and bits_per_byte under the predicted language."""
    made = ("lang_pred", "score", "bits_per_byte")
    keep = [c for c in docs.columns if c not in made]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*keep).mapInArrow(tb.frugal(_predict(shared, text, keep)), schema)
