"""Language-model scoring by online logistic context mixing, beside a unigram base score.

Statistics (one pass over all training documents, summed by Spark)
    Every byte of a text (A-Z lower-cased, one zero byte as its end) is two nibbles. For each of the
    contexts of ``ORDERS`` (the last 3, 4 and 6 bytes, and the word so far with the byte before it)
    the context is hashed to a line of 16 counters for the first nibble, and with that nibble to a line
    for the second one. The tables grow with the training text, about a counter a byte for the longest
    contexts, up to ``2 ** MAX_BITS`` counters; contexts that meet in a line share it. The counters give, for
    each of the four bits of a nibble, a frozen bit prediction.
    Counts of the training words are gathered too, for the base score; their number grows with the corpus.

Mixing (online, inside each text, from the same start, so a text's score depends on nothing else)
    The predictions of all contexts enter a logistic mixer in the stretched domain. Its weights are
    gated: each of the 8 bit positions of a byte has a set of its own. After every ``BLOCK`` bytes the
    weights take one step down the gradient of that block's code length (a text's last block moves nothing).
    The mixed probability is refined by an adaptive map of ``REFINE`` cells per bit position, which learns from every
    byte of the text's earlier blocks, and averaged with the unrefined one. Code lengths add up to the score.

Blocks are handled for many texts at once in numpy; a long text is many blocks. Nothing but the
prediction table (at most 2.75 * 2 ** MAX_BITS bytes) and the most frequent words (at most ``HOT`` by the pigeonhole principle) is broadcast.
Rare words are counted in each text first; the counts meet the training counts in a plain join on the word, which
sorts and spills, so no task holds all occurrences of a word or of a part of the vocabulary.

Words are identified by a 64-bit hash. Null texts are empty. A row with a null doc_id counts as training
data. Repeated rows are scored as separate rows. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelab.llm import textbytes as tb
from pricelab.session import ensure_checkpoint_dir

ORDERS = (3, 4, 6, "word")
FEWER = (2, 1, 0, 0)  # powers of two by which a context's table is smaller than the largest
REACH = 6  # bytes that the longest context holds
MIN_BITS, MAX_BITS = 18, 24  # counters of a context, as powers of two
BLOCK = 128
SCORE_BYTES = 1 << 20  # texts that are scored in one step
CONTEXT_BYTES = 1 << 16  # texts whose contexts are found in one step
LANES = 64  # texts that are mixed side by side
REFINE = 25
PACK = 1 << 16  # counters of a block
SENT = 8  # blocks that a task hands on at a time
FAN_IN = 128
HOT = 1_000_000  # words that come more often than once in so many are broadcast, 16 bytes each
STRETCH = 16.0  # table steps of the stretched domain per unit
START_WEIGHTS = (0.4, 0.25, 0.3, 0.15)  # of the contexts, before a text has been seen
RATE = 0.0015
LIMIT = 9.0  # of the mixed stretched probability

U64 = np.uint64

_VALUES = np.arange(256)
#: For each of the eight bits and each byte, the bit's node inside its line.
_NODES = np.stack([(1 << (b & 3)) | ((_VALUES >> 4 if b < 4 else _VALUES & 15) >> (4 - (b & 3))) for b in range(8)])
_BITS = np.stack([_VALUES >> (7 - b) & 1 for b in range(8)])
_SIGNS = (2 * _BITS - 1).astype(np.float32)


def table_bits(n_bytes: int) -> tuple[int, ...]:
    """The counters of each context, as powers of two: about one for each byte of training text for the longest
    contexts, fewer for the shorter ones, within MIN_BITS and MAX_BITS."""
    most = min(int(n_bytes).bit_length(), MAX_BITS)
    return tuple(max(most - fewer, MIN_BITS) for fewer in FEWER)


def _padded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with REACH zero bytes before each, and the places of their own bytes there."""
    at = np.repeat(np.arange(1, len(offsets)) * REACH, np.diff(offsets))
    at += np.arange(len(buf))
    out = np.zeros(len(buf) + (len(offsets) - 1) * REACH, np.uint8)
    out[at] = buf
    return out, at


def contexts(padded: np.ndarray) -> Iterator[np.ndarray]:
    """Yield for each of ORDERS a 64-bit number of the context of every byte; before a text stand zero bytes."""
    n = len(padded)
    before = np.concatenate([np.zeros(8, np.uint8), padded])
    recent = np.ndarray(n, "<u8", before, strides=(1,))  # the last eight bytes, the newest on top
    for order in ORDERS[:-1]:
        yield recent >> U64(64 - 8 * order)
    wide = padded.astype(U64) + U64(1)
    # the word so far, from the last byte that is no letter on: a polynomial read off prefix sums
    letter = ((padded >= 97) & (padded <= 122)) | (padded >= 128)
    index = np.arange(n)
    since = np.zeros(n, np.int64)
    since[1:] = np.maximum.accumulate(np.where(letter, 0, index))[:-1]
    root = 0x9E3779B97F4A7C15
    powers, inverse = tb.powers(root, n), tb.powers(pow(root, -1, 1 << 64), n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(wide * powers[:-1], out=sums[1:])
    yield (sums[:-1] - sums[since]) * inverse[since]


def _lines(context: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a byte's two nibbles, in tables of 2 ** bits counters."""
    spread = context * U64(0xD6E8FEB86659FD93)
    first = (spread >> U64(64 - (bits - 4))).astype(np.uint32)
    # another place in the same 256 lines, so that both are in one page of memory
    second = ((spread + high) * U64(0xA0761D6478BD642F) >> U64(56)).astype(np.uint32)
    second |= first & np.uint32(0xFFFFFF00)
    return first, second


def _text_ends(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a zero byte after each."""
    at = offsets[1:]
    return np.insert(buf, at, 0), offsets + np.arange(len(offsets))


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' words by hash and how many each has, found in some texts at a time: the numbers a byte takes on
    the way are many times its size."""
    found = [tb.words(buf[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]) for i, j in tb.steps(offsets, CONTEXT_BYTES)]
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])


def _gather_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n): words by hash, summed over some millions of words."""
    held: list[np.ndarray] = []
    size = 0

    def rows() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for batch in batches:
        buf, offsets = tb.column_bytes(batch.column("text"))
        for i, j in tb.steps(offsets):
            h, per_doc = _words(tb.lower(buf[offsets[i]: offsets[j]]), offsets[i: j + 1] - offsets[i])
            held += [h, np.full(len(per_doc), END, U64)]
            size += len(h) + len(per_doc)
            if size > 4_000_000:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


PACKED = "part long, block int, packed binary"


def _packed(part: int, counts: list[np.ndarray]) -> Iterator[tuple]:
    """(part, block, bytes) for each block with counts: how many, their places, their counts. Blocks are
    numbered through all contexts."""
    for block, own in enumerate(x for table in counts for x in table.reshape(-1, PACK)):
        at = np.flatnonzero(own)
        if len(at):
            yield part, block, _pack(at, own[at])


def _pack(at: np.ndarray, n: np.ndarray) -> bytes:
    narrow = int(n.max(initial=0)) < 1 << 32
    return (b"\x04" if narrow else b"\x08") + at.astype("<u2").tobytes() + n.astype("<u4" if narrow else "<u8").tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = packed[0]
    n = (len(packed) - 1) // (2 + width)
    return np.frombuffer(packed, "<u2", n, 1), np.frombuffer(packed, f"<u{width}", n, 1 + 2 * n)


def _gather_counters(bits: tuple[int, ...]):
    """The contexts' counters of one partition of texts, packed in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << b, np.uint32) for b in bits]  # a partition's texts have far fewer than 2^32 bytes
        for batch in batches:
            buf, offsets = tb.column_bytes(batch.column("text"))
            for i, j in tb.steps(offsets, CONTEXT_BYTES):
                padded, at = _padded(*_text_ends(tb.lower(buf[offsets[i]: offsets[j]]), offsets[i: j + 1] - offsets[i]))
                high, low = padded >> 4, padded & 15
                for k, context in enumerate(contexts(padded)):
                    for line, nibble in zip(_lines(context, high, bits[k]), (high, low)):
                        np.add.at(counts[k], ((line << np.uint32(4)) + nibble)[at], np.uint32(1))
        context = TaskContext.get()
        rows = _packed(context.partitionId() if context else 0, counts)
        while some := list(islice(rows, SENT)):
            part, block, packed = zip(*some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(block, pa.int32()), pa.array(packed, pa.binary())], ["part", "block", "packed"])

    return tb.frugal(run)


def _total(rows: pa.Table) -> np.ndarray:
    total = np.zeros(PACK, np.uint64)
    for packed in rows["packed"]:
        at, n = _unpack(packed.as_py())
        total[at] += n
    return total


def _sum_packed(rows: pa.Table) -> pa.Table:
    """Up to FAN_IN parts of one block -> their sum."""
    total = _total(rows)
    at = np.flatnonzero(total)
    return pa.table({"part": rows["part"][:1], "block": rows["block"][:1], "packed": pa.array([_pack(at, total[at])], pa.binary())})


def _sum_predict(rows: pa.Table) -> pa.Table:
    """The last parts of one block -> its predictions, one byte each."""
    return pa.table({"block": rows["block"][:1], "packed": pa.array([predictions(_total(rows)).tobytes()], pa.binary())})


def block_predictions(texts: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    """(block, packed) over all texts: a tree of sums, each of at most FAN_IN parts of a block, as high as the partitions need."""
    rows = texts.mapInArrow(_gather_counters(bits), PACKED)
    parts = texts.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "block").applyInArrow(_sum_packed, PACKED)
    return rows.groupBy("block").applyInArrow(_sum_predict, "block int, packed binary")


#: The word hash of the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


def predictions(counts: np.ndarray) -> np.ndarray:
    """Counters of lines of 16 -> stretched probabilities of a one at the 15 nodes of each line (node 0 unused), as int8."""
    leaves = counts.reshape(-1, 16).astype(np.float64)
    out = np.zeros((len(leaves), 16), np.int8)
    for depth in range(4):
        sums = leaves.reshape(len(leaves), 2 << depth, -1).sum(2)
        zero, one = sums[:, 0::2], sums[:, 1::2]
        stretch = np.log((one + 0.1) / (zero + 0.1))
        out[:, 1 << depth: 2 << depth] = np.clip(np.round(stretch * STRETCH), -127, 127)
    return out.ravel()


def code_lengths(tables: list[np.ndarray], buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under the mixed model; ``tables``: the int8 predictions of each context."""
    size = np.diff(offsets)
    padded = _padded(buf, offsets)[0]
    begin = offsets[:-1] + np.arange(1, len(offsets)) * REACH
    # lines of some texts at a time: what they need is then in the processor's cache
    first, second = np.empty((len(padded), len(ORDERS)), np.uint32), np.empty((len(padded), len(ORDERS)), np.uint8)
    for i, j in tb.steps(offsets, CONTEXT_BYTES):
        own = slice(begin[i] - REACH, begin[j - 1] + size[j - 1])
        high = padded[own] >> 4
        for k, context in enumerate(contexts(padded[own])):
            first[own, k], other = _lines(context, high, len(tables[k]).bit_length() - 1)
            second[own, k] = other & np.uint32(255)  # the rest is the first one's
    return _mix(tables, padded, first, second, begin, size)


class _Room:
    """Arrays of a block of all lanes, used over and over."""

    def __init__(self, n_in: int, n: int):
        shape = (8, n, BLOCK)
        self.inputs = np.empty((n_in, *shape), np.float32)
        self.mixed, self.other, self.sign = (np.empty(shape, np.float32) for _ in range(3))
        self.node, self.cell = (np.empty(shape, np.int64) for _ in range(2))
        self.picked = np.empty(shape, np.int8)
        self.met = np.empty((2, n, BLOCK), "V16")


def _mix(tables: list[np.ndarray], buf: np.ndarray, first: np.ndarray, second: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of each text. LANES texts are mixed side by side, a block of each at a time; where one ends, the next begins."""
    n_in = len(ORDERS)
    whole = [t.view("V16") for t in tables]
    first, second = first.view(f"V{4 * n_in}")[:, 0], second.view(f"V{n_in}")[:, 0]  # a byte's lines, side by side
    bits = np.zeros(len(size))
    queue = np.flatnonzero(size > 0)
    queue = queue[np.argsort(-size[queue], kind="stable")]
    n = min(LANES, len(queue))
    text, queue = queue[:n], queue[n:]
    done = np.zeros(n, np.int64)  # bytes of each lane's text
    start_weights = np.array(START_WEIGHTS, np.float32)[:, None, None] / np.float32(STRETCH)
    centres = np.linspace(-LIMIT, LIMIT, REFINE, dtype=np.float32)
    start_refine = np.stack([1 / (1 + np.exp(centres)), 1 / (1 + np.exp(-centres))])[:, None, None]
    weights = np.repeat(np.broadcast_to(start_weights, (n_in, 8, 1)), n, axis=2)  # (contexts, bit, lane)
    refine = np.empty((2, 8, n, REFINE), np.float32)  # (value of the bit, place, lane, cell): its probability
    refine[:] = start_refine
    rate, scale = np.float32(RATE / STRETCH / STRETCH), np.float32((REFINE - 1) / (2 * LIMIT))
    room, lane = None, np.arange(BLOCK)
    while n:
        if room is None:
            room = _Room(n_in, n)
            places = np.arange(n * BLOCK).reshape(n, BLOCK) * 16
            places = np.stack([places, places + n * BLOCK * 16]).repeat(4, axis=0)
            cells = (np.arange(8 * n) * REFINE).reshape(8, n, 1)
            of_bit = _BITS * (8 * n * REFINE)
        mixed, other, sign, node, cell = room.mixed, room.other, room.sign, room.node, room.cell
        left = size[text] - done
        inside = lane < left[:, None]
        at = (begin[text] + done)[:, None] + np.where(inside, lane, 0)
        byte = buf.take(at, mode="clip")
        _NODES.take(byte, axis=1, out=node, mode="clip")
        node += places
        # the lines of a block are fetched whole, 16 bytes each; their nodes are then picked from that
        line = first.take(at, mode="clip")[..., None].view(np.uint32)
        low = second.take(at, mode="clip")[..., None].view(np.uint8)
        line = line, (line & np.uint32(0xFFFFFF00)) | low
        for k in range(n_in):
            for half in (0, 1):
                whole[k].take(line[half][..., k], mode="clip", out=room.met[half])
            room.met.view(np.int8).reshape(-1).take(node, mode="clip", out=room.picked)
            np.copyto(room.inputs[k], room.picked)
            np.multiply(room.inputs[k], weights[k][..., None], out=other if k else mixed)
            if k:
                mixed += other
        np.clip(mixed, -LIMIT, LIMIT, out=mixed)
        np.multiply(mixed, scale, out=other)
        other += np.float32(LIMIT * scale + 0.5)
        np.copyto(cell, other, casting="unsafe")
        cell += cells
        cell += of_bit.take(byte, axis=1, out=node, mode="clip")  # the cell of the bit that came
        _SIGNS.take(byte, axis=1, out=sign, mode="clip")
        # the probability of the bit that came, by the mixer and by the map
        np.exp(np.negative(np.multiply(mixed, sign, out=mixed), out=mixed), out=mixed)
        mixed += 1
        right = np.reciprocal(mixed, out=mixed)
        both = np.add(right, refine.reshape(-1).take(cell, mode="clip"), out=other)
        np.add.at(bits, text, -((np.log2(np.multiply.reduce(both, axis=0)) - 8) * inside).sum(1, dtype=np.float64))
        goes_on = left > BLOCK
        if goes_on.any():
            error = np.multiply(1 - right, sign, out=other)
            for k in range(n_in):
                weights[k] += rate * np.einsum("bmc,bmc->bm", error, room.inputs[k])
            seen = np.bincount(cell.reshape(-1), minlength=refine.size).reshape(refine.shape).astype(np.float32)
            times = seen[0] + seen[1]
            refine += (seen - times * refine) / (times + 12)
        done += BLOCK
        ended = np.flatnonzero(~goes_on)
        if len(ended):
            new = min(len(ended), len(queue))
            text[ended[:new]], queue = queue[:new], queue[new:]
            done[ended[:new]] = 0
            weights[:, :, ended[:new]] = start_weights
            refine[:, :, ended[:new]] = start_refine
            if new < len(ended):
                stay = np.delete(np.arange(n), ended[new:])
                text, done, weights, refine = text[stay], done[stay], np.ascontiguousarray(weights[:, :, stay]), np.ascontiguousarray(refine[:, :, stay])
                n, room = len(stay), None
    return bits


SCORED = "rid long, key long, c long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _parts(table: np.ndarray, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Each context's part of the whole table."""
    return np.split(table, np.cumsum([1 << b for b in bits])[:-1])


def _folded(table: np.ndarray) -> bytes:
    """The whole table as it is broadcast: a worker keeps that beside its own copy."""
    return pa.compress(table.tobytes(), codec="zstd", asbytes=True)


def _unfolded(folded: bytes, bits: tuple[int, ...]) -> np.ndarray:
    # a copy by numpy, whose large arrays lie on large pages where the system has them
    whole = pa.decompress(folded, sum(1 << b for b in bits), codec="zstd", memory_pool=pa.system_memory_pool())
    return np.array(np.frombuffer(whole, np.int8))


def _score(tables, bits, hot, totals):
    """Rows with c = 0 hold a text's finished parts (key: its row, mixed), the others a rare word's count in a text."""
    train, vocabulary = totals
    made = uuid.uuid4().hex  # names this table in the workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tb.kept(("contexts", made), lambda: _parts(_unfolded(tables.value, bits), bits))
        hot_key, hot_n = (np.frombuffer(x, t) for x, t in zip(hot.value, (U64, np.int64)))
        log_n = np.log10(hot_n + 1.0)
        for batch in batches:
            buf, offsets = tb.column_bytes(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            for i, j in tb.steps(offsets, SCORE_BYTES):
                part, own = tb.lower(buf[offsets[i]: offsets[j]]), offsets[i: j + 1] - offsets[i]
                h, per_doc = _words(part, own)
                doc = np.concatenate([np.repeat(np.arange(j - i), per_doc), np.arange(j - i)])
                h = np.concatenate([h, np.full(j - i, END, U64)])
                at = np.minimum(np.searchsorted(hot_key, h), max(len(hot_key) - 1, 0))
                is_hot = hot_key[at] == h if len(hot_key) else np.zeros(len(h), bool)
                base = np.bincount(doc[is_hot], weights=log_n[at[is_hot]], minlength=j - i).astype(np.float64)  # none hot: whole numbers
                known = np.bincount(doc[is_hot], minlength=j - i)
                base -= (per_doc + 1) * np.log10(float(train + vocabulary + 1))
                model = -np.log10(2.0) * code_lengths(table, *_text_ends(part, own))
                # the rare words of each text, once with their number
                rest_h, rest_doc = h[~is_hot], doc[~is_hot]
                order = np.lexsort((rest_h, rest_doc))
                rest_h, rest_doc = rest_h[order], rest_doc[order]
                new = np.ones(len(order), bool)
                new[1:] = (rest_h[1:] != rest_h[:-1]) | (rest_doc[1:] != rest_doc[:-1])
                at = np.flatnonzero(new)
                counted = np.diff(np.append(at, len(order)))
                own_rid = rid[i:j]
                columns = [(own_rid, own_rid[rest_doc[at]], pa.int64()),
                           (tb.mix(own_rid.astype(U64)).view(np.int64), rest_h[at].view(np.int64), pa.int64()),
                           (np.zeros(j - i, np.int64), counted.astype(np.int64), pa.int64()),
                           (batch.column("doc_id").slice(i, j - i), None, pa.int64()), (batch.column("held_out").slice(i, j - i), None, pa.bool_()),
                           (np.diff(own), None, pa.int64()), (per_doc + 1, None, pa.int64()), (known, None, pa.int64()),
                           (base, None, pa.float64()), (model, None, pa.float64())]
                arrays = [pa.concat_arrays([x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind),
                                            pa.nulls(len(at), kind) if y is None else pa.array(y, kind)]) for x, y, kind in columns]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCORED.split(", ")])

    return run


def score_documents(docs: DataFrame, training: str) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) after learning from those that ``training`` (SQL) holds for.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) and bits_per_byte."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_training = F.coalesce(F.expr(training), F.lit(True))
    texts = rows.filter(is_training).select("text")
    words = (texts.mapInArrow(tb.frugal(_gather_words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).checkpoint())
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot_rows = words.filter(F.col("n") * HOT >= total[0]).toPandas()  # at most HOT rows
    hot_key = hot_rows["key"].to_numpy(np.int64).view(U64)
    by = np.argsort(hot_key)
    hot = sc.broadcast((hot_key[by].tobytes(), hot_rows["n"].to_numpy(np.int64)[by].tobytes()))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = table_bits(n_bytes)
    table = np.zeros(sum(1 << b for b in bits), np.int8)  # at most 2 ** MAX_BITS bytes a context
    blocks = table.reshape(-1, PACK)
    for r in block_predictions(texts, bits).collect():
        blocks[r["block"]] = np.frombuffer(r["packed"], np.int8)
    tables = sc.broadcast(_folded(table))
    # an id for each row, so that rows with equal doc_ids stay apart
    rows_out = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (~is_training).alias("held_out"), "text")
    scored = rows_out.mapInArrow(tb.frugal(_score(tables, bits, hot, (total[0], total[1]))), SCORED)
    rare = words.filter(F.col("n") * HOT < total[0]).select("key", "n")
    # a text's finished parts go along under a key of their own; what that meets is not counted
    met = scored.join(rare, "key", "left")
    hit = F.col("n").isNotNull() & (F.col("c") > 0)
    # a rare word that training lacks adds nothing
    parts = met.where(hit | (F.col("c") == 0)).groupBy("rid").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_bytes", "n_tokens", "score")],
        (F.sum("n_known") + F.sum(F.when(hit, F.col("c")).otherwise(0))).alias("n_known"),
        (F.sum("base_score") + F.sum(F.when(hit, F.col("c") * F.log10(F.col("n") + 1.0)).otherwise(0.0))).alias("base_score"))
    per_byte = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return parts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total[0]).cast("long").alias("train_tokens"),
                        "base_score", "score", per_byte.alias("bits_per_byte"))
