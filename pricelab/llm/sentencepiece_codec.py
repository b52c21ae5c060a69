"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file (a protobuf) is parsed here, field by field, and rebuilt as a ``tokenizers`` pipeline:

* normaliser: the model's precompiled character map, its removal of extra spaces, the dummy prefix and the
  metaspace marker for spaces;
* model: unigram pieces with their scores, or byte-pair merges in the order of their scores, with byte fallback;
* decoder: byte fallback, joined pieces, marker back to space, the dummy prefix taken off.

Texts are normalised whole and then cut before a marker that follows another character. No piece of a model
trained on white-space-split text crosses such a place (checked for every piece when the model is read; a model
with such a piece is never cut), so parts are encoded on their own: memory is bounded for texts of any length, and
a part that came before (most words do) is looked up: when the cache is full, the parts that still come stay. New
parts go to the library side by side in longer texts, which it cuts at the same places. Batches go to the library's
threads; their number is the task's CPUs.

Parity: every part is encoded and decoded by the ``sentencepiece`` library too when it enters the cache, side by
side with others, and alone where those differ. A text
with a part that doesn't prove right alone (one with several markers in front, say) is compared whole; ``parity``
is false where that differs.
The round trip of every text is compared.

Rows: a null text is empty and has no ids; repeated rows give repeated result rows; an empty table gives an empty
result. Columns of the input that have the names of the result's columns are replaced; others pass through.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pricelab.llm import textbytes as tb

MARK = "▁"
#: Numbers of the model file's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

CACHE_WORDS = 80_000  # of each of the cache's two halves
BATCH_WORDS = 4_000
JOINED = 256  # parts that are encoded side by side
BATCH_TEXTS = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protobuf message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, at = data[at: at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at: at + size], at + size
        elif kind == 5:
            value, at = data[at: at + 4], at + 4
        else:
            raise ValueError(f"unexpected wire type {kind}")
        yield key >> 3, value


@dataclass
class Spec:
    """What a SentencePiece model file says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix_marker: bool = False
    raw: bytes = b""


def read_model(data: bytes) -> Spec:
    """Parse a model file's bytes."""
    spec = Spec(raw=data)
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            spec.pieces.append(piece.get(1, b"").decode())
            spec.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            spec.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
            spec.model_type = trainer.get(3, UNIGRAM)
            spec.byte_fallback = bool(trainer.get(35, 0))
            spec.suffix_marker = bool(trainer.get(24, 0))
        elif number == 3:
            rules = dict(_fields(value))
            spec.charsmap = rules.get(2, b"")
            spec.dummy_prefix = bool(rules.get(3, 1))
            spec.remove_extra = bool(rules.get(4, 1))
            spec.escape = bool(rules.get(5, 1))
    if spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    spec.unk_id = spec.kinds.index(UNKNOWN) if UNKNOWN in spec.kinds else 0
    return spec


class Codec:
    """The rebuilt tokenizer of one model."""

    def __init__(self, spec: Spec):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.spec = spec
        steps = []
        if spec.charsmap:
            steps.append(normalizers.Precompiled(spec.charsmap))
        if spec.remove_extra:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if spec.escape:
            steps.append(normalizers.Replace(" ", MARK))
        self._normalizer = normalizers.Sequence(steps) if steps else None
        vocab = {p: i for i, p in enumerate(spec.pieces)}
        if spec.model_type == UNIGRAM:
            # pieces that are never made from text get names that no text has (a Unicode noncharacter first)
            scored = [("\uffff" + p if k in (CONTROL, UNUSED, UNKNOWN) else p, s) for p, s, k in zip(spec.pieces, spec.scores, spec.kinds)]
            model = models.Unigram(scored, unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
        else:
            usable = {p for p, k in zip(spec.pieces, spec.kinds) if k in (NORMAL, USER_DEFINED)}
            merges = []
            for piece, score, kind in zip(spec.pieces, spec.scores, spec.kinds):
                if kind == NORMAL and len(piece) > 1:
                    pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in usable and piece[k:] in usable]
                    merges += [(-score, vocab[piece], vocab[a], vocab[b], a, b) for a, b in pairs]
            model = models.BPE(vocab, [(m[4], m[5]) for m in sorted(merges)], unk_token=spec.pieces[spec.unk_id],
                               byte_fallback=spec.byte_fallback, fuse_unk=True)
        self._tokenizer = Tokenizer(model)
        parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if spec.dummy_prefix:
            parts.append(decoders.Strip(" ", 1, 0))
        self._tokenizer.decoder = decoders.Sequence(parts)
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cuttable = spec.escape and not spec.suffix_marker and not any(
            inner.search(p) for p, k in zip(spec.pieces, spec.kinds) if k in (NORMAL, USER_DEFINED))
        words = f"{MARK}*[^{MARK}]+|{MARK}+"
        self._words = re.compile(words)
        if self.cuttable:
            self._tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(words), "isolated")
        # bytes of text that a piece stands for; those that stand for none in particular are too long for any text
        self._size = np.array([1 if k == BYTE else len(p.encode()) if k in (NORMAL, USER_DEFINED) else 1 << 40
                               for p, k in zip(spec.pieces, spec.kinds)], np.int64)
        # a byte piece's name that stands in a text is text; the library would take it for the piece
        self._literal = re.compile("(?<=<)(?=0x[0-9A-F]{2}>)") if spec.model_type == UNIGRAM and spec.byte_fallback else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known when the cache was last full
        self.fresh: list[str] = []  # the parts that the last call added to the known ones

    def normalize(self, text: str) -> str:
        """The text as the model sees it."""
        if not self._plain(text) and self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        elif self.spec.escape:
            text = text.replace(" ", MARK)
        return (MARK if self.spec.escape else " ") + text if text and self.spec.dummy_prefix else text

    def _plain(self, text: str) -> bool:
        return not self.spec.charsmap and not self.spec.remove_extra

    def parts(self, text: str) -> list[str]:
        """The parts of a text that are encoded on their own."""
        whole = self.normalize(text)
        parts = self._words.findall(whole) if self.cuttable else [whole] if whole else []
        if self._literal and "<0x" in whole:
            parts = [x for w in parts for x in self._literal.split(w)]
        return parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.encode_parts([self.parts(t) for t in texts])

    def encode_parts(self, made: list[list[str]]) -> list[np.ndarray]:
        known, older, fresh = self.known, self.older, []
        words = dict.fromkeys(chain.from_iterable(made))
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    fresh.append(w)
        if len(known) + len(fresh) > CACHE_WORDS:
            self.older = older = known
            self.known = known = {w: older[w] for w in words if w in older}
        self.fresh = fresh
        for a in range(0, len(fresh), BATCH_WORDS):
            some = fresh[a: a + BATCH_WORDS]
            plain = alone(some) if self.cuttable else []
            if not self._side_by_side(plain):
                rest = some
            else:
                rest = [w for w in some if w not in known] if len(plain) < len(some) else []
            for word, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                known[word] = array("i", e.ids).tobytes()
        return [np.frombuffer(b"".join([known[w] for w in ws]), np.int32) for ws in made]

    def _side_by_side(self, parts: list[str]) -> bool:
        """Make the parts known, encoded in joined texts; false, and none is, where the pieces don't end as the parts do."""
        if not parts:
            return False
        made = self._tokenizer.encode_batch_fast(joined(parts), add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in made), np.int32)
        ends = np.cumsum(self._size[flat])
        want = part_ends(parts)
        at = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != want[-1] or not np.array_equal(ends[at], want):
            return False
        own, at = flat.tobytes(), [0, *(4 * (at + 1)).tolist()]
        self.known.update(zip(parts, [own[i:j] for i, j in zip(at, at[1:])]))
        return True

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self._tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def normalized_text(self, text: str) -> str:
        """What decoding must give back: the normalised text with spaces for markers, without the dummy prefix."""
        whole = self.normalize(text)
        whole = whole[1:] if whole and self.spec.dummy_prefix else whole
        return whole.replace(MARK, " ")


class _Lookup:
    """Decoding by the bytes of the pieces, for whole batches of ids."""

    def __init__(self, spec: Spec):
        out = []
        for piece, kind in zip(spec.pieces, spec.kinds):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind in (CONTROL, UNKNOWN):
                out.append(b"" if kind == CONTROL else " ⁇ ".encode())
            else:
                out.append(piece.replace(MARK, " ").encode())
        size = np.array([len(x) for x in out])
        self.begin, self.size = np.cumsum(size) - size, size
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.strip = 1 if spec.dummy_prefix else 0

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text = self.bytes[at].tobytes()
        return text[1:] if self.strip and text[:1] == b" " else text


def doubtful(codec: Codec, lookup: _Lookup, reference) -> list[str]:
    """Of the parts that entered the cache last, those that don't prove right alone: given the part as a text, the
    reference library makes other ids or another text, or it can't be asked (several markers in front, say)."""
    if not (codec.cuttable and codec.spec.dummy_prefix):
        return codec.fresh
    parts = alone(codec.fresh)
    known = codec.known
    own = [known[w] for w in parts]
    flat = np.frombuffer(b"".join(own), np.int32)
    if not _agree(parts, own, flat, lookup, reference):
        right = reference.encode([w[1:].replace(MARK, " ") for w in parts], num_threads=1)
        agreed = [k for k, (x, y) in enumerate(zip(own, right)) if np.frombuffer(x, np.int32).tolist() == y]
        parts = [parts[k] for k in agreed]
        flat = np.fromiter(chain.from_iterable(right[k] for k in agreed), np.int32)
    if lookup.decode(flat).decode("utf-8", "replace") != reference.decode(flat.tolist()):
        return codec.fresh
    return [] if len(parts) == len(codec.fresh) else list(set(codec.fresh).difference(parts))


def _agree(parts: list[str], own: list[bytes], flat: np.ndarray, lookup: _Lookup, reference) -> bool:
    """Whether the reference library makes the parts' own ids (``flat``: all) where the parts stand side by side, each
    from its own part of the text."""
    if not parts:
        return True
    n = np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) // 4
    spelled = part_ends(parts) - 2 * np.arange(1, len(parts) + 1)  # a marker is a space
    if n[0] == 0 or not np.array_equal(np.cumsum(lookup.size[flat])[n - 1], spelled):
        return False
    right = reference.encode([x[1:].replace(MARK, " ") for x in joined(parts)], num_threads=1)
    return np.array_equal(flat, np.fromiter(chain.from_iterable(right), np.int32))


def parity(texts: list[str], made: list[list[str]], ids: list[np.ndarray], codec: Codec, lookup: _Lookup, reference,
           doubts: set[str]) -> list[bool]:
    """Whether each text's ids, and the text they decode to, are those of the reference library. To be called after
    each ``encode_parts``; ``doubts`` keeps the parts in the cache that don't prove right alone."""
    doubts.update(doubtful(codec, lookup, reference))
    if len(doubts) > 4 * CACHE_WORDS:  # parts that left the cache are asked for again when they come back
        doubts.intersection_update(chain(codec.known, codec.older))
    same = [True] * len(texts)
    asked = [i for i, parts in enumerate(made) if not doubts.isdisjoint(parts)] if doubts else []
    for i, right in zip(asked, reference.encode([texts[i] for i in asked], num_threads=1)):
        same[i] = ids[i].tolist() == right and lookup.decode(ids[i]).decode("utf-8", "replace") == reference.decode(right)
    return same


def alone(parts: list[str]) -> list[str]:
    """Those with one marker in front and then text, so that others can follow and stand before them."""
    return [w for w in parts if w[0] == MARK and w[1:2] not in ("", MARK)]


def part_ends(parts: list[str]) -> np.ndarray:
    """Where the bytes of each of such parts end, in all of them together."""
    text = np.frombuffer("".join(parts).encode(), np.uint8)
    one, two, three = MARK.encode()
    begin = np.flatnonzero((text[:-2] == one) & (text[1:-1] == two) & (text[2:] == three))
    return np.append(begin[1:], len(text))


def joined(parts: list[str]) -> list[str]:
    """The parts side by side, in texts of JOINED each."""
    return ["".join(parts[a: a + JOINED]) for a in range(0, len(parts), JOINED)]


def codec_of(model: bytes) -> Codec:
    return Codec(read_model(model))


def _worker(model: bytes):
    """The rebuilt tokenizer, the byte table and the reference processor, once per Python worker."""
    def make():
        import sentencepiece

        context = TaskContext.get()
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(context.cpus() if context else 1))
        spec = read_model(model)
        return Codec(spec), _Lookup(spec), sentencepiece.SentencePieceProcessor(model_proto=model), set()

    return tb.kept(("sentencepiece", xxhash.xxh64_digest(model)), make)


def _encode(model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, lookup, reference, doubts = _worker(model.value)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(a, BATCH_TEXTS)
                texts = [t or "" for t in batch.column(text).cast(pa.string()).to_pylist()]
                made = [codec.parts(t) for t in texts]
                ids = codec.encode_parts(made)
                same = parity(texts, made, ids, codec, lookup, reference, doubts)
                round_trip = [lookup.decode(x) == codec.normalized_text(t).encode() for x, t in zip(ids, texts)]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                     pa.array(sizes), pa.array(round_trip, pa.bool_()), pa.array(same, pa.bool_())],
                    [*keep, "ids", "n_ids", "round_trip", "parity"])

    return run


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, by default all) with ids, n_ids, round_trip (whether decoding gives
    the normalised text back) and parity (whether the reference library agrees)."""
    made = ("ids", "n_ids", "round_trip", "parity")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType()),
                           T.StructField("parity", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tb.frugal(_encode(shared, text, keep)), schema)


def _decode(model, ids: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _worker(model.value)[1]
        for batch in batches:
            texts = [None if x is None else lookup.decode(np.asarray(x, np.int64)).decode("utf-8", "replace")
                     for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids (null ids: null)."""
    keep = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    return encoded.select(*dict.fromkeys([*keep, ids])).mapInArrow(tb.frugal(_decode(shared, ids, keep)), schema)
