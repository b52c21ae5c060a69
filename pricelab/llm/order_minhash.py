"""Document fingerprints by Order MinHash.

A text is a sequence of tokens: its words of up to ``TOKEN`` characters that are no white space; in a longer run (a text without
spaces, base64) every character begins a token of ``GRAM`` characters, so an edit changes the tokens around it alone. Its k-mers are the runs of
``KMER`` tokens, each numbered by its occurrence (the first, second, ... time that k-mer stands in the text),
so equal k-mers stay apart. Every numbered k-mer has one hash of ``HASH_BITS`` bits, the same in every text, whatever
its length; signature element j orders the k-mers by the distance of their hash above j / ``ELEMENTS`` (a power of two) of the hash range (wrapping around), selects the ``PICK`` minimal
ones, puts them back into text order and hashes their tuple. Likeness is the share of equal elements; since the
order inside the tuples counts, it follows the edit distance and not only the shared content.

One sort of the hashes serves all elements: the selected k-mers of element j are the next ones on the ring. All
steps are array functions inside a row, so a text costs its own length (times its logarithm) and nothing
is shuffled for it. The neighbour by id is found in ranges of ids: ranges are cut at approximate quantiles, and
the first document of every range is sent to the range before it as well.

Rows: a null text is empty; an empty text has no k-mers and the fingerprint ``-``; a text with fewer tokens than
``KMER`` has its whole sequence as its one k-mer, and with fewer k-mers than ``PICK`` all are selected. Rows are
ordered by (doc_id, text), null ids last; repeated rows follow one another. A table of one row is its own next.
Extra columns are ignored; an empty table gives an empty result. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = 16
GRAM = 6
KMER = 2
PICK = 2
ELEMENTS = 64
NONE = "-"

_CHAR = r"[^\x20\x09-\x0D]"
_WORD = rf"(?<!{_CHAR}){_CHAR}{{1,{TOKEN}}}+(?!{_CHAR})"
#: The tokens are its first group; what it consumes is a whole word, or one character of a longer run.
TOKENS = rf"(?=({_WORD}|{_CHAR}{{1,{GRAM}}}))(?:{_WORD}|{_CHAR})"

#: Bits of a k-mer's hash, the same ones in every text, and of its place where both are one number.
HASH_BITS = 42
PLACE_BITS = 20

#: Rows of a range of ids, and the largest number of ranges (beyond it ranges grow; each is sorted, not held).
RANGE_ROWS = 4096
RANGES = 16384


def with_elements(df: DataFrame, text: str, out: str, packed_tokens: int = 1 << PLACE_BITS) -> DataFrame:
    """``df`` with the array ``out`` of the ``ELEMENTS`` signature hashes of a text (empty for one without tokens).

    Texts of up to ``packed_tokens`` tokens (at most 1 << PLACE_BITS) sort packed numbers, longer ones pairs; the
    hashes are the same ones in both."""
    df = df.withColumn("__all", F.regexp_extract_all(F.col(text), F.lit(TOKENS), F.lit(1)))
    tokens, none = F.col("__all"), F.array().cast("array<string>")
    few = F.size("__all") <= packed_tokens
    df = _signed(df.withColumn("__t", F.when(few, tokens).otherwise(none)), "__short", packed=True)
    df = _signed(df.withColumn("__t", F.when(few, none).otherwise(tokens)), "__long", packed=False)
    return df.withColumn(out, F.when(few, F.col("__short")).otherwise(F.col("__long"))).drop("__all", "__short", "__long")


def _signed(df: DataFrame, out: str, packed: bool) -> DataFrame:
    """``df`` with the signature hashes ``out`` of the tokens ``__t``, which it drops.

    ``packed``: a k-mer and its place are one number, the ``HASH_BITS`` of its hash above the ``PLACE_BITS`` of its
    place, so plain number sorts do; else they are a pair of the same hash and place. Every step is a column of its
    own, which keeps it compiled; a column that a function reads for each element is used more than once, so the
    optimiser never moves its definition into that function."""
    t, n = F.col("__t"), F.size("__t")
    df = df.withColumn("__kmers", F.greatest(n - (KMER - 1), F.least(n, F.lit(1))))
    kmers = F.col("__kmers")

    def placed(h: Column, i: Column) -> Column:
        high = F.shiftright(h.bitwiseAND((1 << 62) - 1), 62 - HASH_BITS)
        return F.shiftleft(high, PLACE_BITS) + i if packed else F.struct(high.alias("h"), i.alias("i"))

    key = lambda x: F.shiftright(x, PLACE_BITS) if packed else x["h"]
    place = lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1) if packed else x["i"]

    def kmer(w: Column, i: Column) -> Column:
        return placed(F.xxhash64(w, *[F.coalesce(F.get(t, i + k), F.lit("")) for k in range(1, KMER)]), i)

    df = df.withColumn("__s", F.sort_array(F.slice(F.transform(t, kmer), F.lit(1), kmers)))
    s = F.col("__s")
    every = F.when(kmers > 0, F.sequence(F.lit(0), kmers - 1)).otherwise(F.array().cast("array<int>"))
    # where each run of equal k-mers begins, and one past the end; then the occurrence numbers along the runs
    df = df.withColumn("__b", F.concat(F.filter(every, lambda i: (i == 0) | (key(F.get(s, i)) != key(F.get(s, i - 1)))), F.array(kmers)))
    begin = F.col("__b")
    df = df.withColumn("__nth", F.flatten(F.transform(F.slice(begin, F.lit(1), F.size(begin) - 1),
                                                      lambda b, r: F.sequence(F.lit(0), F.get(begin, r + 1) - b - 1))))
    df = df.withColumn("__ring", F.sort_array(F.zip_with(s, "__nth", lambda x, k: placed(F.xxhash64(key(x), k), place(x)))))
    ring = F.col("__ring")
    # the number of element starts at or below a hash; it changes where the ring passes a start
    reached = lambda i: F.shiftright(key(F.get(ring, i)), HASH_BITS - ELEMENTS.bit_length() + 1).cast("int") + 1
    df = df.withColumn("__c", F.filter(every, lambda i: (i == 0) | (reached(i) != reached(i - 1))))
    crossing = F.col("__c")
    opened = F.flatten(F.transform(crossing, lambda i, r: F.array_repeat(
        i, reached(i) - F.when(r == 0, F.lit(0)).otherwise(reached(F.get(crossing, r - 1))))))
    df = df.withColumn("__o", F.slice(F.concat(opened, F.array_repeat(kmers, F.lit(ELEMENTS))), 1, ELEMENTS))

    def picked(start: Column) -> Column:
        """The hash of the minimal k-mers of an element, in text order."""
        taken = F.transform(F.sequence(F.lit(0), F.least(F.lit(PICK), kmers) - 1), lambda k: F.get(ring, F.pmod(start + k, kmers)))
        in_order = F.sort_array(F.transform(taken, lambda x: F.struct(place(x).alias("place"), key(x).alias("h"))))
        return F.xxhash64(F.transform(in_order, lambda x: x["h"]))

    none = F.array().cast("array<bigint>")
    df = df.withColumn(out, F.when(kmers > 0, F.transform("__o", picked)).otherwise(none))
    return df.drop("__t", "__kmers", "__s", "__b", "__nth", "__ring", "__c", "__o")


def fingerprint(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, F.lit(NONE)).otherwise(
        F.array_join(F.transform(parts, lambda x: F.lower(F.hex(x))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements; two texts without k-mers are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    return F.when(none_a & none_b, F.lit(1.0)).when(none_a | none_b, F.lit(0.0)).otherwise(same / F.lit(float(ELEMENTS)))


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with ``range``: ranges of doc_id of about RANGE_ROWS rows (at most RANGES ranges; nulls in one after them)."""
    n = max(1, min(RANGES, -(-docs.count() // RANGE_ROWS)))
    steps = [i / n for i in range(1, n)] or [0.5]
    cuts = docs.agg(F.percentile_approx("doc_id", steps, 4 * max(n, 100))).first()[0] or []
    splits = [float("-inf"), *(sorted({float(c) for c in cuts}) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__id", outputCol="__range", handleInvalid="keep")
    return (cut.transform(docs.withColumn("__id", F.col("doc_id").cast("double")))
            .withColumn("range", F.coalesce(F.col("__range").cast("int"), F.lit(len(splits)))).drop("__id", "__range"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``parts``, its text's elements, and ``next``: a struct of the text and parts
    of the next row by (doc_id, text)."""
    placed = _ranges(docs)
    # one row per range: its first id, and the range whose last row it follows
    firsts = placed.groupBy("range").agg(F.min("doc_id").alias("first_id"))
    w = Window.orderBy("range")  # at most RANGES rows
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("to", F.coalesce(F.lag("range").over(w), F.last("range").over(whole)))
    follows = F.broadcast(firsts.select(F.col("range").alias("own"), "first_id", F.col("to")))
    copies = (placed.join(follows, (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
              .withColumn("range", F.col("to")).drop("own", "first_id", "to").withColumn("copy", F.lit(1)))
    both = placed.withColumn("copy", F.lit(0)).unionByName(copies)
    both = with_elements(both, "text", "parts")  # once a row, before the shuffle
    by = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_last(), "text")
    return both.withColumn("next", F.lead(F.struct("text", "parts")).over(by)).filter("copy = 0").drop("copy", "range")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text: the last floor(n_chars / 4) characters replaced by the first as many of the next document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.col("next.text"), F.lit(1), cut))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = with_elements(rows, "edited", "edited_parts")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       fingerprint(F.col("parts")).alias("fingerprint"),
                       fingerprint(F.col("edited_parts")).alias("edited_fingerprint"),
                       likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
                       likeness(F.col("parts"), F.col("next.parts")).alias("near_next"))
