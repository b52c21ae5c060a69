"""Order-dependent operators on one long series, without a single-task sort.

W2 row positions, T4/T6 chronological splits, T5 hash split, W1 supervised
sequence windows and W3 lag features.

Positions: the table is range-partitioned on the full sort key (so even a
value shared by a third of the rows is spread over tasks by the tie-breaking
key), sorted inside each partition and checkpointed to the shared checkpoint
folder so that the partitioning is fixed. A position is then the partition's
offset (a table with one row per partition) plus the row's index inside the
partition.

Windows: rows are cut into blocks of ``block_rows`` consecutive positions and
each block also receives the last ``L`` rows of the block before it (a halo).
A window over ``(series, block)`` then equals the window over the whole
series for every row whose home is that block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelab.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id above bit 33
MAX_BLOCK_ROWS = 1 << 20  # unless a window itself is longer
#: Rows of a range that one task sorts to read a rank; cuts of a larger range, and rows sampled to place them.
RANGE_ROWS = 1 << 18
CUTS = 63
SAMPLE_ROWS = 2048


def _order_cols(order_by) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def with_row_position(df: DataFrame, order_by: list, pos_col: str = "pos",
                      total_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based global position in ``order_by`` order.

    ``order_by`` must be a total order (end it with a key) for the result to be
    deterministic. Optionally adds the total row count as ``total_col``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _order_cols(order_by)
    ordered = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).checkpoint(eager=True)
    tagged = ordered.withColumn("__mid", F.monotonically_increasing_id())
    part = F.shiftright(F.col("__mid"), _LOCAL_BITS)
    local = F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = tagged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a single-task window here is bounded by num_partitions
    w = Window.orderBy("__p")
    # computed once (one row per partition) and fixed, so every later use of
    # the positions reads this small table instead of recounting the data
    offsets = counts.select(
        "__p",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__tot")
    ).checkpoint(eager=True)
    joined = tagged.join(F.broadcast(offsets), part == F.col("__p"))
    out = joined.withColumn(pos_col, F.col("__off") + local)
    if total_col:
        out = out.withColumn(total_col, F.col("__tot"))
    return out.drop("__mid", "__p", "__off", "__tot")


def chronological_split(df: DataFrame, order_by: list, test_size: float = 0.2,
                        pos_col: str = "pos", split_col: str = "split",
                        keep_position: bool = True) -> DataFrame:
    """First ``int(n * (1 - test_size))`` rows in time order are ``train`` (T4).

    Also adds ``split_pos``: the position inside the split. If ``df``
    already carries gap-free positions in ``pos_col`` they are reused (the
    total comes from a one-row count joined by broadcast).
    """
    if pos_col in df.columns:
        total = df.agg(F.count(F.lit(1)).alias("__total"))
        out = df.crossJoin(F.broadcast(total))
    else:
        out = with_row_position(df, order_by, pos_col=pos_col, total_col="__total")
    n_train = F.floor(F.col("__total") * F.lit(1.0 - test_size)).cast("long")
    is_train = F.col(pos_col) < n_train
    out = out.withColumns({
        split_col: F.when(is_train, F.lit("train")).otherwise(F.lit("test")),
        "split_pos": F.when(is_train, F.col(pos_col)).otherwise(F.col(pos_col) - n_train),
        "split_n": F.when(is_train, n_train).otherwise(F.col("__total") - n_train),
    }).drop("__total")
    return out if keep_position else out.drop(pos_col)


def rows_at_ranks(df: DataFrame, order_by: list, ranks: list[int], range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row: ``r0``, ``r1``, ... = the order columns (a struct) of the rows at the 0-based ``ranks``; NULL beyond the table.

    No full sort and no shuffle of rows. A range that holds a rank and more than ``range_rows`` rows is cut at up to
    ``CUTS`` of its own rows, taken from a sample (the sample balances the work, the answer doesn't depend on it);
    the rows of the pieces are counted in one map-side combined scan of the order columns, and the rank goes on in
    its piece. A range that is small enough is sorted by one task; one whose rows are all equal is the answer.
    Ties beyond the order columns are rows of equal rank value: end ``order_by`` with a key to tell rows apart."""
    ensure_checkpoint_dir(df.sparkSession)
    own = df.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order_cols(order_by))]).alias("o"))
    n = own.count()
    free = own.limit(0).agg(F.max("o").alias("lo"), F.max("o").alias("hi"))
    todo = [(free, n, {f"r{i}": r for i, r in enumerate(ranks) if 0 <= r < n}, 1.0)]
    found: list[DataFrame] = []
    while todo:
        bounds, size, slots, effort = todo.pop()
        if not slots:
            continue
        inside = own.crossJoin(F.broadcast(bounds)).where(
            (F.col("lo").isNull() | (F.col("o") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("o") <= F.col("hi")))).select("o")
        if size <= range_rows:
            place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o")) - 1
            at = inside.withColumn("__at", place).where(F.col("__at").isin(list(slots.values())))
            found.append(at.agg(*[F.max(F.when(F.col("__at") == r, F.col("o"))).alias(s) for s, r in slots.items()]).checkpoint(eager=True))
            continue
        sampled = inside.sample(fraction=min(1.0, effort * SAMPLE_ROWS / size), seed=7).agg(F.array_sort(F.collect_set("o")).alias("s"))
        step = F.size("s") / F.lit(CUTS + 1.0)
        cuts = sampled.select(F.array_distinct(F.when(F.size("s") <= CUTS, F.col("s")).otherwise(F.transform(
            F.sequence(F.lit(1), F.lit(CUTS)), lambda i: F.get("s", F.floor(i * step).cast("int"))))).alias("cuts")).checkpoint(eager=True)
        piece = F.size(F.filter("cuts", lambda c: c < F.col("o")))
        counted = sorted((r["piece"], r["count"]) for r in inside.crossJoin(F.broadcast(cuts)).groupBy(piece.alias("piece")).count().collect())
        if len(counted) == 1 and inside.agg((F.min("o") == F.max("o")).alias("same")).first()["same"]:
            found.append(inside.agg(*[F.max("o").alias(s) for s in slots]).checkpoint(eager=True))
            continue
        before = 0
        for k, rows in counted:
            in_piece = {s: r - before for s, r in slots.items() if before <= r < before + rows}
            before += rows
            if in_piece:
                lo = F.get("cuts", F.lit(k - 1)) if k else F.lit(None)
                narrowed = bounds.crossJoin(F.broadcast(cuts)).select(F.coalesce(lo, F.col("lo")).alias("lo"),
                                                                      F.coalesce(F.get("cuts", F.lit(k)), F.col("hi")).alias("hi")).checkpoint(eager=True)
                todo.append((narrowed, rows, in_piece, effort * 8 if len(counted) == 1 else 1.0))
    out = own.limit(0).agg(*[F.max("o").alias(f"r{i}") for i in range(len(ranks))])
    for part in found:
        out = out.drop(*part.columns).crossJoin(F.broadcast(part))
    return out.select(*[f"r{i}" for i in range(len(ranks))]).checkpoint(eager=True)


def split_labels(df: DataFrame, order_by: list, test_size: float = 0.2, validation_size: float | None = None,
                 split_col: str = "split", preceded_by: int | None = None, preceded_col: str = "preceded") -> DataFrame:
    """The labels of the chronological split (T4) without positions and without a sort: the last train row is found by
    :func:`rows_at_ranks`, every row is compared with it.

    With ``validation_size`` the last part of train becomes ``validation`` and the earlier one ``fit`` (T6). With
    ``preceded_by`` also a flag: whether the row has that many rows before it in its split (train or test)."""
    n = df.count()
    n_train = math.floor(n * (1.0 - test_size))
    n_fit = None if validation_size is None else math.floor(n_train * (1.0 - validation_size))
    need = [n_train - 1, *([] if n_fit is None else [n_fit - 1]), *([] if not preceded_by else [preceded_by - 1, n_train + preceded_by - 1])]
    ranks = rows_at_ranks(df, order_by, need)
    names = [f"__{c}" for c in ranks.columns]
    x = df.crossJoin(F.broadcast(ranks.toDF(*names)))
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order_cols(order_by))])

    def upto(i: int, rank: int) -> Column:
        return F.lit(False) if rank < 0 else row <= F.col(names[i]) if rank < n else F.lit(True)

    in_train = upto(0, need[0])
    train = F.lit("train") if n_fit is None else F.when(upto(1, need[1]), F.lit("fit")).otherwise(F.lit("validation"))
    new = {split_col: F.when(in_train, train).otherwise(F.lit("test"))}
    if preceded_by is not None:
        k = len(need)
        new[preceded_col] = F.lit(True) if not preceded_by else F.when(in_train, ~upto(k - 2, need[-2])).otherwise(~upto(k - 1, need[-1]))
    return x.withColumns(new).drop(*names)


def validation_split(df: DataFrame, order_by: list, test_size: float = 0.2,
                     validation_size: float = 0.2, split_col: str = "split") -> DataFrame:
    """Chronological split, then the last ``validation_size`` of train becomes
    ``validation`` (T6); the earlier part is ``fit``. Labels only: no sort."""
    return split_labels(df, order_by, test_size, validation_size, split_col)


def hash_number(key_cols: list[str]) -> Column:
    """0 .. 2^32 - 1 from the first 8 hex digits of md5 of the key text (stable
    across engines, independent of partitioning)."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]) if len(key_cols) > 1 \
        else F.col(key_cols[0]).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, key_cols: list[str], train_share: float = 0.8,
               split_col: str = "split", labels: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Random-like 80/20 split that needs no shuffle and no seed state (T5)."""
    cut = round(train_share * (1 << 32))
    return df.withColumn(split_col, F.when(hash_number(key_cols) < cut, F.lit(labels[0]))
                         .otherwise(F.lit(labels[1])))


def block_rows_for(df: DataFrame, halo: int) -> int:
    """Rows per block: enough blocks to feed every shuffle partition twice,
    at least 32x the halo (so halo copies stay within about 3% of the rows),
    at most 2^20 rows (so one window partition always sorts comfortably).
    One count job."""
    n = df.count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(halo, min(MAX_BLOCK_ROWS, max(32 * max(halo, 1), -(-n // (2 * parts))))))


def _with_halo(df: DataFrame, pos_col: str, halo: int, block_rows: int | None) -> DataFrame:
    if block_rows is None:
        block_rows = block_rows_for(df, halo)
    if block_rows < halo:
        raise ValueError("block_rows must be >= the window length")
    home = F.floor(F.col(pos_col) / F.lit(block_rows)).cast("long")
    in_tail = F.pmod(F.col(pos_col), F.lit(block_rows)) >= F.lit(block_rows - halo)
    blocks = F.when(in_tail & F.lit(halo > 0), F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("__home", home).withColumn("__block", F.explode(blocks))


def sequence_windows(df: DataFrame, feature_cols: list[str], target_col: str, length: int = 24,
                     pos_col: str = "pos", partition_cols: list[str] | None = None,
                     block_rows: int | None = None, out_col: str = "sequence",
                     feature_array_col: str | None = None) -> DataFrame:
    """For each row with at least ``length`` earlier rows in its partition, the
    ``length`` preceding feature rows (oldest first) and this row's target (W1).

    ``df`` carries a position ``pos_col`` per partition (e.g. ``split_pos``
    from :func:`chronological_split`); a row whose ``length`` preceding positions
    are not all there gets no window, whatever the blocks. ``partition_cols`` keep
    windows from crossing a split or series boundary. The output column
    ``out_col`` is ``array<array<double>>`` (time x feature). A row's features
    may instead come ready-made from the array column ``feature_array_col``.
    """
    parts = list(partition_cols or [])
    feats = F.col(feature_array_col) if feature_array_col else \
        F.array(*[F.col(c).cast("double") for c in feature_cols])
    x = _with_halo(df.withColumn("__f", feats), pos_col, length, block_rows)
    w = Window.partitionBy(*parts, "__block").orderBy(pos_col).rowsBetween(-length, -1)
    x = x.withColumn(out_col, F.collect_list("__f").over(w)).withColumn("__first", F.min(pos_col).over(w))
    x = x.where((F.col("__block") == F.col("__home")) & (F.size(out_col) == length)
                & (F.col("__first") == F.col(pos_col) - length))
    return x.drop("__f", "__home", "__block", "__first")


def lag_features(df: DataFrame, cols: list[str], lags: list[int], pos_col: str = "pos",
                 partition_cols: list[str] | None = None,
                 block_rows: int | None = None) -> DataFrame:
    """``{c}_lag{k}``: value k rows earlier in position order, NULL if none."""
    parts = list(partition_cols or [])
    k_max = max(lags)
    x = _with_halo(df, pos_col, k_max, block_rows)
    w = Window.partitionBy(*parts, "__block").orderBy(pos_col)
    x = x.withColumns({f"{c}_lag{k}": F.lag(F.col(c), k).over(w) for c in cols for k in lags})
    return x.where(F.col("__block") == F.col("__home")).drop("__home", "__block")
