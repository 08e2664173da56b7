"""Look-back windows per actor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.ordering import HOT_ROWS, GroupLoad, group_key, group_load, number_rows
from eventloom.schemas import LABEL, LOOK_BACK

# Rows of a hot actor in one block of windows: many blocks, so that they spread evenly over tasks.
BLOCK_ROWS = 5_000
# Rows of a stored block of a sequence.
STORE_ROWS = 1024

_VECTOR, _LABEL, _GROUP, _SLOT, _FIRST = "__vector", "__label", "__group", "__slot", "__first"


def lag_windows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    label: str = LABEL,
    look_back: int = LOOK_BACK,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
    load: GroupLoad | None = None,
) -> DataFrame:
    """For each row with ``look_back`` earlier rows of its actor: those rows and its own label.

    Returns ``by``, ``order``, ``seq`` (0-based position of the row in its actor's sequence),
    ``window`` (``look_back`` x features, oldest first, the row itself excluded) and
    ``label``. ``order`` must be unique per actor.

    Actors up to ``block_rows`` rows are one window partition each. Where one is larger, all
    sequences are cut into blocks of that size and each block also gets the last
    ``look_back`` rows of the block before it. Rows of actors above ``hot_rows`` rows are
    numbered by more than one task.
    """
    load = load or group_load(df, by)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    keys = list(dict.fromkeys([*by, *order]))
    rows = df.select(*keys, vector.alias(_VECTOR), F.col(label).alias(_LABEL))
    output = [*keys, "seq", "window", F.col(_LABEL).alias("label")]

    if load.largest <= block_rows:
        ordered = W.partitionBy(*by).orderBy(*order)
        rows = rows.withColumns(
            {
                "seq": (F.row_number().over(ordered) - 1).cast("bigint"),
                "window": F.collect_list(_VECTOR).over(ordered.rowsBetween(-look_back, -1)),
            }
        )
        return rows.where(F.col("seq") >= look_back).select(*output)

    if block_rows < look_back:
        raise ValueError("a block must hold at least one look-back")
    numbered = number_rows(rows, by, order, "seq", hot_rows, load=load)
    block = F.expr(f"seq div {block_rows}")
    own = F.struct(block.alias("block"), F.lit(False).alias("halo"))
    following = F.struct((block + 1).alias("block"), F.lit(True).alias("halo"))
    in_tail = F.col("seq") % block_rows >= block_rows - look_back
    slotted = numbered.withColumn(_GROUP, group_key(by)).withColumn(
        _SLOT, F.explode(F.when(in_tail, F.array(own, following)).otherwise(F.array(own)))
    )
    ordered = W.partitionBy(_GROUP, f"{_SLOT}.block").orderBy("seq").rowsBetween(-look_back, -1)
    return (
        slotted.withColumn("window", F.collect_list(_VECTOR).over(ordered))
        .where(~F.col(f"{_SLOT}.halo") & (F.col("seq") >= look_back))
        .select(*output)
    )


def sequence_blocks(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    label: str = LABEL,
    look_back: int = LOOK_BACK,
    hot_rows: int = HOT_ROWS,
    block_rows: int = STORE_ROWS,
    load: GroupLoad | None = None,
) -> DataFrame:
    """Each actor's sequence in blocks, from which windows are cut when they are read.

    Returns ``by``, ``block``, ``first`` (position of the block's first row), ``keys`` (the order
    columns of each row), ``labels`` and ``values`` (the features, row after row). A block has
    ``block_rows`` rows, and before them the last ``look_back`` rows of the block before; a row
    is kept once and not once for every window it is in. ``order`` must be unique per actor.
    """
    if block_rows < look_back:
        raise ValueError("a block must hold at least one look-back")
    vector = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(*dict.fromkeys([*by, *order]), vector.alias(_VECTOR), F.col(label).alias(_LABEL))
    numbered = number_rows(rows, by, order, "seq", hot_rows, load=load)
    block = F.expr(f"seq div {block_rows}")
    in_tail = F.col("seq") % block_rows >= block_rows - look_back
    slotted = numbered.withColumn(_SLOT, F.explode(F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block))))
    row = F.struct("seq", F.struct(*order).alias("key"), F.col(_LABEL).alias("label"), F.col(_VECTOR).alias("values"))
    blocks = slotted.groupBy(*by, F.col(_SLOT).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # A block of nothing but the rows before it has no windows.
    return blocks.where(F.element_at("rows", -1)["seq"] >= F.col("block") * block_rows).select(
        *by, "block", F.get("rows", F.lit(0))["seq"].alias("first"), F.col("rows.key").alias("keys"),
        F.col("rows.label").alias("labels"), F.flatten("rows.values").alias("values"),
    )


def block_windows(
    blocks: DataFrame, by: Sequence[str], order: Sequence[str], features: int, look_back: int = LOOK_BACK, flat: bool = False
) -> DataFrame:
    """The windows of stored blocks, as ``lag_windows`` gives them.

    ``window`` is one array, step after step, if ``flat``. ``look_back`` must be the stored one.
    """

    def cut(i: Column) -> Column:
        window = F.slice("values", (i - look_back) * features + 1, look_back * features)
        if not flat:
            steps = F.sequence(F.lit(0), F.lit(look_back - 1))
            window = F.transform(steps, lambda s: F.slice("values", (i - look_back + s) * features + 1, features))
        keys = [F.get("keys", i)[c].alias(c) for c in order if c not in by]
        return F.struct(*keys, (F.col("first") + i).alias("seq"), window.alias("window"), F.get("labels", i).alias("label"))

    full = blocks.where(F.size("labels") > look_back)
    cuts = F.transform(F.sequence(F.lit(look_back), F.size("labels") - 1), cut)
    found = full.select(*by, F.inline(cuts))
    return found.select(*dict.fromkeys([*by, *order]), "seq", "window", "label")


def windows_long(windows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (window, step, feature): the keys, step, feature, value and label."""
    steps = windows.select(*keys, "label", F.posexplode("window").alias("step", "values"))
    names = F.lit(list(features))
    return steps.select(
        *keys, "step", "label", F.inline(F.arrays_zip(names.alias("feature"), F.col("values").alias("value")))
    )


def flatten_windows(windows: DataFrame, output: str = "features") -> DataFrame:
    """Add each window as one vector, step after step; flat windows are one already."""
    nested = dict(windows.dtypes)["window"].startswith("array<array")
    return windows.withColumn(output, array_to_vector(F.flatten("window") if nested else F.col("window")))


def tail_holdout(
    windows: DataFrame, order: Sequence[str], n: int = 300, include_in_train: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(train, test): test is the last ``n`` windows by ``order``, a unique key.

    The order key of the first test row is looked up once; both parts are filters.
    ``windows`` is read three times: pass a stored table.
    """
    first = tail_start(windows, order, n)
    train, test = split_at(windows, order, first)
    return (windows if include_in_train else train), test


def tail_start(windows: DataFrame, order: Sequence[str], n: int) -> Column:
    """The order key of the first of the last ``n`` windows, as a literal; null without windows."""
    tail = windows.select(*order).orderBy(*[F.desc(c) for c in order]).limit(n)
    return tail.select(F.min(_order_key(order))).scalar()


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])


def split_at(windows: DataFrame, order: Sequence[str], first: Column) -> tuple[DataFrame, DataFrame]:
    """(train, test): the windows before an order key, and those from it on."""
    key = _order_key(order)
    # Without rows there is no first key: everything is train.
    return windows.where(F.coalesce(key < first, F.lit(True))), windows.where(F.coalesce(key >= first, F.lit(False)))


def block_keys(blocks: DataFrame, order: Sequence[str], look_back: int = LOOK_BACK) -> DataFrame:
    """The order columns of the windows of stored blocks, without the windows."""
    own = F.slice("keys", F.lit(look_back + 1), F.size("keys") - look_back)
    return blocks.where(F.size("keys") > look_back).select(F.inline(own)).select(*order)


def blocks_before(blocks: DataFrame, order: Sequence[str], first: Column, look_back: int = LOOK_BACK) -> DataFrame:
    """(data, starts, label) of stored blocks: their numbers, and row of start and label of each window before an order key."""

    def wanted(i: Column) -> Column:
        key = F.struct(*[F.get("keys", i)[c].alias(f"k{n}") for n, c in enumerate(order)])
        return F.coalesce(key < F.col(_FIRST), F.lit(True))

    at = F.filter(F.sequence(F.lit(look_back), F.size("labels") - 1), wanted)
    full = blocks.where(F.size("labels") > look_back).withColumn(_FIRST, first)
    found = full.select(F.col("values").alias("data"), "labels", at.alias("at"))
    return found.where(F.size("at") > 0).select(
        "data", F.transform("at", lambda i: i - look_back).alias("starts"), F.transform("at", lambda i: F.get("labels", i)).alias("label")
    )
