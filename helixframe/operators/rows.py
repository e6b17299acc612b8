"""Selection, order, grouping and list operations on sequences, features and matches.

Order is part of a basket: every table has an `ord` column, and operators that depend on order use it explicitly.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that `len` stands for, by the first that a table has.
_LENGTHS = (("data",), ("start", "stop"))


def key_column(df: DataFrame, key: str | Callable[[DataFrame], Column] | Column | None) -> Column:
    """A column, `len`, a metadata key (read from meta_json), a Column, or a function of the table."""
    if isinstance(key, Column):
        return key
    if callable(key):
        return F.length("data") if key is len and "data" in df.columns else F.col("stop") - F.col("start") if key is len else key(df)
    if key in df.columns:
        return F.col(key)
    if key == "len":
        return F.length("data") if "data" in df.columns else F.col("stop") - F.col("start")
    if "meta_json" in df.columns:
        return F.get_json_object("meta_json", "$" + "".join(f"['{part}']" for part in key.split(".")))
    return F.lit(None).cast("string")


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _member(c: Column, values) -> Column:
    return F.contains(F.lit(values), c) if isinstance(values, str) else c.isin(*values)


#: Operators by name; max and min are limits that count as inside.
OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge,
    "max": operator.le, "min": operator.ge, "in": _member, "contains": lambda c, v: F.contains(c, F.lit(v)),
}
#: Operators with which the empty value differs from any value.
_NULL_IS_OTHER = {"ne"}


def predicate(df: DataFrame, name: str, value) -> Column:
    """key_op=value as a boolean column that is never null; a missing value equals nothing.

    The operator may begin with not, lower or notlower. A name whose last part is no operator is a key, compared by eq.
    """
    key, _, op = name.rpartition("_")
    bare, negate, fold = op, False, False
    if bare.startswith("not") and bare != "not":
        bare, negate = bare[3:], True
    if bare.startswith("lower"):
        bare, fold = bare[5:], True
    if not key or bare not in OPERATORS:
        key, bare, negate, fold = name, "eq", False, False
    c = key_column(df, key)
    if isinstance(value, (int, float)) and not isinstance(value, bool) and key not in df.columns and key != "len":
        c = c.cast("double")
    found = OPERATORS[bare](F.lower(c) if fold else c, value)
    found = F.coalesce(found, F.lit(bare in _NULL_IS_OTHER))
    return ~found if negate else found


def select(df: DataFrame, type: str | Sequence[str] | None = None, **criteria) -> DataFrame:  # noqa: A002
    """Rows for which all criteria hold, such as select(fts, 'cds', len_gt=1000, strand='+').

    type is compared in lower case; a sequence of types means any of them. The filter reaches the scan.
    """
    found = []
    if type is not None:
        kinds = [type] if isinstance(type, str) else list(type)
        found.append(_false_if_null(F.lower("type").isin(*(k.lower() for k in kinds))))
    found += [predicate(df, k, v) for k, v in criteria.items()]
    return df.filter(functools.reduce(operator.and_, found)) if found else df


def first_of_type(fts: DataFrame, type: str | Sequence[str], by: str | None = None) -> DataFrame:  # noqa: A002
    """The first feature of the type in list order: of all, or of each value of `by`."""
    found = select(fts, type)
    if by is None:
        return found.orderBy("ord").limit(1)
    row = F.struct(*found.columns)
    return found.groupBy(F.col(by).alias("_by")).agg(F.min_by(row, "ord").alias("r")).select("r.*")


def renumber(df: DataFrame, *order: Column) -> DataFrame:
    """df with ord as 0, 1, ... in the given order.

    Places are counted within range partitions and shifted by the sizes of those before, so no task sorts all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = placed.persist(StorageLevel.DISK_ONLY)  # both uses below see one dealing; a lost part is made anew alike
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a partition
    names = [c for c in df.columns if c != "ord"]
    return placed.join(F.broadcast(shifts), "_part").select((F.col("_before") + F.col("_row")).alias("ord"), *names)


def sort(df: DataFrame, keys: str | Sequence | None = "id", reverse: bool = False, natural: Sequence[str] = ("seqid", "start", "stop")) -> DataFrame:
    """Stable order by keys (space-separated names, Columns or functions; None is the natural order)."""
    parts = keys.split() if isinstance(keys, str) else [keys] if keys is None or callable(keys) or isinstance(keys, Column) else list(keys)
    columns: list[Column] = []
    for k in parts:
        own = [F.col(n) for n in natural if n in df.columns] if k is None else [key_column(df, k)]
        columns += [c.desc() if reverse else c.asc() for c in own]
    return df.orderBy(*columns, F.col("ord").asc())


def top(df: DataFrame, keys: str | Sequence, n: int, reverse: bool = True) -> DataFrame:
    """The first n rows of sort(); a partial top-n in each task, then one of n rows a task."""
    return sort(df, keys, reverse).limit(n)


def item(df: DataFrame, i: int) -> DataFrame:
    """Row number i of the list; negative numbers count from the end. ord must run 0, 1, ..."""
    if i >= 0:
        return df.filter(F.col("ord") == i)
    return df.join(F.broadcast(df.agg(F.max("ord").alias("_last"))), F.col("ord") == F.col("_last") + 1 + i).drop("_last")


def list_slice(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows [start:stop:step] of the list, renumbered; ord must run 0, 1, ..."""
    if step == 0:
        raise ValueError("a slice's step can't be 0")
    n = F.col("_n")
    sized = df.join(F.broadcast(df.agg(F.count("*").alias("_n"))), how="cross")  # one row

    def place(i: int | None, default: Column, low: int, high: Column) -> Column:
        return default if i is None else F.least(F.lit(i), high) if i >= 0 else F.greatest(n + i, F.lit(low))

    if step > 0:
        begin, end = place(start, F.lit(0), 0, n), place(stop, n, 0, n)
        kept = (F.col("ord") >= begin) & (F.col("ord") < end) & (F.pmod(F.col("ord") - begin, F.lit(step)) == 0)
        number = F.floor((F.col("ord") - begin) / step)
    else:
        begin, end = place(start, n - 1, -1, n - 1), place(stop, F.lit(-1), -1, n - 1)
        kept = (F.col("ord") <= begin) & (F.col("ord") > end) & (F.pmod(begin - F.col("ord"), F.lit(-step)) == 0)
        number = F.floor((begin - F.col("ord")) / -step)
    return sized.filter(kept).withColumn("ord", number.cast("long")).drop("_n")


def group_lists(df: DataFrame, keys: str | Sequence[str] | None = "seqid") -> DataFrame:
    """One row for each group, in order of first appearance: the keys, n, first_ord and the rows in list order.

    Meant for groups that fit a row. For counts and ranges use group_counts and loc_range, which combine partially.
    """
    names = [] if keys is None else keys.split() if isinstance(keys, str) else list(keys)
    columns = [key_column(df, k).alias(k) for k in names]
    row = F.struct("ord", *(c for c in df.columns if c != "ord"))
    grouped = df.groupBy(*columns).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.orderBy("first_ord")


def group_counts(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    names = keys.split() if isinstance(keys, str) else list(keys)
    return df.groupBy(*(key_column(df, k).alias(k) for k in names)).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def todict(df: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key: the last in list order."""
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), "ord").alias("r")).select("r.*")


def loc_range(fts: DataFrame, by: str | None = None) -> DataFrame:
    """Smallest start and largest stop, of all features or of each group."""
    grouped = fts.groupBy(by) if by else fts.groupBy()
    return grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def _compared(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """The columns by which rows are equal: all but ord."""
    return list(columns or [c for c in df.columns if c != "ord"])


def remove_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The first of equal rows, in list order. Equal rows are combined before the shuffle."""
    names = _compared(df, columns)
    rest = [c for c in df.columns if c not in names and c != "ord"]
    return df.groupBy(*names).agg(F.min("ord").alias("ord"), *(F.min_by(c, "ord").alias(c) for c in rest)).select(*df.columns)


def _matched(a: DataFrame, b: DataFrame, columns: Sequence[str] | None, how: str) -> DataFrame:
    """Rows of a with (left_semi) or without (left_anti) an equal row in b; nulls are equal."""
    names = _compared(a, columns)
    other = b.select(*(F.col(c).alias(f"_b{k}") for k, c in enumerate(names))).distinct()
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(names)))
    return a.join(other, same, how)


def list_and(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a that b has too; order and repeats of a stay."""
    return _matched(a, b, columns, "left_semi")


def list_sub(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a that b lacks; order and repeats of a stay."""
    return _matched(a, b, columns, "left_anti")


def list_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, then b; b's ord goes on behind a's."""
    last = a.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_from"))
    moved = b.join(F.broadcast(last), how="cross").withColumn("ord", F.col("ord") + F.col("_from")).drop("_from")  # one row
    return a.unionByName(moved.select(*a.columns))


def list_or(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """a, then the rows of b that a lacks."""
    return list_add(a, list_sub(b, a, columns))


def list_xor(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that just one of both has: those of a, then those of b."""
    return list_add(list_sub(a, b, columns), list_sub(b, a, columns))
