"""Row filters, typed cells, stable sorting with toggles, and wrap-around navigation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import FOREIGN, STAND_IN, java_pattern
from ..lineage import written


@dataclass(frozen=True)
class ColumnInfo:
    key: str
    sortable: bool
    type: str
    descending_first: bool


def columns_of(df: DataFrame, fixed: tuple[str, ...] = ()) -> list[ColumnInfo]:
    """Name, sortable, type and default direction: numbers start descending."""
    out = []
    for f in df.schema.fields:
        number = isinstance(f.dataType, T.NumericType)
        out.append(ColumnInfo(f.name, f.name not in fixed, "number" if number else "string", number))
    return out


def declared_columns(columns: DataFrame) -> list[ColumnInfo]:
    """The columns that the header of one table declares, in order: rows of (i, key, sortable, type, descending_first)."""
    return [ColumnInfo(r["key"], r["sortable"], r["type"], r["descending_first"]) for r in columns.orderBy("i").collect()]


def matches_row(df: DataFrame, pattern: str, columns: list[str] | None = None) -> Column:
    """Regardless of case: the pattern, of the dialect of ``functions.patterns``, occurs in the row's whole text; one that
    is invalid there is taken literally."""
    whole = F.concat_ws("\n", *[F.col(c).cast("string") for c in columns or df.columns])
    java = java_pattern(pattern)
    if java is None:
        return F.contains(F.lower(whole), F.lit(pattern.lower()))
    return F.translate(whole, FOREIGN, STAND_IN).rlike(java)


def filter_rows(df: DataFrame, pattern: str, columns: list[str] | None = None) -> DataFrame:
    return df.where(matches_row(df, pattern, columns))


#: The white space around a number, and how numbers are written.
_BLANK = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_BASES = {"x": (16, "[0-9a-fA-F]"), "o": (8, "[0-7]"), "b": (2, "[01]")}


def number_cell(text: Column) -> Column:
    """Text as a number, by the rules of scripts: white space around it is dropped; blank, and no text at all, is 0;
    decimal numbers, ``Infinity`` with a sign, and hexadecimal, octal and binary numbers without one; anything else is NaN."""
    bare = F.regexp_replace(text, f"^{_BLANK}|{_BLANK}\\z", "")

    def based(letter: str) -> Column:
        base, _ = _BASES[letter]
        value = lambda c: F.instr(F.lit("0123456789abcdef"), F.lower(c)) - 1
        digits = F.filter(F.split(F.substring(bare, F.lit(3), F.length(bare)), ""), lambda c: c != "")
        return F.aggregate(digits, F.lit(0.0), lambda n, c: n * base + value(c))

    out = F.when(text.isNull() | (bare == ""), 0.0).when(bare.rlike(_DECIMAL), bare.try_cast("double"))
    out = out.when(bare.isin("Infinity", "+Infinity"), float("inf")).when(bare == "-Infinity", float("-inf"))
    for letter, (_, digit) in _BASES.items():
        out = out.when(bare.rlike(f"^0[{letter}{letter.upper()}]{digit}+\\z"), based(letter))
    return out.otherwise(float("nan"))


def sort_order(df: DataFrame, column: str, position: str, descending: bool = False) -> list[Column]:
    """Stable: ties keep their original order in either direction. Text goes by UTF-16 units, numbers by value, a missing
    one as 0. NaN and missing text equal everything in the comparison this follows, so they have no place of their own
    there; here they come last in either direction."""
    kind = df.schema[column].dataType
    col = F.col(column)
    if isinstance(kind, T.StringType):
        col = F.encode(col, "UTF-16BE")
    elif isinstance(kind, T.NumericType):
        col = F.coalesce(col, F.lit(0).cast(kind))
    last = [F.isnan(col).asc()] if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else []
    return [*last, col.desc_nulls_last() if descending else col.asc_nulls_last(), F.col(position).asc()]


def sort_by(df: DataFrame, column: str, position: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*sort_order(df, column, position, descending))


class SortState:
    """Which column orders the rows; the first column ascending at first."""

    def __init__(self, columns: list[ColumnInfo]):
        self.columns, self.index, self.descending = columns, 0, False

    def click(self, index: int) -> None:
        if not self.columns[index].sortable:
            return
        self.descending = not self.descending if index == self.index else self.columns[index].descending_first
        self.index = index

    def apply(self, df: DataFrame, position: str) -> DataFrame:
        return sort_by(df, self.columns[self.index].key, position, self.descending)

    def positions(self, df: DataFrame, position: str, partition: list[str] = (), **options) -> DataFrame:
        """Adds ``position``: the place of each row, from 1, in this order, in the whole table or within its partition."""
        return with_positions(df, sort_order(df, self.columns[self.index].key, position, self.descending), list(partition), **options)


def fits(df: DataFrame, partition: list[str], most: int) -> bool:
    """No partition has more than ``most`` rows, so a window may hold each in one task."""
    return bool(partition) and (df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0) <= most


@dataclass
class Ranges:
    """A table dealt into ranges of its order, and written: ``rows`` has ``part_`` (the range) and ``local_`` (the place in
    it). ``crossing`` has, for each partition that lies in several ranges, the range, the rows of it in earlier ranges, and
    the keys at its borders; there are fewer such partitions than ranges."""

    rows: DataFrame
    crossing: list[tuple]
    names: list[str]


def in_ranges(df: DataFrame, order: list[Column], partition: list[str], key: Column, ranges: int | None) -> Ranges:
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [*[F.col(c).asc() for c in partition], *order]
    place = F.monotonically_increasing_id()  # the range above 33 bits, the row in it below
    rows = df.repartitionByRange(ranges, *whole).sortWithinPartitions(*whole).withColumn("place_", place)
    rows = written(rows.select(*df.columns, F.shiftright("place_", 33).cast("int").alias("part_"), F.col("place_").bitwiseAND((1 << 33) - 1).alias("local_")), "ordered")
    names = [f"p{i}_" for i in range(len(partition))]
    named = rows.select(*[F.col(c).alias(n) for c, n in zip(partition, names, strict=True)], "part_", "local_", F.struct(key.alias("key")).alias("key_"))
    pieces = named.groupBy(*names, "part_").agg(F.count("*").alias("n"), F.min_by("key_", "local_").alias("first"), F.max_by("key_", "local_").alias("last"))
    cross = pieces.groupBy(*names).agg(F.count("*").alias("c")).where("c > 1").drop("c")
    if names:
        there = [F.col(n).eqNullSafe(F.col(f"c{n}")) for n in names]
        pieces = pieces.join(cross.toDF(*[f"c{n}" for n in names]), there, "left_semi")
    groups: dict[tuple, list] = {}
    for r in pieces.collect():  # at most twice as many as ranges
        groups.setdefault(tuple(r[n] for n in names), []).append(r)
    out = []
    for g, parts in groups.items():
        parts.sort(key=lambda r: r["part_"])
        before = 0
        for i, r in enumerate(parts):
            out.append((*g, r["part_"], before, parts[(i + 1) % len(parts)]["first"], parts[i - 1]["last"]))
            before += r["n"]
    return Ranges(rows, out, names)


def beside(r: Ranges, partition: list[str], key: str | None = None) -> DataFrame:
    """``rows`` with ``before_``, ``follows_`` and ``leads_`` of their piece of a partition, null where it lies in one range."""
    kind = r.rows.schema[key].dataType if key else T.IntegerType()
    item = T.StructType([T.StructField("key", kind)])
    fields = [*[T.StructField(n, r.rows.schema[c].dataType) for n, c in zip(r.names, partition, strict=True)], T.StructField("at_", T.IntegerType()), T.StructField("before_", T.LongType()), T.StructField("follows_", item), T.StructField("leads_", item)]
    pieces = r.rows.sparkSession.createDataFrame(r.crossing, T.StructType(fields))
    on = [F.col("part_") == F.col("at_"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in zip(partition, r.names, strict=True)]]
    return r.rows.join(F.broadcast(pieces), on, "left").drop(*r.names, "at_")


def with_positions(df: DataFrame, order: list[Column], partition: list[str], most: int = 1_000_000, ranges: int | None = None) -> DataFrame:
    """Adds ``position``, from 1, within the partition, or in the whole table if there is none. Large partitions, and the
    whole table, are dealt into ranges: a row's place is its place in the range and the rows of earlier ranges."""
    if fits(df, partition, most):
        return df.withColumn("position", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("bigint"))
    rows = beside(in_ranges(df, order, partition, F.lit(0), ranges), partition)
    local = F.row_number().over(Window.partitionBy("part_", *partition).orderBy("local_")) if partition else F.col("local_") + 1
    return rows.select(*df.columns, (local + F.coalesce("before_", F.lit(0))).cast("bigint").alias("position"))


def with_neighbours(df: DataFrame, key: str, order: str, partition: list[str] = (), most: int = 1_000_000, ranges: int | None = None) -> DataFrame:
    """Adds ``next_`` and ``previous_``: the neighbours of ``key`` in order, wrapping at both ends of a partition, or of the
    whole table if there is none. Rows of equal order go by key. Large partitions, and the whole table, are dealt into
    ranges, and rows at a border take their neighbour from the range beside it."""
    partition, sort = list(partition), [F.col(order).asc(), F.col(key).asc()]
    if fits(df, partition, most):
        rows, local, w = df, [], Window.partitionBy(*partition).orderBy(*sort)
    else:
        rows = beside(in_ranges(df, sort, partition, F.col(key), ranges), partition, key)
        local, w = ["follows_", "leads_"], Window.partitionBy("part_", *partition).orderBy("local_")
    item, whole = F.struct(F.col(key).alias("key")), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead(item).over(w), *local[:1], F.first(item).over(whole))
    before = F.coalesce(F.lag(item).over(w), *local[1:], F.last(item).over(whole))
    return rows.select(*df.columns, after["key"].alias("next_"), before["key"].alias("previous_"))


def uncovered_spans(spans: DataFrame) -> DataFrame:
    """Rows (id, parent, hits, pct_class) without hits or of class low, except direct children of another such row."""
    some = spans.where((F.col("hits") == 0) | (F.col("pct_class") == "low"))
    parents = some.select(F.col("id").alias("parent"))
    return some.join(parents, "parent", "left_anti").select(spans.columns)
