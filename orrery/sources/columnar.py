"""Columnar payloads: Parquet with column globs, components and row groups by size; JSON; Arrow exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.functions.glob import is_glob, matches

ROW_GROUP_BYTES = 1_000_000_000
# Bits of a value in a row's estimated width.
_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64, T.FloatType: 32, T.DoubleType: 64,
    T.DateType: 32, T.TimestampType: 64, T.TimestampNTZType: 64,
}


def chosen(names: Sequence[str], patterns: str | Sequence[str]) -> list[str]:
    """The names that patterns match, in the order of the patterns; LookupError if one matches none."""
    out: dict[str, None] = {}
    for p in [patterns] if isinstance(patterns, str) else patterns:
        found = [n for n in names if n == p or is_glob(p) and matches(p, n)]
        if not found:
            raise LookupError(f"no column matches {p!r}; there are {', '.join(names)}")
        out |= dict.fromkeys(found)
    return list(out)


def read(spark: SparkSession, path: str, columns: str | Sequence[str] | None = None, component: str | None = None) -> DataFrame:
    """A Parquet payload, or one of its components: ``columns``, ``schema`` or ``rowcount``.

    Only the columns wanted are read; a count reads footers only.
    """
    df = spark.read.parquet(path)
    if component == "rowcount":
        return df.agg(F.count("*").alias("rowcount"))
    if component in ("columns", "schema"):
        return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, type string")
    if component:
        raise LookupError(f"there is no component {component!r}")
    return select(df, columns)


def select(df: DataFrame, columns: str | Sequence[str] | None) -> DataFrame:
    return df if columns is None else df.select(*(F.col(f"`{c}`") for c in chosen(df.columns, columns)))


def row_width(schema: T.StructType, lengths: dict[str, int] | None = None) -> int:
    """Bytes of a row: strings count their declared length or 10, lists 10 items."""

    def bits(t: T.DataType, name: str) -> int:
        if isinstance(t, T.ArrayType):
            return 10 * bits(t.elementType, name)
        if isinstance(t, T.StructType):
            return sum(bits(f.dataType, f.name) for f in t)
        if isinstance(t, T.DecimalType):
            return 128
        return _WIDTHS.get(type(t), 8 * (lengths or {}).get(name, 10))

    return max(1, sum(bits(f.dataType, f.name) for f in schema) // 8)


def row_group_rows(schema: T.StructType, target: int = ROW_GROUP_BYTES, lengths: dict[str, int] | None = None) -> int:
    return max(1, target // row_width(schema, lengths))


def write(df: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, mode: str = "error") -> None:
    df.write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_log_records(spark: SparkSession, path: str) -> DataFrame:
    """Log records of JSON lines: name, asctime, message, levelno, levelname, and what else they hold in MDC."""
    return spark.read.schema("name string, asctime timestamp, message string, levelno int, levelname string, MDC map<string, string>").json(path)


def to_numpy(df: DataFrame) -> dict:
    """Columns as numpy arrays, masked where null. Collects the frame."""
    import numpy as np

    out = {}
    for name, column in zip(df.columns, df.toArrow().columns, strict=True):
        values = column.to_numpy(zero_copy_only=False) if hasattr(column, "chunks") is False else column.to_numpy()
        out[name] = np.ma.masked_array(values, column.is_null().to_numpy()) if column.null_count else values
    return out


def from_numpy(spark: SparkSession, arrays: dict) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table({k: pa.array(list(v) if getattr(v, "ndim", 1) > 1 else v) for k, v in arrays.items()}))


# ---------------------------------------------------------------- other shapes of the same columns


def to_pandas(df: DataFrame, index: str | Sequence[str] | None = None, multi: bool = False):
    """A pandas frame of ``df``, which is collected. ``multi``: struct columns become levels of a column index."""
    import pandas as pd

    out = df.toArrow().to_pandas()
    if multi:
        nested = [f.name for f in df.schema if isinstance(f.dataType, T.StructType)]
        if len(nested) != len(df.columns):
            raise ValueError("a column index of several levels needs structs only")
        flat = {(c, f.name): [None if r is None else r[f.name] for r in out[c]] for c in nested for f in df.schema[c].dataType}
        out = pd.DataFrame(flat, columns=pd.MultiIndex.from_tuples(list(flat)))
    return out if index is None else out.set_index(index)


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A frame of a pandas one: named index levels become columns, levels of its columns structs."""
    import pandas as pd

    names = [n for n in frame.index.names if n is not None]
    if names:
        frame = frame.reset_index(names)
    if isinstance(frame.columns, pd.MultiIndex):
        if frame.columns.nlevels != 2:
            raise ValueError("columns may have two levels")
        flat = frame.copy()
        flat.columns = [f"c{i}" for i in range(len(frame.columns))]
        df = from_pandas(spark, flat)
        outer: dict[str, list] = {}
        for i, (a, b) in enumerate(frame.columns):
            outer.setdefault(str(a), []).append(F.col(f"c{i}").alias(str(b)))
        return df.select(*(F.struct(*cols).alias(name) for name, cols in outer.items()))
    import pyarrow as pa

    return spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False))


def two_level(df: DataFrame, wanted: Sequence[tuple[str, str]] | dict[int, str | Sequence[str]]) -> DataFrame:
    """Columns of structs by pairs (outer, inner), or by the names of either level; LookupError if there is none."""
    have = [(f.name, g.name) for f in df.schema if isinstance(f.dataType, T.StructType) for g in f.dataType]
    if isinstance(wanted, dict):
        if set(wanted) - {0, 1}:
            raise ValueError("levels are 0 and 1")
        listed = {k: [v] if isinstance(v, str) else list(v) for k, v in wanted.items()}
        for level, names in listed.items():
            if missing := [n for n in names if n not in {p[level] for p in have}]:
                raise LookupError(f"level {level} has no {', '.join(missing)}")
        pairs = [p for p in have if all(p[level] in names for level, names in listed.items())]
    else:
        pairs = list(wanted)
        if missing := [p for p in pairs if p not in have]:
            raise LookupError(f"there is no column {missing[0]}")
    outer: dict[str, list] = {}
    for a, b in pairs:
        outer.setdefault(a, []).append(F.col(f"`{a}`.`{b}`").alias(b))
    return df.select(*(F.struct(*cols).alias(a) for a, cols in outer.items()))


#: Spark's types of key and metadata kinds.
SPARK_TYPES = {
    "int": T.LongType(), "string": T.StringType(), "float": T.DoubleType(), "bool": T.BooleanType(), "hash": T.BinaryType(), "uuid": T.StringType(),
    "datetime": T.LongType(), "ingest_date": T.TimestampNTZType(),
    "timespan": T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]),
    "region": T.StructType([T.StructField("kind", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType()))]),
}


def record_schema(universe, element: str) -> T.StructType:
    """The schema of an element's table: its keys, what they imply, its metadata, region and timespan."""
    e = universe[element]
    names = [*universe.conform(e.required).names, *([element] if e.is_dimension else [])]
    fields = [T.StructField(n, SPARK_TYPES[universe[n].key_type], nullable=False) for n in names]
    fields += [T.StructField(n, SPARK_TYPES[universe[n].key_type]) for n in e.implied if n not in names]
    fields += [T.StructField(n, SPARK_TYPES[k]) for n, k in e.metadata.items()]
    fields += [T.StructField(k, SPARK_TYPES[k]) for k, there in (("region", e.spatial), ("timespan", e.temporal)) if there]
    return T.StructType(fields)


def record_arrow_schema(universe, element: str, version: str = "1"):
    """The same as Arrow has it, with the element and the version of its universe as metadata."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(record_schema(universe, element)).with_metadata({"element": element, "version": version})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def json_lines(df: DataFrame, page: int = 2000):
    """Pages of JSON lines, text of at most so many rows each, fetched a partition at a time."""
    held: list[str] = []
    for r in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator(prefetchPartitions=True):
        held.append(r["line"])
        if len(held) == page:
            yield "\n".join(held) + "\n"
            held = []
    if held:
        yield "\n".join(held) + "\n"


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of each file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
