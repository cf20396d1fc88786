"""Series and frames as JSON documents with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import LONG, FrameError, Shape, get_attributes, is_time, value_columns
from tidewell.plans.blocks import lay_out, number_rows

# Field names of the document format.
KIND, METADATA, DATA, OPTIONS = (
    "__hd_wrapped_data_object__",
    "__metadata__",
    "__data__",
    "__data_parsing_options__",
)
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
PART_ROWS = 100_000


def _field(document: Column, *path: str) -> Column:
    return F.get_json_object(document, "$" + "".join(f"['{p}']" for p in path))


def _content(document: Column) -> Column:
    """The data part; a plain document is data as a whole."""
    return F.when(_field(document, KIND).isNotNull(), _field(document, DATA)).otherwise(document)


def _orient(document: Column, default: str) -> Column:
    return F.coalesce(_field(document, OPTIONS, "orient"), F.lit(default))


def _as_time(text: Column) -> Column:
    """ISO text, or milliseconds since the epoch."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_millis(text.try_cast("bigint")))


def check_kind(document: Column, kind: str) -> Column:
    """Fails on a wrapped document of another kind."""
    found = _field(document, KIND)
    message = F.concat(F.lit(f"expected {kind}, got "), found)
    return F.when(found.isNotNull() & (found != kind), F.raise_error(message).cast("string")).otherwise(document)


def decode_series(df: DataFrame, document: str, value_type: str = "double", time_index: bool = True) -> DataFrame:
    """Rows ``timestamp`` (or ``index``), ``value`` of every series document, beside the other columns."""
    whole = check_kind(F.col(document), "SERIES")
    content, orient = _content(F.col("_doc")), _orient(F.col("_doc"), "index")
    split = F.from_json(content, f"index array<string>, data array<{value_type}>")
    flat = F.from_json(content, f"map<string,{value_type}>")
    listed = F.from_json(content, f"array<{value_type}>")
    pair = f"array<struct<i:string,v:{value_type}>>"
    from_split = F.arrays_zip(split["index"].alias("i"), split["data"].alias("v")).cast(pair)
    from_map = F.map_entries(flat).cast(pair)
    from_list = F.transform(listed, lambda v, i: F.struct(i.cast("string").alias("i"), v.alias("v")))
    entries = F.when(orient == "split", from_split).when(orient == "records", from_list).otherwise(from_map)
    rows = df.withColumn("_doc", whole).withColumn("_entry", F.explode(entries))
    others = [c for c in df.columns if c != document]
    index = F.col("_entry.i")
    placed = _as_time(index).alias("timestamp") if time_index else index.alias("index")
    return rows.select(*others, placed, F.col("_entry.v").alias("value"))


def decode_frame(df: DataFrame, document: str, schema: T.StructType, time_index: bool = True) -> DataFrame:
    """Rows of every frame document in one of the orients columns, index, records or split.

    Each orient is parsed into fields of the given schema and zipped by position. Only a
    document in the columns orient whose columns do not list the same index is looked up by
    index label.
    """
    names = [f.name for f in schema if f.name != "timestamp" or not time_index]
    plain = "string"

    def fields(kind: str) -> str:
        return ", ".join(f"`{n}` {kind}" for n in names)

    entry = f"array<struct<i:string, {', '.join(f'`{n}`:string' for n in names)}>>"
    doc = F.col("_doc")
    rows = df.withColumn("_doc", check_kind(F.col(document), "DATAFRAME")).withColumns(
        {"_content": _content(doc), "_orient": _orient(doc, "columns")}
    )

    def parsed(orient: str, kind: str) -> Column:
        return F.when(F.col("_orient") == orient, F.from_json("_content", kind))

    rows = rows.withColumns(
        {
            "_columns": parsed("columns", fields("map<string,string>")),
            "_index": parsed("index", f"map<string,struct<{fields(plain)}>>"),
            "_records": parsed("records", f"array<struct<{fields(plain)}>>"),
            "_split": parsed("split", "columns array<string>, index array<string>, data array<array<string>>"),
        }
    )
    columns, split = F.col("_columns"), F.col("_split")
    keys = F.map_keys(columns[names[0]])
    same = F.lit(True)
    for n in names[1:]:
        same = same & F.coalesce(F.map_keys(columns[n]) == keys, F.lit(False))
    zipped = F.arrays_zip(keys, *[F.map_values(columns[n]) for n in names]).cast(entry)
    labels = F.array_distinct(
        F.flatten(F.array(*[F.coalesce(F.map_keys(columns[n]), F.array().cast("array<string>")) for n in names]))
    )
    looked_up = F.transform(labels, lambda i: F.struct(i, *[F.try_element_at(columns[n], i) for n in names])).cast(entry)
    by_index = F.transform(F.map_entries("_index"), lambda e: F.struct(e["key"], *[e["value"][n] for n in names]))
    by_record = F.transform("_records", lambda r, i: F.struct(i.cast("string"), *[r[n] for n in names]))
    place = {n: F.array_position(split["columns"], n).cast("int") for n in names}
    by_split = F.transform(
        F.arrays_zip(split["index"].alias("i"), split["data"].alias("d")),
        lambda e: F.struct(
            e["i"], *[F.when(place[n] > 0, F.try_element_at(e["d"], F.greatest(place[n], F.lit(1)))) for n in names]
        ),
    )
    entries = (
        F.when(F.col("_orient") == "split", by_split.cast(entry))
        .when(F.col("_orient") == "records", by_record.cast(entry))
        .when(F.col("_orient") == "index", by_index.cast(entry))
        .when(same, zipped)
        .otherwise(looked_up)
    )
    others = [c for c in df.columns if c != document]
    exploded = rows.select(*others, F.explode(entries).alias("_entry"))
    index = F.col("_entry.i")
    cells = [(_as_time(index) if time_index else index).alias("timestamp" if time_index else "index")]
    for field in schema:
        if field.name in names:
            text = F.col("_entry")[field.name]
            typed = _as_time(text) if isinstance(field.dataType, T.TimestampType) else text.try_cast(field.dataType)
            cells.append(typed.alias(field.name))
    return exploded.select(*others, *cells)


def document_metadata(document: Column) -> Column:
    """Metadata of a wrapped document as JSON text, NULL for a plain one."""
    return _field(document, METADATA)


def _metadata_json(df: DataFrame, column: str) -> Column:
    import json

    return F.lit(json.dumps(get_attributes(df, column)))


def _label(df: DataFrame, shape: Shape) -> Column:
    at = F.col(shape.ts)
    return F.date_format(at, ISO) if is_time(df, shape.ts) else at.cast("string")


def _numbered(df: DataFrame, shape: Shape, part_rows: int) -> DataFrame:
    if part_rows < 1:
        raise FrameError("part_rows must be positive")
    numbered = number_rows(lay_out(df, shape)).rows()
    return numbered.withColumn("part", F.floor((F.col("_row") - 1) / F.lit(part_rows)))


def _joined(pieces: Column) -> Column:
    return F.concat_ws(",", pieces)


def encode_series(df: DataFrame, shape: Shape = LONG, part_rows: int = PART_ROWS) -> DataFrame:
    """Series documents in the split orient, which keeps repeated index values.

    A document holds at most ``part_rows`` points; a longer series gives several, numbered by
    ``part``, so no task ever gathers a whole long series.
    """
    quoted = F.concat(F.lit('"'), _label(df, shape), F.lit('"'))
    value = F.coalesce(F.get_json_object(F.to_json(F.struct(F.col(shape.value).alias("v")), {"ignoreNullFields": "false"}), "$.v"), F.lit("null"))
    if isinstance(df.schema[shape.value].dataType, (T.StringType, T.TimestampType, T.DateType)):
        value = F.when(F.col(shape.value).isNull(), F.lit("null")).otherwise(
            F.regexp_extract(F.to_json(F.struct(F.col(shape.value).cast("string").alias("v"))), r'^\{"v":(.*)\}$', 1)
        )
    item = F.struct(F.col("_row").alias("row"), quoted.alias("i"), value.alias("v"))
    parts = _numbered(df, shape, part_rows).groupBy(*shape.keys, "part").agg(F.array_sort(F.collect_list(item)).alias("items"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in shape.keys]) if shape.keys else F.lit(shape.value)
    text = F.concat(
        F.lit(f'{{"{KIND}":"SERIES","{METADATA}":'), _metadata_json(df, shape.ts), F.lit(f',"{DATA}":{{"name":'),
        F.regexp_extract(F.to_json(F.struct(name.alias("v"))), r'^\{"v":(.*)\}$', 1),
        F.lit(',"index":['), _joined(F.transform("items", lambda e: e["i"])),
        F.lit('],"data":['), _joined(F.transform("items", lambda e: e["v"])),
        F.lit(f']}},"{OPTIONS}":{{"orient":"split"}}}}'),
    )
    return parts.select(*shape.keys, "part", text.alias("document"))


def encode_frame(df: DataFrame, shape: Shape = LONG, part_rows: int = PART_ROWS) -> DataFrame:
    """Frame documents in the columns orient; the index must not repeat inside a document."""
    columns = value_columns(df, shape)
    item = F.struct(F.col("_row").alias("row"), _label(df, shape).alias("i"), *[F.col(c) for c in columns])
    parts = _numbered(df, shape, part_rows).groupBy(*shape.keys, "part").agg(F.array_sort(F.collect_list(item)).alias("items"))
    def labelled(column: str) -> Column:
        return F.map_from_entries(F.transform("items", lambda e: F.struct(e["i"], e[column]))).alias(column)

    cells = F.struct(*[labelled(c) for c in columns])
    text = F.concat(
        F.lit(f'{{"{KIND}":"DATAFRAME","{METADATA}":'), _metadata_json(df, shape.ts), F.lit(f',"{DATA}":'),
        F.to_json(cells, {"ignoreNullFields": "false", "timestampFormat": ISO}), F.lit("}"),
    )
    return parts.select(*shape.keys, "part", text.alias("document"))
