"""Catalog files: the wide product export and the extract as JSON lines; bulk load of the dimension tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import catalog
from tideline.sources import dimensions
from tideline.tables import CATALOG_EXPORT, CATALOG_EXTRACT

_EXPORT = {"sep": "\t", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
_PIECE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("closed", pa.bool_()), ("open", pa.bool_())])
_TEXTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("record", pa.string())])


def product_export(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The five columns used of a tab-separated export with a header, quoted text and very long fields.

    With ``multi_line`` quoted fields may hold line ends (``quoted_records``). Either way an uncompressed file is read in as
    many tasks as its size asks for. Records end with a line feed, or with a carriage return before it; line ends inside a field
    stay as they are.
    """
    reader = spark.read.options(**_EXPORT, header="true", inferSchema="false")
    if not multi_line:
        return reader.csv(path).select(*CATALOG_EXPORT)
    names = reader.csv(path).columns  # from the first line of the first file
    columns = ", ".join(f"`{name}` string" for name in names)
    records = quoted_records(spark, path).select(F.from_csv("record", columns, _EXPORT).alias("row"))
    return records.select(*[F.col("row").getField(name).alias(name) for name in CATALOG_EXPORT])


def _after(line: Column, inside: bool) -> Column:
    """Whether the end of a line lies inside a quoted field, if its start does or does not.

    A quote opens a field only as its first character; inside, an odd number of quotes up to a tab or the end closes it.
    """
    def step(state: Column, piece: Column) -> Column:
        odd = (F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))) % 2 == 1
        return F.when(state, ~odd).otherwise(F.startswith(piece, F.lit('"')) & odd)

    return F.when(F.contains(line, F.lit('"')), F.aggregate(F.split(line, "\t"), F.lit(inside), step)).otherwise(F.lit(inside))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of tab-separated files without their header lines; a record ends with a line whose end is not quoted.

    The files are read as lines, in the pieces that Spark cuts them into. What a piece does to the state "inside quotes" is a
    function of two values, so one small row a piece, put in the order of the file, tells every piece how it begins. Each
    piece then joins its own lines, and only what crosses its borders moves. The files are read three times: for the states,
    for whole records, and for the ends at borders. Broadcast is a row for each piece that begins inside a field.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    lines = lines.select("file", "start", "line", _after(F.col("line"), False).alias("closed"), _after(F.col("line"), True).alias("open"))

    def pieces(batches):
        found: dict = {}
        for batch in batches:
            for file, start, *after in zip(*[batch[name].to_pylist() for name in ("file", "start", "closed", "open")]):
                found[file, start] = tuple(after[state] for state in found.get((file, start), (False, True)))
        yield pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, (*key, *after))) for key, after in found.items()], schema=_PIECE)

    each = lines.select(*_PIECE.names).mapInArrow(pieces, "file string, start bigint, closed boolean, open boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("closed", "open")).over(before)
    inside = F.aggregate(earlier, F.lit(False), lambda state, piece: F.when(state, piece["open"]).otherwise(piece["closed"]))
    begins = each.select(F.col("file").alias("of"), F.col("start").alias("at"), inside.alias("inside")).where("inside")
    told = lines.join(F.broadcast(begins), (F.col("file") == F.col("of")) & (F.col("start") == F.col("at")), "left")
    texts = told.select(*_PIECE.names, "line", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(
        _joined, "file string, start bigint, place bigint, begins boolean, ends boolean, record string")
    whole = texts.where("begins and ends").select("record")
    order = Window.partitionBy("file").orderBy("start", "place")
    parts = texts.where("not (begins and ends)").withColumn("of", F.sum(F.col("begins").cast("int")).over(order))
    parts = parts.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("parts"))
    return whole.unionByName(parts.select(F.concat_ws("\n", "parts.record").alias("record")))


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines joined to records, and to parts of records at the borders of pieces; without headers and empty lines."""
    out, size, place, piece, held, begins, header = [], 0, 0, None, [], True, False

    def ended(ends: bool) -> None:
        nonlocal held, place, header, size
        text = "\n".join(held)
        text = text[:-1] if ends and text.endswith("\r") else text
        if held and not header and not (begins and ends and not text):
            out.append(dict(zip(_TEXTS.names, (*piece, place, begins, ends, text))))
            size += len(text)
        held, place, header = [], place + 1, False

    for batch in batches:
        for file, start, closed, open_, line, inside in zip(*[batch[name].to_pylist() for name in (*_PIECE.names, "line", "inside")]):
            if piece != (file, start):
                ended(False)
                piece, state, begins, header = (file, start), inside, not inside, start == 0
            held.append(line)
            state = open_ if state else closed
            if not state:
                ended(True)
                begins = True
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=_TEXTS)
                out, size = [], 0
    ended(False)
    yield pa.RecordBatch.from_pylist(out, schema=_TEXTS)


def write_extract(extract: DataFrame, path: str) -> None:
    extract.write.mode("overwrite").option("compression", "gzip").json(path)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_EXTRACT).json(path)


def load_catalog(spark: SparkSession, extract: DataFrame, root: str) -> None:
    """Replace the product and shade tables by a new catalog; ingredients are empty until the next refresh."""
    numbered = catalog.catalog_ids(extract)
    no_key = F.lit(None).cast("string").alias("canonical_key")
    no_name = F.lit(None).cast("string").alias("canonical_name")
    never = F.lit(None).cast("timestamp").alias("refreshed_at")
    products = catalog.products(numbered).select("*", no_key, never)
    shades = catalog.shades(numbered).select("shade_id", "product_id", "raw_name", no_name, "hex", never)
    dimensions.write_version(spark, root, products=products, shades=shades)
