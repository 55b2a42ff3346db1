"""Records: named fields in one place, each its own Parquet table, with a checksum and metadata; point clouds and meshes as text; grids as JSON."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.operators.statistics import checksum
from graticula.sources.meshes import CELLS_SQL
from graticula.sources.tables import order_points, table


#: Where spark.checkpoint.dir is unset (local use): a folder of this machine for each application.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that spark.checkpoint.dir names. Only a local session may leave it unset: it gets a folder of its own then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="graticula-")
        folder = _OWN[app]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once: what is used more than once is made once, and the plans of what follows stay short.

    Spark takes files for as large as they are compressed, so joins of what can be as large as a mesh say hint("merge"): it could be broadcast otherwise.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_record(fields: dict[str, DataFrame], path: str, mode: str = "error", compression: str = "zstd") -> None:
    """Each field goes to path/name; their schemas, row counts and checksums to path/_index, a row for each.

    mode: error, overwrite or append. What is appended counts with what was there, and the index keeps the fields that are not written now.
    """
    spark, rows = None, []
    for name, df in fields.items():
        spark = df.sparkSession
        df.write.mode(mode).option("compression", compression).parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        c = checksum(back, back.columns).first()
        rows.append((name, json.dumps(back.dtypes), c["n"], c["added"] or 0, c["mixed"] or 0))
    if rows:
        if mode == "append":
            try:
                before = spark.read.parquet(f"{path}/_index.parquet").collect()  # a row for each field
            except AnalysisException:  # the first part
                before = []
            rows += [tuple(r) for r in before if r["name"] not in fields]
        index = spark.createDataFrame(rows, "name string, columns string, n long, added long, mixed long").coalesce(1)
        index.write.mode("overwrite" if mode == "append" else mode).parquet(f"{path}/_index.parquet")


def read_field(spark: SparkSession, path: str, name: str, *columns: str) -> DataFrame:
    """One field, read when it is used; only the columns asked for leave the file."""
    df = spark.read.parquet(f"{path}/{name}")
    return df.select(*columns) if columns else df


def verify(spark: SparkSession, path: str) -> DataFrame:
    """name and ok: whether each field still has its row count and checksum."""
    out = []
    for r in spark.read.parquet(f"{path}/_index.parquet").collect():  # a row for each field
        df = spark.read.parquet(f"{path}/{r['name']}")
        c = checksum(df, df.columns).first()
        out.append((r["name"], (c["n"], c["added"] or 0, c["mixed"] or 0) == (r["n"], r["added"], r["mixed"])))
    return spark.createDataFrame(out, "name string, ok boolean")


def list_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_index.parquet").select("name", "columns", "n")


def linked(*parts: DataFrame) -> DataFrame:
    """A record over others: their rows, read in place."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_points(points: DataFrame, path: str, columns: list[str]) -> None:
    """Text with a header line: lon, lat and fields, separated by blanks."""
    points.select("lon", "lat", *columns).write.option("sep", " ").option("header", True).csv(path)


def read_points(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} double" for c in ("lon", "lat", *columns))
    return spark.read.schema(schema).option("sep", " ").option("header", True).csv(path)


def points_json(points: DataFrame, *columns: str) -> DataFrame:
    """One JSON line for each point."""
    return points.select(F.to_json(F.struct("gidx", *columns)).alias("json"))


def write_mesh(nodes: DataFrame, cells: DataFrame, path: str) -> None:
    """Nodes and elements as text lines `n id x y z` and `e id nodes...`."""
    n = nodes.select(F.concat_ws(" ", F.lit("n"), "gidx", "lon", "lat", F.lit("0")).alias("value"))
    e = cells.select(F.concat_ws(" ", F.lit("e"), "cell", F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ")).alias("value"))
    n.unionByName(e).write.text(path)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    nodes = parts.filter(F.col("p")[0] == "n").select(F.col("p")[1].cast("long").alias("gidx"), F.col("p")[2].cast("double").alias("lon"), F.col("p")[3].cast("double").alias("lat"))
    cells = parts.filter(F.col("p")[0] == "e").select(F.col("p")[1].cast("long").alias("cell"), F.slice(F.col("p"), F.lit(3), F.size("p") - 2).cast("array<long>").alias("nodes"))
    return nodes, cells


def sectioned(spark: SparkSession, path: str) -> DataFrame:
    """section, value: the lines of a text with sections $Name ... $EndName, a file of any size or a folder of files in the order of their names, read in splits.

    A task does not know in which section its split begins. So a first pass notes the last mark of each split, a row for each; the section in which a split begins is
    the last mark before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def marked(batches: Iterator[pa.RecordBatch], summary: bool) -> Iterator[pa.RecordBatch]:
        split, section = None, None
        for batch in batches:
            out, ends = [], []
            for value, *here in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if here != split:
                    if split is not None:
                        ends.append((*split, section))
                    split, section = here, None
                text = value.strip()
                if text.startswith("$"):
                    section = "" if text.startswith("$End") else text[1:]
                elif text and not summary:
                    out.append((*here, section, text))
            yield from rows(ends if summary else out)
        if summary and split is not None:
            yield from rows([(*split, section)])

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            columns = list(zip(*found, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["file", "at", "section", "value"][: len(columns)])

    ends = lines.mapInArrow(lambda b: marked(b, True), "file string, at long, section string")
    # a split may come in pieces of a task's batches: its last mark counts
    ends = ends.groupBy("file", "at").agg(F.last("section", ignorenulls=True).alias("section"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    begins = ends.select("file", "at", F.coalesce(F.last("section", ignorenulls=True).over(before), F.lit("")).alias("begins"))
    found = lines.mapInArrow(lambda b: marked(b, False), "file string, at long, section string, value string")
    return found.join(F.broadcast(begins), ["file", "at"]).select(F.coalesce("section", "begins").alias("section"), "value")


def read_gmsh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and elements of ASCII text of format 2, sections $Nodes and $Elements: a file or a folder of them, read by many tasks."""
    lines = sectioned(spark, path)
    # try_cast: the optimizer may look at lines of other sections first
    inside = lambda name: lines.filter(F.col("section") == name).select(F.split("value", r"\s+").alias("p")).filter(F.size("p") > 1)
    nodes = inside("Nodes").select(F.col("p")[0].try_cast("long").alias("gidx"), *(F.col("p")[k].try_cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))))
    tags = F.col("p")[2].try_cast("int")
    cells = inside("Elements").select(F.col("p")[0].try_cast("long").alias("cell"), F.col("p")[1].try_cast("int").alias("type"), F.slice(F.col("p"), tags + 4, F.size("p")).try_cast("array<long>").alias("nodes"))
    return nodes, cells


def read_gmsh_field(spark: SparkSession, path: str, section: str = "NodeData") -> DataFrame:
    """gidx, value of a $NodeData (or $ElementData) section: its lines of two numbers; the tags before them have one."""
    p = sectioned(spark, path).filter((F.col("section") == section) & ~F.col("value").startswith('"')).select(F.split("value", r"\s+").alias("p")).filter(F.size("p") == 2)
    return p.select(F.col("p")[0].try_cast("long").alias("gidx"), F.col("p")[1].try_cast("double").alias("value"))


def _section(name: str, first: int, lines: DataFrame, head: list[str]) -> DataFrame:
    """s, k, value: a section's marks, head lines (the last one with the number of lines behind it) and lines (k, value)."""
    spark = lines.sparkSession
    n = lines.agg(F.count("*").cast("string").alias("value")).select(F.lit(first + 1).alias("s"), F.lit(0).cast("long").alias("k"), "value")
    marks = spark.createDataFrame([(first, k, v) for k, v in enumerate([f"${name}", *head])] + [(first + 3, 0, f"$End{name}")], "s int, k long, value string")
    return marks.unionByName(n).unionByName(lines.select(F.lit(first + 2).alias("s"), F.col("k").cast("long").alias("k"), "value"))


def _write_sorted(text: DataFrame, path: str) -> None:
    """Part files whose names are in the order of their lines."""
    parts = int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text.repartitionByRange(parts, "s", "k").sortWithinPartitions("s", "k").select("value").write.text(path)


def write_gmsh(nodes: DataFrame, cells: DataFrame, path: str) -> None:
    """An ASCII mesh of format 2 as a folder of sorted part files, written by many tasks: one after the other they are one mesh file."""
    n = nodes.select(F.col("gidx").alias("k"), F.concat_ws(" ", "gidx", "lon", "lat", F.lit("0")).alias("value"))
    kind = F.when(F.size("nodes") == 2, "1").when(F.size("nodes") == 3, "2").otherwise("3")
    e = cells.select(F.col("cell").alias("k"), F.concat_ws(" ", "cell", kind, F.lit("2 1 1"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ")).alias("value"))
    head = nodes.sparkSession.createDataFrame([(0, 0, "$MeshFormat"), (0, 1, "2.2 0 8"), (0, 2, "$EndMeshFormat")], "s int, k long, value string")
    _write_sorted(head.unionByName(_section("Nodes", 1, n, [])).unionByName(_section("Elements", 5, e, [])), path)


def write_gmsh_field(field: DataFrame, path: str, name: str, section: str = "NodeData", time: float = 0.0, step: int = 0) -> None:
    """A field (gidx, value) in the same format: its name, time and step, then a line for each value."""
    lines = field.select(F.col("gidx").alias("k"), F.concat_ws(" ", "gidx", "value").alias("value"))
    head = field.sparkSession.createDataFrame([(0, 0, "$MeshFormat"), (0, 1, "2.2 0 8"), (0, 2, "$EndMeshFormat")], "s int, k long, value string")
    tags = ["1", json.dumps(name), "1", repr(time), "3", str(step), "1"]
    _write_sorted(head.unionByName(_section(section, 1, lines, tags)), path)


def load_config(text_or_path: str) -> dict:
    """A configuration from JSON text or a JSON file of the driver."""
    if text_or_path.lstrip().startswith("{"):
        return json.loads(text_or_path)
    with open(text_or_path) as f:
        return json.load(f)


#: Sinks by name.
SINKS = {"record": write_record, "points": write_points, "mesh": write_mesh, "gmsh": write_gmsh}


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "record")
    write_record({"points": order_points(s, d), "events": table(s, d, "events", "event_id", "value")}, path)
    return read_field(s, path, "points", "gidx", "value")


def _verified(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "record")
    write_record({"points": order_points(s, d), "events": table(s, d, "events", "event_id", "value")}, path)
    return verify(s, path)


def _appended(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "record")
    points = order_points(s, d).select("gidx", "value")
    for k in range(2):
        write_record({"points": points.filter(F.col("gidx") % 2 == k)}, path, mode="append")
    write_record({"events": table(s, d, "events", "event_id", "value")}, path, mode="append")
    whole = verify(s, path).agg(F.count_if("ok").alias("fields_ok"))
    return read_field(s, path, "points").join(F.broadcast(whole))  # one row


def _text(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "points")
    write_points(order_points(s, d), path, ["value"])
    return read_points(s, path, ["value"])


def _mesh(s: SparkSession, d: str) -> DataFrame:
    from graticula.operators.mesh import structured_cells
    from graticula.sources.meshes import orders_grid

    path, (p, nx, _) = scratch(s, "gmsh"), orders_grid(s, d)
    write_gmsh(p, structured_cells(p, nx), path)
    nodes, cells = read_gmsh(s, path)
    corner = cells.select("cell", "type", F.posexplode("nodes").alias("k", "gidx")).join(nodes, "gidx")
    at = F.transform(F.sort_array(F.collect_list(F.struct("k", "gidx"))), lambda v: v["gidx"].cast("string"))
    return corner.groupBy("cell", "type").agg(F.array_join(at, ",").alias("nodes"), (F.round(F.avg("y"), 6) + 0.0).alias("lat"))


def _gmsh_field(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "gmsh-field")
    write_gmsh_field(order_points(s, d), path, "total price")
    return read_gmsh_field(s, path)


QUERIES = {
    "io1_record_round_trip": _round_trip,
    "io2_record_append": _appended,
    "io5_linked_records": lambda s, d: linked(order_points(s, d).filter("gidx < 500").select("gidx"), order_points(s, d).filter("gidx >= 500").select("gidx")),
    "io8_record_checksums": _verified,
    "io11_gmsh_round_trip": _mesh,
    "io13_gmsh_field": _gmsh_field,
    "io14_points_text": _text,
    "io16_points_json": lambda s, d: points_json(order_points(s, d).select("gidx", "part"), "part"),
}
ORACLES = {
    "io1_record_round_trip": "SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders",
    "io2_record_append": "SELECT o_orderkey AS gidx, o_totalprice AS value, 2::BIGINT AS fields_ok FROM orders",
    "io5_linked_records": "SELECT o_orderkey AS gidx FROM orders",
    "io8_record_checksums": "SELECT * FROM (VALUES ('points', true), ('events', true)) t(name, ok)",
    "io11_gmsh_round_trip": f"SELECT cell, 3 AS type, array_to_string(nodes, ',') AS nodes, round(90.0::DOUBLE - (j + 0.5)*180.0/(ny-1), 6) + 0.0 AS lat FROM {CELLS_SQL}",
    "io13_gmsh_field": "SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders",
    "io14_points_text": "SELECT ((o_orderkey*37)%360)::DOUBLE AS lon, ((o_orderkey*17)%179-89)::DOUBLE AS lat, o_totalprice AS value FROM orders",
    "io16_points_json": "SELECT '{\"gidx\":' || o_orderkey || ',\"part\":' || (o_orderkey % 4) || '}' AS json FROM orders",
}
