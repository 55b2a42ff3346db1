"""Mesh text in sections, in one file and in many splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from graticula.sources import records


def test_cells_of_many_nodes_keep_them_all(spark, tmp_path):
    nodes = spark.range(130).select(F.col("id").alias("gidx"), F.col("id").cast("double").alias("lon"), F.lit(0.5).alias("lat"))
    cells = spark.createDataFrame([(7, list(range(130)))], "cell long, nodes array<long>")
    records.write_mesh(nodes, cells, f"{tmp_path}/mesh")
    assert records.read_mesh(spark, f"{tmp_path}/mesh")[1].first()["nodes"] == list(range(130))


def test_sections_over_splits(spark, tmp_path):
    lines = ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", "3000"] + [f"{k} {k / 8} {-k / 16} 0" for k in range(3000)] + ["$EndNodes", "$Elements", "1000"]
    lines += [f"{k} 2 2 1 1 {k} {k + 1} {k + 2}" for k in range(1000)] + ["$EndElements", "$NodeData", "1", '"a name of words"', "1", "0.5", "3", "0", "1", "3000"] + [f"{k} {k * 0.25}" for k in range(3000)] + ["$EndNodeData", ""]
    (tmp_path / "one.msh").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        path = str(tmp_path / "one.msh")
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        nodes, cells = records.read_gmsh(spark, path)
        assert sorted(map(tuple, nodes.collect())) == [(k, k / 8, -k / 16, 0.0) for k in range(3000)]
        assert sorted((r.cell, r.type, r.nodes) for r in cells.collect()) == [(k, 2, [k, k + 1, k + 2]) for k in range(1000)]
        assert sorted(map(tuple, records.read_gmsh_field(spark, path).collect())) == [(k, k * 0.25) for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_written_parts_are_one_file(spark, tmp_path):
    nodes = spark.range(200).select(F.col("id").alias("gidx"), (F.col("id") / 4).alias("lon"), F.lit(1.0).alias("lat")).repartition(5)
    cells = spark.range(150).select(F.col("id").alias("cell"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2).alias("nodes")).repartition(3)
    records.write_gmsh(nodes, cells, f"{tmp_path}/parts")
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 1
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text[:5] == ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", "200"] and text[5].split()[0] == "0" and text[-1] == "$EndElements"
    at = text.index("$Elements")
    assert text[at - 1] == "$EndNodes" and text[at + 1] == "150" and [int(t.split()[0]) for t in text[at + 2 : -1]] == list(range(150))
    (tmp_path / "whole.msh").write_text("\n".join(text))
    for path in ("parts", "whole.msh"):
        assert sum(df.count() for df in records.read_gmsh(spark, f"{tmp_path}/{path}")) == 350
    records.write_gmsh_field(nodes.select("gidx", F.col("lon").alias("value")), f"{tmp_path}/field", "a b")
    assert {(r.gidx, r.value) for r in records.read_gmsh_field(spark, f"{tmp_path}/field").collect()} == {(k, k / 4) for k in range(200)}
    assert records.read_gmsh(spark, f"{tmp_path}/field")[0].count() == 0
