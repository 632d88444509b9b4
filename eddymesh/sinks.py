"""Results to files: tab-separated text with a description, and XDMF descriptions of cutouts stored as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv_lines(result: DataFrame, columns: list[str]) -> DataFrame:
    """pid, time and text: a line for each row of result(time, pid, x, y, z, <columns>)."""
    cell = lambda c: F.format_string("%.6f", F.col(c))
    return result.select("pid", "time", F.concat_ws("\t", F.col("time").cast("string"), cell("x"), cell("y"), cell("z"), *[cell(c) for c in columns]).alias("text"))


def write_tsv(result: DataFrame, columns: list[str], about: str, path: str) -> None:
    """Lines ordered by time and point over all part files; the first two lines in a file of their own, which sorts
    before the others' names in `path`/header."""
    spark = result.sparkSession
    head = "\t".join(["time", "x_point", "y_point", "z_point", *columns])
    spark.createDataFrame([(about,), (head,)], "text string").coalesce(1).write.text(f"{path}/header")
    lines = tsv_lines(result, columns).repartitionByRange("time", "pid").sortWithinPartitions("time", "pid")
    lines.select("text").write.text(f"{path}/rows")


def xdmf(title: str, variable: str, components: int, counts: tuple[int, int, int], path: str) -> str:
    """XDMF text of a cutout: its strided lengths along x, y, z, and the coordinates and values it refers to."""
    nx, ny, nz = counts
    kind = "Vector" if components == 3 else "Scalar"
    axes = "".join(f'      <DataItem Dimensions="{n}" Format="HDF">{path}:/{a}coor</DataItem>\n' for a, n in (("x", nx), ("y", ny), ("z", nz)))
    return (
        f'<?xml version="1.0"?>\n<Xdmf Version="2.0">\n  <Domain>\n    <Grid Name="{title}" GridType="Uniform">\n'
        f'    <Topology TopologyType="3DRectMesh" NumberOfElements="{nz} {ny} {nx}"/>\n    <Geometry GeometryType="VXVYVZ">\n{axes}    </Geometry>\n'
        f'    <Attribute Name="{variable}" AttributeType="{kind}" Center="Node">\n      <DataItem Dimensions="{nz} {ny} {nx} {components}" Format="HDF">{path}:/{variable}</DataItem>\n'
        "    </Attribute>\n    </Grid>\n  </Domain>\n</Xdmf>\n"
    )
