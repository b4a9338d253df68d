"""Sources: landing folders, text blocks, model answers, NDJSON, project files and ASCII DXF drawings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.classify import ESSENTIAL_TEXT, has_any, layer_type

TEXT_BLOCK = (
    "file string, page int, seq int, type int, text string, source string, layer string, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>"
)
VOTES = "array<struct<id:bigint,zone_type:string,confidence:double,reason:string>>"


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind (pdf, cad, other), size of the files in a landing folder; contents are not read."""
    kind = F.when(F.col("path").rlike(r"(?i)\.pdf$"), "pdf").when(F.col("path").rlike(r"(?i)\.(dxf|dwg)$"), "cad").otherwise("other")
    return spark.read.format("binaryFile").load(folder).select("path", kind.alias("kind"), F.col("length").alias("size"))


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Pre-parsed text blocks (JSON lines): type 0 and not blank."""
    return blank_free(spark.read.schema(TEXT_BLOCK).json(path))


def blank_free(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.coalesce("type", F.lit(0)) == 0) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))


def image_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Image blocks (type 1) of 1 to 90 hundredths of the page and an aspect of at most 15, counted by key."""
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    share = w * h / F.col("page_area")
    ok = (F.col("type") == 1) & (w > 0) & (h > 0) & share.between(0.01, 0.90) & (F.greatest(w, h) <= 15 * F.least(w, h))
    return blocks.groupBy(*keys).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("n_images"))


def parse_answer(text: Column, schema: str = VOTES) -> Column:
    """A model's JSON answer, fences stripped; null where it does not parse; an object counts as a list of one."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    return F.from_json(F.when(F.startswith(body, F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body), schema)


def project(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def essential_texts(texts: DataFrame) -> DataFrame:
    """Drawing texts that say something: by word, or on a layer of a known type."""
    return texts.filter(has_any(F.col("text"), ESSENTIAL_TEXT) | (layer_type(F.col("layer")) != "cad_context"))


# --- ASCII DXF -------------------------------------------------------------------------------------------
DXF = (
    "file string, seq int, kind string, layer string, points array<array<double>>, cx double, cy double, radius double, "
    "a0 double, a1 double, closed boolean, text string, error string"
)
_KINDS = {"LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC", "TEXT", "MTEXT"}


def dxf_entities(text: str) -> Iterator[dict]:
    """Entities of an ASCII drawing's ENTITIES section, from its pairs of code and value lines."""
    lines = text.splitlines()
    if len(lines) % 2:
        lines.pop()
    section, expect_name, cur, poly = None, False, None, None

    def done(e: dict | None) -> Iterator[dict]:
        if e and e["kind"] in _KINDS:
            yield e

    for code, value in zip(lines[::2], lines[1::2], strict=True):
        c, v = int(code), value.strip()
        if c == 0:
            if cur is not None:
                if cur["kind"] == "VERTEX" and poly is not None:
                    poly["points"] += cur["points"]
                elif cur["kind"] == "POLYLINE":
                    poly = cur
                else:
                    yield from done(cur)
            if v == "SEQEND" or (poly is not None and v not in ("VERTEX",)):
                if poly is not None and cur is not poly or v == "SEQEND":
                    yield from done(poly)
                    poly = None
            cur = None
            if v == "SECTION":
                expect_name = True
            elif v == "ENDSEC":
                section = None
            elif section == "ENTITIES":
                cur = {"kind": v, "layer": "0", "points": [], "cx": None, "cy": None, "radius": None, "a0": None, "a1": None, "closed": False, "text": None}
        elif expect_name and c == 2:
            section, expect_name = v, False
        elif cur is not None:
            if c == 8:
                cur["layer"] = v
            elif c in (1, 3):
                cur["text"] = (cur["text"] or "") + v
            elif c in (10, 20) and cur["kind"] == "POLYLINE":
                pass  # its own point only tells the height
            elif c in (10, 11):
                cur["points"].append([float(v), 0.0])
                if c == 10:
                    cur["cx"] = float(v)
            elif c in (20, 21):
                if cur["points"]:
                    cur["points"][-1][1] = float(v)
                if c == 20:
                    cur["cy"] = float(v)
            elif c == 40:
                cur["radius"] = float(v)
            elif c == 50:
                cur["a0"] = float(v)
            elif c == 51:
                cur["a1"] = float(v)
            elif c == 70 and cur["kind"] in ("LWPOLYLINE", "POLYLINE"):
                cur["closed"] = bool(int(v) & 1)
    if poly is not None:
        yield from done(poly)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DxfSource(DataSource):
    """``spark.read.format("kadastra_dxf").load(folder)``: a partition a file of a folder that executors can open.

    For object stores read the files with ``binaryFile`` and apply ``dxf_rows``."""

    @classmethod
    def name(cls) -> str:
        return "kadastra_dxf"

    def schema(self) -> str:
        return DXF

    def reader(self, schema):
        return _DxfReader(self.options["path"])


class _DxfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(f"{path}/*.dxf")) if os.path.isdir(path) else [path]
        return [_File(f) for f in files]

    def read(self, partition):
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield from _rows_of(partition.path, f.read())


def _rows_of(path: str, text: str) -> Iterator[tuple]:
    """Rows of a file; one row with ``error`` if it is damaged."""
    try:
        for i, e in enumerate(list(dxf_entities(text))):
            yield (path, i, e["kind"], e["layer"], e["points"], e["cx"], e["cy"], e["radius"], e["a0"], e["a1"], e["closed"], e["text"], None)
    except (ValueError, IndexError) as x:
        yield (path, 0, *[None] * 10, str(x))


def dxf_rows(files: DataFrame) -> DataFrame:
    """Entities of drawings read with ``binaryFile`` (path, content)."""
    import pandas as pd

    names = [x.split()[0] for x in DXF.split(", ") if " " in x]

    def run(batches):
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) for r in _rows_of(p, bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, DXF)


def cad_geometry(entities: DataFrame) -> DataFrame:
    """Rings and lines of drawing entities: arcs in 16 and circles in 32 parts, type by layer, context layers dropped."""
    from ..functions.geometry import arc, circle

    pts = (
        F.when(F.col("kind") == "CIRCLE", circle(F.col("cx"), F.col("cy"), F.col("radius")))
        .when(F.col("kind") == "ARC", arc(F.col("cx"), F.col("cy"), F.col("radius"), F.col("a0"), F.col("a1")))
        .otherwise(F.col("points"))
    )
    return (
        entities.filter(F.col("kind").isin("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC") & F.col("error").isNull())
        .select("file", "seq", layer_type(F.col("layer")).alias("zone_type"), pts.alias("points"), (F.col("closed") | (F.col("kind") == "CIRCLE")).alias("closed"))
        .filter("zone_type <> 'cad_context'")
    )
