"""Darwin Core archives: a core file and extensions described by meta.xml, read and written by Spark's readers and writers."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions.names import blank_to_null
from namewright.sources.delimited import read_delimited

#: The columns that a table of taxa needs; the order in which kinds of sources load; the description's namespace.
REQUIRED = ["taxonID", "nomenclaturalCode", "acceptedNameUsageID", "parentNameUsageID", "scientificName", "scientificNameAuthorship", "taxonRank", "taxonomicStatus", "datasetID"]
LOAD_ORDER = ["Location", "Taxon", "VernacularName", "Distribution"]
TEXT = "{http://rs.tdwg.org/dwc/text/}"


@dataclass(frozen=True)
class Part:
    """One file of an archive: kind, locations, separators, header lines, place of the id, columns by place and constant columns."""

    kind: str
    locations: list[str]
    sep: str
    quote: str
    skip: int
    id_at: int | None
    columns: dict[int, str]
    constants: dict[str, str]


def short(term: str) -> str:
    return term.rstrip("/").rsplit("/", 1)[-1].rsplit("#", 1)[-1]


def describe(text: str) -> list[Part]:
    """The parts of a meta.xml, the core first."""
    out = []
    for node in ET.fromstring(text):
        if node.tag not in (f"{TEXT}core", f"{TEXT}extension"):
            continue
        own = node.find(f"{TEXT}id") if node.tag == f"{TEXT}core" else node.find(f"{TEXT}coreid")
        fields = node.findall(f"{TEXT}field")
        out.append(Part(
            short(node.get("rowType", "")), [x.text.strip() for x in node.iter(f"{TEXT}location")], node.get("fieldsTerminatedBy", ",").replace("\\t", "\t"), node.get("fieldsEnclosedBy", '"'),
            int(node.get("ignoreHeaderLines", "0")), int(own.get("index")) if own is not None else None,
            {int(f.get("index")): short(f.get("term")) for f in fields if f.get("index") is not None}, {short(f.get("term")): f.get("default") for f in fields if f.get("index") is None},
        ))
    return out


def read_part(spark: SparkSession, folder: str, part: Part) -> DataFrame:
    """All columns as trimmed text, blank as null, and core_id, the record of the core that a row belongs to. Files have one header line or none."""
    width = max([*part.columns, part.id_at or 0]) + 1
    schema = ", ".join(f"_{i} string" for i in range(width))
    df = spark.read.csv([f"{folder}/{x}" for x in part.locations], schema=schema, sep=part.sep, quote=part.quote or "\0", escape=part.quote or "\0", header=part.skip > 0, enforceSchema=True, multiLine=bool(part.quote))
    cell = lambda i: blank_to_null(F.col(f"_{i}"))
    core = [cell(part.id_at).alias("core_id")] if part.id_at is not None else []
    return df.select(*core, *[cell(i).alias(t) for i, t in sorted(part.columns.items())], *[F.lit(v).alias(t) for t, v in part.constants.items()])


def read_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Kind of rows to table, the core first, the rest in load order."""
    text = spark.read.text(f"{folder}/meta.xml", wholetext=True).first()[0]
    core, *rest = describe(text)
    place = lambda p: LOAD_ORDER.index(p.kind) if p.kind in LOAD_ORDER else len(LOAD_ORDER)
    return {p.kind: read_part(spark, folder, p) for p in [core, *sorted(rest, key=place)]}


def with_extension(core: DataFrame, extension: DataFrame, name: str, key: str = "core_id") -> DataFrame:
    """core with an array column of its extension rows. Rows of one record are few by design of the format; do not use it on a table without such a bound."""
    rest = [c for c in extension.columns if c != "core_id"]
    rows = extension.groupBy(F.col("core_id").alias("__of")).agg(F.collect_list(F.struct(*rest)).alias(name))
    return core.join(rows, core[key] == rows["__of"], "left").drop("__of")


def find_sources(root: str) -> list[str]:
    """Folders with a meta.xml and CSV files outside those, below a local folder, in order."""
    out = []
    for at, folders, files in os.walk(root):
        folders.sort()
        if "meta.xml" in files:
            out.append(at)
            folders.clear()
        else:
            out += [os.path.join(at, f) for f in sorted(files) if f.endswith(".csv")]
    return out


def open_source(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED) -> dict[str, DataFrame]:
    """A CSV file of taxa or an archive; ValueError names required columns that its taxa lack."""
    if path.endswith(".csv"):
        return {"Taxon": read_delimited(spark, path, required=required)}
    tables = read_archive(spark, path)
    missing = [c for c in required if "Taxon" in tables and c not in tables["Taxon"].columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return tables


def all_taxa(sources: Sequence[DataFrame]) -> DataFrame:
    """The rows of all sources, absent columns null."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def ordered_columns(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    """Required columns in their order, then the others by name."""
    return [c for c in required if c in columns] + sorted(c for c in columns if c not in required)


def write_archive(folder: str, core: DataFrame, extensions: dict[str, DataFrame], kind: str = "Taxon", key: str = "taxonID", order: str = "scientificName") -> None:
    """Tab-separated tables and a meta.xml that lists their files. The core is in order of a column; every table has the key column first."""
    spark = core.sparkSession
    root = ET.Element("archive", xmlns=TEXT[1:-1])
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for n, (name, df) in enumerate({kind: core.orderBy(order, key), **extensions}.items()):
        cols = [key, *[c for c in ordered_columns(df.columns, REQUIRED) if c != key]]
        df.select([F.col(c).cast("string") for c in cols]).write.csv(f"{folder}/{name.lower()}", sep="\t", header=False, emptyValue="", nullValue="")
        node = ET.SubElement(root, "core" if n == 0 else "extension", rowType=f"http://rs.tdwg.org/dwc/terms/{name}", encoding="UTF-8", fieldsTerminatedBy="\\t", fieldsEnclosedBy='"', ignoreHeaderLines="0")
        files = ET.SubElement(node, "files")
        for found in fs.listStatus(path(f"{folder}/{name.lower()}")):
            if found.getPath().getName().startswith("part-"):
                ET.SubElement(files, "location").text = f"{name.lower()}/{found.getPath().getName()}"
        ET.SubElement(node, "id" if n == 0 else "coreid", index="0")
        for i, c in enumerate(cols):
            ET.SubElement(node, "field", index=str(i), term=f"http://rs.tdwg.org/dwc/terms/{c}")
    out = fs.create(path(f"{folder}/meta.xml"), True)
    out.write(bytearray(ET.tostring(root, encoding="UTF-8", xml_declaration=True)))
    out.close()
