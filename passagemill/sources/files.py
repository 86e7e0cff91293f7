"""Readers, writers and guards for the formats that the corpus comes in."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON object a line, blank lines skipped, under a fixed schema."""
    return spark.read.schema(schema).json(path).dropna("all")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_nested(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of an array, which is the document itself or in one of its fields."""
    raw = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", f"struct<{field}: array<struct<{schema}>>>")[field]
    outer = F.from_json("value", f"array<struct<{schema}>>")
    listed = F.when(F.ltrim("value").startswith("["), outer).otherwise(inner)
    return raw.select(F.explode(listed).alias("r")).select("r.*")


def files(spark: SparkSession, path: str, pattern: str = "*", without: str | None = None) -> DataFrame:
    """Files below a folder: path, folder, name, size; those whose path has the part `without` are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    rows = found.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size"))
    return rows.filter(~F.array_contains(F.split("path", "/"), without)) if without else rows


def text_or_sidecar(native: DataFrame, sidecars: DataFrame, least: int = 200) -> DataFrame:
    """The text of each file (name, said): its own if long enough, else that of the sidecar of its name in any case, else none.

    A sidecar whose name is the same letter for letter is taken before others.
    """
    side = sidecars.select(F.lower("name").alias("_low"), F.struct("name", "said").alias("s"))
    met = native.withColumn("_low", F.lower("name")).join(side, "_low", "left")
    best = met.groupBy("name").agg(F.first("said").alias("own"), F.min_by("s.said", F.struct(F.col("s.name") != F.col("name"), "s.name")).alias("side"))
    own, other = F.length("own") >= least, F.length("side") >= least
    kind = F.when(own, "native").when(other, "sidecar").otherwise("empty")
    return best.select("name", kind.alias("kind"), F.when(own, F.col("own")).when(other, F.col("side")).otherwise("").alias("said"))


def read_law(spark: SparkSession, path: str, row: str = "Articulo") -> DataFrame:
    """Articles of a law in XML, one element a row, however deep: number, version, repealed, said."""
    schema = "_numero string, _version string, _derogado string, Texto string"
    found = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return found.select(F.col("_numero").alias("number"), F.col("_version").alias("version"), F.coalesce(F.lower("_derogado").isin("si", "sí", "true", "derogado"), F.lit(False)).alias("repealed"), F.trim("Texto").alias("said"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a part in XML: number, head, said, cita (its amendments), reserved."""
    schema = "_N string, HEAD string, P array<string>, CITA string"
    found = spark.read.format("xml").option("rowTag", "DIV8").schema(schema).load(path)
    return found.select(
        F.col("_N").alias("number"), F.trim("HEAD").alias("head"), F.array_join(F.coalesce("P", F.expr("array()")), "\n").alias("said"), F.col("CITA").alias("cita"), F.coalesce(F.contains("HEAD", F.lit("[Reserved]")), F.lit(False)).alias("reserved")
    )


def listing_rows(html: Column) -> Column:
    """Table rows of a page as structs: the table's category (bold text of its head), the cells as text, the first link."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))

    def of(table: Column) -> Column:
        head = T.clean_html(F.regexp_extract(table, r"(?is)<thead.*?<strong>(.*?)</strong>", 1))
        rows = F.filter(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: ~r.rlike("(?i)<th[ >]"))
        made = F.transform(
            rows,
            lambda r: F.struct(
                head.alias("category"),
                F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), T.clean_html).alias("cells"),
                F.regexp_extract(r, r"""(?i)href=["']([^"']*)["']""", 1).alias("link"),
            ),
        )
        return F.filter(made, lambda x: F.size(x["cells"]) >= 5)

    return F.flatten(F.transform(tables, of))


def pipe_rows(markdown: Column) -> Column:
    """Rows of pipe tables: arrays of cells, header rules and rows of fewer than five cells left out."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^\s*\|[\s:|-]+$"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.btrim(x, F.lit("| ")), r"\|"), lambda c: F.trim(c)))
    return F.filter(cells, lambda c: F.size(c) >= 5)


def embedded_json(html: Column, name: str, schema: str) -> Column:
    """The object that a script of the page assigns to a constant."""
    return F.from_json(F.regexp_extract(html, rf"const {re.escape(name)} = (\{{[\s\S]*?\}});", 1), schema)


def guarded(df: DataFrame, least: int, what: str = "rows") -> DataFrame:
    """The rows, if there are enough of them; a broken source must not replace a good table."""
    n = df.count()
    if n < least:
        raise ValueError(f"{n} {what}, {least} expected at least")
    return df


def replace_atomically(df: DataFrame, path: str) -> None:
    """Writes a new version of the table below path and makes it the current one; the one before stays until the next.

    The table is a folder of versions, and a small file beside them, replaced
    by one rename of the file system, names the current one.  So a reader meets
    the old rows or the new ones, and a write or a rename that fails leaves the
    old rows where they were.
    """
    replace_guarded(df, path, {})


def replace_guarded(df: DataFrame, path: str, guards: dict[str, Column]) -> dict[str, object]:
    """replace_atomically, if every guard holds: aggregates of the rows that say whether they may replace the table.

    Guards are observed while the rows are written, so the source runs once.
    The version of rows that fail one is dropped, the table stays what it was,
    and the error names the guards.  Returns what the guards came to.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    seen = Observation(version)
    held = {name: F.coalesce(guard, F.lit(False)).alias(name) for name, guard in guards.items()}
    (df.observe(seen, *held.values()) if held else df).write.parquet(f"{path}/{version}")
    figures = dict(seen.get) if held else {}
    fs, at = _file_system(spark, path)
    failed = [name for name in guards if not figures.get(name)]
    if failed:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}"), True)
        raise ValueError(f"kept the table as it was: {', '.join(failed)}")
    before = current_version(spark, path)
    _set_current(spark, path, version)
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(found.getPath(), True)
    return figures


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows that replace_atomically wrote last."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers of the table meet; none before the first."""
    fs, _ = _file_system(spark, path)
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _set_current(spark: SparkSession, path: str, version: str) -> None:
    """Replaces the pointer file by one rename that overwrites; what fails is raised, and the old pointer stays."""
    jvm = spark.sparkContext._jvm
    hadoop, uri = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path(path).toUri()
    context = hadoop.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration())
    new = hadoop.Path(f"{path}/.{version}")
    fs, _ = _file_system(spark, path)
    out = fs.create(new, True)
    try:
        out.write(version.encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(new, hadoop.Path(f"{path}/current"), options)


def append_log(df: DataFrame, path: str) -> None:
    """Events are added and never rewritten."""
    df.write.mode("append").json(path)
