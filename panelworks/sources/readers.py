"""Scans and sinks: stage artifacts, partitioned files, delimited text with oddities, nested JSON, sheet cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def artifact(spark: SparkSession, root: str, stage: str, optional: bool = False) -> DataFrame | None:
    """One named stage output. A missing one raises and names the stage; an optional one is None. Works on any store Spark reads."""
    try:
        return spark.read.parquet(f"{root}/{stage}.parquet")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if optional:
            return None
        raise FileNotFoundError(f"run the stage '{stage}' first: nothing under {root}") from None


def yearly_union(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern, columns merged, fully identical rows once."""
    return spark.read.option("mergeSchema", "true").parquet(pattern).dropDuplicates()


def named_files(spark: SparkSession, base: str, pattern: str, regex: str, names: list[str], schema: str, years: list[int] | None = None) -> DataFrame:
    """CSV files under ``base`` with columns out of their names by the regex's groups. ``pattern`` is a glob with ``{year}`` in it;
    with ``years`` only the files of those are listed and read."""
    globs = [pattern.replace("{year}", "*" if y is None else str(y)) for y in (years or [None])]
    return with_file_parts(spark.read.schema(schema).csv([f"{base}/{g}" for g in globs], header=True), regex, names)


def with_file_parts(df: DataFrame, regex: str, names: list[str]) -> DataFrame:
    """Columns out of the file name by the regex's groups."""
    return df.withColumns({n: F.regexp_extract(F.col("_metadata.file_path"), regex, i + 1) for i, n in enumerate(names)})


def split_by_year(spark: SparkSession, csv: str, out: str, schema: str, keep: Column, year: str, files: int = 16) -> DataFrame:
    """Filters a large CSV and writes a partition for each year: one scan, and the rows of a year dealt to ``files`` tasks."""
    rows = spark.read.csv(csv, schema=schema, header=True, nullValue="").where(keep)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("_salt")
    rows.repartition(F.col(year), salt).write.partitionBy(year).parquet(out)
    return spark.read.parquet(out)


def commented(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Delimited text after a block of # lines; every column a string."""
    return spark.read.csv(path, sep=sep, header=True, comment="#", inferSchema=False)


def comment_value(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(value) read out of the comment lines."""
    return spark.read.text(path).where("value LIKE '#%'").select(F.regexp_extract("value", pattern, 1).alias("value")).where("value <> ''")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated strings; names trimmed, unnamed and empty columns left out."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns if c.strip() and not c.startswith("_c")])


def _banner_rows(marker: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                lines = [x.split(";") for x in content.decode("utf-8-sig").splitlines()]
                at = next((i for i, cells in enumerate(lines) if marker in cells), None)
                if at is None:
                    continue
                above = lines[at - 1] if at and len(lines[at - 1]) == len(lines[at]) else [""] * len(lines[at])
                last, names = "", []
                for group, field in zip(above, lines[at], strict=True):
                    last = group.strip() or last
                    names.append(f"{last} - {field.strip()}" if last and field.strip() != marker else field.strip())
                out += [(path, i, n, v) for i, cells in enumerate(lines[at + 1:]) for n, v in zip(names, cells)]
            yield pd.DataFrame(out, columns=["file", "row", "name", "value"])

    return read


def banner_csv(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """(file, row, name, value) of files whose header, one or two rows deep, stands under a banner. Files are read side by side."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_banner_rows(marker), "file string, row long, name string, value string")


def sheet_rows(cells: DataFrame, labels: dict[str, str], marker: str, top: int = 16) -> DataFrame:
    """(file, sheet, row, <canonical names>): the header is the first of ``top`` rows with the marker; labels map to names."""
    from functools import reduce

    low = F.lower(F.trim("value"))
    head = cells.where((low == marker) & (F.col("row") < top)).groupBy("file", "sheet").agg(F.min("row").alias("_h"))
    with_head = cells.join(head, ["file", "sheet"])
    name = reduce(lambda w, kv: w.when(low == kv[0], kv[1]), list(labels.items())[1:], F.when(low == list(labels)[0], list(labels.values())[0]))
    names = with_head.where("row = _h").withColumn("_name", name).where("_name is not null").groupBy("file", "sheet", "_name").agg(F.min("col").alias("col"))
    body = with_head.where("row > _h").join(names, ["file", "sheet", "col"])
    return body.groupBy("file", "sheet", "row").pivot("_name", sorted(set(labels.values()))).agg(F.first("value"))


def cube_rows(cubes: DataFrame, dims: list[tuple[str, list[str]]], values: str = "value", status: str = "status") -> DataFrame:
    """Row-major cube to long rows, the last dimension fastest; missing values are null, status is keyed by position."""
    total = 1
    for _, codes in dims:
        total *= len(codes)
    at, stride, out = F.col("_i"), total, []
    for name, codes in dims:
        stride //= len(codes)
        out.append(F.element_at(F.array(*[F.lit(c) for c in codes]), (F.floor(at / stride) % len(codes) + 1).cast("int")).alias(f"{name}_code"))
    rows = cubes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    return rows.select(*[c for c in cubes.columns if c not in (values, status)], *out, F.get(values, at).alias("value"), F.try_element_at(status, at.cast("string")).alias("status"))


def features(pages: DataFrame, array: str, key: str) -> DataFrame:
    """Union of paged feature arrays, one row for each key, the smallest page first."""
    f = pages.select("page", F.explode(array).alias("f")).withColumn("_k", F.col(f"f.{key}"))
    return f.groupBy("_k").agg(F.min_by("f", "page").alias("f")).select("f.*")


def torn_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``_bad`` set where a line can't be read."""
    return spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)


def sink_with_report(df: DataFrame, path: str, measures: dict[str, Column]) -> DataFrame:
    """Writes the table and, beside it, a one-row JSON report; returns the report."""
    df.write.mode("overwrite").parquet(path)
    report = df.sparkSession.read.parquet(path).agg(*[c.alias(n) for n, c in measures.items()])
    report.coalesce(1).write.mode("overwrite").json(f"{path}.report")
    return df.sparkSession.read.schema(report.schema).json(f"{path}.report")
