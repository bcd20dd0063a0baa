"""File sources: CSV of arbitration providers, workbooks, taxonomies, JSON drop folders."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidra.functions.dates import filing_date
from evidra.functions.text import first_match, trim_all

#: What columns of provider files are called, in the order in which they are looked for.
RESPONDENT = ["nonconsumer", "non-consumer", "respondent", "company"]
CASE_ID = ["case id", "case number", "case no", "reference no"]
FILED = ["filing date", "date filed", "file date"]


def find_column(header: list[str], wanted: list[str]) -> str | None:
    """The first column whose lower-case name holds a wanted text, wanted texts taken in order."""
    for w in wanted:
        for h in header:
            if w in h.lower():
                return h
    return None


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A provider's CSV: quoted cells, doubled quotes, line breaks in cells; all columns text."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def sniff(files: DataFrame) -> DataFrame:
    """``files`` of the binaryFile source with whether each is a zip (workbook) by its first two bytes."""
    return files.select("path", "length", (F.substring("content", 1, 2) == F.lit(b"PK")).alias("is_workbook"))


def arbitration_rows(table: DataFrame, provider: str, file_name: str, respondents: list[tuple[str, list[str]]]) -> DataFrame:
    """Provider rows of known respondents as records: (dedupe_key, record_date, excerpt, carrier); no respondent column gives no rows."""
    header = table.columns
    who, case, filed = (find_column(header, w) for w in (RESPONDENT, CASE_ID, FILED))
    empty = F.lit("")
    if who is None:
        return table.limit(0).select(F.lit("").alias("dedupe_key"), F.lit(0).cast("bigint").alias("record_date"), empty.alias("excerpt"), empty.alias("carrier"))
    company = trim_all(F.coalesce(F.col(f"`{who}`"), empty))
    carrier = first_match(company, respondents)
    ident = trim_all(F.coalesce(F.col(f"`{case}`"), empty)) if case else empty
    body = F.concat_ws("; ", *(F.concat(F.lit(f"{h.lower()}="), F.coalesce(F.col(f"`{h}`"), empty)) for h in header))
    line = F.concat_ws(":", F.lit(f"arb:{provider}"), F.lit(file_name), F.substring(F.sha2(body, 256), 1, 16))
    df = table.select(F.when(ident != "", F.concat(F.lit(f"arb:{provider}:"), ident)).otherwise(line).alias("dedupe_key"), (filing_date(F.col(f"`{filed}`")) if filed else F.lit(None).cast("bigint")).alias("record_date"), F.substring(F.concat(company, F.lit(" | "), body), 1, 500).alias("excerpt"), carrier.alias("carrier"), company.alias("__c"))
    return df.where("__c <> '' and carrier is not null").drop("__c")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _cells(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet of a workbook, cells as text, gaps as empty texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{_NS['m']}}}row"):
            out: list[str] = []
            for c in row.findall("m:c", _NS):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(ref.group()))) - 1 if ref else len(out)
                v, kind = c.find("m:v", _NS), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                out += [""] * (at - len(out))
                out.append(shared[int(text)] if kind == "s" and text else text)
            yield out


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: the first sheet of .xlsx files, a row each as (path, row, cells). A file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, row int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _WorkbookReader(self.options)


class _WorkbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob

        path = self.options["path"].removeprefix("file://")
        return [InputPartition(p) for p in sorted(glob.glob(path if "*" in path or path.endswith(".xlsx") else f"{path}/*.xlsx"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for i, cells in enumerate(_cells(f.read())):
                yield partition.value, i, cells


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, row, cells) of ``files``(path, content) of the binaryFile source, so of any storage that Spark reads; a file that is no workbook gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                if bytes(content[:2]) == b"PK":
                    cells = list(_cells(bytes(content)))
                    yield pd.DataFrame({"path": path, "row": range(len(cells)), "cells": cells})

    return files.select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def workbook_table(rows: DataFrame, header: list[str]) -> DataFrame:
    """Rows of one workbook as a table with the names of its first row, which the caller has read."""
    return rows.where("row > 0").select("path", "row", *(F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)))


def json_lines(texts: DataFrame, text: str, schema: str) -> DataFrame:
    """Lines that are JSON objects, by ``schema``; others are skipped."""
    parsed = F.from_json(F.col(text), schema)
    return texts.where(F.col(text).rlike(r"^\s*\{") & F.try_parse_json(F.col(text)).isNotNull()).select(parsed.alias("x")).select("x.*")


def latest_payloads(jobs: DataFrame, newest: int = 20) -> DataFrame:
    """(provider, payload) of the newest job of each provider among the ``newest`` parse jobs; malformed payloads are skipped."""
    recent = jobs.where("type = 'parse_file'").orderBy(F.desc("id")).limit(newest)
    good = recent.where(F.try_parse_json("payload").isNotNull()).withColumn("provider", F.get_json_object("payload", "$.provider")).where("provider is not null")
    return good.groupBy("provider").agg(F.max_by("payload", "id").alias("payload"))


def respondent_filter(column: Column, respondents: list[tuple[str, list[str]]]) -> Column:
    return first_match(column, respondents).isNotNull()
