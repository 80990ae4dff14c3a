"""Text members of archives: landed ZIP files as rows of lines."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "path string, member string, line_no long, line string, error string"
LINES_A_BATCH = 50_000


def archive_lines(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path, member, line_no, line and error of every member whose name ends in ``suffix``, in any case, of the ZIP files in a folder.

    Archives are spread over tasks, members are read line by line. An archive that can't be read, or that has
    no such member, gives one row with an error and no line; bytes that are no UTF-8 are replaced.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def lines(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield from _members(path, content, suffix.lower())

    return files.repartition("path").mapInPandas(lines, MEMBERS)


def _members(path: str, content: bytes, suffix: str):
    def rows(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in MEMBERS.split(", ")])

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = [n for n in archive.namelist() if n.lower().endswith(suffix)]
            if not names:
                yield rows([(path, None, None, None, f"no member ends in {suffix}")])
            for name in names:
                held = []
                with archive.open(name) as member:
                    for k, line in enumerate(io.TextIOWrapper(member, "utf-8", "replace"), 1):
                        held.append((path, name, k, line.rstrip("\r\n"), None))
                        if len(held) >= LINES_A_BATCH:
                            yield rows(held)
                            held = []
                yield rows(held)
    except (zipfile.BadZipFile, OSError, RuntimeError) as fault:
        yield rows([(path, None, None, None, str(fault))])


def with_file_ids(lines: DataFrame) -> DataFrame:
    """The lines in the form of landed text files: file_id (a hash of archive and member), line_no and line."""
    return lines.filter("error is null").select(F.xxhash64("path", "member").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), "line")
