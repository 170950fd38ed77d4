"""Raw files of one layout that do not share a header (SRC1, SRC2).

A CSV scan binds columns by place, so files whose headers differ (another order,
more or fewer extra columns) can't be one scan. Here the first line of every file
is read, files are grouped by it, each group is one scan with its own schema, and
the groups are put together by name. What the layout doesn't map is NULL where a
file lacks it; a file that lacks a mapped column is an error that names the file.

Reading a first line opens the file and takes one block; lines come to the driver,
as the list of files does, and rows never do.
"""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyroll.operators.standardise import MissingColumnError, _resolve
from skyroll.schemas import SourceSpec

REJECTED = "_rejected_line"      # the text of a line that doesn't fit its header
FILE = "_file"
OPENED_AT_ONCE = 16


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> list[str]:
    """The files under ``path`` (a folder, a glob or a list of them), at any depth."""
    return sorted(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
                  .text(path).inputFiles())


def _first_line(spark: SparkSession, file: str) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        opened = stream if codec is None else codec.createInputStream(stream)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8")).readLine()
        return line or ""
    finally:
        stream.close()


def headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files that have it. Files without any line have no header and
    no rows, and are left out."""
    with ThreadPoolExecutor(max_workers=OPENED_AT_ONCE) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        names = next(csv.reader(io.StringIO(line.removeprefix("﻿"))), [])
        if names:
            found.setdefault(tuple(names), []).append(file)
    return found


def _unique(names: tuple[str, ...]) -> list[str]:
    """Column names of a header, later ones of equal names (in any case) numbered."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        low = name.lower()
        seen[low] = seen.get(low, 0) + 1
        out.append(name if seen[low] == 1 else f"{name}__{seen[low]}")
    return out


def _scan(spark: SparkSession, names: list[str], files: list[str], rejects: bool) -> DataFrame:
    fields = [*names, REJECTED] if rejects else names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    reader = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE")
    if rejects:
        # the number of a line's fields is only seen when none is skipped
        reader = (reader.option("columnNameOfCorruptRecord", REJECTED)
                  .option("columnPruning", "false"))
    return reader.csv(files)


def read_raw_groups(spark: SparkSession, path: str | list[str], spec: SourceSpec,
                    rejects: bool = False) -> DataFrame:
    """Raw rows of all files under ``path``, whatever order and extras their headers
    have: the mapped columns under the layout's names, then the extras.

    With ``rejects``, ``REJECTED`` holds the whole line where it has fewer or more
    fields than its file's header (NULL for good lines), and ``FILE`` its file."""
    groups = headers(spark, list_files(spark, path))
    lacking: dict[str, list[str]] = {}
    frames = []
    for header, files in groups.items():
        names, places = _unique(header), {}
        for wanted in spec.source_columns:
            try:
                # a repeated name counts as its first, exact case before any case
                places[wanted] = _resolve(list(header), wanted)
            except MissingColumnError:
                lacking.setdefault(wanted, []).extend(files)
        if lacking:
            continue
        taken = set(places.values())
        columns = [F.col(f"`{names[i]}`").alias(wanted) for wanted, i in places.items()]
        columns += [F.col(f"`{n}`") for i, n in enumerate(names) if i not in taken]
        if rejects:
            columns += [F.col(REJECTED), F.col("_metadata.file_path").alias(FILE)]
        frames.append(_scan(spark, names, files, rejects).select(*columns))
    if lacking:
        told = "; ".join(f"{c!r} is not in {', '.join(sorted(files))}" for c, files in lacking.items())
        raise MissingColumnError(f"mapped source columns without a place: {told}")
    if not frames:
        names = spec.source_columns + ([REJECTED, FILE] if rejects else [])
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType())
                                                       for n in names]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
