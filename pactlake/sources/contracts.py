"""Contract JSON as a Spark data source, and the words of a text as a table function.

    register(spark)
    spark.read.format("contracts").load(folder).filter("path like '%/2024/%'")
    spark.sql("SELECT d.doc_id, w.* FROM documents d, LATERAL text_words(d.text) w")
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pactlake.sources.files import CONTRACT

SCHEMA = f"path string, doc_ord bigint, bytes bigint, error string, {CONTRACT}"
#: Bytes and files of a partition; a file counts as a few kilobytes at least, for opening it.
PART_BYTES, OPEN_BYTES = 32 << 20, 64 << 10

#: What a filter on the path alone asks; the others are left to Spark.
_TESTS = {
    EqualTo: lambda path, value: path == value, In: lambda path, value: path in value, StringStartsWith: lambda path, value: path.startswith(value),
    StringEndsWith: lambda path, value: path.endswith(value), StringContains: lambda path, value: value in path,
}


@dataclass
class Files(InputPartition):
    """Files of a partition: place in the order of all, path and bytes."""

    files: list[tuple[int, str, int]]


def _shaped(raw: Any) -> dict[str, Any]:
    """A contract with its findings as pairs; ValueError if it isn't an object."""
    if not isinstance(raw, dict):
        raise ValueError("not a JSON object")
    found = raw.get("cuad_findings")
    return raw | {"cuad_findings": list(found.items()) if isinstance(found, dict) else found}


class ContractReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options, self.tests = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the path leave files out before any is opened."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def _listed(self) -> list[tuple[int, str, int]]:
        store, at = fs.FileSystem.from_uri(self.options["path"])
        root = store.get_file_info(at)
        if root.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        glob = self.options.get("pathglobfilter", "*.json")
        found = [root] if root.is_file else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and fnmatch(x.base_name, glob)]
        return [(k, x.path, x.size) for k, x in enumerate(sorted(found, key=lambda x: (x.base_name, x.path)))]

    def partitions(self) -> list[Files]:
        most = int(self.options.get("partbytes", PART_BYTES))
        parts, held = [Files([])], 0
        for k, path, size in self._listed():
            if not all(_TESTS[type(f)](path, getattr(f, "value", None)) for f in self.tests):
                continue
            if parts[-1].files and held + max(size, OPEN_BYTES) > most:
                parts.append(Files([]))
                held = 0
            parts[-1].files.append((k, path, size))
            held += max(size, OPEN_BYTES)
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A batch for each file: a bad one is a row with an error and stops nothing."""
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        schema = to_arrow_schema(self.schema)
        for k, path, size in partition.files:
            known = {"path": path, "doc_ord": k, "bytes": size}
            try:
                with store.open_input_stream(path) as f:
                    raw = _shaped(json.loads(f.read().decode("utf-8-sig")))
                batch = pa.RecordBatch.from_pylist([raw | known | {"error": None}], schema)
            except (ValueError, TypeError, OSError, pa.ArrowException, RecursionError) as wrong:
                batch = pa.RecordBatch.from_pylist([known | {"error": f"{type(wrong).__name__}: {wrong}"[:2000]}], schema)
            yield batch


class ContractSource(DataSource):
    """A row for each file under a path: path, doc_ord (by file name, then path), bytes, error and what the contract says.

    Options: pathGlobFilter (*.json) and partBytes (32 MB a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "contracts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ContractReader:
        return ContractReader(schema, {k.lower(): v for k, v in self.options.items()} | {"path": self.options["path"]})


@F.udtf(returnType="word_ord int, line int, text string, char_start int, char_end int", useArrow=True)
class TextWords:
    """The words of a text, what stands between blanks, with their lines and places in code points; none of a null."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str, int, int]]:
        line, seen = 1, 0
        for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text or "")):
            line += text.count("\n", seen, m.start())
            seen = m.start()
            yield k, line, m.group(), m.start(), m.end()


def register(spark: SparkSession) -> None:
    """The format `contracts` and the table function `text_words` in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContractSource)
    spark.udtf.register("text_words", TextWords)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the format `contracts`; a path without a scheme is a local one."""
    register(spark)
    return spark.read.format("contracts").load(path if "://" in path or path.startswith("file:") else f"file://{path}")
