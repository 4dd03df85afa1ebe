"""One text file from a distributed table: tasks write their lines beside the target, the commit joins them in order.

The parts of a sorted table follow each other by partition, so the file is sorted; the header stands before them.  With
``gzip`` every part is a member of its own, which readers take for one stream.  The commit copies bytes in bounded
pieces; a failed or repeated task leaves a file that no commit names.
"""

from __future__ import annotations

import gzip
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources import bgzf


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str


class _LineWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.header, self.gzip = options.get("header", ""), options.get("gzip", "false").lower() == "true"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _packed(self, text: str) -> bytes:
        data = text.encode()
        return gzip.compress(data, mtime=0) if self.gzip else data

    def write(self, iterator):
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}"
        with bgzf.open_output(f"{self.folder}/{name}") as out:
            for batch in iterator:
                if batch.num_rows:
                    out.write(self._packed("".join(f"{line}\n" for line in batch.column(0).to_pylist() if line is not None)))
        return _Part(number, name)

    def commit(self, messages):
        with bgzf.open_output(self.path) as out:
            if self.header:
                out.write(self._packed(self.header))
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                bgzf.append_file(out, f"{self.folder}/{part.name}")
        bgzf.remove_folder(self.folder)

    def abort(self, messages):
        bgzf.remove_folder(self.folder)


class OneFileSink(DataSource):
    """``df.write.format("onefile").option("header", ...).save(path)`` of a single text column."""

    @classmethod
    def name(cls):
        return "onefile"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        if len(schema.fields) != 1 or schema.fields[0].dataType.typeName() != "string":
            raise ValueError("one text column is written")
        return _LineWriter(self.options)


def tab_line(df: DataFrame, missing: str = ".") -> Column:
    """All columns of a row, separated by tabs."""
    return F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in df.columns])


def write_lines(lines: DataFrame, path: str, header: list[str] = (), gzip_parts: bool = False) -> None:
    """Write a text column as one file; lines come in the order of ``lines``."""
    lines.sparkSession.dataSource.register(OneFileSink)
    text = "".join(f"{line}\n" for line in header)
    lines.write.format("onefile").mode("overwrite").option("header", text).option("gzip", str(gzip_parts).lower()).save(path)
