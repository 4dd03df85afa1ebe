"""BAM files as a Spark data source: indexed region scans, optional tags, read groups, and a writer with an index.

Reading.  A file is cut at record starts that its BAI index names, and read by many tasks.  ``regions`` ("c1:100-200;c2")
reads only the stretches that can hold overlapping records, those that begin before a region included, and returns
exactly the overlapping ones.  Filters on ``chrom`` and ``pos`` are pushed the same way.  Only the asked columns are
decoded, as Arrow arrays over runs of records.

Writing.  Tasks write blocks and an index of their sorted part beside the target; the commit puts the parts behind one
header, in order, and joins the indexes.  A failed or repeated task leaves a file that no commit names.  With
``single=false`` every part stays a whole BAM file with its own index, and nothing is copied.

Defined cases: a region past a contig's end, of an unknown contig, or of a file without records gives no rows; without
an index a file is read by one task, and regions are then a filter; unmapped reads placed at their mate count as one
base long; a header without read groups gives NULL libraries.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

from ..constants import NIBBLE_LETTERS as BASE_LETTERS
from . import bgzf
from .bai import Index, bin_of

ALN_SCHEMA = (
    "qname string, flag int, chrom string, pos long, mapq int, cigar string, mchrom string, mpos long, "
    "isize int, seq string, qwidth int, strand string"
)
MORE_SCHEMA = "end long, qual string, tags map<string,string>, rg string, library string"
FULL_SCHEMA = f"{ALN_SCHEMA}, {MORE_SCHEMA}"
# fixed tables of the format
CIGAR_LETTERS = "MIDNSHP=X"
REFERENCE_OPS = (0, 2, 3, 7, 8)
HEAD = np.dtype([
    ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"),
    ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("isize", "<i4"),
])
TAG_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
FAR = 1 << 29


# ---------------------------------------------------------------- header


@dataclass
class Header:
    text: str
    contigs: list[tuple[str, int]]
    first: int = 0  # virtual offset of the first record

    def groups(self) -> dict[str, dict[str, str]]:
        """Fields of the read groups by their ID."""
        rows = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in self.text.splitlines() if line.startswith("@RG")]
        return {r["ID"]: r for r in rows if "ID" in r}

    def pack(self) -> bytes:
        text = self.text.encode()
        parts = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(self.contigs))]
        for name, length in self.contigs:
            parts.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
        return b"".join(parts)


def bam_header(path: str) -> Header:
    """Text, contigs and the virtual offset of the first record."""
    with bgzf.open_input(path) as handle:
        data, starts = b"", []
        for place, block in bgzf.blocks(handle):
            starts.append((len(data), place, len(block)))
            data += block
            if data[:4] != b"BAM\1":
                break
            try:
                size = struct.unpack_from("<i", data, 4)[0]
                at = 8 + size
                contigs, count = [], struct.unpack_from("<i", data, at)[0]
                at += 4
                for _ in range(count):
                    length = struct.unpack_from("<i", data, at)[0]
                    contigs.append((data[at + 4 : at + 3 + length].decode(), struct.unpack_from("<i", data, at + 4 + length)[0]))
                    at += 8 + length
                if at > len(data):
                    continue
            except struct.error:
                continue
            base, block_place, block_size = max(s for s in starts if s[0] <= at)
            if at - base == block_size:  # the records begin with the next block
                return Header(data[8 : 8 + size].rstrip(b"\0").decode(), contigs, handle.tell() << 16)
            return Header(data[8 : 8 + size].rstrip(b"\0").decode(), contigs, block_place << 16 | at - base)
    raise ValueError(f"{path} has no complete BAM header")


def read_index(path: str) -> Index | None:
    for name in (f"{path}.bai", re.sub(r"\.bam$", ".bai", path)):
        if name != path and bgzf.exists(name):
            with bgzf.open_input(name) as handle:
                return Index.parse(handle.read())
    return None


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, length, mapped, unmapped`` in header order (``place``); the counts come from the index, no read is decoded."""
    header, index = bam_header(path), read_index(path)
    rows = [
        (i, name, length, *((index.contigs[i].mapped, index.contigs[i].unmapped) if index else (None, None)))
        for i, (name, length) in enumerate(header.contigs)
    ]
    return spark.createDataFrame(rows, "place int, chrom string, length long, mapped long, unmapped long")


def bam_read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``rg, library, sample`` of the header's read groups."""
    rows = [(k, g.get("LB"), g.get("SM")) for k, g in bam_header(path).groups().items()]
    return spark.createDataFrame(rows, "rg string, library string, sample string")


def parse_region(text: str) -> tuple[str, int, int]:
    """``chrom``, ``chrom:start`` or ``chrom:start-end`` (1-based, both ends in, commas allowed) as 0-based start and end."""
    found = re.fullmatch(r"(.+?)(?::([0-9,]+)(?:-([0-9,]+))?)?", text.strip())
    if not found:
        raise ValueError(f"not a region: {text!r}")
    number = lambda g, default: int(g.replace(",", "")) if g else default
    start, end = number(found[2], 1) - 1, number(found[3], FAR)
    if start < 0 or end <= start:
        raise ValueError(f"not a region: {text!r}")
    return found[1], start, end


# ---------------------------------------------------------------- decoding


def _gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many stretches behind each other, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    index = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)
    return raw[index], bounds


def _text(data: np.ndarray, bounds: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    plain = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
    return plain if missing is None else pa.compute.if_else(pa.array(missing), pa.scalar(None, pa.string()), plain)


PAIRS = np.array([[ord(BASE_LETTERS[b >> 4]), ord(BASE_LETTERS[b & 15])] for b in range(256)], dtype=np.uint8)


def read_tags(data: bytes, at: int, end: int) -> dict[str, str]:
    """Optional fields as ``tag -> TYPE:value``, in the spelling of SAM text."""
    found = {}
    while at < end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in TAG_NUMBERS:
            value = struct.unpack_from(TAG_NUMBERS[kind], data, at)[0]
            at += struct.calcsize(TAG_NUMBERS[kind])
            found[tag] = f"f:{value:g}" if kind == "f" else f"i:{value}"
        elif kind == "A":
            found[tag] = f"A:{chr(data[at])}"
            at += 1
        elif kind in "ZH":
            stop = data.index(b"\0", at, end)
            found[tag] = f"{kind}:{data[at:stop].decode()}"
            at = stop + 1
        elif kind == "B":
            item, count = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = f"<{count}{TAG_NUMBERS[item][1]}"
            values = struct.unpack_from(form, data, at + 5)
            at += 5 + struct.calcsize(form)
            found[tag] = ",".join([f"B:{item}", *(f"{v:g}" if item == "f" else str(v) for v in values)])
        else:
            raise ValueError(f"tag {tag} has the unknown type {kind!r}")
    return found


def tag_value(tags: Column, name: str) -> Column:
    """The value of a tag without its type; NULL when absent."""
    return F.substring(F.element_at(tags, name), 3, 1 << 30)


class Decoder:
    """Records as Arrow arrays of the asked columns."""

    def __init__(self, header: Header, columns: list[str]):
        self.columns = columns
        self.names = [n for n, _ in header.contigs]
        self.library = {k: g.get("LB") for k, g in header.groups().items()}
        self.cigars: dict[bytes, str] = {}

    def fields(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fixed fields and 0-based ends of all records."""
        raw = np.frombuffer(data, dtype=np.uint8)
        head = raw[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0]
        at = starts + HEAD.itemsize + head["name"]
        ops, bounds = _gather(raw, at, head["ops"].astype(np.int64) * 4)
        ops = ops.view("<u4")
        taken = np.concatenate([[0], np.cumsum(np.where(np.isin(ops & 15, REFERENCE_OPS), ops >> 4, 0), dtype=np.int64)])
        length = taken[bounds[1:] // 4] - taken[bounds[:-1] // 4]
        length[(head["flag"] & 4) != 0] = 0
        return head, head["pos"] + np.maximum(length, 1)

    def batch(self, data: bytes, starts: np.ndarray, head: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        """A record batch of the records at ``starts``."""
        raw = np.frombuffer(data, dtype=np.uint8)
        after_name = starts + HEAD.itemsize + head["name"]
        at_seq = after_name + head["ops"].astype(np.int64) * 4
        bases = head["bases"].astype(np.int64)
        at_qual = at_seq + (bases + 1) // 2
        at_tags = at_qual + bases
        stops = starts + np.frombuffer(raw[starts[:, None] + np.arange(-4, 0)].tobytes(), dtype="<i4")
        chrom = lambda i: pa.DictionaryArray.from_arrays(pa.array(i.astype(np.int32), mask=i < 0), pa.array(self.names, pa.string())).cast(pa.string())
        held: dict[str, list] = {}

        def groups() -> list:
            if "rg" not in held:
                held["rg"] = [t.get("RG", "Z:")[2:] or None for t in tags()]
            return held["rg"]

        def tags() -> list:
            if "tags" not in held:
                held["tags"] = [read_tags(data, a, b) for a, b in zip(at_tags.tolist(), stops.tolist())]
            return held["tags"]

        def cigar() -> pa.Array:
            out = []
            for a, n in zip(after_name.tolist(), head["ops"].tolist()):
                key = data[a : a + 4 * n]
                text = self.cigars.get(key)
                if text is None:
                    if len(self.cigars) > 200_000:
                        self.cigars.clear()
                    text = "".join(f"{op >> 4}{CIGAR_LETTERS[op & 15]}" for op in struct.unpack(f"<{n}I", key)) or "*"
                    self.cigars[key] = text
                out.append(text)
            return pa.array(out, pa.string())

        def seq() -> pa.Array:
            packed, bounds = _gather(raw, at_seq, (bases + 1) // 2)
            letters, bounds = _gather(PAIRS[packed].reshape(-1), 2 * bounds[:-1], bases)
            return _text(letters, bounds)

        def qual() -> pa.Array:
            values, bounds = _gather(raw, at_qual, bases)
            missing = bases == 0
            some = np.flatnonzero(~missing)
            missing[some] = values[bounds[:-1][some]] == 255
            return _text(np.where(values == 255, 42, values + 33).astype(np.uint8), bounds, missing)

        flag = head["flag"].astype(np.int32)
        make = {
            "qname": lambda: _text(*_gather(raw, starts + HEAD.itemsize, head["name"].astype(np.int64) - 1)),
            "flag": lambda: pa.array(flag), "chrom": lambda: chrom(head["ref"]), "pos": lambda: pa.array(head["pos"].astype(np.int64) + 1),
            "mapq": lambda: pa.array(head["mapq"].astype(np.int32)), "cigar": cigar, "mchrom": lambda: chrom(head["mate_ref"]),
            "mpos": lambda: pa.array(head["mate_pos"].astype(np.int64) + 1), "isize": lambda: pa.array(head["isize"]), "seq": seq,
            "qwidth": lambda: pa.array(head["bases"]), "strand": lambda: pa.array(np.where(flag & 16, "-", "+"), mask=(flag & 4) != 0),
            "end": lambda: pa.array(end.astype(np.int64)), "qual": qual, "rg": lambda: pa.array(groups(), pa.string()),
            "tags": lambda: pa.array([list(t.items()) for t in tags()], pa.map_(pa.string(), pa.string())),
            "library": lambda: pa.array([self.library.get(g) for g in groups()], pa.string()),
        }
        return pa.RecordBatch.from_arrays([make[c]() for c in self.columns], self.columns)


# ---------------------------------------------------------------- reading


@dataclass
class _Stretch(InputPartition):
    path: str
    start: int
    stop: int | None


class BamReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.target = int(options.get("splitBytes", 64 << 20))
        self.regions = [parse_region(r) for r in options.get("regions", "").split(";") if r.strip()]
        self.columns = columns
        self.chroms: set[str] | None = None  # pushed filters
        self.low, self.high = 1, FAR

    def pushFilters(self, filters):
        """Narrow the scan by conditions on ``chrom`` and ``pos``; Spark still checks every row."""
        for f in filters:
            name = f.attribute[0].lower() if getattr(f, "attribute", None) else None
            if name == "chrom" and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = given if self.chroms is None else self.chroms & given
            elif name == "pos" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if name == "pos" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def _wanted(self, header: Header) -> list[tuple[int, int, int]] | None:
        """Contig number, start and end of what has to be looked at; None is everything."""
        place = {n: i for i, (n, _) in enumerate(header.contigs)}
        asked = self.regions
        if not asked:
            if self.chroms is None and self.low <= 1 and self.high >= FAR:
                return None
            asked = [(c, 0, FAR) for c in (place if self.chroms is None else self.chroms)]
        low, high = max(0, self.low - 1), min(FAR, self.high)
        narrowed = [(c, max(start, low) if not self.regions else start, min(end, high)) for c, start, end in asked if self.chroms is None or c in self.chroms]
        return sorted((place[c], start, end) for c, start, end in narrowed if c in place and start < end)

    def partitions(self):
        parts = []
        for path in self.paths:
            header, index = bam_header(path), read_index(path)
            wanted = self._wanted(header)
            if index is None or wanted is None:
                stretches = [(header.first, None)]
            else:
                stretches = _joined(c for ref, start, end in wanted if ref < len(index.contigs) for c in index.contigs[ref].chunks(start, end))
            cuts = index.cuts() if index else []
            for start, stop in stretches:
                starts = [start]
                for cut in cuts:
                    if cut > start and (stop is None or cut < stop) and (cut >> 16) - (starts[-1] >> 16) >= self.target:
                        starts.append(cut)
                parts += [_Stretch(path, a, b) for a, b in zip(starts, [*starts[1:], stop])]
        return parts

    def read(self, partition):
        if partition is None:  # no stretch holds anything asked for
            return
        header = bam_header(partition.path)
        decoder, wanted = Decoder(header, self.columns), self._wanted(header)
        with bgzf.open_input(partition.path) as handle:
            for data, starts in bgzf.record_runs(handle, partition.start, partition.stop):
                head, end = decoder.fields(data, starts)
                if wanted is not None:
                    keep = np.zeros(len(starts), dtype=bool)
                    for ref, a, b in wanted:
                        keep |= (head["ref"] == ref) & (head["pos"] < b) & (end > a)
                    starts, head, end = starts[keep], head[keep], end[keep]
                for at in range(0, len(starts), 10_000):
                    part = slice(at, at + 10_000)
                    yield decoder.batch(data, starts[part], head[part], end[part])


def _joined(chunks) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class BamSource(DataSource):
    """``spark.read.format("bam").load("a.bam,b.bam")``.

    Options: ``regions``; ``splitBytes``, the size of a task's part.  ``.schema(...)`` asks for some columns of
    ``FULL_SCHEMA`` only.  For writing: ``contigs`` ("c1:5000,c2:9000" in order), ``header`` (more header lines), ``single``.
    """

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return ALN_SCHEMA

    def reader(self, schema):
        known = set(re.findall(r"(\w+) \w", FULL_SCHEMA))
        unknown = [c for c in schema.fieldNames() if c not in known]
        if unknown:
            raise ValueError(f"a BAM file has no column {unknown[0]}")
        return BamReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known; a source that takes filters needs the setting."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_bam(spark: SparkSession, path: str, columns: list[str] | None = None, regions: list[str] = (), split_bytes: int | None = None) -> DataFrame:
    """Alignments of one or more BAM files; with ``regions`` exactly the reads that overlap one of them."""
    register(spark)
    reader = spark.read.format("bam")
    if columns:
        kinds = dict(re.findall(r"(\w+) (map<\w+,\w+>|\w+)", FULL_SCHEMA))
        reader = reader.schema(", ".join(f"`{c}` {kinds[c]}" for c in columns))
    if regions:
        reader = reader.option("regions", ";".join(regions))
    if split_bytes:
        reader = reader.option("splitBytes", split_bytes)
    return reader.load(path)


def split_libraries(reads: DataFrame, path: str) -> None:
    """One Parquet folder per library of the reads' read groups (column ``library``), sorted by position inside."""
    named = reads.withColumn("library", F.coalesce("library", F.lit("unknown")))
    named.repartitionByRange("library", "chrom", "pos").sortWithinPartitions("library", "chrom", "pos").write.mode("overwrite").partitionBy("library").parquet(path)


# ---------------------------------------------------------------- writing

NIBBLE = {c: i for i, c in enumerate(BASE_LETTERS)}
OP_CODE = {c: i for i, c in enumerate(CIGAR_LETTERS)}
CIGAR_PART = re.compile(r"(\d+)([MIDNSHP=X])")


def pack_tags(tags) -> bytes:
    """Optional fields from ``tag -> TYPE:value``; integers take the smallest signed form that holds them, else unsigned."""
    out = []
    for tag, text in tags or []:
        kind, value = text[0], text[2:]
        out.append(tag.encode())
        if kind == "i":
            number = int(value)
            form = next(k for k in "csiI" if _fits(number, k))
            out.append(form.encode() + struct.pack(TAG_NUMBERS[form], number))
        elif kind == "f":
            out.append(b"f" + struct.pack("<f", float(value)))
        elif kind == "A":
            out.append(b"A" + value.encode()[:1])
        elif kind in "ZH":
            out.append(kind.encode() + value.encode() + b"\0")
        elif kind == "B":
            item, *values = value.split(",")
            read = float if item == "f" else int
            out.append(b"B" + item.encode() + struct.pack(f"<i{len(values)}{TAG_NUMBERS[item][1]}", len(values), *map(read, values)))
        else:
            raise ValueError(f"tag {tag} has the unknown type {kind!r}")
    return b"".join(out)


def _fits(number: int, form: str) -> bool:
    bits = 8 * struct.calcsize(TAG_NUMBERS[form])
    return 0 <= number < 1 << bits if form.isupper() else -(1 << bits - 1) <= number < 1 << bits - 1


def pack_record(row: dict, places: dict[str, int]) -> tuple[bytes, int, int, int]:
    """A record with its length in front; contig number, 0-based start and end."""
    ref = -1 if row["chrom"] is None else places[row["chrom"]]
    mate = -1 if row["mchrom"] is None else places[row["mchrom"]]
    start = (row["pos"] or 0) - 1
    ops = [(int(n), OP_CODE[o]) for n, o in CIGAR_PART.findall(row["cigar"] or "")]
    mapped = not row["flag"] & 4
    length = sum(n for n, o in ops if o in REFERENCE_OPS) if mapped else 0
    end = start + max(length, 1)
    seq = "" if row["seq"] in (None, "*") else row["seq"].upper()
    codes = [NIBBLE.get(c, 15) for c in seq]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], 0]))
    qual = row.get("qual")
    quality = bytes(ord(c) - 33 for c in qual) if qual not in (None, "*") else b"\xff" * len(seq)
    if len(quality) != len(seq):
        raise ValueError(f"read {row['qname']}: {len(seq)} bases but {len(quality)} qualities")
    name = (row["qname"] or "*").encode()
    body = struct.pack(
        "<iiBBHHHiiii", ref, start, len(name) + 1, row["mapq"] or 0, bin_of(start, end) if start >= 0 else 4680, len(ops), row["flag"], len(seq), mate,
        (row["mpos"] or 0) - 1, row["isize"] or 0,
    ) + name + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + quality + pack_tags(row.get("tags"))
    return struct.pack("<i", len(body)) + body, ref, start, end


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    first: tuple[int, int] | None  # contig number and start; None without records
    last: tuple[int, int] | None


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        contigs = [c.rsplit(":", 1) for c in options["contigs"].split(",") if c]
        contigs = [(name, int(length)) for name, length in contigs]
        lines = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{m}" for n, m in contigs), *options.get("header", "").splitlines()]
        self.header = Header("".join(f"{line}\n" for line in lines), contigs)
        self.single = options.get("single", "true").lower() == "true"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}" if self.single else self.path
        if not overwrite and bgzf.exists(self.path):
            raise ValueError(f"{self.path} exists")

    def write(self, iterator):
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}.bam"
        places = {n: i for i, (n, _) in enumerate(self.header.contigs)}
        index = Index.empty(len(places))
        ahead = 1 << 16 if self.single else 0  # offset 0 means "none", so a part counts as if a byte stood before it
        first = last = None
        with bgzf.open_output(f"{self.folder}/{name}") as out:
            blocks = bgzf.BlockWriter(out)
            if not self.single:
                blocks.write(self.header.pack())
                blocks.flush()
            for batch in iterator:
                for row in batch.to_pylist():
                    data, ref, start, end = pack_record(row, places)
                    key = (ref if ref >= 0 else len(places), start)
                    if last is not None and key < last:
                        raise ValueError("alignments are not sorted by contig and position; write them with write_bam")
                    first, last = first or key, key
                    if len(blocks.held) + len(data) > bgzf.BLOCK:
                        blocks.flush()
                    place = blocks.tell()
                    blocks.write(data)
                    if ref < 0:
                        index.unplaced += 1
                    else:
                        index.contigs[ref].add(start, end, place + ahead, blocks.tell() + ahead, not row["flag"] & 4)
            blocks.flush()
            if not self.single:
                out.write(bgzf.END_BLOCK)
        with bgzf.open_output(f"{self.folder}/{name}.bai") as out:
            out.write(index.serialize())
        return _Part(number, name, first, last)

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.number)
        if any(a.last > b.first for a, b in zip(parts, parts[1:])):
            raise ValueError("the parts are not in order; write alignments with write_bam")
        if not self.single:
            return
        index = Index.empty(len(self.header.contigs))
        with bgzf.open_output(self.path) as out:
            head = bgzf.BlockWriter(out)
            head.write(self.header.pack())
            head.flush()
            at = head.place
            for part in parts:
                name = f"{self.folder}/{part.name}"
                with bgzf.open_input(f"{name}.bai") as handle:
                    index.join(Index.parse(handle.read()), at - 1)
                bgzf.append_file(out, name)
                at += bgzf.size_of(name)
            out.write(bgzf.END_BLOCK)
        with bgzf.open_output(f"{self.path}.bai") as out:
            out.write(index.serialize())
        bgzf.remove_folder(self.folder)

    def abort(self, messages):
        if self.single:
            bgzf.remove_folder(self.folder)


def write_bam(aln: DataFrame, path: str, contigs: list[tuple[str, int]], header: str = "", single: bool = True, parts: int | None = None) -> None:
    """Write alignments sorted by contig (in the given order) and position, with an index.

    Reads of a position are dealt on by name, so a position that holds most reads is not one task.
    """
    register(aln.sparkSession)
    order = F.create_map(*[x for i, (n, _) in enumerate(contigs) for x in (F.lit(n), F.lit(i))])
    keys = [F.when(F.col("chrom").isNull(), len(contigs)).otherwise(F.element_at(order, F.col("chrom"))), F.col("pos"), F.col("qname"), F.col("flag")]
    wanted = [n for n, *_ in re.findall(r"(\w+) (map<\w+,\w+>|\w+)", FULL_SCHEMA) if n in aln.columns and n not in ("end", "rg", "library", "qwidth", "strand")]
    rows = aln.repartitionByRange(parts, *keys) if parts else aln.repartitionByRange(*keys)
    rows = rows.sortWithinPartitions(*keys).select(*wanted)
    writer = rows.write.format("bam").mode("overwrite").option("contigs", ",".join(f"{n}:{m}" for n, m in contigs))
    writer.option("header", header).option("single", str(single).lower()).save(path)
