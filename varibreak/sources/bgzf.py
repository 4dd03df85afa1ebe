"""Blocked gzip files: opening by path or URI, blocks by virtual offset, whole records, writing.

A virtual offset is a block's place in the file shifted by 16 bits, plus a place in the block's data.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# fixed values of the format: most data bytes of a block, the empty block that ends a file
BLOCK = 0xFF00
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = 18
RUN = 4 << 20
COPY = 8 << 20


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_input(path: str):
    """A seekable file at a local path or a URI of any file system that Arrow knows."""
    where, name = _at(path)
    return where.open_input_file(name)


def open_output(path: str):
    where, name = _at(path)
    folder = name.rpartition("/")[0]
    if folder:
        where.create_dir(folder, recursive=True)
    return where.open_output_stream(name)


def exists(path: str) -> bool:
    where, name = _at(path)
    return bool(where.get_file_info([name])[0].type)


def size_of(path: str) -> int:
    where, name = _at(path)
    return where.get_file_info([name])[0].size


def remove_folder(path: str) -> None:
    where, name = _at(path)
    if where.get_file_info([name])[0].type:
        where.delete_dir(name)


def append_file(out, path: str) -> None:
    """Copy a file to an open output in bounded pieces."""
    with open_input(path) as part:
        while piece := part.read(COPY):
            out.write(piece)


def blocks(handle) -> Iterator[tuple[int, bytes]]:
    """Data of the blocks from the current position on, with their places in the file."""
    while True:
        place = handle.tell()
        head = handle.read(HEAD)
        if not head:
            return
        if len(head) < HEAD or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block starts at byte {place}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        body = handle.read(size - HEAD)
        if len(body) < size - HEAD:
            raise ValueError(f"the block at byte {place} is cut short")
        data = zlib.decompress(body[:-8], -15)
        if struct.unpack("<II", body[-8:]) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at byte {place} does not hold what was written")
        yield place, data


def _whole(data: bytearray, limit: int | None) -> tuple[list[int], int]:
    """Starts (behind the length) of the complete records that begin before ``limit``, and the bytes they take."""
    starts, at, size = [], 0, len(data)
    while at + 4 <= size and (limit is None or at < limit):
        length = int.from_bytes(data[at : at + 4], "little", signed=True)
        if length < 0:
            raise ValueError("a record of negative length")
        if at + 4 + length > size:
            break
        starts.append(at + 4)
        at += 4 + length
    return starts, at


def record_runs(handle, start: int, stop: int | None) -> Iterator[tuple[bytes, np.ndarray]]:
    """Runs of some megabytes: data and record starts, for the records that begin from ``start`` up to ``stop``."""
    handle.seek(start >> 16)
    skip, data, limit = start & 0xFFFF, bytearray(), None
    for place, block in blocks(handle):
        if stop is not None and limit is None and place >= stop >> 16:
            limit = len(data) + ((stop & 0xFFFF) - skip if place == stop >> 16 else 0)
        data += block[skip:]
        skip = 0
        if limit is not None or len(data) >= RUN:
            starts, used = _whole(data, limit)
            if starts:
                yield bytes(data[:used]), np.array(starts, dtype=np.int64)
                del data[:used]
                limit = None if limit is None else limit - used
            if limit is not None and limit <= 0:
                return
    starts, used = _whole(data, limit)
    if starts:
        yield bytes(data[:used]), np.array(starts, dtype=np.int64)
    if used < len(data) and (limit is None or used < limit):
        raise ValueError("the last record is cut short")


class BlockWriter:
    """Data written as blocks; ``tell`` is the virtual offset of the next byte."""

    def __init__(self, out, level: int = 6):
        self.out, self.level, self.held, self.place = out, level, bytearray(), 0

    def tell(self) -> int:
        return self.place << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        """Append data; a piece that fits a block is not cut, so that most records lie in one block."""
        if len(self.held) + len(data) > BLOCK and len(data) <= BLOCK:
            self.flush()
        self.held += data
        while len(self.held) >= BLOCK:
            self._block(self.held[:BLOCK])
            del self.held[:BLOCK]

    def flush(self) -> None:
        if self.held:
            self._block(self.held)
            self.held = bytearray()

    def _block(self, data: bytes) -> None:
        deflate = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        body = deflate.compress(data) + deflate.flush()
        if len(body) + HEAD + 8 > 1 << 16:  # data that does not shrink is stored
            deflate = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = deflate.compress(data) + deflate.flush()
        size = len(body) + HEAD + 8
        block = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))
        self.out.write(block)
        self.place += size
