"""What a parquet file tells without decoding its values: footers, page headers, dictionaries."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

DATA, DICTIONARY, DATA_V2 = 0, 2, 3
DICT_ENCODINGS = (2, 8)  # PLAIN_DICTIONARY, RLE_DICTIONARY
NUMPY = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}


class Compact:
    """Reader of thrift's compact protocol: a struct becomes a dict by field number."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.byte()
            n = head >> 4
            n = self.varint() if n == 15 else n
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"thrift type {kind}")

    def struct(self) -> dict:
        out, number = {}, 0
        while head := self.byte():
            number = number + (head >> 4) if head >> 4 else self.zigzag()
            out[number] = self.value(head & 15)
        return out


@dataclass
class Chunk:
    """A column of one row group. nulls, lo and hi are None where the footer doesn't give them."""

    column: str
    values: int
    nulls: int | None
    lo: object
    hi: object
    dictionary: list | None = field(default=None)  # all values that occur, where every page is dictionary coded


def open_file(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return fs.open_input_file(path)


def chunk_of(meta: pq.FileMetaData, group: int, index: int) -> Chunk:
    c = meta.row_group(group).column(index)
    s = c.statistics if c.is_stats_set else None
    lo, hi = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
    return Chunk(c.path_in_schema, c.num_values, s.null_count if s is not None and s.has_null_count else None, lo, hi)


def dictionary_of(file, meta: pq.FileMetaData, group: int, index: int) -> list | None:
    """The chunk's dictionary, if every data page is coded by it; None where that isn't so or can't be told."""
    c = meta.row_group(group).column(index)
    if not c.has_dictionary_page:
        return None
    start = min(x for x in (c.dictionary_page_offset, c.data_page_offset) if x)
    end, found = start + c.total_compressed_size, None
    try:
        while start < end:
            head, size = None, 512
            while head is None:
                reader = Compact(file.read_at(min(size, end - start), start))
                try:
                    head = reader.struct()
                except IndexError:
                    if size > 1 << 20:
                        return None
                    size *= 8
            body = start + reader.at
            if head[1] == DICTIONARY:
                raw = file.read_at(head[3], body)
                if c.compression != "UNCOMPRESSED":
                    raw = pa.decompress(raw, decompressed_size=head[2], codec=c.compression.lower(), asbytes=True)
                found = _plain(bytes(raw), c.physical_type, head[7][1])
            elif head[1] == DATA and head[5][2] not in DICT_ENCODINGS or head[1] == DATA_V2 and head[8][4] not in DICT_ENCODINGS:
                return None
            start = body + head[3]
    except (KeyError, ValueError, OSError, struct.error):
        return None
    return found


def _plain(raw: bytes, kind: str, n: int) -> list | None:
    if kind in NUMPY:
        return np.frombuffer(raw, NUMPY[kind], n).tolist()
    if kind != "BYTE_ARRAY":
        return None
    out, at = [], 0
    for _ in range(n):
        size = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + size].decode("utf-8", "replace"))
        at += 4 + size
    return out
