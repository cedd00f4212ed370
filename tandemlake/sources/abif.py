"""ABIF trace files (.fsa): binary files to a row a channel.

The public format: `ABIF`, a version, and one directory entry that tells where the directory lies. An entry has a tag
of four letters, a number, an element type and size, a count, a data size and either the data (up to four bytes) or
their offset; all numbers are big-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_ENTRY = struct.Struct(">4sihhiii")
#: Element types of the format: struct codes of numbers; the others are text.
_NUMBERS = {1: "B", 4: "h", 5: "i", 7: "f", 8: "d", 201: "b"}
#: Entries whose stored element type is not the one that their data have.
_TYPES = {("PCON", 1): 201, ("GELP", 1): 2}
#: Directory entries of the dyes' traces, by dye number.
_TRACES = ((1, 1), (2, 2), (3, 3), (4, 4), (5, 105))

SCHEMA = "path string, dye_no int, dye string, wavelength int, raw array<int>"


def entries(data: bytes) -> dict[tuple[str, int], object]:
    """(tag, number) -> numbers or text of a file's directory."""
    if data[:4] != b"ABIF":
        raise ValueError("not an ABIF file")
    _, _, _, _, count, _, place = _ENTRY.unpack_from(data, 6)
    out: dict[tuple[str, int], object] = {}
    for i in range(count):
        at = place + 28 * i
        tag, number, kind, _, n, size, where = _ENTRY.unpack_from(data, at)
        body = data[at + 20 : at + 20 + size] if size <= 4 else data[where : where + size]
        kind = _TYPES.get((tag.decode("latin-1"), number), kind)
        if kind in _NUMBERS:
            value: object = struct.unpack(f">{len(body) // struct.calcsize(_NUMBERS[kind])}{_NUMBERS[kind]}", body)
        elif kind == 18:  # a length and that many characters
            value = body[1 : 1 + body[0]].decode("latin-1") if body else ""
        elif kind in (2, 19):
            value = body.rstrip(b"\0").decode("latin-1")
        else:
            value = body
        out[tag.decode("latin-1"), number] = value
    return out


def channels(data: bytes) -> list[tuple[int, str | None, int | None, list[int]]]:
    """(dye number, dye, wavelength, raw trace) of the channels that a file has."""
    got = entries(data)
    out = []
    for dye, number in _TRACES:
        raw = got.get(("DATA", number))
        if raw:
            length = got.get(("DyeW", dye))
            out.append((dye, got.get(("DyeN", dye)), int(length[0]) if length else None, list(raw)))
    return out


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """path, dye_no, dye, wavelength, raw of every channel of the files below a path; other files are an error."""

    ship(spark)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *c) for p, data in zip(f["path"], f["content"]) for c in channels(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "dye_no", "dye", "wavelength", "raw"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fsa").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(decode, SCHEMA)


def trace_points(traces: DataFrame) -> DataFrame:
    """path, t and a column for each dye number: the table form of a file."""
    rows = traces.select("path", "dye_no", F.posexplode("raw").alias("t", "y"))
    return rows.groupBy("path", "t").pivot("dye_no", [d for d, _ in _TRACES]).agg(F.first("y"))


def encode(tags: dict[tuple[str, int], tuple[int, bytes, int]]) -> bytes:
    """A file with the given entries, (tag, number) -> (element type, bytes, count); for tests and round trips."""
    body, directory = bytearray(b"\0" * 128), bytearray()
    for (tag, number), (kind, data, n) in tags.items():
        where = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">i", len(body))
        if len(data) > 4:
            body += data
        directory += struct.pack(">4sihhii", tag.encode(), number, kind, max(1, len(data) // max(n, 1)), n, len(data)) + where + b"\0" * 4
    head = b"ABIF" + struct.pack(">h", 101) + _ENTRY.pack(b"tdir", 1, 1023, 28, len(tags), 28 * len(tags), len(body)) + b"\0" * 4
    body[: len(head)] = head
    return bytes(body + directory)
