"""BAM files of any size as reads, in splits.

A BAM file is a row of compressed blocks (BGZF), whose headers all hold the same six bytes: ``MARK``. Spark's text
reader takes these for the line end, so it deals out a file in splits of ``spark.sql.files.maxPartitionBytes``, from any
store it can read, and each row is the rest of one block. A task unpacks the blocks of a split one after the other.

Records cross blocks and splits. A split looks for the first place from which its bytes make a chain of records; what
is before it, and what is left after the last whole record, are its *seams*. Seams of neighbouring splits together must
make whole records again: this is checked for every pair, from the file's header on, so that a split that began at a
wrong place is an error and never a wrong read. The six bytes may also stand inside a block: its pieces are put together
again, and if a split begins between them, the pieces are seams as well.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.scalar import sample_name
from genoframe.session import Scratch

# Fixed values of the formats.
MARK = b"\x06\x00BC\x02\x00"  # length 6, subfield BC of length 2
HEAD = b"\x1f\x8b\x08\x04"  # how a block begins; six bytes follow, then MARK
CONSUMES = [0, 2, 3, 7, 8]  # CIGAR operations that take up the reference: M D N = X

FIELDS = ["ref", "start", "end", "mapq", "flag", "query_length"]
ROWS = "path string, at long, ref int, start long, end long, mapq int, flag int, query_length int, lone boolean, head binary, tail binary, before binary, after binary"
PIECE = 8 << 20
LARGEST = 1 << 16  # bytes of a block

#: Files up to which their names are broadcast with the names of their sequences; more are joined by a shuffle.
FEW = 20_000


def block(body: bytes) -> bytes | None:
    """The content of a block without its header, or None if the bytes are not all of it."""
    size = int.from_bytes(body[:2], "little") - 15  # two bytes of size, the data, checksum and length
    if len(body) < 10 or len(body) < size:
        return None
    if size < 10 or len(body) not in (size, size + 10):
        raise ValueError("not a BGZF file, or it is damaged")
    check, length = struct.unpack_from("<II", body, size - 8)
    try:
        data = zlib.decompress(body[2 : size - 8], -15, length or 1)
    except zlib.error:
        data = b""
    if len(data) != length or zlib.crc32(data) != check:
        raise ValueError("a BGZF block is damaged")
    return data


def joined(body: bytes) -> bytes:
    """The content of blocks that follow each other, all without the first one's header."""
    out = []
    while body:
        size = int.from_bytes(body[:2], "little") - 5
        out.append(block(body[:size]))
        if body[size : size + 6] not in (b"", MARK):
            raise ValueError("a BGZF block is damaged")
        body = body[size + 6 :]
    if None in out:
        raise ValueError("a BGZF block ends early")
    return b"".join(out)


def header_end(data: bytes) -> tuple[int, list[str]] | None:
    """Where the header ends, and the names of the sequences; None if it is not all there."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n, names = struct.unpack_from("<i", data, at)[0], []
        at += 4
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            if len(data) < at + 8 + size:
                return None
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return (at, names) if at <= len(data) else None


def plausible(data: bytes, at: int) -> int | None:
    """Where the next record would begin if one begins here; None if none can. Bytes that are not there prove nothing."""
    if len(data) < at + 36:
        return len(data)
    size, ref, pos, name, _, _, ops, flag, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    known = 33 <= size < 1 << 28 and min(ref, pos, mate, mate_pos) >= -1 and max(ref, mate) < 1 << 24 and name and length >= 0 and flag < 1 << 12
    if not known or 32 + name + 4 * ops + (length + 1) // 2 + length > size:
        return None
    text = data[at + 36 : at + 36 + name]
    if any(not 33 <= c <= 126 for c in text[: name - 1]) or text[name - 1 :] not in (b"", b"\0"):
        return None
    return at + 4 + size


def first_record(data: bytes, chain: int = 12) -> int | None:
    """The first place from which ``chain`` records follow each other, or all that the bytes have (one whole at least)."""
    for start in range(len(data) - 36):
        at, n = start, 0
        while n < chain and at is not None and at < len(data):
            at = plausible(data, at)
            n += 1
        if at is not None and (n == chain or n > 1 or at <= len(data)):
            return start
    return None


def records(data: bytes, at: int = 0) -> tuple[dict[str, np.ndarray], int]:
    """The fields of all whole records from ``at`` on, and where the rest begins."""
    starts, n = [], len(data)
    while at + 4 <= n and (after := at + 4 + int.from_bytes(data[at : at + 4], "little")) <= n:
        starts.append(at)
        at = after
    if not starts:
        return {f: np.zeros(0, "i8") for f in FIELDS}, at
    raw, o = np.frombuffer(data, "u1"), np.array(starts)
    fixed = raw[o[:, None] + np.arange(36)].view("<i4")
    small, ops, flag = fixed[:, 3], fixed[:, 4] & 0xFFFF, fixed[:, 4] >> 16 & 0xFFFF
    total, record = int(ops.sum()), np.repeat(np.arange(len(o)), ops)
    nth = np.arange(total) - np.repeat(np.cumsum(ops) - ops, ops)
    cigar = raw[(np.repeat(o + 36 + (small & 0xFF), ops) + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0] if total else np.zeros(0, "u4")
    span = np.bincount(record, np.where(np.isin(cigar & 15, CONSUMES), cigar >> 4, 0), len(o)).astype("i8")
    start = fixed[:, 2].astype("i8")
    return {"ref": fixed[:, 1], "start": start, "end": start + np.maximum(span, 1), "mapq": small >> 8 & 0xFF, "flag": flag, "query_length": fixed[:, 5]}, at


SEAMS = ["lone", "head", "tail", "before", "after"]


def rows(path: str, at: int, fields: dict[str, np.ndarray] | None = None, seams: tuple = (None,) * 5) -> pa.RecordBatch:
    """Reads of a split, or its seams."""
    n = 1 if fields is None else len(fields["ref"])
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    read = [pa.nulls(n, t) if fields is None else pa.array(fields[f], t) for f, t in zip(FIELDS, types, strict=True)]
    sides = [pa.array([x] * n, pa.bool_() if c == "lone" else pa.binary()) for c, x in zip(SEAMS, seams, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([at] * n, pa.int64()), *read, *sides], names=["path", "at", *FIELDS, *SEAMS])


class Split:
    """The blocks of a split in their order, made into reads and seams."""

    def __init__(self, path: str, at: int):
        self.path, self.at, self.data, self.body = path, at, bytearray(), b""
        self.head: bytes | None = None
        self.fresh = at == 0  # the first row of a file is what is before the first MARK
        self.lost: list[bytes] | None = None if at == 0 else []  # rows before the first whole block
        self.before = b""

    def push(self, row: bytes) -> Iterator[pa.RecordBatch]:
        if self.fresh:
            self.fresh = False
            if len(row) != 10 or row[:4] != HEAD:
                raise ValueError(f"{self.path} is not a BGZF file")
            return
        if self.lost is not None:
            content = self.first_block(row)
        elif (content := block(self.body + row)) is None:  # MARK stood inside the block
            self.body += row + MARK
        else:
            self.body = b""
        if content is not None:
            self.data += content
            if len(self.data) > PIECE:
                yield from self.reads()

    def first_block(self, row: bytes) -> bytes | None:
        self.lost.append(row)
        for n in range(len(self.lost)):
            try:
                content = block(MARK.join(self.lost[n:]))
            except ValueError:
                continue
            if content is not None:
                self.before, self.lost = MARK.join(self.lost[:n]), None
                return content
        if sum(map(len, self.lost)) > 4 * LARGEST:
            raise ValueError(f"{self.path} is not a BGZF file, or it is damaged")
        return None

    def reads(self) -> Iterator[pa.RecordBatch]:
        data = bytes(self.data)
        begin = 0
        if self.head is None:
            found = header_end(data) if self.at == 0 else first_record(data)
            begin = found[0] if isinstance(found, tuple) else found
            if begin is None:
                return
            self.head = data[:begin]
        fields, rest = records(data, begin)
        if len(fields["ref"]):
            yield rows(self.path, self.at, fields)
        self.data = bytearray(data[rest:])

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.reads()
        lone, data = self.head is None, bytes(self.data)
        if self.lost is None:
            yield rows(self.path, self.at, None, (lone, data if lone else self.head, b"" if lone else data, self.before, self.body))
        else:  # no whole block begins here
            yield rows(self.path, self.at, None, (True, b"", b"", None, MARK.join([*self.lost, b""])))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (path, at, value) to reads and seams; a task has whole splits, each in the file's order."""
    split = None
    for b in batches:
        for path, at, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if split is None or (split.path, split.at) != (path, at):
                if split:
                    yield from split.close()
                split = Split(path, at)
            yield from split.push(value)
    if split:
        yield from split.close()


def sewn(table: pa.Table) -> pa.Table:
    """The seams of a file: reads that cross splits, and in the first row the names of the sequences."""
    path, table = table["path"][0].as_py(), table.sort_by("at")
    carry, names, out, pieces = b"", None, [], b""

    def whole(data: bytes, what: str) -> None:
        nonlocal names
        begin = 0
        if names is None:
            if (found := header_end(data)) is None:
                raise ValueError(f"the header of {path} is not whole")
            begin, names = found
        fields, rest = records(data, begin)
        if rest != len(data):
            raise ValueError(f"{path} {what}")
        out.append(pa.table({f: pa.array(x, pa.int64()) for f, x in fields.items()}))

    for lone, head, tail, before, after in zip(*[table[c].to_pylist() for c in SEAMS], strict=True):
        if before is None:
            pieces += after
            continue
        if pieces or before:
            carry += joined(pieces + before)
        carry, pieces = carry + head, after
        if not lone:
            whole(carry, "has a split that did not find where its records begin")
            carry = tail
    if pieces:
        raise ValueError(f"{path} ends inside a block")
    whole(carry, "ends inside a record")
    reads = pa.concat_tables(out)
    n = len(reads) + 1
    columns = {f: pa.concat_arrays([pa.nulls(1, pa.int64()), reads[f].combine_chunks()]) for f in FIELDS}
    return pa.table({"path": [path] * n, **columns, "names": pa.array([names] + [None] * (n - 1), pa.list_(pa.string()))})


def named_files(spark: SparkSession, *paths: str, pattern: str = "*.bam") -> DataFrame:
    """cell, path of all files, without those named ``all``; two files of one cell are an error. Reads no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    named = files.select(sample_name(F.col("path")).alias("cell"), "path").where("cell <> 'all'")
    twice = named.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two files are named {twice[0]['cell']}")
    return named


def bam_reads(spark: SparkSession, *paths: str, pattern: str = "*.bam") -> DataFrame:
    """Reads of all BAM files in folders or of single files; one file is one cell.

    Files are unpacked once: the reads are written to the folder of intermediate tables and read from there.
    """
    scratch = Scratch(spark)
    named_files(spark, *paths, pattern=pattern)
    place = F.udf(unquote, "string")  # paths come as URIs
    text = spark.read.option("pathGlobFilter", pattern).text(list(paths), lineSep=MARK.decode())
    blocks = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    blocks = blocks.where(sample_name(F.col("path")) != "all")
    parts = scratch.save(blocks.mapInArrow(unpacked, ROWS))
    crossing = "path string, " + ", ".join(f"{f} long" for f in FIELDS) + ", names array<string>"
    seams = scratch.save(parts.where("head is not null").select("path", "at", *SEAMS).groupBy("path").applyInArrow(sewn, crossing))
    names = seams.where("names is not null").select("path", sample_name(place("path")).alias("cell"), "names")
    names = F.broadcast(names) if names.count() <= FEW else names
    within = parts.where("head is null").select("path", *FIELDS)
    across = seams.where("names is null").select("path", *[F.col(f).cast(within.schema[f].dataType).alias(f) for f in FIELDS])
    chrom = F.when(F.col("ref") >= 0, F.get("names", F.col("ref"))).alias("chrom")
    return within.unionByName(across).join(names, "path").select("cell", chrom, "start", "end", "mapq", "flag", "query_length")
