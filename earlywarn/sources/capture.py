"""Byte captures as a data source: partitions are byte ranges, each of which finds its first frame by itself.

A frame belongs to the range that holds its start byte. A range skips to its first start byte, for what lies before belongs to a frame of an earlier range, and reads on
beyond its end until its last frame and the bytes after it end. So ranges need nothing from each other, and any length of range gives the same frames and counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The start, end and trailer bytes of a frame.
FRAME_START, FRAME_END, TRAILER = b"\x0b", b"\x1c", 0x0D
RANGE = 128 << 20
CHUNK = 1 << 20
BATCH = 4 << 20
#: A row with ``place`` is a frame that starts there; one without is what its range counted.
RAW = "file string, begins long, place long, bytes binary, oversize boolean, total_size long, missing_trailer boolean, frames long, outside_bytes long, abandoned long"
FRAMES = "file string, frame_no int, bytes binary, oversize boolean, total_size long, outside_bytes long, abandoned int, missing_trailer boolean"
_MARK = re.compile(b"[\x0b\x1c]")


class Range(InputPartition):
    def __init__(self, file: str, begins: int, ends: int):
        super().__init__((file, begins, ends))


class Frames:
    """The frames of one range, fed by chunks; what it holds is one frame cut to ``most`` bytes."""

    def __init__(self, begins: int, ends: int, most: int, kept: int):
        self.at, self.ends, self.most, self.kept = begins, ends, most, min(kept, most)
        self.state = "outside" if begins == 0 else "skipped"
        self.frames = self.outside = self.abandoned = 0
        self.done = False
        self.place, self.size, self.held = -1, 0, bytearray()

    def _begin(self, place: int) -> None:
        if place >= self.ends:
            self.done = True
        else:
            self.state, self.place, self.size, self.held = "inside", place, 0, bytearray()

    def _finish(self, missing: bool) -> tuple:
        self.state, self.frames = "outside", self.frames + 1
        return self.place, bytes(self.held), self.size > self.most, self.size, missing

    def _keep(self, piece: bytes) -> None:
        self.size += len(piece)
        limit = self.kept if self.size > self.most else self.most
        self.held += piece[: max(0, limit - len(self.held))]
        del self.held[limit:]

    def feed(self, chunk: bytes):
        i, n = 0, len(chunk)
        while i < n and not self.done:
            if self.state == "after":
                i += (present := chunk[i] == TRAILER)
                yield self._finish(not present)
            elif self.state == "inside":
                mark = _MARK.search(chunk, i)
                stop = mark.start() if mark else n
                self._keep(chunk[i:stop])
                i = stop + 1
                if mark and mark[0] == FRAME_END:
                    self.state = "after"
                elif mark:  # a start inside a frame abandons what came before
                    self.abandoned += 1
                    self._begin(self.at + stop)
            else:
                found = chunk.find(FRAME_START, i)
                stop = n if found < 0 else found
                self.outside += (stop - i) * (self.state == "outside")
                i = stop + 1
                if found >= 0:
                    self._begin(self.at + found)
        self.at += n
        if self.state == "skipped" and self.at >= self.ends:
            self.done = True

    def close(self):
        """The end of the file: a frame whose end byte came is whole, an open one is abandoned."""
        if self.state == "after":
            yield self._finish(True)
        elif self.state == "inside" and not self.done:
            self.abandoned += 1


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.most, self.kept = int(options.get("most", 1 << 20)), int(options.get("kept", 4096))
        if self.range < 1 or self.most < 1 or self.kept < 0:
            raise ValueError("range, most or kept out of range")

    def partitions(self):
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._")
        return [Range(f, b, min(b + self.range, size)) for f, size in files for b in range(0, max(1, size), self.range)] or [Range("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        file, begins, ends = partition.value
        if not file:
            return
        system, _ = _opened(self.path)
        found = Frames(begins, ends, self.most, self.kept)
        names = [c.split()[0] for c in RAW.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        rows, held = [], 0
        batch = lambda r: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*r, strict=True), kinds, strict=True)], names=names)
        with system.open_input_file(file) as source:
            source.seek(begins)
            while not found.done:
                chunk = source.read(CHUNK if found.at < ends else CHUNK >> 4)
                for place, content, oversize, size, missing in found.feed(chunk) if chunk else found.close():
                    rows.append((file, begins, place, content, oversize, size, missing, None, None, None))
                    held += len(content) + 64
                    if held >= BATCH:
                        yield batch(rows)
                        rows, held = [], 0
                if not chunk:
                    break
        rows.append((file, begins, None, None, None, None, None, found.frames, found.outside, found.abandoned))
        yield batch(rows)


class Capture(DataSource):
    """``spark.read.format("capture")`` with ``range`` (bytes of a partition), ``most`` (bytes of a whole frame) and ``kept`` (bytes kept of a larger one)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return RAW

    def reader(self, schema):
        return _Reader(dict(self.options))


def raw_frames(spark: SparkSession, path: str, most: int = 1 << 20, kept: int = 4096, range_bytes: int = RANGE) -> DataFrame:
    """Rows of ``RAW``: the frames of all files below ``path`` (hidden ones left out) by the place of their start byte, and a row of counts for each range."""
    spark.dataSource.register(Capture)
    return spark.read.format("capture").option("range", range_bytes).option("most", most).option("kept", kept).load(path)


def scan_capture(spark: SparkSession, path: str, most: int = 1 << 20, kept: int = 4096, range_bytes: int = RANGE) -> DataFrame:
    """Frames of byte captures, one row each, numbered in each file, and for each file a last row (``bytes`` null) with what lay outside frames and how many frames were abandoned.

    Frames of more than ``most`` bytes keep their first ``kept``. A frame's number is its number in its range plus the frames of the file's ranges before, so no file is one task; the
    captures are read once for the counts and once for the frames. An empty file has a row of zero counts, an empty folder no rows."""
    raw = raw_frames(spark, path, most, kept, range_bytes)
    counts = raw.where("place is null").select("file", "begins", "frames", "outside_bytes", "abandoned")
    before = F.coalesce(F.sum("frames").over(Window.partitionBy("file").orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    offsets = counts.select("file", "begins", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "begins").orderBy("place"))
    frames = raw.where("place is not null").withColumn("_n", inside).join(offsets, ["file", "begins"])
    frames = frames.select("file", (F.col("_n") + F.col("before") - 1).cast("int").alias("frame_no"), "bytes", "oversize", "total_size", F.lit(None).cast("long").alias("outside_bytes"), F.lit(None).cast("int").alias("abandoned"), "missing_trailer")
    none = {"bytes": "binary", "oversize": "boolean", "total_size": "long", "missing_trailer": "boolean"}
    last = counts.groupBy("file").agg(F.sum("frames").cast("int").alias("frame_no"), F.sum("outside_bytes").alias("outside_bytes"), F.sum("abandoned").cast("int").alias("abandoned"))
    return frames.unionByName(last.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items())))
