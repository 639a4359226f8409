"""Captures split at any byte, against one pass over the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from earlywarn.sources import capture
from earlywarn.sources.capture import Frames, scan_capture


def plain(data, most, kept):
    """Byte by byte: frames (place, bytes, oversize, size, missing), bytes outside, frames abandoned."""
    frames, outside, abandoned, place, held, i = [], 0, 0, None, b"", 0
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\x0b":
            abandoned += place is not None
            place, held = i, b""
        elif place is None:
            outside += 1
        elif c == b"\x1c":
            trailer = data[i + 1 : i + 2] == b"\r"
            frames.append((place, held[:kept] if len(held) > most else held, len(held) > most, len(held), not trailer))
            place, i = None, i + trailer
        else:
            held += c
        i += 1
    return frames, outside, abandoned + (place is not None)


def noise(seed, n):
    draw = random.Random(seed)
    return bytes(draw.choice(b"\x0b\x0b\x1c\x1c\r\rabcde\n") for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
def test_ranges_need_nothing_from_each_other(seed):
    draw = random.Random(seed)
    data = noise(seed, draw.randint(0, 400))
    want = plain(data, 5, 2)
    for step in (1, 2, 3, 7, 50, 1000):
        frames, outside, abandoned = [], 0, 0
        for begins in range(0, max(1, len(data)), step):
            f = Frames(begins, min(begins + step, len(data)), 5, 2)
            at = begins
            while not f.done:
                chunk = data[at : at + draw.randint(1, 9)]
                at += len(chunk)
                frames += f.feed(chunk) if chunk else f.close()
                if not chunk:
                    break
            outside, abandoned = outside + f.outside, abandoned + f.abandoned
        assert (frames, outside, abandoned) == want, step


def test_files(spark, tmp_path):
    files = {"a.bin": noise(1, 3000), "b c.bin": b"", "deep/c.bin": b"x" * 100 + b"\x0b" + b"y" * 500 + b"\x1c\r" + noise(2, 200), ".hidden": b"\x0bno\x1c\r", "d.bin": b"only noise"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    seen = None
    for step in (64, 1 << 20):
        rows = scan_capture(spark, f"file://{tmp_path}", 50, 4, step).collect()
        got = sorted((r.file, r.frame_no, r.bytes is not None and bytes(r.bytes), r.oversize, r.total_size, r.outside_bytes, r.abandoned, r.missing_trailer) for r in rows)
        want = []
        for name, data in files.items():
            if name != ".hidden":
                frames, outside, abandoned = plain(data, 50, 4)
                want += [(f"{tmp_path}/{name}", i, b, over, size, None, None, missing) for i, (_, b, over, size, missing) in enumerate(frames)]
                want.append((f"{tmp_path}/{name}", len(frames), False, None, None, outside, abandoned, None))
        assert got == sorted(want)
        assert seen in (None, got)
        seen = got
    assert capture.raw_frames(spark, f"file://{tmp_path}", range_bytes=64).where(F.col("place").isNull()).count() == 47 + 1 + 13 + 1


def test_empty_folder(spark, tmp_path):
    assert scan_capture(spark, f"file://{tmp_path}").count() == 0
    with pytest.raises(Exception, match="out of range"):
        scan_capture(spark, f"file://{tmp_path}", range_bytes=0).count()
