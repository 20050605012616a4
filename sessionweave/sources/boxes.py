"""What a media file's own boxes say of it: duration, streams, sizes, rates and codecs, without an outside program.

Only the heads of the outer boxes and the description (`moov`) are fetched, by ranges, however long the file is. The result has the form of a
media probe's JSON, so that `readers.index_media(files, boxes.probe)` makes the index.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs

#: Fixed values of the format: names of codecs by those of sample descriptions.
CODECS = {"avc1": "h264", "avc3": "h264", "hev1": "hevc", "hvc1": "hevc", "mp4v": "mpeg4", "vp09": "vp9", "av01": "av1", "mp4a": "aac", "ac-3": "ac3", "ec-3": "eac3", "Opus": "opus", "fLaC": "flac", "alac": "alac", ".mp3": "mp3", "sowt": "pcm_s16le", "twos": "pcm_s16be"}
#: Fixed values of the format: boxes that a file may begin with.
FIRST = (b"ftyp", b"styp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot", b"uuid")
_LARGEST = 256 << 20


def _inner(data: bytes, first: int = 0) -> Iterator[tuple[str, bytes]]:
    """Name and content of the boxes within a box."""
    at = first
    while at + 8 <= len(data):
        size, head = struct.unpack_from(">I", data, at)[0], 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            raise ValueError(f"a broken box at {at}")
        yield data[at + 4 : at + 8].decode("latin-1"), data[at + head : at + size]
        at += size


def _find(data: bytes, *names: str) -> bytes | None:
    """The first box by its path."""
    for name in names:
        data = next((d for n, d in _inner(data) if n == name), None)
        if data is None:
            return None
    return data


def description(file: BinaryIO, length: int) -> bytes:
    """The content of the outer `moov` box."""
    at, known = 0, False
    while at + 8 <= length:
        file.seek(at)
        head = file.read(16)
        size, used = struct.unpack_from(">I", head)[0], 8
        name = head[4:8]
        if size == 1 and len(head) == 16:
            size, used = struct.unpack_from(">Q", head, 8)[0], 16
        size = size or length - at
        if not known and name not in FIRST:
            raise ValueError("not a media file of boxes")
        if size < used:
            raise ValueError(f"a broken box at {at}")
        known = True
        if name == b"moov":
            if at + size > length or size > _LARGEST:
                raise ValueError("the description is cut off" if at + size > length else "the description is too large")
            file.seek(at + used)
            return file.read(size - used)
        at += size
    raise ValueError("no description in the file" if known else "not a media file of boxes")


def _seconds(data: bytes) -> tuple[int, float | None]:
    """Ticks a second, and duration in seconds, of a movie's or medium's head."""
    wide = data[0] == 1
    scale, length = struct.unpack_from(">IQ" if wide else ">II", data, 20 if wide else 12)
    unknown = length in ((1 << 64) - 1, (1 << 32) - 1)
    return scale, length / scale if scale and not unknown else None


def _stream(track: bytes) -> dict | None:
    """One track as a stream of a probe."""
    medium = _find(track, "mdia")
    handler = medium and _find(medium, "hdlr")
    table = medium and _find(medium, "minf", "stbl")
    kind = {b"vide": "video", b"soun": "audio"}.get(handler[8:12]) if handler else None
    if kind is None or table is None:
        return None
    head = _find(medium, "mdhd")
    scale, seconds = _seconds(head) if head else (0, None)
    out = {"codec_type": kind, "duration": None if seconds is None else f"{seconds:.6f}"}
    described = _find(table, "stsd")
    entry = next(_inner(described, 8), None) if described else None
    if entry:
        name, data = entry
        out["codec_name"] = CODECS.get(name, name.strip().lower())
        if kind == "video":
            out["width"], out["height"] = struct.unpack_from(">HH", data, 24)
        else:
            channels, rate = struct.unpack_from(">H6xI", data, 16)
            out["channels"], out["sample_rate"] = channels, str(rate >> 16)
    times = _find(table, "stts")
    if kind == "video" and times:
        runs = [struct.unpack_from(">II", times, 8 + 8 * k) for k in range(min(struct.unpack_from(">I", times, 4)[0], (len(times) - 8) // 8))]
        most = max(runs, default=(0, 0))  # the step that most frames have
        out["r_frame_rate"] = f"{scale}/{most[1]}"
    return out


def described(moov: bytes) -> dict:
    """A probe's content from a description."""
    head = _find(moov, "mvhd")
    seconds = _seconds(head)[1] if head else None
    return {"format": {} if seconds is None else {"duration": f"{seconds:.6f}"}, "streams": [s for n, d in _inner(moov) if n == "trak" for s in [_stream(d)] if s]}


def probe(path: str) -> str:
    """The description of one file as a probe's JSON; ValueError says what is wrong with it."""
    store, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(inner) as file:
        try:
            return json.dumps(described(description(file, file.size())))
        except (struct.error, IndexError) as error:
            raise ValueError(f"a broken description: {error}") from error
