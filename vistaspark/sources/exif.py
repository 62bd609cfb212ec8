"""How a JPEG's pixels are to be turned: the orientation tag of its EXIF segment."""

from __future__ import annotations

import struct

import numpy as np

_ORIENTATION, _SHORT = 0x0112, 3
#: Markers without a length: restarts and TEM.
_BARE = {0x01, *range(0xD0, 0xD8)}


def _tag(tiff: bytes) -> int:
    """Orientation in the first directory of a TIFF structure; 1 if it has none or is broken."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return 1
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    if at + 2 > len(tiff):
        return 1
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(count):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            return 1
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, entry)
        if tag == _ORIENTATION:
            (value,) = struct.unpack_from(order + "H", tiff, entry + 8)
            return value if kind == _SHORT and n == 1 and 1 <= value <= 8 else 1
    return 1


def orientation(data: bytes | None) -> int:
    """1 to 8: the orientation that a JPEG's bytes state; 1 where they state none, and for all else."""
    if not data or data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in _BARE:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tag(data[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


def upright(pixels: np.ndarray, turned: int) -> np.ndarray:
    """Pixels as they are to be seen."""
    if turned >= 5:
        pixels = pixels.transpose(1, 0, 2)
    if turned in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turned in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)
