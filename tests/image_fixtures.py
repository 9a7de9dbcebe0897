"""Images for tests."""

import struct
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of height x width (grey), x 3 (RGB) or x 4 (RGBA)."""
    a = pixels.astype(np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, c = a.shape
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image_rows(spark, images: dict[str, np.ndarray]):
    """images as the decoded form that operators take (BGR or BGRA rows)."""
    rows = []
    for name, a in images.items():
        a = a.astype(np.uint8)
        a = a[:, :, None] if a.ndim == 2 else a
        order = a if a.shape[2] == 1 else a[:, :, [2, 1, 0, *range(3, a.shape[2])]]
        rows.append((name, a.shape[1], a.shape[0], a.shape[2], order.tobytes()))
    return spark.createDataFrame(rows, "image_id string, width int, height int, n_channels int, data binary")
