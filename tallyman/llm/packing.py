"""Numbers and texts packed into one compressed value, so that a shuffle moves a few large rows."""

from __future__ import annotations

import io

import numpy as np
import zstandard

_writer = zstandard.ZstdCompressor(level=1)
_reader = zstandard.ZstdDecompressor()


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays are split into byte planes, which compress better than whole numbers."""
    out = io.BytesIO()
    for part in parts:
        if isinstance(part, bytes):
            kind, raw = b"bytes", part
        else:
            kind = part.dtype.str.encode()
            raw = np.ascontiguousarray(part).view(np.uint8).reshape(len(part), part.dtype.itemsize).T.tobytes()
        squeezed = _writer.compress(raw)
        out.write(np.array([len(kind), len(squeezed)], np.int64).tobytes() + kind + squeezed)
    return out.getvalue()


def unpack(value: bytes) -> list[np.ndarray | bytes]:
    parts, at = [], 0
    while at < len(value):
        kind_size, size = np.frombuffer(value, np.int64, 2, at).tolist()
        kind = value[at + 16 : at + 16 + kind_size].decode()
        raw = _reader.decompress(value[at + 16 + kind_size : at + 16 + kind_size + size])
        at += 16 + kind_size + size
        if kind == "bytes":
            parts.append(raw)
        else:
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width)
            parts.append(np.ascontiguousarray(planes.T).view(kind)[:, 0] if len(raw) else np.zeros(0, kind))
    return parts
