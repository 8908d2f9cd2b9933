"""Named arrays as one compressed value, and front-coded string lists."""

from __future__ import annotations

import io

import numpy as np
import zstandard


def pack(**arrays) -> bytes:
    """Integers go by byte planes, which suits small deltas; bytes go as they are."""
    sink = io.BytesIO()
    for name, x in arrays.items():
        if isinstance(x, bytes):
            kind, body = "b", x
        else:
            x = np.ascontiguousarray(x)
            kind, body = x.dtype.str, x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if len(x) else b""
        head = f"{name},{kind},{len(body)}".encode()
        sink.write(bytes([len(head)]) + head + body)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def unpack(data: bytes) -> dict:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), {}, 0
    while at < len(raw):
        name, kind, n = raw[at + 1 : at + 1 + raw[at]].decode().split(",")
        at += 1 + raw[at]
        body = raw[at : at + int(n)]
        at += int(n)
        if kind == "b":
            out[name] = body
        else:
            size = np.dtype(kind).itemsize
            out[name] = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return out
