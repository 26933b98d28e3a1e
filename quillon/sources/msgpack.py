"""MessagePack (public format): values to bytes and back."""

from __future__ import annotations

import struct
from typing import Any

from quillon.errors import BadDataError


def pack(x: Any) -> bytes:
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return struct.pack("b", x)
        return b"\xd3" + struct.pack(">q", x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        b = x.encode()
        return (bytes([0xA0 | len(b)]) if len(b) < 32 else b"\xdb" + struct.pack(">I", len(b))) + b
    if isinstance(x, (bytes, bytearray)):
        return b"\xc6" + struct.pack(">I", len(x)) + bytes(x)
    if isinstance(x, (list, tuple)):
        return (bytes([0x90 | len(x)]) if len(x) < 16 else b"\xdd" + struct.pack(">I", len(x))) + b"".join(map(pack, x))
    if isinstance(x, dict):
        return (bytes([0x80 | len(x)]) if len(x) < 16 else b"\xdf" + struct.pack(">I", len(x))) + b"".join(pack(k) + pack(v) for k, v in x.items())
    raise BadDataError(f"can't pack {type(x).__name__}")


_FIXED = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCA: ">f", 0xCB: ">d"}
_SIZED = {0xD9: (">B", "s"), 0xDA: (">H", "s"), 0xDB: (">I", "s"), 0xC4: (">B", "b"), 0xC5: (">H", "b"), 0xC6: (">I", "b"), 0xDC: (">H", "l"), 0xDD: (">I", "l"), 0xDE: (">H", "m"), 0xDF: (">I", "m")}


def _get(b: bytes, i: int) -> tuple[Any, int]:
    t = b[i]
    i += 1
    if t < 0x80:
        return t, i
    if t >= 0xE0:
        return t - 256, i
    if t in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[t], i
    if t in _FIXED:
        n = struct.calcsize(_FIXED[t])
        return struct.unpack(_FIXED[t], b[i : i + n])[0], i + n
    if t < 0x90:
        kind, n = "m", t & 15
    elif t < 0xA0:
        kind, n = "l", t & 15
    elif t < 0xC0:
        kind, n = "s", t & 31
    elif t in _SIZED:
        f, kind = _SIZED[t]
        w = struct.calcsize(f)
        n = struct.unpack(f, b[i : i + w])[0]
        i += w
    else:
        raise BadDataError("invalid packed data")
    if kind in "sb":
        raw = b[i : i + n]
        if len(raw) < n:
            raise BadDataError("packed data end too early")
        return (raw.decode() if kind == "s" else bytes(raw)), i + n
    out: list = []
    for _ in range(n * (2 if kind == "m" else 1)):
        v, i = _get(b, i)
        out.append(v)
    return (out if kind == "l" else dict(zip(out[::2], out[1::2], strict=True))), i


def unpack(b: bytes) -> Any:
    try:
        v, i = _get(bytes(b), 0)
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise BadDataError("invalid packed data") from e
    if i != len(b):
        raise BadDataError("extra data behind the value")
    return v
