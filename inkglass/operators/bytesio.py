"""Bounded reading of bytes, for walkers."""

from __future__ import annotations

import signal
import struct
import threading
import zlib
from contextlib import contextmanager


class LimitError(Exception):
    """A read outside the bytes."""


FORMS = {(little, kind): struct.Struct(("<" if little else ">") + kind) for little in (False, True) for kind in "bBhHiIqQfd"}


class Reader:
    """Reads numbers and slices of a buffer; a read outside it raises LimitError."""

    def __init__(self, data, little: bool = False):
        self.data, self.little = memoryview(data), little

    def has(self, at: int, n: int) -> bool:
        return 0 <= at and at + n <= len(self.data)

    def take(self, at: int, n: int) -> bytes:
        if n < 0 or not self.has(at, n):
            raise LimitError
        return bytes(self.data[at : at + n])

    def number(self, at: int, kind: str) -> int:
        form = FORMS[self.little, kind]
        if not self.has(at, form.size):
            raise LimitError
        return form.unpack_from(self.data, at)[0]

    def u8(self, at: int) -> int:
        return self.number(at, "B")

    def u16(self, at: int) -> int:
        return self.number(at, "H")

    def u32(self, at: int) -> int:
        return self.number(at, "I")

    def i32(self, at: int) -> int:
        return self.number(at, "i")


def inflate(data: bytes, most: int, raw: bool = False) -> tuple[bytes, bool, bool]:
    """(bytes, truncated at `most`, error). Exactly `most` bytes are not truncated."""
    stream = zlib.decompressobj(-15 if raw else 15)
    try:
        out = stream.decompress(data, most + 1)
    except zlib.error:
        # what came before the fault, in small steps
        stream, out = zlib.decompressobj(-15 if raw else 15), b""
        try:
            for k in range(0, len(data), 64):
                out += stream.decompress(data[k : k + 64], max(1, most + 1 - len(out)))
                if len(out) > most:
                    break
        except zlib.error:
            pass
        return out[:most], len(out) > most, True
    return out[:most], len(out) > most, not stream.eof and len(out) <= most


def latin1(data: bytes) -> str:
    return data.decode("latin-1")


def utf8(data: bytes) -> str:
    """Lenient; a byte-order mark at the start is dropped."""
    return data.decode("utf-8-sig", "replace") if data[:3] == b"\xef\xbb\xbf" else data.decode("utf-8", "replace")


class TimeLimitError(Exception):
    """A file took longer than its time."""


@contextmanager
def time_limit(seconds: float):
    """Ends what runs inside after so many seconds, in the main thread of a worker (elsewhere there is no limit)."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeLimitError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class Findings:
    """Findings and coverage rows of one file, in the order in which they are made."""

    def __init__(self):
        self.rows: list[dict] = []
        self.areas: list[tuple[str, str, str]] = []

    def add(self, code: str, source: str, value=None, at: tuple[int, int] | None = None, path: str | None = None, **more) -> None:
        row = {"code": code, "source": source, "value": None if value is None else str(value), "kind": "bytes" if at else "structure" if path else "none", "offset": at[0] if at else None, "length": at[1] if at else None, "path": path}
        self.rows.append(row | more)

    def cover(self, area: str, state: str, note: str = "") -> None:
        self.areas.append((area, state, note))
