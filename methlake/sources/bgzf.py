"""Block-compressed gzip: finding blocks, inflating them, and reading across them by virtual position.

A virtual position is `block_offset << 16 | offset_in_block`.
"""

from __future__ import annotations

import struct
import zlib

from methlake.sources.files import resolve

MAX_BLOCK = 1 << 16
HEADER_ROOM = 64
WINDOW = 4 << 20


class DamagedBlock(Exception):
    """A block that is cut short, does not inflate, or fails its checksum."""


def block_length(head: bytes) -> int | None:
    """Total length of the block whose header starts `head`; None when it is not a block header."""
    if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    extra_end = 12 + struct.unpack_from("<H", head, 10)[0]
    if extra_end > len(head):
        return None
    at = 12
    while at + 4 <= extra_end:
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= extra_end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class BlockFile:
    """Positioned reads over a (possibly remote) file with one read-ahead window."""

    def __init__(self, path: str):
        system, inner = resolve(path)
        self._file = system.open_input_file(inner)
        self.size = self._file.size()
        self._at, self._window = 0, b""

    def peek(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        rel = offset - self._at
        if rel < 0 or rel + n > len(self._window):
            self._window = self._file.read_at(max(n, min(WINDOW, self.size - offset)), offset)
            self._at, rel = offset, 0
        return self._window[rel : rel + n]

    def find_block(self, start: int) -> int:
        """First block at or after `start`, or the file size.

        A candidate counts only when its length lands on another block header or on the end of the file,
        which rules out look-alike bytes inside compressed data.
        """
        while start < self.size:
            window = self.peek(start, MAX_BLOCK + HEADER_ROOM)
            at = window.find(b"\x1f\x8b\x08")
            while 0 <= at <= MAX_BLOCK:
                length = block_length(window[at : at + HEADER_ROOM])
                if length:
                    after = start + at + length
                    if after == self.size or (after < self.size and block_length(self.peek(after, HEADER_ROOM))):
                        return start + at
                at = window.find(b"\x1f\x8b\x08", at + 1)
            start += MAX_BLOCK + 1
        return self.size

    def inflate(self, offset: int) -> tuple[bytes, int]:
        """Contents of the block at `offset` and the offset of the next one."""
        length = block_length(self.peek(offset, HEADER_ROOM))
        if not length:
            raise DamagedBlock(f"no block header at {offset}")
        raw = self.peek(offset, length)
        head = 12 + struct.unpack_from("<H", raw, 10)[0]
        if len(raw) < length or length < head + 8:
            raise DamagedBlock(f"truncated block at {offset}")
        crc, size = struct.unpack_from("<II", raw, length - 8)
        try:
            data = zlib.decompressobj(-15).decompress(raw[head:-8], MAX_BLOCK + 1)
        except zlib.error as e:
            raise DamagedBlock(f"block at {offset} does not inflate ({e})") from None
        if len(data) != size or zlib.crc32(data) != crc:
            raise DamagedBlock(f"checksum mismatch in the block at {offset}")
        return data, offset + length


class BlockCursor:
    """Sequential reads over the inflated stream, reporting virtual positions."""

    def __init__(self, file: BlockFile, block: int = 0):
        self.file = file
        self._block, self._next, self._data, self._pos = block, block, b"", 0

    def seek(self, virtual: int) -> None:
        block, within = virtual >> 16, virtual & 0xFFFF
        self._block, self._next, self._data, self._pos = block, block, b"", 0
        if within:
            self._data, self._next = self.file.inflate(block)
            if within > len(self._data):
                raise DamagedBlock(f"virtual position {virtual} is outside its block")
            self._pos = within

    def fill(self) -> bool:
        """Make sure unread bytes are buffered; False at the end of the file."""
        while self._pos >= len(self._data):
            if self._next >= self.file.size:
                return False
            self._block = self._next
            self._data, self._next = self.file.inflate(self._block)
            self._pos = 0
        return True

    def virtual(self) -> int:
        if self._pos >= len(self._data):
            return self._next << 16
        return self._block << 16 | self._pos

    def chunk(self) -> bytes:
        """The unread rest of the current block, consumed."""
        out, self._pos = self._data[self._pos :], len(self._data)
        return out

    def read(self, n: int) -> bytes:
        """Exactly n bytes, or fewer at the end of the file."""
        parts, missing = [], n
        while missing and self.fill():
            part = self._data[self._pos : self._pos + missing]
            self._pos += len(part)
            missing -= len(part)
            parts.append(part)
        return parts[0] if len(parts) == 1 else b"".join(parts)


def inflate_all(path: str) -> bytes:
    """A small block-compressed file (an index) as a whole."""
    cursor, parts = BlockCursor(BlockFile(path)), []
    while cursor.fill():
        parts.append(cursor.chunk())
    return b"".join(parts)
