"""Blocked gzip: a file of independent compressed blocks that name their size, so it can be read from any block on."""

from __future__ import annotations

import bisect
import os
import struct
import zlib

#: The empty block that ends a file, as the format has it.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of data in a block that is written, and blocks in a row that prove a start that was searched for.
DATA, PROOF = 0xFF00, 3
_HEAD = b"\x1f\x8b\x08\x04"
_SCAN = 1 << 17


def block_size(head: bytes) -> int:
    """Size of the block with this header (its first 18 bytes or more); 0 if it is none."""
    if len(head) < 18 or head[:4] != _HEAD or head[12:16] != b"BC\x02\x00":
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


def pack(data: bytes, level: int = 6) -> bytes:
    """``data`` of at most ``DATA`` bytes as one block."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return _HEAD + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """The data of consecutive blocks in one buffer that grows at its end and is cut at its front.

    ``data`` starts at the block ``origin``; places inside are virtual offsets (block start << 16 | offset in the block).
    ``bytes_read`` counts what came from the file.
    """

    def __init__(self, path: str, start: int = 0):
        self.file = open(path, "rb")
        self.size = os.fstat(self.file.fileno()).st_size
        self.bytes_read = 0
        self.jump(start)

    def jump(self, start: int) -> None:
        """Begin anew at the block that starts at ``start``."""
        self.next, self.data, self.starts, self.ends = start, bytearray(), [], []

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        raw = self.file.read(n)
        self.bytes_read += len(raw)
        return raw

    def grow(self) -> bool:
        """Append a block; False at the end of the file."""
        if self.next >= self.size:
            return False
        head = self._read(self.next, 18)
        n = block_size(head)
        if not n:
            raise ValueError("not a blocked gzip file")
        body = self._read(self.next + 18, n - 18)
        if len(body) < n - 18:
            raise ValueError("a blocked gzip file ends inside a block")
        self.starts.append(self.next)
        self.data += zlib.decompress(body[:-8], -15)
        self.ends.append(len(self.data))
        self.next += n
        return True

    def need(self, n: int) -> bool:
        """Grow until there are ``n`` bytes of data; False if the file has fewer."""
        while len(self.data) < n:
            if not self.grow():
                return False
        return True

    def place(self, at: int) -> int:
        """Virtual offset of a byte of the buffer; that of the next block where the byte isn't loaded yet."""
        k = bisect.bisect_right(self.ends, at)
        return self.next << 16 if k == len(self.ends) else self.starts[k] << 16 | at - (self.ends[k - 1] if k else 0)

    def cut(self, at: int) -> None:
        """Forget the blocks that end at or before byte ``at``; returns nothing, but see ``offset``."""
        k = bisect.bisect_right(self.ends, at)
        gone = self.ends[k - 1] if k else 0
        del self.data[:gone], self.starts[:k], self.ends[:k]
        self.ends = [e - gone for e in self.ends]
        self.gone = gone

    def seek_block(self, start: int, stop: int) -> int | None:
        """Start of the first block in [start, stop), found by its header and by ``PROOF`` blocks that follow one another."""
        at = start
        while at < min(stop, self.size):
            raw = self._read(at, _SCAN)
            k = raw.find(_HEAD)
            while k >= 0:
                if at + k >= stop:
                    return None
                if self._proven(at + k):
                    return at + k
                k = raw.find(_HEAD, k + 1)
            at += max(len(raw) - 3, 1)
        return None

    def _proven(self, at: int) -> bool:
        for _ in range(PROOF):
            if at == self.size:
                return True
            n = block_size(self._read(at, 18))
            if not n or at + n > self.size:
                return False
            at += n
        return True


def splits(size: int, width: int) -> list[tuple[int, int]]:
    """Byte ranges of about ``width`` over a file."""
    return [(a, min(a + width, size)) for a in range(0, size, width)]
