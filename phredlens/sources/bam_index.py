"""Indexes of alignment files: bins and linear offsets to file chunks, and the counts they keep."""

from __future__ import annotations

import gzip
import os
import struct
from dataclasses import dataclass, field

# Fixed values of the layouts: smallest bin and depth of the plain kind, and its linear window.
BAI_SHIFT, BAI_DEPTH, LINEAR = 14, 5, 14


@dataclass
class Contig:
    chunks: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by bin: virtual offsets [begin, end)
    linear: list[int] = field(default_factory=list)  # by window: the first record that overlaps it
    first: dict[int, int] = field(default_factory=dict)  # by bin: the first record that overlaps it (binned kind)
    mapped: int | None = None
    unmapped: int | None = None


@dataclass
class Index:
    shift: int
    depth: int
    contigs: list[Contig]

    def chunks(self, contig: int, start: int, stop: int) -> list[tuple[int, int]]:
        """Merged file ranges that hold every record overlapping [start, stop) of a contig."""
        if contig >= len(self.contigs) or start >= stop:
            return []
        c = self.contigs[contig]
        # The coordinate space ends where the top bin does.
        top = 1 << (self.shift + 3 * self.depth)
        start, stop = max(0, min(start, top - 1)), max(1, min(stop, top))
        least = 0
        if c.linear:
            least = c.linear[min(start >> LINEAR, len(c.linear) - 1)]
        found = []
        for level in range(self.depth + 1):
            offset, width = ((1 << 3 * level) - 1) // 7, self.shift + 3 * (self.depth - level)
            for b in range(offset + (start >> width), offset + ((stop - 1) >> width) + 1):
                found += [x for x in c.chunks.get(b, ()) if x[1] > least]
        merged: list[tuple[int, int]] = []
        for a, z in sorted(found):
            a = max(a, least)
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(z, merged[-1][1])
            else:
                merged.append((a, z))
        return merged

    def starts(self) -> list[int]:
        """Virtual offsets of record starts that the index names, ascending."""
        return sorted({a for c in self.contigs for x in c.chunks.values() for a, _ in x})


def index_of(path: str) -> str | None:
    """Path of the index beside an alignment file, or None."""
    return next((p for p in (path + ".bai", os.path.splitext(path)[0] + ".bai", path + ".csi") if os.path.exists(p)), None)


def read_index(path: str) -> Index:
    """An index of either kind; the binned kind (``.csi``) is compressed and says how deep its bins are."""
    with open(path, "rb") as f:
        raw = f.read()
    at, shift, depth, binned = 4, BAI_SHIFT, BAI_DEPTH, raw[:4] != b"BAI\1"
    if binned:
        raw = gzip.decompress(raw)
        if raw[:4] != b"CSI\1":
            raise ValueError(f"{path} is no index")
        shift, depth, more = struct.unpack_from("<iii", raw, 4)
        at = 16 + more
    summary = ((1 << 3 * (depth + 1)) - 1) // 7 + 1
    n_contigs = struct.unpack_from("<i", raw, at)[0]
    at += 4
    contigs = []
    for _ in range(n_contigs):
        c = Contig()
        n_bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(n_bins):
            number = struct.unpack_from("<I", raw, at)[0]
            at += 4
            if binned:
                c.first[number] = struct.unpack_from("<Q", raw, at)[0]
                at += 8
            n_chunks = struct.unpack_from("<i", raw, at)[0]
            pairs = struct.unpack_from(f"<{2 * n_chunks}Q", raw, at + 4)
            at += 4 + 16 * n_chunks
            if number == summary:  # the second pair is of counts
                c.mapped, c.unmapped = pairs[2:4] if n_chunks > 1 else (None, None)
            else:
                c.chunks[number] = list(zip(pairs[::2], pairs[1::2], strict=True))
        if not binned:
            n = struct.unpack_from("<i", raw, at)[0]
            c.linear = list(struct.unpack_from(f"<{n}Q", raw, at + 4))
            at += 4 + 8 * n
        contigs.append(c)
    return Index(shift, depth, contigs)


def bin_of(start: int, stop: int) -> int:
    """The smallest bin of the plain kind that holds [start, stop)."""
    stop = max(stop, start + 1) - 1
    for level in range(BAI_DEPTH, -1, -1):
        width = BAI_SHIFT + 3 * (BAI_DEPTH - level)
        if start >> width == stop >> width:
            return ((1 << 3 * level) - 1) // 7 + (start >> width)
    return 0


def written_index(index: Index, unplaced: int) -> bytes:
    """The plain kind (``.bai``) as bytes, counts of each contig included."""
    summary = ((1 << 3 * (BAI_DEPTH + 1)) - 1) // 7 + 1
    out = [b"BAI\1", struct.pack("<i", len(index.contigs))]
    for c in index.contigs:
        bins = sorted(c.chunks.items())
        spans = [x for _, v in bins for x in v]
        out.append(struct.pack("<i", len(bins) + bool(bins)))
        for number, chunks in bins:
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks))
        if bins:
            out.append(struct.pack("<IiQQQQ", summary, 2, min(a for a, _ in spans), max(z for _, z in spans), c.mapped or 0, c.unmapped or 0))
        filled, last = [], 0
        for x in c.linear:
            last = x or last
            filled.append(last)
        out.append(struct.pack("<i", len(filled)) + struct.pack(f"<{len(filled)}Q", *filled))
    return b"".join(out) + struct.pack("<Q", unplaced)
