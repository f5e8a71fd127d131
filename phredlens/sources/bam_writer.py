"""Sorted BAM files with an index, written by the executors."""

from __future__ import annotations

import pickle
import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.sources.bam import ALONG, BASES, OPS
from phredlens.sources.bam_index import BAI_DEPTH, BAI_SHIFT, LINEAR, Contig, Index, bin_of, written_index
from phredlens.sources.blocked import DATA, END, pack
from phredlens.sources.joined import write_joined

_COLUMNS = ["read_name", "flag", "mapq", "cigar", "seq", "qual", "md", "ref_start"]
_HEX = str.maketrans({c: "0123456789abcdef"[k] for k, c in enumerate(BASES)} | {c.lower(): "0123456789abcdef"[k] for k, c in enumerate(BASES)})
_QUALITIES = bytes((c - 33) % 256 for c in range(256))
_OP = re.compile("([0-9]+)([MIDNSHP=X])")
_MOST_OPS = 0xFFFF


def _record(name: str, flag: int, mapq: int, cigar: str | None, seq: str | None, qual: str | None, md: str | None, pos: int, ref: int) -> tuple[bytes, int]:
    """(bytes of a record, reference end). More operations than a record can count go to tag CG, behind a placeholder."""
    ops = [(int(n) << 4) | OPS.index(op) for n, op in _OP.findall(cigar or "")]
    along = sum(x >> 4 for x in ops if x & 15 in ALONG)
    n_seq = len(seq or "")
    tags = b"" if md is None else b"MDZ" + md.encode() + b"\0"
    if len(ops) > _MOST_OPS:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [n_seq << 4 | 4, along << 4 | 3]
    bases = bytes.fromhex((seq or "").translate(_HEX) + "0" * (n_seq % 2))
    quality = qual.encode("latin-1").translate(_QUALITIES) if qual and n_seq else b"\xff" * n_seq
    if len(quality) != n_seq:
        raise ValueError(f"read {name} has as many qualities as {len(quality)} bases, not {n_seq}")
    end = pos + max(along, 1)
    read_name = (name or "*").encode()
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(read_name) + 1, mapq, bin_of(max(pos, 0), max(end, 1)) if ref >= 0 else 4680, len(ops), flag, n_seq, -1, -1, 0)
    body = fixed + read_name + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bases + quality + tags
    return struct.pack("<i", len(body)) + body, end


def _encode(batches):
    """Blocks of the partition's records; at the end the partition's part of the index."""
    contigs: dict[int, Contig] = {}
    held, written, unplaced = bytearray(), 0, 0
    last: dict[int, tuple[int, int]] = {}

    def close(n: int) -> bytes:
        nonlocal written
        block = pack(bytes(held[:n]))
        del held[:n]
        written += len(block)
        return block

    for b in batches:
        for *fields, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
            record, end = _record(*fields, -1 if ref is None else ref)
            if len(held) + len(record) > DATA and held:
                yield close(len(held))
            begin = written << 16 | len(held)
            held += record
            while len(held) > DATA:
                yield close(DATA)
            stop = written << 16 | len(held)
            flag, pos = fields[1], fields[7]
            if ref is None:
                unplaced += 1
                continue
            c = contigs.setdefault(ref, Contig(mapped=0, unmapped=0))
            c.mapped, c.unmapped = (c.mapped, c.unmapped + 1) if flag & 4 else (c.mapped + 1, c.unmapped)
            number = bin_of(max(pos, 0), end)
            chunks = c.chunks.setdefault(number, [])
            if chunks and last.get(ref) == (number, begin):
                chunks[-1] = chunks[-1][0], stop
            else:
                chunks.append((begin, stop))
            last[ref] = number, stop
            c.linear += [0] * (((end - 1) >> LINEAR) + 1 - len(c.linear))
            for w in range(max(pos, 0) >> LINEAR, ((end - 1) >> LINEAR) + 1):
                c.linear[w] = c.linear[w] or begin + 1  # one more, so that the file's first place isn't none
    if held:
        yield close(len(held))
    return pickle.dumps((contigs, unplaced))


def _blocks(data: bytes) -> bytes:
    return b"".join(pack(data[k : k + DATA]) for k in range(0, len(data), DATA))


def write_bam(reads: DataFrame, contigs: DataFrame, path: str) -> None:
    """One BAM file at ``path``, sorted by place, and its index (``.bai``) beside it.

    Reads have the columns of alignments (md may be missing); those of no contig come last. Ranges of places are encoded
    and compressed side by side and joined by byte offsets; the parts of the index, which follow the ranges' bins, are
    merged on the driver. Mates and tags other than MD aren't kept in alignments, so they aren't written. The list of
    contigs comes to the driver. No reads, a file of a header only.
    """
    listed = contigs.orderBy("ord").collect()
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{r['name']}\tLN:{r['length']}\n" for r in listed)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(listed))
    head += b"".join(struct.pack("<i", len(r["name"]) + 1) + r["name"].encode() + b"\0" + struct.pack("<i", r["length"]) for r in listed)
    numbers = reads.sparkSession.createDataFrame([(r["name"], k) for k, r in enumerate(listed)], "chrom string, contig int")
    md = F.col("md") if "md" in reads.columns else F.lit(None).cast("string").alias("md")
    placed = reads.join(F.broadcast(numbers), "chrom", "left").select(*_COLUMNS[:6], md, "ref_start", "contig", "ord")
    order = [F.col("contig").asc_nulls_last(), F.col("ref_start"), F.col("ord")]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("ord")
    pieces = write_joined(ordered, path, _encode, _blocks(head), END)
    merged, unplaced = [Contig(mapped=0, unmapped=0) for _ in listed], 0
    for p in pieces:
        parts, n = pickle.loads(p.note)
        unplaced += n
        shift = p.start << 16
        for k, c in parts.items():
            into = merged[k]
            into.mapped, into.unmapped = into.mapped + c.mapped, into.unmapped + c.unmapped
            for number, chunks in c.chunks.items():
                into.chunks.setdefault(number, []).extend((a + shift, z + shift) for a, z in chunks)
            into.linear += [0] * (len(c.linear) - len(into.linear))
            for w, at in enumerate(c.linear):
                into.linear[w] = into.linear[w] or (at - 1 + shift if at else 0)
    Path(f"{path.removeprefix('file://')}.bai").write_bytes(written_index(Index(BAI_SHIFT, BAI_DEPTH, merged), unplaced))
