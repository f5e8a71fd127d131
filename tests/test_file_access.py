"""Access by index and by splits, files joined from partitions, tiles by byte ranges."""

import struct

import numpy as np
import pytest

from phredlens.operators import alignments as al
from phredlens.operators import statistics
from phredlens.schemas import ALIGNMENTS, CONTIGS, REFERENCE
from phredlens.sources import bam, bam_index, bcf, blocked, blocked_text, fasta, sinks, text
from phredlens.sources.bam_writer import write_bam
from tests.test_operators import dataset
from tests.test_sources_and_reports import bam_bytes, block


def whole(parts, counted=None):
    return [tuple(r.values()) for p in parts if p.path for b in bam.records(p, "t", counted) for r in b.to_pylist()]


def reader(path, **options):
    return bam.Reader({"path": str(path), "technology": "t", **{k: str(v) for k, v in options.items()}})


def test_records_are_found_from_any_split(tmp_path):
    ref, reads = dataset(n=600)
    data, offsets = bam_bytes(reads, [(n, len(s)) for n, s in ref.items()])
    (tmp_path / "a.bam").write_bytes(data)
    one = whole(reader(tmp_path / "a.bam").partitions())
    assert [r[9] for r in one] == offsets
    for width in (len(data) // 40, 3000, 701):
        parts = reader(tmp_path / "a.bam", split=width).partitions()
        assert len(parts) == -(-len(data) // width) and whole(parts) == one


def test_a_split_without_a_record_is_empty(tmp_path):
    """One record covers many blocks and splits."""
    rows = [("a", 0, "c", 1, 9, "3M", "ACG", "III", "3", 0, "t"), ("b", 0, "c", 2, 9, "9000M", "ACG" * 3000, "I" * 9000, "9000", 0, "t"), ("d", 0, "c", 3, 9, "3M", "ACG", "III", "3", 0, "t")]
    data, _ = bam_bytes(rows, [("c", 100_000)])
    (tmp_path / "a.bam").write_bytes(data)
    assert [r[0] for r in whole(reader(tmp_path / "a.bam", split=300).partitions())] == ["a", "b", "d"]


def test_what_is_no_bam_file_is_an_error(tmp_path):
    for k, raw in enumerate((b"text", block(b"VCF"), block(b"BAM\1")[:30])):
        (tmp_path / f"{k}.bam").write_bytes(raw)
        with pytest.raises(ValueError, match="BAM|gzip"):
            whole(reader(tmp_path / f"{k}.bam").partitions())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A written file of many ranges, with a read of 70,000 operations and one of no contig, and its rows."""
    folder = tmp_path_factory.mktemp("bam")
    ref, reads = dataset(n=700)
    ref = ref | {"chrEnd": "ACGT" * 20_000}
    reads += [("long", 16, "chrEnd", 5, 60, "1M1I" * 35_000, "AC" * 35_000, "II" * 35_000, None, 10_000, "t"), ("none", 4, None, -1, 0, None, "ACG", "#II", None, 10_001, "t")]
    frame = spark.createDataFrame(reads, ALIGNMENTS)
    contigs = spark.createDataFrame([(k, n, len(s)) for k, (n, s) in enumerate(ref.items())], CONTIGS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_bam(frame, contigs, str(folder / "x.bam"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return folder / "x.bam", ref, reads, frame, contigs


def test_a_written_bam_file_has_the_same_rows_in_order(spark, written):
    path, ref, reads, frame, contigs = written
    got = whole(reader(path).partitions())
    want = [(*r[:7], r[7] if r[6] else None, r[8]) for r in reads]
    assert sorted(map(str, (r[:9] for r in got))) == sorted(map(str, want))
    names = [*ref, None]
    places = [(names.index(r[2]), r[3]) for r in got]
    assert places == sorted(places) and [r[9] for r in got] == sorted(r[9] for r in got)
    assert next(r[5] for r in got if r[0] == "long") == "1M1I" * 35_000
    assert path.read_bytes().endswith(blocked.END)
    bam.register(spark)
    loaded = spark.read.format("bam").option("technology", "t").option("split", 4000).load(str(path))
    assert sorted(map(str, (tuple(r)[:9] for r in loaded.collect()))) == sorted(map(str, want))


def test_regions_read_their_chunks_only(spark, written):
    path, ref, _, frame, _ = written
    names = list(ref)
    for regions in ([(names[1], 100, 160)], [(names[0], 100, 400), (names[0], 350, 700), (names[1], 0, 60)], [("chrEnd", 30_000, 30_001)], [("nowhere", 0, 9)]):
        rows = spark.createDataFrame([(k, *r) for k, r in enumerate(regions)], "region_ord int, chrom string, start int, stop int")
        want = sorted({(r.read_name, r.flag, r.ref_start) for r in al.reads_in_regions(frame.where("cigar is not null"), rows).collect()})
        got = bam.reads_of_regions(spark, str(path), regions).select("read_name", "flag", "ref_start").collect()
        assert sorted(map(tuple, got)) == want


def test_predicates_choose_chunks(spark, written):
    path, ref, _, frame, _ = written
    name = list(ref)[1]
    bam.register(spark)
    where = f"chrom = '{name}' and ref_start >= 300 and ref_start < 500"
    got = spark.read.format("bam").load(str(path)).where(where)
    assert sorted(r.read_name for r in got.collect()) == sorted(r.read_name for r in frame.where(where).collect())
    r = reader(path)
    pushed = [bam.EqualTo(("chrom",), name), bam.GreaterThanOrEqual(("ref_start",), 300), bam.LessThan(("ref_start",), 500)]
    assert list(r.pushFilters(pushed)) == pushed and r.window == ([name], 300, 499)
    r.pushFilters([bam.In(("chrom",), ("nowhere",))])
    assert whole(r.partitions()) == []


def test_a_region_of_a_wide_file_reads_little(spark, tmp_path):
    rng = np.random.default_rng(1)
    letters = lambda a, n: "".join(chr(c) for c in rng.choice(np.frombuffer(a, np.uint8), n))
    rows = [(f"r{k}", 0, "c", k * 130, 60, "100M", letters(b"ACGT", 100), letters(bytes(range(35, 74)), 100), None, k, "t") for k in range(3000)]
    path = tmp_path / "w.bam"
    write_bam(spark.createDataFrame(rows, ALIGNMENTS), spark.createDataFrame([(0, "c", 400_000)], CONTIGS), str(path))
    by_region, by_predicate = reader(path, regions="c:200001-200300"), reader(path)
    by_predicate.pushFilters([bam.EqualTo(("chrom",), "c"), bam.GreaterThan(("ref_start",), 199_900), bam.LessThan(("ref_start",), 200_300)])
    for r in (by_region, by_predicate):
        counted: list[int] = []
        found = [x for x in whole(r.partitions(), counted) if x[3] + 100 > 200_000 and x[3] < 200_300]
        assert [x[0] for x in found] == [x[0] for x in rows if x[3] + 100 > 200_000 and x[3] < 200_300]
        assert sum(counted) < path.stat().st_size / 2


def test_counts_come_from_the_index(spark, written, tmp_path, monkeypatch):
    path, _, _, frame, contigs = written
    want = [tuple(r) for r in statistics.mapped_counts(frame, contigs).orderBy("ord").collect()]
    (tmp_path / "bare.bam").write_bytes(path.read_bytes())
    assert [tuple(r) for r in bam.indexed_counts(spark, str(tmp_path / "bare.bam")).collect()] == want  # no index: a scan
    monkeypatch.setattr(bam, "records", None)
    assert [tuple(r) for r in bam.indexed_counts(spark, str(path)).orderBy("ord").collect()] == want


def test_binned_index(tmp_path):
    """The compressed kind tells its bins' width and depth; bins, chunks and counts are as in the plain kind."""
    first = struct.pack("<IQi", 4681, 7 << 16, 2) + struct.pack("<QQQQ", 7 << 16, 9 << 16, 9 << 16, 11 << 16)
    summary = struct.pack("<IQi", 37450, 0, 2) + struct.pack("<QQQQ", 7 << 16, 11 << 16, 5, 1)
    (tmp_path / "a.csi").write_bytes(block(b"CSI\1" + struct.pack("<iii", 14, 5, 2) + b"xx" + struct.pack("<ii", 1, 2) + first + summary) + block(b""))
    index = bam_index.read_index(str(tmp_path / "a.csi"))
    assert index.chunks(0, 0, 100) == [(7 << 16, 11 << 16)] and index.chunks(0, 20_000, 20_001) == [] and index.chunks(3, 0, 9) == []
    assert (index.contigs[0].mapped, index.contigs[0].unmapped) == (5, 1) and index.starts() == [7 << 16, 9 << 16]


@pytest.mark.parametrize("start,stop", [(0, 1), (0, 16_384), (16_383, 16_385), (131_071, 131_073), (0, 1 << 29)])
def test_bins_hold_their_interval(start, stop):
    """The bin of an interval is among the bins that a look-up of any place inside it reads."""
    b = bam_index.bin_of(start, stop)
    index = bam_index.Index(14, 5, [bam_index.Contig(chunks={b: [(1, 2)]})])
    for at in (start, (start + stop) // 2, stop - 1):
        assert index.chunks(0, at, at + 1) == [(1, 2)]


@pytest.mark.parametrize("n", [1, 7, 40])
def test_joined_csv_has_the_bytes_of_one_writer(spark, tmp_path, n):
    rows = spark.range(500).selectExpr("id", "id / 7e9 as d", "id % 2 = 0 as b", "if(id % 3 > 0, concat('a,\"b ', id), null) as s", "'' as e", "if(id = 4, 'x\\r\\ny', 'é') as t")
    sinks.write_csv_file(rows.orderBy("id"), tmp_path / "one.csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        ordered = rows.repartition(3).orderBy("id")
        sinks.write_csv_joined(ordered, tmp_path / "joined.csv")
        sinks.write_csv_parts(ordered.drop("t"), f"file://{tmp_path}/parts")
        sinks.write_csv_joined(ordered.where("id < 0"), tmp_path / "empty.csv")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = (tmp_path / "one.csv").read_bytes()
    assert (tmp_path / "joined.csv").read_bytes() == want and (tmp_path / "empty.csv").read_bytes() == want.split(b"\r\n")[0] + b"\r\n"
    sinks.write_csv_file(rows.drop("t").orderBy("id"), tmp_path / "one.csv")
    head, *lines = (tmp_path / "one.csv").read_bytes().split(b"\r\n")
    files = sorted((tmp_path / "parts").glob("part-*.csv"))
    assert [x for f in files for x in f.read_bytes().split(b"\r\n")[1:] if x] == lines[:-1] and all(f.read_bytes().startswith(head) for f in files)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty.csv", "joined.csv", "one.csv", "parts"]


def test_a_joined_file_survives_a_task_that_runs_twice(spark, tmp_path):
    """A task that fails after it wrote leaves a piece that nothing reads."""
    from phredlens.sources.joined import write_joined

    def encode(batches):
        for b in batches:
            yield b"".join(b"%d\n" % x for x in b.column(0).to_pylist())

    pieces = write_joined(spark.range(0, 1000, 1, 4), str(tmp_path / "x"), encode, b"head\n", b"tail\n")
    assert (tmp_path / "x").read_text().split() == ["head", *map(str, range(1000)), "tail"]
    assert [p.start for p in pieces] == list(np.cumsum([5, *(p.size for p in pieces[:-1])]))

    def fails(batches):
        yield from encode(batches)
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        write_joined(spark.range(9), str(tmp_path / "x"), fails)
    assert (tmp_path / "x").read_text().startswith("head") and [p.name for p in tmp_path.iterdir()] == ["x"]


def test_signs_in_descriptions(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 has A>G in its note\nACGT\nAC\n>chr2 >> x\r\nGG\r\nTT\r\n>chr3\n>chr4\nA\n")
    rows = text.read_fasta(spark, str(tmp_path / "r.fa")).orderBy("ord").collect()
    assert [(r.chrom, r.seq) for r in rows] == [("chr1", "ACGTAC"), ("chr2", "GGTT"), ("chr3", ""), ("chr4", "A")]


@pytest.mark.parametrize("tile,split", [(7, 7), (7, 50), (64, 1 << 20), (1024, 1 << 20)])
def test_tiles_by_byte_ranges(spark, tmp_path, tile, split):
    ref, _ = dataset(n=10)
    ref = ref | {"short": "acgtn"}
    lines, index, at = [], [], 0
    for name, seq in ref.items():
        head = f">{name} a > b\n"
        body = "".join(seq[k : k + 60] + "\n" for k in range(0, len(seq), 60))
        index.append(f"{name}\t{len(seq)}\t{at + len(head)}\t60\t61\n")
        at += len(head) + len(body)
        lines += [head, body]
    (tmp_path / "r.fa").write_text("".join(lines))
    (tmp_path / "r.fa.fai").write_text("".join(index))
    key = lambda df: sorted((r.chrom, r.tile_id, bytes(r.ref_tile)) for r in df.collect())
    got = fasta.read_tiles(spark, str(tmp_path / "r.fa"), tile, split)
    assert key(got) == key(al.reference_tiles(spark.createDataFrame(list(ref.items()), REFERENCE), tile))
    assert [(r.name, r.length) for r in fasta.indexed_contigs(spark, str(tmp_path / "r.fa")).collect()] == [(n, len(s)) for n, s in ref.items()]


def test_a_long_contig_is_read_in_many_tasks():
    entry = fasta.Entry("chr1", 300_000_000, 6, 60, 61)
    parts = fasta.parts([entry, fasta.Entry("a", 10, 0, 60, 61), fasta.Entry("b", 10, 0, 60, 61)], al.TILE, fasta.SPLIT)
    assert len(parts) == 9 and [s for p in parts for _, s, _ in p.spans][:2] == [0, 32 << 20]
    assert sum(z - a for p in parts for _, a, z in p.spans) == 300_000_020


def test_an_index_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c\nACGT\n")
    (tmp_path / "r.fa.fai").write_text("c\t40\t3\t60\t61\n")
    with pytest.raises(Exception, match="doesn't fit"):
        fasta.read_tiles(spark, str(tmp_path / "r.fa")).collect()


@pytest.mark.parametrize("ended", [True, False])
def test_blocked_text_in_any_splits(tmp_path, ended):
    """Blocks cut lines anywhere, also at a line break; some lines cover splits."""
    rng = np.random.default_rng(2)
    want = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(0, 60, 400)] + ["x" * 9000, "", "é", "y" * 3000, "end"]
    raw = "\n".join(want).encode() + b"\n" * ended
    cuts = sorted({0, len(raw), *rng.integers(0, len(raw), 90).tolist(), *(k + 1 for k in range(0, len(raw), 300) if raw[k : k + 1] == b"\n")})
    data = b"".join(blocked.pack(raw[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)) + blocked.END
    (tmp_path / "t.gz").write_bytes(data)
    for width in (1 << 20, 2000, 333, 60):
        parts = blocked_text.Reader({"path": str(tmp_path / "t.gz"), "split": str(width)}).partitions()
        got = [x.decode() for p in parts for found in blocked_text.lines(p) for x in found]
        assert got == want, width
    assert blocked_text.is_blocked(str(tmp_path / "t.gz")) and not blocked_text.is_blocked(str(tmp_path / "none"))


def test_blocked_variants_and_reads_in_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocked_text, "SPLIT", 700)
    rows = [("c1", k + 1, ".", "A", "G,T", None if k % 3 else 30.5, "PASS") for k in range(900)]
    vcf = "##x\n#CHROM\tPOS\n" + "".join(f"{c}\t{p}\t{i}\t{r}\t{a}\t{'.' if q is None else q}\t{f}\t.\n" for c, p, i, r, a, q, f in rows)
    reads = [(f"r{k}", "ACGT" * (k % 9 + 1), "@III" * (k % 9 + 1)) for k in range(500)]
    fastq = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in reads)
    for name, body in (("v.vcf.gz", vcf), ("r.fastq.gz", fastq)):
        raw = body.encode()
        (tmp_path / name).write_bytes(b"".join(blocked.pack(raw[k : k + 501]) for k in range(0, len(raw), 501)) + blocked.END)
    found = text.read_vcf(spark, str(tmp_path / "v.vcf.gz"))
    assert found.rdd.getNumPartitions() > 5 and sorted(map(tuple, found.collect()), key=lambda r: r[1]) == rows
    assert sorted(map(tuple, text.read_fastq(spark, str(tmp_path / "r.fastq.gz")).collect())) == sorted(reads)


def variant_bytes(n, samples=2, seed=7):
    """(a binary variant file of ``n`` records, its rows). Blocks cut header and records anywhere; some records span many blocks,
    and fields after the shared ones hold bytes that look like heads of records."""
    rng = np.random.default_rng(seed)
    sample = "".join(f"\ts{k}" for k in range(samples))
    head = f'##FILTER=<ID=PASS,Description="ok">\n##FILTER=<ID=Low,Description="x">\n##contig=<ID=c1>\n##contig=<ID=c2>\n{"##filler=1" * 200}\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT{sample}\n\0'.encode()
    string = lambda s: (bytes([len(s) << 4 | 7]) if len(s) < 15 else b"\xf7\x12" + struct.pack("<H", len(s))) + s.encode()
    body, rows = b"", []
    for k in range(n):
        ref = "".join("ACGT"[c] for c in rng.integers(0, 4, 3000 if k % 97 == 5 else rng.integers(1, 20)))
        chrom, name, quality, low = int(rng.integers(0, 2)), f"rs{k}" if k % 3 else "", None if k % 4 else 30.5, k % 5 == 0
        shared = struct.pack("<iii", chrom, k - 1, len(ref)) + (struct.pack("<I", 0x7F800001) if quality is None else struct.pack("<f", quality)) + struct.pack("<HHI", 0, 2, 1 << 24 | samples)
        shared += string(name) + string(ref) + string("A") + bytes([0x11, int(low)])
        fake = struct.pack("<IIiiiIHHI", 40, 9, 0, 5, 1, 0, 0, 1, samples) + b"\x17A" * 30
        single = fake * 2 if k % 7 == 0 else rng.integers(0, 256, rng.integers(0, 90)).astype(np.uint8).tobytes()
        body += struct.pack("<II", len(shared), len(single)) + shared + single
        rows.append((f"c{chrom + 1}", k, name or ".", ref, "A", quality, "Low" if low else "PASS"))
    raw = b"BCF\2\2" + struct.pack("<I", len(head)) + head + body
    cuts = sorted({0, len(raw), *rng.integers(0, len(raw), len(raw) // 400).tolist()})
    return b"".join(blocked.pack(raw[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)) + blocked.END, rows


@pytest.mark.parametrize("samples", [0, 2])
def test_binary_variants_in_any_splits(tmp_path, samples):
    data, rows = variant_bytes(600, samples)
    (tmp_path / "v.bcf").write_bytes(data)
    for width in (1 << 24, 9000, 2000, 333, 60):
        parts = bcf.Reader({"path": str(tmp_path / "v.bcf"), "split": str(width)}).partitions()
        each = [[r for found in bcf.records(p) for r in found] for p in parts]
        assert [r for p in each for r in p] == rows, width
    assert sum(map(bool, each)) > 100


def test_binary_variants_without_records(tmp_path):
    data, _ = variant_bytes(0)
    (tmp_path / "v.bcf").write_bytes(data)
    for width in (1 << 24, 100):
        assert [r for p in bcf.Reader({"path": str(tmp_path / "v.bcf"), "split": str(width)}).partitions() for r in bcf.records(p)] == []
    (tmp_path / "v.bcf").write_bytes(b"")
    with pytest.raises(ValueError, match="binary variant file"):
        [*bcf.records(bcf.Reader({"path": str(tmp_path / "v.bcf")}).partitions()[0])]


def test_binary_variants_are_read_in_many_tasks(spark, tmp_path, monkeypatch):
    data, rows = variant_bytes(400)
    (tmp_path / "v.bcf").write_bytes(data)
    monkeypatch.setattr(bcf, "SPLIT", 4000)
    monkeypatch.setattr(bcf, "DECODED", 1000)
    found = text.read_vcf(spark, str(tmp_path / "v.bcf"))
    assert found.rdd.getNumPartitions() > 5 and sorted(map(tuple, found.collect()), key=lambda r: r[1]) == rows
