"""Readers, writers, the BAM source, workflows, generators, streaming, adapters and the command line."""

import gzip
import random
import re
import struct
import zlib
from contextlib import contextmanager

import pytest

from phredlens import cli, external, simulate
from phredlens.operators import alignments as al
from phredlens.operators import pileup
from phredlens.operators import variants as var
from phredlens.plans import fixture, report
from phredlens.schemas import ALIGNMENTS, MISMATCHES, REFERENCE
from phredlens.sources import bam, sinks, text
from phredlens.streaming import extraction, histogram
from tests.test_operators import dataset, walker


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def bam_bytes(reads, contigs):
    """(file, virtual offsets of the records), in small blocks that cut records."""
    import re

    names = [n for n, _ in contigs]
    raw = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in contigs)
    starts = []
    for name, flag, chrom, start, mapq, cigar, seq, qual, md, _, _ in reads:
        seq = seq or ""
        qual = (qual or "\xff" * len(seq)) if seq else ""
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        ops = [(int(n) << 4) | "MIDNSHP=X".index(op) for n, op in re.findall(r"(\d+)([A-Z=])", cigar)]
        tags = b"NMC\1" + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"MDZ" + md.encode() + b"\0" + b"XFf" + struct.pack("<f", 1.5)
        body = struct.pack("<iiBBHHHiiii", names.index(chrom), start, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(255 if q == "\xff" else ord(q) - 33 for q in qual) + tags
        starts.append(len(raw))
        raw += struct.pack("<i", len(body)) + body
    out, place = b"", []
    for i in range(0, len(raw), 777):
        place.append(len(out))
        out += block(raw[i : i + 777])
    return out + block(b""), [place[s // 777] << 16 | s % 777 for s in starts]


@pytest.mark.parametrize("indexed", [False, True])
def test_bam_source_equals_the_rows(spark, tmp_path, monkeypatch, indexed):
    ref, reads = dataset(n=120)
    contigs = [(n, len(s)) for n, s in ref.items()]
    data, offsets = bam_bytes(reads, contigs)
    (tmp_path / "a.bam").write_bytes(data)
    if indexed:
        monkeypatch.setattr(bam, "SPLIT", 500)
        chunks = b"".join(struct.pack("<QQ", offsets[k], offsets[k + 30] if k + 30 < len(offsets) else offsets[-1]) for k in range(0, 120, 30))
        (tmp_path / "a.bam.bai").write_bytes(b"BAI\1" + struct.pack("<iiIi", 1, 1, 0, 4) + chunks + struct.pack("<i", 0))
        assert len(bam.Reader({"path": str(tmp_path / "a.bam")}).partitions()) > 4
    bam.register(spark)
    rows = spark.read.format("bam").option("technology", "t").load(str(tmp_path / "a.bam")).orderBy("ord").collect()
    want = [(*r[:6], r[6], r[7] if r[6] else None, r[8]) for r in reads]
    assert [tuple(r)[:9] for r in rows] == want
    assert [(r.name, r.length) for r in bam.bam_contigs(spark, str(tmp_path / "a.bam")).collect()] == contigs


def test_text_readers(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 first\nACgt\nNN\n>c2\nA\n")
    assert [(r.chrom, r.seq) for r in text.read_fasta(spark, str(tmp_path / "r.fa")).orderBy("ord").collect()] == [("c1", "ACgtNN"), ("c2", "A")]
    (tmp_path / "r.fa.fai").write_text("c1\t6\t10\t4\t5\nc2\t1\t22\t1\t2\n")
    assert [tuple(r) for r in text.read_fai(spark, str(tmp_path / "r.fa.fai")).collect()] == [(0, "c1", 6), (1, "c2", 1)]
    with gzip.open(tmp_path / "x.fq.gz", "wt") as f:
        f.write("@a 1\nACGT\n+\nIIII\n@b\nAC\n+b\nII\n")
    assert sorted(tuple(r) for r in text.read_fastq(spark, str(tmp_path / "x.fq.gz")).collect()) == [("a", "ACGT", "IIII"), ("b", "AC", "II")]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\nc1\t5\t.\tA\tG,T\t.\tPASS\t.\nc1\t7\t.\tAC\tA\t30.5\tLowQual\t.\n")
    assert [tuple(r) for r in text.read_vcf(spark, str(tmp_path / "v.vcf")).collect()] == [("c1", 5, ".", "A", "G,T", None, "PASS"), ("c1", 7, ".", "AC", "A", 30.5, "LowQual")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq\t16\tc1\t3\t60\t4M\t*\t0\t0\tACGT\t*\tNM:i:0\tMD:Z:4\n")
    assert tuple(text.read_sam(spark, str(tmp_path / "a.sam"), "t").first())[:9] == ("q", 16, "c1", 2, 60, "4M", "ACGT", None, "4")


@contextmanager
def small_splits(spark, size):
    """Files are read in splits of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_reference_of_many_splits(spark, tmp_path):
    rng = random.Random(4)
    contigs = [(f"c{k}", "".join(rng.choice("ACGTn") for _ in range(rng.randint(0, 400)))) for k in range(60)]
    (tmp_path / "r.fa").write_text("".join(f">{n} about\n" + "".join(s[i : i + 70] + "\n" for i in range(0, len(s), 70)) for n, s in contigs))
    (tmp_path / "r.fai").write_text("".join(f"{n}\t{len(s)}\t0\t70\t71\n" for n, s in contigs))
    with small_splits(spark, 1000):
        found = text.read_fasta(spark, str(tmp_path / "r.fa"))
        assert found.rdd.getNumPartitions() > 5
        assert [(r.chrom, r.seq) for r in found.orderBy("ord").collect()] == contigs
        want = [(k, n, len(s)) for k, (n, s) in enumerate(contigs)]
        assert sorted(tuple(r) for r in text.contigs_of(found).collect()) == want
    with small_splits(spark, 100):
        assert sorted(tuple(r) for r in text.read_fai(spark, str(tmp_path / "r.fai")).collect()) == want


def test_qualities_may_begin_like_names(spark, tmp_path):
    rng = random.Random(5)
    records = []
    for k in range(300):
        n = rng.randint(0, 60)
        records.append((f"r{k}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@@+I#") for _ in range(n))))
    for end in ("\n", "\r\n"):
        (tmp_path / "x.fq").write_text("".join(f"@{a} x{end}{b}{end}+{end}{c}{end}" for a, b, c in records) + "\n", newline="")
        for size in (97, 1000, 1 << 20):
            with small_splits(spark, size):
                assert sorted(tuple(r) for r in text.read_fastq(spark, str(tmp_path / "x.fq")).collect()) == sorted(records)
    for wrong in ("@a\nAC\n+\nI\n", "@a\nAC\nII\n", "a\nAC\n+\nII\n", "@a\nAC\n-\nII\n"):
        (tmp_path / "x.fq").write_text(wrong)
        with pytest.raises(Exception, match="four lines"):
            text.read_fastq(spark, str(tmp_path / "x.fq")).collect()
    (tmp_path / "x.fq").write_text("")
    assert text.read_fastq(spark, str(tmp_path / "x.fq")).count() == 0


def test_binary_variants(spark, tmp_path):
    header = b'##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description="ok">\n##FILTER=<ID=LowQual,Description="x">\n##contig=<ID=c1,length=9>\n##contig=<ID=c2>\n#CHROM\n\0'
    string = lambda s: (bytes([len(s) << 4 | 7]) if len(s) < 15 else b"\xf7\x11" + bytes([len(s)])) + s.encode()

    def record(chrom, pos, quality, name, alleles, filters):
        shared = struct.pack("<iii", chrom, pos - 1, len(alleles[0])) + (struct.pack("<I", 0x7F800001) if quality is None else struct.pack("<f", quality)) + struct.pack("<HHI", 0, len(alleles), 0)
        shared += string(name) + b"".join(map(string, alleles)) + (bytes([len(filters) << 4 | 1, *filters]) if filters else b"\0")
        return struct.pack("<II", len(shared), 3) + shared + b"abc"

    body = record(0, 5, None, "", ["A", "G", "T"], [0]) + record(1, 70_000, 30.5, "rs1", ["A" * 20, "A"], [1]) + record(1, 3, 1.0, "", ["C"], [])
    (tmp_path / "v.bcf").write_bytes(block(b"BCF\2\2" + struct.pack("<I", len(header)) + header + body) + block(b""))
    assert [tuple(r) for r in text.read_vcf(spark, str(tmp_path / "v.bcf")).collect()] == [("c1", 5, ".", "A", "G,T", None, "PASS"), ("c2", 70_000, "rs1", "A" * 20, "A", 30.5, "LowQual"), ("c2", 3, ".", "C", ".", 1.0, ".")]
    (tmp_path / "w.bcf").write_bytes(block(b"VCF\2\2xxxx"))
    with pytest.raises(Exception, match="binary variant file"):
        text.read_vcf(spark, str(tmp_path / "w.bcf")).collect()


def test_reads_are_scanned_once(spark):
    ref, reads = dataset(n=80)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    reference = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(ref.items())], "ord int, " + REFERENCE)
    x = report.extract(spark.createDataFrame(reads, ALIGNMENTS).mapInArrow(count, ALIGNMENTS), "t", reference)
    for df in (x.errors, x.variants, x.counts, x.histogram, x.distribution, x.calibration):
        df.collect()
    assert seen.value == len(reads)


def test_a_failing_sorter_ends_the_mapper(monkeypatch):
    endless = ["sh", "-c", "while :; do echo x; done"]
    with pytest.raises(RuntimeError, match="false failed"):
        external.piped(endless, ["false"])
    with pytest.raises(FileNotFoundError):
        external.piped(endless, ["no-such-program-here"])
    with pytest.raises(RuntimeError, match="sh failed"):
        external.piped(["sh", "-c", "exit 3"], ["cat"])


def test_shards_run_in_order_with_logs(tmp_path, monkeypatch):
    (tmp_path / "gatk").write_text("#!/bin/sh\necho told $@\ncase \"$*\" in *bad*) exit 4;; esac\n")
    (tmp_path / "gatk").chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    shards = external.Shards("x.bam", "r.fa", [["c1:1-5"], ["c2", "c3"]], tmp_path, "-Xmx1g")
    external.run_shards(shards, 2)
    log = (tmp_path / "00001.vcf.log").read_text()
    assert "--native-pair-hmm-threads 1" in log and "--java-options -Xmx1g" in log and log.rstrip().endswith("-L c2 -L c3")
    assert shards.joiner("o.vcf")[:4] == ["bcftools", "concat", "-a", str(tmp_path / "00000.vcf.gz")]
    assert external.Shards("x", "r", [["c"]], tmp_path).joiner("o")[1] == "view"
    with pytest.raises(RuntimeError, match="calling bad failed"):
        external.run_shards(external.Shards("x.bam", "r.fa", [["bad"], ["c2"]], tmp_path), 1)


def test_mapping_commands():
    m = external.Mapping("lab", 8, "map-ont")
    assert m.mapper("r.fa", ("1.fq", "2.fq")) == ["bwa", "mem", "-t", "8", "-R", "@RG\\tID:lab\\tSM:lab\\tPL:ILLUMINA", "-x", "ont2d", "r.fa", "1.fq", "2.fq"]
    assert m.sorter("o.bam")[2:6] == ["-@", "4", "-m", "1G"] and m.indexer("o.bam") == ["samtools", "index", "-@", "4", "o.bam"]


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as Made

    from phredlens.sources import staging

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        session = Made(conf=Made(get=lambda *_: None), sparkContext=Made(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError, match="checkpoint"):
            staging.shared_dir(session)
    df = staging.stage(spark.range(5))
    assert df.count() == 5
    staging.unstage(df, spark.range(3))
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        spark.read.schema("id long").parquet(df._phredlens_path).collect()


def test_charts_and_fasta_files(spark, tmp_path):
    points = spark.createDataFrame([("a", 10, 12.0, 40, 9.0, 31.0), ("b", 30, 28.5, 50, 9.0, 31.0)], "technology string, base_qual int, empirical_q double, n_errors long, lo double, hi double")
    for some in (points, points.limit(0)):
        for name in ("c.png", "c.svg"):
            sinks.write_calibration_chart(some, tmp_path / name)
    image = sinks._raster([(10, 12.0, sinks.COLOURS[0])], 9.0, 31.0, 480)
    x, y = (int(round(sinks._place(v, 9.0, 31.0, 480))) for v in (10, 12.0))
    assert image[479 - y, x].tolist() == [0x1B, 0x6C, 0xA8]
    raw = (tmp_path / "c.png").read_bytes()
    assert raw.startswith(b"\x89PNG") and struct.unpack(">II", raw[16:24]) == (480, 480) and len(zlib.decompress(raw[41:-16])) == 480 * (480 * 3 + 1)
    ref = spark.createDataFrame([(1, "c2", "AC"), (0, "c1", "ACGTN"), (2, "c3", "")], "ord int, chrom string, seq string")
    sinks.write_fasta_file(ref, tmp_path / "x.fa")
    assert (tmp_path / "x.fa").read_text() == ">c1\nACGTN\n>c2\nAC\n>c3\n\n"
    data = (tmp_path / "x.fa").read_bytes()
    for line in (tmp_path / "x.fa.fai").read_text().splitlines():
        name, n, at, _, _ = line.split("\t")
        assert data[int(at) : int(at) + int(n)].decode() == {"c1": "ACGTN", "c2": "AC", "c3": ""}[name]


def test_extract_writes_the_walkers_rows_whatever_the_partitions(spark, tmp_path):
    ref, reads = dataset(n=150)
    reference = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(ref.items())], "ord int, " + REFERENCE)
    found, counts = walker(reads, ref, 1, 0)
    keys = spark.createDataFrame([(m[2], m[3], m[4], m[5]) for m in found[::5]], "chrom string, pos int, ref_allele string, alt string").distinct()
    known = {(m[2], m[3], m[4], m[5]) for m in found[::5]}
    texts = []
    for parts in (1, 5):
        x = report.extract(spark.createDataFrame(reads, ALIGNMENTS).repartition(parts), "t", reference, keys)
        report.write_extraction(x, text.contigs_of(reference), str(tmp_path / str(parts)))
        texts.append([(tmp_path / str(parts) / f).read_bytes() for f in ("errors.csv", "variants.csv", "calibration.csv")])
        n = x.counts.first()
        assert n.n_mismatches == len(found) == n.n_errors + n.n_variants
        assert n.n_variants == sum((m[2], m[3], m[4], m[5]) in known for m in found)
    assert texts[0] == texts[1]
    head, first = texts[0][0].decode().split("\r\n")[:2]
    assert head == ",".join(c.split()[0] for c in MISMATCHES.split(", ")) and first.endswith(("True,True", "True,False", "False,True", "False,False"))
    assert len(texts[0][2].decode().split("\r\n")) == len(counts) + 2


def test_compare_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,base_qual\n1,2\n1,4\n")
    (tmp_path / "b.csv").write_text("base_qual\n")
    told = report.compare_files(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")}, str(tmp_path / "out.txt"))
    assert told.split("\n")[1].split() == ["A", "2", "3.00", "3.00", "1.00"] and told.split("\n")[2].split() == ["B", "0", "0.00", "0.00", "0.00"]
    assert (tmp_path / "out.txt").read_text() == told + "\n" and (tmp_path / "A_qual_histogram.csv").read_bytes() == b"technology,base_qual,count\r\nA,2,1\r\nA,4,1\r\n"
    (tmp_path / "c.csv").write_text("y\n1\n")
    with pytest.raises(ValueError):
        report.compare_files(spark, {"A": str(tmp_path / "c.csv")})


def test_run_all_and_command_line(spark, tmp_path, capsys):
    ref, reads = dataset(n=100)
    (tmp_path / "r.fa").write_text("".join(f">{n}\n{s}\n" for n, s in ref.items()))
    for name, seed in (("a", 7), ("b", 8)):
        spark.createDataFrame(dataset(n=100)[1] if seed == 7 else dataset(n=60)[1], ALIGNMENTS).write.parquet(str(tmp_path / f"{name}.parquet"))
        (tmp_path / f"{name}.vcf").write_text(f"#x\nchr1\t{seed}\t.\t{ref['chr1'][seed - 1].upper()}\tN\t.\tPASS\t.\nchr1\t50\t.\tA\tC\t.\t.\t.\n")
    args = ["run_all", "--bam-a", f"{tmp_path}/a.parquet", "--bam-b", f"{tmp_path}/b.parquet", "--reference", f"{tmp_path}/r.fa", "--vcf-a", f"{tmp_path}/a.vcf", "--vcf-b", f"{tmp_path}/b.vcf", "--out-dir", f"{tmp_path}/out"]
    assert cli.main(args) == 0
    told = capsys.readouterr().out
    assert told == (tmp_path / "out/comparison_summary.txt").read_text() and "observed/expected" in told
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"illumina", "bgi", "comparison_summary.txt", "calibration.png", "consensus.vcf"}
    assert [line.split("\t")[1] for line in (tmp_path / "out/consensus.vcf").read_text().splitlines() if line[0] != "#"] == ["50"]
    assert cli.main(["bqsr", "--bam-before", f"{tmp_path}/a.parquet", "--bam-after", f"{tmp_path}/b.parquet", "--technology", "t", "--reference", f"{tmp_path}/r.fa", "--out", f"{tmp_path}/d.csv"]) == 0
    assert "matched" in capsys.readouterr().out and (tmp_path / "d.csv").read_text().startswith("read_name,chrom,ref_pos")
    assert cli.main(["extract", "--bam", f"{tmp_path}/a.parquet", "--technology", "t", "--reference", f"{tmp_path}/r.fa", "--out-dir", f"{tmp_path}/e"]) == 0
    assert "mismatches" in capsys.readouterr().out
    assert cli.main(["compare", "--errors-a", f"{tmp_path}/e/errors.csv", "--errors-b", f"{tmp_path}/e/variants.csv"]) == 0


def test_arguments_are_checked(spark, tmp_path):
    bad = [{}, {"bam_a": "x", "reads_a": ("1", "2"), "bam_b": "y"}, {"bam_a": "x", "reads_b": ("1", None)}, {"bam_a": "x", "bam_b": "y", "vcf_a": "v"}, {"bam_a": "x", "bam_b": "y", "preset": "no"}, {"bam_a": "x", "bam_b": "y", "label_b": "illumina"}, {"bam_a": "x", "bam_b": "y", "call": True}, {"bam_a": "x", "bam_b": "y", "threads": 0}, {"bam_a": "x", "bam_b": "y", "vcf": "v", "vcf_a": "v", "vcf_b": "v"}]
    for options in bad:
        with pytest.raises(ValueError):
            report.run_all(spark, str(tmp_path), **options)
    with pytest.raises(ValueError, match="map-ont"):
        external.check_mapping("nope", 1)
    assert [external.sort_threads_for(n) for n in (1, 4, 40)] == [1, 2, 8]
    with pytest.raises(ValueError):
        external.call_variants("b", "r", "o", [])
    with pytest.raises(RuntimeError, match="not installed"):
        external.needed("no-such-program-here")


def test_generators(spark, tmp_path):
    ref = simulate.random_reference(spark)
    seq = ref.first().seq
    assert len(seq) == 6000 and all(seq[p : p + len(r)] == r for p, r, _, _ in simulate.TRUTH)
    haps = {r.haplotype: r.seq for r in simulate.haplotypes(ref).collect()}
    assert len(haps["A"]) == 5998 and len(haps["B"]) == 6000 and haps["A"][1000] == haps["B"][1000] == "T" and haps["A"][2000] == "G" and haps["B"][2000] == "A"
    pairs = simulate.paired_reads(simulate.haplotypes(ref)).collect()
    assert 1000 < len(pairs) <= 1140
    wrong = sum(q == ")" for r in pairs for q in r.r1_qual + r.r2_qual)
    assert 0.002 < wrong / (300 * len(pairs)) < 0.004
    assert {q for r in pairs for q in r.r1_qual} == {")", "I"}
    rev = str.maketrans("ACGT", "TGCA")
    clean = [r for r in pairs if ")" not in r.r1_qual + r.r2_qual]
    assert clean and all(any(r.r1_seq in h and r.r2_seq[::-1].translate(rev) in h for h in haps.values()) for r in clean)
    with pytest.raises(Exception, match="lacks"):
        simulate.haplotypes(ref, ((10, "ACGTACGTACGT", "A", "hom"),)).collect()
    two, reads = simulate.two_technology_reads(spark)
    rows = reads.collect()
    assert len(rows) == 800 and len(two.first().seq) == 5000
    assert all(r.qual.count("$" if r.technology == "a" else "D") == r.n_substitutions for r in rows)
    assert 0.55 < sum(r.n_substitutions == 1 for r in rows) / 800 < 0.78
    truth = simulate.truth_variants(spark).selectExpr("'chr1' chrom", "vcf_pos pos", "ref ref_allele", "alt", "genotype")
    sinks.write_vcf(truth, [("chr1", 6000)], tmp_path / "t.vcf", sinks.TRUTH_INFO)
    assert [(r.pos, r.ref_allele, r.alt) for r in text.read_vcf(spark, str(tmp_path / "t.vcf")).collect()] == [(p + 1, r, a) for p, r, a, _ in simulate.TRUTH]
    sinks.write_fastq(reads.where("mate = 1"), str(tmp_path / "fq"))
    assert text.read_fastq(spark, str(tmp_path / "fq")).count() == 400
    sinks.write_fasta(ref, str(tmp_path / "fa"))
    assert text.read_fasta(spark, str(tmp_path / "fa")).first().seq == seq


def test_sorted_alignments_and_parts(spark, tmp_path, sf_dir):
    reads = fixture.reads(spark, sf_dir)
    sinks.write_alignments(reads, fixture.contigs(spark), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == reads.count()
    sinks.write_csv_parts(reads.select("read_name"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == reads.count()


def test_streaming_histogram(spark, tmp_path, sf_dir):
    reads, ref = fixture.reads(spark, sf_dir), fixture.reference(spark)
    reads.select(*[c.split()[0] for c in ALIGNMENTS.split(", ")]).repartition(3).write.parquet(str(tmp_path / "in"))
    keys = var.variant_keys(fixture.variants(spark, sf_dir))
    q = histogram.streaming_error_histogram(histogram.alignment_stream(spark, str(tmp_path / "in")), ref, keys).writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("grown").collect()))
    finally:
        q.stop()
    found = var.errors_and_variants(al.mismatches(reads, ref), keys)[0]
    assert got == sorted(map(tuple, found.groupBy("technology", "base_qual").count().collect()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path, sf_dir):
    """Two arrivals are counted; the last batch runs again from a checkpoint without its commit; then a third arrives."""
    reads, ref = fixture.reads(spark, sf_dir), fixture.reference(spark)
    keys = var.variant_keys(fixture.variants(spark, sf_dir))
    sites = var.variant_sites(keys)
    columns = [c.split()[0] for c in ALIGNMENTS.split(", ")]
    arrive = lambda k: reads.where(f"ord % 3 = {k}").select(*columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = lambda: [sorted(map(tuple, t.collect())) for t in extraction.totals(spark, str(tmp_path / "out"))]

    def run():
        q = extraction.streamed_extraction(histogram.alignment_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ref, keys, sites)
        q.awaitTermination()
        assert q.exception() is None

    for k in (0, 1):
        arrive(k)
        run()
    before = told()
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert told() == before
    arrive(2)
    run()
    whole = report.extract(reads.select(*columns), "t", ref, keys, sites)
    assert told() == [sorted(map(tuple, whole.calibration.collect())), sorted(map(tuple, whole.histogram.collect()))]


def test_planted_variants_are_called(spark):
    """Reads of a reference with one homozygous and one heterozygous base; errors stay below the share."""
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
    rows = []
    for k in range(1200):
        start = rng.randint(0, 2900)
        bases = list(seq[start : start + 100])
        for at, both in ((1000, True), (2047, False)):
            if start <= at < start + 100 and (both or k % 2):
                bases[at - start] = swap[seq[at]]
        if k % 10 == 0:
            bases[50] = swap[bases[50]]
        rows.append((f"r{k}", 0, "c", start, 60, "100M", "".join(bases), "I" * 100, None, k, "t"))
    reads = spark.createDataFrame(rows, ALIGNMENTS)
    ref = spark.createDataFrame([("c", seq)], REFERENCE)
    called = pileup.pileup_variants(reads, al.mismatches(reads, ref), min_alt=3, min_share=0.25)
    cover = lambda at: sum(r[3] <= at < r[3] + 100 for r in rows)
    got = {(r.pos, r.ref_allele, r.alt, r.genotype): r.depth for r in called.collect()}
    assert got == {(at + 1, seq[at], swap[seq[at]], g): cover(at) for at, g in ((1000, "1/1"), (2047, "0/1"))}
    places = spark.createDataFrame([("c", p) for p in (1, 500, 1024, 1025, 2048, 3000)] + [("none", 5)], "chrom string, pos int")
    depths = {(r.chrom, r.pos): r.depth for r in pileup.depth_at(reads, places).collect()}
    assert depths == {("c", p): cover(p - 1) for p in (1, 500, 1024, 1025, 2048, 3000)} | {("none", 5): 0}


def test_fastq_lines_go_by_a_number_of_their_split(spark, tmp_path):
    """No path and no pattern for each line, and a record that two batches share is whole."""
    records = [(f"r{k}", "ACGT" * (k % 7), "IIII" * (k % 7)) for k in range(500)]
    (tmp_path / "x.fq").write_text("".join(f"@{n}\tabout\n{s}\n+\n{q}\n" for n, s, q in records))
    found = text.read_fastq(spark, str(tmp_path / "x.fq"))
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow run\(value#\d+, split#\d+L?\)", shown) and "split(" not in shown
    for size in (3, 5, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(tuple, text.read_fastq(spark, str(tmp_path / "x.fq")).collect())) == sorted(records)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
