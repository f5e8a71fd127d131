"""Sequencing operators against a slow per-base walker and fixed expectations."""

import random
import re
import statistics as st

import pytest

from phredlens.operators import alignments as al
from phredlens.operators import calibration as cal
from phredlens.operators import planning, recalibration, statistics
from phredlens.operators import variants as var
from phredlens.schemas import ALIGNMENTS, MISMATCHES, REFERENCE, VARIANTS


def walker(reads, ref, min_mapq, min_bq, sites=frozenset()):
    """(mismatch rows, calibration counts by quality) one base at a time."""
    found, counts = [], {}
    for name, flag, chrom, start, mapq, cigar, seq, qual, _, _, tech in reads:
        if flag & (4 | 256 | 1024 | 2048) or mapq < min_mapq or seq is None or qual is None:
            continue
        q, r = 0, start
        for n, op in re.findall(r"(\d+)([MIDNSHPX=])", cigar):
            for _ in range(int(n)):
                if op in "M=X":
                    a, b, bq = ref[chrom][r].upper(), seq[q].upper(), ord(qual[q]) - 33
                    if a in "ACGT" and bq >= min_bq:
                        if a != b:
                            found.append((name, tech, chrom, r + 1, a, b, bq, mapq, cigar, bool(flag & 64), bool(flag & 16)))
                        if b != "N" and (chrom, r + 1) not in sites:
                            t, e = counts.get(bq, (0, 0))
                            counts[bq] = t + 1, e + (a != b)
                q += op in "M=XIS"
                r += op in "M=XDN"
    return sorted(found), counts


def dataset(seed=7, n=400):
    rng = random.Random(seed)
    ref = {}
    for chrom, size in (("chr1", 3000), ("chr2", 900), ("chrEmpty", 200)):
        s = [rng.choice("ACGT") if rng.random() > 0.01 else "N" for _ in range(size)]
        a = rng.randrange(size - 150)
        s[a : a + 150] = [c.lower() for c in s[a : a + 150]]
        ref[chrom] = "".join(s)
    reads = []
    for k in range(n):
        chrom = rng.choice(["chr1", "chr2"])
        a, b = rng.randint(5, 25), rng.randint(5, 25)
        cigar = rng.choice([f"{a + b}M", f"4S{a}M", f"{a}M3I{b}M", f"{a}M2D{b}M", f"{a}M5S", f"{a}M20N{b}M", f"3S{a}M2S", f"2H{a}={b}X", f"{a}M1P{b}M", f"{a}M2I1D{b}M"])
        ops = [(int(x), y) for x, y in re.findall(r"(\d+)([A-Z=])", cigar)]
        span = sum(x for x, y in ops if y in "M=XDN")
        start = rng.randrange(len(ref[chrom]) - span)
        seq, md, run, r = "", "", 0, start
        for x, y in ops:
            if y in "M=X":
                for _ in range(x):
                    c = ref[chrom][r].upper()
                    s = "N" if rng.random() < 0.01 else rng.choice("ACGT") if rng.random() < 0.05 or c == "N" else c
                    seq += s
                    run, md = (run + 1, md) if s == c else (0, f"{md}{run}{c}")
                    r += 1
            elif y in "IS":
                seq += "".join(rng.choice("ACGT") for _ in range(x))
            elif y == "D":
                md, run = f"{md}{run}^{ref[chrom][r : r + x].upper()}", 0
                r += x
            elif y == "N":
                r += x
        md += str(run)
        flag = rng.choice([0, 16, 65, 145, 81]) | rng.choice([0] * 20 + [4, 256, 512, 1024, 2048])
        qual = "".join(chr(33 + rng.randint(2, 41)) for _ in seq)
        reads.append((f"r{k}", flag, chrom, start, rng.choice([0, 1, 20, 60]), cigar, seq if k % 50 else None, qual if k % 51 else None, md, k, "t"))
    return ref, reads


@pytest.fixture(scope="module")
def data(spark):
    ref, reads = dataset()
    return ref, reads, spark.createDataFrame(list(ref.items()), REFERENCE).cache(), spark.createDataFrame(reads, ALIGNMENTS).cache()


COLS = [c.split()[0] for c in MISMATCHES.split(", ")]


@pytest.mark.parametrize("mapq,bq,tile,broadcast", [(0, 0, 65536, 10**9), (1, 0, 13, 10**9), (20, 0, 64, 0), (1, 20, 97, 0), (60, 35, 1000, 10**9)])
def test_mismatches_equal_the_walker_for_any_tiling(data, mapq, bq, tile, broadcast):
    ref, reads, reference, alignments = data
    got = al.mismatches(alignments, reference, mapq, bq, tile, broadcast).select(*COLS).collect()
    assert sorted(map(tuple, got)) == walker(reads, ref, mapq, bq)[0]


def test_md_path_equals_the_reference_path(data):
    ref, reads, reference, alignments = data
    assert sorted(map(tuple, al.mismatches(alignments).select(*COLS).collect())) == walker(reads, ref, 1, 0)[0]


@pytest.mark.parametrize("bq", [0, 20])
def test_calibration_equals_the_walker(spark, data, bq):
    ref, reads, reference, alignments = data
    sites = {("chr1", p) for p in range(100, 2000, 7)}
    frame = spark.createDataFrame(sorted(sites), "chrom string, pos int")
    told = lambda counts: {r.base_qual: (r.n_bases, r.n_errors) for r in counts.collect()}
    plain = al.aligned_pieces(al.usable_reads(alignments), reference, tile=50)
    assert told(cal.calibration_counts(plain, bq)) == walker(reads, ref, 1, bq)[1]
    assert told(cal.calibration_counts_by_base(plain, frame, bq)) == walker(reads, ref, 1, bq, sites)[1]
    for source in (reference, None):  # by tiles, and by MD strings
        for most in (10**9, 0):
            marked = al.aligned_pieces(al.usable_reads(alignments), source, tile=50, broadcast_chars=most, sites=frame)
            assert told(cal.calibration_counts(marked, bq)) == walker(reads, ref, 1, bq, sites)[1]
            assert sorted(map(tuple, al.mismatches_of(marked, bq).select(*COLS).collect())) == walker(reads, ref, 1, bq)[0]
    shown = cal.calibration_counts(al.aligned_pieces(al.usable_reads(alignments), reference, broadcast_chars=0, sites=frame))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in shown and "LeftAnti" not in shown  # no row a base, no anti join of bases


def test_a_hot_tile_is_dealt_out(spark):
    """A third of the reads on one tile, no broadcast: no join task has over twice the median of its rows."""
    ref = spark.createDataFrame([("c", "ACGT" * 12_000), ("mt", "ACGT" * 100)], REFERENCE)
    rows = [(f"r{k}", 0, "mt" if k % 3 == 0 else "c", k % 300 if k % 3 == 0 else k * 7 % 47_000, 60, "20M", "ACGTACGTACGTACGTACGT", "I" * 20, None, k, "t") for k in range(6000)]
    reads = spark.createDataFrame(rows, ALIGNMENTS)
    pieces = al._pieces(al.cigar_blocks(reads), al.TILE)
    met = al._meet_tiles(pieces, al.reference_tiles(ref))
    assert met.count() == pieces.count() and met.where("ref_tile is null").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = sorted(r["count"] for r in al._meet_tiles(pieces, al.reference_tiles(ref)).groupBy(al.F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert per_task[-1] <= 2 * per_task[len(per_task) // 2]
    want = sorted(tuple(r) for r in al.mismatches(reads, ref).select(*COLS).collect())
    assert sorted(tuple(r) for r in al.mismatches(reads, ref, broadcast_chars=0).select(*COLS).collect()) == want


def test_a_cigar_of_very_many_operations(spark):
    n = 35_000
    read = spark.createDataFrame([("x", 0, "c", 0, 60, "1M1I" * n, "AC" * n, "I" * 2 * n, None, 0, "t")], ALIGNMENTS)
    blocks = al.cigar_blocks(read).select("block_idx", "q", "r", "n")
    assert blocks.count() == n and tuple(blocks.orderBy("block_idx").tail(1)[0]) == (n - 1, 2 * n - 2, n - 1, 1)
    assert read.select(al.reference_end(al.F.col("cigar"), al.F.col("ref_start"))).first()[0] == n


def test_errors_are_clear(spark, data):
    _, _, reference, alignments = data
    far = alignments.where("read_name = 'r1'").selectExpr("*").withColumn("ref_start", al.F.lit(2_999_999)).withColumn("flag", al.F.lit(0)).withColumn("mapq", al.F.lit(60))
    with pytest.raises(Exception, match="past the end"):
        al.mismatches(far, reference).collect()
    with pytest.raises(Exception, match="neither a reference"):
        al.mismatches(alignments.withColumn("md", al.F.lit(None).cast("string"))).collect()


def test_one_read(spark):
    ref = spark.createDataFrame([("c", "ACGTACGTAC")], REFERENCE)
    read = spark.createDataFrame([("x", 0, "c", 0, 60, "10M", "ACGTCCGTAC", "IIII#IIIII", None, 0, "t")], ALIGNMENTS)
    got = al.mismatches(read, ref).collect()
    assert [(r.ref_pos, r.base_qual, r.mapping_qual) for r in got] == [(5, 2, 60)]
    assert al.mismatches(read, ref, min_mapq=61).count() == 0


def test_sites_take_bases_out_of_calibration_only(spark):
    ref = spark.createDataFrame([("c", "A" * 30)], REFERENCE)
    seq = "A" * 4 + "G" + "A" * 5 + "T" + "A" * 19
    read = spark.createDataFrame([("x", 0, "c", 0, 60, "30M", seq, "I" * 30, None, 0, "t")], ALIGNMENTS)
    keys = var.variant_keys(spark.createDataFrame([("c", 5, ".", "A", "G", None, "PASS"), ("c", 10, ".", "AAA", "A", None, ".")], VARIANTS))
    pieces, marked = (al.aligned_pieces(al.usable_reads(read), ref, sites=x) for x in (None, var.variant_sites(keys)))
    assert [(r.n_bases, r.n_errors) for r in cal.calibration_counts(pieces).collect()] == [(30, 2)]
    assert [(r.n_bases, r.n_errors) for r in cal.calibration_counts(marked).collect()] == [(26, 0)]
    errors, variants = var.errors_and_variants(al.mismatches(read, ref), keys)
    assert [r.ref_pos for r in errors.collect()] == [11] and [r.ref_pos for r in variants.collect()] == [5]


def test_variant_rules(spark):
    rows = [("c", 1, ".", "A", "G", 10.0, "PASS"), ("c", 2, ".", "a", "G,T", None, "q10;PASS"), ("c", 3, ".", "AC", "A", 50.0, "."), ("c", 4, ".", "A", ".", 50.0, ""), ("c", 5, ".", "A", "C", 50.0, "LowQual"), ("c", 6, ".", "A", "C", 50.0, None)]
    records = spark.createDataFrame(rows, VARIANTS)
    assert sorted((r.pos, r.ref_allele, r.alt) for r in var.variant_keys(records).collect()) == [(1, "A", "G"), (2, "a", "G"), (2, "a", "T"), (3, "AC", "A"), (6, "A", "C")]
    assert sorted(r.pos for r in var.variant_keys(records, min_qual=20, pass_only=False).collect()) == [2, 2, 3, 5, 6]
    assert sorted(r.pos for r in var.variant_sites(var.variant_keys(records)).collect()) == [1, 2, 3, 4, 6]
    other = spark.createDataFrame([("c", 2, ".", "a", "T,G", 1.0, "x"), ("c", 3, ".", "AC", "AT", 1.0, "PASS")], VARIANTS)
    assert [r.pos for r in var.consensus(records, other).collect()] == [2]


@pytest.mark.parametrize("values", [[7], [5, 9], [1, 2, 3], [4] * 4, [2, 40, 40, 2, 17], [30] * 99 + [31]])
def test_distribution(spark, values):
    h = spark.createDataFrame([("t", v) for v in values], "technology string, base_qual int").groupBy("technology", "base_qual").count()
    asked = spark.createDataFrame([("t",), ("none",)], "technology string")
    got = {r.technology: tuple(r)[1:] for r in statistics.quality_distribution(h, asked).collect()}
    assert got["t"] == pytest.approx((len(values), st.fmean(values), st.median(values), st.pstdev(values)))
    assert got["none"] == (0, 0.0, 0.0, 0.0)


def test_calibration_rows_and_summary(spark):
    counts = spark.createDataFrame([("t", 20, 100, 5), ("t", 30, 50, 0), ("t", 40, 10, 1), ("t", 41, 0, 0)], "technology string, base_qual int, n_bases long, n_errors long")
    rows = {r.base_qual: (r.error_rate, r.empirical_q) for r in cal.calibration_rows(counts).collect()}
    assert rows[20][0] == 0.05 and rows[30] == (0.0, None) and rows[40] == (0.1, 10.0) and 41 not in rows
    one = cal.calibration_summary(counts.where("base_qual = 20")).first()
    assert one.ratio == pytest.approx(5.0)
    none = cal.calibration_summary(counts.where("base_qual = 41")).first()
    assert (none.observed, none.expected, none.ratio) == (0, 0, 0)
    assert [(r.base_qual, r.lo, r.hi) for r in cal.calibration_plot_points(counts, 5).collect()] == [(20, pytest.approx(12.0103), 21.0)]


def test_recalibration_keeps_the_last_row(spark):
    row = lambda n, q, o, read1=True: (n, "t", "c", 5, "A", "G", q, 60, "10M", read1, False, o)
    schema = MISMATCHES + ", ord long"
    before = spark.createDataFrame([row("x", 10, 0), row("x", 12, 3), row("y", 20, 1), row("y", 21, 2), row("x", 9, 4, False)], schema)
    after = spark.createDataFrame([row("x", 30, 0), row("x", 33, 1)], schema)
    assert [(r.read_name, r.qual_before, r.qual_after, r.delta, r.first_ord) for r in recalibration.quality_deltas(before, after).collect()] == [("x", 12, 33, 21, 0)]
    assert sorted(r.ord for r in recalibration.dropped_after(before, after).collect()) == [1, 2, 4]
    assert recalibration.mean_delta(recalibration.quality_deltas(before.limit(0), after)).first().mean_delta is None


def brute_tasks(contigs, chunk):
    out, held, size = [], [], 0
    for name, n in contigs:
        if n > chunk:
            out += [held] if held else []
            out += [[f"{name}:{a}-{min(a + chunk - 1, n)}"] for a in range(1, n + 1, chunk)]
            held, size = [], 0
        else:
            held, size = [*held, name], size + n
            if size >= chunk:
                out, held, size = [*out, held], [], 0
    return out + ([held] if held else [])


def test_planning(spark, data):
    rng = random.Random(3)
    for _ in range(4):
        contigs = [(f"c{k}", rng.choice([0, 3, 50, 99, 100, 101, 250])) for k in range(rng.randint(1, 9))]
        frame = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(contigs)], "ord int, name string, length long")
        assert [r.intervals for r in planning.interval_tasks(frame, 100).orderBy("task").collect()] == brute_tasks(contigs, 100)
    contigs = spark.createDataFrame([(0, "chr1", 3000), (1, "chr2", 900), (2, "chrEmpty", 200)], "ord int, name string, length long")
    windows = planning.scan_windows(data[3], contigs, 700).orderBy("idx").collect()
    assert [tuple(w)[0] for w in windows] == list(range(7)) and {w.chrom for w in windows} == {"chr1", "chr2"}
    assert [(w.start, w.stop) for w in windows if w.chrom == "chr2"] == [(0, 700), (700, 900)]
    for f in (lambda: planning.scan_windows(data[3], contigs, 0), lambda: planning.interval_tasks(contigs, 0)):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("bin_size", [7, 100, 16384])
def test_regions(spark, data, bin_size):
    _, reads, _, alignments = data
    regions = [(0, "chr1", 100, 400), (1, "chr1", 350, 700), (2, "chr2", 0, 60), (3, "chr9", 0, 10)]
    frame = spark.createDataFrame(regions, "region_ord int, chrom string, start int, stop int")
    end = lambda r: r[3] + sum(int(n) for n, op in re.findall(r"(\d+)([A-Z=])", r[5]) if op in "M=XDN")
    want = sorted((r[0], o) for r in reads for o, c, a, z in regions if r[2] == c and r[3] < z and end(r) > a)
    assert sorted((r.read_name, r.region_ord) for r in al.reads_in_regions(alignments, frame, bin_size).collect()) == want


def test_plans_push_filters_and_prune_columns(spark, data, tmp_path):
    data[3].write.parquet(str(tmp_path / "a"))
    plan = statistics.mapped_counts(spark.read.parquet(str(tmp_path / "a")), spark.createDataFrame([(0, "chr1", 1)], "ord int, name string, length long"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<flag:int,chrom:string>" in plan
    plan = al.usable_reads(spark.read.parquet(str(tmp_path / "a"))).select("read_name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(mapq,1)" in plan


def test_derived_reads_equal_their_rule_without_a_step_for_each_base(spark, sf_dir):
    from phredlens.plans import fixture as fx

    letter = lambda p, ci: "ACGT"[(p * 2654435761 + ci * 40503) // 65536 % 4]
    found = fx.reads(spark, sf_dir)
    lambdas = lambda df: df._jdf.queryExecution().analyzed().toString().count("lambdafunction")
    assert lambdas(found) == lambdas(fx.reference(spark))
    orders = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    rows = found.collect()
    assert len(rows) == 2 * len(orders)
    for r in rows:
        k, m = divmod(r.ord, 2)
        ci, (_, blocks) = orders[k] % 5 + 1, fx.CIGARS[(k + m) % 7]
        seq, md, run, last = [], "", 0, None
        for q in range(fx.READ_LENGTH):
            shift = next((s for a, z, s in blocks if a <= q < z), None)
            if shift is None:
                seq.append("A")
                continue
            p, h = r.ref_start + q + shift, (r.ord * 7919 + q * 104729) % 97
            base = letter(p, ci)
            seq.append("ACGT"[("ACGT".index(base) + 1 + (k + q) % 3) % 4] if h == 0 else "N" if h == 1 else base)
            if "D" in r.cigar and last is not None and p > last + 1:
                md, run = f"{md}{run}^{''.join(letter(x, ci) for x in range(last + 1, p))}", 0
            last = p
            md, run = (md, run + 1) if seq[-1] == base else (f"{md}{run}{base}", 0)
        assert (r.seq, r.md) == ("".join(seq), f"{md}{run}"), r
        assert r.qual == "".join(chr(35 + (k * 7 + q * 13 + m) % 40) for q in range(fx.READ_LENGTH))


def test_extraction_has_no_lambda_and_walks_equal_cigars_alike(spark):
    rows = [("a", "3M2D2M", 5), ("b", None, 5), ("c", "3M2D2M", 9), ("d", "*", 1), ("e", "2S0M3I4=1X2N5H1M", 0), ("f", "4M", None)]
    reads = spark.createDataFrame(rows, "read_name string, cigar string, ref_start int").coalesce(1)
    got = {r[0]: (None if r[1] is None else [tuple(b) for b in r[1]], r[2]) for r in al.with_blocks(reads).select("read_name", "blocks", "ref_end").collect()}
    assert got == {"a": ([(0, 5, 0, 3), (3, 10, 5, 2)], 12), "b": (None, None), "c": ([(0, 9, 0, 3), (3, 14, 5, 2)], 16), "d": ([], 1), "e": ([(5, 0, 0, 4), (9, 4, 4, 1), (10, 7, 5, 1)], 8), "f": (None, None)}
    short = spark.createDataFrame([("r", 0, "c", 0, 60, "6M", "ACG", "II", "3A2", 1, "t")], ALIGNMENTS)
    genome = spark.createDataFrame([("c", "ATGTAC")], REFERENCE)
    found = al.mismatches(short, genome, min_base_qual=-99)
    assert sorted((r.ref_pos, r.ref_base, r.read_base, r.base_qual) for r in found.collect()) == [(2, "T", "C", 40), (4, "T", "", -33), (5, "A", "", -33), (6, "C", "", -33)]
    for frame in (found, al.mismatches(short)):
        assert "lambdafunction" not in frame._jdf.queryExecution().analyzed().toString()


def test_interval_tasks_fold_without_a_growing_list(spark):
    rng = random.Random(5)
    rows = [(k, f"c{k}", rng.choice([0, 1, 3, 9, 10, 11, 25, 30])) for k in range(400)]
    want, held, size = [], [], 0
    for _, name, n in rows:
        if n > 10:
            want += [held] * bool(held) + [[f"{name}:{a}-{min(a + 9, n)}"] for a in range(1, n + 1, 10)]
            held, size = [], 0
        else:
            held, size = [*held, name], size + n
            if size >= 10:
                want, held, size = [*want, held], [], 0
    want += [held] * bool(held)
    tasks = planning.interval_tasks(spark.createDataFrame(rng.sample(rows, len(rows)), "ord int, name string, length long"), 10)
    assert sorted((r.task, r.intervals) for r in tasks.collect()) == list(enumerate(want))
    assert "aggregate(" not in tasks._jdf.queryExecution().analyzed().toString()


def test_what_is_compiled_for_a_derived_read_stays_short(spark, sf_dir):
    """The JVM never compiles a method of over 8,000 bytes; it stays interpreted, at many times the cost of a row."""
    from phredlens.plans import fixture as fx

    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (fx.reads(spark, sf_dir), al.usable_reads(fx.reads(spark, sf_dir)), al.mismatches(fx.reads(spark, sf_dir), fx.reference(spark)), al.mismatches(fx.reads(spark, sf_dir))):
            shown = found._jdf.queryExecution().explainString(mode)
            assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown))) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_function_runs_twice_for_a_read(spark, sf_dir):
    from phredlens.plans import queries as plans

    for name in ("mismatches", "mismatches_md", "calibration_counts", "error_histogram"):
        shown = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        calls = re.findall(r"ArrowEvalPython \[(_walk|_unlike)\(([^)]*)\)", shown)
        assert calls and len(calls) == len(set(calls)), (name, calls)
