"""Round trips of the file formats; encoders for BAM and bigWig are small ones of our own."""

import struct
import zlib

from locusflow.config import Settings
from locusflow.operators.values import coverage_vectors
from locusflow.sources import formats as X
from locusflow.sources import manifest as M


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def test_bam(spark, tmp_path):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    rest = struct.pack("<iii", -1, -1, 0) + b"r1\0" + struct.pack("<II", 2 << 4, 700 << 4 | 3) + bytes([0x12, 0x40]) + b"\xff" * 3
    full = struct.pack("<ii", 0, 99) + struct.pack("<BBHHHi", 3, 60, 0, 2, 16, 3) + rest
    (tmp_path / "x.bam").write_bytes(member(head) + member(struct.pack("<i", len(full)) + full) + member(b""))
    r = X.read_bam(spark, str(tmp_path / "x.bam")).first()
    assert (r.read_name, r.flag, r.chrom, r.pos, r.mapq, r.cigar, r.seq) == ("r1", 16, "chr1", 99, 60, "2M700N", "ACG")


def test_bigwig(spark, tmp_path):
    section = struct.pack("<IIIIIBBH", 0, 10, 40, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 10, 20, 1.5, 20, 40, -2.0)
    packed = zlib.compress(section)
    chrom_at = 64
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 1000)
    data_at = chrom_at + len(tree)
    index_at = data_at + len(packed)
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 1, 1, 0, 10, 0, 40, index_at, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, 10, 0, 40, data_at, len(packed))
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, chrom_at, data_at, index_at, 0, 0, 0, 0, len(section), 0)
    assert len(head) == 64
    (tmp_path / "x.bw").write_bytes(head + tree + packed + index)
    runs = X.read_bigwig(spark, str(tmp_path / "x.bw"), "-")
    assert [(r.chrom, r.start, r.end, r.value) for r in runs.orderBy("start").collect()] == [("chr1", 10, 20, 1.5), ("chr1", 20, 40, -2.0)]
    tx = spark.createDataFrame([(1, "chr1", 18, 22, "-")], "id bigint, chrom string, start bigint, end bigint, strand string")
    assert coverage_vectors(runs, tx).first()["v"] == [2.0, 2.0, -1.5, -1.5]


def test_text_formats(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    g = X.read_gff(spark, w("a.gff", "#c\nchr1\ts\texon\t11\t20\t.\t+\t.\tID=t1;gene_id=g1.2\n")).first()
    assert (g.start, g.end, g.attrs["gene_id"]) == (10, 20, "g1.2")
    fa = X.read_fasta(spark, w("a.fa", ">c1 first\nACGT\nAC\n>c2\nGG\n"), 4)
    assert sorted((r.chrom, r.chunk, r.seq) for r in fa.collect()) == [("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c2", 0, "GG")]
    s = X.read_reactivity(spark, w("s.tsv", "t1\t3\t1.0\t0.5\tNULL\t2\n"))
    assert s.first()["v"] == [0.5, None, 2.0]
    X.write_reactivity(s, str(tmp_path / "o"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "o"), sep="\t").collect()) == [("t1", "1", "0.5"), ("t1", "2", "-999.0"), ("t1", "3", "2.0")]
    f = X.read_fold(spark, w("f.txt", ">x\nACGU\n(..) (-1.50)\n")).first()
    assert (f.seq, f.structure, f.energy) == ("ACGU", "(..)", -1.5)
    e = X.read_expression(spark, w("RBP_HepG2.tsv", "gene\tlog2FoldChange\tpadj\ng1.3\t2.0\t0.01\n")).first()
    assert (e.id, e.log2FoldChange, e.name_parts) == ("g1.3", 2.0, ["RBP", "HepG2"])
    r = X.read_regions(spark, w("r.tsv", "chr\tstart\tend\tgc\tstrand\tq_betabinom_1\tq_betabinom_2\nc\t1\t9\t0.5\t+\t0.1\t0.2\n")).first()
    assert (r.region, r.q_betabinom_1) == ("c:1:9:+", 0.1)
    v = X.read_windows(spark, w("w.tsv", "gene_id\tn\na.1:b.2\t3\n"))
    assert sorted(x.gene_id for x in v.collect()) == ["a", "b"]
    b = X.bed_from_string(spark, "chr1 5 9 n 0 +\nchr1 5 9 n 0 +")
    X.write_bed(b, str(tmp_path / "b"))
    assert X.read_bed(spark, str(tmp_path / "b")).count() == 2
    assert [r.id for r in X.read_ids(spark, w("ids", "b\na\n\n")).orderBy("ord").collect()] == ["b", "a"]
    assert Settings.from_ini(w("c.ini", "[FILES]\nGENOME_FA = /x.fa\nDATADIR =\n")).files == {"GENOME_FA": "/x.fa", "DATADIR": ""}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",uid,RBP,bam_0,bam_control,plus_0,idr\n0,u1,R,a,b,c,\n1,u2,S,d,e,f,g\n")
    m = M.read(spark, str(tmp_path / "m.csv"))
    rows = {(r.uid, r.lib, r.kind, r.path) for r in M.unpivot(m).collect()}
    assert ("u1", "rep1", "bam", "a") in rows and ("u1", "ctrl", "bam", "b") in rows and ("u2", "rep1", "idr", "g") in rows
    assert M.one_experiment(m, "u2").first()["RBP"] == "S"
    assert M.missing_files(spark, M.unpivot(m).filter("path = 'a'").withColumn("path", M.F.lit(str(tmp_path / "no")))) == [str(tmp_path / "no")]


def test_base_values(spark):
    """Missing bases and chromosomes, other strands, infinite values and the sign of minus-strand vectors."""
    from pyspark.sql import functions as F

    from locusflow.operators import values as RV

    runs = "chrom string, start long, end long, value double"
    plus = spark.createDataFrame([("a", 2, 4, 1.5), ("a", 4, 5, float("inf")), ("a", 8, 20, 2.0)], runs)
    minus = spark.createDataFrame([("a", 0, 3, -1.0), ("a", 3, 4, 4.0)], runs)
    where = [(1, "a", 1, 9, "+"), (2, "a", 1, 6, "-"), (3, "z", 0, 3, "+"), (4, "a", 0, 3, "."), (5, "a", 5, 5, "+"), (6, "a", 9, 11, "+"), (7, "b", 4, 6, "-")]
    regions = spark.createDataFrame(where, "id long, chrom string, start long, end long, strand string")
    out = RV.base_values(plus, minus, regions).join(regions.select("id", "strand"), "id").withColumn("c", RV.clean(F.col("v"), F.col("strand")))
    got = {r.id: (["-" if x != x else x for x in r.v], r.c) for r in out.collect()}
    inf, top = float("inf"), RV.LARGEST
    assert got == {
        1: (["-", 1.5, 1.5, inf, "-", "-", "-", 2.0], [0, 1.5, 1.5, top, 0, 0, 0, 2.0]), 2: (["-", "-", 4.0, -1.0, -1.0], [0, 0, -4.0, 1.0, 1.0]),
        3: (["-"] * 3, [0] * 3), 4: ([1.0], [1.0]), 5: ([], []), 6: ([2.0, 2.0], [2.0, 2.0]), 7: (["-"] * 2, [0] * 2),
    }
