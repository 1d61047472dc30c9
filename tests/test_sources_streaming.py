import gzip
import io
import random
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from readloom.operators.counts import soft_filter, unique_alignments
from readloom.operators.periods import merge_periods
from readloom.plans.pipelines import alignment_counts, prepare_reads
from readloom.sources import bam, fastq, formats
from readloom.sources.fetch import fetched
from readloom.sources.files import files_of
from readloom.streaming.reads import clean_stream, reads_per_window, stream_periods


def fastq_text(names):
    return "".join(f"@{n} x\nACGT\n+\nIIII\n" for n in names)


def test_fastq_order_over_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write(fastq_text(["a", "b"]))
    (tmp_path / "b.fq").write_text(fastq_text(["c"]))
    (tmp_path / "c.fq").write_text("")
    (tmp_path / "d.fq").write_text(fastq_text(["d"]) + "\n")
    rows = fastq.read_fastq(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.acc) for r in rows] == [(i, f"@{n} x") for i, n in enumerate("abcd")]


def test_fastq_in_chunks(spark, tmp_path):
    rng = random.Random(5)
    for case in range(6):
        reads = []
        for i in range(rng.randint(1, 40)):
            n = rng.randint(0, 12)
            reads.append((f"@{i}" + rng.choice(["", " +x", " @y"]), "".join(rng.choice("ACGTN") for _ in range(n)), rng.choice(["+", f"+{i}"]), "".join(rng.choice("@+I#") for _ in range(n))))
        end = rng.choice(["\n", "\r\n"])
        path = tmp_path / f"{case}, x.fq"
        path.write_bytes("".join(end.join(r) + end for r in reads).encode())
        file = files_of(str(path))[0]
        for size in (1, 2, 3, 7, 20, 64, 1000, 10**9):
            assert [r for c in fastq.chunks_of([file], size) for r in fastq._records(c)] == reads
        rows = fastq.read_fastq(spark, [str(path)], chunk=50).orderBy("ordinal").collect()
        assert [(r.ordinal, r.acc, r.seq, r.sep, r.qual) for r in rows] == [(i, *r) for i, r in enumerate(reads)]
    broken = tmp_path / "broken.fq"
    broken.write_text("@a\nACGT\n+\nIIII\n@b\nAC\n")
    for size in (5, 17, 1000):
        with pytest.raises(ValueError, match="fewer than four lines"):
            [r for c in fastq.chunks_of(files_of(str(broken)), size) for r in fastq._records(c)]
    with pytest.raises(FileNotFoundError):
        files_of(str(tmp_path / "none.fq"))


def test_fastq_round_trip(spark, tmp_path, reads_of):
    df = reads_of("ACGT", "GG", "T")
    fastq.write_fastq(df.coalesce(1), str(tmp_path / "out"))
    back = fastq.read_fastq(spark, str(tmp_path / "out")).orderBy("ordinal")
    assert [r.seq for r in back.collect()] == ["ACGT", "GG", "T"]
    fastq.write_one_line(df, str(tmp_path / "lines"))
    assert sorted(r.seq for r in fastq.read_one_line(spark, str(tmp_path / "lines")).collect()) == ["ACGT", "GG", "T"]
    fastq.write_demultiplexed(df.withColumn("well", F.when(F.col("seq") == "T", "NA").otherwise("A1")), str(tmp_path / "wells"))
    assert sorted(p.name for p in (tmp_path / "wells").iterdir() if p.is_dir()) == ["well=A1", "well=NA"]


def test_files_per_well(spark, tmp_path, reads_of):
    df = reads_of("ACGT", "GG", "T", "TT").withColumn("well", F.when(F.col("seq") == "T", "NA").when(F.col("seq") == "GG", "B:2").otherwise("A1"))
    fastq.write_demultiplexed(df.repartition(3, "ordinal"), str(tmp_path / "out"), base="Lib1")
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(("_", ".")))
    assert {n.split(".")[1] for n in names} == {"A1", "B:2", "NA"} and all(n.startswith("Lib1.") and n.endswith(".fq.gz") for n in names)
    assert sorted(r.seq for r in fastq.read_fastq(spark, str(tmp_path / "out" / "Lib1.A1*")).collect()) == ["ACGT", "TT"]


def test_fetch(tmp_path):
    (tmp_path / "a.txt").write_text("content")
    url = (tmp_path / "a.txt").as_uri()
    for mode, go_on in (("yes", True), ("only", False)):
        path = tmp_path / mode / "b.txt"
        assert fetched(url, str(path), mode) is go_on and path.read_text() == "content"
        assert [p.name for p in path.parent.iterdir()] == ["b.txt"]
    assert fetched(None, str(tmp_path / "none"), "no") and not (tmp_path / "none").exists()
    for bad in (("yes", None), ("maybe", url)):
        with pytest.raises(ValueError):
            fetched(bad[1], str(tmp_path / "c"), bad[0])


def test_broken_fastq(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAC\n+\n")
    with pytest.raises(Exception, match="fewer than four lines"):
        fastq.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGT\nAC\n>b\nGG\n>empty\n")
    rows = {r.id: r.seq for r in formats.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert rows == {"a one": "ACGTAC", "b": "GG", "empty": ""}
    df = spark.createDataFrame([("a", "ACGTACGTA"), ("b", "ACGT")], "id string, seq string")
    formats.write_fasta(df.coalesce(1), str(tmp_path / "out"), width=4)
    text = "".join(gzip.open(p, "rt").read() for p in (tmp_path / "out").glob("*.gz"))
    assert text == ">a\nACGT\nACGT\nA\n>b\nACGT\n"


def test_bed_gtf_tables(spark, tmp_path):
    (tmp_path / "x.bed").write_text('track name=x\nchr1\t5\t9\tn\t3\t-\nchr1\t1\t2\tm\t0\t+\n')
    got = formats.read_bed(spark, str(tmp_path / "x.bed")).orderBy("start_pos").collect()
    assert [tuple(r) for r in got] == [("chr1", 1, 2, "m", 0, "+"), ("chr1", 5, 9, "n", 3, "-")]
    formats.write_bed(formats.read_bed(spark, str(tmp_path / "x.bed")), str(tmp_path / "out"))
    assert formats.read_bed(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "x.gtf").write_text('#c\nchr1\tS\texon\t1\t5\t.\t+\t.\tgene_id "g"; tag "basic";\n')
    row = formats.read_gtf(spark, str(tmp_path / "x.gtf")).first()
    assert (row.right_pos, row.attrs) == (5, 'gene_id "g"; tag "basic";')
    (tmp_path / "x.fai").write_text("a 10 x\nb\t7\n")
    assert [tuple(r) for r in formats.read_index(spark, str(tmp_path / "x.fai")).collect()] == [("a", 10), ("b", 7)]
    (tmp_path / "d.csv").write_text("BASE,Age\nx,3\n")
    assert formats.read_table(spark, str(tmp_path / "d.csv")).dtypes == [("BASE", "string"), ("Age", "int")]
    assert formats.read_table(spark, str(tmp_path / "d.csv"), lower=True).columns == ["base", "age"]
    (tmp_path / "m.csv").write_text("CAAAGT,A2\nGGG,B1\n")
    assert [(r.bc, r.well) for r in formats.read_barcodes(spark, str(tmp_path / "m.csv")).orderBy("pos").collect()] == [("CAAAGT", "A2"), ("GGG", "B1")]


def test_sam_and_vcf(spark, tmp_path):
    lines = ["@HD\tx", "r1\t0\tc\t5\t60\t3S4M2I1D5N1=\t*\t0\t0\tA\tI\tNH:i:1", "r2\t16\tc\t5\t60\t4M\t*\t0\t0\tA\tI\tNH:i:12", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI"]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    sam = formats.read_sam(spark, str(tmp_path / "x.sam"))
    assert [tuple(r) for r in formats.sam_to_bed(unique_alignments(sam)).collect()] == [("c", 4, 15, "r1", 60, "+")]
    vcf = "#h\nc\t1\t.\tA\tC\t30\t.\tx\tGT:DP\t0:25\t1:19\nc\t2\t.\tA\tC\t30\t.\tx\tGT:DP\t0:25\t1:20\nc\t3\t.\tA\tC\t10\t.\tx\tDP\t50\n"
    (tmp_path / "x.vcf").write_text(vcf)
    got = soft_filter(formats.read_vcf(spark, str(tmp_path / "x.vcf"))).orderBy("pos").collect()
    assert [r["filter"] for r in got] == ["LowQual", "PASS", "LowQual"]


def bam_bytes():
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, nh in ((b"a", 0, 1), (b"b", 16, 3), (b"c", 4, 1)):
        cigar = [(4 << 4) | 0, (2 << 4) | 1, (3 << 4) | 3]  # 4M2I3N
        tags = b"XSZhi\0" + b"XBBs" + struct.pack("<I2h", 2, 1, 1) + b"NHC" + bytes([nh])
        body = struct.pack("<iiBBHHHiiii", 0, 10, len(name) + 1, 60, 0, len(cigar), flag, 5, -1, -1, 0)
        body += name + b"\0" + struct.pack(f"<{len(cigar)}I", *cigar) + bytes(3) + bytes(5) + tags
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam(spark, tmp_path):
    data = bam_bytes()
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    rows = bam.read_bam(spark, str(tmp_path / "x.bam")).orderBy("name").collect()
    assert [(r.chrom, r.start_pos, r.end_pos, r.name, r.strand, r.nh) for r in rows] == [("chr1", 10, 17, "a", "+", 1), ("chr1", 10, 17, "b", "-", 3)]
    assert [r.name for r in bam.read_bam(spark, str(tmp_path / "x.bam"), unique=True).collect()] == ["a"]
    counted = alignment_counts(spark, str(tmp_path / "x.bam")).collect()
    assert [(r.chrom, r.start_pos, r.end_pos, r.name, r.score, r.strand) for r in counted] == [("chr1", 10, 11, "x", 1, "+")]


def test_bam_in_ranges(spark, tmp_path):
    rng = random.Random(8)
    refs = [(f"chr{i}", 10_000) for i in range(5)]
    for case, n in enumerate((0, 1, 40, 700)):
        rows = [(f"read{i}/" + "x" * rng.randint(0, 60), rng.randrange(5), rng.randrange(9000), rng.randint(1, 300), rng.choice([0, 4, 16]), rng.randint(1, 9)) for i in range(n)]
        data = gzip.decompress(bam.bam_bytes(refs, rows))
        path = tmp_path / f"{case}.bam"
        for block in (100, 900, 60_000):
            path.write_bytes(bam.blocks_of(data, block))
            file = files_of(str(path))[0]
            whole = list(bam.read_alignments(file))
            assert [(r[4], r[2], r[3], r[8]) for r in whole] == [(a, p, p + size, h) for a, _, p, size, flag, h in rows if flag != 4]
            for size in (37, 500, 5000, 10**7):
                if file.size // size < 800:
                    parts = [r for at in range(0, file.size, size) for r in bam._split_alignments(file, at, min(at + size, file.size))]
                    assert parts == whole
    assert bam.read_bam(spark, str(path), chunk=2000).count() == len(whole)


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        for name, text in (("chr1.fa", ">chr1\nAC\nGT\n"), ("chr1_random.fa", ">chr1_random\nA\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.fa", ">e1\nAC\n>e2\nGG\n")
        z.writestr("b.txt", "no")
    assert [tuple(r) for r in formats.read_archive(spark, str(tmp_path / "x.tar.gz"), exclude=["*_*"]).collect()] == [("chr1.fa", "chr1", "ACGT")]
    assert [(r.id, r.seq) for r in formats.read_archive(spark, str(tmp_path / "x.zip"), include="a.fa").collect()] == [("e1", "AC"), ("e2", "GG")]


def run_stream(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_of_clean_reads_equals_batch(spark, tmp_path, reads_of):
    seqs = ["AAAAAACAAAGTGG" + "ACGT" * 12, "AAAAAACAAAGTGGG" + "ACGT" * 8 + "AGATC", "A" * 40]
    df = reads_of(*seqs)
    df.write.parquet(str(tmp_path / "in"))
    barcodes = [(0, "CAAAGT", "A2")]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run_stream(clean_stream(stream, barcodes), "clean", "append").collect()
    expected = clean_stream(df, barcodes).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) == 2
    assert {r.ordinal for r in prepare_reads(df, barcodes)[0].collect()} == {r.ordinal for r in expected}


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([("A1", "AC", "2031-03-01 10:05:00"), ("A1", "ACG", "2031-03-01 10:55:00"), ("B1", None, "2031-03-01 11:00:00")], "well string, seq string, at string")
    df = df.select("well", "seq", F.to_timestamp("at").alias("run_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    rows = run_stream(reads_per_window(stream), "windows", "complete").orderBy("well").collect()
    assert [(r.well, r.reads, r.bases) for r in rows] == [("A1", 2, 5), ("B1", 1, None)]


def test_stream_periods_reach_the_batch_result(spark, tmp_path):
    schema = "acc string, left_pos bigint, right_pos bigint"
    parts = [[("a", 1, 5), ("b", 1, 2), (None, 1, 2)], [("a", 10, 12), ("a", 9, 4)], [("a", 6, 7), ("a", 20, 30)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = run_stream(stream_periods(stream), "periods", "update")
    everything = spark.createDataFrame([r for p in parts for r in p], schema)
    final = {tuple(r) for r in merge_periods(everything, "acc", "left_pos", "right_pos").collect()}
    assert final <= {tuple(r) for r in updates.collect()}
