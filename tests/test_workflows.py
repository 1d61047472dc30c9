"""Commands from files to files on a tiny experiment."""

import gzip
import io
import tarfile
import zipfile

from readloom.plans import workflows as X
from readloom.sources import formats
from readloom.sources.fastq import read_fastq
from tests_bam import write_bam


def lines(folder):
    out = []
    for p in sorted(folder.rglob("part-*")):
        out += (gzip.open(p, "rt") if p.suffix == ".gz" else open(p)).read().splitlines()
    return out


def test_prepare_reads(spark, tmp_path):
    seqs = ["AAAAAACAAAGTGG" + "ACGT" * 12, "AAAAAACAAAGTGG" + "ACGT" * 12, "CCCCCCTTTTTTGG" + "ACGT" * 12, "AC"]
    (tmp_path / "r.fq").write_text("".join(f"@r{i} x\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)))
    (tmp_path / "map.csv").write_text("CAAAGT,A2\n")
    X.prepare_reads_files(spark, str(tmp_path / "r.fq"), str(tmp_path / "map.csv"), str(tmp_path / "out"))
    kept = read_fastq(spark, str(tmp_path / "out/reads/well=A2")).collect()
    assert [(r.acc, r.seq) for r in kept] == [("@r1:AAAAAA xCAAAGT", "ACGT" * 12)]
    rows = [x.split(",") for x in lines(tmp_path / "out/counts") if not x.startswith("step")]
    total = {}
    for step, _, _, n in rows:
        total[step] = total.get(step, 0) + int(n)
    assert total == {"1": 4, "2": 3, "3": 3, "4": 2, "5": 2, "6": 2, "7": 2, "8": 2}


def test_reference_and_counts(spark, tmp_path):
    with tarfile.open(tmp_path / "g.tar.gz", "w:gz") as t:
        for name, text in (("chr1.fa", ">chr1 main\n" + "ACGT" * 30 + "\n"), ("chr1_alt.fa", ">chr1_alt\nA\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("kit.fa", ">E1\n" + "A" * 95 + "\n")
    (tmp_path / "ribo.fa").write_text(">x\nACGTACGT\n")
    p = lambda *x: str(tmp_path.joinpath(*x))
    X.prepare_genome(spark, p("g.tar.gz"), p("genome"))
    X.prepare_spikein(spark, p("s.zip"), p("spike"))
    X.prepare_ribosome(spark, p("ribo.fa"), p("ribo"))
    X.build_reference(spark, p("genome"), p("spike"), p("ribo"), p("ref"))
    index = {r.acc: r.len for r in formats.read_index(spark, p("ref", "index")).collect()}
    assert index == {"chr1": 120, "RNA_SPIKE_E1": 100, "RIBO_U13369.1": 8}

    tags = 'gene_id "g1"; transcript_id "t1"; gene_name "G"; exon_number 1;'
    gtf = [("transcript", 11, 60), ("exon", 11, 60), ("start_codon", 31, 33)]
    (tmp_path / "a.gtf").write_text("".join(f"chr1\tS\t{f}\t{a}\t{b}\t.\t+\t.\t{tags}\n" for f, a, b in gtf))
    X.prepare_transcriptome(spark, p("a.gtf"), p("ref", "index"), p("tx"))
    utr = X.region_set(spark, p("tx"), "coding_5utr").collect()
    assert [(r.start_pos, r.end_pos, r.name) for r in utr] == [(10, 30, "G|g1|t1")]
    merged = X.region_set(spark, p("tx"), "coding_whole").collect()
    assert [(r.start_pos, r.end_pos, r.name) for r in merged] == [(0, 60, "G")]
    assert "G,g1:t1" in lines(tmp_path / "tx/coding_whole_accessions")
    (head,) = [row for row in lines(tmp_path / "tx/coding_whole") if row.startswith("track")]
    assert head.startswith("track name=CodingWhole description=") and head.endswith('colorByStrand="38,139,210 203,75,22"')

    refs = [("chr1", 120), ("RNA_SPIKE_E1", 100), ("RIBO_U13369.1", 8)]
    write_bam(tmp_path / "L1.bam", refs, [(0, 15, 0, 1), (0, 15, 0, 1), (0, 50, 0, 1), (1, 5, 0, 1), (1, 70, 0, 1), (2, 2, 16, 1), (0, 20, 0, 4)])
    X.count_alignments(spark, p("L1.bam"), p("counts"))
    assert sorted((r.chrom, r.start_pos, r.score, r.base) for r in X.read_counts(spark, p("counts")).collect()) == [
        ("RIBO_U13369.1", 5, 1, "L1"), ("RNA_SPIKE_E1", 5, 1, "L1"), ("RNA_SPIKE_E1", 70, 1, "L1"), ("chr1", 15, 2, "L1"), ("chr1", 50, 1, "L1"),
    ]
    (tmp_path / "design.csv").write_text("BASE,note\nL1,x\n")
    X.quantify_files(spark, p("design.csv"), p("counts"), p("tx"), p("matrix"))
    rows = sorted(lines(tmp_path / "matrix"))
    assert [r for r in rows if not r.startswith("ID")] == ["G,g1:t1,3000.0,3", "RIBO_U13369.1,NA,1000.0,1", "RNA_SPIKE_E1,NA,1000.0,1"]
    assert set(rows) >= {"ID,ACCESSIONS,N|L1,R|L1"}
    (tmp_path / "lengths.csv").write_text("base,length,reads\nL1,40,6\nL1,41,4\n")
    X.qualify_files(spark, p("design.csv"), p("counts"), p("tx"), p("lengths.csv"), p("quality"))
    (row,) = spark.read.csv(p("quality"), header=True, inferSchema=True).collect()
    assert (row.BASE, row.note, row.TOTAL_READS, row.MAPPED_READS, row.MAPPED_RATE) == ("L1", "x", 10, 6, 0.6)
    assert (row.RIBOSOME_READS, row.SPIKEIN_READS, row.SPIKEIN_5END_READS, row.CODING_READS, row.CODING_5END_READS) == (1, 2, 1, 3, 2)
    assert (row.RELATIVE_POLYA_RNAS, row.CODING_5END_RATE) == (3.0, 2 / 3)


def test_variation(spark, tmp_path):
    rows = [("c", 7, 8, "rs2", "+", "A/T", "single"), ("c", 3, 5, "rs1", "-", "-/AC", "deletion")]
    text = "".join(f"1\t{c}\t{s}\t{e}\t{n}\t0\t{d}\tA\tA\t{o}\tgenomic\t{k}\tx\n" for c, s, e, n, d, o, k in rows)
    (tmp_path / "known.txt").write_text(text)
    X.prepare_variation(spark, str(tmp_path / "snps.txt"), str(tmp_path / "out"), url=(tmp_path / "known.txt").as_uri(), download="only")
    assert (tmp_path / "snps.txt").read_text() == text and not (tmp_path / "out").exists()
    X.prepare_variation(spark, str(tmp_path / "snps.txt"), str(tmp_path / "out"))
    assert lines(tmp_path / "out/snp") == ["rs1\tdeletion\tc\t3\t2", "rs2\tsingle\tc\t7\tT"]
    assert lines(tmp_path / "out/haplotype") == ["ht_rs1\tc\t3\t4\trs1", "ht_rs2\tc\t7\t7\trs2"]
