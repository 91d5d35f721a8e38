import pytest
from pyspark.sql import functions as F

from helixloom import __main__ as command
from helixloom.options import Options
from helixloom.sources import bam

SAM = "@HD\tVN:1.0\n" + "".join(
    f"s{i}\t99\tc\t{101 + i // 2}\t50\t10M\t=\t{151 + i // 2}\t60\tACGTACGTAC\tIIIIIIIIII\tNH:i:1\tMD:Z:10\ns{i}\t147\tc\t{151 + i // 2}\t50\t10M\t=\t{101 + i // 2}\t-60\tACGTACGTAC\tIIIIIIIIII\tNH:i:1\tMD:Z:10\n" for i in range(40)
)
GRAPH = "Instance\tg\nBoundary\tc 101 200 +\nReads\t9\nSegs\t1\n101\t200\t0\t0\t0\t0\t0\t0\nRefs\t0\nSGTypes\t1\n1 9\nPETypes\t0 0\n"


def test_a_run_from_the_command_line(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "g.txt").write_text(GRAPH)
    (tmp_path / "lengths").write_text("59 0.25\n60 0.75\n")
    out = str(tmp_path / "out")
    command.main(["-b", str(tmp_path / "a.sam"), "-i", str(tmp_path / "g.txt"), "-o", out, "-m", "--output-mode", "full", "--keep-temp-files", "--fragment-lengths", str(tmp_path / "lengths"), "--gibbs-iteration-scaling", "1"], spark)
    line = [r["value"] for r in spark.read.text(f"{out}/transcripts").collect()]
    assert len(line) == 1 and 'transcript_id "g_seq0"' in line[0] and 'expected_count "20"' in line[0] and 'transcript_confidence "1"' in line[0]
    assert [(r["locus_id"], r["return_code"]) for r in spark.read.csv(f"{out}/loci", sep="\t", header=True).collect()] == [("g", "0")]
    kept = spark.read.format("bam").load(f"{out}/deduplicated/unstranded")
    assert kept.count() == 40 and kept.filter("ref = 'c' AND pos = 150").count() == 1
    assert kept.agg(F.countDistinct("name")).first()[0] == 20
    assert bam.files_of(f"{out}/deduplicated/unstranded")


def test_arguments_become_options():
    read = lambda *a: command.options_of(command.parser().parse_args(["-b", "x", "-i", "y", "-o", "z", *a]))
    assert read() == Options()
    assert read("-s", "first", "-c", "0.2", "--max-candidate-number", "7", "--dirichlet-parameter", "0.5", "-m") == Options(strand="first", confidence_threshold=0.2, max_candidates=7, gamma=0.5, pre_mrna=False)
    with pytest.raises(ValueError, match="go together"):
        read("--frag-mean", "200")
    with pytest.raises(SystemExit):
        command.parser().parse_args(["-b", "x"])
