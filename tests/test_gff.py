"""From a GFF3 file to a model and back; the file is written here."""

import pytest

from strandline.model import GeneModel
from strandline.operators import derived, extract, grouped
from strandline.sources import gff, sinks

LINES = """##gff-version 3
ch0\tx\tgene\t100\t900\t.\t+\t.\tID=g1;Name=G1
ch0\tx\tmRNA\t100\t900\t.\t+\t.\tID=m1;Parent=g1;Name=M1
ch0\tx\texon\t100\t300\t.\t+\t.\tID=e1;Parent=m1
ch0\tx\texon\t600\t900\t.\t+\t.\tID=e2;Parent=m1
ch0\tx\tCDS\t200\t300\t.\t+\t0\tID=c1;Parent=m1
ch0\tx\tCDS\t600\t700\t.\t+\t1\tID=c1;Parent=m1
ch0\tx\tgene\t1000\t2000\t.\t-\t.\tID=g2
ch0\tx\tmRNA\t1000\t2000\t.\t-\t.\tID=m2;Parent=g2
ch0\tx\texon\t1000\t1100\t.\t-\t.\tID=e3;Parent=m2
ch0\tx\texon\t1900\t2000\t.\t-\t.\tID=e4;Parent=m2
ch0\tx\tCDS\t1050\t1100\t.\t-\t0\tID=c2;Parent=m2
ch0\tx\tmRNA\t3000\t3500\t.\t-\t.\tID=m3
ch0\tx\tCDS\t3000\t3100\t.\t-\t0\tID=c3;Parent=m3
ch0\tx\texon\t7000\t7100\t.\t-\t.\tID=orphan
"""


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("gff") / "small.gff3"
    path.write_text(LINES)
    return gff.from_gff3(spark, str(path))


def test_lengths(model):
    rows = derived.transcript_lengths(model, True, True, True).collect()
    assert [(r["tx_name"], r["gene_id"], r["nexon"], r["tx_len"], r["cds_len"], r["utr5_len"], r["utr3_len"]) for r in rows] == [
        ("M1", "G1", 2, 502, 202, 100, 200), ("m2", "g2", 2, 202, 51, 101, 50), ("m3", None, 1, 101, 101, 0, 0),
    ]


def test_groups(model):
    minus = grouped.exons_by(model, "tx").where("group_id = 2").orderBy("pos").collect()
    assert [(r["start"], r["end"]) for r in minus] == [(1900, 2000), (1000, 1100)]
    five = grouped.five_utrs_by_transcript(model).orderBy("group_id", "pos").collect()
    assert [(r["group_id"], r["start"], r["end"]) for r in five] == [(1, 100, 199), (2, 1900, 2000)]
    assert extract.exons(model).count() == 5


def test_sinks_and_round_trips(model, spark, tmp_path):
    bed = {r["name"]: r for r in sinks.as_bed(model).collect()}
    assert (bed["M1"]["chromStart"], bed["M1"]["blockSizes"], bed["M1"]["blockStarts"], bed["M1"]["thickStart"]) == (99, "201,301", "0,500", 199)
    model.save(str(tmp_path / "model"))
    assert GeneModel.load(spark, str(tmp_path / "model")).equals(model)
    sinks.write_gff3(model, str(tmp_path / "out"))
    again = gff.from_gff3(spark, str(tmp_path / "out"))
    assert [r["cds_len"] for r in derived.transcript_lengths(again, True).collect()] == [202, 51, 101]
    sinks.write_bed(model, str(tmp_path / "bed"))
    assert spark.read.csv(str(tmp_path / "bed"), sep="\t").count() == 3
