"""Text VCF: fields by FORMAT, several alternatives, missing values, files of different samples."""

import pytest
from pyspark.sql import functions as F

from varloom.sources import readers

FIRST = """##fileformat=VCFv4.2
##INFO=<ID=DB>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t10\trs1\tA\tG\t30\tPASS\tDB;AC=2\tES:SE:LP:ID\t0.5:0.1:3:rsX\t.
1\t20\t.\tA\tC,T\t.\t.\t.\tES:LP:AF\t0.1,0.2:2,4:0.3\t-0.1,.:1,2
"""
SECOND = """#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tother
2\t5\trs9\tG\tA\t.\tq10\tEND=7\tLP:SS:ES\t0:1000:-2
"""
BARE = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n3\t1\trs3\tC\tT\t.\tPASS\tX=a=b\n"


@pytest.fixture
def paths(tmp_path):
    out = []
    for name, text in (("a.vcf", FIRST), ("b.vcf", SECOND), ("c.VCF", BARE)):
        (tmp_path / name).write_text(text)
        out.append(str(tmp_path / name))
    return out


def test_rows(spark, paths):
    got = {(r.Chromosome, r.Position, r.EA, r.sample): r for r in readers.scan_vcf(spark, paths).collect()}
    assert set(got) == {("1", "10", "G", "s1"), ("1", "10", "G", "s2"), *[("1", "20", a, s) for a in "CT" for s in ("s1", "s2")], ("2", "5", "A", "other"), ("3", "1", "T", None)}
    r = got["1", "10", "G", "s1"]
    assert r.fields == {"ES": "0.5", "SE": "0.1", "LP": "3", "ID": "rsX"} and r.info == {"DB": "", "AC": "2"} and r["filter"] == "PASS"
    assert got["1", "10", "G", "s2"].fields == {} and got["1", "20", "C", "s2"].fields == {"ES": "-0.1,.", "LP": "1,2"}
    assert got["1", "20", "C", "s1"].id is None and got["2", "5", "A", "other"].fields == {"LP": "0", "SS": "1000", "ES": "-2"}
    assert got["3", "1", "T", None].info == {"X": "a=b"} and got["3", "1", "T", None].fields == {}


def test_association_rows(spark, paths):
    out = readers.scan_by_extension(spark, paths).withColumn("P", F.round(F.col("P").cast("double"), 9))
    got = {(r.dataset, r.Position, r.EA): (r.RSID, r.P, r.BETA, r.SE, r.AF, r.N) for r in out.collect()}
    assert got == {
        ("s1", "10", "G"): ("rsX", 0.001, "0.5", "0.1", None, None),
        ("s1", "20", "C"): (None, 0.01, "0.1", None, "0.3", None), ("s1", "20", "T"): (None, 0.0001, "0.2", None, "0.3", None),
        ("s2", "20", "C"): (None, 0.1, "-0.1", None, None, None), ("s2", "20", "T"): (None, 0.01, None, None, None, None),
        ("other", "5", "A"): ("rs9", 1.0, "-2", None, None, "1000"),
    }
