import pytest

from methlake.functions.parse import csv_fields, strict_float, strict_uint
from methlake.functions import reads as R
from methlake.operators import calls as C
from methlake.sources import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ",".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize("line, want", [
    ("a,b,,c", ["a", "b", "", "c"]), ('"cg1","x, y",0.5\r', ["cg1", "x, y", "0.5"]), ('"say ""hi""",1', ['say "hi"', "1"]),
    ("", [""]), (",", ["", ""]), ('a"b,c', ['a"b', "c"]), ('"open,1', ["open,1"]),
])
def test_csv_records(spark, line, want):
    from pyspark.sql import functions as F

    assert one(spark, csv_fields(F.col("x")), x=line) == want


def test_strict_numbers(spark):
    from pyspark.sql import functions as F

    texts = ["7", "+7", " 7", "7.0", "-7", "", "1e2", ".5", "5.", "0.5f", "0.5d", "inf", "-Infinity", "NaN", "nan", "0x1", "1_0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", strict_uint(F.col("t")).alias("u"), strict_float(F.col("t")).cast("string").alias("f")).orderBy("i").collect()
    assert [r["u"] for r in rows] == [7, 7] + [None] * 15
    assert [r["f"] for r in rows] == ["7.0", "7.0", None, "7.0", "-7.0", None, "100.0", "0.5", "5.0", None, None, "Infinity", "-Infinity", "NaN", "NaN", None, None]


def test_betas(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text('﻿ID_REF , methylation_call\r\n"cg1","0.5"\r\ncg2,-1\ncg3,NA\ncg4,.\ncg5,nan\ncg6,1.7\ncg7,abc\ncg8,inf\ncg9,0.5f\ncg10\n\n,0.3\ncg2,0.8\n')
    b.write_text("x,PROBE_ID,Beta\n1,cg1,0.25\n")
    values, report = T.read_betas(spark, [str(a), str(b)])
    got = sorted((r["path"][-5:], r["probe_id"], round(r["beta"], 4)) for r in values.collect())
    assert got == [("a.csv", "cg1", 0.5), ("a.csv", "cg2", 0.0), ("a.csv", "cg2", 0.8), ("a.csv", "cg6", 1.7), ("b.csv", "cg1", 0.25)]
    assert {(r["code"], r["n"], r["first_line"]) for r in report.collect()} == {("CSV_VALUES", 3, 8), ("CSV_RANGE", 1, 7)}
    probes = spark.createDataFrame([("cg1", 0), ("cg2", 1)], "cg_id string, probe_idx int")
    vector = C.ternary_vector(values.filter("path like '%a.csv'").withColumnRenamed("path", "sample_id"), probes).collect()
    assert [(r["probe_idx"], r["t"]) for r in vector] == [(1, 1)]
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(Exception, match="no probe id column"):
        T.read_betas(spark, str(tmp_path / "c.csv"))[0].collect()


def test_pileups(spark, tmp_path):
    p = tmp_path / "p.bed"
    row = lambda start, m, u, contig="chr1": "\t".join([contig, str(start), *["x"] * 9, str(m), str(u)])
    p.write_text("\n".join(["chrom\tstart\t" + "\t".join("abcdefghijk"), "# note", row(5, 3, 4), "", row(5, 1, 0), row(7, "x", 1), "chr1\t8", row(9, 2, 2) + "\textra"]) + "\n")
    sites, report = T.read_pileup(spark, str(p))
    assert sorted((r["pos"], r["n_mod"], r["n_unmod"]) for r in sites.collect()) == [(5, 1, 0), (5, 3, 4), (9, 2, 2)]
    assert [(r["code"], r["n"], r["first_line"]) for r in report.collect()] == [("PILEUP_ROWS", 2, 6)]


def test_line_numbers_survive_splits(spark, tmp_path):
    p = tmp_path / "counts.tsv"
    p.write_text("probe_id\tn_mod\tn_unmod\tfraction\n" + "".join(f"cg{i}\t{i}\t1\t0.5\n" if i != 700 else "cg700\tx\t1\n" for i in range(1, 1001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        counts, report = T.read_counts(spark, str(p))
        assert T.read_lines(spark, str(p)).rdd.getNumPartitions() > 3
        assert counts.count() == 999
        assert [(r["n"], r["first_line"]) for r in report.collect()] == [(1, 701)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_counts_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("cg1\t1\t2\ncg2\t3\n")
    (tmp_path / "b.tsv").write_text("probe_id\tn_mod\tn_unmod\ncg1\t10\t20\t0.3\n")
    counts, report = T.read_counts(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    assert {(r["probe_id"], r["n_mod"], r["n_unmod"]) for r in C.sum_counts(counts, ["probe_id"]).collect()} == {("cg1", 11, 22)}
    assert report.count() == 1


def test_probe_maps(spark, tmp_path):
    p = tmp_path / "p.bed"
    p.write_text("chrom\tstart\tend\tcg\nchr1\t5\t7\tcgA\nchr1\tx\t7\tcgB\nchr2\t9\t11\tcgC\n")
    rows = T.read_probe_bed(spark, str(p)).orderBy("probe_idx").collect()
    assert [(r["cg_id"], r["probe_idx"]) for r in rows] == [("cgA", 0), ("cgB", 1), ("cgC", 2)]
    assert T.read_probe_bed(spark, str(p), strict=False).count() == 2
    p.write_text("chr1\t5\t7\n")
    with pytest.raises(Exception, match="fewer than 4 columns"):
        T.read_probe_bed(spark, str(p)).collect()


def test_cohorts(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text("# list\n/x/a.bam\tbam\tL1\n\n/x/b.csv\tbeta\tnode one\n")
    assert [(r["input"], r["kind"], r["label"]) for r in T.read_cohort(spark, str(p)).orderBy("sample_id").collect()] == [
        ("/x/a.bam", "bam", "L1"), ("/x/b.csv", "beta", "node one"),
    ]
    p.write_text("/x/a.bam\tbam\n")
    with pytest.raises(Exception, match="expected path, kind, label"):
        T.read_cohort(spark, str(p)).collect()


def test_thresholds_at_their_bytes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(257).select("id", R.outcome(F.col("id")).alias("o")).collect()
    got = {r["id"]: r["o"] for r in rows}
    assert [got[i] for i in (0, 76, 77, 179, 180, 256)] == [-1, -1, 0, 0, 1, 1]
