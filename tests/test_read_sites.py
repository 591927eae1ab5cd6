"""Tags and outcomes of a batch of reads against the column expressions."""

import pyarrow as pa
from pyspark.sql import functions as F

from methlake.functions import reads as R
from methlake.operators import read_sites


def test_tags_are_parsed_as_by_the_expression(spark):
    tags = ["C+m,0,1;", "A+a,1,2;C+m?, 3 ,+4;", " C+mh.,1,x,,2;C+m", "C+76792,5;C-m?;", "", ";;", "C+,1;CC", None, "C+m?,-1,7;G+m,2;C+h,0"]
    for single in (True, False):
        rows = spark.createDataFrame([(t,) for t in tags], "mm string").select("mm", R.parse_mm(F.col("mm"), single).alias("g")).collect()
        for r in rows:
            want = [(g["implicit"], g["n_codes"], g["ml_start"], g["deltas"]) for g in r["g"] or [] if g["base"] == "C"]
            assert read_sites.parse_tag(r["mm"], single) == want, r["mm"]


def test_a_batch_is_decoded_whatever_its_reads_lack():
    near = [[{"pos": 10, "cg_id": "a"}, {"pos": 11, "cg_id": "b"}, {"pos": 99, "cg_id": "c"}], None, [{"pos": 5, "cg_id": "d"}], []]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([7, 8, 9, 10]), pa.array([10, None, 5, 0], pa.int64()), pa.array([12, None, 6, 4], pa.int64()), pa.array([False] * 4),
            pa.array([2, None, 1, 4], pa.int32()), pa.array([[2 << 4], None, [1 << 4], [4 << 4]], pa.list_(pa.int64())),
            pa.array([b"\x21", None, b"\x20", b"\x22\x22"], pa.binary()), pa.array(["C+m,0;", None, None, "C+m,0;"]),
            pa.array([b"\xff", None, None, b"\x00"], pa.binary()), pa.array(near, pa.list_(pa.struct([("pos", pa.int64()), ("cg_id", pa.string())]))),
        ],
        names=["k", "ref_start", "ref_end", "is_reverse", "l_seq", "cigar", "seq", "mm", "ml", "near"],
    )
    schema = pa.schema([("k", pa.int64()), ("probe_id", pa.string()), ("outcome", pa.int8())])
    got = [r for out in read_sites.outcomes(batch, schema, 0.3, 0.7, True, True) for r in out.to_pylist()]
    want = [(7, "a", 1), (7, "b", None), (8, None, None), (9, "d", None), (10, None, None)]
    assert sorted((tuple(r.values()) for r in got), key=repr) == sorted(want, key=repr)
