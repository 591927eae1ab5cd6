"""Index-pruned scans: planning, packing, filters, and columns taken out of records side by side."""

import random
import statistics
import struct

import pytest

from methlake.functions.reads import OPS_ON_REFERENCE
from methlake.sources import bam, bam_plan
from methlake.sources.bam_columns import RecordBlock
from methlake.sources.bam_index import read_index
from methlake.sources.bam_write import indexed_bytes


@pytest.fixture(scope="module")
def panel(tmp_path_factory):
    """12,000 reads over three contigs, with an index."""
    rnd, reads = random.Random(1), []
    for contig in range(3):
        for pos in sorted(rnd.randrange(2_000_000) for _ in range(4000)):
            n = rnd.randint(1, 40)
            reads.append({"contig": contig, "pos": pos, "flag": rnd.choice([0, 16, 256]), "l_seq": 4 * n, "cigar": [4 * n << 4, rnd.randint(0, 900) << 4 | 2], "seq": b"\x12\x48" * n, "mm": "C+m,0;", "ml": bytes([rnd.randrange(256)])})
    path = str(tmp_path_factory.mktemp("panel") / "p.bam")
    made = indexed_bytes([(f"c{i}", 2_100_000) for i in range(3)], reads)
    for data, name in zip(made, (path, path + ".bai")):
        with open(name, "wb") as f:
            f.write(data)
    return path, reads


def tasks(df):
    return df.rdd.getNumPartitions()


def test_cuts_lie_at_records_and_cover_the_stretches():
    found = bam_plan.pieces("f", [(5 << 16, 900 << 16), (950 << 16, 990 << 16)], [x << 16 for x in range(0, 1000, 7)], 50)
    assert [(p.begin, p.end) for p in found][0][0] == 5 << 16 and found[-1].end == 990 << 16
    assert all(a.end == b.begin or (a.end, b.begin) == (900 << 16, 950 << 16) for a, b in zip(found, found[1:]))
    assert all((p.end >> 16) - (p.begin >> 16) <= 50 for p in found)
    assert all(p.begin >> 16 in (5, 950) or (p.begin >> 16) % 7 == 0 for p in found)


def test_pieces_without_inner_records_stay_whole():
    assert [(p.begin, p.end) for p in bam_plan.pieces("f", [(1, 1000 << 16)], [], 10)] == [(1, 1000 << 16)]


@pytest.mark.parametrize("count", [None, 4])
def test_packing_is_even_and_loses_nothing(count):
    rnd = random.Random(2)
    items, at = [], 0
    for _ in range(300):
        size = rnd.choice([1 << 10, 1 << 18, 1 << 21])
        items.append(bam_plan.Piece(f"f{rnd.randrange(5)}", at << 16, at + size << 16))
        at += size
    bins = bam_plan.pack(items, 8 << 21, count)
    assert sorted((p.path, p.begin) for b in bins for p in b) == sorted((p.path, p.begin) for p in items)
    loads = [sum(p.cost for p in b) for b in bins]
    assert max(loads) < 2 * statistics.median(loads) and (count is None or len(bins) == count)


def overlapping(reads, regions):
    span = lambda r: sum(c >> 4 for c in r["cigar"] if c & 15 in OPS_ON_REFERENCE)
    return sorted((r["contig"], r["pos"]) for r in reads if any(f"c{r['contig']}" == c and r["pos"] <= e and r["pos"] + span(r) > b for c, b, e in regions))


@pytest.mark.parametrize("split", [0, 3000, 20_000, 128 << 20])
def test_regions_of_an_indexed_file(spark, panel, split):
    path, reads = panel
    regions = [["c0", 100_000, 180_000], ["c0", 170_000, 171_000], ["c2", 1_990_000, 2_050_000], ["c2", 5, 5], ["no", 0, 9]]
    df = bam.scan(spark, [path], regions=regions, splitBytes=split)
    got = df.filter("kind = 'read'").select("rid", "pos").collect()
    assert sorted(map(tuple, got)) == overlapping(reads, regions)
    assert [r["stop"] for r in df.filter("kind = 'span'").collect()] == [bam.SPAN_EOF]  # the plan stands for the file
    by_path = bam.scan(spark, [path], regions={path: regions, "other": []}, splitBytes=split, columns=["pos", "kind"])
    assert by_path.columns == ["pos", "kind"] and by_path.filter("kind = 'read'").count() == len(got)


def test_shards_of_regions_share_the_work(spark, panel):
    path, reads = panel
    regions = [["c0", 0, 2_000_000], ["c1", 500_000, 1_500_000]]
    parts = [bam.scan(spark, [path], regions=regions, splitBytes=10_000, shard=f"{i}/3").filter("kind = 'read'").select("rid", "pos").collect() for i in range(3)]
    assert sorted(tuple(r) for p in parts for r in p) == overlapping(reads, regions)
    assert max(map(len, parts)) < 1.5 * min(map(len, parts))


def test_filters_reach_the_index(spark, panel):
    path, reads = panel
    for condition, keep in (
        ("rid = 1 AND pos >= 500000 AND pos < 520000", lambda r: r["contig"] == 1 and 500_000 <= r["pos"] < 520_000),
        ("rid IN (0, 2) AND pos > 1999000", lambda r: r["contig"] in (0, 2) and r["pos"] > 1_999_000),
        ("rid = 2", lambda r: r["contig"] == 2),
        ("rid = 7", lambda r: False),
        ("rid = -1", lambda r: False),
        ("pos <= 1000", lambda r: r["pos"] <= 1000),
        (f"rid = 0 AND pos = {reads[17]['pos']} AND path = '{path}'", lambda r: r["contig"] == 0 and r["pos"] == reads[17]["pos"]),
        ("rid = 0 AND path = 'another'", lambda r: False),
    ):
        got = bam.scan(spark, [path], splitBytes=5000).filter(condition).select("rid", "pos").collect()
        assert sorted(map(tuple, got)) == sorted((r["contig"], r["pos"]) for r in reads if keep(r)), condition
    whole, few = bam.scan(spark, [path], splitBytes=5000), bam.scan(spark, [path], splitBytes=5000).filter("rid = 1 AND pos < 20000")
    assert tasks(few) < tasks(whole) / 4


def test_an_index_that_cannot_be_used_costs_speed_alone(spark, panel, tmp_path):
    path, reads = panel
    copy = tmp_path / "c.bam"
    copy.write_bytes(open(path, "rb").read())
    (tmp_path / "c.bam.bai").write_bytes(b"BAI\x01" + struct.pack("<i", 9))
    df = bam.scan(spark, [str(copy)], regions=[["c0", 0, 10]], splitBytes=30_000)
    assert df.filter("kind = 'read'").count() == len(reads)
    assert [r["code"] for r in df.filter("kind = 'issue'").collect()] == ["INDEX_UNREADABLE"]
    df = bam.scan(spark, [path], regions=[["c0", 0, 1 << 30]], splitBytes=30_000)
    assert df.filter("kind = 'read'").count() == len(reads) and [r["code"] for r in df.filter("kind = 'issue'").collect()] == ["INDEX_QUERY"]


def test_index_of_the_writer(panel):
    index = read_index(panel[0] + ".bai")
    assert len(index.refs) == 3 and all(r.meta[2] == 4000 for r in index.refs)


# ---- optional fields, by the rules of the format one record at a time


def slow_tags(data, at, lenient):
    width = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    seen, ok = {}, True
    while at < len(data):
        if at + 3 > len(data):
            ok = False
            break
        tag, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in width:
            stop = after = at + width[kind]
        elif kind in "ZH":
            stop = data.find(b"\0", at)
            after = stop + 1
            if stop < 0:
                ok, seen = False, seen if lenient else {}
                break
        elif kind == "B" and at + 5 > len(data):
            ok = False
            break
        elif kind == "B" and chr(data[at]) in width:
            stop = after = at + 5 + width[chr(data[at])] * struct.unpack_from("<I", data, at + 1)[0]
        else:
            ok, seen = False, seen if lenient else {}
            break
        if after > len(data):
            ok = False
            break
        seen.setdefault(tag, (kind, data[at:stop]))
        at = after
    mm, ml, mn = seen.get("MM") or seen.get("Mm"), seen.get("ML") or seen.get("Ml"), seen.get("MN")
    of = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
    return (
        mm[1].decode("utf-8", "replace") if mm and mm[0] == "Z" else None,
        ml[1][5:] if ml and ml[0] == "B" and ml[1][:1] == b"C" else None,
        chr(ml[1][0]) if ml and ml[0] == "B" else None,
        struct.unpack(of[mn[0]], mn[1])[0] if mn and mn[0] in of else None, ok,
    )


@pytest.mark.parametrize("lenient", [False, True])
def test_tags_side_by_side(lenient):
    rnd = random.Random(9)

    def field():
        name = rnd.choice(["MM", "Mm", "ML", "Ml", "MN", "XX", "CG"])
        kind = rnd.choice("AcCsSiIfZHB" + "?" * (rnd.random() < 0.05))
        body = {"Z": b"C+m,0;\0", "H": b"1AE3\0", "?": b""}.get(kind)
        if kind == "Z" and rnd.random() < 0.1:
            body = b"\xff\xfe\0"
        if kind == "B":
            inner = rnd.choice("cCsSiIfAZ")
            n = rnd.randint(0, 4)
            body = inner.encode() + struct.pack("<I", n) + bytes(rnd.randrange(256) for _ in range(n * {"c": 1, "C": 1, "A": 1, "s": 2, "S": 2}.get(inner, 4)))
        elif body is None:
            body = bytes(rnd.randrange(256) for _ in range({"A": 1, "c": 1, "C": 1, "s": 2, "S": 2}.get(kind, 4)))
        return name.encode() + kind.encode() + body

    records, want = [], []
    for _ in range(3000):
        aux = b"".join(field() for _ in range(rnd.randint(0, 6)))
        if rnd.random() < 0.2:
            aux = aux[: rnd.randint(0, len(aux))]
        n = rnd.randint(0, 9)
        cigar = [n << 4 | 4, 3 << 4 | 3] if rnd.random() < 0.3 else [n << 4] * rnd.randint(0, 3)
        head = struct.pack("<iiBBHHHiiii", 0, 5, 2, 60, 0, len(cigar), 16, n, -1, -1, 0) + b"r\0" + struct.pack(f"<{len(cigar)}I", *cigar)
        head += bytes((n + 1) // 2) + b"\xff" * n
        records.append(head + aux)
        want.append(slow_tags(head + aux, len(head), lenient))
    block = RecordBlock(records, lenient)
    got = list(zip(*(block.column(c).to_pylist() for c in ("mm", "ml", "ml_kind", "mn", "aux_ok"))))
    assert got == want
    assert block.column("l_seq").to_pylist() == [struct.unpack_from("<i", r, 16)[0] for r in records]
    assert len(block.cigars()[1]) == len(records) + 1
