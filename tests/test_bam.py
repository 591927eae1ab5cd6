import json
import struct
from collections import Counter

import pytest

import fixtures as X
from methlake.model.artifact import load_model
from methlake.plans import entries as E
from methlake.sources import bam
from methlake.sources.bam_index import region_bin, metadata_bin
from methlake.sources.bgzf import BlockCursor, BlockFile, DamagedBlock, inflate_all

SPAN = 3000


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    refs = X.grch38_refs()
    reads = X.random_reads(400, 3, SPAN)
    path = str(folder / "a.bam")
    lengths = X.write_bam(path, refs, [X.to_record(r) for r in reads])
    sites = [(f"chr{c + 1}", p, f"cg{c}_{p}") for c in range(3) for p in range(0, SPAN + 200, 3)]
    X.model_folder(folder / "model", sites)
    return {"folder": folder, "path": path, "reads": reads, "lengths": lengths, "sites": sites, "refs": refs}


def brute_counts(world):
    counts = {}
    for r in world["reads"]:
        sites = {p: cg for c, p, cg in world["sites"] if c == f"chr{r['rid'] + 1}"}
        for cg, call in X.read_calls(r, sites).items():
            if call != "between":
                m, u = counts.get(cg, (0, 0))
                counts[cg] = (m + (call == "m"), u + (call == "u"))
    return counts


def rows(df):
    return {r["probe_id"]: (r["n_mod"], r["n_unmod"]) for r in df.collect()}


def test_counts_equal_brute_force(spark, world):
    counts, warnings, spans = E.bam_counts(spark, [world["path"]], load_model(spark, str(world["folder"] / "model")))
    want = brute_counts(world)
    assert len(want) > 200
    assert rows(counts) == want
    assert warnings.count() == 0
    assert [r["stop"] for r in spans.collect()] == [bam.SPAN_EOF]


@pytest.mark.parametrize("split", [300, 1500, 7000])
def test_any_split_reads_every_record_once(spark, world, split):
    df = bam.scan(spark, [world["path"]], splitBytes=split)
    got = Counter((r["rid"], r["pos"], r["flag"], r["mm"]) for r in df.filter("kind = 'read'").collect())
    assert got == Counter((r["rid"], r["pos"], r["flag"], r["mm"]) for r in world["reads"])
    assert df.filter("kind = 'issue'").count() == 0


def test_shards_add_up_to_the_whole(spark, world, tmp_path):
    model = load_model(spark, str(world["folder"] / "model"))
    parts = []
    for i in range(3):
        counts, warnings, spans = E.bam_counts(spark, [world["path"]], model, shard=f"{i}/3")
        parts.append(str(tmp_path / f"part{i}"))
        E.write_counts(counts.drop("sample_id"), parts[-1], warnings, spans)
    ranges = [p + ".range" for p in parts]
    values, _ = E.counts_values(spark, parts, [p + ".warnings" for p in parts], ranges)
    want = {cg: m / (m + u) for cg, (m, u) in brute_counts(world).items()}
    got = {r["probe_id"]: r["beta"] for r in values.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    with pytest.raises(ValueError, match="exactly once"):
        E.counts_values(spark, [parts[0], parts[2]], [], [ranges[0], ranges[2]])
    with pytest.raises(ValueError, match="exactly once"):  # the first shard is missing
        E.counts_values(spark, parts[1:], [], ranges[1:])


def test_damaged_block_is_skipped_and_reported(spark, world, tmp_path):
    data = bytearray(open(world["path"], "rb").read())
    k = len(world["lengths"]) // 2
    data[sum(world["lengths"][:k]) + 40] ^= 0xFF
    bad = tmp_path / "bad.bam"
    bad.write_bytes(bytes(data))
    df = bam.scan(spark, [str(bad)], splitBytes=0)
    n = df.filter("kind = 'read'").count()
    assert len(world["reads"]) - 25 < n < len(world["reads"])
    assert {r["code"] for r in df.filter("kind = 'issue'").collect()} == {"BAM_CORRUPT"}


def test_records_longer_than_a_window_are_found(spark, tmp_path):
    """A record of over 64 MB between short ones, with splits that begin inside it."""
    seq = "ACGT" * (12 << 20)
    recs = [X.record(f"r{i}", 0, i, 0, [(4, "M")], "ACGT") for i in range(50)]
    recs.insert(20, X.record("long", 0, 20, 0, [(len(seq), "I")], seq))
    path = tmp_path / "long.bam"
    X.write_bam(path, [("chr1", 1000)], recs)
    size = path.stat().st_size
    df = bam.scan(spark, [str(path)], splitBytes=size // 3)
    got = Counter((r["pos"], r["l_seq"]) for r in df.filter("kind = 'read'").select("pos", "l_seq").collect())
    assert got == Counter({**{(i, 4): 1 for i in range(50)}, (20, len(seq)): 1})
    assert df.filter("kind = 'issue'").count() == 0


def test_header_and_index_facts(spark, world, tmp_path):
    refs = bam.scan(spark, [world["path"]], emit="refs").orderBy("rid").collect()
    assert [(r["name"], r["length"]) for r in refs] == world["refs"]
    cram, text = tmp_path / "x.cram", tmp_path / "x.txt"
    cram.write_bytes(b"CRAM" + b"\0" * 50)
    text.write_bytes(b"hello, this is no alignment file")
    files = {r["path"]: r for r in bam.scan(spark, [world["path"], str(cram), str(text)], emit="files").collect()}
    assert files[str(cram)]["container"] == "cram" and files[str(text)]["container"] == "other"
    assert files[world["path"]]["n_refs"] == 22 and files[world["path"]]["index_state"] == "none"


def test_region_query_through_an_index(spark, world, tmp_path):
    """An index with one chunk per reference; records of other references are not returned."""
    raw = BlockCursor(BlockFile(world["path"]))
    bam.read_header(raw)
    starts = {}
    while True:
        at = raw.virtual()
        size = raw.read(4)
        if not size:
            break
        rec = raw.read(struct.unpack("<i", size)[0])
        rid = struct.unpack_from("<i", rec)[0]
        starts.setdefault(rid, [at, at])[1] = raw.virtual()
    copy = tmp_path / "i.bam"
    copy.write_bytes(open(world["path"], "rb").read())
    index = b"BAI\x01" + struct.pack("<i", len(world["refs"]))
    for rid in range(len(world["refs"])):
        chunks = starts.get(rid)
        if not chunks:
            index += struct.pack("<ii", 0, 0)
            continue
        index += struct.pack("<i", 2) + struct.pack("<IiQQ", 4681, 1, *chunks)
        n = sum(r["rid"] == rid for r in world["reads"])
        index += struct.pack("<IiQQQQ", 37450, 2, *chunks, n, 0)
        index += struct.pack("<iQ", 1, chunks[0])
    (tmp_path / "i.bam.bai").write_bytes(index + struct.pack("<Q", 0))
    for split in (0, 900):
        got = bam.scan(spark, [str(copy)], regions=[["chr2", 500, 1200]], splitBytes=split).filter("kind = 'read'").collect()
        span = lambda r: sum(n for n, o in r["cigar"] if o in "MDN=X")
        want = [r for r in world["reads"] if r["rid"] == 1 and r["pos"] <= 1200 and r["pos"] + span(r) > 500]
        assert sorted(r["pos"] for r in got) == sorted(r["pos"] for r in want)
    # the job reads the probes' windows alone and counts the same
    counts, warnings, spans = E.bam_counts(spark, [str(copy)], load_model(spark, str(world["folder"] / "model")))
    assert rows(counts) == brute_counts(world) and warnings.count() == 0
    assert [r["stop"] for r in spans.collect()] == [bam.SPAN_EOF]
    facts, _ = E.preflight(spark, [str(copy)])
    row = facts.first()
    assert row["index_state"] == "read" and row["mapped_on_probes"] == len(world["reads"])


def test_preflight_of_a_good_and_a_poor_file(spark, world, tmp_path):
    poor = tmp_path / "poor.bam"
    X.write_bam(poor, [("chr1", 12345)], [X.record("a", 0, 5, 0, [(4, "M")], "ACGT")])
    other = tmp_path / "old.bam"
    X.write_bam(other, [("1", 249250621)], [])
    untagged = tmp_path / "untagged.bam"
    X.write_bam(untagged, X.grch38_refs(20), [X.record("a", 0, 5, 0, [(4, "M")], "ACGT")])
    paths = [world["path"], str(poor), str(other), str(untagged)]
    facts, issues = E.preflight(spark, paths)
    codes = {}
    for r in issues.collect():
        codes.setdefault(r["path"], set()).add(r["code"])
    assert {"REFERENCE", "NO_INDEX", "MOD_TAGS"} <= codes[world["path"]]
    assert codes[str(poor)] == {"UNKNOWN_REFERENCE"}
    assert codes[str(other)] == {"WRONG_REFERENCE"}
    assert codes[str(untagged)] == {"REFERENCE", "MISSING_CONTIGS", "NO_INDEX", "NO_MOD_TAGS"}
    fact = facts.filter(f"path = '{world['path']}'").first()
    assert fact["programs"] == ["dorado 0.5"] and fact["sort_order"] == "coordinate"
    assert "chr" in E.inspection_text(facts, issues).filter(f"path = '{world['path']}'").first()["value"]
    assert json.loads(E.inspection_json(facts, issues).filter(f"path = '{poor}'").first()["value"])["issues"][0]["level"] == "fatal"
    with pytest.raises(ValueError, match="not usable"):
        E.stop_if_unusable(issues)


def test_malformed_tags_and_long_cigar(spark, tmp_path):
    ok = X.record("a", 0, 5, 0, [(4, "M")], "ACGT", X.tag("MM", "Z", "C+m,0;") + X.tag("ML", "BC", [200]))
    cut = X.record("b", 0, 6, 0, [(4, "M")], "ACGT", b"XX?" + X.tag("MM", "Z", "C+m,0;"))
    wrong = X.record("c", 0, 7, 0, [(4, "M")], "ACGT", X.tag("MM", "i", 5) + X.tag("Mm", "Z", "C+m,0;"))
    long = X.record("d", 0, 8, 0, [(4, "S"), (10, "N")], "ACGT", X.tag("CG", "BI", [4 << 4]))
    path = tmp_path / "t.bam"
    X.write_bam(path, [("chr1", 1000)], [ok, cut, wrong, long])
    got = {r["pos"]: r for r in bam.scan(spark, [str(path)]).filter("kind = 'read'").collect()}
    assert got[5]["mm"] == "C+m,0;" and bytes(got[5]["ml"]) == b"\xc8" and got[5]["aux_ok"]
    assert got[6]["mm"] is None and not got[6]["aux_ok"]
    assert got[7]["mm"] is None and got[7]["aux_ok"]
    assert got[8]["cigar"] == [64]


def test_one_pass_reports_malformed_reads_and_damage(spark, world, tmp_path):
    refs, seq = X.grch38_refs(), "CGA" * 10
    good = X.tag("MM", "Z", "C+m,0;") + X.tag("ML", "BC", [200])
    recs = [X.record(f"r{i}", 0, 0, 0, [(30, "M")], seq, good if i % 3 else b"XX?" + good) for i in range(9)]
    path = str(tmp_path / "m.bam")
    X.write_bam(path, refs, recs)
    counts, warnings, spans = E.bam_counts(spark, [path, world["path"]], load_model(spark, str(world["folder"] / "model")))
    mine = {r["probe_id"]: (r["n_mod"], r["n_unmod"]) for r in counts.filter(f"sample_id = '{path}'").collect()}
    # six usable reads: the first cytosine is listed, the others count as unmodified
    assert mine == {f"cg0_{p}": (0, 6) if p else (6, 0) for p in range(0, 30, 3)}
    assert [(r["path"], r["code"], r["message"].split()[0]) for r in warnings.collect()] == [(path, "BAM_AUX", "3")]
    assert sorted(r["path"] for r in spans.collect()) == sorted([path, world["path"]])


def test_block_cursor_seeks_checks_and_reports(tmp_path):
    path = tmp_path / "b.gz"
    a, b = X.block(b"hello "), X.block(b"world")
    path.write_bytes(a + b)
    cursor = BlockCursor(BlockFile(str(path)))
    assert cursor.read(100) == b"hello world" and cursor.virtual() == (len(a) + len(b)) << 16
    cursor.seek((len(a) << 16) + 2)
    assert cursor.read(10) == b"rld"
    assert inflate_all(str(path)) == b"hello world"
    damaged = bytearray(a + b)
    damaged[len(a) + 20] ^= 1
    path.write_bytes(bytes(damaged))
    with pytest.raises(DamagedBlock):
        BlockCursor(BlockFile(str(path))).read(100)
    path.write_bytes((a + b)[:-3])
    with pytest.raises(DamagedBlock):
        BlockCursor(BlockFile(str(path))).read(100)


def test_bins():
    assert [region_bin(0, 1), region_bin(16384, 16385), region_bin(0, 1 << 26), region_bin(0, 1 << 29), metadata_bin(5)] == [4681, 4682, 1, 0, 37450]
