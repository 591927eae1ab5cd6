"""Files written from a table of reads: the same records as one by one, and an index that holds every region's reads."""

import numpy as np
import pandas as pd

from methlake.plans.queries_files import _regions
from methlake.sources.bam_index import read_index
from methlake.sources.bam_write import frame_bytes, indexed_bytes


def _reads(places: int, n: int = 1500) -> pd.DataFrame:
    rng, rows = np.random.default_rng(1), []
    for _ in range(n):
        k = int(rng.integers(1, 17))
        rows.append({
            "contig": int(rng.integers(0, 3)), "pos": int(rng.integers(0, places)), "flag": int(rng.choice([0, 16])), "l_seq": 4 * k,
            "cigar": np.array([4 * k * 16]), "seq": b"\x12\x48" * k, "mm": "C+m" + ",0" * k + ";", "ml": bytes(rng.integers(0, 256, 16, dtype=np.uint8)),
        })
    return pd.DataFrame(rows).sort_values(["contig", "pos"], ignore_index=True)


def test_records_are_those_written_one_by_one():
    reads = _reads(2_000_000)
    refs = [(f"c{i}", 2_100_000) for i in range(3)]
    assert frame_bytes(refs, reads)[0] == indexed_bytes(refs, reads.to_dict("records"))[0]


def test_the_index_holds_every_region_and_grows_with_the_reads_only(tmp_path):
    rng, sizes = np.random.default_rng(2), []
    for places in (2_000_000, 2_000_000_000):  # the second reaches beyond a BAI's last place
        reads, refs = _reads(places), [(f"c{i}", (1 << 31) - 1) for i in range(3)]
        path = tmp_path / f"{places}.bam.csi"
        path.write_bytes(frame_bytes(refs, reads)[1])
        sizes.append(path.stat().st_size)
        index = read_index(str(path))
        assert [r.meta[2] for r in index.refs] == reads.groupby("contig").size().tolist()
        whole = {r: index.chunks(r, 0, 1 << 31) for r in range(3)}
        for at in rng.choice(len(reads), 200):
            read = reads.iloc[at]
            stop = int(read["pos"] + read["l_seq"])
            begin = max(0, int(read["pos"]) - int(rng.integers(0, 50_000)))
            found = index.chunks(int(read["contig"]), begin, stop)
            assert found and all(any(a <= c[0] and c[1] <= b for a, b in whole[int(read["contig"])]) for c in found)
    assert max(sizes) < 20 * len(reads)


def test_windows_go_to_the_files_that_can_hold_their_reads():
    files = [("a", 0, 100, 0, 500), ("b", 0, 500, 1, 40), ("c", 1, 40, 3, 10)]
    windows = [(0, 0, 90), (0, 80 + 20, 110), (0, 560, 600), (0, 900, 950), (1, 30, 39), (1, 45, 60), (2, 7, 8), (3, 200, 300)]
    got = _regions(files, windows, 64)
    assert got == {
        "a": [["c0", 100, 111], ["c0", 560, 601]],
        "b": [["c0", 560, 601], ["c0", 900, 951], ["c1", 30, 40], ["c1", 45, 61]],
        "c": [["c1", 45, 61], ["c2", 7, 9]],
    }
