"""Small synthetic inputs: alignment files written byte by byte, model folders, and brute-force answers."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np

from methlake.operators import references as REF
from methlake.sources.tensors import header_bytes

BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"


def block(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


EOF = block(b"")


def tag(name: str, kind: str, value) -> bytes:
    head = name.encode()
    if kind == "Z":
        return head + b"Z" + value.encode() + b"\0"
    if kind == "BC":
        return head + b"BC" + struct.pack("<I", len(value)) + bytes(value)
    if kind == "BI":
        return head + b"BI" + struct.pack(f"<I{len(value)}I", len(value), *value)
    return head + kind.encode() + struct.pack("<" + {"i": "i", "C": "B"}[kind], value)


def record(name="r", rid=0, pos=0, flag=0, cigar=(), seq="", tags=b"", qual=None) -> bytes:
    codes = [BASES.index(b) for b in seq] + ([0] if len(seq) % 2 else [])
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    ops = b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in cigar)
    raw = name.encode() + b"\0"
    quals = bytes([30] * len(seq)) if qual is None else qual
    body = struct.pack("<iiBBHHHiiii", rid, pos, len(raw), 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + raw + ops + packed + quals + tags
    return struct.pack("<i", len(body)) + body


def header(refs, text="@HD\tVN:1.6\tSO:coordinate\n@PG\tID:a\tPN:dorado\tVN:0.5\n") -> bytes:
    t = text.encode()
    out = b"BAM\x01" + struct.pack("<i", len(t)) + t + struct.pack("<i", len(refs))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


def write_bam(path, refs, records, per_block=700, eof=True):
    """Header in its own block; the record stream is cut into blocks without regard to record borders."""
    data = b"".join(records)
    blocks = [block(header(refs))] + [block(data[i : i + per_block]) for i in range(0, len(data), per_block)]
    with open(path, "wb") as f:
        f.write(b"".join(blocks) + (EOF if eof else b""))
    return [len(b) for b in blocks]


def grch38_refs(n=22, style=""):
    lengths = REF.CONTIG_LENGTHS[REF.GRCH38]
    return [(c if style == "" else c[3:], lengths[i]) for i, c in enumerate(REF.CHROMOSOMES[:n])]


# ---- brute force ------------------------------------------------------------------------------------


def complement(b):
    return {"A": "T", "T": "A", "C": "G", "G": "C"}.get(b, b)


def read_calls(read, sites, low=0.3, high=0.7):
    """{cg: 'm' | 'u' | 'between'} of one read dict (pos, flag, cigar, seq, mm, ml) and sites {pos: cg}."""
    if read["flag"] & 0x904 or read.get("mm") is None:
        return {}
    seq, rev = read["seq"], bool(read["flag"] & 16)
    original = [complement(b) for b in reversed(seq)] if rev else list(seq)
    c_positions = [i for i, b in enumerate(original) if b == "C"]
    if rev:
        c_positions = [len(seq) - 1 - i for i in c_positions]
    scores, used, implicit = {}, 0, False
    for group in filter(None, (g.strip() for g in read["mm"].split(";"))):
        head, *deltas = group.split(",")
        codes = head[2:].rstrip("?.")
        n = 1 if codes.isdigit() else max(1, len(codes))
        k = -1
        for d in map(int, deltas):
            k += d + 1
            chunk = read["ml"][used : used + n]
            used += n
            if head[0] == "C" and k < len(c_positions) and chunk:
                scores[c_positions[k]] = scores.get(c_positions[k], 0) + sum(chunk)
        implicit |= head[0] == "C" and "?" not in head
    q, r, at = 0, read["pos"], {}
    for n, op in read["cigar"]:
        if op in "M=X":
            for j in range(n):
                at[r + j] = q + j
        if op in "M=XIS":
            q += n
        if op in "M=XDN":
            r += n
    out = {}
    for pos, cg in sites.items():
        i = at.get(pos + 1 if rev else pos)
        if i is None or i not in set(c_positions):
            continue
        score = scores.get(i, 0 if implicit else None)
        if score is None:
            continue
        p = np.float32(min(score, 256) / 256)
        out[cg] = "m" if p >= np.float32(high) else "u" if p < np.float32(low) else "between"
    return out


def random_reads(n, n_refs, span, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cigar, length = [], 0
        for op in rng.choice(["M", "SMIMDM", "MNM=X", "HSMS", "MDM"]):
            k = rng.randint(1, 40)
            cigar.append((k, op))
            length += k if op in "MIS=X" else 0
        seq = "".join(rng.choice("ACGTCG") for _ in range(length))
        groups, ml = [], []
        for head, codes in rng.choice([[("C+m?", 1)], [("C+m", 1)], [("A+a", 1), ("C+mh?", 2)], [("C+h?", 1), ("C+m?", 1)], [("C+27551?", 1)]]):
            deltas = [rng.randint(0, 3) for _ in range(rng.randint(0, length // 8 + 1))]
            groups.append(",".join([head, *map(str, deltas)]))
            ml += [rng.choice([0, 40, 76, 77, 128, 179, 180, 255]) for _ in range(codes * len(deltas))]
        if rng.random() < 0.1:
            ml = ml[: len(ml) // 2]
        out.append({
            "name": f"r{i}", "rid": rng.randrange(n_refs), "pos": rng.randrange(span), "flag": rng.choice([0, 16, 0, 16, 1024, 4, 256, 2048]),
            "cigar": cigar, "seq": seq, "mm": ";".join(groups) + ";" if rng.random() < 0.95 else None, "ml": ml,
        })
    return sorted(out, key=lambda r: (r["rid"], r["pos"]))


def to_record(r) -> bytes:
    tags = tag("NM", "C", 1)
    if r["mm"] is not None:
        tags += tag("MM", "Z", r["mm"]) + tag("ML", "BC", r["ml"]) + tag("MN", "i", len(r["seq"]))
    return record(r["name"], r["rid"], r["pos"], r["flag"], r["cigar"], r["seq"], tags)


# ---- model folders ----------------------------------------------------------------------------------

CLASSES = ["L1", "L2", "L3", "L4"]
LINEAGE = {
    "name": "demo",
    "version": "1.2",
    "leaves": CLASSES,
    "descent_thresholds": {"1": 0.3, "2": 0.4},
    "hierarchy": [
        {"name": "A", "children": [{"name": "L1", "alert": {"p_min": 0.05, "note": "look"}}, {"name": "L2"}]},
        {"name": "B", "children": [{"name": "L3"}, {"name": "L4", "alert": {"p_min": 0.1}}]},
    ],
}


def network_arrays(n_probes, rank=6, hidden=8, depth=2, k=4, head="cell_origin", seed=3):
    rng = np.random.default_rng(seed)
    g = lambda *s: rng.normal(0, 0.5, s).astype(np.float32)
    w = {"first.0.weight": g(rank, n_probes), "first.1.weight": g(hidden, rank), "first.1.bias": g(hidden), "ln1.weight": 1 + g(hidden), "ln1.bias": g(hidden)}
    for i in range(depth):
        w |= {f"trunk.{i}.lin.weight": g(hidden, hidden), f"trunk.{i}.lin.bias": g(hidden), f"trunk.{i}.ln.weight": 1 + g(hidden), f"trunk.{i}.ln.bias": g(hidden)}
    h = f"heads.{head}"
    half = hidden // 2
    w |= {f"{h}.0.weight": g(half, hidden), f"{h}.0.bias": g(half), f"{h}.1.weight": 1 + g(half), f"{h}.1.bias": g(half), f"{h}.4.weight": g(k, half), f"{h}.4.bias": g(k)}
    return w


def write_tensor_file(path, arrays):
    names = sorted(arrays)
    with open(path, "wb") as f:
        f.write(header_bytes([(n, list(arrays[n].shape)) for n in names]))
        for n in names:
            f.write(np.asarray(arrays[n], "<f4").tobytes())


def model_folder(folder, sites, calibrated=True):
    """sites: [(chrom, pos, cg)] in GRCh38 coordinates; the first assembly's map holds them shifted by 1000."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "lineage.json").write_text(json.dumps(LINEAGE))
    arrays = network_arrays(len(sites))
    if calibrated:
        arrays["cell_origin_bin_centers"] = np.array([5, 20, 80], np.float32)
        arrays["cell_origin_log_temps"] = np.array([0.5, 0.2, -0.1], np.float32)
    write_tensor_file(folder / "model.safetensors", arrays)
    names = {c: REF.t2t_accession(i) for i, c in enumerate(REF.CHROMOSOMES)}
    t2t = ["chrom\tstart\tend\tcg"] + [f"{names[c]}\t{p + 1000}\t{p + 1002}\t{cg}" for c, p, cg in sites]
    (folder / "probes.T2T.bed").write_text("\n".join(t2t) + "\n")
    (folder / "probes.hg38.bed").write_text("".join(f"{c}\t{p}\t{p + 2}\t{cg}\n" for c, p, cg in sites))
    return arrays


def brute_forward(w, x, head="cell_origin", depth=2):
    """Logits of one dense ternary vector, with plain loops."""

    def lin(h, name):
        return [sum(float(a) * b for a, b in zip(row, h)) + float(bias) for row, bias in zip(w[name + ".weight"], w[name + ".bias"])]

    def stage(h, a, b):
        u = lin(h, a)
        mean = sum(u) / len(u)
        sd = (sum((v - mean) ** 2 for v in u) / len(u) + 1e-5) ** 0.5
        y = [(v - mean) / sd * float(g) + float(s) for v, g, s in zip(u, w[b + ".weight"], w[b + ".bias"])]
        return [v / (1 + np.exp(-v)) for v in y]

    h = stage([sum(float(a) * b for a, b in zip(row, x)) for row in w["first.0.weight"]], "first.1", "ln1")
    for i in range(depth):
        h = [a + b for a, b in zip(h, stage(h, f"trunk.{i}.lin", f"trunk.{i}.ln"))]
    return np.array(lin(stage(h, f"heads.{head}.0", f"heads.{head}.1"), f"heads.{head}.4"))
