import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as X
from methlake.model import fit as FIT, network
from methlake.model import weights as W
from methlake.model.artifact import load_model
from methlake.operators.ordered import merge_intervals, row_ordinal, running_sum
from methlake.sources.codes import read_codes
from methlake.sources.training import load_spec, load_tree
from methlake.training import augment as AUG, depth as DEPTH

LEAVES = ["Blood T", "Blood B", "Liver", "Tumour X", "Tumour Y"]
P = 60


@pytest.fixture(scope="module")
def recipe(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spec")
    rng = np.random.default_rng(2)
    tree = {
        "leaves": LEAVES,
        "nodes": {"All": None, "Normal": "All", "Cancer": "All", "Blood T": "Normal", "Blood B": "Normal", "Liver": "Normal", "Tumour X": "Cancer", "Tumour Y": "Cancer"},
        "leaf_domain": {"Tumour X": 1, "Tumour Y": 1},
    }
    centres = {leaf: rng.integers(0, 2, P) for leaf in LEAVES}
    lines, codes = ["row\tnote\ttarget\tin_training"], []
    for i in range(70):
        leaf = LEAVES[i % 5]
        target = f"leaf:{leaf}" if i < 60 else ["node:Cancer", "mix:Liver=0.8000;Blood B=0.2000", "node:All", "", ""][i % 5]
        lines.append(f"{i}\tx\t{target}\t{int(target != '' and i != 64)}")
        row = np.where(centres[leaf] == 1, rng.integers(190, 251, P), rng.integers(0, 60, P))
        row[rng.random(P) < 0.05] = 255
        codes.append(row.astype(np.uint8))
    (folder / "tree.json").write_text(json.dumps(tree))
    (folder / "labels.tsv").write_text("\n".join(lines) + "\n")
    (folder / "probes.tsv").write_text("col\tprobe_id\n" + "".join(f"{i}\tcg{i}\n" for i in range(P)))
    (folder / "beta.u8").write_bytes(b"".join(c.tobytes() for c in codes))
    spec = {
        "corpus": "demo", "beta_u8": "beta.u8", "probes": "probes.tsv", "labels": "labels.tsv", "tree": "tree.json",
        "model": {"rank": 6, "hidden": 8, "depth": 1, "dropout": 0.1},
        "optim": {"lr": 0.02, "wd": 0.01, "epochs": 2, "sched_tmax": 0, "batch_size": 16, "seed": 1, "betas": [0.9, 0.99], "eps": 1e-8},
        "kd_temperature": 2.0, "hier_level_weight": 0.2, "coverage_levels": [20, 50], "probe_mask_prob": 0.05, "nano_prob": 0.5,
        "read_error": 0.02, "read_depth": {"mu": 6.0, "r": 2.5, "scales": [0.5, 1.0], "weights": [0.4, 0.6]},
        "consistency": {"weight": 0.3, "lo": 10.0, "hi": 30.0}, "row_balance": {"mean": 1.0},
        "purity_mix": {"prob": 0.9, "pi_lo": 0.3, "pi_hi": 0.9, "immune_leaves": ["Blood T", "Blood B"], "tissue_leaves": ["Liver"], "domains": [1], "bank_size": 20},
    }
    (folder / "spec.json").write_text(json.dumps(spec))
    return folder, spec, tree, np.stack(codes)


def test_spec_is_strict(recipe, tmp_path):
    folder, spec, *_ = recipe
    assert load_spec(str(folder)).labels == f"{folder}/labels.tsv"
    for change, why in [
        ({"extra": 1}, "unknown keys"), ({"model": {"rank": 1}}, "missing keys"),
        ({"purity_mix_extra": [spec["purity_mix"]]}, "two purity blocks"), ({"purity_mix": None, "purity_mix_extra": [spec["purity_mix"]]}, "without purity_mix"),
        ({"read_depth": {**spec["read_depth"], "weights": [1.0]}}, "pair up"),
    ]:
        (tmp_path / "spec.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError, match=why):
            load_spec(str(tmp_path))


def test_tree_levels_in_document_order(recipe):
    tree = load_tree(f"{recipe[0]}/tree.json")
    assert tree.level_rows() == [(1, "Normal", [0, 1, 2]), (1, "Cancer", [3, 4])] + [(2, leaf, [i]) for i, leaf in enumerate(LEAVES)]
    assert tree.height() == 3


def test_tables_equal_plain_numpy(spark, recipe):
    folder, spec, tree, codes = recipe
    s = load_spec(str(folder))
    t = FIT.build_tables(spark, s, FIT.Store(spark))
    assert (t.n_rows, t.n_probes, t.level_sizes) == (70, P, [2, 5])
    q = np.zeros((70, 5))
    for i in range(60):
        q[i, i % 5] = 1
    for i in range(60, 70):
        q[i] = [[0, 0, 0, 0.5, 0.5], [0, 0.2, 0.8, 0, 0], [0.2] * 5, [0] * 5, [0] * 5][i % 5]
    rows = [i for i in range(70) if q[i].sum() > 0]
    committed = [i for i in rows if q[i].max() >= 0.5 and (np.sort(q[i])[-1] > np.sort(q[i])[-2])]
    n = np.bincount(q[committed].argmax(1), minlength=5)
    w = np.clip(np.sqrt(np.median(n) / n), 0.3, 8.0)
    x = {i: q[i] @ w * q[i].max() for i in rows}
    scale = len(x) / sum(x.values())
    got = {r["row"]: r for r in t.examples.collect()}
    assert sorted(got) == rows
    for i in rows:
        assert abs(got[i]["weight"] - x[i] * scale) < 1e-6
        assert np.allclose(got[i]["log_q"], np.log(np.maximum(q[i], 1e-13)), atol=1e-4)
    # too few markers are covered to place any candidate, so nothing is eligible
    assert t.eligible.count() == 0
    bank = t.bank.collect()
    assert len(bank) == 20 and sum(r["kind"] == "immune" for r in bank) == 14
    assert all(q[r["row"]].argmax() == LEAVES.index(r["leaf"]) for r in bank)
    assert abs(max(r["cum_weight"] for r in bank) - 1.0) < 1e-9


def test_eligibility_against_numpy(spark, recipe):
    from methlake.operators import tree as TR
    from methlake.training import balance as BAL, purity as PUR

    folder, spec, tree, codes = recipe
    cfg = load_spec(str(folder)).purity_mix
    corpus = read_codes(spark, f"{folder}/beta.u8", P)
    pool = spark.createDataFrame([(i, LEAVES[i % 5], "immune") for i in range(60) if i % 5 < 2], "row bigint, leaf string, kind string")
    cand = spark.createDataFrame([(i, LEAVES[i % 5]) for i in range(60) if i % 5 >= 3], "row bigint, leaf string")
    b = np.where(codes <= 250, (codes + 0.5) / 250, np.nan)
    imm, can = b[[i for i in range(60) if i % 5 < 2]], b[[i for i in range(60) if i % 5 >= 3]]
    mb, ms = np.nanmean(imm, 0), np.nanmean(can, 0)
    score = np.abs(mb - ms) / (np.nanstd(imm, 0) + np.nanstd(can, 0) + 0.05)
    k = 25
    marks = np.argsort(-score)[:k]
    from dataclasses import replace

    got = {r["row"]: r["fraction"] for r in PUR.eligibility(corpus, pool, cand, replace(cfg, marker_probes=k), min_covered=10).collect()}
    assert len(got) == 24
    for i, f in got.items():
        ok = ~np.isnan(b[i, marks])
        d = (mb - ms)[marks][ok]
        assert abs(f - np.clip(((b[i, marks][ok] - ms[marks][ok]) * d).sum() / (d * d).sum(), 0, 1)) < 1e-6


def test_training_runs_repeats_and_learns(spark, recipe, tmp_path):
    folder, *_ = recipe
    log = FIT.train(spark, str(folder), str(tmp_path / "a"), epochs=2, max_batches=4)
    again = FIT.train(spark, str(folder), str(tmp_path / "b"), epochs=1, max_batches=1)
    assert [e["epoch"] for e in log] == [0, 1] and log[1]["total"] < log[0]["total"]
    assert abs(log[1]["lr"] - 0.01) < 1e-12 and len(again) == 1
    shapes = FIT.parameter_shapes(load_spec(str(folder)), 5, P)
    from methlake.sources.tensors import read_tensor_header

    assert {n: tuple(e["shape"]) for n, e in read_tensor_header(str(tmp_path / "a" / "model.safetensors"))[0].items()} == shapes
    assert json.loads((tmp_path / "a" / "config.json").read_text())["n_params"] == sum(int(np.prod(s)) for s in shapes.values())


def test_batch_gradient_does_not_depend_on_partitions(spark, recipe):
    folder, *_ = recipe
    spec, store = load_spec(str(folder)), FIT.Store(spark)
    t = FIT.build_tables(spark, spec, store)
    store.keep(FIT.initial_parameters(spark, FIT.parameter_shapes(spec, 5, P), 1), "step_0")
    examples, n = FIT.epoch_examples(spec, t, 0, store, max_batches=1)
    assert n == 1 and examples.count() == 16
    sums = [W.load(W.publish(FIT.batch_gradients(examples.repartition(k), store.path("step_0"), spec, t, 5))) for k in (1, 5)]
    assert sums[0].keys() == sums[1].keys() and all(np.allclose(sums[0][n], sums[1][n], atol=1e-4) for n in sums[0])
    assert sums[0]["(stats)"][0] == 16


def test_initial_weights_follow_the_rules(spark):
    shapes = {"first.0.weight": (64, 4000), "first.1.weight": (128, 64), "first.1.bias": (128,), "ln1.weight": (128,), "ln1.bias": (128,)}
    w = W.load(W.publish(FIT.initial_parameters(spark, shapes, 1)))
    assert abs(w["first.0.weight"].std() / np.sqrt(2 / 4000) - 1) < 0.02
    assert np.abs(w["first.1.bias"]).max() <= 1 / 8 and (w["ln1.weight"] == 1).all() and (w["ln1.bias"] == 0).all()


def test_simulation_is_seeded_and_unbiased(spark):
    lut = DEPTH.depth_table(DEPTH.scaled_cdf(DEPTH.base_pmf(spark, 6.0, 2.5), [1.0])).toPandas()
    grid = lut.pivot(index="table", columns="bin", values="depth").to_numpy()
    codes = bytes([250] * 2000 + [0] * 2000 + [255] * 500 + [125] * 2000)
    rows = [(i, 100, codes, i % 2 == 0, 0, 0.5, 1.0, None) for i in range(6)]
    df = spark.createDataFrame(rows, "row bigint, coverage int, codes binary, sequenced boolean, table int, keep_p double, purity double, bg_codes binary")
    run = lambda k: {r["row"]: (r["plus"], r["minus"]) for r in AUG.simulate(df.repartition(k), grid, AUG.AugmentConfig(read_error=0.02, seed=4)).collect()}
    a = run(1)
    assert a == run(4)
    plus, minus = map(np.array, a[0])
    assert abs(len(plus[plus < 2000]) / 2000 - 0.5) < 0.06 and not ((plus >= 4000) & (plus < 4500)).any()
    assert (plus < 2000).sum() > 30 * max(1, (minus < 2000).sum() - 20)
    plus, minus = map(np.array, a[1])  # not sequenced: clean calls
    assert not (minus < 2000).any() and not ((plus >= 2000) & (plus < 4000)).any()


def test_codes_source(spark, tmp_path):
    path = tmp_path / "m.u8"
    data = np.arange(12, dtype=np.uint8).reshape(4, 3)
    path.write_bytes(data.tobytes())
    assert [(r["row"], list(r["codes"])) for r in read_codes(spark, str(path), 3).orderBy("row").collect()] == [(i, list(data[i])) for i in range(4)]
    with pytest.raises(Exception, match="whole number of rows"):
        read_codes(spark, str(path), 5).collect()
    data[2, 1] = 252
    path.write_bytes(data.tobytes())
    with pytest.raises(Exception, match="codes 251..254 in row 2"):
        read_codes(spark, str(path), 3).collect()
    data[2] = [15, 191, 0]  # F, B, F meet only across byte borders
    path.write_bytes(data.tobytes())
    assert read_codes(spark, str(path), 3).count() == 4


def test_blocked_scans_with_one_hot_group(spark):
    rng = np.random.default_rng(3)
    order = rng.permutation(5000)
    rows = [("hot", int(o), int(rng.integers(0, 9))) for o in order] + [("cold", i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = {(r["g"], r["o"]): (r["s"], r["n"]) for r in row_ordinal(running_sum(df, ["g"], "o", F.col("v"), "s", block=64), ["g"], "o", "n", block=64).collect()}
    total, want = {}, {}
    for g, o, v in sorted(rows):
        s, n = total.get(g, (0, -1))
        total[g] = want[g, o] = (s + v, n + 1)
    assert got == want
    spans = [(int(a), int(a + rng.integers(0, 6))) for a in rng.integers(0, 9000, 2000)]
    out = merge_intervals(spark.createDataFrame([("x", *s) for s in spans], "g string, start bigint, stop bigint"), ["g"], block=50)
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    assert sorted([r["start"], r["stop"]] for r in out.collect()) == merged
