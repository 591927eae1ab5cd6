import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as X
from methlake.functions import numeric as N
from methlake.model import federated as FED, network
from methlake.model import weights as W
from methlake.model.artifact import load_model, parse_lineage
from methlake.model.predict import predict, project
from methlake.operators import report as REP
from methlake.plans import entries as E
from methlake.sources.files import sha256_of
from methlake.sources.tensors import read_tensor_header, read_tensors, write_tensors

N_PROBES = 40
SITES = [("chr1", 10 * i, f"cg{i}") for i in range(N_PROBES)]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("m") / "model"
    X.model_folder(folder, SITES)
    m = load_model(spark, str(folder))
    m.check()
    return m


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(0)
    dense = {f"s{i}": rng.choice([-1, 0, 1], N_PROBES, p=[0.3, 0.4, 0.3]) for i in range(9)}
    rows = [(s, j, int(t)) for s, v in dense.items() for j, t in enumerate(v) if t]
    return dense, spark.createDataFrame(rows, "sample_id string, probe_idx int, t int")


def test_tensor_file_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"b": rng.normal(size=(300, 500)).astype(np.float32), "a.x": np.float32([1, -2, 3.5]), "é": np.zeros((2, 2), np.float32)}
    path, again = str(tmp_path / "t.safetensors"), str(tmp_path / "again.safetensors")
    X.write_tensor_file(path, arrays)
    blocks = read_tensors(spark, path)
    assert blocks.filter("name = 'b'").count() == 3
    write_tensors(blocks.repartition(3), again)
    assert sha256_of(path) == sha256_of(again)
    loaded = W.load(W.publish(blocks))
    assert all(np.array_equal(loaded[n], a) for n, a in arrays.items())


def test_half_precision_widens(spark, tmp_path):
    f16, bf16 = [0x3C00, 0xC000, 0x0001, 0x7BFF, 0x7C00], [0x3F80, 0xC000]
    head = json.dumps({"__metadata__": {"k": "v"}, "h": {"dtype": "F16", "shape": [5], "data_offsets": [0, 10]}, "b": {"dtype": "BF16", "shape": [2], "data_offsets": [10, 14]}}).encode()
    path = tmp_path / "h"
    path.write_bytes(len(head).to_bytes(8, "little") + head + np.array(f16 + bf16, "<u2").tobytes())
    got = {r["name"]: r["values"] for r in read_tensors(spark, str(path)).collect()}
    assert got["h"] == [1.0, -2.0, 2.0**-24, 65504.0, float("inf")] and got["b"] == [1.0, -2.0]
    (tmp_path / "bad").write_bytes(b"\xff" * 20)
    with pytest.raises(ValueError):
        read_tensor_header(str(tmp_path / "bad"))


def test_lineage_rules():
    doc = json.loads(json.dumps(X.LINEAGE))
    assert parse_lineage(json.dumps(doc)).nodes[:3] == [("A", "ROOT"), ("L1", "A"), ("L2", "A")]
    doc["hierarchy"][0]["alert"] = {"p_min": 0.1}
    with pytest.raises(ValueError, match="inner node"):
        parse_lineage(json.dumps(doc))
    with pytest.raises(ValueError, match="twice"):
        parse_lineage(json.dumps({**X.LINEAGE, "hierarchy": [{"name": "L1"}, {"name": "L1"}]}))
    with pytest.raises(ValueError, match="no output class"):
        parse_lineage(json.dumps({**X.LINEAGE, "leaves": ["L1", "L2", "L3"]}))


def test_predictions_equal_plain_loops(spark, model, cohort):
    dense, features = cohort
    w = W.load(model.published)
    got = {r["sample_id"]: r for r in predict(project(features, model), model).collect()}
    assert len(got) == len(dense)
    for s, x in dense.items():
        logits = X.brute_forward(w, x)
        n = int((x != 0).sum())
        t = np.exp(w["cell_origin_log_temps"][np.abs(w["cell_origin_bin_centers"] - n).argmin()])
        p = np.exp(logits / t - np.logaddexp.reduce(logits / t))
        assert got[s]["n_covered"] == n and abs(got[s]["temperature"] - t) < 1e-6
        assert np.allclose(got[s]["logits"], logits, atol=1e-6) and np.allclose(got[s]["probs"], p, atol=1e-6)
        assert np.allclose(spark.createDataFrame([(logits.tolist(),)], "z array<double>").select(N.softmax(F.col("z"), float(t))).first()[0], p, atol=1e-9)


def test_projection_equals_the_dense_product(spark, model, cohort):
    dense, features = cohort
    first = W.load(model.published)[network.FIRST].astype(np.float64)
    got = {r["sample_id"]: r for r in project(features, model).collect()}
    assert all(np.allclose(r["z"], first @ dense[s]) for s, r in got.items())
    listed = spark.createDataFrame([("s0",), ("s0",), ("nobody",)], "sample_id string")
    exact = {r["sample_id"]: r for r in project(features, model, samples=listed).collect()}
    assert exact.keys() == {"s0", "nobody"} and np.allclose(exact["s0"]["z"], got["s0"]["z"])
    assert exact["nobody"]["n_covered"] == 0 and not np.any(exact["nobody"]["z"])


def test_gradients_equal_central_differences():
    w = {k: v.astype(np.float64) for k, v in X.network_arrays(12).items()}
    rng = np.random.default_rng(4)
    z, mask = rng.normal(size=(3, 6)), np.array([[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 0, 1.0]])
    drop = [np.where(rng.random((3, d)) < 0.3, 0, 1 / 0.7) for d in (8, 8, 8, 4)]

    def loss():
        return network.set_nll(network.forward(w, z, "cell_origin", 2, drop)[0], mask)[0]

    logits, trace = network.forward(w, z, "cell_origin", 2, drop)
    grads, dz = network.backward(w, trace, network.set_nll(logits, mask)[1], "cell_origin", 2, drop)
    assert sorted(grads) == sorted(network.trainable_names("cell_origin", 2))
    for target, g in [*((w[n], g) for n, g in grads.items()), (z, dz)]:
        flat = target.reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-5


def test_training_loss_gradient():
    rng = np.random.default_rng(5)
    z, shallow = rng.normal(size=(4, 5)), rng.normal(size=(4, 5))
    log_t = np.log(rng.dirichlet(np.ones(5), 4))
    levels = np.array([[1, 1, 0, 0, 0], [0, 0, 1, 1, 1.0]])
    weight = np.array([1, 2, 0.5, 0])
    args = (log_t, weight, levels, 2.0, 0.3)
    _, _, dz, ds = network.training_loss(z, *args, shallow, (weight > 0).astype(float), 0.7)
    for a, g, term in ((z, dz, 0), (shallow, ds, 1)):
        for i in range(a.size):
            flat, keep = a.reshape(-1), a.reshape(-1)[i]
            flat[i] = keep + 1e-6
            up = network.training_loss(z, *args, shallow, (weight > 0).astype(float), 0.7)[term].sum()
            flat[i] = keep - 1e-6
            down = network.training_loss(z, *args, shallow, (weight > 0).astype(float), 0.7)[term].sum()
            flat[i] = keep
            assert abs((up - down) / 2e-6 - g.reshape(-1)[i]) < 1e-5


def test_report_forms(spark, model):
    probs = [("a", [0.05, 0.6, 0.3, 0.05]), ("b", [0.25, 0.25, 0.25, 0.25]), ("c", [0.28, 0.0, 0.36, 0.36])]
    scored = spark.createDataFrame([(s, 20_000, 1.0, p) for s, p in probs], "sample_id string, n_covered bigint, temperature double, probs array<float>")
    none = F.expr("cast(array() as array<struct<level:string,code:string,message:string>>)")
    rows = REP.with_report(scored, model.lineage).withColumn("source", F.lit("beta CSV x")).withColumn("input_checks", none)
    got = {r["sample_id"]: r["report"] for r in rows.collect()}
    a = got["a"]
    assert (a["call"], a["call_depth"]) == ("L2", 2) and abs(a["call_p"] - 0.6) < 1e-6
    assert [x["leaf"] for x in a["alerts"]] == ["L1"] and a["alerts"][0]["note"] == "look"
    b = got["b"]  # equal masses: first name wins; the second step misses its threshold
    assert [s["node"] for s in b["descent"]] == ["A", "L1"] and b["call"] == "A" and [s["met"] for s in b["descent"]] == [True, False]
    assert [x["leaf"] for x in b["alerts"]] == ["L1", "L4"]
    assert got["c"]["call"] == "B"
    doc = json.loads(REP.as_json(rows, model.lineage, N_PROBES).filter("sample_id = 'a'").first()["value"])
    assert doc["model"] == {"name": "demo", "version": "1.2"} and doc["qc"]["coverage_tier"] == "adequate"
    assert [c["class"] for c in doc["classes"]] == X.CLASSES and doc["report"]["call"] == "L2"
    text = REP.as_text(rows, model.lineage, N_PROBES).filter("sample_id = 'b'").first()["value"]
    assert text.startswith("Input: beta CSV x\nModel: demo, version 1.2\nProbes: 20000 of ")
    assert "    1. A: 0.500, limit 0.30 reached\n    2. L1: 0.250, limit 0.40 missed\n" in text
    assert "Call: A, level 1, probability 0.500\n" in text and "    L1: 0.250, listed from 0.050; look\n" in text


@pytest.fixture(scope="module")
def updates(spark, model, cohort, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fed")
    _, features = cohort
    labels = spark.createDataFrame([(f"s{i}", ["L1", "A", "L3", "B"][i % 4]) for i in range(9)], "sample_id string, label string")
    out = []
    for site in range(2):
        mine = F.expr(f"cast(substr(sample_id, 2) as int) % 2 = {site}")
        out.append(str(folder / f"site{site}.safetensors"))
        FED.contribute(features.filter(mine), labels.filter(mine), model, out[-1])
    return out, labels


def test_contribution_equals_one_batch(spark, model, cohort, updates):
    dense, _ = cohort
    w = W.load(model.published)
    ids = [f"s{i}" for i in range(0, 9, 2)]
    z = np.stack([w["first.0.weight"].astype(np.float64) @ dense[s] for s in ids])
    mask = np.array([{"L1": [1, 0, 0, 0], "A": [1, 1, 0, 0], "L3": [0, 0, 1, 0], "B": [0, 0, 1, 1]}[["L1", "A", "L3", "B"][int(s[1:]) % 4]] for s in ids], float)
    logits, trace = network.forward(w, z, "cell_origin", 2)
    loss, d = network.set_nll(logits, mask)
    want, _ = network.backward(w, trace, d, "cell_origin", 2)
    got = W.load(W.publish(read_tensors(spark, updates[0][0])))
    assert sorted(got) == sorted("grad." + n for n in want)
    assert all(np.allclose(got["grad." + n], g, atol=1e-4) for n, g in want.items())
    meta = json.loads(open(FED.sidecar(updates[0][0])).read())
    assert meta["n_samples"] == 5 and abs(meta["loss"] - loss / 5) < 1e-9 and meta["label_counts"] == {"L1": 3, "L3": 2}
    assert abs(meta["grad_norm"] - np.sqrt(sum((g * g).sum() for g in want.values()))) < 1e-3


def test_merge_then_apply(spark, model, updates, tmp_path):
    hub, site, patch = str(tmp_path / "hub"), str(tmp_path / "site"), str(tmp_path / "p.safetensors")
    info = FED.merge(spark, model, updates[0], hub, lr=0.5, patch=patch)
    assert info["n_samples"] == 9 and info["label_counts"] == {"L1": 3, "A": 2, "L3": 2, "B": 2}
    old, new = W.load(model.published), W.load(load_model(spark, hub).published)
    parts = [W.load(W.publish(read_tensors(spark, u))) for u in updates[0]]
    for n in network.trainable_names("cell_origin", 2):
        assert np.allclose(new[n], old[n] - (0.5 / 9) * sum(p["grad." + n] for p in parts), atol=1e-5)
    assert np.array_equal(new["first.0.weight"], old["first.0.weight"])
    assert sorted(read_tensor_header(patch)[0]) == sorted(network.trainable_names("cell_origin", 2))
    FED.apply_patch(spark, model, patch, site)
    assert sha256_of(site + "/model.safetensors") == sha256_of(hub + "/model.safetensors")
    assert json.loads(open(site + "/lineage.json").read())["federated"]["merged_updates"] == 2
    with pytest.raises(ValueError, match="the patch is for weights"):
        FED.apply_patch(spark, load_model(spark, hub), patch, str(tmp_path / "x"))


@pytest.mark.parametrize("change, why", [
    ({"base_sha256": "0" * 64}, "belongs to base"), ({"class_names": ["x"]}, "class names"),
    ({"n_samples": 0}, "no samples"), ({"grad_norm": 1e6}, "declares"),
])
def test_merge_rejects(spark, model, updates, tmp_path, change, why):
    path = tmp_path / "u.safetensors"
    path.write_bytes(open(updates[0][0], "rb").read())
    meta = json.loads(open(FED.sidecar(updates[0][0])).read())
    (tmp_path / "u.json").write_text(json.dumps({**meta, **change}))
    with pytest.raises(ValueError, match=why):
        FED.merge(spark, model, [str(path)], str(tmp_path / "out"))


def test_merge_rejects_large_and_misshapen(spark, model, updates, tmp_path):
    with pytest.raises(ValueError, match="exceeds"):
        FED.merge(spark, model, updates[0], str(tmp_path / "out"), max_grad_norm=1e-9)
    path = tmp_path / "u.safetensors"
    X.write_tensor_file(path, {"grad.ln1.weight": np.zeros((3,), np.float32)})
    meta = json.loads(open(FED.sidecar(updates[0][0])).read())
    (tmp_path / "u.json").write_text(json.dumps({**meta, "grad_norm": 0.0}))
    with pytest.raises(ValueError, match="ln1.weight"):
        FED.merge(spark, model, [str(path)], str(tmp_path / "out"))


def test_unknown_label_is_an_error(spark, model):
    labels = spark.createDataFrame([("s1", "nowhere")], "sample_id string, label string")
    with pytest.raises(Exception, match="neither a class nor a tree node"):
        FED.class_masks(labels, model, "cell_origin").collect()


def test_values_of_every_text_kind_reach_a_report(spark, model, tmp_path):
    beta = tmp_path / "b.csv"
    beta.write_text("﻿Name,x,Beta\n" + "".join(f'"cg{i}",q,{(i % 10) / 10}\n' for i in range(30)) + "cg1,q,abc\ncg2,q,NA\ncg3,q,1.7\n")
    pileup = tmp_path / "p.bed"
    pileup.write_text("".join("\t".join(["chr1", str(10 * i), *["x"] * 9, str(i), "5"]) + "\n" for i in range(30)) + "chr1\tbad\n")
    t2t = tmp_path / "t.bed"
    t2t.write_text("".join("\t".join(["chr1", str(10 * i + 1000), *["x"] * 9, str(i), "5"]) + "\n" for i in range(30)))
    values, bad = E.beta_values(spark, [str(beta)])
    assert {r["code"]: r["message"] for r in bad.collect()} == {"CSV_VALUES": "1 rows, the first at line 32", "CSV_RANGE": "1 rows, the first at line 34"}
    feats = {r["probe_idx"]: r["t"] for r in E.features(values, model).collect()}
    assert feats[3] == 1 and feats[1] == -1 and 5 not in feats and feats[4] == -1  # the later 1.7 wins; 0.5 is no call
    both, bad, chosen = E.pileup_values(spark, [str(pileup), str(t2t)], model)
    assert {r["sample_id"]: r["assembly"] for r in chosen.collect()} == {str(pileup): "GRCh38", str(t2t): "T2T-CHM13v2.0"}
    assert [r["code"] for r in bad.collect()] == ["PILEUP_ROWS"]
    assert both.filter(f"sample_id = '{t2t}'").count() == 30
    rows = E.reported(both.unionByName(values), model, bad).collect()
    assert sorted(r["sample_id"] for r in rows) == sorted(map(str, (beta, pileup, t2t)))
    assert [c["code"] for r in rows if r["sample_id"] == str(pileup) for c in r["input_checks"]] == ["PILEUP_ROWS"]
