import json
import os

import pytest

import fixtures as X
from methlake.__main__ import main, parser
from methlake.sources.tensors import read_tensor_header


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    sites = [(f"chr{c + 1}", p, f"cg{c}_{p}") for c in range(2) for p in range(0, 2000, 5)]
    X.model_folder(folder / "model", sites)
    X.write_bam(folder / "a.bam", X.grch38_refs(), [X.to_record(r) for r in X.random_reads(150, 2, 1900, seed=8)])
    (folder / "b.csv").write_text("Name,Beta\n" + "".join(f"{cg},{i % 7 / 6}\n" for i, (_, _, cg) in enumerate(sites)))
    (folder / "cohort.tsv").write_text(f"{folder}/a.bam\tbam\tL1\n# x\n{folder}/b.csv\tbeta\tB\n")
    return folder


@pytest.mark.parametrize("line", [
    "bam --model m -i a.bam --no-checks", "--model m --json beta -i x.csv", "counts -i a -o b --shard 2/5 --threshold-high 0.8",
    "inspect -i a --records 100 --json", "classify -i a b c --model m", "merge --updates a b --out o --lr 0.1 --patch p",
    "apply --patch p --out o", "eval --labels l", "contribute --head h --labels l --out o", "train --spec s --out o --max-batches 3", "check --spec s --dump d",
])
def test_accepted_lines(line):
    assert parser().parse_args(line.split()).command in line


@pytest.mark.parametrize("line", [
    "", "bam", "bam -i", "counts -i a -o b --shard 5/5", "counts -i a -o b --shard x", "classify", "merge --out o", "nothing -i a", "inspect -i a --records many",
])
def test_rejected_lines(line):
    with pytest.raises(SystemExit):
        parser().parse_args(line.split())


def test_alignment_report_and_shards_agree(spark, world, capsys, tmp_path):
    model = ["--model", str(world / "model")]
    assert main(["bam", "-i", str(world / "a.bam"), "--json", *model]) == 0
    whole = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert whole["report"]["descent"] and whole["n_covered"] > 50 and whole["n_probes_total"] == 800
    parts = [str(tmp_path / f"p{i}") for i in range(2)]
    for i, p in enumerate(parts):
        assert main(["counts", "-i", str(world / "a.bam"), "-o", p, "--shard", f"{i}/2", *model]) == 0
    capsys.readouterr()
    assert main(["classify", "-i", *parts, "--json", *model]) == 0
    added = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert added["n_covered"] == whole["n_covered"] and added["classes"] == whole["classes"]
    assert main(["beta", "-i", str(world / "b.csv"), *model]) == 0
    assert "Call: " in capsys.readouterr().out


def test_cohort_evaluation_and_contribution(spark, world, capsys, tmp_path):
    model = ["--model", str(world / "model")]
    assert main(["eval", "--labels", str(world / "cohort.tsv"), *model]) == 0
    docs = [json.loads(line) for line in capsys.readouterr().out.strip().splitlines() if line.startswith("{")]
    assert [(d["label"], d["path"].rsplit("/", 1)[1]) for d in docs] == [("L1", "a.bam"), ("B", "b.csv")]
    update, hub = str(tmp_path / "u.safetensors"), str(tmp_path / "hub")
    assert main(["contribute", "--labels", str(world / "cohort.tsv"), "--out", update, *model]) == 0
    assert json.loads((tmp_path / "u.json").read_text())["n_samples"] == 2
    assert main(["merge", "--updates", update, "--out", hub, *model]) == 0
    assert set(read_tensor_header(f"{hub}/model.safetensors")[0]) == set(read_tensor_header(f"{world}/model/model.safetensors")[0])


def test_every_listed_line_is_a_sample(spark, world, capsys, tmp_path):
    """Relative, encoded, repeated and uncovered inputs, and one file as two kinds: a line and a sample each."""
    model = ["--model", str(world / "model")]
    folder = tmp_path / "rel dir+x"
    folder.mkdir()
    (folder / "b%1.csv").write_text((world / "b.csv").read_text())
    (folder / "none.csv").write_text("Name,Beta\ncg_unknown,0.9\n")
    lines = [(str(folder / "b%1.csv"), "beta", "B"), (os.path.relpath(folder / "b%1.csv"), "beta", "L1"), (str(folder / "none.csv"), "beta", "A"), (str(world / "a.bam"), "bam", "L1")]
    (tmp_path / "c.tsv").write_text("".join("\t".join(x) + "\n" for x in lines))
    assert main(["eval", "--labels", str(tmp_path / "c.tsv"), *model]) == 0
    docs = [json.loads(line) for line in capsys.readouterr().out.strip().splitlines() if line.startswith("{")]
    assert [(d["path"], d["label"]) for d in docs] == [(p, label) for p, _, label in lines]
    assert docs[0]["n_covered"] == docs[1]["n_covered"] > 0 and docs[2]["n_covered"] == 0 and docs[0]["classes"] == docs[1]["classes"]
    update = str(tmp_path / "u.safetensors")
    assert main(["contribute", "--labels", str(tmp_path / "c.tsv"), "--out", update, *model]) == 0
    meta = json.loads((tmp_path / "u.json").read_text())
    assert meta["n_samples"] == 4 == sum(meta["label_counts"].values())
    (folder / "empty.csv").write_text("")
    (tmp_path / "c.tsv").write_text(f"{folder}/empty.csv\tbeta\tB\n")
    with pytest.raises(Exception, match="nothing to read|no probe id column"):
        main(["eval", "--labels", str(tmp_path / "c.tsv"), *model])


def test_inspect_exit_codes(spark, world, capsys, tmp_path):
    assert main(["inspect", "-i", str(world / "a.bam")]) == 0
    assert "MOD_TAGS" in capsys.readouterr().out
    (tmp_path / "x.bam").write_bytes(b"not an alignment")
    assert main(["inspect", "-i", str(tmp_path / "x.bam"), "--json"]) == 2
    assert "NOT_BAM" in capsys.readouterr().out
