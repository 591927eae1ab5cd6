"""Command line: `python -m methlake <command> ...`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from methlake.functions.reads import THRESHOLD_HIGH, THRESHOLD_LOW
from methlake.model import federated as FED, fit as FIT
from methlake.model.artifact import load_model
from methlake.operators import report as REP
from methlake.plans import entries as E
from methlake.session import get_session
from methlake.sources.files import file_size, is_folder
from methlake.sources.text import read_cohort


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--model", default=argparse.SUPPRESS, help="model folder")
    shared.add_argument("--json", action="store_true", default=argparse.SUPPRESS, help="JSON instead of text")
    shared.add_argument("--master", default=argparse.SUPPRESS, help="Spark master, where the launcher sets none")
    top = argparse.ArgumentParser(prog="methlake", parents=[shared])
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, **kwargs) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=about, parents=[shared], **kwargs)

    def reads(p: argparse.ArgumentParser) -> None:
        p.add_argument("-i", "--input", required=True)
        p.add_argument("--threshold-high", type=float, default=THRESHOLD_HIGH)
        p.add_argument("--threshold-low", type=float, default=THRESHOLD_LOW)
        p.add_argument("--no-checks", action="store_true")

    reads(command("bam", "classify an alignment file"))
    for kind in ("pileup", "beta"):
        command(kind, f"classify a {kind} table").add_argument("-i", "--input", required=True)
    counts = command("counts", "per-probe counts of an alignment file or of one shard of it")
    reads(counts)
    counts.add_argument("-o", "--out", required=True)
    counts.add_argument("--shard", type=shard, default="0/1")
    inspect = command("inspect", "check an alignment file")
    inspect.add_argument("-i", "--input", required=True)
    inspect.add_argument("--records", type=int, default=0, help="judge a file by its first reads only; 0: by all")
    command("classify", "classify the sum of count tables").add_argument("-i", "--input", nargs="+", required=True)
    evaluate = command("eval", "reports of a cohort as JSON Lines")
    evaluate.add_argument("--labels", required=True)
    evaluate.add_argument("-o", "--out", help="folder for the lines; printed without it")
    give = command("contribute", "gradients of a labelled cohort")
    give.add_argument("--head")
    give.add_argument("--labels", required=True)
    give.add_argument("--out", required=True)
    merge = command("merge", "step the model against contributed gradients")
    merge.add_argument("--updates", nargs="+", required=True)
    merge.add_argument("--lr", type=float, default=0.01)
    merge.add_argument("--max-grad-norm", type=float, default=0.0)
    merge.add_argument("--patch")
    merge.add_argument("--out", required=True)
    take = command("apply", "apply a hub's patch")
    take.add_argument("--patch", required=True)
    take.add_argument("--out", required=True)
    train = command("train", "train a model from a recipe")
    train.add_argument("--spec", required=True)
    train.add_argument("--out", required=True)
    train.add_argument("--epochs", type=int)
    train.add_argument("--max-batches", type=int)
    check = command("check", "build the tables of a recipe")
    check.add_argument("--spec", required=True)
    check.add_argument("--out")
    check.add_argument("--dump")
    return top


def shard(text: str) -> str:
    i, sep, n = text.partition("/")
    if not (sep and i.isdigit() and n.isdigit() and int(i) < int(n)):
        raise argparse.ArgumentTypeError("expected i/n with 0 <= i < n")
    return text


def _totals(scanned: E.Scanned) -> None:
    """What a scan counted, a line a file, beside the report."""
    for r in scanned.totals.collect():
        print(f"{r['sample_id']}: {r['n_called']} calls kept, {r['n_filtered']} between the thresholds, {r['n_covered']} probes covered", file=sys.stderr)


def _show(rows) -> None:
    """Print the few documents a command line run asks for, as they come."""
    for r in rows.select("value").toLocalIterator():
        print(r["value"])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session(master=getattr(args, "master", None))
    as_json, command = getattr(args, "json", False), args.command
    if command == "train":
        FIT.train(spark, args.spec, args.out, args.epochs, args.max_batches)
        return 0
    if command == "check":
        FIT.check(spark, args.spec, args.out, args.dump)
        return 0
    model = load_model(spark, args.model) if hasattr(args, "model") else None
    if model is not None:
        model.check()
    if command == "inspect":
        facts, issues = E.preflight(spark, [args.input], model, args.records)
        _show(E.inspection_json(facts, issues) if as_json else E.inspection_text(facts, issues))
        return 2 if issues.filter("level = 'fatal'").first() is not None else 0
    if model is None:
        raise SystemExit("--model is required")
    if command == "merge":
        FED.merge(spark, model, args.updates, args.out, args.lr, args.max_grad_norm, args.patch)
        return 0
    if command == "apply":
        FED.apply_patch(spark, model, args.patch, args.out)
        return 0
    if command in ("eval", "contribute"):
        cohort = read_cohort(spark, args.labels)
        values, warnings = E.cohort_values(spark, cohort, model)
        # a file may be listed more than once; every line is a sample
        listed = E.cohort_samples(spark, cohort)
        if command == "contribute":
            feats = E.features(values, model).withColumnRenamed("sample_id", "input_id").join(F.broadcast(listed), "input_id")
            FED.contribute(feats.select("sample_id", "probe_idx", "t"), listed.select("sample_id", "label"), model, args.out, args.head)
            return 0
        inputs = listed.select(F.col("input_id").alias("sample_id")).distinct()
        rows = E.reported(values, model, warnings, samples=inputs).withColumnRenamed("sample_id", "input_id")
        lines = REP.as_json_lines(listed.join(rows, "input_id"), model.lineage)
        if args.out:
            E.write_lines(lines.orderBy("sample_id"), args.out)
        else:
            _show(lines.orderBy("sample_id"))
        return 0
    pre = warnings = None
    if command in ("bam", "counts") and not args.no_checks and getattr(args, "shard", "0/1").startswith("0/"):
        _, pre = E.preflight(spark, [args.input], model)
        E.stop_if_unusable(pre)
    if command == "counts":
        part = None if args.shard == "0/1" else args.shard
        counts, warnings, spans = scanned = E.bam_counts(spark, [args.input], model, args.threshold_low, args.threshold_high, part)
        _totals(scanned)
        E.write_counts(counts.drop("sample_id"), args.out, warnings, spans)
        return 0
    if command == "bam":
        counts, warnings, _ = scanned = E.bam_counts(spark, [args.input], model, args.threshold_low, args.threshold_high)
        _totals(scanned)
        values, source = E.bam_values(counts), f"BAM {args.input}"
    elif command == "pileup":
        values, warnings, _ = E.pileup_values(spark, [args.input], model)
        source = f"pileup {args.input}"
    elif command == "beta":
        values, warnings = E.beta_values(spark, [args.input])
        source = f"beta CSV {args.input}"
    else:
        there = lambda p: is_folder(p) or file_size(p) is not None
        side = lambda ext: [p + ext for p in args.input if there(p + ext)]
        values, warnings = E.counts_values(spark, args.input, side(".warnings"), side(".range"))
        source = "counts " + " + ".join(args.input)
    rows = E.reported(values, model, warnings, pre).withColumn("source", F.lit(source))
    if rows.isEmpty():
        raise SystemExit(f"no probes covered by {source}")
    _show((REP.as_json if as_json else REP.as_text)(rows, model.lineage, model.n_probes))
    return 0


if __name__ == "__main__":
    sys.exit(main())
