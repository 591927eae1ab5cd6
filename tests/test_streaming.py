from methlake.streaming import counts as S


def test_arriving_count_tables_add_up(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "counts")
    inbox.mkdir()
    keys = ["probe_id"]
    add = lambda batch: S.C.sum_counts(batch, keys)

    def drain():
        S.accumulate(S.count_parts(spark, str(inbox), files_per_batch=1), add, table, str(tmp_path / "ckpt")).awaitTermination()
        return {r["probe_id"]: (r["n_mod"], r["n_unmod"]) for r in S.totals(spark, table, keys).collect()}

    (inbox / "a.tsv").write_text("probe_id\tn_mod\tn_unmod\ncg1\t1\t2\ncg2\t5\tx\n")
    (inbox / "b.tsv").write_text("cg1\t10\t0\ncg3\t1\t1\n")
    assert drain() == {"cg1": (11, 2), "cg3": (1, 1)}
    (inbox / "c.tsv").write_text("cg3\t4\t4\n")
    assert drain() == {"cg1": (11, 2), "cg3": (5, 5)}
    assert drain() == {"cg1": (11, 2), "cg3": (5, 5)}
    # a batch that runs again replaces its own rows
    first = spark.read.parquet(f"{table}/batch=0").collect()
    spark.createDataFrame(first, "probe_id string, n_mod bigint, n_unmod bigint").write.mode("overwrite").parquet(f"{table}/batch=0")
    assert {r["probe_id"]: r["n_mod"] for r in S.totals(spark, table, keys).collect()} == {"cg1": 11, "cg3": 5}
    S.compact(spark, table, str(tmp_path / "folded"), keys)
    assert S.totals(spark, str(tmp_path / "folded"), keys).count() == 2


def test_stateful_form_agrees(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("cg1\t1\t2\ncg1\t3\t4\n")
    q = (
        S.running_totals(S.count_parts(spark, str(tmp_path / "in")), ["probe_id"])
        .writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "c")).start()
    )
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("running").collect()] == [("cg1", 4, 6)]


def test_alignment_files_that_arrive_count_as_a_batch_does(spark, tmp_path):
    """Two files in two runs of one job, a third still being written: the totals are those of the whole files in a batch."""
    import fixtures as X
    from methlake.model.artifact import load_model
    from methlake.plans import entries as E

    refs, folder = X.grch38_refs(), tmp_path / "in"
    folder.mkdir()
    sites = [(f"chr{c + 1}", p, f"cg{c}_{p}") for c in range(3) for p in range(0, 3200, 3)]
    X.model_folder(tmp_path / "model", sites)
    model = load_model(spark, str(tmp_path / "model"))
    reads = X.random_reads(240, 3, 3000)

    def arrive(name, some):
        X.write_bam(tmp_path / name, refs, [X.to_record(r) for r in some])
        (tmp_path / name).rename(folder / name)

    def run():
        stream = S.alignment_reads(spark, str(folder), splitBytes="2000")
        query = S.accumulate(stream, S.alignment_counts(model), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
        query.awaitTermination()

    arrive("a.bam", reads[:120])
    run()
    (folder / "late.bam").write_bytes((folder / "a.bam").read_bytes()[:-40])  # no closing block yet
    arrive("b.bam", reads[120:])
    run()
    run()  # nothing new
    key = ["sample_id", "probe_id"]
    got = {tuple(r) for r in S.totals(spark, str(tmp_path / "table"), key).select(*key, "n_mod", "n_unmod").collect()}
    scanned = E.bam_counts(spark, [str(folder / "a.bam"), str(folder / "b.bam")], model)
    assert got == {tuple(r) for r in scanned[0].select(*key, "n_mod", "n_unmod").collect()} and len(got) > 200
    totals = {r["sample_id"]: r for r in scanned.totals.collect()}
    for path, t in totals.items():
        mine = [r for r in got if r[0] == path]
        assert (t["n_called"], t["n_covered"]) == (sum(r[2] + r[3] for r in mine), len(mine)) and t["n_filtered"] > 0
