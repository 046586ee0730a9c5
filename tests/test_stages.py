"""Staged runs: what is computed when, killed runs, forced stages; stored slices; states that add up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from backglot.operators import positions, reports, stages
from backglot.plans import pipeline_queries, roundtrip
from backglot.plans.roundtrip import ROW
from backglot.session import scratch_path
from backglot.sources import tables

KINDS = "run long, model string"


def graph(spark, path, grid, calls, fail=()):
    def stage(name, keys, *needs):
        def build(cells, *tables):
            calls.append((name, sorted(map(str, cells.collect()))))
            if name in fail:
                raise RuntimeError(name)
            value = F.lit(1)  # and the values of the stages before
            for k, table in enumerate(tables):
                cells = cells.join(table.select("run", F.col("v").alias(f"v{k}")), "run", "left")
                value = value + F.coalesce(f"v{k}", F.lit(0))
            return cells.withColumn("v", value).select(*keys, "v")

        return stages.Stage(name, keys, build, needs)

    run, cell = ("run",), ("run", "model")
    return stages.StagedRun(spark, path, grid, [stage("a", run), stage("b", run, "a"), stage("c", cell, "a", "b")])


def test_only_missing_cells_are_computed(spark):
    path, calls = scratch_path(spark, "staged"), []
    grid = spark.createDataFrame([(1, "x"), (2, "x"), (2, None)], KINDS)
    assert graph(spark, path, grid.where("run = 1"), calls).run() == {"a": 1, "b": 1, "c": 1}
    assert graph(spark, path, grid, calls).run(until="b") == {"a": 1, "b": 1}
    last = graph(spark, path, grid, calls)
    assert last.run() == {"a": 0, "b": 0, "c": 2}
    assert graph(spark, path, grid, calls).run() == {"a": 0, "b": 0, "c": 0}
    assert sorted((r["run"], str(r["model"]), r["v"]) for r in last.table("c").collect()) == [(1, "x", 4), (2, "None", 4), (2, "x", 4)]
    assert dict(last.table("c").dtypes) == {"v": "int", "run": "bigint", "model": "string"}


def test_killed_run_goes_on_at_the_missing_stage(spark):
    path, calls = scratch_path(spark, "staged"), []
    grid = spark.createDataFrame([(1, "x"), (2, "y")], KINDS)
    with pytest.raises(RuntimeError):
        graph(spark, path, grid, calls, fail=("b",)).run()
    assert graph(spark, path, grid, calls).run() == {"a": 0, "b": 2, "c": 2}
    assert [name for name, _ in calls] == ["a", "b", "b", "c"]


def test_table_without_ledger_is_written_again(spark):
    """A run killed after the table, before the ledger."""
    path = scratch_path(spark, "staged")
    grid = spark.createDataFrame([(1, "x")], KINDS)
    spark.createDataFrame([(99, 1)], "v int, run long").write.partitionBy("run").parquet(f"{path}/a")
    run = graph(spark, path, grid, [])
    assert run.run() == {"a": 1, "b": 1, "c": 1}
    assert [tuple(r) for r in run.table("a").collect()] == [(1, 1)]


def test_forced_stage_renews_what_hangs_on_it(spark):
    path, calls = scratch_path(spark, "staged"), []
    grid = spark.createDataFrame([(1, "x"), (2, "x")], KINDS)
    graph(spark, path, grid, calls).run()
    assert graph(spark, path, grid, calls).run(force=["b"]) == {"a": 0, "b": 2, "c": 2}


def test_empty_grid(spark):
    run = graph(spark, scratch_path(spark, "staged"), spark.createDataFrame([], KINDS), [])
    assert run.run() == {"a": 0, "b": 0, "c": 0}


def test_slices_read_only_their_files(spark):
    path = scratch_path(spark, "positions")
    keys = spark.range(1000).select((F.col("id") * 7).alias("k")).repartition(5)
    positions.store_positions(keys, "k", path, range_rows=100)
    inside = positions.stored_slice(spark, path, 250, 100)
    assert sorted((r["row"], r["pos"], r["k"]) for r in inside.collect()) == [(i, 250 + i, (250 + i) * 7) for i in range(100)]
    assert {f.split("pos_range=")[1].split("/")[0] for f in inside.inputFiles()} >= {"2", "3"}
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pos_range" in plan and "pos_range#" in plan
    over = positions.stored_slice(spark, path, 950, 100)
    assert sorted(r["pos"] for r in over.collect()) == list(range(100))
    assert positions.stored_slice(spark, path, 10, 0).count() == 0


def test_large_tables_have_no_more_ranges_than_allowed(spark):
    path = scratch_path(spark, "positions")
    positions.store_positions(spark.range(1000).select(F.col("id").alias("k")), "k", path, range_rows=1)
    stored = spark.read.parquet(path)
    assert stored.select("pos_range").distinct().count() <= positions.MOST_RANGES
    assert sorted(r["k"] for r in positions.stored_slice(spark, path, 500, 10).collect()) == list(range(500, 510))


def test_texts_are_stored_once_per_run_not_per_cell(spark):
    run = pipeline_queries.staged(spark, "/root/testdata/sf0.001", scratch_path(spark, "staged"))
    run.run(until="stage2")
    assert not {"original", "partial"} & set(run.table("stage2").columns)
    rows = run.table("stage2").count()
    assert run.table("stage2").join(run.table("partial").select(*ROW, "original", "partial"), ROW).count() == rows > 0


def test_own_texts_are_stored_once_and_scratch_goes(spark):
    """One model answers everything, the other one nothing: its rows keep their own texts, which no cell stores."""
    path = scratch_path(spark, "staged")
    corpus = spark.createDataFrame([(i, f"a b{i}") for i in range(8)], "doc_id long, text string")
    words = spark.createDataFrame([("a", "x")], "word string, repl string")
    memory = spark.createDataFrame([], "src string, tgt string, phrase string, translation string")
    handed = []

    def answers(requests):
        given = requests.where("model = 'first'").select("model", "request_id", F.lit("done").alias("response")).distinct()
        handed.append(tables.hand_over(given, "responses").inputFiles()[0].rsplit("/", 1)[0])
        return spark.read.parquet(handed[-1])

    cells = [(0, 2, 3, m, k) for m in ("first", "second") for k in (0, 2)]
    grid = spark.createDataFrame(cells, "start_index long, stage1_samples long, stage2_samples long, model string, chunk_size long")
    trip = roundtrip.RoundTrip(spark, corpus, words, memory, answers, range_rows=4)
    run = stages.StagedRun(spark, path, grid, trip.stages(path))
    run.run()
    forward, back = run.table("stage2"), run.table("back2")
    assert {(r["model"], r["translated"], r["status"]) for r in forward.collect()} == {("first", "done", "answered"), ("second", None, "missing")}
    assert {(r["model"], r["partial_back"], r["back"]) for r in back.collect()} == {("first", "done", "done"), ("second", None, None)}
    whole = roundtrip.stage2_texts(forward, run.table("partial"))
    assert {r["translated"] for r in whole.where("model = 'second'").collect()} == {"x b2", "x b3", "x b4"}
    details = roundtrip.details2_texts(run.table("details2"), run.table("partial"), back, run.table("own")).collect()
    want = [(*c[3:], i, f"a b{i + 1}", *([f"x b{i + 1}"] * 2 if c[3] == "second" else ["done"] * 2)) for c in cells for i in (1, 2, 3)]
    assert sorted((r["model"], r["chunk_size"], r["index"], r["original"], r["partial_back"], r["back"]) for r in details) == sorted(want)
    assert len(handed) == 2 and not any(tables.exists(spark, p) for p in (*handed, f"{path}/positions"))
    assert run.run() == {stage: 0 for stage in run.stages}


def test_a_step_deletes_what_it_handed_over(spark):
    with tables.step(spark):
        with tables.step(spark):
            inner = tables.hand_over(spark.range(9).repartition(3), "inner").inputFiles()[0]
        outer = tables.hand_over(spark.range(9), "outer").inputFiles()[0]
        assert not tables.exists(spark, inner) and tables.exists(spark, outer)
        assert spark.conf.get(tables.SHUFFLE_CLEANUP) == "true"
    assert not tables.exists(spark, outer) and spark.conf.get(tables.SHUFFLE_CLEANUP, None) != "true"
    with pytest.raises(RuntimeError), tables.step(spark):
        failed = tables.hand_over(spark.range(9), "failed").inputFiles()[0]
        raise RuntimeError
    assert tables.exists(spark, failed)


def test_summary_of_batches_equals_summary_of_all(spark):
    rows = [(i % 3, i / 7, i % 2 == 0, i / 11, None if i % 5 == 0 else i / 13, i / 17, i / 19) for i in range(60)]
    kinds = "run int, bleu_score double, syntax_valid boolean, structure_score double, semantic_score double, token_match double, overall_score double"
    df = spark.createDataFrame(rows, kinds).fillna(0.0)
    want = {r["run"]: r.asDict() for r in reports.evaluation_summary(df, ["run"]).collect()}
    states = reports.summary_state(df.where("overall_score < 1"), ["run"]).union(reports.summary_state(df.where("overall_score >= 1"), ["run"]))
    got = {r["run"]: r.asDict() for r in reports.finish_summary(reports.merge_states(states, ["run"]), ["run"]).collect()}
    for run, row in want.items():
        assert got[run] == pytest.approx(row)
