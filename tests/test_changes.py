import datetime as dt
import random

import pytest

from lexloom.operators.changes import ChangeCapture, Log, plan_history, replay_history, replay_runs

FEED = Log("corpus", "ruta", ("seq",), "m", ("u", "b"))
SCHEMA = "corpus string, ruta string, seq bigint, m double, u string, b bigint"


class Stop(Exception):
    pass


def made(n=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        version = rng.randrange(6)
        rows.append((rng.choice(["es", "fr", "de"]), f"r{0 if k % 3 == 0 else rng.randrange(12)}", k, float(version), None if version == 4 else f"v{version // 2}", None if version == 3 else version // 2))
    return rows


def model(rows, cuts):
    """Keys to process at each cut: new or of another state."""
    known, out = {}, []
    for cut in cuts:
        best = {}
        for c, r, s, m, u, b in rows:
            if s <= cut and c is not None and r is not None:
                k = (m if m is not None else float("-inf"), u is not None, u or "", b is not None, b or 0)
                if (c, r) not in best or k > best[c, r][0]:
                    best[c, r] = (k, (u, b))
        state = {k: v[1] for k, v in best.items()}
        out.append({k for k, v in state.items() if k not in known or known[k] != v})
        known = state
    return out


def test_runs_with_failures_neither_skip_nor_repeat(spark, tmp_path):
    rows = made() + [("es", None, 5, 1.0, "x", 1), (None, "r1", 6, 1.0, "x", 1), ("es", "r1", 7, None, "z", 9)]
    cuts, capture, rng = [40, 41, 90, 150, 300], ChangeCapture(spark, str(tmp_path / "cdc"), FEED, compact_every=3), random.Random(2)
    got = []
    for cut in cuts:
        log = spark.createDataFrame([r for r in rows if r[2] <= cut], SCHEMA)
        for stage in rng.sample(["planned", "written"], 2):

            def stop(now, stage=stage):
                if now == stage:
                    raise Stop

            before = capture.committed()
            with pytest.raises(Stop):
                capture.run(log, stop=stop)
            assert capture.committed() == before
        batch = capture.run(log)
        found = {(r.part, r.key) for r in spark.read.parquet(str(tmp_path / "cdc" / "batches" / f"batch={batch}")).where("changed").collect()}
        got.append(found)
        assert capture.run(log) is None  # nothing new: no batch
    assert got == model(rows, cuts)
    sink = capture.changes()
    assert sink.count() == sum(map(len, got)) == sink.select("part", "key", "offset").distinct().count()


def test_a_failed_plan_is_replayed_as_it_was(spark, tmp_path):
    capture = ChangeCapture(spark, str(tmp_path / "cdc"), FEED)
    rows = made(30)

    def stop(stage):
        raise Stop

    with pytest.raises(Stop):
        capture.run(spark.createDataFrame(rows[:10], SCHEMA), stop=stop)
    log = spark.createDataFrame(rows, SCHEMA)
    assert capture.run(log) == 0 and max(capture.committed().values()) == [9]  # the plan's range, not the newer rows
    assert capture.run(log) == 1 and max(capture.committed().values()) == [29]
    assert capture.run(spark.createDataFrame([], SCHEMA)) is None


def test_deliveries_of_one_instant_that_land_after_a_run_are_taken(spark, tmp_path):
    t = dt.datetime(2024, 5, 1, 12)
    names, schema = Log("corpus", "ruta", ("at", "seq"), "m", ("u",)), "corpus string, ruta string, at timestamp_ntz, seq bigint, m double, u string"
    capture, rows = ChangeCapture(spark, str(tmp_path / "cdc"), names), [("es", "a.md", t, 1, 1.0, "x")]
    taken = []
    for seq, name in ((2, "b.md"), (3, "c.md"), (None, None)):
        batch = capture.run(spark.createDataFrame(rows, schema))
        taken.append({r.key for r in capture.changes().where(f"batch = {batch}").collect()})
        if name:
            rows.append(("es", name, t, seq, 1.0, "x"))
    assert taken == [{"a.md"}, {"b.md"}, {"c.md"}] and capture.run(spark.createDataFrame(rows, schema)) is None


def test_ranges_reach_the_scan(spark, tmp_path):
    t = dt.datetime(2024, 5, 1)
    names = Log("corpus", "ruta", ("at", "seq"), "m", ("u",))
    spark.createDataFrame([("es", f"r{k}", t + dt.timedelta(hours=k), k, 1.0, "x") for k in range(50)], "corpus string, ruta string, at timestamp_ntz, seq bigint, m double, u string").write.parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    log, capture = spark.read.parquet(str(tmp_path / "log")), ChangeCapture(spark, str(tmp_path / "cdc"), names)
    part = capture._between(log, {"es": [["2024-05-01 03:00:00.000000", 3], ["2024-05-01 07:00:00.000000"]]})
    assert sorted(r.seq for r in part.collect()) == [4, 5, 6, 7]
    plan = part._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(seq,3)" in pushed and "LessThanOrEqual(at," in pushed and "EqualTo(corpus,es)" in pushed


def test_a_partition_that_fails_is_taken_again(spark, tmp_path):
    capture, rows = ChangeCapture(spark, str(tmp_path / "cdc"), FEED), [("es", "a", 1, 1.0, "x", 1), ("fr", "a", 2, 1.0, "x", 1)]
    assert capture.run(spark.createDataFrame(rows, SCHEMA), failing={"fr"}) == 0
    assert capture.committed() == {"es": [1]}
    rows += [("fr", "b", 3, 1.0, "x", 1), ("fr", "a", 4, 0.5, "y", 1)]
    assert capture.run(spark.createDataFrame(rows, SCHEMA)) == 1
    assert {(r.batch, r.part, r.key, r.u) for r in capture.changes().collect()} == {(0, "es", "a", "x"), (1, "fr", "a", "x"), (1, "fr", "b", "x")}
    assert [p[:2] for p in capture.plans()] == [(0, "es"), (0, "fr"), (1, "fr")]


def test_history_equals_the_model(spark, tmp_path):
    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k)
    rows = made(150, 3) + [("es", "late", 3, None, None, None), ("es", "late", 20, None, None, None)]
    runs = [(k, c, t(10 * k + 3), s) for k, (c, s) in enumerate([("es", "ok"), ("fr", "failed"), ("es", "aborted"), ("es", "ok"), ("fr", "ok"), ("es", "timeout"), ("fr", "ok"), ("de", "ok"), ("es", "ok"), ("de", None)])]
    runs += [runs[3], (99, None, t(5), "ok"), (98, "es", None, "ok")]
    plans = plan_history(spark.createDataFrame(runs, "run_id bigint, corpus string, started timestamp_ntz, status string"), "corpus", "run_id", "started", "status")
    by = {r.run_id: r for r in plans.collect()}
    assert len(by) == 10 and by[0]["from"] is None and by[3]["from"] == t(3) and by[8].replays == 1 and by[6].replays == 0 and by[4].replays == 1
    log = spark.createDataFrame([(c, r, t(s), m, u, b) for c, r, s, m, u, b in rows], "corpus string, ruta string, seq timestamp_ntz, m double, u string, b bigint")
    got = {(r.run_id, r.key) for r in replay_history(log, plans, FEED).collect()}
    want = set()
    for corpus in ("es", "fr", "de"):
        ok = [r for r in runs[:10] if r[1] == corpus and r[3] == "ok"]
        for r, found in zip(ok, model([x for x in rows if x[0] == corpus], [10 * r[0] + 3 for r in ok])):
            want |= {(r[0], k) for _, k in found}
    assert got == want
    assert {tuple(r) for r in replay_runs(log, plans, FEED, str(tmp_path / "cdc")).collect()} == want
    assert replay_runs(log.limit(0), plans, FEED, str(tmp_path / "none")).count() == 0 and replay_runs(log, plans.limit(0), FEED, str(tmp_path / "no")).count() == 0
    assert replay_history(log.limit(0), plans, FEED).count() == 0 and replay_history(log, plans.limit(0), FEED).count() == 0
