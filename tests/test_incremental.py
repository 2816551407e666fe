"""Keyed streaming state, and the reconcile run after batches against a run from nothing."""

import glob
import os
import random
import shutil
import time

from graphlake.operators import reconcile
from graphlake.streaming import incremental

SCHEMA = "id int, v string, at timestamp, n int"


def feed(spark, source, name, rows):
    spark.createDataFrame(rows, "id int, v string, at int, n int").selectExpr("id", "v", "timestamp_seconds(at) as at", "n").coalesce(1).write.parquet(f"{source}-{name}")
    os.makedirs(source, exist_ok=True)
    shutil.move(glob.glob(f"{source}-{name}/part-*.parquet")[0], f"{source}/{name}.parquet")


def test_newest_row_wins_and_a_batch_repeats(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    run = lambda: incremental.run(spark, source, SCHEMA, "id", "at", work).awaitTermination()
    feed(spark, source, "a", [(1, "x", 5, None), (1, "late", 3, 1), (2, None, None, 7), (None, "no key", 1, 1)])
    run()
    feed(spark, source, "b", [(1, "old", 4, 2), (2, "y", 1, None), (3, "z", 1, 1), (3, "z", 1, 1)])
    run()
    log = lambda: sorted((r.batch, r.id, r.change, r.old and (r.old.v, r.old.n), r.new and (r.new.v, r.new.n)) for r in incremental.changes(spark, work).collect())
    want = [(0, 1, "add", None, ("x", None)), (0, 2, "add", None, (None, 7)), (1, 2, "modify", (None, 7), ("y", None)), (1, 3, "add", None, ("z", 1))]
    assert log() == want
    # the last batch was written but not committed: it runs again to the same result
    for f in glob.glob(f"{work}/progress/commits/1") + glob.glob(f"{work}/progress/commits/.1.crc"):
        os.remove(f)
    run()
    assert log() == want
    assert sorted((r.id, r.v, r.n) for r in incremental.current(spark, work, SCHEMA, "id").collect()) == [(1, "x", None), (2, "y", None), (3, "z", 1)]


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """The change logs that a batch adds to the store do not grow with the state."""
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    size = lambda batch: sum(os.path.getsize(f) for f in glob.glob(f"{work}/progress/state/0/*/{batch + 1}.changelog"))
    feed(spark, source, "a", [(i, "x" * 50, 1, i) for i in range(4000)])
    feed(spark, source, "b", [(i, "y", 2, i) for i in range(20)])
    incremental.run(spark, source, SCHEMA, "id", "at", work).awaitTermination()
    assert size(0) > 20_000 and 0 < size(1) < 0.1 * size(0)


def test_keys_expire(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    feed(spark, source, "a", [(1, "x", 1, 1)])
    incremental.run(spark, source, SCHEMA, "id", "at", work, idle_ms=10).awaitTermination()
    time.sleep(0.1)
    feed(spark, source, "b", [(2, "y", 1, 1)])
    incremental.run(spark, source, SCHEMA, "id", "at", work, idle_ms=10).awaitTermination()
    got = {(r.id, r.change) for r in incremental.changes(spark, work).collect()}
    assert {(1, "add"), (2, "add"), (1, "expire")} <= got


TABLES = {"uses": "repo string, channel string, app string, role string", "claims": "repo string, channel string, app string, role string", "names": "repo string, name string, id int", "declared": "repo string, name string", "calls": "repo string, call string, host string"}


def facts_of(spark, rows):
    return reconcile.Facts(**{k: spark.createDataFrame(rows[k], s) for k, s in TABLES.items()})


def random_rows(rng, repo):
    """The facts of one repository: few channels and names, so that repositories meet in them."""
    channel, app = lambda: f"c{rng.randrange(60)}", f"a{repo[1:]}"
    role = lambda: rng.choice(["produces", "consumes"])
    hosts = ["svc-%d-api", "${env}-%d-api", "svc-%d-${kind}.ns.svc", "svc-%d-api:80", "nobody%d"]
    return {
        "uses": [(repo, channel(), app, role()) for _ in range(rng.randrange(4))],
        "claims": [(repo, channel(), rng.choice([app, "a1"]), role()) for _ in range(rng.randrange(3))],
        "names": [(repo, "svc-%d-api" % rng.randrange(90), int(repo[1:])) for _ in range(rng.randrange(2))],
        "declared": [(repo, "svc-%d-api" % rng.randrange(90)) for _ in range(rng.randrange(2))] + [(repo, None)],
        "calls": [(repo, f"{repo}/{i}", rng.choice(hosts) % rng.randrange(90)) for i in range(rng.randrange(4))] + [(repo, f"{repo}/none", None)],
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_equal_a_run_from_nothing(spark):
    rng = random.Random(17)
    repos = [f"r{i}" for i in range(80)]
    state = {r: random_rows(rng, r) for r in repos}
    merged = lambda: {k: [x for r in state.values() for x in r[k]] for k in TABLES}
    before = facts_of(spark, merged())
    results = reconcile.derive(before)
    for batch in range(3):
        some = rng.sample(repos, 2) + [f"r{100 + batch}"]
        for r in some:
            state[r] = random_rows(rng, r) if rng.random() < 0.8 else {k: [] for k in TABLES}
        listed = spark.createDataFrame([(r,) for r in some], "repo string")
        after = facts_of(spark, merged())
        what = reconcile.touched(before, after, listed)
        part = reconcile.restricted(after, what)
        results = reconcile.update(before, after, results, listed)
        want = reconcile.derive(after)
        got = {name: rows(getattr(results, name)) for name in reconcile.KEYS}
        assert got == {name: rows(getattr(want, name)) for name in reconcile.KEYS}
        # what is read again is a share of the facts
        assert part.calls.count() < 0.6 * after.calls.count() and part.uses.count() < 0.5 * after.uses.count()
        # results go on as plain tables, as they would be stored
        results = reconcile.Results(**{name: spark.createDataFrame(got[name], getattr(want, name).schema) for name in reconcile.KEYS})
        before = after
