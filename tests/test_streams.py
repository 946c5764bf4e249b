"""Topics, keyed state, as-of joins and the store: restarts, ties, skew."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from lodestar_market.operators import store
from lodestar_market.operators.asof import as_of_join
from lodestar_market.sources import topics
from lodestar_market.streaming import jobs, stateful

START = dt.datetime(2024, 1, 1)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_topics_survive_restarts(spark, tmp_path):
    """A reader that starts again goes on after what it has read: no message is lost or doubled; a batch written twice is there once."""
    log = str(tmp_path / "log")

    def send(number, first, n):
        rows = [("alerts" if i % 3 == 0 else "results", f'{{"id":{i},\n"text":"é"}}') for i in range(first, first + n)] + [(None, "x"), ("alerts", None)]
        topics.write_batch(spark.createDataFrame(rows, "topic string, value string").repartition(3), number, log)

    def read(name):
        # The same checkpoint each time, as after a stop.
        jobs.run_available(topics.read_topics(spark, log, *name), str(tmp_path / "-".join(("reader", *name))), again=True)
        out = spark.read.parquet(str(tmp_path / "-".join(("reader", *name)) / "out")).select(F.get_json_object("value", "$.id").cast("int").alias("id"), "topic").collect()
        return sorted(r["id"] for r in out), {r["topic"] for r in out}

    send(0, 0, 10)
    assert read(("alerts",)) == ([0, 3, 6, 9], {"alerts"})
    files = sorted(os.listdir(f"{log}/batch=0/topic=alerts"))
    send(0, 0, 10)
    assert sorted(os.listdir(f"{log}/batch=0/topic=alerts")) == files
    send(1, 10, 5)
    send(2, 15, 5)
    # A batch that isn't whole holds back itself and those after it.
    os.remove(f"{log}/batch=1/_SUCCESS")
    assert read(("alerts",))[0] == [0, 3, 6, 9]
    send(1, 10, 5)
    assert read(("alerts",))[0] == list(range(0, 20, 3))
    assert read(("alerts",))[0] == list(range(0, 20, 3))
    assert read(()) == (list(range(20)), {"alerts", "results"})
    batch = topics.read_topics(spark, log, "results", stream=False)
    assert batch.count() == 13 and batch.select("file", "line", "batch").distinct().count() == 13
    assert topics.read_topics(spark, str(tmp_path / "none"), stream=False).count() == 0


def stream_of(own, folder, parts, schema):
    """A stream over files that are there, one a batch."""
    for n, rows in enumerate(parts):
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        path = max((p for p in folder.iterdir() if p.name.startswith("part-")), key=lambda p: p.stat().st_mtime)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
        path.rename(folder / f"{n:03d}.parquet")
        os.utime(folder / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return jobs.read_stream(own, str(folder / "*.parquet"), schema, per_trigger=1)


def test_failing_sources(spark, tmp_path):
    """A run of failures is told once, whether a failure, a success or the watermark shows its length; rows may come late."""
    own = stateful.state_session(spark)
    (tmp_path / "in").mkdir()
    a = [("a", minutes(m), s) for m, s in ((0, "ok"), (5, "bad"), (20, "bad"), (36, "bad"), (50, "bad"), (60, "ok"), (61, "bad"), (80, "ok"))]
    b = [("b", minutes(m), s) for m, s in ((0, "bad"), (30, "ok"), (40, "bad"), (71, "ok"))]
    c = [("c", minutes(m), s) for m, s in ((100, "bad"),)] + [("d", minutes(400), "bad"), (None, minutes(3), "bad"), ("e", None, "bad")]
    # The second half of a's rows comes before its first, within what the watermark allows.
    parts = [a[4:6] + b[:1], a[:4] + b[1:], a[6:] + c[:1], c[1:]]
    log = stream_of(own, tmp_path / "in", parts, "source string, ts timestamp, status string")
    out = jobs.run_available(stateful.failing_sources(log, 30, "90 minutes"), str(tmp_path / "job"), again=True).collect()
    got = sorted((r["source"], r["failing_since"], r["failures"], r["alerted_at"]) for r in out)
    assert got == [("a", minutes(5), 2, minutes(35)), ("b", minutes(40), 1, minutes(70)), ("c", minutes(100), 1, minutes(130))]


def test_request_windows_open_at_requests(spark, tmp_path):
    own = stateful.state_session(spark)
    (tmp_path / "in").mkdir()
    rng = random.Random(5)
    rows = sorted((rng.choice("xyz"), START + dt.timedelta(seconds=rng.randrange(40_000))) for _ in range(600)) + [("late", minutes(2000))]
    order = sorted(rows, key=lambda r: r[1])
    log = stream_of(own, tmp_path / "in", [order[:150], order[150:400], order[400:]], "client string, ts timestamp")
    tiers = own.createDataFrame([("x", "premium"), ("y", "registered"), ("z", "unheard of")], "client string, tier string")
    limits = {"anonymous": 2, "registered": 10, "premium": 1000}
    out = jobs.run_available(stateful.request_windows(log, tiers, limits, 3600), str(tmp_path / "job"), again=True).collect()
    want = []
    for client in "xyz":
        opened = count = None
        for _, ts in sorted(r for r in rows if r[0] == client):
            if opened is None or ts >= opened + dt.timedelta(hours=1):
                if opened:
                    want.append((client, opened, count))
                opened, count = ts, 0
            count += 1
        want.append((client, opened, count))
    most = {"x": 1000, "y": 10, "z": 2}
    assert sorted((r["client"], r["window_start"], r["requests"], r["allowed"], r["denied"]) for r in out) == sorted((c, o, n, min(n, most[c]), n - min(n, most[c])) for c, o, n in want)


def test_as_of_join(spark):
    """Against a plain search, with a key that has most rows, ties, nulls and requests before all history."""
    rng = random.Random(8)
    keys = ["hot"] * 8 + ["a", "b", "none"]
    history = [(rng.choice(keys[:10]), START + dt.timedelta(hours=rng.randrange(9000)), i) for i in range(3000)] + [(None, START, 1), ("a", None, 2)]
    asked = [(i, rng.choice(keys), START + dt.timedelta(hours=rng.randrange(-500, 9500))) for i in range(2000)] + [(9001, None, START), (9002, "a", None)]
    asked += [(9003 + i, *h[:2]) for i, h in enumerate(history[:20])]
    left = spark.createDataFrame(asked, "n int, k string, at timestamp")
    right = spark.createDataFrame(history, "k string, at timestamp, v int").repartition(4)
    got = {r["n"]: r["v"] for r in as_of_join(left, right, "k", "at", ["v"]).collect()}
    assert len(got) == len(asked)
    for n, k, at in asked:
        known = [(h[1], h[2]) for h in history if h[0] == k and k and at and h[1] and h[1] <= at]
        assert got[n] == (max(known)[1] if known else None)


def test_as_of_join_shuffles_rows_once(spark):
    """Rows of both sides go through one exchange, by key and month; the others carry a row a bucket."""
    left = spark.createDataFrame([(1, "a", START)], "n int, k string, at timestamp")
    right = spark.createDataFrame([("a", START, 1)], "k string, at timestamp, v int")
    plan = as_of_join(left, right, "k", "at", ["v"])._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "hashpartitioning(k" in line and "_bucket" in line]
    rows = [line for line in plan.split("\n") if " Window " in line and "_role" in line]
    assert len(rows) == 1 and plan.count("_row#") and wide
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_merging_leaves_other_months_alone(spark, tmp_path):
    at = str(tmp_path / "store")
    base = spark.createDataFrame([(s, dt.date(2024, m, d), 1, 0) for s in "ab" for m in (1, 2, 3) for d in (1, 2)], "symbol string, trade_date date, value int, version int")
    store.create(base, at)

    def files():
        return {f"{folder}/{name}" for folder, _, names in os.walk(at) for name in names if name.startswith("part-")}

    before = files()
    fresh = spark.createDataFrame([("a", dt.date(2024, 2, 1), 7, 1), ("b", dt.date(2024, 2, 2), 8, -1), ("c", dt.date(2024, 4, 1), 9, 0)], base.schema)
    store.merge(fresh, at, ["symbol", "trade_date"], "version")
    after = files()
    assert {f for f in before if "month=202402" not in f} <= after and not any("month=202402" in f for f in before & after)
    store.merge(fresh, at, ["symbol", "trade_date"], "version")
    rows = {(r["symbol"], r["trade_date"]): r["value"] for r in store.read(spark, at, base.schema).collect()}
    assert len(rows) == 13 and rows["a", dt.date(2024, 2, 1)] == 7 and rows["b", dt.date(2024, 2, 2)] == 1 and rows["c", dt.date(2024, 4, 1)] == 9
    store.merge(fresh.limit(0), at, ["symbol", "trade_date"], "version")
    assert store.read(spark, at, base.schema).count() == 13


def test_first_of_seven_days(spark, tmp_path):
    """A hash is let through again seven days after it was let through last, not after it was seen last; rows may come late and in several batches."""
    own = stateful.state_session(spark)
    (tmp_path / "in").mkdir()
    day = 24 * 60
    a = [("a", minutes(m)) for m in (0, 3 * day, 7 * day - 1, 7 * day, 8 * day, 13 * day, 14 * day)]
    parts = [[a[2], a[0], a[1]], [a[3], ("b", minutes(6 * day)), (None, minutes(1)), ("c", None)], a[4:], [("z", minutes(60 * day))]]
    stream = stream_of(own, tmp_path / "in", parts, "hash string, published_at timestamp")
    out = jobs.run_available(stateful.first_of_days(stream, 7, "5 days"), str(tmp_path / "job"), again=True).collect()
    assert sorted((r["hash"], r["published_at"]) for r in out) == [("a", minutes(0)), ("a", minutes(7 * day)), ("a", minutes(14 * day)), ("b", minutes(6 * day))]


def test_messages_are_short_and_escaped(spark):
    from lodestar_market.operators import report

    kind = "title string, i double, c double, picks array<struct<symbol:string,recommendation:string,confidence:double>>"
    rows = [("A_*`[b", 1234.5, -0.5, [("V_N", "BUY", 0.905), ("X", "SELL", 0.5), ("Y", "HOLD", 0.6), ("Z", "BUY", 0.1)]), ("x", 1.0, None, None), ("y", None, None, []), ("z", 1.0, 1.0, [("S" * 5000, "BUY", 1.0)])]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(report.short_message(F.col("title"), F.col("i"), F.col("c"), F.col("picks"))).collect()]
    end = f"\n_{report.DISCLAIMER}_"
    assert got[0] == "*A\\_\\*\\`\\[b*\n\nIndex: 1234.50 (-0.50%)\n• V\\_N - BUY (91%)\n• X - SELL (50%)\n• Y - HOLD (60%)\n" + end
    assert got[1:] == ["*x*\n\nIndex: 1.00\n" + end, "*y*\n\n" + end, "*z*\n\nIndex: 1.00 (+1.00%)\n" + end]
    assert all(len(m) <= report.MESSAGE_LIMIT for m in got)


def test_no_severity_is_lost(spark):
    from lodestar_market.operators import monitoring

    rows = spark.createDataFrame([("critical",), ("high",), ("medium",), ("new",), (None,)], "severity string")
    got = sorted((r["severity"] or "", r["channel"]) for r in monitoring.route_by_severity(rows).collect())
    assert got == [("", "log"), ("critical", "email"), ("critical", "telegram"), ("high", "telegram"), ("medium", "log"), ("new", "log")]


def test_bars_and_snapshots_are_not_sorted(spark):
    """Bars and last rows are aggregates by hash: no sort stands before them."""
    from lodestar_market import catalog

    for name in ("w21_bars_from_trades", "w19_latest_snapshot", "c3_recommendation", "c8_forecast", "j9_latest_as_of"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortAggregate") == 0 and plan.count("HashAggregate") >= 2, name


def test_order_keys_sort_as_their_columns(spark):
    from lodestar_market.operators.bars import order_key

    rows = [(a, b, c) for a in (-5, 0, 7, 10**15) for b in (0, 9) for c in (0, 5, 10**9)]
    df = spark.createDataFrame(rows, "a long, b int, c long").withColumn("k", order_key("a", ("b", 2), ("c", 12)))
    assert [tuple(r)[:3] for r in df.orderBy("k").collect()] == sorted(rows)


def test_gaps_count_rounded_seconds(spark, tmp_path):
    """Both ends of a gap are rounded to seconds, halves to the even one, as in the SQL: beside 36 hours that lets gaps in and rules them out."""
    import duckdb

    from lodestar_market import catalog

    ends = (0, 1, 400_000, 499_999, 500_000, 500_001, 600_000, 999_999)
    pairs = [(s, a, b) for s in (-7, 0, 1, 1_704_067_200, 1_704_067_201) for a in ends for b in ends]
    at = lambda seconds, micros: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds, microseconds=micros)
    rows = [(n, at(s + far, x)) for n, (s, a, b) in enumerate(pairs) for far, x in ((0, a), (36 * 3600, b))]
    spark.createDataFrame([*rows, (None, at(0, 0)), (1, None), (1, at(0, 0))], "user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in catalog.queries()["st4_gaps"](spark, str(tmp_path)).select("source", "gap_start", "gap_end").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["st4_gaps"]).fetchall())
    assert got == want and 0 < len(want) < len(pairs)


def test_alert_stream_writes_counts_only(spark, tmp_path, monkeypatch):
    """Each alert goes to every user of its symbol: what the stream writes doesn't grow with their number, and the users' counts are the SQL's."""
    import duckdb

    from lodestar_market import catalog
    from lodestar_market.plans import daily

    rng = random.Random(9)
    events = [(i, rng.choice([*range(40), None]), rng.choice(["error", "error", "view", None]), START) for i in range(600)]
    segments = ["BUILDING", "MACHINERY", "FURNITURE", None]
    customers = [(rng.randrange(300), rng.choice([-1.0, 0.0, 5.0, 7.0, None]), rng.choice(segments)) for _ in range(500)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(daily, "_folder", lambda _: str(tmp_path / "shared"))
    got = sorted(tuple(r) for r in catalog.queries()["st9_alert_stream"](spark, str(tmp_path)).select("symbol", "alert_type", "user_id", "n").collect())
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracle_sql()["st9_alert_stream"]).fetchall()) and len(got) > 100
    written = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "shared" / "*" / "out")).count()
    assert written <= 11  # ten symbols, and users without one


def test_counts_of_several_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = stream_of(spark, tmp_path / "in", [[("a",), ("a",), (None,)], [("b",)], [("a",), ("b",), (None,)]], "k string")
    out = jobs.run_counted(stream, str(tmp_path / "job"), ["k"])
    assert sorted((r["k"] or "", r["n"]) for r in out.collect()) == [("", 2), ("a", 3), ("b", 2)]
