"""Streams against their batch twins."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from provenant.streaming import ingest, leases

SMS = '<smses><sms date="1700000000000" address="1" type="1" body="{}"/><sms date="1700000000001" address="2" type="2" body="b"/></smses>'
START = dt.datetime(2024, 1, 1)
EVENTS = [(1, 1, "claim", "a", 60.0, 0), (1, 2, "renew", "a", 60.0, 50), (1, 3, "finish", "a", 0.0, 100), (2, 1, "claim", "a", 10.0, 0), (2, 2, "claim", "b", 10.0, 5), (2, 3, "finish", "a", 0.0, 30), (2, 4, "claim", "c", 1000.0, 40), (3, 1, "renew", "z", 5.0, 1)]


def log(spark, some=EVENTS):
    rows = [(j, s, e, t, x, START + dt.timedelta(seconds=at)) for j, s, e, t, x, at in some]
    return spark.createDataFrame(rows, "job_id bigint, seq bigint, event string, token string, lease_seconds double, ts timestamp")


def test_batch_fold(spark):
    now = START.replace(tzinfo=dt.UTC).timestamp() + 200
    found = {r.job_id: (r.status, r.attempts, r.token, r.abandoned) for r in leases.lease_state(log(spark), now).collect()}
    assert found == {1: ("done", 1, None, 0), 2: ("running", 2, "c", 1), 3: ("queued", 0, None, 0)}


def streamed(spark, tmp_path, name, df, folder="in", files=1):
    query = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect()


def test_stream_fold(spark, tmp_path):
    late = (99, 1, "claim", "z", 1.0, 10_000)  # moves the watermark on
    log(spark, [*EVENTS, late]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log(spark).schema).parquet(str(tmp_path / "in"))
    rows = {}
    for r in streamed(spark, tmp_path, "leases", leases.lease_stream(stream)):
        rows[r.job_id] = (r.attempts, r.status, r.token or "", r.abandoned)
    assert rows[1] == (1, "done", "", 0) and rows[2] == (2, "queued", "", 2) and rows[3] == (0, "queued", "", 0) and 99 not in rows


def test_events_that_arrive_in_any_order_fold_in_order(spark, tmp_path):
    rnd = random.Random(4)
    some = [(rnd.randrange(6), i, rnd.choice(["claim", "claim", "renew", "finish", "fail"]), rnd.choice("ab"), rnd.choice([30.0, 200.0]), rnd.randrange(0, 3000)) for i in range(150)]
    delay = 400
    arrival = sorted(some, key=lambda e: e[5] + rnd.randrange(delay - 1))
    (tmp_path / "in").mkdir()
    for i in range(6):
        part = arrival[i * 25 : i * 25 + 25]
        log(spark, part).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        file = next((tmp_path / f"part{i}").glob("*.parquet"))
        os.utime(file, (1_000_000 + i, 1_000_000 + i))
        file.rename(tmp_path / "in" / f"{i}.parquet")
    stream = spark.readStream.schema(log(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    for r in streamed(spark, tmp_path, "shuffled", leases.lease_stream(stream, f"{delay} seconds")):
        last[r.job_id] = tuple(r)
    mark = START.replace(tzinfo=dt.UTC).timestamp() + max(e[5] for e in some) - delay
    seen = log(spark, [e for e in some if START.replace(tzinfo=dt.UTC).timestamp() + e[5] <= mark])
    assert last == {r.job_id: tuple(r) for r in leases.lease_state(seen, mark).collect()}


def test_step_is_the_batch_fold(spark):
    rnd = random.Random(9)
    some = [(rnd.randrange(40), i, rnd.choice(["claim", "renew", "finish", "fail", "other"]), rnd.choice(["a", "b", None]), rnd.choice([5.0, 60.0]), rnd.randrange(0, 400)) for i in range(800)]
    start = START.replace(tzinfo=dt.UTC).timestamp()
    want = {}
    for job, _, event, token, lease, at in sorted(some, key=lambda e: (e[5], e[1])):
        want[job] = leases.step(want.get(job, ("queued", 0, None, None, 0)), start + at, event, token, lease)
    want = {job: leases.step(state, start + 500, "look", None, None) for job, state in want.items()}
    assert {r.job_id: tuple(r)[1:] for r in leases.lease_state(log(spark, some), start + 500).collect()} == want


def test_results_are_fenced_in_a_stream(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    held = [(1, "a", 0, 100), (1, "a", 80, 200), (1, "b", 300, 400), (2, "c", 50, 60), (9, "z", 5000, 5001)]
    told = [(10, 1, "a", 50), (11, 1, "a", 150), (12, 1, "a", 250), (13, 1, "a", 350), (14, 1, "b", 350), (15, 2, "c", 55), (16, 3, "x", 10), (17, 2, "c", 40), (10, 1, "a", 50), (99, 9, "z", 5000)]
    lease = spark.createDataFrame([(j, t, at(s), at(e)) for j, t, s, e in held], "job_id bigint, token string, since timestamp, expires timestamp")
    result = spark.createDataFrame([(i, j, t, at(s)) for i, j, t, s in told], "id bigint, job_id bigint, token string, published timestamp")
    # results come first, in order of no kind; their leases come with a later batch
    for name, df in (("results", result), ("leases", lease)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    (tmp_path / "none").mkdir()
    lease_file = next((tmp_path / "leases").glob("*.parquet"))
    lease_file.rename(tmp_path / "later.parquet")
    paths = [str(tmp_path / x) for x in ("accepted", "rejected", "state")]
    run = lambda: leases.write_fenced(leases.fence_stream(read("results", result), read("leases", lease), horizon="20 minutes"), *paths).awaitTermination(300)
    run()
    (tmp_path / "later.parquet").rename(lease_file)
    run()
    for name, df, after in (("results", result, "published"), ("leases", lease, "since")):  # time goes on on both sides
        df.filter("job_id = 9").withColumn(after, F.lit(at(9000))).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    run()
    run()
    accepted = sorted(r.id for r in spark.read.parquet(paths[0]).collect())
    rejected = sorted((r.id, r.rejected) for r in spark.read.parquet(paths[1]).collect())
    assert accepted == [10, 11, 14, 15, 99]
    assert rejected == [(12, "expired"), (13, "stale_token"), (16, "no_lease"), (17, "no_lease")]


def test_a_crash_between_the_two_writes_leaves_nothing_twice(spark, tmp_path, monkeypatch):
    inbox, out, odd, state = (str(tmp_path / x) for x in ("inbox", "events", "conflicts", "state"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.xml").write_text(SMS.format("a"))
    ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    real, commit = ingest.parse_sms_files, ingest._commit
    twice = lambda files: (one := real(files)).unionByName(one.filter("row = 2").withColumn("body", F.lit("other")))
    monkeypatch.setattr(ingest, "parse_sms_files", twice)
    (tmp_path / "inbox" / "b.xml").write_text(SMS.format("b"))

    def crash(*_):
        raise RuntimeError("power is off")

    monkeypatch.setattr(ingest, "_commit", crash)
    query = ingest.stream_ingest(spark, inbox, out, odd, state)
    try:
        query.awaitTermination(120)
    except Exception as e:
        assert "power is off" in str(e)
    assert ingest.imported(spark, out).count() == 2 and ingest.conflicts(spark, out, odd).count() == 0  # written, not committed
    monkeypatch.setattr(ingest, "_commit", commit)
    for checkpoint in (state, state, str(tmp_path / "fresh")):
        ingest.stream_ingest(spark, inbox, out, odd, checkpoint).awaitTermination(120)
    assert ingest.imported(spark, out).count() == 4
    assert [r.row for r in ingest.conflicts(spark, out, odd).filter(F.col("batch").contains("-1")).collect()] == [2]


def test_a_batch_opens_its_own_buckets_only(spark, tmp_path, monkeypatch):
    inbox, out, odd, state = (str(tmp_path / x) for x in ("inbox", "events", "conflicts", "state"))
    (tmp_path / "inbox").mkdir()
    for name in "abcdefgh":
        (tmp_path / "inbox" / f"{name}.xml").write_text(SMS.format(name))
    ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    seen, real = [], ingest.imported
    monkeypatch.setattr(ingest, "imported", lambda *a, **b: seen.append((df := real(*a, **b)) and len(df.inputFiles())) or df)
    (tmp_path / "inbox" / "z.xml").write_text(SMS.format("z"))
    ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    assert seen in ([None], [1], [2]) and real(spark, out).count() == 18


def test_ingest_is_idempotent(spark, tmp_path):
    inbox, out, odd, state = (str(tmp_path / x) for x in ("inbox", "events", "conflicts", "state"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.xml").write_text(SMS.format("a"))
    for _ in range(2):
        ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    assert ingest.imported(spark, out).count() == 2
    (tmp_path / "inbox" / "b.xml").write_text(SMS.format("a"))
    ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    assert ingest.imported(spark, out).count() == 4  # another file is another source
    ingest.stream_ingest(spark, inbox, out, odd, str(tmp_path / "fresh")).awaitTermination(120)
    assert ingest.imported(spark, out).count() == 4 and ingest.conflicts(spark, out, odd).count() == 0


def test_one_key_with_two_payloads_in_a_batch_is_a_conflict(spark, tmp_path, monkeypatch):
    inbox, out, odd, state = (str(tmp_path / x) for x in ("inbox", "events", "conflicts", "state"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.xml").write_text(SMS.format("a"))
    real = ingest.parse_sms_files
    # the batch holds each row twice, and the second row a third time with another body
    monkeypatch.setattr(ingest, "parse_sms_files", lambda files: (one := real(files)).unionByName(one).unionByName(one.filter("row = 2").withColumn("body", F.lit("other"))))
    ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    assert sorted(r.row for r in ingest.imported(spark, out).collect()) == [1, 2] and [r.row for r in ingest.conflicts(spark, out, odd).collect()].count(2) >= 1
    assert {r.row for r in ingest.conflicts(spark, out, odd).collect()} == {2}


def test_what_a_batch_wrote_is_read_again_only_where_a_key_repeats(spark, tmp_path, monkeypatch):
    inbox, out, odd, state = (str(tmp_path / x) for x in ("inbox", "events", "conflicts", "state"))
    (tmp_path / "inbox").mkdir()
    for name in "abcdefgh":
        (tmp_path / "inbox" / f"{name}.xml").write_text(SMS.format(name))
    met, upsert, real = [], ingest.upsert_events, ingest.parse_sms_files
    monkeypatch.setattr(ingest, "upsert_events", lambda new, known, payload: met.append((new.count(), known.count())) or upsert(new, known, payload))
    ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    assert met == [(16, 0)]
    # again, with one row of one export a second time: equal rows are left, the other body is a conflict with what is known
    monkeypatch.setattr(ingest, "parse_sms_files", lambda files: (one := real(files)).unionByName(one.filter("row = 2 and file like '%/c.xml'").withColumn("body", F.lit("other"))))
    met.clear()
    ingest.stream_ingest(spark, inbox, out, odd, str(tmp_path / "fresh")).awaitTermination(120)
    assert met[0] == (16, 16) and len(met) == 2 and met[1][0] == 1 and met[1][1] < 16
    assert ingest.imported(spark, out).count() == 16 and [(r.row, r.file[-5:]) for r in ingest.conflicts(spark, out, odd).collect()] == [(2, "c.xml")]


def test_the_slice_of_a_row_is_not_stored(spark, tmp_path, monkeypatch):
    inbox, out, odd, state = (str(tmp_path / x) for x in ("inbox", "events", "conflicts", "state"))
    (tmp_path / "inbox").mkdir()
    for i in range(40):
        (tmp_path / "inbox" / f"{i}.xml").write_text(SMS.format(i))
    names = []
    upsert = ingest.upsert_events
    monkeypatch.setattr(ingest, "upsert_events", lambda new, known, payload: names.append(set(new.columns) - set(known.columns)) or upsert(new, known, payload))
    ingest.stream_ingest(spark, inbox, out, odd, state).awaitTermination(120)
    assert names == [{"slice"}]
    found = ingest.imported(spark, out)
    assert found.count() == 80 and "slice" not in found.columns and "slice" not in ingest.conflicts(spark, out, odd).columns


def test_the_inbox_of_k01_is_one_folder(spark, tmp_path, monkeypatch):
    from provenant.plans import registry

    seen, real = [], ingest.stream_ingest
    monkeypatch.setattr(ingest, "stream_ingest", lambda s, inbox, *a: seen.append(inbox) or real(s, inbox, *a))
    registry.queries()["k01_stream_ingest"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and len(set(seen)) == 1 and "*" not in seen[0]
    assert all(f.is_file() for f in os.scandir(seen[0].removeprefix("file:")))
