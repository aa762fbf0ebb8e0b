"""A drained stream must equal its batch twin."""
import json
import os
import random
from collections import deque

from pyspark.sql import Row, functions as F

import pytest

from licmatch.operators import ingest
from licmatch.sources import feeds
from licmatch.streaming import jobs, limiter, verdict_state, verdicts
from tests.test_sources import ASHBY, GREENHOUSE, LEVER

TODAY = "2026-08-14"


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def memory(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode) \
        .trigger(availableNow=True).start()
    drain(query)
    return frame.sparkSession.table(name)


def write_fetches(folder, *batches):
    path = os.path.join(folder, "fetches")
    os.makedirs(path, exist_ok=True)
    order = 0
    for i, batch in enumerate(batches):
        name = os.path.join(path, f"{i:03d}.json")
        with open(name, "w") as handle:
            for ats, company, status, body in batch:
                handle.write(json.dumps({
                    "ats": ats, "slug": company.lower(), "company": company,
                    "http_status": status, "body": body, "fetched_on": TODAY,
                    "ord": order}) + "\n")
                order += 1
        os.utime(name, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return path


def batches():
    gone = dict(GREENHOUSE, id=99, title="Data Engineer")
    return [
        [("greenhouse", "Monzo", 200, json.dumps({"jobs": [GREENHOUSE, gone]})),
         ("lever", "Beta", 200, json.dumps([LEVER]))],
        [("greenhouse", "Monzo", 200, json.dumps({"jobs": [GREENHOUSE]})),
         ("lever", "Beta", 503, ""),
         ("ashby", "Acme", 200, json.dumps({"jobs": [ASHBY]}))]]


def test_ingest_stream(spark, folder):
    path = write_fetches(folder, *batches())
    lookup = spark.createDataFrame([("MONZO BANK", "A", 1)], "key string, rating string, "
                                                             "ord bigint")
    boards = spark.createDataFrame([("Monzo", "greenhouse", "MONZO BANK", 1)],
                                   "company string, ats string, register_name string, "
                                   "ord bigint")
    calls = []

    def aliases():
        calls.append(1)         # the overlay is read again in every micro-batch
        return spark.createDataFrame([("Acme", "MONZO BANK", "B", 1)],
                                     "company string, register_name string, rating string, "
                                     "ord bigint")

    def run(checkpoint):
        drain(jobs.ingest_stream(jobs.read_fetches(spark, path), folder,
                                 os.path.join(folder, checkpoint), TODAY, lambda: boards,
                                 lambda: lookup, aliases))
    run("ck")
    assert len(calls) == 2
    stored = jobs.posting_store(spark, folder).read()
    found = {r["id"]: r["sponsor_match"] for r in stored.collect()}
    assert found == {"gh:4410277": "yes", "gh:99": "yes", "lever:m2q9": "no",
                     "ashby:k77a": "yes"}
    closed = jobs.closure_store(spark, folder).read()
    assert [r["id"] for r in closed.collect()] == ["gh:99"]
    # Every batch run again from the start finds its postings there: nothing changes.
    run("ck-again")
    again = jobs.posting_store(spark, folder).read()
    assert [r["id"] for r in jobs.closure_store(spark, folder).read().collect()] == ["gh:99"]
    assert sorted(r["id"] for r in again.collect()) == sorted(found)
    # The batch twin over the same fetches keeps the same postings.
    log = spark.read.schema(jobs.STREAM_FETCH).json(path)
    good = feeds.fetch_outcomes(log).filter("outcome IN ('active', 'empty')")
    empty = stored.limit(0)
    twin = ingest.ingest(feeds.board_rows(good, TODAY), empty, boards, lookup, aliases(),
                         good.select("ats", "company"), None, TODAY)
    assert {r["id"] for r in twin.new_rows.collect()} == set(found)


def test_board_health(spark, folder):
    path = write_fetches(folder, *batches())
    stream = jobs.board_health(jobs.read_fetches(spark, path))
    found = {(r["ats"], r["slug"]): r["outcome"]
             for r in memory(stream, "health", "complete").collect()}
    twin = jobs.board_health(spark.read.schema(jobs.STREAM_FETCH).json(path))
    assert found == {(r["ats"], r["slug"]): r["outcome"] for r in twin.collect()}
    assert found["lever", "beta"] == "active"       # the outage changed nothing


def write_rows(spark, folder, name, rows, columns, files=3):
    path = os.path.join(folder, name)
    spark.createDataFrame(rows, columns).repartition(files).write.json(path)
    return path, spark.createDataFrame(rows[:1], columns).schema


def test_verdict_stream(spark, folder):
    rows = [(f"j{i % 7}", ["live", "dead", "unknown", "live"][(i * i) % 4 if i % 7 else 2],
             f"2026-08-{10 + i % 5:02d}T00:00:00Z") for i in range(40)]
    path, columns = write_rows(spark, folder, "probes", rows,
                               "id string, verdict string, checked string")
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).json(path) \
        .withColumn("checked", F.col("checked").cast("timestamp"))
    drain(jobs.verdict_stream(stream, folder, os.path.join(folder, "ck")))
    at = "2026-08-14 12:00:00"
    found = {tuple(r) for r in jobs.read_verdicts(spark, folder, at).collect()}
    batch = spark.createDataFrame(rows, columns) \
        .withColumn("checked", F.col("checked").cast("timestamp"))
    assert found == {tuple(r) for r in verdicts.current(verdicts.fold(batch), at).collect()}
    late = {r["id"]: r["verdict"] for r in
            jobs.read_verdicts(spark, folder, "2027-01-01 00:00:00").collect()}
    assert set(late.values()) <= {"dead", "unknown"}    # live has run out, dead never does


def test_distinct_actions_and_postings(spark, folder):
    rows = [(f"a{i % 5}", f"p{i % 3}", f"2026-08-14T00:0{i % 10}:00Z") for i in range(10)]
    path, columns = write_rows(spark, folder, "acts", rows,
                               "action_id string, id string, at string", 1)
    stream = spark.readStream.schema(columns).json(path) \
        .withColumn("at", F.col("at").cast("timestamp"))
    assert memory(jobs.distinct_actions(stream, "at"), "acts", "append").count() == 5
    assert memory(jobs.distinct_postings(stream, "at"), "posts", "append").count() == 3


def test_daily_decisions(spark, folder):
    rows = [("x", f"2026-08-1{i % 3}T01:00:00Z") for i in range(9)]
    path, columns = write_rows(spark, folder, "log", rows, "type string, at string", 1)
    stream = spark.readStream.schema(columns).json(path) \
        .withColumn("at", F.col("at").cast("timestamp"))
    found = memory(jobs.daily_decisions(stream, "at"), "days", "complete")
    assert sorted(r["decisions"] for r in found.collect()) == [3, 3, 3]


def plain_limiter(hits, limit, window):
    kept, recent = set(), {}
    for key, at, order in sorted(hits, key=lambda h: (h[1], h[2])):
        times = recent.setdefault(key, deque())
        while times and at - times[0] > window:
            times.popleft()
        if len(times) < limit:
            times.append(at)
            kept.add(order)
    return kept


def random_hits():
    rng = random.Random(3)
    at, hits = 0.0, []
    for i in range(600):
        at += rng.choice([1, 5, 20, 90, 4000]) * rng.random()
        hits.append(("hot" if rng.random() < .7 else rng.choice("ab"), round(at, 3), i))
    return hits


def test_limiter_equals_a_plain_walk(spark):
    hits = random_hits()
    frame = spark.createDataFrame(hits, "key string, at double, ord int").repartition(4)
    for limit in (1, 3):
        found = {r["ord"] for r in limiter.admitted(frame, limit, 60.0).collect()}
        assert found == plain_limiter(hits, limit, 60.0)


def tied_hits():
    rng = random.Random(4)
    return [(rng.choice("ab"), float(rng.choice([0, 30, 60, 61, 200]) + 400 * rng.randrange(6)), i)
            for i in range(400)]


@pytest.mark.parametrize("limit", [1, 3, 30])
def test_limiter_with_equal_times(spark, folder, limit):
    hits = tied_hits()
    want = plain_limiter(hits, limit, 60.0)
    for parts in (1, 5):
        frame = spark.createDataFrame(hits, "key string, at double, ord int").repartition(parts)
        assert {r["ord"] for r in limiter.admitted(frame, limit, 60.0).collect()} == want
    path, columns = write_rows(spark, folder, "ties", hits, "key string, at double, ord int", 1)
    stream = spark.readStream.schema(columns).json(path)
    found = memory(jobs.limit_stream(stream, limit, 60.0), f"ties{limit}", "append")
    assert {r["ord"] for r in found.collect()} == want


def test_limiter_stream(spark, folder):
    hits = random_hits()
    path, columns = write_rows(spark, folder, "hits", hits, "key string, at double, ord int",
                               1)
    stream = spark.readStream.schema(columns).json(path)
    found = memory(jobs.limit_stream(stream, 3, 60.0), "hits", "append")
    assert {r["ord"] for r in found.collect()} == plain_limiter(hits, 3, 60.0)


def test_verdict_state_equals_its_batch_twin(spark, folder):
    """State after a drain in three runs: dead for good, live for three days, unknown never."""
    rng = random.Random(6)
    start = 1_767_225_600_000                              # 2026-01-01
    probes = [(f"j{rng.randrange(12)}", rng.choice(["live", "live", "unknown", "dead"])
               if rng.random() < .3 else rng.choice(["live", "unknown"]),
               start + i * 7_200_000) for i in range(90)]
    columns = "id string, verdict string, at bigint"
    path = os.path.join(folder, "probes")
    kept = 0
    for part in range(3):
        rows = probes[30 * part:30 * part + 30]
        spark.createDataFrame(rows, columns).withColumn("checked", F.timestamp_millis("at")) \
            .coalesce(1).write.parquet(f"{path}/part={part}")
        stream = spark.readStream.schema("id string, verdict string, at bigint, checked timestamp") \
            .parquet(f"{path}/part=*")
        verdict_state.run(stream, os.path.join(folder, "out"), os.path.join(folder, "ck"))
        now, want = probes[30 * part + 29][2] - 600_000, {}
        for ident, verdict, at in probes[:30 * part + 30]:
            if verdict == "dead":
                want[ident] = ("dead", None)
            elif verdict == "live" and want.get(ident, ("", None))[0] != "dead":
                want[ident] = ("live", at)
        want = {k: v for k, v in want.items() if v[0] == "dead" or v[1] + 3 * 86_400_000 > now}
        found = {r["id"]: (r["verdict"], r["live_ms"]) for r in
                 verdict_state.stored(spark, os.path.join(folder, "ck")).collect()}
        assert found == want
        kept = max(kept, len(found))
    changes = spark.read.schema(verdict_state.CHANGES).json(os.path.join(folder, "out"))
    assert {r["verdict"] for r in changes.select("verdict").distinct().collect()} \
        >= {"live", "dead"} and kept <= 12


def test_streams_compact_their_tables(spark, folder):
    path = os.path.join(folder, "rows")
    for i in range(4):
        spark.createDataFrame([(f"{i}", f"t{i}", i), ("same", f"t{i}", i)],
                              "id string, title string, ord bigint") \
            .coalesce(1).write.json(f"{path}/part={i}")
    stream = spark.readStream.schema("id string, title string, ord bigint") \
        .option("maxFilesPerTrigger", 1).json(f"{path}/part=*")
    drain(jobs.upsert_stream(stream, folder, os.path.join(folder, "ck"), compact_after=2))
    store = jobs.posting_store(spark, folder)
    assert {r["id"] for r in store.read().collect()} == {"0", "1", "2", "3", "same"}
    assert store.read().count() == 5 and len(store.manifest()["deltas"]) < 2


def test_verdict_of_an_id_needs_few_calls_to_its_state():
    """Plain rows go in, a later live verdict moves no timer, unknown ones don't read the state."""
    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def exists(self):
            return self.get() is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), []

        def getValueState(self, *_):
            return self.held

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def __init__(self, watermark, expiry=None):
            self.watermark, self.expiry = watermark, expiry

        def getCurrentWatermarkInMs(self):
            return self.watermark

        def getExpiryTimeInMs(self):
            return self.expiry

    def told(rows):
        return [(r.verdict, r.at_ms) for r in rows]

    day, handle, state = 86_400_000, Handle(), verdict_state.VerdictState()
    state.init(handle)

    def put(watermark, *seen):
        return told(state.handleInputRows(("j",), iter([Row(verdict=v, at_ms=at)
                                                        for v, at in seen]), Times(watermark)))

    def fire(at, watermark):
        return told(state.handleExpiredTimer(("j",), Times(watermark), Times(watermark, at)))
    assert put(0, ("unknown", 1)) == [] and handle.held.calls == 0
    assert put(0, ("live", 10), ("live", 5)) == [("live", 10)] and handle.timers == [3 * day + 10]
    assert put(20, ("live", day)) == [] and handle.timers == [3 * day + 10]
    assert fire(3 * day + 10, 3 * day + 20) == [] and handle.timers[1:] == [4 * day]
    assert fire(4 * day, 4 * day) == [("expired", 4 * day)] and handle.held.value is None
    assert put(5 * day, ("dead", 9), ("live", 6 * day), ("dead", 8)) == [("dead", 8)]
    assert fire(9 * day, 9 * day) == [] and handle.held.value == (True, None)
