import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from amalgam.operators import timeline
from amalgam.streaming.lives import lives

BASE = dt.datetime(2024, 1, 1)
EVENT = "user_id long, ts timestamp, event_id long, event_type string, value double"
KINDS = ["a", "b"]


def minutes(n):
    return BASE + dt.timedelta(minutes=n)


def events(seed, n, users=4, span=6000):
    rnd = random.Random(seed)
    return [(rnd.randrange(users), minutes(rnd.randrange(span)), i, rnd.choice("abc"), rnd.choice([None, float(rnd.randrange(50))])) for i in range(n)]


def plain_sessions(rows, gap=60):
    out = []
    for user in {r[0] for r in rows if r[0] is not None}:
        own = sorted(r for r in rows if r[0] == user and r[1] is not None)
        groups = []
        for r in own:
            if groups and (r[1] - groups[-1][-1][1]).total_seconds() <= gap * 60:
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            last = {r[3]: r[4] for r in sorted(g, key=lambda r: r[1:3]) if r[4] is not None}
            out.append((user, g[0][1], g[-1][1], len(g), *(last.get(k) for k in KINDS)))
    return sorted(map(repr, out))


def spans(df):
    return sorted(repr(tuple(r)) for r in df.select("user_id", "started", "ended", "n", *KINDS).collect())


def test_sessions_of_a_table(spark):
    """Rows over midnight, exactly the gap apart, of one time, without key or time; names that clash."""
    rows = events(1, 500) + [(9, minutes(1380 + 60 * i), 1000 + i, "a", float(i)) for i in range(30)] + [(9, minutes(4000), 2000, "b", 1.0), (9, minutes(4000), 2001, "b", 2.0), (9, minutes(4061), 2002, "b", 3.0), (None, minutes(1), 3000, "a", 1.0), (9, None, 3001, "a", 1.0)]
    table = spark.createDataFrame([(*r, 1) for r in rows], EVENT + ", n int").repartition(5)
    assert spans(timeline.sessions(table, "user_id", "ts", "60 minutes", "event_type", KINDS, "event_id", "value")) == plain_sessions(rows)
    assert timeline.sessions(table.limit(0), "user_id", "ts", "60 minutes", "event_type", KINDS, "event_id", "value").collect() == []


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(f"{folder}/{i:03d}")


def run(spark, stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


@pytest.fixture
def disk_state(spark):
    """The state store that keyed state needs, and few partitions of it."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


@pytest.mark.parametrize("kind", ["state", "window"])
def test_streams_equal_the_table(spark, tmp_path, disk_state, kind):
    """Micro-batches with late and repeated rows, and a restart from the checkpoint between them."""
    rows = sorted(events(2, 240, users=3, span=5000), key=lambda r: r[1])
    rnd = random.Random(3)
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.randrange(100)))  # each at most 100 minutes late
    batches = [late[i : i + 60] for i in range(0, 240, 60)]
    for b in batches:
        b += rnd.sample(b, 10)  # delivered twice
    sentinel = [[(99, minutes(20_000), 9000, "a", 1.0)], [(98, minutes(30_000), 9001, "a", 1.0)]]  # time goes on, so that all lives end
    place = [f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint")]

    def stream():
        read = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(f"{place[0]}/*")
        if kind == "state":
            return lives(read, "user_id", "ts", 3600, "3 hours", "event_type", KINDS, "event_id", "value")
        once = read.withWatermark("ts", "3 hours").dropDuplicatesWithinWatermark(["user_id", "event_id"])
        return timeline.sessions(once, "user_id", "ts", "60 minutes", "event_type", KINDS, "event_id", "value")

    feed(spark, place[0], batches[:2])
    run(spark, stream(), *place[1:])
    for i, more in enumerate((batches[2:], sentinel)):
        feed(spark, f"{place[0]}/later{i}", [])
        for j, b in enumerate(more):
            spark.createDataFrame(b, EVENT).coalesce(1).write.json(f"{place[0]}/{100 * (i + 1) + j}")
        run(spark, stream(), *place[1:])
    got = [r for r in spans(spark.read.parquet(place[1])) if not r.startswith(("(99", "(98"))]
    want = plain_sessions(rows)
    assert got == want, (set(got) - set(want), set(want) - set(got))


def test_as_of(spark):
    rnd = random.Random(5)
    versions = [(rnd.randrange(5), minutes(rnd.randrange(9000) // 7 * 7), i, f"v{i}") for i in range(400)]
    versions += [(7, minutes(i), 1000 + i, f"w{i}") for i in range(3000)] + [(None, minutes(1), 5000, "x"), (3, None, 5001, "y")]
    lookups = [(rnd.randrange(9), minutes(rnd.randrange(12_000)), i) for i in range(400)] + [(None, minutes(5), 900), (3, None, 901), (7, minutes(50_000), 902), (7, minutes(-5), 903), (3, minutes(70), 904), (3, minutes(70), 904)]
    v = spark.createDataFrame(versions, "user_id long, ts timestamp, version_id long, said string")
    asked = spark.createDataFrame(lookups, "user_id long, ts timestamp, id long")
    got = [(r.user_id, r.ts, r.id, r.version and r.version.version_id) for r in timeline.as_of(asked, v, "user_id", "ts", "version_id").collect()]

    def holds(user, ts):
        own = [x for x in versions if user is not None and ts is not None and x[0] == user and x[1] is not None and x[1] <= ts]
        return max(own, key=lambda x: x[1:3])[2] if own else None

    assert sorted(map(repr, got)) == sorted(repr((*x, holds(x[0], x[1]))) for x in lookups)
    assert timeline.as_of(asked, v.limit(0), "user_id", "ts", "version_id").filter("version is not null").isEmpty()
    # a hot user's versions are as many groups as they have days
    sizes = v.groupBy("user_id", F.date_trunc("day", "ts")).count().agg(F.max("count")).first()[0]
    assert sizes <= 1440
    held = {(r.user_id, r.ts): (r.version_id, r.valid_to) for r in timeline.validity(v, "user_id", "ts", "version_id").collect()}
    for user, ts, _, _ in versions:
        if user is not None and ts is not None:
            after = [x[1] for x in versions if x[0] == user and x[1] and x[1] > ts]
            assert held[(user, ts)] == (holds(user, ts), min(after, default=None))


def test_intervals(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(6), s, s + rnd.randrange(-2, 30), i) for i in range(300) for s in [rnd.randrange(400)]] + [(8, None, 4, 900), (8, 4, None, 901), (8, 5, 5, 902), (8, 5, 5, 903), (8, 6, 9, 904)]
    table = spark.createDataFrame(rows, "who long, first long, last long, id long")
    known = [r for r in rows if r[1] is not None and r[2] is not None and r[1] <= r[2]]
    got = {(r.who, m) for r in timeline.merged_intervals(table, "who", "first", "last").collect() for m in range(r.first, r.last + 1)}
    assert got == {(r[0], m) for r in known for m in range(r[1], r[2] + 1)}
    merged = timeline.merged_intervals(table, "who", "first", "last").collect()
    assert sum(r.n for r in merged) == len(known)
    for a in merged:
        assert not any(a.who == b.who and a != b and a.first <= b.last and b.first <= a.last for b in merged)
    pairs = timeline.overlapping(table, table, "who", "first", "last", 12)
    want = sorted((a[3], b[3]) for a in known for b in known if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert sorted((r.a.id, r.b.id) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rolling_and_coverage(spark):
    rnd = random.Random(7)
    rows = [(s, d, rnd.choice([None, rnd.randrange(4)])) for s in "xyz" for d in range(90) if rnd.random() < 0.6]
    table = spark.createDataFrame(rows, "source string, day long, conflicts long")
    got = sorted(map(tuple, timeline.rolling(table, "source", "day", "conflicts", 7).collect()), key=repr)
    c = duckdb.connect()
    c.register("t", table.toPandas().astype({"conflicts": "Int64"}))
    want = c.sql("""SELECT source, day, conflicts, CAST(sum(conflicts) OVER s AS BIGINT), count(conflicts) OVER s, last_value(conflicts IGNORE NULLS) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      rank() OVER (PARTITION BY day ORDER BY conflicts DESC NULLS LAST), dense_rank() OVER (PARTITION BY day ORDER BY conflicts DESC NULLS LAST) FROM t WINDOW s AS (PARTITION BY source ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""").fetchall()
    assert got == sorted(want, key=repr)
    people = [(rnd.choice(["a", None]), rnd.choice("pq"), rnd.randrange(20)) for _ in range(100)]
    cube = timeline.coverage(spark.createDataFrame(people, "source string, badge string, id long"), ["source", "badge"], "id")
    told = {(r.source, r.badge, r.grouping): (r.n, r["keys"]) for r in cube.collect()}
    assert told[(None, None, 3)] == (100, len({p[2] for p in people}))
    assert told[(None, "p", 0)] == (sum(p[:2] == (None, "p") for p in people), len({p[2] for p in people if p[:2] == (None, "p")}))
    assert told[(None, "p", 2)] == (sum(p[1] == "p" for p in people), len({p[2] for p in people if p[1] == "p"}))
