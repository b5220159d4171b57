"""Streaming (ST, T-02, S-09) and file round-trip (S-01..03, S-07) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions.clock import format_clock
from flightline.plans.inputs import DAY, DET, MARKS, detections, marks, r, table
from flightline.plans.registry import query
from flightline.runtime import workspace
from flightline.sources import answerkeys, scans, tables
from flightline.streaming import jobs

def _secs(c: str):
    return (F.unix_micros(c) / F.lit(1e6)).alias(c)


def event_table(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st01_session_events", """WITH l AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts>=p+INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l),
g AS (SELECT user_id, min(ts) AS a, max(ts)+INTERVAL 6 HOUR AS b, count(*) AS n, max(value) AS peak FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a)/1e6 AS start, epoch_us(b)/1e6 AS stop, n, peak FROM g""")
def st01(spark, sf):
    """The whole table as one frame, so that the last sessions are closed too; tests hold the streaming run against it."""
    out = jobs.session_events(event_table(spark, sf), "user_id", "6 hours", "1 day")
    return out.select("user_id", _secs("start"), _secs("stop"), "n", "peak")


@query("st02_window_counts", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts)-o*INTERVAL 3 HOUR AS start FROM events, (SELECT unnest([0, 1]) AS o))
SELECT event_type, epoch_us(start)/1e6 AS start, epoch_us(start+INTERVAL 6 HOUR)/1e6 AS stop, count(*) AS n FROM w GROUP BY ALL""")
def st02(spark, sf):
    """As st01: every window of the table."""
    out = jobs.window_counts(event_table(spark, sf), "event_type", "6 hours", "3 hours", "1 day")
    return out.select("event_type", _secs("start"), _secs("stop"), "n")


@query("st03_first_per_key", "SELECT DISTINCT user_id, event_type FROM events")
def st03(spark, sf):
    out = jobs.run_to_table(jobs.first_per_key(jobs.read_events(spark, sf), ["user_id", "event_type"], "40 days"), "firsts")
    return out.select("user_id", "event_type")


def sightings(e: DataFrame) -> DataFrame:
    """Events as sightings; an hour is a frame."""
    return e.select(F.col("user_id").alias("video"), F.col("event_id").alias("seq"), "ts", F.floor(F.unix_micros("ts") / 3.6e9).alias("frame"),
                    ((F.col("event_id") * 37) % 500).cast("double").alias("x"), F.col("value").alias("y"), ((F.col("event_id") % 100) / 100.0).alias("conf"))


@query("t02_streaming_tracks")
def t02(spark, sf):
    """The stateful streaming tracker over the whole table, its last frames flushed at the end of the input; an hour is a frame."""
    from flightline.plans.track_queries import FAST, RADIUS
    return jobs.run_tracks(sightings(jobs.read_events(spark, sf)), RADIUS, "2 hours", FAST, 3_600_000)


@query("s09_guarded_scan", "SELECT event_id, user_id, value FROM events WHERE value>=5")
def s09(spark, sf):
    base = workspace(spark, "scans")
    stream = jobs.read_events(spark, sf).filter("value >= 5").select("event_id", "user_id", "value")
    config = {"floor": 5, "source": sf}
    jobs.guarded_scan(stream, base, config)
    return jobs.guarded_scan(stream, base, config)  # nothing new to read: the second run adds no rows


@query("s01_scan_round_trip", f"""WITH {DET} SELECT video::VARCHAR AS video, site, frame, round(t, 2) AS t, round(x, 1) AS x, round(y, 1) AS y, round(conf, 3) AS conf, round(w, 1) AS w FROM det""")
def s01(spark, sf):
    path = workspace(spark, "scan-files")
    scans.write_scans(detections(spark, sf), path, DAY)
    return scans.read_scans(spark, path)


def key_lines(spark, sf) -> DataFrame:
    """Every user's purchases of a day as an answer key, errors as moments that are no shots."""
    m = marks(spark, sf).withColumn("day", F.floor(F.col("mt") / DAY))
    shot = F.struct(F.col("mt").alias("t"), format_clock(F.col("mt") % DAY).alias("at"), F.when(F.col("mhoop") == 0, "left").when(F.col("mhoop") == 1, "right").alias("hoop"), "outcome")
    d = detections(spark, sf).filter("site = 'error'").withColumn("day", F.floor(F.col("t") / DAY))
    bad = d.groupBy("video", "day").agg(F.collect_list(F.struct("t", F.lit("carried").alias("what"))).alias("not_shots"))
    shots = m.groupBy("video", "day").agg(F.collect_list(shot).alias("shots"))
    return shots.join(bad, ["video", "day"], "full").select(F.col("video").cast("string").alias("video"), F.array(F.col("day") * DAY, (F.col("day") + 1) * DAY).alias("covers"),
                                                            "shots", "not_shots")


@query("s02_answer_keys", f"""WITH {DET}, {MARKS}, b AS (SELECT video, floor(mt/86400)::BIGINT AS day FROM marks UNION SELECT video, floor(t/86400)::BIGINT FROM det WHERE site='error'),
m AS (SELECT video, count(*) AS marks, count(*) FILTER (outcome='make') AS makes, count(mhoop) AS sited FROM marks GROUP BY video), n AS (SELECT video, count(*) AS non_marks FROM det WHERE site='error' GROUP BY video),
c AS (SELECT video, count(*)*86400.0::DOUBLE AS covered_s FROM b GROUP BY video)
SELECT c.video::VARCHAR AS video, coalesce(marks, 0) AS marks, coalesce(makes, 0) AS makes, coalesce(sited, 0) AS sited, coalesce(non_marks, 0) AS non_marks, covered_s FROM c LEFT JOIN m USING (video) LEFT JOIN n USING (video)""")
def s02(spark, sf):
    path = workspace(spark, "keys")
    key_lines(spark, sf).write.json(path)
    m, n, c = answerkeys.read_keys(spark, path, multi_line=False)
    a = m.groupBy("video").agg(F.count("*").alias("marks"), F.count_if(F.col("outcome") == "make").alias("makes"), F.count("hoop").alias("sited"))
    b = n.groupBy("video").agg(F.count("*").alias("non_marks"))
    cov = c.groupBy("video").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered_s"))
    return cov.join(a, "video", "left").join(b, "video", "left").na.fill(0)


@query("s03_commented_csv", """SELECT doc_id%3000*1.0::DOUBLE AS t, CASE WHEN doc_id%2=0 THEN 'left' ELSE 'right' END AS hoop, CASE WHEN quality=1 THEN 'make' ELSE 'miss' END AS outcome FROM labels""")
def s03(spark, sf):
    path = workspace(spark, "csv")
    t = F.col("doc_id") % 3000
    rows = table(spark, sf, "labels").select(
        format_clock(t).alias("time"), F.lit("IMG").alias("video"), F.when(F.col("doc_id") % 2 == 0, "left").otherwise("right").alias("hoop"),
        F.when(F.col("quality") == 1, "make").otherwise("miss").alias("outcome"), F.lit("hand").alias("source"), F.lit("").alias("notes"))
    rows.write.option("header", True).csv(path)
    rows.select(F.concat(F.lit("# taken back: "), "time").alias("value")).write.mode("append").text(path)
    got = tables.read_labels(spark, path, tables.CALLED)
    return got.select("t", "hoop", "outcome")


@query("s07_replace_partition", """SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_type='click' THEN value*2 ELSE value END), 4) AS total FROM events GROUP BY event_type""")
def s07(spark, sf):
    path = workspace(spark, "parts")
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    tables.replace_partitions(e, path, ["event_type"])
    tables.replace_partitions(e.filter("event_type = 'click'").withColumn("value", F.col("value") * 2), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


