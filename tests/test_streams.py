from pyspark.sql import functions as F, types as T

from pageloom.operators.html import parse_pages
from pageloom.operators.links import extract_links
from pageloom.streaming import streams


def test_links_continue_after_checkpoint(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.test/{i}", f'<a href="/{i % 4}">l{i}</a><a href="/x">x</a>') for i in range(20)]
    pages = spark.createDataFrame(rows, streams.PAGES)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pages.where("page_id < 12").repartition(3).write.parquet(source)
    streams.drain(streams.stream_links(streams.stream_pages(spark, source, files_per_batch=1)), out, state)
    assert spark.read.parquet(out).select("page_id").distinct().count() == 12
    pages.where("page_id >= 12").write.mode("append").parquet(source)
    streams.drain(streams.stream_links(streams.stream_pages(spark, source, files_per_batch=1)), out, state)
    want = extract_links(parse_pages(pages))
    assert sorted(spark.read.parquet(out).select(*want.columns).collect()) == sorted(want.collect())


def test_dedup_over_batches(spark, tmp_path):
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("item", T.StringType()), T.StructField("at", T.TimestampType())])
    items = spark.range(60).select(F.concat(F.lit("j"), (F.col("id") % 2).cast("string")).alias("job_id"),
                                   F.concat(F.lit("i"), (F.col("id") % 10).cast("string")).alias("item"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("at"))
    items.repartition(4).write.parquet(str(tmp_path / "in"))
    for name, event_time in (("plain", None), ("timed", "at")):
        source = streams.stream_pages(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        streams.drain(streams.stream_dedup(source, event_time), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        assert spark.read.parquet(str(tmp_path / name)).select("job_id", "item").count() == 10


def test_state_over_batches(spark, tmp_path):
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("state", T.StringType()), T.StructField("seq", T.LongType())])
    rows = [("j", f"u{i % 5}", "failed" if i % 3 else "processed", i) for i in range(40)]
    log = spark.createDataFrame(rows, schema)
    log.repartition(5).write.parquet(str(tmp_path / "in"))
    source = streams.stream_pages(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    streams.drain(streams.stream_job_state(source), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("job_id", "url").agg(F.max_by("state", "batch_id").alias("state"))
    want = log.groupBy("job_id", "url").agg(F.max_by("state", "seq").alias("state"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_tables_of_one_file_and_of_many(spark, tmp_path):
    """The stream queries over a folder whose tables are single files, and one whose tables are folders of files."""
    import os
    import pyarrow.parquet as pq
    from pageloom.plans.catalog import QUERIES
    pages = spark.createDataFrame([(i, f"https://h{i % 3}.test/{i}", f'<nav><a href="/{i}">l{i}</a></nav>') for i in range(20)], streams.PAGES)
    docs = spark.range(60).selectExpr("id as doc_id", "concat('text ', id % 7) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    events = spark.range(60).selectExpr("id as event_id", "id % 5 as user_id", "if(id % 3 = 0, 'a', 'b') as event_type", "double(id * 7 % 100) as value")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    os.makedirs(one)
    for name, df in (("pages", pages), ("documents", docs), ("events", events)):
        df.repartition(3).write.parquet(f"{many}/{name}.parquet")
        pq.write_table(pq.read_table(f"{many}/{name}.parquet"), f"{one}/{name}.parquet")
    for name, n in (("stream_links", 20), ("stream_items", 20), ("stream_dedup", 14), ("stream_job_state", 10)):
        got = [sorted(QUERIES[name](spark, folder).collect()) for folder in (one, many)]
        assert got[0] == got[1] and len(got[0]) == n, name


def _events(spark, rows):
    return spark.createDataFrame(rows, "job_id string, url string, event string")


def test_job_machine_over_batches_and_a_restart(spark, tmp_path):
    """Equal to mark_urls and job_status over the whole table, in any order of events."""
    import random
    from pageloom.operators import jobs
    from pageloom.streaming import job_state
    pick = random.Random(5)
    queued = [(f"j{i % 3}", f"u{i}", "queued") for i in range(40)] + [("closed", "u", "queued"), ("partial", "u", "queued")]
    told = [(j, u, pick.choice(["done", "failed"])) for j, u, _ in queued[:40] for _ in range(pick.randrange(3))]
    told += [("closed", "u", "done"), ("partial", "u", "failed"), ("closed", "never listed", "done"), ("partial", "u", "failed")]
    rows = queued + queued[:9] + told + [(None, "u", "done"), ("closed", None, "failed"), ("closed", "u", None), ("closed", "u", "odd")]
    pick.shuffle(rows)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:30], rows[30:60], rows[60:]):
        _events(spark, part).repartition(2).write.mode("append").parquet(source)
        stream = streams.stream_pages(spark, source, _events(spark, []).schema, files_per_batch=1)
        streams.drain(job_state.stream_job_changes(stream, shards=3), out, state)
    changes = spark.read.parquet(out)
    pending = spark.createDataFrame([(j, u, "pending") for j, u, _ in queued], "job_id string, url string, state string")
    outcomes = spark.createDataFrame(told, "job_id string, url string, outcome string")
    want = jobs.mark_urls(pending, outcomes)
    assert sorted(job_state.url_states(changes).collect()) == sorted(want.collect())
    assert sorted(job_state.job_states(changes).select("job_id", "status").collect()) == sorted(jobs.job_status(want).collect())
    marks = changes.where("url is not null").groupBy("job_id", "url", "state").count()
    assert marks.where("count > 1").count() == 0  # each mark once, also over the restart
    assert {r.status for r in job_state.job_states(changes).where("job_id in ('closed', 'partial')").collect()} == {"complete", "partial"}


def test_job_machine_forgets(spark, tmp_path):
    """Marks older than the time to live are gone, so a late outcome is told again."""
    import time
    from pageloom.streaming import job_state
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for ttl, event in ((1000, "queued"), (1000, "done"), (1000, "done")):
        _events(spark, [("j", "u", event)]).write.mode("append").parquet(source)
        stream = streams.stream_pages(spark, source, _events(spark, []).schema, files_per_batch=1)
        streams.drain(job_state.stream_job_changes(stream, shards=1, ttl_ms=ttl), out, state)
        time.sleep(1.5)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    changes = spark.read.parquet(out).where("url is not null")
    assert sorted(r.state for r in changes.collect()) == ["pending", "processed", "processed"]
    assert [r.state for r in job_state.url_states(changes).collect()] == ["processed"]
