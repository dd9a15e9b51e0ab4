"""What the physical plans must and must not contain."""

import os

import pytest
from pyspark.sql import functions as F

from pageloom.operators import clean, fetch, items, select
from pageloom.operators.html import parse_pages
from pageloom.operators.links import extract_links
from pageloom.plans.catalog import ORACLES, QUERIES
from pageloom.plans.derived import ATTEMPTS
from pageloom.sources.readers import read_pages

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def pages(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.test/{i}", f"<p>{i}<a href=/x>x</a>") for i in range(50)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages"))
    return read_pages(spark, str(tmp_path / "pages"))


def test_page_rules_do_not_shuffle(pages):
    parsed = parse_pages(pages)
    for df in (extract_links(parsed), clean.page_text(parsed), clean.main_text(parsed), clean.render_html(clean.clean_pages(parsed)),
               select.element_records(parsed, "p a"), select.select_xpath(parsed, "//a/@href")):
        text = plan(df)
        assert "Exchange" not in text and text.count("MapInArrow") == 1


def test_only_needed_columns_are_read(pages):
    text = plan(extract_links(parse_pages(pages.select("page_id", "url", "html").where("page_id > 10"))))
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,10)]" in text
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan(clean.page_text(parse_pages(pages.select("page_id", "html"))))


def test_bodies_stay_out_of_the_shuffle(spark, pages):
    pages.createOrReplaceTempView("pages")
    attempts = spark.sql(ATTEMPTS.replace("unnest(list_value(", "explode(array("))
    chosen = fetch.resolve_layer(attempts)
    shuffled = [line for line in plan(chosen).splitlines() if "Exchange" in line]
    assert shuffled and "html" not in " ".join(shuffled)


def test_repeats_are_combined_before_the_shuffle(spark):
    found = spark.range(10).selectExpr("'j' as job_id", "id as url_seq", "0 as pos", "'same' as item")
    text = plan(items.dedup_items(found))
    assert "partial_min_by" in text and "Window" not in text


@needs_data
def test_no_cross_joins(spark):
    for name, run in QUERIES.items():
        if name in ("crawl", "crawl_open") or name.startswith("stream_"):
            continue  # these run jobs of their own
        text = plan(run(spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@needs_data
def test_entry(spark):
    import __spark_entry__
    df = __spark_entry__.entry(spark)
    assert df.columns == ["host", "links", "distinct_links", "pages"] and df.where(F.col("links") < F.col("pages")).count() == 0
    assert df.count() > 0


def _html_is_shuffled(df):
    """Does a column of whole pages pass an exchange?"""
    plan = df._jdf.queryExecution().executedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange" not in line:
            continue
        below = []
        for other in lines[i + 1:]:
            if depth(other) <= depth(line):
                break
            below.append(other)
        if any("FileScan" in x and "html" in x for x in below):
            return True
    return False


def test_look_ups_come_to_a_page_store(spark):
    from pageloom.operators import extract, select
    from pageloom.sources import page_store
    name = "stored_pages_of_the_test"
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    page_store.write_page_store(pages, name, mode="overwrite")
    try:
        store = page_store.read_page_store(spark, name)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large look-ups
        wanted = pages.select("page_id", F.lit("article > h1").alias("selector"))
        targets = pages.select("page_id", F.lit("names").alias("content_target"))
        for of, shuffled in ((pages, True), (store, False)):
            found = select.apply_selectors(of, wanted)
            assert _html_is_shuffled(found) == shuffled
            assert _html_is_shuffled(extract.with_choices(of, targets, wanted)) == shuffled
        columns = ["page_id", "pos", "item"]
        assert sorted(select.apply_selectors(store, wanted).select(*columns).collect()) == sorted(
            select.apply_selectors(pages, wanted).select(*columns).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table if exists {name}")


def test_formats_share_one_numbering(spark, tmp_path, monkeypatch):
    """Each format alone and all at once give the same lines; all at once number and shape the items once."""
    from pageloom.plans import item_queries
    from pageloom.sources import sinks
    rows = {"customer": [(i, f"c {i}", ["A", None][i % 2], i) for i in range(9)], "part": [(i, f"p|{i}", None, i) for i in range(5)],
            "region": [(i, f"R{i}") for i in range(5)], "documents": [(i // 2, [None, "", "name: x\nurl: y", "a, b"][i % 4], "s") for i in range(12)]}
    kinds = {"customer": "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey bigint",
             "part": "p_partkey bigint, p_name string, p_brand string, p_size bigint", "region": "r_regionkey bigint, r_name string",
             "documents": "doc_id bigint, text string, source string"}
    for name, kind in kinds.items():
        spark.createDataFrame(rows[name], kind).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    calls, number, shape = [], sinks.number_rows, items.records_wide
    monkeypatch.setattr(sinks, "number_rows", lambda *a, **k: (calls.append("number"), number(*a, **k))[1])
    monkeypatch.setattr(items, "records_wide", lambda *a, **k: (calls.append("shape"), shape(*a, **k))[1])
    got = QUERIES["format_result_each"](spark, str(tmp_path))
    assert sorted(calls) == ["number", "shape"]
    got = got.collect()
    for fmt, name in item_queries._FORMATS.items():
        key = lambda r: tuple((x is not None, x) for x in r)
        count = lambda found: sorted(((r.job_id, r.line_no) for r in found), key=key)
        alone = QUERIES[name](spark, str(tmp_path)).collect()
        mine = [r for r in got if r.fmt == fmt]
        assert count(mine) == count(alone)
        # two documents of one id may come in either order
        of = lambda found: sorted(((r.job_id, r.line_no, r.line) for r in found if r.job_id != "texts"), key=key)
        assert of(mine) == of(alone)
