import random
import re

from pyspark.sql import Window, functions as F

from pageloom.functions.items import normalise_values
from pageloom.operators import items, jobs
from pageloom.operators.ranking import first_k_per_key, number_rows
from pageloom.sources import sinks

META = "select 'j' as job_id, 'https://e.com' as url, 'p' as selector, 'llm_selector' as method union all select 'none', 'https://n.com', null, 'text_only'"


def shaped(spark, pairs):
    out = []
    for text, fields in pairs:
        df = spark.createDataFrame([(text,)], "item string")
        out.append(list(df.select(normalise_values(F.col("item"), fields)).first()[0]))
    return out


def test_fixture_items(spark):
    assert shaped(spark, [
        ("name: Ann\nurl: /a", ["name", "url"]), ("Ann | 7", ["name", "size", "city"]), ("name: A\nname: B", ["name", "other"]),
        ("price: 5\nBook", ["title", "book_price"]), ("a | b: c", ["value"]), ("", ["a", "b"]), ("x|y|z|w", ["a", "b"]),
    ]) == [["Ann", "/a"], ["Ann", "7", ""], ["A", "name: B"], ["Book", "5"], ["a | b: c"], ["", ""], ["x", "y"]]


def brute(text, fields):
    """The rule in plain words: keyed parts claim their field once, the rest fill the gaps."""
    claimed, loose = {}, []
    for part in (p.strip() for p in re.split(r"[\n|]", text)):
        hit = re.fullmatch(r"([\w][\w-]*):\s+(.+)", part)
        name = None
        if hit:
            key = hit[1].lower()
            name = next((f for f in fields if key in f.lower() or f.lower() in key), None)
        if name and name not in claimed:
            claimed[name] = hit[2]
        elif part:
            loose.append(part)
    gaps = iter(loose)
    return [claimed[f] if f in claimed else next(gaps, "") for f in fields]


def test_shaping_equals_brute_force(spark):
    rng = random.Random(3)
    bits = ["name", "Price", "size", "é", "7", ":", ": ", "\n", "|", " ", "-", "book_price"]
    fields = ["Name", "book_price", "size", "e"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, item string")
    got = [list(r[0]) for r in df.orderBy("i").select(normalise_values(F.col("item"), fields)).collect()]
    assert got == [brute(t, fields) for t in texts]


def test_rank_helpers_equal_plain_windows(spark):
    # one key holds most rows
    df = spark.range(5000).selectExpr("if(id % 10 < 7, 'hot', concat('k', id % 10)) as k", "(id * 7919) % 5003 as seq", "id % 3 as tie")
    w = Window.partitionBy("k").orderBy("seq", "tie")
    plain = df.withColumn("n", F.row_number().over(w))
    numbered = number_rows(df, ["k"], "seq", ["tie"], name="n")
    assert sorted(numbered.select("k", "seq", "tie", "n").collect()) == sorted(plain.collect())
    # sparse, constant and null orders and keys
    odd = df.selectExpr("if(k = 'k8', null, k) as k", "case k when 'hot' then null when 'k7' then 1 else seq * 1000003 end as seq", "seq as tie")
    by_tie = Window.partitionBy("k").orderBy("seq", "tie")
    key = lambda r: tuple(-1 if v is None else v for v in (r.n, r.tie))
    assert sorted(number_rows(odd, ["k"], "seq", ["tie"], name="n").collect(), key=key) == sorted(odd.withColumn("n", F.row_number().over(by_tie)).collect(), key=key)
    caps = F.when(F.col("k") == "hot", 40).otherwise(3)
    kept = first_k_per_key(df, ["k"], ["seq", "tie"], caps, salts=8, rank="n")
    assert sorted(kept.select("k", "seq", "tie", "n").collect()) == sorted(plain.where(F.col("n") <= caps).collect())


def rows_of(spark, *texts, job="j"):
    return spark.createDataFrame([(job, i, 0, t) for i, t in enumerate(texts)], "job_id string, url_seq bigint, pos int, item string")


def test_dedup_and_saved(spark):
    found = rows_of(spark, "a" * 200 + "1", "b", "a" * 200 + "2", "b", "c")
    assert sorted((r.url_seq, r.item[-1]) for r in items.dedup_items(found).collect()) == [(0, "1"), (1, "b"), (2, "2"), (4, "c")]
    once = items.dedup_items(found)
    assert sorted(items.dedup_items(once).collect()) == sorted(once.collect())
    saved = rows_of(spark, "b")
    assert sorted(r.url_seq for r in items.new_items(found, saved).collect()) == [0, 2, 4]
    report = {r.url_seq: (r["items"], r.kept, r.skipped) for r in items.dedup_report(found).collect()}
    assert report[0] == (1, 1, 0) and report[3] == (1, 0, 1)


def document(lines, job="j"):
    return "\n".join(r.line for r in lines.where(F.col("job_id") == job).orderBy("line_no").collect())


def test_rendering(spark):
    import json
    found = rows_of(spark, "Book One", "Book Two", 'val|with|"pipes", and\nmore ' + "z" * 130)
    meta = items.result_metadata(found, spark.sql(META), "2026-01-01")
    records = items.records_wide(found, ["content"])
    data = json.loads(document(sinks.to_json_lines(records, ["content"], meta)))
    assert [d["content"] for d in data["data"]][:2] == ["Book One", "Book Two"]
    assert data["metadata"]["item_count"] == 3 and data["metadata"]["confidence"] == "high"
    assert json.loads(document(sinks.to_json_lines(records, ["content"], meta, False))).keys() == {"data"}
    assert json.loads(document(sinks.to_json_lines(records, ["content"], meta), "none"))["data"] == []
    import csv, io
    text = document(sinks.to_csv_lines(records, ["content"], meta, False))
    assert [r["content"] for r in csv.DictReader(io.StringIO(text))] == [r.item for r in found.orderBy("url_seq").collect()]
    assert document(sinks.to_csv_lines(records, ["content"], meta), "none") == ""
    md = document(sinks.to_markdown_lines(records, ["content"], meta)).split("\n")
    assert md[2:6] == ["| content |", "| --- |", "| Book One |", "| Book Two |"] and md[0].startswith("**Source:** https://e.com")
    assert "val\\|with" in document(sinks.to_markdown_lines(records, ["content"], meta))
    assert document(sinks.to_markdown_lines(records, ["content"], meta), "none") == "_No data extracted._"
    txt = document(sinks.to_text_lines(found, meta)).split("\n")
    assert txt[0] == "# Source: https://e.com" and txt[4:6] == ["1. Book One", "2. Book Two"]
    assert document(sinks.format_result(found, records, ["content"], meta, " MARKDOWN ")) == "\n".join(md)


def test_csv_edge_cells(spark):
    import csv, io
    values = ["", " lead", "trail ", 'q"q', "a,b", "a\nb", "é", "#", "\\", '"', "\\\"", "a\tb", "a\rb"]
    df = spark.createDataFrame([(i, v, v[::-1]) for i, v in enumerate(values)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(sinks.csv_row(["a", "b"])).collect()]
    want = []
    for v in values:
        buf = io.StringIO()
        csv.writer(buf, lineterminator="").writerow([v, v[::-1]])
        want.append(buf.getvalue())
    assert got == want
    assert df.where("i = 0").select(sinks.csv_row(["a"])).first()[0] == '""'


def test_write_lines(spark, tmp_path):
    lines = spark.createDataFrame([("a", i, f"line {i}") for i in range(50)] + [("b", 0, "x")], "job_id string, line_no bigint, line string")
    sinks.write_lines(lines, str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "job_id=a").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == [f"line {i}" for i in range(50)]


def test_placeholder_and_result(spark):
    found = rows_of(spark, *[f"i{n}" for n in range(8)])
    filled = items.with_placeholder(found, spark.sql(META))
    assert [r.item for r in filled.where("job_id = 'none'").collect()] == ["No data extracted."] and filled.count() == 9
    lines = sinks.to_text_lines(filled, items.result_metadata(found, spark.sql(META), "2026-01-01"))
    assert [r.line for r in lines.where("job_id = 'none' and line_no > 3").collect()] == ["No data extracted."]
    cache = spark.createDataFrame([("j", 2, "late"), ("j", 1, "first")], "job_id string, seq int, selector string")
    r = jobs.job_result(found, cache).first()
    assert (r.item_count, r.preview, r.selector, r.method) == (8, "i0\ni1\ni2\ni3\ni4", "first", "llm_selector")


def test_documents_are_written_whole(spark, tmp_path):
    import csv
    import io
    import json
    import os
    import pytest
    from pyspark.sql import functions as F
    from pageloom.operators import items
    from pageloom.sources import documents, sinks
    rows = [("a/b", i, 0, f'name {i} "x", \n é') for i in range(500)] + [("two", 0, 0, "only")]
    found = spark.createDataFrame(rows, "job_id string, url_seq bigint, pos int, name string")
    meta = spark.createDataFrame([("a/b", "u", "t", 500, "li", "llm_selector", "high"), ("two", "v", "t", 1, None, "text_only", "low"), ("none", "w", "t", 0, None, "text_only", "low")],
                                 "job_id string, url string, timestamp string, item_count bigint, selector string, method string, confidence string")

    def read(folder, job):
        parts = sorted(os.listdir(f"{folder}/job_id={job}"))
        return "".join(open(f"{folder}/job_id={job}/{p}").read() for p in parts), len([p for p in parts if not p.startswith(".")])

    out = str(tmp_path / "json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts, as of large tables
    documents.write_documents(sinks.to_json_lines(found, ["name"], meta).repartition(7), out, ".json")
    text, parts = read(out, "a%2Fb")
    got = json.loads(text)
    assert [x["name"] for x in got["data"]] == [r[3] for r in rows[:500]] and got["metadata"]["item_count"] == 500
    assert parts > 1 and json.loads(read(out, "none")[0])["data"] == []
    documents.write_documents(sinks.to_csv_lines(found, ["name"], meta, False), out, ".csv", overwrite=True)
    assert [r[0] for r in csv.reader(io.StringIO(read(out, "a%2Fb")[0], newline=""))] == ["name", *(r[3] for r in rows[:500])]
    assert sorted(os.listdir(out)) == ["_SUCCESS", "job_id=a%2Fb", "job_id=two"]

    # a task that fails leaves the folder as it was
    broken = spark.range(100).select(F.lit("bad").alias("job_id"), F.col("id").alias("line_no"),
                                     F.expr("if(id = 77, raise_error('stop'), 'x')").alias("line"))
    before = {job: read(out, job) for job in ("a%2Fb", "two")}
    with pytest.raises(Exception, match="stop"):
        documents.write_documents(broken, out)
    assert sorted(os.listdir(out)) == ["_SUCCESS", "job_id=a%2Fb", "job_id=two"]
    assert {job: read(out, job) for job in before} == before
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
