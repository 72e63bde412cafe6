import pytest

from lensaudit.sources import crawl, datasource, fetch

PLAN = "site_id string, url string, pos int, lens string, user_agent string"


@pytest.fixture
def folders(spark, tmp_path):
    spark.dataSource.register(datasource.CrawlSource)
    web = [(f"http://h{h}.net/{i}", 403 if i == 2 else 200, {"X": "y"}, f"body {h} {i}") for h in range(5) for i in range(3)] + [("http://h0.net/r", 301, {"Location": "/1"}, "")]
    spark.createDataFrame(web, "url string, status int, headers map<string,string>, body string").write.parquet(f"{tmp_path}/web")
    rows = [(f"s{h}", f"http://h{h}.net/{i}", i, lens, "ua") for h in range(5) for i in range(3) for lens in ("browser", "GPTBot")] + [("s0", "http://h0.net/r", 3, "browser", "ua"), ("s9", "http://none.net/", 0, "browser", "ua")]
    return f"{tmp_path}/web", f"{tmp_path}/plan", rows, {u: (s, h, b.encode()) for u, s, h, b in web}


def told(df):
    return sorted((r.site_id, r.url, r.pos, r.lens, r.final_url, r.status, tuple(r.headers.items()), r.body, r.error, r.blocked_by, len(r.redirect_chain)) for r in df.collect())


def test_equals_a_fetch_of_the_plan(spark, folders):
    web, plan, rows, answers = folders
    df = spark.createDataFrame(rows, PLAN)
    df.repartition(3).write.parquet(plan)
    got = spark.read.format("lensaudit").options(plan=plan, transport="recorded", answers=web, partitions="3", delay="0").load()
    want = fetch.fetch(df, lambda url, headers: answers.get(url, (404, {}, b"")), lambda host: ["93.184.216.34"], fetch.Limits(delay=0.0))
    assert told(crawl.classify(got)) == told(want) and len(told(got)) == len(rows)
    assert spark.read.format("lensaudit").options(plan=f"{plan}-none", transport="recorded", answers=web).load().count() == 0
    with pytest.raises(Exception, match="option plan"):
        spark.read.format("lensaudit").load().count()


def test_a_stream_goes_on_at_its_offset(spark, folders, tmp_path):
    web, plan, rows, _ = folders
    seen = []
    for part in (rows[:10], [], rows[10:]):
        if part:
            spark.createDataFrame(part, PLAN).coalesce(1).write.mode("append").parquet(plan)
        stream = spark.readStream.format("lensaudit").options(plan=plan, transport="recorded", answers=web, partitions="2", delay="0").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.schema(crawl.FETCHES).parquet(f"{tmp_path}/out").count())
    assert seen == [10, 10, len(rows)]
