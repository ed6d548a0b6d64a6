"""Tables that grow by batches: the log, its compaction, streams into it, capped runs; and listings read page by page."""

import os

import pytest
from pyspark.sql import functions as F

from tallywork.operators import flows
from tallywork.sources import parse as P
from tallywork.sources import sinks as S
from tallywork.sources.deltalog import DeltaLog
from tallywork.streaming import stream as ST

COLUMNS = "id string, source string, detail_url string, first_seen_at string, last_seen_at string, scraped_at string, scrape_run_id string, category string, ingest_seq int"


def posting(i, url, day, category=None, seq=0):
    return (i, "s", url, f"d{day}", f"d{day}", f"d{day}", f"r{day}", category, seq)


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(tuple(r[c] for c in ("id", "detail_url", "first_seen_at", "last_seen_at", "scrape_run_id", "category")) for r in df.collect())


def test_the_log_merges_as_the_upsert_does(spark, tmp_path):
    batches = [
        [posting("a", "u1", 1, "all"), posting("b", "u2", 1, "it"), posting("z", "u9", 1), posting("y", "u9", 1, "hr", 5)],
        [posting("x", "u1", 2, "it", 1), posting("x2", "u2", 2, "all", 2), posting("c", "u3", 2, None, 3), posting("d", "u3", 2, "all", 4)],
        [posting("e", "u1", 3, "hr"), posting("f", "u3", 3, None), posting("g", "u4", 3)],
        [posting("h", "u3", 4, "last"), posting("i", "u4", 4, "all")],
    ]
    log, old = ST.postings_log(spark, str(tmp_path / "t"), buckets=4), None
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, COLUMNS)
        old = df.drop("ingest_seq").limit(0) if old is None else old
        old = S.upsert_postings(old, df).drop("was_insert")
        assert log.append(df, n) and not log.append(df, n)
        assert rows_of(log.read()) == rows_of(old)
        if n in (1, 2):
            log.compact()
            assert rows_of(log.read()) == rows_of(old)


def test_a_batch_of_ten_rows_rewrites_nothing(spark, tmp_path):
    log = ST.postings_log(spark, str(tmp_path / "t"), buckets=16)
    log.append(spark.createDataFrame([posting(str(i), f"u{i}", 1) for i in range(2_000)], COLUMNS), 0)
    log.compact()
    before = files(tmp_path)
    log.append(spark.createDataFrame([posting("n", f"u{i}", 2) for i in range(10)], COLUMNS), 1)
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())
    new = [f for f in after if f not in before]
    assert sum(spark.read.parquet(f).count() for f in new) == 10
    touched = log.compact()
    assert 0 < len(touched) <= 10 and log.compact() == []
    base = [f for f in files(tmp_path) if f not in after]
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in base} == set(touched)  # only the buckets that the batch touched
    assert all(files(tmp_path)[f] == t for f, t in before.items())
    got = {r.detail_url: r.last_seen_at for r in log.read().collect()}
    assert len(got) == 2_000 and got["u3"] == "d2" and got["u11"] == "d1"


def test_lost_tries_and_wrong_batches(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path / "t"), ["k"], buckets=2)
    assert log.read() is None and log.compact() == [] and log.next_seq() == 0
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    df.write.parquet(str(tmp_path / "t" / "delta-000000000000-lost"))  # written, but it never came into the log
    assert log.append(df, 3) and [tuple(r) for r in log.read().collect()] == [("a", 1)]
    with pytest.raises(ValueError, match="after 2"):
        log.append(df, 2)
    with pytest.raises(Exception, match="whole key"):
        log.append(spark.createDataFrame([(None, 1)], "k string, v int"), 4)
    assert log.append(df.limit(0), 5) and log.read().count() == 1 and log.next_seq() == 6
    more = spark.createDataFrame([("b", 2, "w")], "k string, v int, extra string")
    log.append(more, 6)
    assert {(r.k, r.extra) for r in log.read().collect()} == {("a", None), ("b", "w")}


def test_a_stream_into_the_log(spark, tmp_path):
    src = str(tmp_path / "in")
    for day in (1, 2, 3):
        spark.createDataFrame([posting(f"i{day}", "u1", day, "all", day), posting("j", f"v{day}", day, None, day)], COLUMNS).coalesce(1).write.mode("append").parquet(src)
    df = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = df.writeStream.foreachBatch(ST.upsert_batches(str(tmp_path / "t"), compact_every=2, buckets=4)).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    log = ST.postings_log(spark, str(tmp_path / "t"), 4)
    assert log.next_seq() == 3 and {r.detail_url for r in log.read().collect()} == {"u1", "v1", "v2", "v3"}
    assert any("base-" in f for f in files(tmp_path / "t"))


def test_a_capped_run_goes_on_where_it_stopped(spark, tmp_path):
    pending = spark.range(47).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    ledger = flows.batch_ledger(spark, str(tmp_path / "l"))
    seen = []

    def work(batch):
        ids = sorted(r.id for r in batch.collect())
        seen.append(ids)
        if 20 in ids and len(seen) < 4:
            raise RuntimeError("the service is down")
        # some ids are not answered, one answer is for nobody
        return batch.where("id % 10 <> 9").select("id", F.lit("x").alias("domain")).unionByName(spark.createDataFrame([(999, "x")], "id long, domain string"))

    first = flows.drain(pending, ledger, work, size=10, max_batches=3)
    assert seen == [list(range(10)), list(range(10, 20)), list(range(20, 30))]
    assert first == {"total": 47, "batches": 3, "written": 18, "unanswered": 2, "failed": 10, "remaining": 29}
    second = flows.drain(pending, ledger, work, size=10, max_batches=2)
    assert seen[3:] == [[9, 19, *range(20, 28)], list(range(28, 38))] and second["total"] == 29 and second["remaining"] == 29 - second["written"]
    third = flows.drain(pending, ledger, work, size=50)
    assert third["batches"] == 1 and ledger.read().where("state = 'done'").count() == 43
    assert {r.id: (r.state, r.domain) for r in ledger.read().where("id IN (0, 9, 999)").collect()} == {0: ("done", "x"), 9: ("unanswered", None)}
    assert flows.drain(pending.limit(0), ledger, work)["batches"] == 0


def test_paging_stops_as_a_reader_would(spark):
    card = lambda *urls: [(u,) for u in urls]
    pages = [
        ("all", 1, card("a", "b")), ("all", 2, card("c", "a")), ("all", 3, card("d")),
        ("repeat", 1, card("a")), ("repeat", 2, card("a", "z")), ("repeat", 3, card("y")),
        ("gap", 1, card("a")), ("gap", 3, card("b")), ("empty", 1, card("a")), ("empty", 2, []), ("empty", 3, card("b")), ("null", 1, None), ("late", 2, card("a")),
        ("twice", 1, card("a")), ("twice", 1, card("b")), (None, 1, card("a")),
    ]
    df = spark.createDataFrame(pages, "listing string, page_no int, cards array<struct<detail_url: string>>")
    cards, ends = P.paged(df, most=2)
    got = {r.listing: (r.pages_fetched, r.cards, r.new_cards, r.stop_reason) for r in ends.collect()}
    assert got == {
        "all": (2, 4, 3, "reached the most pages"), "repeat": (1, 1, 1, "the same first card as the page before"), "gap": (1, 1, 1, "reached the most pages"), "empty": (1, 1, 1, "a page without cards"),
        "null": (0, 0, 0, "a page without cards"), "late": (0, 0, 0, "a page is missing"), "twice": (1, 1, 1, "no more pages"),
    }
    assert sorted((r.page_no, r.n, r.detail_url) for r in cards.where("listing = 'all'").collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    assert {r.listing: r.stop_reason for r in P.paged(df)[1].collect()}["gap"] == "a page is missing"
