"""Paged evidence in batch and as a stream: planned pages, merged windows, company searches, kill and replay."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressline.functions import control
from pressline.sources import paged

ROW = "uuid string, url string, title string, published_at string, entities array<struct<symbol:string>>"


def put(root, provider, request, window, phase, page, payload):
    folder = f"{root}/provider={provider}/request={request}/from={window[0]}/to={window[1]}/phase={phase}/page={page}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/answer.json", "w") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload))


def window(n):
    return f"2024010{n}T000000Z", f"2024010{n + 1}T000000Z"


def row(i, *symbols):
    return {"uuid": f"u{i}", "url": f"https://x.example.com/{i}", "title": f"t{i}", "published_at": "2024-01-01T00:00:00Z", "entities": [{"symbol": s} for s in symbols]}


def answer(page, rows, found, limit=3):
    return {"meta": {"found": found, "returned": len(rows), "limit": limit, "page": page + 1}, "data": rows}


def states(spark, root, **more):
    out = paged.windows(paged.pages_of(paged.read(spark, str(root))), page_size=3, **more).withColumn("checkpoint", paged.checkpoint())
    return {(r["provider"], r["from"]): r for r in out.collect()}


def test_pages_are_planned_by_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "PAGES_A_SPLIT", 4)
    for page in range(10):
        put(tmp_path, "a", "all", window(1), "news", page, answer(page, [row(page)], 10, 1))
    put(tmp_path, "a", "r2", window(1), "news", 0, "[]")
    put(tmp_path, "b", "all", window(1), "news", 0, "[]")
    (tmp_path / "provider=b" / "_temporary").mkdir()
    (tmp_path / "provider=b" / "request=all" / f"from={window(1)[0]}" / f"to={window(1)[1]}" / "phase=news" / "page=0" / "_SUCCESS").write_text("")
    reader = paged.PagedEvidence({"path": str(tmp_path)}).reader(None)
    assert [len(p.places) for p in reader.partitions()] == [4, 4, 2, 1, 1]
    got = paged.read(spark, str(tmp_path)).collect()
    assert sorted((r["provider"], r["request"], r["page"]) for r in got) == sorted([("a", "all", i) for i in range(10)] + [("a", "r2", 0), ("b", "all", 0)])
    assert paged.read(spark, f"file://{tmp_path}", provider="b").count() == 1
    assert paged.read(spark, str(tmp_path / "nothing")).collect() == []


def test_windows_are_complete_stopped_or_open(spark, tmp_path):
    rows = [row(i) for i in range(20)]
    put(tmp_path, "m", "all", window(1), "news", 0, answer(0, rows[:3], 5))  # full, then the rest
    put(tmp_path, "m", "all", window(1), "news", 1, answer(1, rows[3:5], 5))
    put(tmp_path, "m", "all", window(2), "news", 0, answer(0, rows[:3], 3))  # full, but that is all
    put(tmp_path, "m", "all", window(3), "news", 0, answer(0, rows[:3], 7))  # more to come
    put(tmp_path, "m", "all", window(4), "news", 0, answer(0, rows[:3], 9))
    put(tmp_path, "m", "all", window(4), "news", 1, {"error": {"code": "usage_limit_reached", "message": "x"}})
    put(tmp_path, "m", "all", window(5), "news", 0, answer(1, rows[:3], 9))  # says another page
    put(tmp_path, "m", "all", window(6), "news", 0, answer(0, rows[:3], 20_001))
    put(tmp_path, "m", "all", window(7), "news", 1, answer(1, rows[:2], 5))  # the first page is missing
    put(tmp_path, "m", "all", window(8), "news", 0, "not json")
    got = states(spark, tmp_path)
    short = {k[1][7:8]: (r["pages"], r["n_rows"], r["problem"], r["complete"], r["next_page"]) for k, r in got.items()}
    assert short == {
        "1": (2, 5, None, True, None), "2": (1, 3, None, True, None), "3": (1, 3, None, False, 1), "4": (1, 3, "rate_limited", False, 1),
        "5": (0, 0, "invalid_response", False, 0), "6": (0, 0, "rate_limited", False, 0), "7": (0, 0, None, False, 0), "8": (0, 0, "invalid_response", False, 0),
    }


def test_narrowed_windows_are_put_together(spark):
    part = lambda day, k, pages, problem=None, next_page=None: (day, f"{day}T0{k}", f"{day}T0{k + 1}", pages, 40 * pages, problem, next_page is None, next_page)
    rows = [
        part("1", 0, 5), part("1", 1, 3), part("2", 0, 5), part("2", 1, 3, None, 3), part("3", 0, 5), part("3", 1, 0, "rate_limited", 0), part("3", 2, 4),  # behind an open one
        part("4", 0, 5), part("4", 2, 5), part("4", 3, 5),  # one is missing
        part("5", 0, 2, "upstream", 2),
    ]
    states = spark.createDataFrame(rows, "day string, from string, to string, pages long, n_rows long, problem string, complete boolean, next_page long")
    got = {r["day"]: tuple(r)[1:] for r in paged.joined(states, F.col("day")).collect()}
    assert got == {"1": (8, 320, None, True, None), "2": (8, 320, None, False, 8), "3": (5, 200, "rate_limited", False, 5), "4": (5, 200, None, False, 5), "5": (2, 80, "upstream", False, 2)}


def test_checkpoints_agree_with_the_plain_ones(spark, tmp_path):
    """Page by page, the state of the saved pages is the checkpoint that a collector would hold."""
    phases, now = ("news", "removed"), datetime.fromisoformat("2024-01-02T00:00:00+00:00")
    w = control.Window(datetime.fromisoformat("2024-01-01T00:00:00+00:00"), now)
    name = ("20240101T000000Z", "20240102T000000Z")
    for phase, page, n in (("news", 0, 3), ("news", 1, 3), ("news", 2, 1), ("removed", 0, 3), ("removed", 1, 0)):
        rows = [row(i) for i in range(n)]
        put(tmp_path, "b", "all", name, phase, page, {"2024": rows} if phase == "removed" and page == 0 else rows)
        want = control.after_page(w, n == 3, phases)
        got = json.loads(next(iter(states(spark, tmp_path, phases=phases).values()))["checkpoint"])
        if "watermark" in want:
            assert datetime.fromisoformat(got["watermark"]) == datetime.fromisoformat(want["watermark"])
            assert control.window_of(got, now).start == control.window_of(want, now).start
        else:
            w = control.window_of(want, now)
            assert control.window_of(got, now) == w


def test_articles_once_in_the_latest_window(spark, tmp_path):
    put(tmp_path, "m", "all", window(1), "news", 0, answer(0, [row(1), row(2), row(2)], 4))
    put(tmp_path, "m", "all", window(1), "news", 1, answer(1, [row(3)], 4))
    put(tmp_path, "m", "all", window(2), "news", 0, answer(0, [{**row(2), "title": "new"}, row(4)], 2))
    put(tmp_path, "m", "all", window(3), "news", 0, {"error": {"code": "x"}, "data": [row(9)]})
    got = paged.articles(paged.pages_of(paged.read(spark, str(tmp_path))), ROW, "uuid")
    assert sorted((r["uuid"], r["title"], r["from"][7:8]) for r in got.collect()) == [("u1", "t1", "1"), ("u2", "new", "2"), ("u3", "t3", "1"), ("u4", "t4", "2")]


def test_company_searches(spark, tmp_path):
    w = window(1)
    put(tmp_path, "m", "c1", w, "news", 0, answer(0, [row(1, "acm"), row(2, "OTHER"), row(3)], 4))
    put(tmp_path, "m", "c1", w, "news", 1, answer(1, [row(4, "X", "ACM")], 4))
    put(tmp_path, "m", "c1", w, "news", 2, answer(2, [row(5, "ACM")], 4))  # never asked for: all was there
    put(tmp_path, "m", "c2", w, "news", 0, answer(0, [], 0))
    for page in range(4):  # three pages at most
        put(tmp_path, "m", "c3", w, "news", page, answer(page, [row(10 + page, "BBY.L")], 9, 1))
    put(tmp_path, "m", "c4", w, "news", 0, {"error": {"code": "quota", "message": "m"}})
    put(tmp_path, "m", "c5", w, "news", 0, {"error": {"code": "malformed", "message": "m"}})
    put(tmp_path, "m", "c6", w, "news", 0, answer(0, [row(20, "BBY")], 1))  # the bare symbol is another company's
    put(tmp_path, "m", "c7", w, "news", 0, {"data": [{**row(21, "S7"), "url": None}, {**row(22, "S7"), "published_at": "soon"}]})
    put(tmp_path, "m", "c8", w, "news", 0, {"meta": {"limit": 1}, "data": [row(23, "S8")]})  # full and not counted: open
    wanted = spark.createDataFrame([("c1", ["ACM"]), ("c2", ["A"]), ("c3", ["BBY.L"]), ("c4", ["A"]), ("c5", ["A"]), ("c6", ["BBY.L"]), ("c7", ["S7"]), ("c8", ["S8"])], "request string, symbols array<string>")
    out = paged.company_search(paged.pages_of(paged.read(spark, str(tmp_path))), wanted, ROW)
    assert {r["request"]: (r["outcome"], r["complete"], r["pages"], r["n_articles"]) for r in out["outcomes"].collect()} == {
        "c1": ("ok", True, 2, 2), "c2": ("no_news", True, 1, 0), "c3": ("ok", False, 3, 3), "c4": ("rate_limited", False, 1, 0),
        "c5": ("refused", False, 1, 0), "c6": ("no_news", True, 1, 0), "c7": ("no_news", True, 1, 0), "c8": ("ok", False, 1, 1),
    }
    assert sorted(r["uuid"] for r in out["articles"].collect()) == ["u1", "u10", "u11", "u12", "u23", "u4"]


def test_offsets_wait_for_a_missing_page():
    place = lambda day, phase, page: ("p", "all", *window(day), phase, str(page))
    assert paged.after([]) is None
    one = [place(1, "news", 0), place(1, "news", 1), place(1, "removed", 0), place(2, "news", 0)]
    assert paged.after(one) == {"from": window(2)[0], "to": window(2)[1], "page": 1, "phase": "news"}
    assert paged.after([*one[:1], place(1, "news", 2), *one[2:]])["page"] == 1  # page 1 is not there yet
    assert paged.after([place(1, "news", 1)]) is None


def test_a_killed_stream_reads_the_same_pages_again(spark, tmp_path):
    root, seen = tmp_path / "in", []

    def collect(day):
        for page in range(40):
            put(root, "m", "all", window(day), "news", page, answer(page, [row(100 * day + 2 * page), row(100 * day + 2 * page + 1)], 80, 2))

    fail = {1}

    def sink(batch, number):
        parsed = paged.pages_of(batch).select("from", "page", F.explode("rows").alias("row")).withColumn("uuid", F.get_json_object("row", "$.uuid"))
        parsed.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        seen.append(number)
        if number in fail:
            fail.discard(number)
            raise RuntimeError("killed after the write, before the commit")

    def run():
        query = paged.read_stream(spark, str(root), "m").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()

    collect(1)
    run()
    collect(2)
    with pytest.raises(Exception, match="killed"):
        run()
    collect(3)  # what came meanwhile does not change the batch that is read again
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert seen == [0, 1, 1, 2]
    assert got.filter("batch = 1").select("from").distinct().count() == 1
    batch = paged.articles(paged.pages_of(paged.read(spark, str(root))), ROW, "uuid")
    assert sorted(r[0] for r in got.select("uuid").collect()) == sorted(r[0] for r in batch.select("uuid").collect()) and batch.count() == 240


def test_a_stream_needs_a_provider(spark, tmp_path):
    with pytest.raises(ValueError, match="one provider"):
        paged.PagedEvidence({"path": str(tmp_path)}).streamReader(None)


def test_saved_pages_come_back(spark, tmp_path):
    pages = spark.createDataFrame([("p", "all", *window(1), "news", i, json.dumps({"meta": {"page": i + 1}, "data": [row(i)], "s": "ä\\n\"x\""})) for i in range(5)], paged.SCHEMA)
    paged.save(pages, str(tmp_path / "saved"))
    assert {tuple(r)[:6] + (json.dumps(json.loads(r["payload"])),) for r in paged.read(spark, str(tmp_path / "saved")).collect()} == {tuple(r)[:6] + (json.dumps(json.loads(r["payload"])),) for r in pages.collect()}


def test_bundles_are_planned_and_read_by_their_names(spark, tmp_path, monkeypatch):
    """Ten times the pages are not ten times the files; gaps stay gaps; a page that was saved twice counts once."""
    page = lambda day, i, text="": ("p", "all", *window(day), "news", i, json.dumps({"meta": {"page": i + 1}, "data": [row(i)]}) + text)
    frame = lambda rows: spark.createDataFrame(rows, paged.SCHEMA)
    root = str(tmp_path / "saved")
    paged.save(frame([page(1, i) for i in range(600)] + [page(2, i) for i in (0, 1, 2, 5, 6)]), root)
    places = paged._Folder(root).places()
    assert [(p[2][7:8], p[5]) for p in places] == [("1", "0-249"), ("1", "250-499"), ("1", "500-599"), ("2", "0-2"), ("2", "5-6")]
    assert sum(f.endswith(".parquet") for _, _, names in os.walk(root) for f in names) == 5
    assert paged.after(places) == {"from": window(2)[0], "to": window(2)[1], "page": 3, "phase": "news"}
    monkeypatch.setattr(paged, "ROWS_A_SPLIT", 500)
    assert [len(p.places) for p in paged.PagedEvidence({"path": root}).reader(None).partitions()] == [2, 3]
    paged.save(frame([page(2, i, " ") for i in range(3)] + [page(1, 600)]), root)  # the same bundle again
    paged.save(frame([page(2, i) for i in range(8)]), root)  # and one over all
    got = [(r["from"][7:8], r["page"]) for r in paged.read(spark, root).select("from", "page").collect()]
    assert sorted(got) == [("1", i) for i in range(601)] + [("2", i) for i in range(8)]


def test_offsets_within_bundles():
    """A stream that is restarted plans the same pages for the same offsets, whatever bundles came meanwhile."""
    place = lambda page: ("p", "all", *window(1), "news", page)
    key = lambda page: (*window(1), 0, "news", page)
    old, new = [place("0-9"), place("10-12")], [place("0-9"), place("0-19"), place("10-12"), place("20")]
    assert paged.after(old)["page"] == 13 and paged.after(new)["page"] == 21
    pages = lambda items: [i for _, low, high in items for i in range(low, high + 1)]
    assert pages(paged.planned(old, key(0), key(13))) == pages(paged.planned(new, key(0), key(13))) == list(range(13))
    assert pages(paged.planned(new, key(13), key(21))) == list(range(13, 21))
    assert pages(paged.planned([place("0-3"), place("6-7")])) == [0, 1, 2, 3, 6, 7]
