import gzip
import hashlib
import io
import random

import pytest

from tidemark.llm import url_filter, warc

SCHEMA = "page_id long, url string, html string, host string, score double"
BIG = "<p>" + "x" * 200 + "</p>"
ROWS = [
    (1, "http://A.example.com/a?x=1", BIG), (2, "http://b.example.com/", BIG), (3, None, BIG), (None, "http://c.example.com", BIG),
    (4, "http://a.example.com/a?x=1", None), (5, "http://a.example.com/a\r\nWARC-Type: x", ""), (6, "no host", "short"),
    (7, "http://é.example.com/é", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 9), (8, "http://d.example.com", "short"),
    (2, "http://b.example.com/", BIG), (9, "http://e.example.com/" + "p" * 3000, "é漢🙂" * 5000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "h", 0.5) for r in ROWS], SCHEMA)


def test_archives_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    out = warc.capture_histories(pages.repartition(3), path, records_per_file=2).collect()
    first = 1  # the smallest id of the large payload that three ids share
    want = []
    for i, url, html in ROWS:
        raw = (html or "").encode()
        refers = first if html == BIG and i != first else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    keys = [(r["url_key"], r["captured_at"]) for r in out]
    assert keys == sorted(keys)  # global order, partition after partition
    files = list((tmp_path / "archives").glob("*.gz"))
    assert len(files) >= 5
    for file in files:
        raw = gzip.decompress(file.read_bytes())
        for offset, headers, block in warc.parse_records(io.BytesIO(raw)):
            assert raw[offset:offset + 8] == b"WARC/1.1" and len(block) == int(headers["Content-Length"])


def test_empty_table(spark, pages, tmp_path):
    assert warc.capture_histories(pages.where("page_id > 99"), str(tmp_path / "none")).count() == 0


def test_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort")))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(rnd.randrange(20) for _ in range(rnd.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "com", "/de/")]


def test_host_path_and_rules(spark):
    urls = {
        "http://WWW.Example.ORG/es/1?q": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en": ("example.org", "/en", "org/", "allow"), "x://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, None), "http://a.com/de/#x/y": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com#/de/": ("a.com", "", None, None), "no scheme.org/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "a://b://c.org/": ("b:", "//c.org/", None, None), "http://É.com/\n/x?": ("É.com", "/\n/x", None, None)}
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_trees_learn_from_labelled_urls(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(800):
        bad = i % 3 == 0
        name = "".join(rnd.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
        rows.append((i, f"http://{name}.example.{'biz' if i % 2 else 'net'}/{'x/' * (4 if bad else 1)}", "", "", int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, label int")
    parts = df.withColumns({"host": url_filter.host_of(df.url), "path": url_filter.path_of(df.url)})
    model = url_filter.train(parts.where("page_id < 600"), max_rows=500)
    out = model.score(url_filter.lexical_features(parts)).where("page_id >= 600").collect()
    assert all((r["score"] >= 0.5) == (r["label"] == 1) for r in out)


def test_one_class_or_none(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(df, RULES).collect()} == {"allow"}
    blocked = spark.createDataFrame([(1, "http://a.com/de/"), (2, "http://a.net/")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(blocked, RULES).collect()} == {"block"}
    assert url_filter.judge(df.where("page_id > 5"), RULES).count() == 0


def labelled_urls(spark, rows):
    df = spark.createDataFrame(rows, "url string, label int")
    return df.withColumns({"host": url_filter.host_of(df.url), "path": url_filter.path_of(df.url)})


def test_repeated_urls_do_not_fill_the_draw(spark):
    rows = [(f"http://h{i}.example.net/{'x/' * (4 if i % 10 == 0 else 1)}", int(i % 10 == 0)) for i in range(40)]
    model = url_filter.train(labelled_urls(spark, rows * 30), max_rows=20)
    assert model.trees is not None
    drawn = url_filter._drawn(labelled_urls(spark, rows * 30), 20).collect()
    assert len(drawn) == len({r["url"] for r in drawn}) == 20 and sum(r["label"] for r in drawn) == 4
    assert {k: round(sum(r["weight"] for r in drawn if r["label"] == k)) for k in (0, 1)} == {0: 1080, 1: 120}


def test_statistics_cover_all_labelled_rows(spark):
    rows = [(f"http://a.d{i % 30}.{'net' if i % 2 else 'biz'}/{i}", int(i % 2)) for i in range(120)]
    model = url_filter.train(labelled_urls(spark, rows), max_rows=10)
    found = {r["domain"]: r for r in model.statistics["domain"].collect()}
    assert len(found) == 30 and all(r["domain_n"] == 4 for r in found.values())
    assert sum(r["domain_blocked"] for r in found.values()) == 60
    assert sum(sum(r["domain_fold_n"]) for r in found.values()) == 120
