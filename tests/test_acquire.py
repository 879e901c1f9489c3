"""Acquisition against a pretended API, settings and the command line."""

import json
from urllib.parse import parse_qs, urlsplit

import pytest

from lakeloom.__main__ import main
from lakeloom.session import Settings, load_settings, preflight
from lakeloom.sources.acquire import Acquisition, land, landed, pages


def api(total, cursors=True, asked=None):
    def fetch(url):
        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        if asked is not None:
            asked.append(q)
        size = int(q["per-page"])
        start = (0 if q["cursor"] == "*" else int(q["cursor"])) if "cursor" in q else (int(q["page"]) - 1) * size
        found = [{"id": i} for i in range(start, min(start + size, total))]
        return {"results": found, "meta": {"next_cursor": str(start + size) if cursors else None}}

    return fetch


def ids(wanted, fetch):
    return [r["id"] for _, records in pages(wanted, fetch) for r in records]


def test_request():
    q = parse_qs(urlsplit(Acquisition("http://x/w", 50, ("id", "title"), 7, 20, {"has_abstract": False, "type": "article", "from_publication_date": ""}, "a@b").url(3)).query)
    assert q == {"per-page": ["20"], "select": ["id,title"], "sample": ["50"], "seed": ["7"], "page": ["3"], "filter": ["type:article,has_abstract:false"], "mailto": ["a@b"]}
    q = parse_qs(urlsplit(Acquisition("http://x/w", 20_000, ("id",)).url(1, "abc")).query)
    assert q == {"per-page": ["200"], "select": ["id"], "cursor": ["abc"]}


def test_pages():
    asked = []
    assert ids(Acquisition("http://x", 50, ("id",), page_size=20), api(1000, asked=asked)) == list(range(50))
    assert [q["page"] for q in asked] == ["1", "2", "3"]
    assert ids(Acquisition("http://x", 50, ("id",), page_size=20), api(30)) == list(range(30))
    assert ids(Acquisition("http://x", 50, ("id",), page_size=20), api(0)) == []
    assert ids(Acquisition("http://x", 0, ("id",)), api(9)) == []
    big = Acquisition("http://x", 10_100, ("id",))
    assert big.by_cursor and ids(big, api(20_000)) == list(range(10_100))
    assert ids(big, api(20_000, cursors=False)) == list(range(200))


def test_land(spark, tmp_path):
    folder = f"{tmp_path}/raw"
    for total in (45, 3, 0):
        done = land(spark, Acquisition("http://x", 50, ("id",), page_size=20), folder, api(total))
        assert done["records"] == total and done["mode"] == "sample" and done["request_urls"]
        assert sorted(json.loads(r["value"])["id"] for r in landed(spark, folder).collect()) == list(range(total))


def test_settings_and_command(spark, tmp_path, capsys):
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"tables": "/root/testdata/sf0.001", "output": "out", "master": "local[8]"}))
    assert load_settings(str(file)).path("out") == str(tmp_path / "out")
    assert main([str(file), "yearly_trends", "--format", "csv"]) == 0
    assert spark.read.csv(str(tmp_path / "out/yearly_trends"), header=True).count() > 0
    assert main(["--list"]) == 0 and "pagerank" in capsys.readouterr().out
    assert not preflight(Settings("/no/such/folder", "out"))["ok"]
    file.write_text(json.dumps({"tables": "x", "output": "y", "speed": 1}))
    with pytest.raises(ValueError):
        load_settings(str(file))
    with pytest.raises(SystemExit):
        main([str(file), "no_such_query"])
