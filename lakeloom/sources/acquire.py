"""Acquisition of records from a paged JSON API: requests that push filters and fields down, and their landing as JSON lines.

What is fetched is a parameter (`fetch`, a function of a URL that gives the decoded reply), so that another client, a
cache or a test takes the place of HTTP.  Pages follow one another, as each names the next; the driver holds one page.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

#: The API gives at most so many records of a random sample, and of a page.
MOST_SAMPLED, MOST_A_PAGE = 10_000, 200
FILTERS = ("from_publication_date", "type", "has_abstract")

Fetch = Callable[[str], Mapping]


def http(url: str) -> Mapping:
    with urlopen(url, timeout=60) as reply:
        return json.load(reply)


@dataclass(frozen=True)
class Acquisition:
    """What is wanted: `records` records with `fields`, sampled by `seed` or, beyond MOST_SAMPLED, in order by cursor."""

    source_url: str
    records: int
    fields: tuple[str, ...]
    seed: int = 0
    page_size: int | None = None
    filters: Mapping[str, object] = field(default_factory=dict)
    contact: str | None = None

    @property
    def by_cursor(self) -> bool:
        return self.records > MOST_SAMPLED

    @property
    def a_page(self) -> int:
        return min(self.page_size or self.records, self.records, MOST_A_PAGE)

    def filter_text(self) -> str:
        """The filters that are set, by name; a flag counts as set when it is false, other empty values do not."""
        given = {name: self.filters.get(name) for name in FILTERS}
        given["has_abstract"] = None if given["has_abstract"] is None else str(bool(given["has_abstract"])).lower()
        return ",".join(f"{name}:{value}" for name, value in given.items() if value)

    def url(self, page: int = 1, cursor: str | None = None) -> str:
        place = {"sample": self.records, "seed": self.seed, "page": page} if cursor is None else {"cursor": cursor}
        rest = {"filter": self.filter_text(), "mailto": self.contact}
        return f"{self.source_url}?" + urlencode({"per-page": self.a_page, "select": ",".join(self.fields), **place, **{k: v for k, v in rest.items() if v}})


def pages(wanted: Acquisition, fetch: Fetch = http) -> Iterator[tuple[str, list]]:
    """(url, records) of each page until there are enough: an empty or short page, or one without a next cursor, is the last."""
    left, page, cursor = wanted.records, 1, "*" if wanted.by_cursor else None
    while left > 0:
        url = wanted.url(page, cursor)
        reply = fetch(url)
        records = reply.get("results") or []
        if records:
            yield url, records[:left]
        left -= len(records)
        cursor = (reply.get("meta") or {}).get("next_cursor") if wanted.by_cursor else None
        if len(records) < wanted.a_page or wanted.by_cursor and not cursor:
            return
        page += 1


def land(spark: SparkSession, wanted: Acquisition, folder: str, fetch: Fetch = http) -> dict:
    """Write the records as JSON lines below folder, in place of what is there, a file a page; returns what was done."""
    urls, n = [], 0
    for url, records in pages(wanted, fetch):
        lines = [(json.dumps(r, ensure_ascii=False, sort_keys=True),) for r in records]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append" if urls else "overwrite").text(folder)
        urls.append(url)
        n += len(records)
    if not urls:
        spark.createDataFrame([], "value string").write.mode("overwrite").text(folder)
    return {"mode": "cursor" if wanted.by_cursor else "sample", "request_urls": urls or [wanted.url(cursor="*" if wanted.by_cursor else None)], "wanted": wanted.records, "records": n, "seed": wanted.seed, "filters": dict(wanted.filters), "folder": folder}


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The landed records as text, a row each, for reading with any schema."""
    return spark.read.text(folder)
