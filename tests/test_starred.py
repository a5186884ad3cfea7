"""Starred pages as a data source, with addresses answered from a table."""

import json

import pytest
from pyspark.sql import functions as F

from larder.sources import starred


def star(n):
    return {"starred_at": "2024-01-02T03:04:05Z", "repo": {"full_name": f"o/r{n}", "html_url": f"https://g/o/r{n}", "default_branch": "main", "created_at": "2020-01-01T00:00:00Z", "owner": {"login": "o"}}}


def answers(login, *pages, left=None):
    """A fetch for pages of numbers; ``left`` is the quota after each."""
    table = {}
    for i, numbers in enumerate(pages, 1):
        headers = {"link": '<u>; rel="next"'} if i < len(pages) else {}
        if left is not None:
            headers["x-ratelimit-remaining"] = str(left[i - 1])
        table[f"{starred.API}/users/{login}/starred?per_page=100&page={i}"] = (200, headers, json.dumps([star(n) for n in numbers]).encode())
    return table


def scan(spark, table, **kw):
    def fetch(url):
        return table.get(url, (404, {}, b'{"message": "Not Found"}'))

    got = starred.stars(spark, fetch, "ann", **kw).orderBy("page").collect()
    return [[s["full_name"] for s in r["stars"] or []] for r in got], got[-1]["stop"], got[-1]["code"]


@pytest.mark.parametrize(
    "kw, pages, stop",
    [({}, 3, "end"), ({"known": ["o__r3"]}, 2, "frontier"), ({"known": ["o__r0"]}, 1, "frontier"), ({"cap": 3}, 2, "cap"), ({"cap": 2}, 1, "cap"), ({"known": ["other"], "cap": 50}, 3, "end")],
)
def test_paging(spark, kw, pages, stop):
    whole = [["o/r0", "o/r1"], ["o/r2", "o/r3"], ["o/r4"]]
    assert scan(spark, answers("ann", [0, 1], [2, 3], [4]), **kw) == (whole[:pages], stop, None)


def test_quota_ends_and_errors(spark):
    assert scan(spark, answers("ann", [0], [1], [2], left=[9, 1, 9]))[1] == "quota"
    assert scan(spark, answers("ann", [0], [1], left=[9, 1]))[1] == "end"  # nothing more to ask for
    assert scan(spark, answers("ann", [0], [], [2]))[1] == "end"
    assert scan(spark, answers("bob", [0])) == ([[]], "error", "source_unavailable")
    first = f"{starred.API}/users/ann/starred?per_page=100&page=1"
    limit = b'{"message": "API rate limit exceeded"}'
    for answer, code in (((401, {}, b""), "login_required"), ((403, {}, limit), "rate_limited"), ((500, {}, b"oops"), "page_changed"), ((200, {}, b"oops"), "page_changed"), ((200, {}, b'{"x": 1}'), "page_changed")):
        assert scan(spark, {first: answer})[2] == code


def test_readmes(spark):
    table = {f"{starred.RAW}/o/a/main/readme.md": (200, {}, "é".encode()), f"{starred.RAW}/o/b/dev/README": (200, {}, b"\xff")}

    def fetch(url):
        return table.get(url, (404, {}, b""))

    repos = spark.createDataFrame([("o/a", "main", 1), ("o/b", "dev", 2), ("o/c", "main", 3)], "full_name string, default_branch string, n int")
    got = {r["full_name"]: r["readme"] for r in starred.with_readme(repos, fetch).collect()}
    assert got == {"o/a": "é", "o/b": "�", "o/c": None}
    assert starred.with_readme(repos, fetch).where(F.col("readme").isNull()).count() == 1
