"""Starred repositories as a data source: linked pages read in turn, newest first, and the README of each repository."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larder.sources import pages

# Where pages and files lie, entries to a page, the quota that is left alone, and names of a README.
API, RAW = "https://api.github.com", "https://raw.githubusercontent.com"
PAGE, QUOTA = 100, 2
READMES = ("README.md", "readme.md", "README.rst", "README")
PAGES = "page int, status int, body string, has_next boolean, remaining int, stop string"

#: (status, headers with lower-case names, body) of an address.
Fetch = Callable[[str], tuple[int, dict, bytes]]


def _ids(body: str) -> list[str]:
    """Ids of the stars of a page, as far as it can be read; the parser judges its shape."""
    try:
        got = json.loads(body)
    except ValueError:
        return []
    names = [(x.get("repo") or {}).get("full_name") for x in got if isinstance(x, dict)] if isinstance(got, list) else []
    return [n.replace("/", "__") for n in names if isinstance(n, str)]


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, login: str, known: frozenset[str], cap: int | None):
        self.fetch, self.login, self.known, self.cap = fetch, login, known, cap

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # each page tells whether there is another

    def read(self, partition) -> Iterator[tuple]:
        page = seen = 0
        while True:
            page += 1
            status, headers, raw = self.fetch(f"{API}/users/{self.login}/starred?per_page={PAGE}&page={page}")
            body, more = raw.decode("utf-8", "replace"), 'rel="next"' in (headers.get("link") or "")
            left = headers.get("x-ratelimit-remaining") or ""
            left = int(left) if left.isdigit() else None
            ids = _ids(body) if status == 200 else []
            seen += len(ids)
            if status != 200:
                stop = "error"
            elif self.known.intersection(ids):
                stop = "frontier"
            elif self.cap is not None and seen >= self.cap:
                stop = "cap"
            elif not ids or not more:
                stop = "end"
            elif left is not None and left < QUOTA:
                stop = "quota"
            else:
                stop = None
            yield page, status, body, more, left, stop
            if stop:
                return


def source(fetch: Fetch) -> type[DataSource]:
    """A data source ``starred`` that reads addresses with ``fetch``; options: login, known (JSON list of ids) and cap."""

    class Starred(DataSource):
        @classmethod
        def name(cls) -> str:
            return "starred"

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            cap = self.options.get("cap")
            return _Reader(fetch, self.options["login"], frozenset(json.loads(self.options.get("known", "[]"))), None if cap is None else int(cap))

    return Starred


def stars(spark: SparkSession, fetch: Fetch, login: str, known: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """The pages of a user's stars, each with its ``stars`` or a ``code``, and ``stop`` on the last one: end, frontier, cap, quota or error.

    Reading stops after the page that holds a known id or reaches the cap, so no page beyond is asked for; ``ingest.cut_at_frontier`` cuts within it. A scan that stopped at its cap or for the quota has
    not seen the end. A user that is not there is source_unavailable, a refused token login_required.
    """
    spark.dataSource.register(source(fetch))
    read = spark.read.format("starred").option("login", login).option("known", json.dumps(known or []))
    got = pages.github_starred((read if cap is None else read.option("cap", cap)).load())
    code = F.when(F.col("status") == 404, "source_unavailable").when(F.col("status") == 401, "login_required").when((F.col("status") != 200) & F.col("code").isNull(), "page_changed").otherwise(F.col("code"))
    return got.withColumn("code", code).withColumn("stars", F.when(F.col("code").isNull(), F.col("stars")))


def with_readme(repos: DataFrame, fetch: Fetch) -> DataFrame:
    """``repos`` (full_name, default_branch, ...) with ``readme``: the first file of ``READMES`` that is there, else null. Repositories are asked for in the tasks that hold them."""

    def ask(names: pd.Series, branches: pd.Series) -> pd.Series:
        def one(name, branch):
            for file in READMES:
                status, _, body = fetch(f"{RAW}/{name}/{branch}/{file}")
                if status == 200:
                    return body.decode("utf-8", "replace")
            return None

        return pd.Series([one(n, b) for n, b in zip(names, branches)], dtype=object)

    return repos.withColumn("readme", F.pandas_udf(ask, "string")("full_name", "default_branch"))
