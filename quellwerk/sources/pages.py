"""Raw pages: charset detection and decoding, fetching with retries and rate limit."""

from __future__ import annotations

import codecs
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quellwerk.config import Config
from quellwerk.functions.urls import parse

PAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("content_type", T.StringType()),
                     T.StructField("status", T.IntegerType()), T.StructField("retries", T.IntegerType())])
_CHARSET = r"""(?i)charset=["']?([\w-]+)"""


def charset(content: Column, content_type: Column) -> Column:
    """Charset of a page (S3): from its header, else from its first 2,048 bytes, else utf-8; lower-cased."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    found = [F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), _CHARSET, 1)), F.lit("")) for c in (content_type, head)]
    return F.coalesce(*found, F.lit("utf-8"))


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw: bytes | None, label: str) -> str | None:
        if raw is None:
            return None
        try:
            codecs.lookup(label)
            text = raw.decode(label, "replace")
        except LookupError:
            text = raw.decode("utf-8", "replace")
        return text.removeprefix("﻿")

    return pd.Series([one(*x) for x in zip(content, charset, strict=True)], dtype=object)


def decoded(content: Column, content_type: Column) -> Column:
    """Text of a page (S4); unknown charsets are read as utf-8, bad bytes become U+FFFD, null stays null."""
    return _decoded(content, charset(content, content_type))


class FetchError(Exception):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status
        #: Any status but 429 and 5xx will not get better.
        self.permanent = status is not None and status < 500 and status != 429


def with_retry(call: Callable, retries: int, base_ms: int, on_retry: Callable = lambda error, attempt, again: None, sleep=time.sleep, jitter=random.random):
    """Result of `call`, tried again up to `retries` times after waits that double (T8); permanent errors are not retried."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as error:
            again = attempt < retries and not getattr(error, "permanent", False)
            on_retry(error, attempt + 1, again)
            if not again:
                raise
            sleep((base_ms * 2**attempt + jitter() * 250) / 1000)
    raise AssertionError("unreachable")


class RateLimit:
    """Least gap between calls of `wait`."""

    def __init__(self, gap_ms: int, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.last = gap_ms / 1000, clock, sleep, float("-inf")

    def wait(self) -> None:
        if (left := self.last + self.gap - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def http_get(url: str, config: Config, referer: str | None = None) -> tuple[int, bytes, str | None]:
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": config.user_agent} | ({"Referer": referer} if referer else {}))
    try:
        with urllib.request.urlopen(request, timeout=config.timeout_ms / 1000) as r:
            return r.status, r.read(), r.headers.get("content-type")
    except urllib.error.HTTPError as e:
        raise FetchError(f"HTTP {e.code} for {url}", e.code) from e


def attempts(call: Callable, config: Config, limit: RateLimit) -> tuple[int | None, bytes | None, str | None, str | None, int]:
    """(status, content, content type, error, retries) of one request, tried again and spaced as the settings say.

    What can't be had is a row with an error, not a failed job.
    """
    tried: list[bool] = []

    def spaced():
        limit.wait()
        return call()

    try:
        status, content, kind = with_retry(spaced, config.retries, config.retry_base_ms, lambda error, attempt, again: tried.append(again))
        return status, content, kind, None, sum(tried)
    except Exception as e:  # noqa: BLE001
        return getattr(e, "status", None), None, None, str(e) or type(e).__name__, sum(tried)


def requested(requests: DataFrame, config: Config, get: Callable) -> DataFrame:
    """`requests` (ord, url, referer) with content, error and retries; requests to one host go one after another."""
    schema = T.StructType([*requests.schema, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType()), T.StructField("retries", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits: dict[str, RateLimit] = {}
        for rows in batches:
            out = []
            for ord, url, referer in rows[["ord", "url", "referer"]].itertuples(index=False):
                limit = limits.setdefault(p.origin if (p := parse(url)) else "", RateLimit(config.delay_ms))
                _, content, _, error, retries = attempts(lambda url=url, referer=referer: get(url, config, referer), config, limit)
                out.append((ord, url, referer, content, error, retries))
            yield pd.DataFrame(out, columns=schema.names)

    host = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    return requests.select("ord", "url", "referer").repartition(host).mapInPandas(run, schema)


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], config: Config, get: Callable):
        self.urls, self.config, self.get = urls, config, get

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:  # one partition a host keeps the rate limit a local matter
            hosts.setdefault(p.origin if (p := parse(u)) else "", []).append(u)
        return [_Host(v) for v in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        limit = RateLimit(self.config.delay_ms)
        for url in partition.urls:
            status, content, kind, _, retries = attempts(lambda url=url: self.get(url, self.config), self.config, limit)
            yield url, content, kind, status, retries


def page_source(urls: list[str], config: Config, get: Callable = http_get) -> type[DataSource]:
    """Data source that fetches `urls` (S1); `get(url, config) -> (status, bytes, content type)` may be injected."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "quellwerk_pages"

        def schema(self) -> T.StructType:
            return PAGE

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(urls, config, get)

    return Pages


def fetch(spark: SparkSession, urls: list[str], config: Config, get: Callable = http_get):
    """(url, content, content_type, status, retries) of `urls`; failed requests have null content, and a null status if there was no answer."""
    spark.dataSource.register(page_source(urls, config, get))
    return spark.read.format("quellwerk_pages").load()
