"""REST services for Spark, by its Python data source API: paged scans, lookups by key, and one answer for each row.

    spark.dataSource.register(PagedRest)
    spark.read.format("paged_rest").options(url=..., pages=...).load()

A page is a partition. Rows are (page, pos, item, status, error): item is the JSON text of one element, or of the whole answer if
that is no list.

    spark.dataSource.register(KeyedRest)
    spark.read.format("keyed_rest").options(url="https://host/items/{key}").load().filter("key IN ('a', 'b')")

Rows are (key, item, status, error), for the keys that the filters name; without such a filter there are no keys to ask for, which
is an error. It needs spark.sql.python.filterPushdown.enabled. Load anew for each lookup: of a DataFrame that is used again without
any filter, Spark keeps the keys of the last time. Where keys are rows, `answers` asks for each.

A fetch function by name can stand in for the network, as tests do.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

PER_PAGE = 100
TIMEOUT = 30
SCHEMA = "page int, pos int, item string, status int, error string"
KEYED_SCHEMA = "key string, item string, status int, error string"
#: Keys of a partition of a lookup.
KEYS = 100


def error_of(status: int | None) -> int | None:
    """As functions.http.error_status, for one answer."""
    if status is None:
        return 502
    if status in (401, 403, 404):
        return status
    return 502 if status >= 400 else None


def fetch(url: str, headers: dict[str, str], timeout: float, data: bytes | None = None) -> tuple[int | None, dict[str, str], str]:
    """(status, headers, body) of a GET, or a POST with data; no status if the connection fails."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, {}, e.read().decode(errors="replace")
    except OSError as e:
        return None, {}, str(e)


def named(name: str | None):
    """The function `module:function`; fetch by default."""
    if not name:
        return fetch
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def page_rows(page: int, status: int | None, body: str) -> Iterator[tuple]:
    if (error := error_of(status)) is not None:
        yield page, 0, None, status, f"{error}: {body}"
        return
    value = json.loads(body)
    for pos, item in enumerate(value if isinstance(value, list) else [value]):
        yield page, pos, json.dumps(item, ensure_ascii=False), status, None


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.pages = options["url"].rstrip("/"), int(options.get("pages", 0))
        self.headers = json.loads(options.get("headers", "{}"))
        self.per_page, self.timeout, self.fetch = int(options.get("per_page", PER_PAGE)), float(options.get("timeout", TIMEOUT)), options.get("fetch")

    def partitions(self) -> list[_Page]:
        return [_Page(p) for p in range(1, self.pages + 1)] if self.pages else [_Page(0)]

    def _get(self, page: int):
        at = "&" if "?" in self.url else "?"
        return named(self.fetch)(f"{self.url}{at}{urllib.parse.urlencode({'page': page, 'per_page': self.per_page})}", self.headers, self.timeout)

    def read(self, partition: _Page) -> Iterator[tuple]:
        """A known page; or, where their number isn't known, all pages one after the other, as the server's headers name them."""
        page = partition.page or 1
        while True:
            status, headers, body = self._get(page)
            rows = list(page_rows(page, status, body))
            yield from rows
            after = headers.get("x-next-page")
            if partition.page or not rows or rows[-1][4] or not after:
                return
            page = int(after)


def posted_as(headers: dict[str, str], url: str, body: bytes, key: str = "") -> dict[str, str]:
    """Headers with a key that is the same when a task is tried again, by which a service that knows it drops the second post."""
    return headers | {"Idempotency-Key": hashlib.sha256(b"\0".join([key.encode(), url.encode(), body])).hexdigest()}


class _Writer(DataSourceWriter):
    """Posts each row's body to the row's path. Posts can't be taken back: all rows are tried, then what failed is said.

    Where each row's outcome is needed, use `answers`.
    """

    def __init__(self, options: dict):
        self.url, self.headers, self.fetch = options["url"].rstrip("/"), json.loads(options.get("headers", "{}")), options.get("fetch")
        self.timeout = float(options.get("timeout", TIMEOUT))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        post, failed, first = named(self.fetch), 0, ""
        for row in rows:
            url, data = f"{self.url}{row.path}", row.body.encode()
            status, _, body = post(url, posted_as(self.headers, url, data), self.timeout, data)
            if (error := error_of(status)) is not None:
                failed, first = failed + 1, first or f"{error}: {body}"
        if failed:
            raise RuntimeError(f"{failed} posts failed, the first with {first}")
        return WriterCommitMessage()


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _KeyedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.headers, self.fetch = options["url"], json.loads(options.get("headers", "{}")), options.get("fetch")
        self.timeout, self.keys = float(options.get("timeout", TIMEOUT)), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and lists of keys are asked for and hold of all rows; what is left, Spark applies."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.keys = [k for k in dict.fromkeys(wanted) if k is not None and (self.keys is None or k in self.keys)]
            else:
                yield f

    def partitions(self) -> list[_Keys]:
        if self.keys is None:
            raise ValueError("a lookup needs a filter that names its keys")
        return [_Keys(self.keys[i : i + KEYS]) for i in range(0, len(self.keys), KEYS)] or [_Keys([])]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        for key in partition.keys:
            url = self.url.replace("{key}", urllib.parse.quote(str(key), safe=""))
            status, _, body = named(self.fetch)(url, self.headers, self.timeout)
            error = error_of(status)
            yield key, None if error else body, status, f"{error}: {body}" if error else None


def answers(rows: DataFrame, url: str, headers: str = "{}", fetch: str | None = None, timeout: float = TIMEOUT, path: str = "path", body: str | None = None, key: list[str] | None = None) -> DataFrame:
    """rows with status, answer, error_status and error of a GET of each row's path, or a POST of its body if that column is named.

    A failure is its row's alone. Each evaluation asks again, so that the result of posts must be stored once and read from there; a
    task that is tried again sends the same Idempotency-Key for a row. Rows that are alike share that key unless columns that tell
    them apart are named by `key`. A null path is not asked for: its status is null and its error says so. Columns named like the
    new ones are replaced.
    """
    base, new = url.rstrip("/"), ("status", "answer", "error_status", "error")
    rows, common = rows.drop(*new), json.loads(headers)

    def one(at: str | None, text: str | None, ident: str) -> tuple:
        if at is None:
            return None, None, 502, "502: no path"
        data = None if body is None else (text or "").encode()
        sent = common if data is None else posted_as(common, base + at, data, ident)
        status, _, got = named(fetch)(base + at, sent, timeout, data)
        error = error_of(status)
        return status, None if error else got, error, f"{error}: {got}" if error else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = lambda c: [None if pd.isna(x) else x for x in batch[c]]
            texts = plain(body) if body is not None else [None] * len(batch)
            idents = ["\0".join(map(str, x)) for x in zip(*[batch[k] for k in key], strict=True)] if key else [""] * len(batch)
            got = [one(*x) for x in zip(plain(path), texts, idents, strict=True)]
            columns = zip(*got, strict=True) if got else [[]] * 4
            out = batch.assign(**{n: pd.Series(list(c), index=batch.index, dtype=object) for n, c in zip(new, columns, strict=True)})
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, status int, answer string, error_status int, error string")


class KeyedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_rest"

    def schema(self) -> str:
        return KEYED_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _KeyedReader(self.options)


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
