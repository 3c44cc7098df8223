"""Saved answers of post APIs as a Spark data source: ``spark.read.format("saved_posts")`` and ``readStream``.

Files hold one JSON object a line. Each file is read in stretches of bytes, one partition each; lines belong to
the stretch that they begin in. A platform names where its fields stand; further ones may be given as options.
Filters on days, authors and channels are applied while reading.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import operator
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "post_id string, author string, channel string, content string, publish_date timestamp, url string"
_ARROW = pa.schema([(c, pa.timestamp("us", "UTC") if c == "publish_date" else pa.string()) for c in ("post_id", "author", "channel", "content", "publish_date", "url")])
# Where each platform's answers hold the fields of a post (a path of names; the first that is there counts).
PLATFORMS = {
    "generic": {"post_id": "post_id|id", "author": "author", "channel": "channel|author", "content": "content|text", "publish_date": "publish_date|date", "url": "url"},
    "reddit": {"post_id": "id", "author": "author", "channel": "subreddit", "content": "selftext|body|title", "publish_date": "created_utc", "url": "full_link|url"},
    "twitter": {"post_id": "id_str|id", "author": "user.screen_name", "channel": "user.screen_name", "content": "full_text|text", "publish_date": "created_at", "url": "url"},
}
#: Bytes of a stretch.
STRETCH = 32 << 20


class Stretch(NamedTuple):
    path: str
    start: int
    end: int


class _Part(InputPartition):
    def __init__(self, stretch: Stretch):
        super().__init__(tuple(stretch))


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files under a path of any store that Arrow knows, in order; names that begin with a mark are no data."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    found = [i for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file] if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
    return sorted((i.path, i.size) for i in found if i.is_file and i.base_name[0] not in "._")


def _day(value) -> dt.datetime | None:
    """A time from seconds, an ISO text or the long form of some platforms; without a zone it is UTC."""
    if value is None:
        return None
    try:
        if isinstance(value, int | float) or str(value).replace(".", "", 1).isdigit():
            return dt.datetime.fromtimestamp(float(value), dt.UTC)
        try:
            at = dt.datetime.fromisoformat(str(value))
        except ValueError:
            at = dt.datetime.strptime(str(value), "%a %b %d %H:%M:%S %z %Y")
        return at if at.tzinfo else at.replace(tzinfo=dt.UTC)
    except (ValueError, OverflowError):
        return None


def _field(post: dict, names: str):
    for name in names.split("|"):
        at = post
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


#: How a filter compares; one that only asks for a value has none.
_OPS = {IsNotNull: None, EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class _Keep(NamedTuple):
    column: str
    compare: Callable | None
    value: object

    def holds(self, row: dict) -> bool:
        own = row[self.column]
        return own is not None and (self.compare is None or self.compare(own, self.value))


def _keep(f: Filter) -> _Keep | None:
    if len(f.attribute) != 1 or f.attribute[0] not in ("post_id", "author", "channel", "publish_date"):
        return None
    if type(f) not in _OPS:
        return None
    value = getattr(f, "value", None)
    return _Keep(f.attribute[0], _OPS[type(f)], value.astimezone(dt.UTC) if isinstance(value, dt.datetime) else value)


def _posts(stretch: Stretch, fields: dict[str, str], keeps: list[_Keep]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    uri = stretch.path
    store, at = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    rows: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    with store.open_input_file(at) as raw:
        at = max(0, stretch.start - 1)
        raw.seek(at)
        file = io.BufferedReader(raw, 1 << 16)
        if stretch.start:
            at += len(file.readline())  # the line that another stretch holds
        while at < stretch.end and (line := file.readline()):
            at += len(line)
            try:
                post = json.loads(line)
            except ValueError:
                continue
            row = {c: _field(post, names) for c, names in fields.items()} if isinstance(post, dict) else None
            if row is None or row["content"] is None:
                continue
            row = {c: _day(v) if c == "publish_date" else None if v is None else str(v) for c, v in row.items()}
            if all(k.holds(row) for k in keeps):
                rows.append(row)
            if len(rows) == 4096:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fields, self.keeps, self.size = options["path"], _fields(options), [], int(options.get("stretch", STRETCH))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters that it can apply and gives the others back."""
        for f in filters:
            keep = _keep(f)
            if keep is None:
                yield f
            else:
                self.keeps.append(keep)

    def partitions(self) -> list[InputPartition]:
        return [_Part(Stretch(path, a, min(a + self.size, size))) for path, size in _files(self.path) for a in range(0, size, self.size)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _posts(Stretch(*partition.value), self.fields, self.keeps)


class _StreamReader(DataSourceStreamReader):
    """New files, in the order of their names; an offset is how many have been read."""

    def __init__(self, options: dict):
        self.path, self.fields = options["path"], _fields(options)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(Stretch(path, 0, size)) for path, size in _files(self.path)[start["files"] : end["files"]]]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _posts(Stretch(*partition.value), self.fields, [])


def _fields(options: dict) -> dict[str, str]:
    """Of the platform, with options such as ``field_content`` in their place."""
    own = PLATFORMS[options.get("platform", "generic")]
    return {c: options.get(f"field_{c}", names) for c, names in own.items()}


class SavedPosts(DataSource):
    """Options: path, platform (generic, reddit, twitter), stretch (bytes), and ``field_<column>`` for paths of one's own.

    Lines that are no JSON object or hold no content are left out; a date that cannot be read is null.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_posts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark) -> None:
    """Make the source known to the session and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedPosts)
