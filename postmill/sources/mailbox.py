"""A mailbox as an incremental source: items above a cursor, in ascending order, from JSON lines.

The folder holds one file for each cursor space (validity), named validity-<n>.jsonl. The offset is
(validity, cursor); a new validity starts over at cursor 0, and the reader of the feed drops what it
has seen by id.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .. import _ship  # noqa: F401

SCHEMA = "validity int, uid bigint, message_id string, received_at timestamp, body string"


class MailboxReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, limit: int, tail: bool):
        self.folder, self.limit, self.tail = folder, limit, tail

    def _items(self) -> tuple[int, list[dict]]:
        """The newest cursor space and its items by uid."""
        spaces = sorted(int(n[9:-6]) for n in os.listdir(self.folder) if n.startswith("validity-") and n.endswith(".jsonl"))
        if not spaces:
            return 0, []
        with open(os.path.join(self.folder, f"validity-{spaces[-1]}.jsonl")) as lines:
            return spaces[-1], sorted(map(json.loads, filter(str.strip, lines)), key=lambda x: x["uid"])

    def initialOffset(self) -> dict:
        validity, items = self._items()
        return {"validity": validity, "uid": items[-1]["uid"] if self.tail and items else 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        validity, items = self._items()
        since = start["uid"] if validity == start["validity"] else 0
        new = [x for x in items if x["uid"] > since][: self.limit]
        return iter(self._rows(validity, new)), {"validity": validity, "uid": new[-1]["uid"] if new else since}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        validity, items = self._items()
        since = start["uid"] if end["validity"] == start["validity"] else 0
        return iter(self._rows(validity, [x for x in items if since < x["uid"] <= end["uid"]]))

    def _rows(self, validity: int, items: list[dict]) -> list[tuple]:
        import datetime

        return [(validity, x["uid"], x.get("message_id"), datetime.datetime.fromisoformat(x["received_at"]), x.get("body")) for x in items]


class MailboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: object) -> MailboxReader:
        return MailboxReader(self.options["path"], int(self.options.get("limit", 500)), self.options.get("tail", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MailboxSource)
