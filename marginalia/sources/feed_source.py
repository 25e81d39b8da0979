"""

A feed is scrolled from its newest post downwards, again and again. Each session is a pull, a folder `pull=<number>/feed=<name>` of JSON lines, one a page:
`{"page": 3, "status": 200, "items": [{"id": "7", "body": "..."}]}`. Offsets are the number of the last pull of each feed, so the checkpoint is the cursor (T2), and every pull of
every feed is a partition of its own. A partition ends at the first page with a known post (T1), after a few pages without posts, or with its pull. What is known: the first page of the feed's
pull before, and, where the option `known` names a table, its ids.

A page with status 429 makes the partition wait, longer each time, up to a budget (T9, F26); beyond it, or at 401 and 403, the task fails, so that the batch is not written and its offset
not committed (T4): a pull is whole or absent. Executors do the waiting; other feeds go on meanwhile.

For a live feed, override `pulls` and `pages`.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from marginalia.storage import in_tasks

#: Pages without posts that end a pull, waits a pull may take.
MAX_IDLE, MAX_BACKOFFS = 4, 3
SCHEMA = "feed string, pull long, page long, place int, id string, body string"


class FeedTruncated(RuntimeError):
    """A pull that was cut short; nothing of it may be kept."""


def scroll(pages: Iterable[dict], known: Callable[[list[str]], set[str]], wait: Callable[[int], None], max_backoffs: int = MAX_BACKOFFS, max_idle: int = MAX_IDLE) -> Iterator[tuple[int, int, str, str | None]]:
    """(page, place, id, body) of the posts that aren't known (S8, T1, T9). Unknown posts of the page with the first known one are still taken."""
    used = idle = 0
    for page in pages:
        status = page.get("status", 200)
        if status == 429:
            if used >= max_backoffs:
                raise FeedTruncated(f"rate limit after {used} waits")
            used += 1
            wait(used)
            continue
        if status in (401, 403):
            raise FeedTruncated(f"status {status}")
        items = page.get("items") or []
        had = known([i["id"] for i in items]) if items else set()
        yield from ((page["page"], place, i["id"], i.get("body")) for place, i in enumerate(items) if i["id"] not in had)
        if had:
            return
        idle = 0 if items else idle + 1
        if idle >= max_idle:
            return


class PullPartition(InputPartition):
    def __init__(self, feed: str, pull: int, earlier: list[int]) -> None:
        super().__init__((feed, pull))
        self.feed, self.pull, self.earlier = feed, pull, earlier


class FeedReader(DataSourceStreamReader):
    """Options: path, known, waitSeconds (60), maxBackoffs, maxIdle, and lookBack (3), how many pulls back a first page with posts is looked for."""

    def __init__(self, options: dict[str, str]) -> None:
        given = {name.lower(): value for name, value in options.items()}
        self.root, self.known = given["path"], given.get("known")
        self.max_backoffs, self.max_idle = int(given.get("maxbackoffs", MAX_BACKOFFS)), int(given.get("maxidle", MAX_IDLE))
        self.wait_seconds, self.look_back = float(given.get("waitseconds", 60)), int(given.get("lookback", 3))

    # --- what a live feed overrides

    def pulls(self) -> dict[str, list[int]]:
        """The numbers of each feed's finished pulls. A pull is finished when its folder, or the whole one, is marked as written."""
        files, root = in_tasks(self.root)
        found: dict[str, list[int]] = {}
        all_done = files.get_file_info(f"{root}/_SUCCESS").type == fs.FileType.File
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            number = re.fullmatch(r"pull=(\d+)", info.base_name)
            if number and (all_done or files.get_file_info(f"{info.path}/_SUCCESS").type == fs.FileType.File):
                for feed in files.get_file_info(fs.FileSelector(info.path)):
                    if feed.base_name.startswith("feed="):
                        found.setdefault(feed.base_name[5:], []).append(int(number[1]))
        return {feed: sorted(numbers) for feed, numbers in found.items()}

    def pages(self, feed: str, pull: int) -> list[dict]:
        files, root = in_tasks(self.root)
        folders = [i.path for i in files.get_file_info(fs.FileSelector(root)) if re.fullmatch(rf"pull=0*{pull}", i.base_name)]
        lines = []
        for folder in folders:
            for info in files.get_file_info(fs.FileSelector(f"{folder}/feed={feed}")):
                if info.base_name.endswith((".json", ".jsonl", ".txt")):
                    with files.open_input_stream(info.path) as f:
                        lines += f.read().splitlines()
        return sorted(map(json.loads, lines), key=lambda p: p["page"])

    # --- offsets and partitions

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {feed: numbers[-1] for feed, numbers in self.pulls().items()}

    def partitions(self, start: dict, end: dict) -> list[PullPartition]:
        made = []
        for feed, numbers in self.pulls().items():
            due = [n for n in numbers if start.get(feed, -1) < n <= end.get(feed, -1)]
            made += [PullPartition(feed, n, [m for m in numbers if m < n][-self.look_back :]) for n in due]
        return made

    # --- on the executors

    def read(self, partition: PullPartition) -> Iterator[tuple]:
        tops: set[str] = set()
        for earlier in reversed(partition.earlier):
            first = next((p for p in self.pages(partition.feed, earlier) if p.get("items")), None)
            if first:
                tops = {i["id"] for i in first["items"]}
                break

        def known(ids: list[str]) -> set[str]:
            had = tops.intersection(ids)
            if self.known:
                files, path = in_tasks(self.known)
                table = ds.dataset(path, filesystem=files, format="parquet").to_table(["id"], filter=ds.field("id").isin(ids))
                had |= set(table.column("id").to_pylist())
            return had

        wait = lambda n: time.sleep(self.wait_seconds * n)
        for page, place, key, body in scroll(self.pages(partition.feed, partition.pull), known, wait, self.max_backoffs, self.max_idle):
            yield (partition.feed, partition.pull, page, place, key, body)


class FeedSource(DataSource):
    """spark.dataSource.register(FeedSource); spark.readStream.format("feed").option("path", ...)"""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))
