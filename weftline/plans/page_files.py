"""A Spark data source that writes pages as files, all of them or none."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """How many files one task has written."""

    files: int


class _Writer(DataSourceWriter):
    """Tasks write into a folder beside the target; commit() gives it the target's name in one step.

    A task that runs again, or twice at once, writes the same names: each file
    gets its name only when it is whole, so the last one stands.
    """

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.overwrite = os.path.abspath(path.removeprefix("file://")), overwrite
        if not {"slug", "html"} <= set(columns):
            raise ValueError("pages have a slug and html")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(f"there already is {self.path}")
        # made once, by the driver: a task that still runs when the write is given up can't bring it back
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"
        os.makedirs(self.staged)

    def write(self, rows: Iterator) -> Written:
        n = 0
        for row in rows:
            slug, html = row["slug"], row["html"]
            if not slug or slug in (".", "..") or "/" in slug or "\\0" in slug:
                raise ValueError(f"no file can be named {slug!r}")
            if html is None:
                raise ValueError(f"a page without text: {slug}")
            draft = os.path.join(self.staged, f".{uuid.uuid4().hex}")
            with open(draft, "w", encoding="utf-8", errors="replace", newline="") as f:
                f.write(html)
            os.replace(draft, os.path.join(self.staged, slug))
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        for name in os.listdir(self.staged):  # drafts of tasks that were lost
            if name.startswith(".") and len(name) == 33:
                os.remove(os.path.join(self.staged, name))
        old = None
        if os.path.exists(self.path):
            old = f"{self.path}.old-{uuid.uuid4().hex}"
            os.rename(self.path, old)
        os.rename(self.staged, self.path)
        if old:
            shutil.rmtree(old)

    def abort(self, messages: list[Written | None]) -> None:
        for _ in range(50):  # while other tasks come to their end
            shutil.rmtree(self.staged, ignore_errors=True)
            if not os.path.exists(self.staged):
                return
            time.sleep(0.1)


class PageFiles(DataSource):
    """spark.dataSource.register(PageFiles); pages.write.format("page_files").mode("append").save(folder).

    Writes rows (slug, html) as files of a new folder, which has to be one that
    driver and executors share. With mode overwrite it takes the place of an
    old one. A row that can't be a file (no text, a slug that is no plain
    name) fails the write, and nothing is left of it; of rows that repeat a
    slug one is kept.
    """

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.fieldNames(), overwrite)
