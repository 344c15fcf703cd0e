"""A small state that many writers may replace: whole versions in files of their own, each written by one of them."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_NAME = re.compile(r"^(\d{12})\.json$")


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class Versions:
    """The versions of a document in a folder of any store that Spark knows.

    A version is written whole under a name of its own, then put in place under its number if no file has
    that name yet. So a reader never sees a part of one, and of two writers one wins and the other is told.
    What a writer left behind that died in between is never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._files = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._at)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def latest(self) -> int:
        """The number of the last version, 0 without any."""
        found = [_NAME.match(x.getPath().getName()) for x in self._files.listStatus(self._at)]
        return max((int(m[1]) for m in found if m), default=0)

    def read(self, number: int | None = None) -> tuple[int, object]:
        """A version's number and document, by default the last one's; 0 and none without any."""
        number = self.latest() if number is None else number
        if not number:
            return 0, None
        stream = self._files.open(self._path(f"{number:012}.json"))
        try:
            return number, json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, document: object, behind: int) -> int:
        """Writes the version after `behind`, or raises `Conflict` if it exists."""
        part, target = self._path(f".{uuid.uuid4().hex}.part"), self._path(f"{behind + 1:012}.json")
        out = self._files.create(part, False)
        try:
            out.write(bytearray(json.dumps(document, ensure_ascii=False, separators=(",", ":")).encode()))
        finally:
            out.close()
        if self._put(part, target):
            return behind + 1
        self._files.delete(part, False)
        raise Conflict(f"version {behind + 1} exists")

    def _put(self, part, target) -> bool:
        """Names a written file if the name is free, in one step of the store: a link on a local disk, a rename that never replaces elsewhere."""
        if self._files.getUri().getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            self._files.delete(part, False)
            return True
        try:
            self._context.rename(part, target, self._jvm.org.apache.hadoop.fs.Options.Rename.NONE)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        return True

    def update(self, change: Callable[[object], object], tries: int = 50) -> tuple[int, object]:
        """Replaces the last version by what `change` makes of it, again on the next one where another writer was first."""
        for k in range(tries):
            number, document = self.read()
            new = change(document)
            try:
                return self.commit(new, number), new
            except Conflict:
                time.sleep(0.001 * k)
        raise Conflict(f"{tries} versions were written by others meanwhile")
