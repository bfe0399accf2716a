"""Small files beside the tables, on any file system that Hadoop knows: listing, manifests, markers."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder with numbered tables (``<prefix><number>``) and numbered manifests of which the latest readable one holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def committed(self, prefix: str, folder: str = "") -> list[int]:
        """Numbers of the tables whose writer has finished."""
        lead = f"{folder}/" if folder else ""
        return [n for n in self.numbers(prefix, folder) if self._fs.exists(self._at(f"{lead}{prefix}{n:09d}/_SUCCESS"))]

    def marked(self, folder: str) -> list[int]:
        """Numbers of the finished tables in ``folder``, by one listing of their markers."""
        found = self._fs.globStatus(self._at(f"{folder}/*/_SUCCESS"))
        names = [s.getPath().getParent().getName() for s in found or []]
        return sorted(int(n) for n in names if n.isdigit())

    def put(self, name: str, content: bytes) -> None:
        """A new file; one that is there is an error."""
        stream = self._fs.create(self._at(name), False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def numbers(self, prefix: str, folder: str = "") -> list[int]:
        """Numbers of all tables, finished or not."""
        return sorted(int(n[len(prefix) :]) for n in self.names(folder) if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def size(self, folder: str = "") -> int:
        at = self._at(folder)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write under another name and rename, so that a reader finds the whole file or none."""
        self._fs.mkdirs(self._at(""))
        draft = self._at(f".{name}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._at(name)):
            raise OSError(f"{self.path}/{name} is there already")

    def manifest(self) -> dict[str, Any] | None:
        """The latest manifest that can be read; its number is in ``number``."""
        for n in reversed([int(x[9:18]) for x in self.names() if x.startswith("manifest-") and x.endswith(".json") and x[9:18].isdigit()]):
            try:
                found = json.loads(self.read(f"manifest-{n:09d}.json") or "")
                return found | {"number": n}
            except ValueError:
                continue
        return None

    def commit(self, content: dict[str, Any]) -> int:
        """Write the next manifest; the two before it stay."""
        numbers = [int(x[9:18]) for x in self.names() if x.startswith("manifest-") and x[9:18].isdigit()]
        n = max(numbers, default=0) + 1
        self.write(f"manifest-{n:09d}.json", json.dumps({k: v for k, v in content.items() if k != "number"}))
        for old in sorted(numbers)[:-2]:
            self._fs.delete(self._at(f"manifest-{old:09d}.json"), False)
        return n
