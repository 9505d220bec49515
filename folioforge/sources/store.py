"""Small files in any store that Spark reaches, through its own file system classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder of small files; a file is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, suffix: str = "") -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._at("")))
        return sorted(n for n in found if n.endswith(suffix) and not n.startswith("."))

    def read(self, name: str) -> bytes | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes, replace: bool = True) -> bool:
        """Written under a hidden name, then renamed. Without `replace`, False if the name is taken."""
        hidden = self._at(f".{name}.tmp")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(data))
        stream.close()
        if self._fs.exists(self._at(name)):
            if not replace:
                return False
            self._fs.delete(self._at(name), False)
        return bool(self._fs.rename(hidden, self._at(name)))
