"""File operations over any Hadoop file system (local, HDFS, S3A), through the session's JVM."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .layout import SYS


@dataclass
class Store:
    spark: SparkSession
    retries: int = 3

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        """Bytes of a file or of all files below a folder; 0 where there is nothing."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def last_modified(self, path: str) -> float:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def list(self, path: str, files: bool = True) -> list[str]:
        """Names below a folder in order, without ``sys``; all pages of a long listing."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName() != SYS and (files or s.isDirectory()))

    def mkdir(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def touch(self, path: str) -> None:
        fs, p = self._at(path)
        fs.create(p, True).close()

    def write(self, path: str, data: bytes) -> None:
        """A small file, in one go."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, path: str) -> bytes:
        """A small file, as a whole."""
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def claim(self, path: str) -> bool:
        """Makes an empty file; False if it is there already. Of several callers one gets True."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            return fs.createNewFile(p)
        except Exception:
            if fs.exists(p):
                return False
            raise

    def move(self, src: str, dst: str) -> None:
        fs, p = self._at(src)
        if not fs.rename(p, self._at(dst)[1]):
            raise OSError(f"can't move {src} to {dst}")

    def copy(self, src: str, dst: str) -> None:
        (fs, p), (to, q) = self._at(src), self._at(dst)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, self.spark._jsc.hadoopConfiguration())

    def delete(self, path: str, recursive: bool = False) -> None:
        fs, p = self._at(path)
        if fs.exists(p):
            fs.delete(p, recursive)

    def upload(self, local: str, path: str) -> None:
        fs, p = self._at(path)
        for k in range(self.retries):
            try:
                return fs.copyFromLocalFile(False, True, self._at(f"file://{local}")[1], p)
            except Exception:
                if k + 1 == self.retries:
                    raise

    def download(self, path: str, local: str) -> None:
        fs, p = self._at(path)
        fs.copyToLocalFile(False, p, self._at(f"file://{local}")[1], True)

    def lines(self, path: str) -> Iterator[str]:
        """Lines of a text file in any codec that Hadoop knows by its extension. For small files: they come to the driver one by one."""
        for row in self.spark.read.text(path).toLocalIterator():
            yield row.value
