"""Small files of metadata on local disks or any store that Hadoop knows."""

from __future__ import annotations

import gzip
import os
import re

from pyspark.sql import SparkSession


class AlreadyExists(FileExistsError):
    pass


def resolve(path: str, location: str | None = None) -> str:
    """A plain path or URI: relative ones are under ``location``, ``file:`` prefixes go, other schemes stay."""
    path = path.replace("\\", "/")
    if m := re.match(r"file:(?://)?(/.*)$", path):
        return re.sub(r"^/+", "/", m[1])
    if "://" in path or path.startswith("/") or re.match(r"[A-Za-z]:/", path):
        return path
    if not location:
        return path
    base = resolve(location).rstrip("/")
    return f"{base}/{path.removeprefix('./')}" if path else base


class FileIO:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @staticmethod
    def _local(path: str) -> bool:
        return "://" not in path

    def read(self, path: str) -> str:
        """A text, which may be packed."""
        data = self.read_bytes(path)
        return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()

    def read_bytes(self, path: str) -> bytes:
        path = resolve(path)
        if self._local(path):
            with open(path, "rb") as f:
                return f.read()
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, path: str, content: str | bytes) -> None:
        """Write a new file; AlreadyExists if there is one. This is what decides between concurrent commits."""
        path = resolve(path)
        data = content.encode() if isinstance(content, str) else content
        if self._local(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            draft = f"{path}.{os.getpid()}.{id(data)}.tmp"
            with open(draft, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, path)  # atomic, fails if the name is taken, and never shows half a file
            except FileExistsError as e:
                raise AlreadyExists(path) from e
            finally:
                os.unlink(draft)
            return
        fs, p = self._fs(path)
        if fs.exists(p):
            raise AlreadyExists(path)
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        path = resolve(path)
        if self._local(path):
            draft = f"{path}.{os.getpid()}.{id(text)}.tmp"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(draft, path)
            return
        fs, p = self._fs(path)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def exists(self, path: str) -> bool:
        path = resolve(path)
        if self._local(path):
            return os.path.exists(path)
        fs, p = self._fs(path)
        return fs.exists(p)

    def folders(self, path: str) -> list[str]:
        path = resolve(path)
        if self._local(path):
            return sorted(e.name for e in os.scandir(path) if e.is_dir()) if os.path.isdir(path) else []
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def files(self, path: str) -> list[str]:
        path = resolve(path)
        if self._local(path):
            return sorted(e.name for e in os.scandir(path) if e.is_file()) if os.path.isdir(path) else []
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []

    def size(self, path: str) -> int:
        path = resolve(path)
        if self._local(path):
            return os.path.getsize(path)
        fs, p = self._fs(path)
        return fs.getFileStatus(p).getLen()

    def delete(self, path: str) -> None:
        fs, p = self._fs(resolve(path))
        fs.delete(p, True)

    def rename(self, path: str, to: str) -> None:
        fs, p = self._fs(resolve(path))
        _, q = self._fs(resolve(to))
        if not fs.rename(p, q):
            raise OSError(f"cannot rename {path} to {to}")
