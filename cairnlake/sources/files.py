"""Small files of a shared folder through Hadoop's file systems, so that a lake may stand wherever Spark can read."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


class Folder:
    """A folder by its URI: whole small files are read, created once and listed. No data of tables passes through here."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path("").getFileSystem(self._conf)
        scheme = self._fs.getUri().getScheme()
        self._local = scheme == "file"
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        # An absolute name stands for itself.
        return self._jvm.org.apache.hadoop.fs.Path(name if "/" in name and (name.startswith(self.root) or ":" in name.split("/", 1)[0]) else f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, replace: bool = False) -> None:
        """The file appears whole or not at all; without ``replace`` an existing one raises ``FileExistsError``."""
        temporary, final = self._path(f".{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._local and not replace:
                # A hard link fails if the name exists, whoever made it.
                at = unquote(urlsplit(self._fs.makeQualified(temporary).toString()).path)
                os.link(at, os.path.join(os.path.dirname(at), name))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
                rule = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                rules = self._jvm.java.lang.reflect.Array.newInstance(rule.getClass(), 1)
                rules[0] = rule
                context.rename(temporary, final, rules)
        except FileExistsError:
            raise
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from None
            raise
        finally:
            self._fs.delete(temporary, False)

    def size(self, path: str) -> tuple[int, int]:
        """Data files and bytes below a folder, from file status alone."""
        files = self._fs.listFiles(self._path(path), True)
        count = total = 0
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().endswith(".parquet"):
                count, total = count + 1, total + s.getLen()
        return count, total

    def folders(self, path: str) -> list[tuple[str, int]]:
        """The folders two levels below ``path`` with the time of their last change in milliseconds."""
        found = self._fs.globStatus(self._path(f"{self.root}/{path}/*/*")) or []
        return sorted((str(s.getPath().toString()), s.getModificationTime()) for s in found if s.isDirectory())

    def qualified(self, path: str) -> str:
        return self._fs.makeQualified(self._path(path)).toString()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
