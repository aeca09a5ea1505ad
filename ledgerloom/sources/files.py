"""Small file-system operations on any Hadoop URI. Only names and sizes reach the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._open(path)
        return fs.exists(target)

    def size(self, path: str) -> int:
        """Bytes under a file or folder; 0 when it does not exist."""
        fs, target = self._open(path)
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0

    def largest(self, path: str) -> int:
        """Bytes of the largest file in a folder (or of the file itself)."""
        fs, target = self._open(path)
        return max((s.getLen() for s in fs.listStatus(target) if s.isFile()), default=0)

    def count(self, path: str) -> int:
        """Number of files in a folder (1 for a file)."""
        fs, target = self._open(path)
        return sum(s.isFile() for s in fs.listStatus(target))

    def names(self, folder: str) -> list[str]:
        fs, target = self._open(folder)
        if not fs.exists(target):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(target))
        return sorted(name for name in names if not name.startswith("."))

    def move(self, source: str, target: str) -> None:
        """Rename, replacing the target. No data passes through this process.

        An old target is set aside under a hidden name until the new one is in place: whatever
        breaks off, one of the two is there whole.
        """
        fs, src = self._open(source)
        _, dst = self._open(target)
        fs.mkdirs(dst.getParent())
        aside = None
        if fs.exists(dst):
            aside = self._jvm.org.apache.hadoop.fs.Path(dst.getParent(), f".{dst.getName()}.{uuid.uuid4().hex}")
            if not fs.rename(dst, aside):
                raise OSError(f"cannot set {target} aside")
        if not fs.rename(src, dst):
            if aside is not None:
                fs.rename(aside, dst)
            raise OSError(f"cannot move {source} to {target}")
        if aside is not None:
            fs.delete(aside, True)

    def modified(self, path: str) -> float:
        """When a file was written, in seconds."""
        fs, target = self._open(path)
        return fs.getFileStatus(target).getModificationTime() / 1000

    def uri_path(self, path: str) -> str:
        """The path part of a URI, escaped as in Spark's names of files."""
        return self._jvm.org.apache.hadoop.fs.Path(path).toUri().getRawPath()

    def make_folder(self, path: str) -> None:
        fs, target = self._open(path)
        fs.mkdirs(target)

    def remove(self, path: str) -> bool:
        fs, target = self._open(path)
        return fs.delete(target, True) if fs.exists(target) else False

    def write_marker(self, path: str, text: str) -> None:
        fs, target = self._open(path)
        out = fs.create(target, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def put_new(self, path: str, text: str) -> bool:
        """Make a small file appear whole under a name that nobody has yet; False if somebody has it.

        Of two writers of one name exactly one succeeds. On a local disk that is a hard link, elsewhere
        a rename, which HDFS refuses when the name exists.
        """
        fs, target = self._open(path)
        fs.mkdirs(target.getParent())
        aside = f"{target.getParent()}/.{target.getName()}.{uuid.uuid4().hex}"
        self.write_marker(aside, text)
        try:
            if fs.getScheme() != "file":
                return fs.rename(self._open(aside)[1], target)
            link = getattr(self._jvm.java.nio.file.Files, "createLink")
            link(self._local(path), self._local(aside))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self.remove(aside)

    def _local(self, path: str):
        return self._jvm.java.nio.file.Paths.get(self._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath(), self._none())

    def _none(self):
        return self._gateway.new_array(self._jvm.java.lang.String, 0)

    def read_marker(self, path: str) -> str:
        """Text of a marker file (a timestamp, so a few bytes)."""
        fs, target = self._open(path)
        stream = fs.open(target)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
