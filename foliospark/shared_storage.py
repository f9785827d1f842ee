"""Paths on the storage that driver and executors share."""

from __future__ import annotations

import re
import threading
import time
import uuid

from pyspark.sql import SparkSession


# What a folder's name ends in while another one takes its place.
_REPLACED = ".replaced"


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if just ``path`` is there, on whatever file system its scheme names."""
    files, hadoop_path = _file_system(spark, path)
    return bool(files.exists(hadoop_path))


def has_folder(spark: SparkSession, path: str, prefix: str = "") -> bool:
    """True if something in the folder ``path`` has a name that starts with ``prefix``.

    The listing ends at the first that has.
    """
    files, hadoop_path = _file_system(spark, path)
    if not files.exists(hadoop_path) or not files.getFileStatus(hadoop_path).isDirectory():
        return False
    listing = files.listStatusIterator(hadoop_path)
    while listing.hasNext():
        if listing.next().getPath().getName().startswith(prefix):
            return True
    return False


def write_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Put a small text file into ``folder``; readers see it whole or not at all."""
    files, target = _file_system(spark, f"{folder.rstrip('/')}/{name}")
    _, hidden = _file_system(spark, f"{folder.rstrip('/')}/_{name}")
    out = files.create(hidden, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(hidden, target):
        raise OSError(f"{folder}/{name} is there already")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of its file system, and from its root."""
    files, hadoop_path = _file_system(spark, path)
    return files.makeQualified(hadoop_path).toString()


def _renamed(files, old, new) -> bool:
    """Some file systems say no, others raise."""
    try:
        return bool(files.rename(old, new))
    except Exception:
        return False


def replace_folder(spark: SparkSession, new: str, target: str) -> None:
    """Put the finished folder ``new`` in the place of ``target``, next to which it lies.

    The old folder is renamed before the new one takes its name, and deleted last; a query that has begun to
    read it may miss its files then. A process that is
    lost between the two renames leaves the old one beside its place, and :func:`restore_folder`
    brings it back.
    """
    files, source = _file_system(spark, new)
    _, place = _file_system(spark, target)
    _, aside = _file_system(spark, f"{target.rstrip('/')}{_REPLACED}")
    if files.exists(place):
        files.delete(aside, True)
        if not _renamed(files, place, aside):
            raise OSError(f"{target} cannot be renamed")
    if not _renamed(files, source, place):
        if files.exists(aside):
            _renamed(files, aside, place)
        raise OSError(f"{new} cannot be renamed to {target}")
    files.delete(aside, True)


def restore_folder(spark: SparkSession, target: str) -> bool:
    """Bring back what a lost :func:`replace_folder` left beside ``target``; true if there was such a thing."""
    files, place = _file_system(spark, target)
    _, aside = _file_system(spark, f"{target.rstrip('/')}{_REPLACED}")
    return bool(not files.exists(place) and files.exists(aside) and _renamed(files, aside, place))


def delete_folder(spark: SparkSession, path: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


class Claim:
    """A file that one of several processes holds: who creates it has the claim.

    Its holder renews it by a thread as long as it lives. A claim not renewed for ``lease`` seconds
    is stale, and who renames it first takes it over. Times are those of the storage.
    """

    def __init__(self, spark: SparkSession, path: str, lease: float):
        self.spark, self.path, self.lease = spark, path, lease
        self.owner = uuid.uuid4().hex
        self._done = threading.Event()

    def take(self) -> bool:
        """True if the claim is ours now."""
        files, place = _file_system(self.spark, self.path)
        if not self._create(files, place):
            holder = self._holder(files, place)
            if holder is None or not self._stale(files, place):
                return False
            _, aside = _file_system(self.spark, f"{self.path}.{self.owner}")
            if not _renamed(files, place, aside):
                return False  # another one was faster
            taken = self._holder(files, aside)
            if taken != holder:  # it was renewed by a new holder meanwhile: give it back
                _renamed(files, aside, place)
                return False
            files.delete(aside, False)
            if not self._create(files, place):
                return False
        threading.Thread(target=self._renew, daemon=True).start()
        return True

    def release(self) -> None:
        self._done.set()
        files, place = _file_system(self.spark, self.path)
        if self._holder(files, place) == self.owner:
            files.delete(place, False)

    def _create(self, files, place) -> bool:
        try:
            out = files.create(place, False)
        except Exception:
            if files.exists(place):
                return False
            raise
        try:
            out.write(bytearray(self.owner.encode()))
        finally:
            out.close()
        return True

    def _holder(self, files, place) -> str | None:
        try:
            stream = files.open(place)
        except Exception:
            return None
        try:
            found = bytearray()
            while (value := stream.read()) >= 0:
                found.append(value)
            return found.decode()
        finally:
            stream.close()

    def _stale(self, files, place) -> bool:
        try:
            renewed = files.getFileStatus(place).getModificationTime()
        except Exception:
            return False
        return time.time() * 1000 - renewed > self.lease * 1000

    def _renew(self) -> None:
        files, place = _file_system(self.spark, self.path)
        while not self._done.wait(self.lease / 4):
            try:
                files.setTimes(place, int(time.time() * 1000), -1)
            except Exception:
                return  # the session has ended or the claim is lost


def literal_path(path: str) -> str:
    """``path`` for a reader that would take ``*``, ``[1]`` and the like as patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the cluster's ``spark.checkpoint.dir``.

    Where that is unset it is below ``spark.sql.warehouse.dir``, which every session has
    and a cluster keeps on shared storage.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
