"""Published versions of a model, and a pointer to the newest one."""

from __future__ import annotations

from pyspark.sql import SparkSession

from topicloom.operators.classifier import TopicModel

_POINTER = "_current"


class PublishedModels:
    """Models below a folder of the shared file system, one folder per version.

    ``publish`` saves a model under the next number and then moves the pointer to it by a
    rename, so a reader sees the old version or the whole new one. Versions stay; a
    stream may still be at work with an older one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._loaded: tuple[int, TopicModel] | None = None

    def publish(self, model: TopicModel) -> int:
        """Save a model as the newest version, and tell its number."""
        version = (self.version() or 0) + 1
        model.save(self._folder(version))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        pointer, written = path(f"{self.root}/{_POINTER}"), path(f"{self.root}/{_POINTER}-{version}")
        files = pointer.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        stream = files.create(written, True)
        try:
            stream.writeUTF(str(version))
        finally:
            stream.close()
        # Some file systems do not rename onto a file; then a reader finds the numbered one.
        if not files.rename(written, pointer):
            files.delete(pointer, False)
            files.rename(written, pointer)
        return version

    def version(self) -> int | None:
        """The newest version, read from the pointer; None if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        pointer = path(f"{self.root}/{_POINTER}")
        files = pointer.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # Between the two renames of ``publish`` only the numbered file is there.
        there = [pointer] if files.exists(pointer) else [
            status.getPath() for status in files.globStatus(path(f"{self.root}/{_POINTER}-*")) or ()]
        numbers = []
        for place in there:
            stream = files.open(place)
            try:
                numbers.append(int(stream.readUTF()))
            finally:
                stream.close()
        return max(numbers, default=None)

    def latest(self) -> tuple[int, TopicModel]:
        """(version, model); the model is loaded again only when the pointer has moved."""
        version = self.version()
        if version is None:
            raise ValueError(f"no model is published below {self.root}")
        if self._loaded is None or self._loaded[0] != version:
            self._loaded = version, TopicModel.load(self.spark, self._folder(version))
        return self._loaded

    def _folder(self, version: int) -> str:
        return f"{self.root}/version={version}"
