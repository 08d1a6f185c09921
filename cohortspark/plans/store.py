"""Publication of a set of files to any store that Hadoop knows, whole or not at all.

A set is written to a folder of its own; then a manifest that names the set,
its files and their digests takes the place of the one before by one rename,
which is the moment of publication.  Readers follow the manifest.  A run that
is killed leaves the old manifest with its whole set, or the new one with its;
what else it leaves, the next run clears.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"
_SETS = "sets"


class Store:
    """A folder of a Hadoop file system: ``file:``, ``hdfs:``, ``viewfs:`` or an object store."""

    def __init__(self, spark: SparkSession, url: str) -> None:
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self._jvm.org.apache.hadoop.fs.Path(url)
        self._fs = self.root.getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.root, name)

    def write(self, name: str, data: bytes) -> None:
        """A new file, with the folders it lies in; complete when this returns."""
        out = self._fs.create(self.path(name), False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, name: str) -> bytes | None:
        if not self._fs.exists(self.path(name)):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Rename, also over a file that is there, in one step."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self._conf)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        qualified = [self._fs.makeQualified(self.path(x)) for x in (source, target)]
        context.rename(*qualified, options)

    def names(self, folder: str = "") -> list[str]:
        where = self.path(folder) if folder else self.root
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


def publish(spark: SparkSession, files: Mapping[str, str], url: str) -> str:
    """Write the files as a new set and make it the published one; the set's name.

    Only one run publishes to a folder at a time.
    """
    if not files or any("/" in n or n.startswith(".") for n in files):
        raise ValueError("files must have plain names")
    store, own = Store(spark, url), uuid.uuid4().hex
    digests = {}
    for name, text in files.items():
        data = text.encode()
        store.write(f"{_SETS}/{own}/{name}", data)
        digests[name] = hashlib.sha256(data).hexdigest()
    # a file system may hide names that begin with a point or a line; this one is temporary
    store.write(f"{MANIFEST}.{own}", (json.dumps({"set": own, "files": digests}, indent=2, sort_keys=True) + "\n").encode())
    store.replace(f"{MANIFEST}.{own}", MANIFEST)
    clear(store, own)
    return own


def clear(store: Store, current: str) -> None:
    """Delete other sets, and manifests that were never put in place."""
    for name in store.names(_SETS):
        if name != current:
            store.delete(f"{_SETS}/{name}")
    for name in store.names():
        if name.startswith(f"{MANIFEST}."):
            store.delete(name)


def published(spark: SparkSession, url: str) -> dict[str, str] | None:
    """The published files, or None before the first publication; fails on a file that is not as it was published."""
    store = Store(spark, url)
    raw = store.read(MANIFEST)
    if raw is None:
        return None
    manifest = json.loads(raw)
    out = {}
    for name, digest in manifest["files"].items():
        data = store.read(f"{_SETS}/{manifest['set']}/{name}")
        if data is None or hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"{name} is not as it was published")
        out[name] = data.decode()
    return out
