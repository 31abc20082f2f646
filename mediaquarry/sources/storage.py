"""The folder that a cluster shares, for checkpoints and stored indexes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; under a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="mediaquarry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = Path(folder).as_uri()
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/mediaquarry/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder; one that can't be removed is left behind."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter
        return


def for_session(spark: SparkSession, name: str) -> str:
    """A fresh path whose folder is removed when the driver ends."""
    path = fresh(spark, name)
    atexit.register(remove, spark, path)
    return path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once; no setting of the session changes."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="mediaquarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "mediaquarry_all.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def _where(spark: SparkSession, path: str):
    """A path and its file system, as the JVM has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it is missing."""
    where, files = _where(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of all files below a folder; 0 where it is missing."""
    where, files = _where(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    where, files = _where(spark, path)
    stream = files.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and give it its own by a rename; raises where a file has it already."""
    where, files = _where(spark, path)
    hidden, _ = _where(spark, f"{path}.{uuid.uuid4().hex}.new")
    stream = files.create(hidden, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(where) or not files.rename(hidden, where):
        files.delete(hidden, False)
        raise FileExistsError(path)
