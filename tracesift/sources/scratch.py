"""Where intermediate tables go."""

import atexit
import tempfile
import uuid
import warnings
from contextvars import ContextVar

from pyspark.sql import SparkSession

#: Paths given out within a block whose tables go at its end (``common.passing``).
PASSING: ContextVar[list[str] | None] = ContextVar("PASSING", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    What is written there is removed when the program ends.  Only a local session may go without that
    setting, and is told so; a cluster needs a folder every executor sees.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _own_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    if (passing := PASSING.get()) is not None:
        passing.append(path)
    return path


def _own_folder() -> str:
    warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to a temporary folder", stacklevel=3)
    folder = tempfile.mkdtemp(prefix="tracesift-")
    atexit.register(remove, folder)
    return folder


def file_system(path: str):
    """The file system of a path, for tasks that read files themselves, and the place within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def remove(path: str) -> None:
    """Delete a folder on any file system that can be reached from here; what can't be reached stays."""
    try:
        system, place = file_system(path)
        system.delete_dir(place)
    except (OSError, ValueError):
        pass
