"""Jobs that several runs share: claims in the shared folder, outputs and markers that appear whole, restart where a run was killed.

A job is a row with a key. Whoever makes its claim file first works on it; the output is written under another name and
renamed, the marker of its end comes after. A claim that is older than ``stale`` seconds belongs to a run that is gone, and is taken away
by a rename, which one of those that try it wins.
"""

from __future__ import annotations

import errno
import hashlib
import os
import re
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "key string, state string, bytes long, error string"
STATES = ("encoded", "skipped", "locked", "failed")


def local(folder: str) -> str:
    """The shared folder as a path: claims need files that are made only if they aren't there, which object stores' clients don't offer."""
    path = re.sub(r"^file:/*", "/", folder)
    if "://" in path:
        raise ValueError("jobs are claimed in a folder of a shared file system (a path or file:)")
    return os.path.abspath(path)


def _name(key: str) -> str:
    """The key as a file name: letters, digits, dots and dashes stay, others are their code; a long one is its digest."""
    name = "".join(c if c.isalnum() and c.isascii() or c in "-." and k else f"_{ord(c):x}_" for k, c in enumerate(key)) or "_"
    return name if len(name) <= 200 else "_sha256_" + hashlib.sha256(key.encode()).hexdigest()


class Claims:
    """The claims, outputs and markers of one folder."""

    def __init__(self, folder: str, stale: float):
        self.folder, self.stale = local(folder), stale
        for part in ("claims", "outputs", "done"):
            os.makedirs(f"{self.folder}/{part}", exist_ok=True)

    def path(self, part: str, key: str) -> str:
        return f"{self.folder}/{part}/{_name(key)}"

    def finished(self, key: str) -> bool:
        """A marker and an output of some bytes."""
        try:
            return os.path.exists(self.path("done", key)) and os.path.getsize(self.path("outputs", key)) > 0
        except OSError:
            return False

    def take(self, key: str) -> bool:
        """Whether the job is now claimed by the caller."""
        path = self.path("claims", key)
        for _ in range(2):
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return True
            except FileExistsError:
                pass
            try:
                if time.time() - os.path.getmtime(path) < self.stale:
                    return False
                gone = f"{self.folder}/claims/.{uuid.uuid4().hex}"
                os.rename(path, gone)
                os.remove(gone)
            except OSError as e:
                if e.errno != errno.ENOENT:
                    raise
        return False

    def give_back(self, key: str) -> None:
        if os.path.exists(self.path("claims", key)):
            os.remove(self.path("claims", key))

    def finish(self, key: str, data: bytes) -> None:
        """Output, then marker, each whole."""
        for part, content in (("outputs", data), ("done", time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()).encode())):
            made = f"{self.folder}/{part}/.{uuid.uuid4().hex}"
            with open(made, "wb") as out:
                out.write(content)
            os.replace(made, self.path(part, key))


def run(jobs: DataFrame, key: str, work: Callable[[dict], bytes], folder: str, stale: float = 3600) -> DataFrame:
    """(key, state, bytes, error) of each row of ``jobs``: the work is done when the result is read, so write it once.

    ``work`` gets a row as a dictionary and returns the output's bytes. ``encoded``: it was done here; ``skipped``: there is a marker and an output
    of some bytes already; ``locked``: another run (or another row of that key) has it; ``failed``: it raised ``error``, its claim is given back. No job
    runs twice at once as long as it takes less than ``stale`` seconds. An output of no bytes is written, but counts as open the next time.
    """

    def one(claims: Claims, row: dict):
        name = str(row[key])
        if claims.finished(name):
            return name, "skipped", os.path.getsize(claims.path("outputs", name)), None
        if not claims.take(name):
            return name, "locked", None, None
        try:
            if claims.finished(name):  # between the look and the claim
                return name, "skipped", os.path.getsize(claims.path("outputs", name)), None
            data = work(row)
            claims.finish(name, data)
            return name, "encoded", len(data), None
        except Exception as e:  # whatever a job raises is its own error, the others go on
            return name, "failed", None, f"{type(e).__name__}: {e}"
        finally:
            claims.give_back(name)

    def each(iterator):
        claims = Claims(folder, stale)
        for batch in iterator:
            rows = [one(claims, row) for row in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["key", "state", "bytes", "error"])

    return jobs.where(F.col(key).isNotNull()).mapInArrow(each, RESULT)


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, done) of the outputs that are there: their sizes, and whether their marker is. No content is read."""
    files = lambda part: spark.read.format("binaryFile").load(f"file://{local(folder)}/{part}").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    return files("outputs").withColumnRenamed("length", "bytes").join(files("done").select("name", F.lit(True).alias("done")), "name", "left").withColumn("done", F.coalesce("done", F.lit(False)))
