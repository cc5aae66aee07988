"""A sink for document stores: tasks send chunks, the driver commits all of them or none.

A store is an object with ``begin(load)``, ``put(load, task, number, documents)`` for a chunk, ``commit(load, told, purge)``
with what the puts gave, and ``abort(load, told)``. ``begin``, ``commit`` and ``abort`` run on the driver, ``put`` in the
tasks. A chunk that is put twice, as a task that is run again does, must count once: only what the successful tasks tell
is committed. ``FolderStore`` is one over a folder that driver and executors share; a service's client fits as well.
"""

from __future__ import annotations

import json
import os
import pickle
import shutil
import uuid
from base64 import b64decode, b64encode
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .sinks import shaped_documents

CHUNK = 2000


@dataclass
class FolderStore:
    """Documents as lines of JSON in files of a shared folder. Readers see files without a leading underscore."""

    folder: str

    def _staged(self, load: str) -> Path:
        return Path(self.folder) / f"_load-{load}"

    def begin(self, load: str) -> None:
        self._staged(load).mkdir(parents=True)

    def put(self, load: str, task: str, number: int, documents: list[dict]) -> str:
        name = f"{task}-{number:05d}.json"
        text = "".join(json.dumps(d, default=str, ensure_ascii=False) + "\n" for d in documents)
        (self._staged(load) / name).write_text(text, encoding="utf-8")
        return name

    def commit(self, load: str, told: list[str], purge: bool) -> None:
        """New files come in first, so that a reader finds old or new documents, or for a moment both."""
        folder, staged = Path(self.folder), self._staged(load)
        before = [p for p in folder.glob("*.json") if not p.name.startswith("_")] if purge else []
        for name in told:
            os.replace(staged / name, folder / f"{load}-{name}")
        for p in before:
            p.unlink()
        shutil.rmtree(staged)

    def abort(self, load: str, told: list[str]) -> None:
        shutil.rmtree(self._staged(load), ignore_errors=True)


@dataclass
class Told(WriterCommitMessage):
    """What a task has put."""

    puts: list


class _Writer(DataSourceWriter):
    def __init__(self, store: Any, purge: bool, chunk: int):
        self.store, self.purge, self.chunk, self.load = store, purge, chunk, uuid.uuid4().hex
        self.begun = False

    def write(self, iterator: Iterator[Row]) -> Told:
        context = TaskContext.get()
        task, puts, held = f"{context.partitionId():05d}-{context.taskAttemptId()}", [], []
        for row in iterator:
            held.append({k: v for k, v in row.asDict(recursive=True).items() if v is not None})
            if len(held) == self.chunk:
                puts.append(self.store.put(self.load, task, len(puts), held))
                held = []
        if held:
            puts.append(self.store.put(self.load, task, len(puts), held))
        return Told(puts)

    def commit(self, messages: list) -> None:
        self.store.commit(self.load, [p for m in messages if m is not None for p in m.puts], self.purge)

    def abort(self, messages: list) -> None:
        self.store.abort(self.load, [p for m in messages if m is not None for p in m.puts])


class DocumentSink(DataSource):
    """``df.write.format("documents")`` with the options store (as of ``packed``), purge and chunk."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        store = pickle.loads(b64decode(self.options["store"]))
        made = _Writer(store, self.options.get("purge", "false") == "true", int(self.options.get("chunk", CHUNK)))
        store.begin(made.load)
        return made


def packed(store: Any) -> str:
    from pyspark import cloudpickle

    return b64encode(cloudpickle.dumps(store)).decode()


def send_documents(docs: DataFrame, store: Any, index: str, doc_type: str, purge: bool = False, chunk: int = CHUNK, mapping: dict[str, str] | None = None) -> None:
    """Send documents to a store in chunks of ``chunk`` at most; they are there all at once, or not at all.

    ``purge`` removes what was there, within the commit: a load that fails leaves it. See ``sinks.shaped_documents`` for
    ``mapping``. Null fields are left out of a document.
    """
    spark: SparkSession = docs.sparkSession
    spark.dataSource.register(DocumentSink)
    writer = shaped_documents(docs, index, doc_type, mapping).write.format("documents").mode("append")
    writer.options(store=packed(store), purge=str(purge).lower(), chunk=chunk).save()
