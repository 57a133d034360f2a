"""Archives of books as a data source: spark.read.format("archives") and df.write.format("archives").

Reading: one row an entry. Small archives share a partition, by their bytes. Conditions on the archive's name choose the files,
conditions on the entry's name choose what is decompressed, and those given to ``read_archives`` reach the source; a schema without
`body` reads the directories of the archives alone. (Other filters stay with Spark: it keeps what was pushed with the relation, so of
two plans that filter one relation differently the second would hold for both.) Writing: one archive for each run of rows of one name. A task writes below a folder of the
job; its files take their places when the job commits, so a failed or repeated task leaves nothing. With the option `folders` they stay
where they are, some thousands a folder, and the job commits by a list of its folders: then nothing in the driver, neither here nor
when they are read, grows with the number of archives but this list.
"""

from __future__ import annotations

import hashlib
import io
import json
import lzma
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, ord int, entry string, size long, body binary, error string"
PARTITION_BYTES = 32 << 20
_PENDING = "_pending-"
MOVES = 16  # archives that take their places at once when a job commits
_JOB, _COMMITTED, _DIGESTS = "_job-", "committed", "digests"
FOLDER_ARCHIVES = 4096  # of a folder, and at most some PARTITION_BYTES
HELD = 1 << 21  # digests of names that a job's commit holds at once


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _condition(column: str, wanted: str | list[str]) -> tuple[list, Column]:
    """As it is told to the source, and as Spark says it: a value, a list of values, or a pattern with one star at an end."""
    c = F.col(column)
    if isinstance(wanted, list):
        return (["In", column, sorted(wanted)], c.isin(*wanted)) if len(wanted) > 1 else (["EqualTo", column, wanted[0]], c == wanted[0])
    if wanted.endswith("*"):
        return ["StringStartsWith", column, wanted[:-1]], c.startswith(wanted[:-1])
    if wanted.startswith("*"):
        return ["StringEndsWith", column, wanted[1:]], c.endswith(wanted[1:])
    return ["EqualTo", column, wanted], c == wanted


def _passes(f: Filter, value: str | None) -> bool:
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value)


def _digest(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _shared(system: fs.FileSystem, lists: list[str], names: int) -> Iterator[int]:
    """Digests that are in several of these sorted lists, which have so many altogether; HELD of them, about, are looked at at once."""
    steps = max(1, -(-names // HELD))
    for k in range(steps):
        low, high = (k << 64) // steps, ((k + 1) << 64) // steps - 1
        some = []
        for path in lists:
            with system.open_input_stream(path) as f:
                all_ = np.frombuffer(f.read(), "<u8")
            some.append(all_[np.searchsorted(all_, np.uint64(low)) : np.searchsorted(all_, np.uint64(high), "right")].copy())
        found = np.sort(np.concatenate(some)) if some else np.empty(0, "<u8")
        yield from map(int, found[1:][found[1:] == found[:-1]])


def _committed(system: fs.FileSystem, path: str, listed: list[fs.FileInfo]) -> Iterator[tuple[str, int]]:
    """Folders of the jobs that have committed, and their bytes."""
    for info in sorted(listed, key=lambda i: i.base_name):
        said = f"{path}/{info.base_name}/{_COMMITTED}"
        if info.base_name.startswith(_JOB) and system.get_file_info(said).type == fs.FileType.File:
            with system.open_input_stream(said) as f:
                yield from ((f"{info.base_name}/{folder}", size) for folder, size in json.loads(f.read()))


@dataclass
class _Files(InputPartition):
    names: list[str]
    folders: list[str] = field(default_factory=list)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int, given: list[list]):
        self.path, self.fields, self.partition_bytes = path, [f.name for f in schema], partition_bytes
        self.arrow = pa.schema([(n, {"ord": pa.int32(), "size": pa.int64(), "body": pa.binary()}.get(n, pa.string())) for n in self.fields])
        self.given, self.on = given, {"name": [], "entry": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        on: dict[str, list[Filter]] = {"name": [], "entry": []}
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("name",), ("entry",)):
                value = sorted(f.value) if isinstance(f, In) else f.value
                if [type(f).__name__, f.attribute[0], value] in self.given:
                    on[f.attribute[0]].append(f)
                    continue
            yield f
        self.on = on

    def partitions(self) -> list[_Files]:
        system, path = _file_system(self.path)
        out, held = [], self.partition_bytes
        listed = system.get_file_info(fs.FileSelector(path))
        for folder, size in _committed(system, path, listed):
            if held + size > self.partition_bytes:
                out.append(_Files([]))
                held = 0
            out[-1].folders.append(folder)
            held += size
        for info in sorted(listed, key=lambda i: i.base_name):
            if info.type != fs.FileType.File or info.base_name[0] in "._" or not all(_passes(f, info.base_name) for f in self.on["name"]):
                continue
            if held + info.size > self.partition_bytes:
                out.append(_Files([]))
                held = 0
            out[-1].names.append(info.base_name)
            held += info.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(self.path)
        rows, held = [], 0
        for at, name in self._archives(system, path, partition):
            for row in self._entries(system, at, name):
                if all(_passes(f, row["entry"]) for f in self.on["entry"]):
                    rows.append([row[n] for n in self.fields])
                    held += len(row["body"] or b"")
                if len(rows) == 1000 or held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _archives(self, system: fs.FileSystem, path: str, partition: _Files) -> Iterator[tuple[str, str]]:
        yield from ((f"{path}/{name}", name) for name in partition.names)
        for folder in partition.folders:
            for name in sorted(i.base_name for i in system.get_file_info(fs.FileSelector(f"{path}/{folder}"))):
                if all(_passes(f, name) for f in self.on["name"]):
                    yield f"{path}/{folder}/{name}", name

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.arrow)], schema=self.arrow)

    def _entries(self, system: fs.FileSystem, path: str, name: str) -> Iterator[dict]:
        none = dict.fromkeys(("ord", "entry", "size", "body", "error"))
        with system.open_input_file(path) as raw:
            try:
                with zipfile.ZipFile(raw) as z:
                    for i, info in enumerate(z.infolist()):
                        row = none | {"name": name, "ord": i, "entry": info.filename, "size": info.file_size}
                        if info.flag_bits & 1:
                            row["error"] = "encrypted"
                        elif "body" in self.fields and all(_passes(f, info.filename) for f in self.on["entry"]):
                            try:
                                row["body"] = z.read(info)
                            except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, NotImplementedError, RuntimeError, ValueError):
                                row["error"] = "damaged"
                        yield row
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                yield none | {"name": name, "error": "no archive"}


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]  # none of them, if they stay in their folders
    own: str = ""
    folders: list[tuple[str, int]] = field(default_factory=list)
    archives: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, folders: bool = False):
        self.path, self.overwrite, self.folders, self.pending = path.rstrip("/"), overwrite, folders, f"{_JOB if folders else _PENDING}{uuid.uuid4().hex}"
        missing = {"name", "entry", "body"} - {f.name for f in schema}
        if missing:
            raise ValueError(f"archives are written from columns name, entry and body; there is no {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _file_system(self.path)
        attempt = uuid.uuid4().hex
        own = f"{path}/{self.pending}/{attempt}"  # an attempt's, so a repeated task is in nobody's way
        system.create_dir(own)
        files, seen, name, sink, z = [], set(), None, None, None
        folders, here = [], FOLDER_ARCHIVES  # with their bytes; archives in the last

        def close() -> None:
            nonlocal here
            if z is not None:
                z.close()
                if self.folders:
                    size = sink.getbuffer().nbytes
                    if here == FOLDER_ARCHIVES or folders[-1][1] + size > PARTITION_BYTES:
                        folders.append((f"{attempt}/{len(folders)}", 0))
                        system.create_dir(f"{path}/{self.pending}/{folders[-1][0]}")
                        here = 0
                    folder, held = folders[-1]
                    with system.open_output_stream(f"{path}/{self.pending}/{folder}/{name}") as out:
                        out.write(sink.getvalue())
                    folders[-1], here = (folder, held + size), here + 1
                    return
                with system.open_output_stream(f"{own}/{name}") as out:
                    out.write(sink.getvalue())
                files.append(f"{own}/{name}")

        for batch in iterator:
            columns = {n: batch.column(n) for n in batch.schema.names}
            names, entries = columns["name"].to_pylist(), columns["entry"].to_pylist()
            stored = columns["stored"].to_pylist() if "stored" in columns else [False] * batch.num_rows
            for i, n in enumerate(names):
                if n is None or "/" in n or n[:1] in ("", ".", "_"):
                    raise ValueError(f"{n!r} is no name of an archive")
                if n != name:
                    close()
                    if n in seen:
                        raise ValueError(f"the rows of {n} don't lie together")
                    seen.add(n)
                    name, sink = n, io.BytesIO()
                    z = zipfile.ZipFile(sink, "w")
                info = zipfile.ZipInfo(entries[i], (1980, 1, 1, 0, 0, 0))  # fixed, so a rerun gives the same bytes
                info.compress_type = zipfile.ZIP_STORED if stored[i] else zipfile.ZIP_DEFLATED
                z.writestr(info, columns["body"][i].as_py() or b"")
        close()
        if self.folders and seen:
            with system.open_output_stream(f"{own}/{_DIGESTS}") as out:
                out.write(np.sort(np.array([_digest(n) for n in seen], "<u8")).tobytes())
        return _Written(files, attempt, folders, len(seen))

    def commit(self, messages: list[_Written | None]) -> None:
        if self.folders:
            return self._commit_folders([m for m in messages if m is not None and m.archives])
        system, path = _file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [f.rpartition("/")[2] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks wrote archives of one name; their rows don't lie together")
        if self.overwrite:
            self._clear(system, path)
        with ThreadPoolExecutor(MOVES) as pool:  # a store's answers overlap; list() tells of what failed
            list(pool.map(lambda part: [system.move(files[i], f"{path}/{names[i]}") for i in part], [range(k, min(k + 256, len(files))) for k in range(0, len(files), 256)]))
        system.delete_dir(f"{path}/{self.pending}") if system.get_file_info(f"{path}/{self.pending}").type == fs.FileType.Directory else None

    def _commit_folders(self, messages: list[_Written]) -> None:
        system, path = _file_system(self.path)
        job = f"{path}/{self.pending}"
        # a digest's names are looked at folder by folder, as others may have it
        twice = set(_shared(system, [f"{job}/{m.own}/{_DIGESTS}" for m in messages], sum(m.archives for m in messages)))
        seen = set()
        for folder, _ in (f for m in messages for f in m.folders if twice):
            for name in (i.base_name for i in system.get_file_info(fs.FileSelector(f"{job}/{folder}"))):
                if name in seen:
                    self.abort(messages)
                    raise ValueError("several tasks wrote archives of one name; their rows don't lie together")
                if _digest(name) in twice:
                    seen.add(name)
        if self.overwrite:
            self._clear(system, path)
        own = {m.own for m in messages}
        system.create_dir(job)
        for info in system.get_file_info(fs.FileSelector(job)):  # of attempts that failed
            if info.base_name not in own:
                system.delete_dir(info.path)
        with system.open_output_stream(f"{job}/{_COMMITTED}.new") as out:
            out.write(json.dumps([f for m in messages for f in m.folders]).encode())
        system.move(f"{job}/{_COMMITTED}.new", f"{job}/{_COMMITTED}")  # never seen in part

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        """Without what other jobs left."""
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.type == fs.FileType.File:
                system.delete_file(info.path)
            elif info.base_name.startswith(_JOB) and info.base_name != self.pending:
                system.delete_dir(info.path)

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = _file_system(self.path)
        if system.get_file_info(f"{path}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.pending}")


class Archives(DataSource):
    """Options: path, a folder that all executors see; partitionBytes; folders (true: archives stay in folders of their job; their names
    must be new to the path, which is checked only within a job). Columns to write: name, entry, body, and stored (bool) if there is."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"), schema, int(self.options.get("partitionBytes", PARTITION_BYTES)), json.loads(self.options.get("given", "[]")))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite, self.options.get("folders", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA, **wanted: str | list[str]) -> DataFrame:
    """The entries of a folder's archives; only the named columns are read. name=..., entry=...: of which archives, which entries: a value,
    a list of values, or a pattern with a star at one end."""
    register(spark)
    told = [_condition(c, w) for c, w in wanted.items()]
    out = spark.read.format("archives").schema(columns).option("given", json.dumps([t for t, _ in told])).load(path)
    for _, condition in told:
        out = out.where(condition)
    return out


def write_archives(entries: DataFrame, path: str, name: str = "name", folders: bool = False) -> None:
    """entries: name of the archive, ord, entry, body, and stored if there is. An archive's rows go to one task, in order of ord. folders: for
    any number of archives, see ``Archives``."""
    register(entries.sparkSession)
    stored = [c for c in ("stored",) if c in entries.columns]
    rows = entries.repartition(F.col(name)).sortWithinPartitions(name, "ord", "entry")
    rows.select(F.col(name).alias("name"), "entry", "body", *stored).write.format("archives").option("folders", folders).mode("append").save(path)
