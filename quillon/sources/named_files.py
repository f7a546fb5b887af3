"""Data sources of documents and of files by name: `split_manifest` reads manifests, `named_files` writes bodies that are what their hash says.

Both go through pyarrow's file systems, so paths may be local or of any store that these know.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Splits that may be opened; the test split is not among them.
OPEN_SPLITS = ("train", "dev")
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*")


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


# --- manifests ---

SAMPLES = "document string, problem string, name string, version string, split string, id string, frame_path string, frame_sha256 string, w int, h int, annotations array<struct<id:string,cls:string,x:double,y:double,w:double,h:double>>"


#: Partitions that documents are dealt to at most, so that many small ones take no task each.
PARTITIONS = 200


@dataclass
class Documents(InputPartition):
    folders: list[str]


def checked(folder: str, split: str, manifest: object) -> Iterator[tuple]:
    """Rows of one manifest, or one row that says what is wrong with it. Everything in it must be of its split, once."""
    blank = (None,) * 9
    if not isinstance(manifest, dict) or manifest.get("split") != split:
        yield (folder, "DECLARES_OTHER_SPLIT", *blank)
        return
    rows, ids, marks = [], set(), set()
    for s in manifest.get("samples") or []:
        own = s.get("id") or ""
        if s.get("split") != split or not re.fullmatch(rf"{split}-\d{{5}}", own):
            problem = "FOREIGN_SAMPLE"
        elif own in ids:
            problem = "DUPLICATE_SAMPLE"
        elif s.get("framePath") != f"frames-{split}/{own}.png":
            problem = "FOREIGN_FRAME"
        else:
            notes = s.get("annotations") or []
            names = [a.get("id") or "" for a in notes]
            bad = len(set(names)) != len(names) or any(not n.startswith(own + "-e") or n in marks for n in names)
            problem = "FOREIGN_ANNOTATION" if bad else None
            marks.update(names)
        if problem:
            yield (folder, problem, *blank)
            return
        ids.add(own)
        frame = s.get("frame") or {}
        boxes = [(a["id"], a.get("cls"), *(None if (a.get("box") or {}).get(k) is None else float(a["box"][k]) for k in "xywh")) for a in notes]
        rows.append((folder, None, manifest.get("name"), manifest.get("version"), split, own, s["framePath"], frame.get("sha256"), frame.get("w"), frame.get("h"), boxes))
    yield from rows


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split, self.report = options["path"], options.get("split", ""), options.get("onproblem", "fail") == "report"
        if self.split not in OPEN_SPLITS:  # refused before anything is opened
            raise ValueError(f"manifests of {', '.join(OPEN_SPLITS)} may be opened, not of {self.split!r}")

    def partitions(self) -> list[Documents]:
        """The manifests of the split below the path, dealt in turn; names are listed, and no other file is opened."""
        from pyarrow import fs

        store, root = opened(self.path)
        found = sorted(f.path.rpartition("/")[0] for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.base_name == f"manifest-{self.split}.json")
        return [Documents(found[k::PARTITIONS]) for k in range(min(PARTITIONS, len(found)))]

    def read(self, partition: Documents) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for folder in partition.folders:
            with store.open_input_stream(f"{folder}/manifest-{self.split}.json") as f:
                text = f.read()
            try:
                manifest = json.loads(text)
            except ValueError:
                manifest = None
            for row in checked(folder.rsplit("/", 1)[-1], self.split, manifest):
                if row[1] and not self.report:
                    raise ValueError(f"{row[0]}: {row[1]}")
                yield row


class SplitManifest(DataSource):
    """spark.read.format("split_manifest").option("split", "train").load(path): samples of the manifests below path.

    A manifest that breaks a rule ends the read, or with onProblem=report gives one row that names the rule. A task
    holds one manifest at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "split_manifest"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema: StructType) -> DataSourceReader:
        return ManifestReader(self.options)


# --- files by name ---


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int
    size: int


class Attempts:
    """What a task does with its rows (name, sha256, body) and the driver with the tasks' messages, for one batch of a folder.

    A task writes into a folder of its own attempt. The commit moves the folders of the attempts that count into one, and that one to its
    place in a single step: nothing of a batch is seen before, a lost attempt's files are never seen, and a batch that
    is there already stays as it is.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def put(self, rows: Iterator, batch: str) -> Written:
        store, root = opened(self.path)
        attempt = f"_attempt-{batch}-{uuid.uuid4().hex}"
        files = size = 0
        made: set[str] = set()
        for r in rows:
            body = bytes(r["body"])
            if not NAME.fullmatch(r["name"] or ""):
                raise ValueError("not a name for a file")
            if hashlib.sha256(body).hexdigest() != r["sha256"]:
                raise ValueError(f"{r['name']}: the body no longer hashes to what was attested")
            folder = f"{root}/{attempt}/{r['name']}".rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{root}/{attempt}/{r['name']}") as f:
                f.write(body)
            files, size = files + 1, size + len(body)
        return Written(attempt if files else "", files, size)

    def done(self, batch: str) -> bool:
        from pyarrow import fs

        store, root = opened(self.path)
        return store.get_file_info(f"{root}/batch={batch}").type == fs.FileType.Directory

    def commit(self, messages: list, batch: str) -> None:
        store, root = opened(self.path)
        if not self.done(batch):
            stage = f"{root}/_stage-{batch}"
            self.clear(f"_stage-{batch}")
            store.create_dir(stage, recursive=True)
            for k, m in enumerate(m for m in messages if m is not None and m.attempt):
                store.move(f"{root}/{m.attempt}", f"{stage}/part-{k:05d}")
            store.move(stage, f"{root}/batch={batch}")
        self.clear(f"_attempt-{batch}-")

    def clear(self, prefix: str) -> None:
        from pyarrow import fs

        store, root = opened(self.path)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(prefix):
                store.delete_dir(f.path)


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.attempts, self.batch = Attempts(options["path"]), options.get("batch", "0")

    def write(self, iterator: Iterator) -> Written:
        return self.attempts.put(iterator, self.batch)

    def commit(self, messages: list) -> None:
        self.attempts.commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.attempts.clear(f"_attempt-{self.batch}-")


class FileStreamWriter(DataSourceStreamWriter):
    """As FileWriter; a task does not know its batch, so attempts are told apart by their own names alone."""

    def __init__(self, options: dict) -> None:
        self.attempts = Attempts(options["path"])

    def write(self, iterator: Iterator) -> Written:
        return self.attempts.put(iterator, "stream")

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.attempts.commit(messages, str(batchId))
        self.attempts.clear("_attempt-stream-")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.attempts.clear("_attempt-stream-")


@dataclass
class Part(InputPartition):
    folder: str


class FileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.batch = options["path"], options.get("batch")

    def partitions(self) -> list[Part]:
        """One for each part of a batch, or of all: a task lists its files itself, the driver no file."""
        from pyarrow import fs

        store, root = opened(self.path)
        below = lambda p: [f.path for f in store.get_file_info(fs.FileSelector(p, allow_not_found=True)) if f.type == fs.FileType.Directory]
        batches = [f"{root}/batch={self.batch}"] if self.batch is not None else [p for p in below(root) if p.rpartition("/")[2].startswith("batch=")]
        return [Part(p) for b in sorted(batches) for p in sorted(below(b))]

    def read(self, partition: Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = opened(self.path)
        for f in store.get_file_info(fs.FileSelector(partition.folder, recursive=True)):
            if f.type == fs.FileType.File:
                with store.open_input_stream(f.path) as s:
                    body = s.read()
                yield f.path[len(partition.folder) + 1 :], hashlib.sha256(body).hexdigest(), body


class NamedFiles(DataSource):
    """df.write.format("named_files").option("batch", id).mode("append").save(path), and the same as a streaming sink.

    Rows are (name, sha256, body); a body that is not what its hash says ends the write. The files of a batch are in
    path/batch=<id>/part-<k>/<name>; writing a batch again changes nothing. Read, they are the rows that the files now are.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, sha256 string, body binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return FileStreamWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    for source in (SplitManifest, NamedFiles):
        spark.dataSource.register(source)
    return spark
