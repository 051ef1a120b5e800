"""Evidence of segments as files: pictures and a meta body each, by a data source writer.

    spark.dataSource.register(EvidenceFiles)
    frames.write.format("evidence").option("path", folder).option("day", "2026-06-10").mode("append").save()

Rows: candidate_id, source_id, frame_index, ts, image, h, w, and what the meta says of the segment (segment_frames, reason). Each
candidate's rows must lie in one task, in order (`clustered` sees to that). A task writes to a folder of its own attempt;
the commit on the driver moves whole candidate folders into place, and never over another's: a second burst of the same
name gets a suffix. An attempt that fails takes its folder away, and an aborted job all of them."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "candidate_id string, source_id string, frame_index long, ts double, image binary, h int, w int, first_frame long, last_frame long, reason string"


def png(image: np.ndarray) -> bytes:
    """A grey picture as PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = image.shape
    lines = np.zeros((h, w + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = image
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """What png() has written."""
    at, body, shape = 8, b"", (0, 0)
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h = struct.unpack(">II", part[:8])
            shape = (h, w)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], shape[1] + 1)[:, 1:]


def clustered(frames: DataFrame) -> DataFrame:
    """Frames as the writer wants them."""
    return frames.select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition("candidate_id").sortWithinPartitions("candidate_id", "frame_index")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder, and the candidates in it."""

    folder: str
    candidates: list[str]


class EvidenceWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.stride = options["path"].rstrip("/"), int(options.get("stride", "1"))
        self.day = options.get("day") or datetime.now(timezone.utc).strftime("%Y-%m-%d")
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return _store(self.path)

    def write(self, iterator) -> Written:
        store, root = self._store()
        folder, done = f"{root}/.attempts-{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        try:
            for candidate, rows in groupby(iterator, key=lambda r: r["candidate_id"]):
                store.create_dir(f"{folder}/{candidate}", recursive=True)
                kept, span, last = [], [None, None], None
                for i, r in enumerate(rows):
                    span, last = [r["ts"] if i == 0 else span[0], r["ts"]], r
                    if i % self.stride == 0:
                        with store.open_output_stream(f"{folder}/{candidate}/frame_{r['frame_index']:08d}.png") as out:
                            out.write(png(np.frombuffer(r["image"], np.uint8).reshape(r["h"], r["w"])))
                        kept.append(r["frame_index"])
                meta = {"candidate_id": candidate, "frame_count": len(kept), "frame_indices": kept, "ts_range": span, "written_utc": datetime.now(timezone.utc).isoformat(), "source_id": last["source_id"], "segment_frames": [last["first_frame"], last["last_frame"]], "reason": last["reason"]}
                with store.open_output_stream(f"{folder}/{candidate}/meta.json") as out:
                    out.write(json.dumps(meta).encode())
                done.append(candidate)
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(folder, done)

    def commit(self, messages) -> None:
        store, root = self._store()
        store.create_dir(f"{root}/{self.day}", recursive=True)
        for message in messages:
            for candidate in message.candidates if message is not None else []:
                target, n = f"{root}/{self.day}/{candidate}", 0
                while store.get_file_info(target).type != fs.FileType.NotFound:
                    n += 1
                    target = f"{root}/{self.day}/{candidate}-r{n}"
                store.move(f"{message.folder}/{candidate}", target)
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/.attempts-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/.attempts-{self.job}")


class EvidenceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> EvidenceWriter:
        if overwrite:
            raise ValueError("evidence is only ever added to")
        return EvidenceWriter(dict(self.options))


def _read(spark, path: str, wanted, columns, schema: str) -> DataFrame:
    """What columns(files) makes of the files below a folder whose name is `wanted`: (path, bytes) each.

    Days are listed on the driver. What is in a day, a folder a candidate, is dealt to tasks by name, which list and read their share;
    an index of all files on the driver would hold millions, and a scan's splits a few dozen each. Hidden names are left out."""
    path = path.rstrip("/")
    store, root = _store(path)
    days = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name[0] not in "._"]
    shares = 4 * spark.sparkContext.defaultParallelism
    jobs = [(share, folder, folder != root) for share in range(shares) for folder in [*days, root]]

    def run(batches):
        store, _ = _store(path)
        for batch in batches:
            for share, folder, below in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = []
                for entry in store.get_file_info(fs.FileSelector(folder)):
                    if entry.base_name[0] in "._" or zlib.crc32(entry.base_name.encode()) % shares != share:
                        continue
                    if entry.type == fs.FileType.File:
                        found.append(entry.path)
                    elif below:
                        found += [i.path for i in store.get_file_info(fs.FileSelector(entry.path, recursive=True)) if i.type == fs.FileType.File and not re.search(r"/[._]", i.path[len(entry.path) :])]
                found = [f for f in found if wanted(f.rsplit("/", 1)[1])]
                for i in range(0, len(found), 256):
                    files = []
                    for name in found[i : i + 256]:
                        with store.open_input_stream(name) as f:
                            files.append((name, f.read()))
                    yield columns(files)

    dealt = spark.createDataFrame(spark.sparkContext.parallelize(jobs, min(shares, len(jobs))), "share int, folder string, below boolean")
    return dealt.mapInArrow(run, schema)


def read_pictures(spark, path: str) -> DataFrame:
    """(candidate_id, frame_index, image, h, w) of the pictures below a folder."""

    def columns(files):
        at = [re.search(r"([^/]+)/frame_(\d+)\.png$", name) for name, _ in files]
        images = [from_png(c) for _, c in files]
        return pa.RecordBatch.from_arrays(
            [pa.array([m[1] for m in at]), pa.array([int(m[2]) for m in at], pa.int64()), pa.array([a.tobytes() for a in images], pa.binary()), pa.array([a.shape[0] for a in images], pa.int32()), pa.array([a.shape[1] for a in images], pa.int32())],
            names=["candidate_id", "frame_index", "image", "h", "w"])

    return _read(spark, path, lambda name: re.fullmatch(r"frame_\d+\.png", name), columns, "candidate_id string, frame_index long, image binary, h int, w int")


def read_meta(spark, path: str) -> DataFrame:
    schema = "candidate_id string, frame_count int, frame_indices array<bigint>, ts_range array<double>, written_utc string, source_id string, segment_frames array<bigint>, reason string"
    columns = lambda files: pa.RecordBatch.from_arrays([pa.array([body.decode() for _, body in files], pa.string())], names=["body"])
    return _read(spark, path, lambda name: name == "meta.json", columns, "body string").select(F.from_json("body", schema).alias("m")).select("m.*")
