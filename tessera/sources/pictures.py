"""PNG folders as a Spark data source, for reading and writing.

    spark.dataSource.register(PictureSource)
    px = spark.read.format("tessera_png").load(folder)
    by_image(px).write.format("tessera_png").mode("append").save(folder)

Reading: the files below the folder (names that begin with ``_`` or ``.`` are hidden) are dealt
out to partitions of about ``partitionBytes``; each task decodes its own, one image at a time.
Where Spark's pushdown to Python sources is on (PUSHDOWN), an equality filter on ``path``
prunes the files (option ``prune``, which ``read_pictures`` sets). img_id is the file's name where that is a whole
number, else a hash of the path below the folder.

Writing: each task writes the images of its rows, named by img_id, to a hidden folder of its
own and reports what it has written. The driver's commit publishes the folders of complete
tasks, one rename a task; where two tasks report the same image (its rows were not brought
together, see ``by_image``) it publishes nothing and fails. A failed job leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "tessera_png"
SCHEMA = "path string, img_id long, x int, y int, r int, g int, b int, a int"
PARTITION_BYTES = 32 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PIXEL = ("img_id", "x", "y", "r", "g", "b", "a")


def by_image(px: DataFrame) -> DataFrame:
    """The pixels with those of an image together and in order, as the writer needs them."""
    return px.select(*PIXEL).repartition("img_id").sortWithinPartitions("img_id", "y", "x")


def _open(folder: str):
    from pyarrow import fs

    if ":/" in folder:
        where, root = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace(":/", ":///", 1))
    else:
        where, root = fs.LocalFileSystem(), folder
    return where, root.rstrip("/")


def _files(folder: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of the visible PNG files."""
    from pyarrow import fs

    where, root = _open(folder)
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [(f.path[len(root):].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".png")]
    return sorted((p, n) for p, n in names if not any(part[0] in "_." for part in p.split("/")))


def image_id(path: str) -> int:
    import xxhash

    stem = path.rsplit("/", 1)[-1][:-4]
    return int(stem) if stem.lstrip("-").isdigit() and abs(int(stem)) < 2**63 else int(np.uint64(xxhash.xxh64_intdigest(path)).astype(np.int64))


@dataclass
class Files(InputPartition):
    paths: list[str]


class PictureReader(DataSourceReader):
    def __init__(self, folder: str, partition_bytes: int):
        self.folder, self.partition_bytes, self.only = folder, partition_bytes, None

    def partitions(self):
        parts, held = [[]], 0
        for path, size in _files(self.folder):
            if self.only is not None and path not in self.only:
                continue
            if parts[-1] and held + size > self.partition_bytes:
                parts.append([])
                held = 0
            parts[-1].append(path)
            held += size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from ..operators.rasters import read_png

        where, root = _open(self.folder)
        for path in partition.paths:
            with where.open_input_stream(f"{root}/{path}") as f:
                img = read_png(f.read())
            h, w = img.shape[:2]
            y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
            channels = img.reshape(-1, 4).astype(np.int32)
            for lo in range(0, h * w, 1 << 20):
                part = slice(lo, lo + (1 << 20))
                n = len(x[part])
                columns = [pa.array([path], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, image_id(path), np.int64)), pa.array(x[part]), pa.array(y[part]), *(pa.array(channels[part, c]) for c in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", *PIXEL])


class PruningReader(PictureReader):
    """Takes equality filters on ``path``; Spark allows this only where its pushdown to Python sources is on."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - the name Spark calls
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("path",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    folder: str
    images: list[int]


class PictureWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, columns: list[str], overwrite: bool):
        missing = set(PIXEL) - set(columns)
        if missing:
            raise ValueError(f"pictures need the columns {', '.join(sorted(missing))}")
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"_staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from ..operators.rasters import png_bytes

        where, root = _open(self.folder)
        own, images, held = f"{root}/{self.staging}/{uuid.uuid4().hex}", [], []

        def put(rows: np.ndarray) -> None:
            img = np.zeros((int(rows[:, 2].max()) + 1, int(rows[:, 1].max()) + 1, 4), np.uint8)
            img[rows[:, 2], rows[:, 1]] = rows[:, 3:]
            if not images:
                where.create_dir(own, recursive=True)
            with where.open_output_stream(f"{own}/{rows[0, 0]}.png", compression=None) as out:
                out.write(png_bytes(img))
            images.append(int(rows[0, 0]))

        for batch in iterator:
            if not batch.num_rows:
                continue
            if any(batch.column(c).null_count for c in PIXEL):
                raise ValueError("pixels must not hold nulls")
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in PIXEL], axis=1)
            edges = np.flatnonzero(np.diff(rows[:, 0])) + 1
            for part in np.split(rows, edges):
                if held and held[0][0, 0] != part[0, 0]:
                    put(np.concatenate(held))
                    held = []
                held.append(part)
        if held:
            put(np.concatenate(held))
        return Written(own if images else "", images)

    def commit(self, messages: list[Written]) -> None:
        where, root = _open(self.folder)
        images = [i for m in messages for i in m.images]
        if len(images) != len(set(images)):
            self.abort(messages)
            raise ValueError("the pixels of an image lie in several tasks or places: write by_image(px)")
        before = [f.path for f in self._visible(where, root)] if self.overwrite else []
        where.create_dir(root, recursive=True)
        for n, m in enumerate(messages):
            if m.images:
                where.move(m.folder, f"{root}/part-{n:05d}-{self.job}")
        for path in before:
            where.delete_dir(path)
        self.abort([])

    def _visible(self, where, root: str):
        from pyarrow import fs

        return [f for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name.startswith("part-")]

    def abort(self, messages) -> None:
        from pyarrow import fs

        where, root = _open(self.folder)
        if where.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.staging}")


class PictureSource(DataSource):
    """Options: path, and partitionBytes and prune for reading."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PictureReader:
        reader = PruningReader if self.options.get("prune", "false") == "true" else PictureReader
        return reader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options["path"], schema.names, overwrite)


def read_pictures(spark, folder: str) -> DataFrame:
    spark.dataSource.register(PictureSource)
    return spark.read.format(NAME).option("prune", spark.conf.get(PUSHDOWN, "false")).load(folder)


def write_pictures(px: DataFrame, folder: str, mode: str = "append") -> None:
    px.sparkSession.dataSource.register(PictureSource)
    by_image(px).write.format(NAME).mode(mode).save(folder)


