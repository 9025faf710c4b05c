"""Image sequences as tables: files read by Spark's binaryFile source, decoded in tasks."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IMAGE = "run_id string, frame int, h int, w int, px binary"
# fixed values: weights of red, green and blue for grey (Rec. 601)
REC601 = (0.299, 0.587, 0.114)


def grey(img: np.ndarray, weights: tuple[float, float, float] | None = REC601) -> np.ndarray:
    """One channel as float32: weighted (None: plain mean) if there are several."""
    if img.ndim == 2:
        return img.astype(np.float32)
    if weights is None:
        return img.astype(np.float32).mean(axis=2)
    return (img[..., :3].astype(np.float32) @ np.array(weights, np.float32)).astype(np.float32)


def read_pgm(data: bytes, at: int = 0) -> tuple[np.ndarray, str, int]:
    """The binary PGM (P5), 8 or 16 bit, that starts at ``at``: its image, its comments and where it ends."""
    fields, said = [], []
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.index(b"\n", at)
            said.append(data[at + 1 : end].decode("latin-1").strip())
            at = end
            continue
        end = at
        while end < len(data) and end < at + 20 and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("not a binary PGM")
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P5":
        raise ValueError("not a binary PGM")
    w, h, top = (int(f) for f in fields[1:])
    kind = np.dtype(">u2" if top > 255 else "u1")
    end = at + 1 + w * h * kind.itemsize
    return np.frombuffer(data, kind, w * h, at + 1).reshape(h, w), " ".join(said), end


def decode_pgm(data: bytes) -> np.ndarray:
    return read_pgm(data)[0]


def decode_tiff(data: bytes) -> np.ndarray:
    """First image of an uncompressed TIFF, 8, 16 or 32 bit, one or several samples per pixel."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise ValueError("not a TIFF")
    sizes = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 12: "d"}
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code = sizes.get(kind)
        if code is None:
            continue
        form = order + code * n
        size = struct.calcsize(form)
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(form, data, where)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF is not supported")
    w, h, bits, samples = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(277, (1,))[0]
    kind = np.dtype({(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4"}[bits, tags.get(339, (1,))[0]]).newbyteorder(order)
    raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    img = np.frombuffer(raw, kind, w * h * samples)
    return img.reshape(h, w, samples) if samples > 1 else img.reshape(h, w)


#: Decoders in the order in which they are tried after the one of a file's own ending; others can be added.
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"pgm": decode_pgm, "tif": decode_tiff, "tiff": decode_tiff, "npy": lambda b: np.load(io.BytesIO(b), allow_pickle=False)}


def decode(path: str, data: bytes) -> np.ndarray:
    """The image by the decoder of the file's ending, else by the first other one that can read it; if none can, an error names all."""
    ending = path.rsplit(".", 1)[-1].lower()
    failed = []
    for name in dict.fromkeys([*([ending] if ending in DECODERS else []), *DECODERS]):
        try:
            return DECODERS[name](data)
        except (ValueError, KeyError, IndexError, struct.error, EOFError) as e:
            failed.append(f"{name}: {e}")
    raise ValueError(f"no decoder for {path} ({'; '.join(failed)})")


def read_frames(spark: SparkSession, folder: str, pattern: str = r"([^/]+)_(\d+)\.(pgm|tiff?|npy)$", stride: int = 1, most: int | None = None, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """``IMAGE`` rows of a folder's files, numbered by the digits at the end of their names.

    ``stride`` keeps every n-th file in numeric order and ``most`` the first so many of these (sampling features);
    the choice is made on paths alone, so files left out are not read. Files with other names are passed over.
    """
    files = spark.read.format("binaryFile").load(folder).withColumn("run_id", F.regexp_extract("path", pattern, 1)).withColumn("frame", F.regexp_extract("path", pattern, 2))
    files = files.where("frame <> ''").withColumn("frame", F.col("frame").cast("int"))
    if stride > 1 or most is not None:
        at = F.row_number().over(Window.partitionBy("run_id").orderBy("frame")) - 1
        chosen = files.select("run_id", "frame", "path").withColumn("_at", at).where(F.pmod("_at", F.lit(stride)) == 0)
        chosen = chosen if most is None else chosen.where(F.col("_at") < most * stride)
        files = files.join(chosen.select("path"), "path", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                img = grey(decode(row["path"], row["content"]), weights)
                yield pa.RecordBatch.from_arrays([pa.array([row["run_id"]]), pa.array([row["frame"]], pa.int32()), pa.array([img.shape[0]], pa.int32()), pa.array([img.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(img, np.float32).tobytes()], pa.binary())], ["run_id", "frame", "h", "w", "px"])

    return files.select("run_id", "frame", "path", "content").mapInArrow(run, IMAGE)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def frames_of_stream(data: bytes, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Frames ``first`` to ``last`` of PGM images that follow one another in one file.

    The place of frame ``first`` is reckoned from the size of the first image. What is found there must be an image, and if
    it carries its number (a comment "frame N") it must be the right one; else the file is read from its start and images are counted.
    """
    at, k = 0, 0
    try:
        size = read_pgm(data)[2]
        _, said, _ = read_pgm(data, first * size)
        told = said.split()
        if told[:1] != ["frame"] or told[1:2] == [str(first)]:
            at, k = first * size, first
    except (ValueError, IndexError):
        pass
    while k <= last and at < len(data):
        img, _, end = read_pgm(data, at)
        if k >= first:
            yield k, img
        at, k = end, k + 1


class StackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.run_id = options["path"], options.get("run_id", "stack")
        self.first, self.end, self.chunk = int(options.get("first", 0)), int(options.get("last", -1)), int(options.get("chunk", 50))
        self.stream = not self.path.endswith(".npy")

    def partitions(self) -> list[InputPartition]:
        if self.stream:
            data = np.memmap(self.path, np.uint8, "r").data
            # the length in images of the first one's size; a longer count only gives empty last ranges
            n = -(-len(data) // read_pgm(bytes(data[: 1 << 26]))[2])
        else:
            n = np.load(self.path, mmap_mode="r", allow_pickle=False).shape[0]
        last = n - 1 if self.end <= 0 else min(self.end, n - 1)
        if self.stream and self.end <= 0:
            # images may be of unequal size: the last range reads on to the end
            return [_Range(a, a + self.chunk - 1 if a + self.chunk <= last else 1 << 40) for a in range(self.first, last + 1, self.chunk)]
        return [_Range(a, min(a + self.chunk - 1, last)) for a in range(self.first, last + 1, self.chunk)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if self.stream:
            with open(self.path, "rb") as f:
                found = frames_of_stream(f.read(), partition.first, partition.last)
        else:
            stack = np.load(self.path, mmap_mode="r", allow_pickle=False)
            found = ((k, np.asarray(stack[k])) for k in range(partition.first, partition.last + 1))
        for k, img in found:
            img = grey(img)
            yield self.run_id, k, img.shape[0], img.shape[1], np.ascontiguousarray(img, np.float32).tobytes()


class FrameStack(DataSource):
    """``spark.read.format("framestack").option("path", "x.npy")``: a (n, h, w) stack, or PGM images one after another, on a shared disk, read by ranges of ``chunk`` frames.

    Options ``first`` and ``last`` bound the window; a last of 0 or less means the last frame.
    """

    @classmethod
    def name(cls) -> str:
        return "framestack"

    def schema(self) -> str:
        return IMAGE

    def reader(self, schema) -> StackReader:  # noqa: ANN001
        return StackReader(self.options)
