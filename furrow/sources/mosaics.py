"""Mosaics by window: a Spark data source over the strips and tiles of TIFF files, so that one mosaic of any size is read by many tasks.

Planning opens each file's header only. Neighbouring windows (the file's own strips or tiles) make a partition, up to a number of pixels; filters on prj, x, y
and on the grid's col and row choose the files and windows before anything is read. A task reads its windows' bytes and no others. Files are
opened through pyarrow's file systems (local and shared folders, S3, GCS, HDFS).

Baseline TIFF and BigTIFF of either byte order: 8-bit samples, one to many bands, interleaved or plane by plane; uncompressed, deflate or PackBits, with or
without horizontal differences; GeoTIFF scale and tie point. Other compressions are an error that names the file.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# TIFF tags, field types and compressions by number.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "bands", 278: "strip_rows", 279: "strip_counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 33550: "scale", 33922: "tie"}
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
NONE, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 8, 32946, 32773

PIXELS = "prj string, x int, y int, r int, g int, b int"
FACTS = "prj string, image_dimensions array<int>, pixel_size array<double>, image_extents array<double>, windows long, path string"


@dataclass
class Header:
    """What a TIFF file says about itself."""

    path: str
    width: int
    height: int
    bands: int
    compression: int
    predictor: int
    planar: bool
    window: tuple[int, int]  # width and height of a strip or tile
    offsets: list[int] | dict[int, int]
    counts: list[int] | dict[int, int]
    scale: tuple[float, float] | None
    corner: tuple[float, float] | None
    tiled: bool

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.width // self.window[0]), -(-self.height // self.window[1])


def open_at(path: str):
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_header(path: str) -> Header:
    system, inside = open_at(path)
    with system.open_input_file(inside) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if kind not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big = kind == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
        size = struct.calcsize(order + count)
        n = struct.unpack(order + count, f.read_at(size, at))[0]
        raw, tags = f.read_at(n * entry, at + size), {}
        for i in range(n):
            tag, code, many = struct.unpack_from(order + "HH" + word, raw, i * entry)
            if tag not in TAGS or code not in TYPES:
                continue
            form = f"{order}{many}{TYPES[code]}"
            value = raw[i * entry + entry - struct.calcsize(order + word) : (i + 1) * entry]
            if struct.calcsize(form) > len(value):
                value = f.read_at(struct.calcsize(form), struct.unpack(order + word, value)[0])
            tags[TAGS[tag]] = struct.unpack_from(form, value)
    one = lambda key, default: tags.get(key, (default,))[0]
    width, height, tiled = one("width", 0), one("height", 0), "tile_offsets" in tags
    if set(tags.get("bits", (1,))) != {8} or one("compression", 1) not in (NONE, DEFLATE, OLD_DEFLATE, PACKBITS) or one("predictor", 1) not in (1, 2):
        raise ValueError(f"{path}: bits {tags.get('bits')}, compression {one('compression', 1)} or predictor {one('predictor', 1)} can't be read")
    window = (one("tile_width", 0), one("tile_height", 0)) if tiled else (width, min(one("strip_rows", height), height) or 1)
    corner = None
    if "tie" in tags and "scale" in tags:
        i, j, _, x, y, _ = tags["tie"][:6]
        corner = (x - i * tags["scale"][0], y + j * tags["scale"][1])
    return Header(
        path, width, height, one("bands", 1), one("compression", 1), one("predictor", 1), one("planar", 1) == 2, window,
        list(tags["tile_offsets" if tiled else "strip_offsets"]), list(tags["tile_counts" if tiled else "strip_counts"]), tags["scale"][:2] if "scale" in tags else None, corner, tiled,
    )


def _unpacked(data: bytes, size: int) -> bytes:
    """PackBits runs."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    return bytes(out)


def read_window(file, head: Header, number: int) -> tuple[int, int, np.ndarray]:
    """(left, top, pixels (rows, columns, 3)) of a window; of one or two bands the first stands for all three colours."""
    across, down = head.grid
    left, top = number % across * head.window[0], number // across * head.window[1]
    tall = head.window[1] if head.tiled else min(head.window[1], head.height - top)
    planes, bands = (min(head.bands, 3), 1) if head.planar else (1, head.bands)
    parts = []
    for plane in range(planes):
        k = plane * across * down + number
        data, size = file.read_at(head.counts[k], head.offsets[k]), tall * head.window[0] * bands
        if head.compression in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif head.compression == PACKBITS:
            data = _unpacked(data, size)
        block = np.frombuffer(data, np.uint8, size).reshape(tall, head.window[0], bands)
        parts.append(np.cumsum(block, axis=1, dtype=np.uint8) if head.predictor == 2 else block)
    pixels = np.concatenate(parts, axis=2)[: head.height - top, : head.width - left]
    return left, top, pixels[..., :3] if pixels.shape[2] >= 3 else np.repeat(pixels[..., :1], 3, axis=2)


def files_of(path: str) -> list[str]:
    """The TIFF files at a path: itself, or all below a folder."""
    system, inside = open_at(path)
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    if system.get_file_info(inside).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))


class Windows(InputPartition):
    """Some windows of one file. The file's list of offsets stays behind: only those of these windows travel."""

    def __init__(self, head: Header, numbers: list[int]):
        self.head, self.numbers = head, numbers


def thinned(head: Header, numbers: list[int]) -> Header:
    """The header with the offsets of these windows only, by number."""
    planes = len(head.offsets) // (head.grid[0] * head.grid[1])
    wanted = [p * head.grid[0] * head.grid[1] + n for n in numbers for p in range(planes)]
    return replace(head, offsets={k: head.offsets[k] for k in wanted}, counts={k: head.counts[k] for k in wanted})


class MosaicReader(DataSourceReader):
    """Pixels of the windows that the pushed filters leave."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("partitionpixels", 1 << 21))
        self.tile_m = float(options["tilem"]) if "tilem" in options else None
        self.tile_px = float(options["tilepx"]) if "tilepx" in options else None
        self.names: set[str] | None = None
        self.ranges = {c: [-math.inf, math.inf] for c in ("x", "y", "col", "row")}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            values = [f.value] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else list(f.value) if isinstance(f, In) else []
            values = [v for v in values if v is not None]
            if column == "prj" and values and isinstance(f, (EqualTo, In)):
                self.names = set(values) if self.names is None else self.names & set(values)
            elif column in self.ranges and values:
                low = min(values) if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)) else -math.inf
                high = max(values) if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)) else math.inf
                have = self.ranges[column]
                self.ranges[column] = [max(have[0], low), min(have[1], high)]
            yield f  # windows are coarser than rows: Spark still tests each row

    def _tile(self, head: Header) -> float | None:
        """The side of a grid tile in pixels of this file."""
        return self.tile_m / head.scale[0] if self.tile_m and head.scale else self.tile_px

    def _box(self, head: Header) -> list[tuple[float, float]]:
        """The inclusive range of x and of y that the filters leave in a file."""
        side, out = self._tile(head), []
        for place, tile in (("x", "col"), ("y", "row")):
            low, high = self.ranges[place]
            if side:
                low, high = max(low, math.ceil((self.ranges[tile][0] - 1) * side) if self.ranges[tile][0] > -math.inf else low), min(high, self.ranges[tile][1] * side)
            out.append((low, high))
        return out

    def wanted(self, head: Header) -> list[int]:
        """The windows of a file that the filters leave."""
        (x0, x1), (y0, y1) = self._box(head)
        (w, h), (across, down) = head.window, head.grid
        return [j * across + i for j in range(down) if j * h <= y1 and (j + 1) * h > y0 for i in range(across) if i * w <= x1 and (i + 1) * w > x0]

    def partitions(self):
        out = []
        for path in files_of(self.path):
            name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            if self.names is not None and name not in self.names:
                continue
            head = read_header(path)
            numbers, each = self.wanted(head), max(1, self.most // (head.window[0] * head.window[1]))
            out += [Windows(thinned(head, numbers[i : i + each]), numbers[i : i + each]) for i in range(0, len(numbers), each)]
        return out or [Windows(None, [])]

    def read(self, partition):
        head = partition.head
        if head is None:
            return
        (x0, x1), (y0, y1) = self._box(head)
        side = self._tile(head)
        system, inside = open_at(head.path)
        with system.open_input_file(inside) as file:
            for number in partition.numbers:
                left, top, pixels = read_window(file, head, number)
                a, b = int(max(left, x0)), int(min(left + pixels.shape[1], x1 + 1))
                first, last = int(max(top, y0)), int(min(top + pixels.shape[0], y1 + 1))
                step = max(1, 200_000 // max(1, b - a))
                for y in range(first, last, step):
                    part = pixels[y - top : min(y + step, last) - top, a - left : b - left]
                    ys, xs = np.mgrid[y : y + part.shape[0], a : a + part.shape[1]].astype(np.int32)
                    columns = [pa.array([head.name] * part[..., 0].size, pa.string()), *(pa.array(v.ravel()) for v in (xs, ys)), *(pa.array(part[..., k].ravel().astype(np.int32)) for k in range(3))]
                    names = ["prj", "x", "y", "r", "g", "b"]
                    if self.tile_m or self.tile_px:
                        if not side:
                            raise ValueError(f"{head.path} has no scale, so its tiles in metres are unknown")
                        columns += [pa.array((np.floor(v.ravel() / side) + 1).astype(np.int32)) for v in (xs, ys)]
                        names += ["col", "row"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)


class FactsReader(DataSourceReader):
    """A row a file: what its header says. A file is a task."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [InputPartition(path) for path in files_of(self.path)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        head = read_header(partition.value)
        sx, sy = head.scale or (1.0, 1.0)
        x, y = head.corner or (0.0, 0.0)
        yield head.name, [head.width, head.height], [float(sx), -float(sy)], [float(x), y - head.height * sy, x + head.width * sx, float(y)], head.grid[0] * head.grid[1], head.path


def tiff_bytes(rgb: np.ndarray, window: tuple[int, int] | None = None, rows: int = 64, compression: int = DEFLATE, predictor: int = 1, big: bool = False, order: str = "<", planar: bool = False, scale: float | None = None, corner: tuple[float, float] = (0.0, 0.0)) -> bytes:
    """A TIFF file of an image (rows, columns, bands): strips of `rows` rows, or tiles of `window` (width, height)."""
    h, w, bands = rgb.shape
    ww, wh = window or (w, rows)
    blocks = []
    for plane in [rgb[..., k : k + 1] for k in range(bands)] if planar else [rgb]:
        for top in range(0, h, wh):
            for left in range(0, w, ww):
                block = plane[top : top + wh, left : left + ww]
                if window:
                    block = np.pad(block, ((0, wh - block.shape[0]), (0, ww - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                data = np.ascontiguousarray(block).tobytes()
                if compression == PACKBITS:
                    data = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))
                blocks.append(zlib.compress(data) if compression in (DEFLATE, OLD_DEFLATE) else data)
    start = 16 if big else 8
    offsets = [int(v) for v in start + np.append(0, np.cumsum([len(b) for b in blocks]))]
    word = "Q" if big else "I"
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [8] * bands), (259, "H", [compression]), (262, "H", [2 if bands >= 3 else 1]), (277, "H", [bands]), (284, "H", [2 if planar else 1]), (317, "H", [predictor])]
    if window:
        tags += [(322, "I", [ww]), (323, "I", [wh]), (324, word, offsets[:-1]), (325, word, [len(b) for b in blocks])]
    else:
        tags += [(273, word, offsets[:-1]), (278, "I", [rows]), (279, word, [len(b) for b in blocks])]
    if scale:
        tags += [(33550, "d", [scale, scale, 0.0]), (33922, "d", [0.0, 0.0, 0.0, corner[0], corner[1], 0.0])]
    codes = {v: k for k, v in TYPES.items()}
    at, room = offsets[-1] + offsets[-1] % 2, 8 if big else 4
    extra, entries = b"", b""
    for tag, kind, values in sorted(tags):
        value = struct.pack(f"{order}{len(values)}{kind}", *values)
        entries += struct.pack(order + "HH" + word, tag, codes[kind], len(values))
        entries += value.ljust(room, b"\0") if len(value) <= room else struct.pack(order + word, at + len(extra))
        extra += value + b"\0" * (len(value) % 2) if len(value) > room else b""
    mark = b"II" if order == "<" else b"MM"
    directory = at + len(extra)
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, directory) if big else struct.pack(order + "HI", 42, directory))
    count = struct.pack(order + ("Q" if big else "H"), len(tags))
    return head + b"".join(blocks) + b"\0" * (at - offsets[-1]) + extra + count + entries + b"\0" * room


class MosaicWriter(DataSourceArrowWriter):
    """A TIFF file a row (name, w, h, data: bytes of r, g, b by rows). A file appears under its name when it is whole, so a task that runs again
    writes the same files."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, batches):
        system, folder = open_at(self.path)
        system.create_dir(folder, recursive=True)
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], 3)
                with system.open_output_stream(f"{folder}/{row['name']}.tif.part-{id(row)}") as f:
                    f.write(tiff_bytes(image))
                system.move(f"{folder}/{row['name']}.tif.part-{id(row)}", f"{folder}/{row['name']}.tif")
                n += 1
        return WriterCommitMessage()


class Mosaics(DataSource):
    """spark.read.format("mosaics"): options path, tilePx or tileM, partitionPixels, facts."""

    @classmethod
    def name(cls):
        return "mosaics"

    def schema(self):
        if self.options.get("facts"):
            return FACTS
        return PIXELS + (", col int, row int" if "tilepx" in self.options or "tilem" in self.options else "")

    def reader(self, schema):
        return FactsReader(dict(self.options)) if self.options.get("facts") else MosaicReader(dict(self.options))

    def writer(self, schema, overwrite):
        return MosaicWriter(dict(self.options))


def _registered(spark: SparkSession):
    spark.dataSource.register(Mosaics)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("mosaics")


def read_mosaics(spark: SparkSession, path: str, tile_px: float | None = None, tile_m: float | None = None, partition_pixels: int = 1 << 21) -> DataFrame:
    """prj (the file's name), x, y, r, g, b of each pixel of the TIFF files at a path (a file, or all below a folder), by windows; with tile_px (a tile's side in pixels)
    or tile_m (in metres, by the file's scale) also col and row of the grid (see operators.grid), from 1. Filters on prj, x, y, col and row leave other files and
    windows unread. A folder without TIFF files gives no rows."""
    reader = _registered(spark).option("path", path).option("partitionPixels", partition_pixels)
    for key, value in (("tilePx", tile_px), ("tileM", tile_m)):
        reader = reader.option(key, value) if value else reader
    return reader.load()


def mosaic_facts(spark: SparkSession, path: str) -> DataFrame:
    """prj, image_dimensions, pixel_size, image_extents (as in a project's manifest), windows and path of each TIFF file, from its header alone. A file without
    a scale has pixels of 1 by 1 from (0, 0)."""
    return _registered(spark).option("path", path).option("facts", True).load()


def write_mosaics(images: DataFrame, path: str) -> None:
    """A TIFF file for each row (name, w, h, data) of images, tiles of a mosaic for example; a row is held whole."""
    spark = images.sparkSession
    spark.dataSource.register(Mosaics)
    images.select("name", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "data").write.format("mosaics").option("path", path).mode("append").save()
