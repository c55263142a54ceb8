"""Readers of binary containers: files as rows of bytes, unpacked by Arrow-batched functions."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_zip_members(spark: SparkSession, paths: str | list[str], pattern: str = r"(\d+)\.\w+$") -> DataFrame:
    """(path, member, size, number): the members of ZIP files, and the number that the pattern finds in their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        found = re.search(pattern, info.filename)
                        rows.append((path, info.filename, info.file_size, int(found[1]) if found else None))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "number"]).astype({"number": "Int64"})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, member string, size long, number long")


def read_images_bin(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Registered images of a COLMAP model: (path, image_id, name, q array, t array, camera_id, points)."""

    def images(data: bytes) -> Iterator[tuple]:
        (n,), at = struct.unpack_from("<Q", data), 8
        for _ in range(n):
            head = struct.unpack_from("<I7dI", data, at)
            at += struct.calcsize("<I7dI")
            end = data.index(b"\0", at)
            name = data[at:end].decode()
            (points,) = struct.unpack_from("<Q", data, end + 1)
            at = end + 9 + points * 24
            yield head[0], name, list(head[1:5]), list(head[5:8]), head[8], points

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *x) for path, content in zip(batch["path"], batch["content"], strict=True) for x in images(content)]
            yield pd.DataFrame(rows, columns=["path", "image_id", "name", "q", "t", "camera_id", "points"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, image_id long, name string, q array<double>, t array<double>, camera_id long, points long")


def read_sens_frames(spark: SparkSession, paths: str | list[str], stride: int = 1) -> DataFrame:
    """Every ``stride``-th frame of recorded sensor streams: (path, frame, pose array of 16, t_color, t_depth, color, depth bytes)."""

    def frames(data: bytes) -> Iterator[tuple]:
        version, length = struct.unpack_from("<IQ", data)
        at = 12 + length + 4 * 64 + 8 + 16 + 4
        (count,) = struct.unpack_from("<Q", data, at)
        at += 8
        for i in range(count):
            pose = list(struct.unpack_from("<16f", data, at))
            t_color, t_depth, n_color, n_depth = struct.unpack_from("<4Q", data, at + 64)
            start = at + 96
            at = start + n_color + n_depth
            if i % stride == 0:
                yield i, pose, t_color, t_depth, data[start : start + n_color], data[start + n_color : at]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *x) for x in frames(content)], columns=["path", "frame", "pose", "t_color", "t_depth", "color", "depth"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, frame long, pose array<double>, t_color long, t_depth long, color binary, depth binary")


def image_statistics(images: DataFrame, content: str = "content", size: int = 64) -> DataFrame:
    """Adds width, height, brightness, deviation and sharpness (variance of the Laplacian) of encoded images.

    Needs Pillow on the workers; rows it cannot decode get nulls.
    """
    names = ["width", "height", "brightness", "deviation", "sharpness"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema), "width int, height int, brightness double, deviation double, sharpness double"])

    def one(data: bytes) -> tuple:
        import numpy as np

        try:
            from PIL import Image

            image = Image.open(io.BytesIO(data))
            gray = np.asarray(image.convert("L").resize((size, size)), float) / 255
        except Exception:
            return (None,) * 5
        inner = 4 * gray[1:-1, 1:-1] - gray[:-2, 1:-1] - gray[2:, 1:-1] - gray[1:-1, :-2] - gray[1:-1, 2:]
        return (*image.size, float(gray.mean()), float(gray.std()), float(inner.var()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([one(x) for x in batch[content]], columns=names, index=batch.index)
            yield pd.concat([batch, found.astype({"width": "Int32", "height": "Int32"})], axis=1)

    return images.mapInPandas(run, schema)
