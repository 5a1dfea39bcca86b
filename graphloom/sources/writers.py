"""Writers: submissions, segment dumps, detection results. Files come from Spark's own committers."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.voxel import AXES


def submission(rows: DataFrame, path: str, key: str = "id") -> None:
    """One CSV with a header, ordered by key; for results a person uploads, hence one file."""
    rows.orderBy(key).coalesce(1).write.mode("overwrite").csv(path, header=True)


def table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def segment_dump(segments: DataFrame, path: str) -> None:
    """Blocks of a video's name and its `[[s, e, c], ...]`, sorted by name."""
    listed = segments.groupBy("video").agg(F.array_sort(F.collect_list(F.array(F.col("s").cast("double"), F.col("e").cast("double"), F.col("cls").cast("double")))).alias("a"))
    listed.orderBy("video").select(F.concat("video", F.lit("\n"), F.to_json("a"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def voc_results(detections: DataFrame, path: str) -> None:
    """A folder a class with lines `image score x1 y1 x2 y2`: three decimals, corners from 1 with one decimal."""
    line = F.format_string("%s %.3f %.1f %.1f %.1f %.1f", "image", "score", *(F.col(c) + 1 for c in ("x1", "y1", "x2", "y2")))
    detections.select("cls", line.alias("value")).write.mode("overwrite").partitionBy("cls").text(path)


def coco_results(detections: DataFrame, path: str) -> None:
    """JSON lines image_id, category_id, bbox as x, y, width, height, score."""
    box = F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1)
    detections.select(F.col("image").alias("image_id"), F.col("cls").alias("category_id"), box.alias("bbox"), "score").write.mode("overwrite").json(path)


def thresholds(rows: DataFrame, path: str) -> None:
    rows.orderBy("cls").select(F.format_string("%s %.3f", "cls", "threshold").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def by_prefix(rows: DataFrame, path: str, name: str = "name", lengths: tuple[int, int] = (14, 22)) -> None:
    """Parquet in folders by two prefixes of the name."""
    a, b = lengths
    rows.withColumns({"p1": F.substring(name, 1, a), "p2": F.substring(name, 1, b)}).write.mode("overwrite").partitionBy("p1", "p2").parquet(path)


def model(fitted, path: str) -> None:  # noqa: ANN001
    """Any MLlib model."""
    fitted.write().overwrite().save(path)


def one_file(lines: DataFrame, path: str) -> None:
    """A text file of exactly this name from rows (value), in the frame's order: Spark writes one part, Hadoop's file system renames it.

    For files that people or other programs name and read: class lists, image sets, annotations of one class.
    """
    parts = f"{path}.parts"
    lines.coalesce(1).write.mode("overwrite").text(parts)
    jvm = lines.sparkSession._jvm
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(lines.sparkSession._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"cannot rename {part.toString()} to {path}")
    fs.delete(folder, True)


def embedding_text(vectors: DataFrame, path: str) -> None:
    """Lines `token x1 x2 ...` of (token, vec), every number with all its digits; a folder of parts."""
    vectors.select(F.concat_ws(" ", "token", F.concat_ws(" ", F.col("vec").cast("array<string>"))).alias("value")).write.mode("overwrite").text(path)


def volumes(voxels: DataFrame, path: str, size: tuple[int, int, int]) -> DataFrame:
    """Writes an NPZ file with arrays `voxel` and `seg` for each id of (id, z, y, x, val, seg); returns id, uri. A task holds one volume."""
    base = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        fs, at = pyarrow.fs.FileSystem.from_uri(f"{base}/{rows['id'].iloc[0]}.npz")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        out, place = io.BytesIO(), tuple(rows[a].to_numpy() for a in AXES)
        arrays = {name: np.zeros(size) for name in ("voxel", "seg")}
        arrays["voxel"][place], arrays["seg"][place] = rows["val"], rows["seg"]
        np.savez(out, **arrays)
        with fs.open_output_stream(at) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"id": [rows["id"].iloc[0]], "uri": [f"{base}/{rows['id'].iloc[0]}.npz"]})

    return voxels.select("id", *AXES, "val", "seg").groupBy("id").applyInPandas(write, "id long, uri string")
