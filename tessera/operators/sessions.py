"""Segmentation by a model file: one load per Python worker, batches of tensors of many images.

The chain: images are scaled to the model's size and normalised (tensors, channel by
channel), ``predict_batch_udf`` hands batches of them to the model, and each answer is
scaled by its least and largest value to a mask of the image's own size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F

from .rasters import DEVIATION, MEAN, _raster, weights


def scaled(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """An array (height, width, ...) resampled to h x w by Lanczos, as whole values 0..255."""
    out = np.einsum("ij,jk...->ik...", weights(plane.shape[0], h, "lanczos"), plane)
    out = np.einsum("ij,kj...->ki...", weights(plane.shape[1], w, "lanczos"), out)
    return np.clip(np.floor(out + 0.5), 0, 255)


def tensor_of(img: np.ndarray, size: int) -> np.ndarray:
    small = scaled(img[..., :3].astype(float), size, size)
    return ((small / max(small.max(), 255e-6) - np.array(MEAN)) / np.array(DEVIATION)).transpose(2, 0, 1).astype(np.float32)


def mask_of(answer: np.ndarray, h: int, w: int) -> np.ndarray:
    span = max(float(answer.max() - answer.min()), 1e-6)
    return scaled(np.floor((answer - answer.min()) / span * 255), h, w).astype(int)


def tensors(px: DataFrame, size: int) -> DataFrame:
    """img_id, h, w and tensor (3 * size * size floats) of every image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = _raster(pdf).astype(float)
        return pd.DataFrame([(pdf["img_id"].iloc[0], img.shape[0], img.shape[1], tensor_of(img, size).ravel())], columns=["img_id", "h", "w", "tensor"])

    return px.groupBy("img_id").applyInPandas(run, "img_id long, h int, w int, tensor array<float>")


def segment(px: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int = 320, batch: int = 16) -> DataFrame:
    """Masks (img_id, x, y, m) of every image. ``load`` opens the session: a function without arguments
    that returns predict(tensors of shape (n, 3, size, size)) -> (n, size, size); it is
    called once in each Python worker, which keeps the session for all batches it gets."""

    def make():
        predict = load()
        return lambda inputs: np.asarray(predict(inputs), np.float32).reshape(len(inputs), size * size)

    from pyspark.sql.types import ArrayType, FloatType

    answer = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[3, size, size]])

    def back(batches):
        for rows in batches:
            for img_id, h, w, values in zip(rows["img_id"], rows["h"], rows["w"], rows["answer"]):
                mask = mask_of(np.asarray(values, float).reshape(size, size), h, w)
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"img_id": img_id, "x": x, "y": y, "m": mask.ravel()})

    answered = tensors(px, size).select("img_id", "h", "w", answer(F.col("tensor")).alias("answer"))
    return answered.mapInPandas(back, "img_id long, x int, y int, m int")


def convolution(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A session over a NumPy file with ``kernel`` (3, k, k) and ``bias``: one convolution and a sigmoid."""

    def load():
        from pyarrow import fs

        where, plain = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with where.open_input_file(plain) as f:
            file = np.load(f)
            kernel, bias = file["kernel"], float(file["bias"])
        k = kernel.shape[1] // 2

        def predict(inputs: np.ndarray) -> np.ndarray:
            padded = np.pad(inputs, ((0, 0), (0, 0), (k, k), (k, k)), mode="edge")
            h, w = inputs.shape[2:]
            total = sum(kernel[c, i, j] * padded[:, c, i:i + h, j:j + w] for c in range(3) for i in range(2 * k + 1) for j in range(2 * k + 1))
            return 1 / (1 + np.exp(-(total + bias)))

        return predict

    return load
