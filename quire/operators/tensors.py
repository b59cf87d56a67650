"""Packed images at other sizes, and as tensors for a model and back."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quire.operators import images as I


TENSOR = "tensor_width int, tensor_height int, left int, top int, inner_width int, inner_height int, data array<float>"


@lru_cache(maxsize=64)
def weights(old: int, new: int) -> np.ndarray:
    """How much each of ``old`` pixels along an axis is of each of ``new``; rows sum to 1.

    A smaller axis takes areas: a new pixel is the mean of what it covers. A larger one is bilinear: a new
    pixel lies between the two old ones nearest to its centre, and repeats the last one at the ends.
    """
    i, j = np.arange(new)[:, None], np.arange(old)[None, :]
    if new <= old:
        return np.maximum(0.0, np.minimum((i + 1) * old / new, j + 1) - np.maximum(i * old / new, j)) * new / old
    centre = np.clip((i + 0.5) * old / new - 0.5, 0, old - 1)
    return np.maximum(0.0, 1 - np.abs(centre - j))


def resample(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size: first along the rows, then along the columns; values half-way go up."""
    if image.shape[:2] == (height, width):
        return image.copy()
    across = np.einsum("yxc,nx->ync", image.astype(float), weights(image.shape[1], width))
    v = np.einsum("ync,my->mnc", across, weights(image.shape[0], height))
    return np.clip(np.floor(np.round(v, 6) + 0.5), 0, 255).astype(np.uint8)


def _planes(image: np.ndarray) -> tuple[bytes, ...]:
    return tuple(np.ascontiguousarray(image[:, :, k]).tobytes() for k in range(3))


def resampled(images: DataFrame, width: int, height: int) -> DataFrame:
    """``images`` at ``width`` x ``height``."""
    kernel = lambda row: [(width, height, *_planes(resample(I.pixels_of(row), width, height)))]
    return I.per_image(images, ["capture_id"], kernel, "width long, height long, r binary, g binary, b binary")


def colour_variance(images: DataFrame, most: int = 100) -> DataFrame:
    """``capture_id, variance``: root of the summed channel variances of the image at ``most`` pixels a side at the most."""

    def kernel(row: dict) -> list[tuple]:
        v = resample(I.pixels_of(row), min(most, row["width"]), min(most, row["height"])).reshape(-1, 3).astype(np.int64)
        n = len(v)
        return [(round(float(np.sqrt(max(0.0, ((v * v).sum(axis=0) / n - (v.sum(axis=0) / n) ** 2).sum()))), 6),)]

    return I.per_image(images, ["capture_id"], kernel, "variance double")


def letterbox(width: int, height: int, size: int, step: int = 32) -> tuple[int, int, int, int, int, int]:
    """Scaled width and height, left and top pad, and the tensor's width and height (multiples of ``step``)."""
    scale = min(np.float32(size) / np.float32(width), np.float32(size) / np.float32(height))
    half_up = lambda v: max(1, int(np.floor(float(np.float32(v) * scale) + 0.5)))
    w, h = half_up(width), half_up(height)
    pad_w, pad_h = -w % step, -h % step
    return w, h, pad_w // 2, pad_h // 2, w + pad_w, h + pad_h


def to_tensors(images: DataFrame, size: int = 1024, fill: int = 114, step: int = 32) -> DataFrame:
    """``capture_id, width, height`` and ``TENSOR``: what a layout model takes.

    The image is scaled so that it fits ``size``, keeps its shape, and lies in the middle of a tensor of whole
    steps, at ``left`` and ``top``; ``data`` is channel after channel, row by row, 0 to 1, with ``fill`` around
    the image.
    """

    def kernel(row: dict) -> list[tuple]:
        w, h, left, top, tw, th = letterbox(row["width"], row["height"], size, step)
        out = np.full((th, tw, 3), fill, np.uint8)
        out[top : top + h, left : left + w] = resample(I.pixels_of(row), w, h)
        return [(tw, th, left, top, w, h, (out.transpose(2, 0, 1).ravel() / np.float32(255)).astype(np.float32).tolist())]

    return I.per_image(images, ["capture_id", "width", "height"], kernel, TENSOR)


def from_tensors(tensors: DataFrame, unit: float = 255.0) -> DataFrame:
    """Packed images of ``to_tensors`` rows, or of a model's output in their shape, without the pads and at the first size.

    Values times ``unit`` are clamped to 0..255 and cut to whole numbers (a hair below one counts as it).
    """

    def kernel(row: dict) -> list[tuple]:
        v = np.asarray(row["data"], np.float64).reshape(3, row["tensor_height"], row["tensor_width"]).transpose(1, 2, 0)
        inner = v[row["top"] : row["top"] + row["inner_height"], row["left"] : row["left"] + row["inner_width"]]
        img = np.floor(np.clip(inner * unit, 0, 255) + 1e-3).astype(np.uint8)
        return [_planes(resample(img, row["width"], row["height"]))]

    return I.per_image(tensors, ["capture_id", "width", "height"], kernel, "r binary, g binary, b binary")


def mask_tensors(masks: DataFrame) -> DataFrame:
    """``capture_id, width, height, data``: one channel, 1 where a mask plane is above 128, else 0."""
    kernel = lambda row: [((np.frombuffer(row["mask"], np.uint8) > 128).astype(np.float32).tolist(),)]
    return I.per_image(masks, ["capture_id", "width", "height"], kernel, "data array<float>")
