"""Augmentation of pictures in whole numbers alone, so that equal draws give equal pixels on every machine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Chances and sizes of the training chain, weights of the grey level (of 65536)
RESIZED, CROPPED = 256, 224
FLIP, CONTRAST, GREY = 0.5, 0.2, 0.15
RED_WEIGHT, GREEN_WEIGHT, BLUE_WEIGHT = 19595, 38470, 7471

#: Draws are whole numbers below this.
DRAWS = 1 << 32
#: Weights of a resize are multiples of 1 / ONE.
BITS = 16
ONE = 1 << BITS


@dataclass(frozen=True)
class Recipe:
    """The training chain: the shorter side becomes ``resized``, a random square of ``cropped`` is cut out, then chances decide."""

    resized: int = RESIZED
    cropped: int = CROPPED
    flip: float = FLIP
    contrast: float = CONTRAST
    grey: float = GREY

    def __post_init__(self):
        if not 1 <= self.cropped <= self.resized:
            raise ValueError("the crop must be of 1 pixel at least and fit into the resized picture")
        if not all(0 <= p <= 1 for p in (self.flip, self.contrast, self.grey)):
            raise ValueError("chances lie between 0 and 1")


@lru_cache(maxsize=256)
def resize_weights(source: int, target: int) -> np.ndarray:
    """target x source whole numbers that add up to ONE in each row: a triangle as wide as two target pixels (two source pixels when growing)."""
    scale = source / target
    reach = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    exact = np.maximum(0.0, 1 - np.abs(np.arange(source) + 0.5 - centre[:, None]) / reach)
    whole = np.floor(exact / exact.sum(axis=1, keepdims=True) * ONE + 0.5).astype(np.int64)
    whole[np.arange(target), whole.argmax(axis=1)] += ONE - whole.sum(axis=1)
    whole.flags.writeable = False
    return whole


def _along(rows: np.ndarray, target: int) -> np.ndarray:
    """The first axis resized, rounded to bytes."""
    if len(rows) == target:
        return rows
    mixed = np.tensordot(resize_weights(len(rows), target), rows.astype(np.int64), axes=1)
    return ((mixed + ONE // 2) >> BITS).astype(np.uint8)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A height x width picture of bytes: columns first, then rows."""
    return _along(_along(image.swapaxes(0, 1), width).swapaxes(0, 1), height)


def shorter_side(image: np.ndarray, side: int) -> np.ndarray:
    """The picture with its shorter side scaled to ``side``, the other one in proportion, rounded down."""
    height, width = image.shape[:2]
    if height <= width:
        return resized(image, side, side * width // height)
    return resized(image, side * height // width, side)


def stretched(image: np.ndarray) -> np.ndarray:
    """Each channel stretched to the whole range of bytes; one of a single value stays."""
    low, high = (f(axis=(0, 1)).astype(np.int64) for f in (image.min, image.max))
    out = (image - low) * 255 // np.maximum(high - low, 1)
    return np.where(high > low, out, image).astype(np.uint8)


def greyed(image: np.ndarray) -> np.ndarray:
    """The grey level in all three channels."""
    level = (image.astype(np.int64) @ np.array([RED_WEIGHT, GREEN_WEIGHT, BLUE_WEIGHT]) + 32768) >> 16
    return np.repeat(level.astype(np.uint8)[..., None], 3, axis=2)


def coloured(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)


def training_picture(image: np.ndarray, draws: list[int], recipe: Recipe) -> np.ndarray:
    """cropped x cropped x 3 bytes by five draws: row and column of the crop, flip, contrast, grey."""
    out, n = shorter_side(image, recipe.resized), recipe.cropped
    top, left = (draw * (size - n + 1) // DRAWS for draw, size in zip(draws[:2], out.shape[:2], strict=True))
    out = out[top : top + n, left : left + n]
    for draw, chance, change in zip(draws[2:], (recipe.flip, recipe.contrast, recipe.grey), (lambda x: x[:, ::-1], stretched, greyed), strict=True):
        if draw < chance * DRAWS:
            out = change(out)
    return out
