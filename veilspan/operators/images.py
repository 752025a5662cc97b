"""Pixels of a table as its model takes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def weights(old: int, new: int) -> np.ndarray:
    """(new, old): each new pixel's shares of the two old ones whose centers are next to its own; edges repeat."""
    at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    low = np.minimum(at.astype(np.int64), max(old - 2, 0))
    out = np.zeros((new, old), np.float32)
    out[np.arange(new), low] = 1 - (at - low)
    out[np.arange(new), np.minimum(low + 1, old - 1)] += at - low
    return out


def prepared(image: np.ndarray, mean: list[float], std: list[float], size: int) -> np.ndarray:
    """From (height, width, channel) pixels of 0 to 255: normalized, resized by linear interpolation to a square, and
    (1, channel, width, height), in that order."""
    scaled = (image.astype(np.float32) / 255 - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)
    return np.einsum("yh,xw,hwc->cxy", weights(image.shape[0], size), weights(image.shape[1], size), scaled, optimize=True)[None].astype(np.float32)


def prepare(images: DataFrame, mean: list[float], std: list[float], size: int = 448) -> DataFrame:
    """table_id, pixels array<float> for rows (table_id, height, width, content: bytes of three channels); null content, or
    of another length, gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, data in zip(b["height"], b["width"], b["content"], strict=True):
                whole = data is not None and len(data) == h * w * 3 > 0
                out.append(prepared(np.frombuffer(bytes(data), np.uint8).reshape(h, w, 3), mean, std, size).ravel() if whole else None)
            yield pd.DataFrame({"table_id": b["table_id"], "pixels": out})

    kind = images.schema["table_id"].dataType.simpleString()
    return images.select("table_id", "height", "width", "content").mapInPandas(run, f"table_id {kind}, pixels array<float>")
