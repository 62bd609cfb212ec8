"""Image features: one row an image in, one row out; pixels do not leave this stage."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vistaspark.kernels import image as I
from vistaspark.kernels import keypoints as K
from vistaspark.schemas import COMPACT, FEATURES
from vistaspark.sources.exif import upright

#: Rows of a frame that leaves a task; features of one image take megabytes.
FRAME_ROWS = 16


def pixels(row) -> np.ndarray:
    if row.data is None or row.height is None or row.height <= 0:
        raise ValueError(f"cannot decode {row.path}")
    return upright(np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.channels)), int(row.orientation))


def extract(bgr: np.ndarray, max_size: int, per_variant: int) -> dict:
    """All features of one image: edges, gradient and descriptor of the first tone variant, keypoints of all."""
    small = I.resize_max_side(bgr, max_size)
    gray = I.to_gray(small)
    mask, clipped = I.feature_mask(gray)
    variants = I.normalize_variants(gray)
    first = variants[0][1]
    edges, gradient = I.edge_image(first), I.gradient_image(first)
    found = [K.detect(v, per_variant, mask) for _, v in variants]
    xy, desc = np.concatenate([p for p, _ in found]), K.root_normalize(np.concatenate([d for _, d in found]))
    return {
        "width": gray.shape[1], "height": gray.shape[0], "original_width": bgr.shape[1], "original_height": bgr.shape[0], "clipped_ratio": float(clipped),
        "descriptor": I.coarse_descriptor(first, edges, gradient), "edges": edges, "gradient": gradient, "xy": xy, "desc": desc,
    }


def _saved(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def dump(features: dict) -> tuple[bytes, bytes]:
    """(keypoints, maps): what only matching needs, and what every alignment needs."""
    desc = features["desc"]
    keypoints = _saved(xy=features["xy"], desc=np.zeros((0, 128), np.float32) if desc is None else desc)
    return keypoints, _saved(edges=features["edges"] > 0, gradient=features["gradient"])


def undump(row) -> dict:
    """Features of one row; without its keypoints where the row has none."""
    maps = np.load(io.BytesIO(row.maps))
    out = {
        "width": int(row.width), "height": int(row.height), "original_width": int(row.original_width), "original_height": int(row.original_height),
        "edges": maps["edges"].astype(np.uint8) * 255, "gradient": maps["gradient"],
    }
    if getattr(row, "keypoints", None) is not None:
        found = np.load(io.BytesIO(row.keypoints))
        out |= {"xy": found["xy"], "desc": found["desc"]}
    return out


def _framed(frames: Iterator[pd.DataFrame], of) -> Iterator[pd.DataFrame]:
    """``of`` each row, some rows a frame."""
    for frame in frames:
        for lo in range(0, len(frame), FRAME_ROWS):
            yield pd.DataFrame([of(r) for r in frame.iloc[lo : lo + FRAME_ROWS].itertuples(index=False)])


def extract_features(images: DataFrame, max_size: int, per_variant: int) -> DataFrame:
    """Features of every image, turned as its file says; fails on one that cannot be decoded."""

    def of(r) -> dict:
        f = extract(pixels(r), max_size, per_variant)
        keypoints, maps = dump(f)
        return {
            "index": r.index, "keypoints": keypoints, "maps": maps, "width": f["width"], "height": f["height"],
            "original_width": f["original_width"], "original_height": f["original_height"], "clipped_ratio": f["clipped_ratio"], "descriptor": f["descriptor"].tolist(),
        }

    return images.select("index", "path", "height", "width", "channels", "data", "orientation").mapInPandas(lambda frames: _framed(frames, of), FEATURES)


def extract_compact(images: DataFrame, max_size: int) -> DataFrame:
    """(index, filename, width, height, descriptor) for the plans over large sets; sizes are the resized ones."""

    def of(r) -> dict:
        f = I.compact_features(pixels(r), max_size)
        return {"index": r.index, "filename": r.filename, "width": f["width"], "height": f["height"], "descriptor": f["descriptor"].tolist()}

    return images.select("index", "path", "filename", "height", "width", "channels", "data", "orientation").mapInPandas(lambda frames: _framed(frames, of), COMPACT)
