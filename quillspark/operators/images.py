"""Half pages and smaller copies of scans; needs an imaging library on the executors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LEFT_SHARE, RIGHT_FROM = 0.52, 0.48


def resized(images: DataFrame, side: str = "whole", most_side: int | None = None, quality: int = 90) -> DataFrame:
    """path, side, content: the left or right half (they overlap by four per cent) or all of each image, at most most_side pixels long."""
    if side not in ("whole", "left", "right"):
        raise ValueError(f"no side {side!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from PIL import Image

        for b in batches:
            out = []
            for content in b["content"]:
                im = Image.open(io.BytesIO(content)).convert("RGB")
                w, h = im.size
                box = {"whole": (0, 0, w, h), "left": (0, 0, int(w * LEFT_SHARE), h), "right": (int(w * RIGHT_FROM), 0, w, h)}[side]
                im = im.crop(box)
                if most_side and max(im.size) > most_side:
                    k = most_side / max(im.size)
                    im = im.resize((max(1, round(im.size[0] * k)), max(1, round(im.size[1] * k))))
                buffer = io.BytesIO()
                im.save(buffer, "JPEG", quality=quality)
                out.append(buffer.getvalue())
            yield pd.DataFrame({"path": b["path"], "side": side, "content": out})

    return images.select("path", "content").mapInPandas(run, "path string, side string, content binary")
