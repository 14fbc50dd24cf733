"""Row bands against plain definitions."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators import bands
from quillspark.plans import drawn


def flood_boxes(mask):
    """(width * height, x, y, width, height) of the 8-connected regions."""
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            todo, ys, xs = [(y, x)], [], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                ys.append(a)
                xs.append(b)
                for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            todo.append((i, j))
            w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
            out.append((w * h, min(xs), min(ys), w, h))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_parts_of_the_search(seed):
    r = np.random.default_rng(seed)
    gray = r.integers(0, 256, (r.integers(20, 50), r.integers(20, 50))).astype(np.uint8)
    gray = np.kron(gray, np.ones((2, 2), np.uint8))
    mask = gray > 110
    f = bands.Form(page_hole=3, window=7)
    h, w = mask.shape
    square = lambda m, k, inside: np.array([[(all if inside else any)(m[i, j] for i in range(max(0, y - k // 2), min(h, y + k // 2 + 1)) for j in range(max(0, x - k // 2), min(w, x + k // 2 + 1))) for x in range(w)] for y in range(h)])
    opened = square(square(mask, 3, True), 3, False)
    assert (bands.opened(mask, 3) == opened).all()
    box = bands.page_box(gray, f)
    found = flood_boxes(opened)
    assert (box[2] * box[3], *box) in found and box[2] * box[3] == max(found)[0]
    runs = bands.long_runs(mask, 4)
    for y in range(h):
        x = 0
        while x < w:
            end = x
            while end < w and mask[y, end]:
                end += 1
            assert runs[y, x : max(end, x + 1)].all() == (end - x >= 4) and runs[y, x : max(end, x + 1)].any() == (end - x >= 4)
            x = max(end, x + 1)
    wide = np.pad(gray.astype(int), 3, mode="edge")
    mean = np.array([[np.rint(wide[y : y + 7, x : x + 7].mean()) for x in range(w)] for y in range(h)])
    assert (bands.darker_than_around(gray, f) == (gray <= mean - 15)).all()


def test_bands_of_drawn_pages():
    page = drawn.drawn([40, 50, 45, 60], [5, 0, 9, 3], [True, True, True, False])
    y = drawn.GROUND + drawn.FIRST
    got, cuts = bands.row_bands(page)
    assert got == [(y, y + 40), (y + 90, y + 135)] and cuts[:6] == [drawn.GROUND + drawn.HEADER, y, y + 40, y + 90, y + 135, y + 195]
    assert bands.row_bands(np.zeros((40, 30), np.uint8)) == ([], []) and bands.row_bands(np.full((1, 1), 255, np.uint8)) == ([], [])
    assert (bands.decoded(bands.encoded(page)) == page).all()
    assert (bands.decoded(b"P5 # a note\n2 1\n255\n\x01\x02") == [[1, 2]]).all()


def test_bands_of_a_table(spark):
    page = drawn.drawn([40, 50], [5, 6], [True, True])
    df = spark.createDataFrame([(1, bytearray(bands.encoded(page)), "x"), (2, None, None)], "id long, content binary, bands_of string")
    got = {r["id"]: r for r in bands.banded(df).collect()}
    assert [tuple(b) for b in got[1]["bands"]] == bands.row_bands(page)[0] and got[1]["heights"] == [40.0, 50.0] and got[1]["bands_of"] == "x"
    assert got[2]["bands"] is None and got[2]["separators"] is None
    cut = bands.cut_out(bands.banded(df).where("id = 1").selectExpr("id", "content", "bands[1] AS band")).first()
    y0, y1 = cut["band"]
    assert (bands.decoded(bytes(cut["crop"])) == page[y0 - 10 : y1 + 10]).all()
    assert bands.banded(df.where("false")).count() == 0


def test_crops_of_whole_pages(spark):
    """All bands of a page are cut in one pass that sees its image once, in small batches; images needn't be passed on."""
    sheets = [drawn.drawn([40, 50, 45], [5, n, 6], [True, True, n % 2 == 0]) for n in range(70)]
    df = spark.createDataFrame([(i, bytearray(bands.encoded(x))) for i, x in enumerate(sheets)] + [(70, None)], "id long, content binary")
    assert bands.banded(df, keep=False).columns == ["id", "bands", "heights", "separators"]
    found = bands.banded(df)
    one = bands.cut_out(found.selectExpr("id", "content", "posexplode(bands) AS (p, band)"))
    want = {(r["id"], r["p"]): bytes(r["crop"]) for r in one.select("id", "p", "crop").collect()}
    whole = bands.cut_all(found)
    assert "content" not in whole.columns and len(want) == sum(len(bands.row_bands(x)[0]) for x in sheets)
    assert {(r["id"], p): bytes(c) for r in whole.collect() for p, c in enumerate(r["crops"] or ())} == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= bands.BATCH


def test_whole_numbers_as_masks():
    r = np.random.default_rng(5)
    for h, w in ((1, 1), (3, 64), (40, 63), (17, 130)):
        mask = r.random((h, w)) < 0.9
        b = bands.Bits.of(mask)
        assert (b.mask() == mask).all() and (b.mask(slice(1, 3)) == mask[1:3]).all()
        assert (bands._long(b, 5, down=True).mask() == bands.long_runs(mask.T, 5).T).all()


def test_bounds_settle_clean_pages_only_and_rightly():
    """What bounds settle is what the sums of all windows give; clean pages are settled, shaded ones summed."""
    f, r = bands.Form(), np.random.default_rng(8)
    around = lambda gray, half: np.pad(gray, half, mode="edge")
    page = drawn.drawn([40, 50, 45, 38], [8, 9, 0, 14], [True, True, True, False])
    sheet = page[drawn.GROUND : -drawn.GROUND, drawn.GROUND : -drawn.GROUND]
    sure = bands._surely_darker(around(sheet, 25), f)
    assert sure is not None and (sure == bands._darker(around(sheet, 25), f)).all() and sure.any()
    assert bands._surely_darker(around(np.full((90, 90), 128, np.uint8) - np.arange(90).astype(np.uint8), 25), f) is None
    settled = 0
    for seed in range(60):
        h, w = r.integers(20, 70, 2)
        gray = np.where(r.random((h, w)) < 0.02, r.integers(0, 60), r.integers(180, 190 + seed % 30, (h, w))).astype(np.uint8)
        g = bands.Form(window=int(r.choice([9, 15, 51])))
        sure = bands._surely_darker(around(gray, g.window // 2), g)
        settled += sure is not None
        assert sure is None or (sure == bands._darker(around(gray, g.window // 2), g)).all()
    assert 0 < settled < 60


def test_page_box_without_regions():
    """Where a row and a column run through the bounds, regions needn't be told apart; the box is the same."""
    r = np.random.default_rng(9)
    crossed = 0
    for _ in range(40):
        gray = np.where(np.kron(r.random((9, 9)) < 0.85, np.ones((5, 5), bool)), 200, 20).astype(np.uint8)
        gray[20:25] = 200
        gray[:, 10:15] = 200
        f = bands.Form(page_hole=3)
        boxes = flood_boxes(bands.opened(gray > f.bright, 3))
        crossed += bands._crossed(bands._eroded(bands.Bits.of(gray > f.bright, 3), 3)) is not None
        box = bands.page_box(gray, f)
        assert (box[2] * box[3], *box) == max(boxes)
    assert crossed


def test_images_opened_in_the_task(spark):
    """Images that a function opens give what images of a column give, and are in no plan's rows."""
    sheets = {1: drawn.drawn([40, 50], [5, 6], [True, True]), 2: None, 3: drawn.drawn([45, 37, 41], [3, 0, 9], [True, True, True])}
    kept = {k: None if v is None else bands.encoded(v) for k, v in sheets.items()}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in kept.items()], "id long, content binary")
    opened = lambda b: [kept[i] for i in b.column(0).to_pylist()]
    found = bands.banded(df.select("id"), opened)
    assert "content" not in found.columns
    assert sorted(found.collect()) == sorted(bands.banded(df, keep=False).collect())


def test_crops_of_images_opened_in_the_task(spark):
    """Bands are cut from images that are opened again, not passed on."""
    kept = [bands.encoded(drawn.drawn([40 + n, 50], [5, 6 + n], [True, n != 2])) for n in range(4)] + [None]
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(kept)], "id long, content binary")
    opened = lambda b: [kept[i] for i in b.column(0).to_pylist()]
    want = bands.cut_all(bands.banded(df)).select("id", "crops").collect()
    assert sorted(bands.cut_all(bands.banded(df.select("id"), opened), opened).select("id", "crops").collect()) == sorted(want)
    assert [len(r["crops"] or ()) for r in sorted(want)] == [2, 2, 1, 2, 0]
