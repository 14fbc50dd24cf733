"""Training sets out of transcribed pages, and their evaluation."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import char_error_rate, first_number, strip
from quillspark.operators.identity import dense_ids
from quillspark.sources.templates import BUILT_IN, Template

# The columns on the left half of an open double page; the right half has the others.
LEFT = {
    "oddani": (
        "cislo jmeno_oddavajiciho misto_oddavek datum_ohlasek datum_oddavek zenich_jmeno_stav_rodice zenich_misto_prebyvani "
        "zenich_nabozenstvi nevesta_jmeno_stav_rodice nevesta_misto_prebyvani nevesta_nabozenstvi"
    ).split(),
    "narozeni": "cislo datum_narozeni datum_krtu krtitel dite_jmeno nabozenstvi dite_pohlavi dite_manzelske otec_jmeno_stav otec_bydliste".split(),
}
_BRACE, _FENCE = re.compile("[{}]"), re.compile(r"(?m)^```(?:json)?|```$")
HEADINGS = {"oddani": {"rok": "left", "folio": "right"}, "narozeni": {"rok": "right", "folio": "right"}}


def visible_keys(typ: str, side: str) -> list[str]:
    """The keys that a half page shows."""
    left = set(LEFT[typ])
    return [k for k in BUILT_IN[typ].keys if (k in left) == (side == "left")]


def usable(scans: DataFrame, images: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """scans (book_id, file, seq) with an image (book_id, file, sha256), not excluded, the first of equal images."""
    s = scans.join(images, ["book_id", "file"])
    if excluded is not None:
        s = s.join(excluded, "book_id", "left_anti")
    first = s.groupBy("sha256").agg(F.min("seq").alias("seq"))
    return s.join(first, ["sha256", "seq"], "left_semi")


def with_split(scans: DataFrame, val_books: list[str], tails: dict[str, int]) -> DataFrame:
    """split: val for whole books and for the last folios of others, else train; a folio is never in both."""
    number = first_number("folio")
    n = F.coalesce(*(F.when(F.col("book_id") == b, F.lit(k)) for b, k in tails.items()), F.lit(0))
    rank = F.dense_rank().over(Window.partitionBy("book_id").orderBy(F.desc_nulls_last("__folio")))
    val = F.col("book_id").isin(*val_books) | F.col("__folio").isNotNull() & (F.col("__rank") <= n)
    return scans.withColumn("__folio", number).withColumn("__rank", rank).withColumn("split", F.when(val, "val").otherwise("train")).drop("__folio", "__rank")


def half_rows(rows: Column | str, t: Template, side: str) -> Column:
    """All rows with the cells of the other half emptied."""
    shown = F.array(*map(F.lit, visible_keys(t.typ, side)))
    keys = F.array(*map(F.lit, t.keys))
    return F.transform(rows, lambda r: F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.array_contains(shown, k), F.coalesce(F.try_element_at(r, k), F.lit(""))).otherwise(""))))


def half_samples(scans: DataFrame, t: Template) -> DataFrame:
    """Two samples per page (book_id, file, folio, rok, rows): side, id, target."""
    heading = lambda name, side: F.coalesce(F.col(name), F.lit("")) if HEADINGS[t.typ][name] in (side, "both") else F.lit("")
    one = lambda side: F.struct(F.lit(side).alias("side"), F.to_json(F.struct(heading("folio", side).alias("folio"), heading("rok", side).alias("rok"), half_rows("rows", t, side).alias("rows"))).alias("target"))
    s = scans.withColumn("__half", F.explode(F.array(one("left"), one("right")))).select("*", "__half.*").drop("__half")
    scan = F.regexp_replace("file", r"\.[^.]*$", "")
    return s.withColumn("id", F.replace(F.concat_ws("_", "book_id", scan, F.upper(F.substring("side", 1, 1))), F.lit(" "), F.lit("_")))


def every(df: DataFrame, step: int, order: str, by: str | None = None) -> DataFrame:
    """Each step-th row in order, the first included."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))) if by else dense_ids(df, [order], "__n")
    return numbered.where((F.col("__n") - 1) % step == 0).drop("__n")


def uniform_window(heights: Column | str, n: Column | int, most: float = 0.35) -> Column:
    """Where (from 1) the n neighbours of least variation start, or null; all of them if there are n."""
    h = F.col(heights) if isinstance(heights, str) else heights
    n = F.lit(n) if isinstance(n, int) else n

    def variation(i: Column) -> Column:
        part = F.slice(h, i, n)
        mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n
        square = F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.struct((F.sqrt(square / n) / mean).alias("cv"), i.alias("i"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1))), variation))
    return F.when(F.size(h) == n, F.lit(1)).when((F.size(h) > n) & (best["cv"] < most), best["i"])


def row_samples(pages: DataFrame, bands: str = "bands", rows: str = "rows", heights: str = "heights") -> DataFrame:
    """Pages whose bands (after uniform_window) match their rows one to one: pos, band, row."""
    at = uniform_window(heights, F.size(rows))
    paired = F.arrays_zip(F.slice(bands, at, F.size(rows)).alias("band"), F.col(rows).alias("row"))
    return pages.where(at.isNotNull()).select("*", F.posexplode(paired).alias("pos", "__p")).select("*", F.col("__p.band").alias("band"), F.col("__p.row").alias("row")).drop("__p")


def evaluation(samples: DataFrame, by: str = "book_id") -> DataFrame:
    """Per group and in all (null): n, json_valid, rowcount_match, cer, field_accuracy of truth and got (arrays of cell maps; got null if unreadable)."""
    pairs = samples.select(by, "truth", "got")
    fields = pairs.where("got IS NOT NULL").select(by, F.explode(F.arrays_zip(F.slice("truth", 1, F.least(F.size("truth"), F.size("got"))).alias("t"), F.slice("got", 1, F.least(F.size("truth"), F.size("got"))).alias("g"))).alias("z"))
    cells = fields.where("z.g IS NOT NULL").select(by, F.col("z.g").alias("g"), F.explode("z.t").alias("k", "tv")).withColumn("gv", strip(F.try_element_at("g", "k"))).withColumn("tv", strip("tv"))
    error = F.when(F.col("tv") != "", char_error_rate("tv", "gv"))
    f = cells.rollup(by).agg(F.avg(error).alias("cer"), F.avg((F.col("tv") == F.col("gv")).cast("double")).alias("field_accuracy"))
    s = pairs.rollup(by).agg(F.count("*").alias("n"), F.count_if(F.col("got").isNotNull()).alias("json_valid"), F.count_if(F.size("truth") == F.size("got")).alias("rowcount_match"))
    return s.join(f.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def _reply_rows(reply: str | None) -> list[dict[str, str] | None] | None:
    """The rows of the first balanced {...} of a reply, braces in strings counted too; an object without rows is a row; null if it can't be read."""
    text = _FENCE.sub("", (reply or "").strip())
    braces = [(m.start(), 1 if m[0] == "{" else -1) for m in _BRACE.finditer(text, max(text.find("{"), 0))]
    ends = (at for (at, _), depth in zip(braces, accumulate(d for _, d in braces), strict=True) if not depth)
    if not braces or braces[0][1] < 0 or (end := next(ends, None)) is None:
        return None
    try:
        found = json.loads(text[braces[0][0] : end + 1])
    except ValueError:
        return None
    rows = (found["rows"] or []) if "rows" in found else [found]
    return [{k: str(v or "") for k, v in r.items()} if isinstance(r, dict) else None for r in rows] if isinstance(rows, list) else []


_CELLS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


@F.arrow_udf(_CELLS)
def reply_rows(replies: pa.Array) -> pa.Array:
    """Cell maps of each reply of a transcriber, or of a sample's target; a row that is no object is null, a reply without JSON too."""
    rows = [_reply_rows(x) for x in replies.to_pylist()]
    return pa.array([None if r is None else [None if c is None else list(c.items()) for c in r] for r in rows], pa.list_(pa.map_(pa.string(), pa.string())))


def with_replies(samples: DataFrame, target: str = "target", reply: str = "reply") -> DataFrame:
    """samples with truth and got, the rows of target and reply, for evaluation()."""
    return samples.withColumns({"truth": F.coalesce(reply_rows(F.col(target)), F.array().cast(_CELLS)), "got": reply_rows(F.col(reply))})


def dataset_report(halves: DataFrame, rows: DataFrame, by: str = "book_id") -> DataFrame:
    """Per book: half pages, those matched to rows, rows."""
    h = halves.groupBy(by).agg(F.count("*").alias("halves"), F.count_if("matched").alias("matched"))
    return h.join(rows.groupBy(by).agg(F.count("*").alias("rows")), by, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
