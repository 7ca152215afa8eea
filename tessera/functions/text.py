"""Tokens and chunks of texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a text is cut into before windows are taken over it.
UNITS = ("character", "word", "sentence", "passage")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def units(text: Column, by: str) -> Column:
    """A text's units.

    Words and sentences are cut by patterns: a word is a run of letters, digits and marks inside it, or a
    mark; a sentence ends after `.`, `!` or `?` and closing marks before white space.  Repeats in the pattern
    of words are possessive: nothing after them can fail, and without places to go back to a word may be of any length.
    """
    if by == "character":
        return F.filter(F.split(text, ""), lambda x: x != "")
    if by == "word":
        return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]++(?:['’.,-][\p{L}\p{N}]++)*+|[^\s\p{L}\p{N}])"), F.lit(1))
    if by == "sentence":
        return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    if by == "passage":
        return F.split(text, "\n\n")
    raise ValueError(f"unknown unit {by!r}; one of {', '.join(UNITS)}")


def split_text(text: Column, *, by: str = "sentence", length: int = 2, overlap: int = 0) -> Column:
    """Windows of `length` units, each of which starts length - overlap units after the one before; the last may be shorter.

    Units are joined by a space, characters by nothing.  Windows that are blank are left out.  A blank
    text is one chunk of one space; a text of at most one character stays whole.
    """
    if length < 1 or not 0 <= overlap < length:
        raise ValueError("length must be at least 1 and overlap at least 0 and below length")
    glue = "" if by == "character" else " "

    def joined(parts: Column) -> Column:
        starts = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1, F.lit(length - overlap))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda at: F.array_join(F.slice(parts, at + 1, length), glue)), lambda x: F.trim(x) != "")

    # The text is cut once: a variable of a lambda holds its units, while an expression would be worked out again for each window.
    windows = F.get(F.transform(F.array(units(text, by)), joined), F.lit(0))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.trim(text) == "", F.array(F.lit(" "))).when(F.length(text) <= 1, F.array(text)).otherwise(windows)


def prefixed(chunk: Column, prefix: str | None) -> Column:
    """What is embedded of a chunk; what is stored has no prefix."""
    return F.concat(F.lit(prefix), chunk) if prefix else chunk


def resolve_prefix(request: str | None, index: str | None, model: str | None) -> str:
    """The prefix that counts: the request's, else the index's, else the model's."""
    return next((x for x in (request, index, model) if x is not None), "")


def modality(content: Column) -> Column:
    """image, video, audio or text, by the extension of what looks like an address."""
    where = F.lower(F.regexp_extract(content, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://|/)\S+?\.([A-Za-z0-9]+)(?:[?#]\S*)?$", 1))
    return (
        F.when(where.isin("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff"), "image")
        .when(where.isin("mp4", "avi", "mkv", "mov", "webm"), "video")
        .when(where.isin("mp3", "wav", "ogg", "flac", "m4a"), "audio")
        .otherwise("text")
    )


def time_windows(seconds: Column, *, length: float, overlap: float) -> Column:
    """(start, end) windows of a recording; the last one ends with it and is as long as the others if it can be."""
    if length <= 0 or not 0 <= overlap < length:
        raise ValueError("length must be above 0 and overlap at least 0 and below length")
    step = length - overlap
    count = F.greatest(F.ceil((seconds - overlap) / step), F.lit(1)).cast("int")
    last = F.greatest(seconds - length, F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(F.least(k * F.lit(float(step)), last).alias("start"), F.least(k * F.lit(float(step)) + length, seconds).alias("end")))


def grid_boxes(width: Column, height: Column, *, rows: int, columns: int) -> Column:
    """(left, top, right, bottom): first the whole picture, then its grid row by row."""
    box = lambda a, b, c, d: F.struct(a.cast("double").alias("left"), b.cast("double").alias("top"), c.cast("double").alias("right"), d.cast("double").alias("bottom"))
    whole = F.array(box(F.lit(0), F.lit(0), width, height))
    cells = [box(width * c / columns, height * r / rows, width * (c + 1) / columns, height * (r + 1) / rows) for r in range(rows) for c in range(columns)]
    return F.concat(whole, F.array(*cells))


def overlapping_boxes(width: Column, height: Column, *, rows: int, columns: int, overlap: float = 0.5) -> Column:
    """As grid_boxes, and after the grid's boxes the ones between neighbours, shifted by 1 - overlap of a cell right and down, that lie inside."""
    if not 0 < overlap < 1:
        raise ValueError("overlap is between 0 and 1")
    box = lambda a, b, c, d: F.struct(a.cast("double").alias("left"), b.cast("double").alias("top"), c.cast("double").alias("right"), d.cast("double").alias("bottom"))
    shift = 1 - overlap
    between = [box(width * (c + shift) / columns, height * (r + shift) / rows, width * (c + 1 + shift) / columns, height * (r + 1 + shift) / rows) for r in range(rows - 1) for c in range(columns - 1)]
    cells = grid_boxes(width, height, rows=rows, columns=columns)
    return F.concat(cells, F.array(*between)) if between else cells


def box_area(box: Column) -> Column:
    return F.greatest(box["right"] - box["left"], F.lit(0.0)) * F.greatest(box["bottom"] - box["top"], F.lit(0.0))


def box_overlap(a: Column, b: Column) -> Column:
    """Area of what two boxes share by the area of what they cover."""
    shared = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0.0)) * F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))
    return shared / F.greatest(box_area(a) + box_area(b) - shared, F.lit(1e-12))


def box_fits(box: Column, *, least_area: float = 0.0, most_ratio: float | None = None) -> Column:
    """Whether a box is large enough and not too long."""
    wide, high = F.greatest(box["right"] - box["left"], F.lit(1e-12)), F.greatest(box["bottom"] - box["top"], F.lit(1e-12))
    return (box_area(box) >= least_area) & (F.lit(True) if most_ratio is None else F.greatest(wide / high, high / wide) <= most_ratio)


def kept_boxes(boxes: Column, *, least_area: float = 0.0, most_ratio: float | None = None, most_overlap: float = 1.0, top: int | None = None) -> Column:
    """Of an array of (left, top, right, bottom, score) the best ones: large enough, not too long, none that overlaps a better one too much.

    Best scores come first, ties as they stood; `top` of them are kept at most.  A box is compared with those
    kept before it, at most `top`; no box overlaps another by more than 1, so that none are compared then.
    The array is one picture's: where a group may have any number of boxes, see `operators.boxes`.
    """
    fits = lambda x: box_fits(x, least_area=least_area, most_ratio=most_ratio)
    placed = F.transform(F.filter(boxes, fits), lambda x, k: F.struct((-x["score"]).alias("by"), k.alias("place"), x.alias("box")))
    kept = F.transform(F.array_sort(placed), lambda x: x["box"])
    if most_overlap < 1:
        full = lambda done: F.lit(False) if top is None else F.size(done) >= top
        kept = F.aggregate(kept, F.slice(kept, 1, 0), lambda done, x: F.when(full(done) | F.exists(done, lambda y: box_overlap(x, y) > most_overlap), done).otherwise(F.concat(done, F.array(x))))
    return kept if top is None else F.slice(kept, 1, top)
