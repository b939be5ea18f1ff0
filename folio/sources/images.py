"""Images as binary columns: size in pixels from their headers, and the choice of images that go with an element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of an image, pixels of its longer side, images of an element.
MOST_BYTES, MOST_PIXELS, MOST_IMAGES = 5 * 1024 * 1024, 1568, 5
#: How files begin (hexadecimal).
PNG, JPEG, GIF, RIFF, WEBP_EXTENDED = "89504E470D0A1A0A", "FFD8", "47494638", "52494646", "5745425056503858"
#: JPEG segments that are read for the frame's; files with more have no known size.
SEGMENTS = 512


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The unsigned number of `size` bytes from place `at` (from 0)."""
    digits = F.hex(F.substr(content, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(size)))
    if little:
        digits = F.concat(*[F.substr(digits, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("int")


def _begins(content: Column, digits: str, at: int = 0) -> Column:
    return F.hex(F.substr(content, F.lit(at + 1), F.lit(len(digits) // 2))) == digits


def _jpeg_frame(content: Column) -> Column:
    """The place of the frame segment's marker: segments follow each other by their lengths."""
    marker = lambda at: _number(content, at, 2)
    # Frame markers are C0 to CF without tables (C4), extensions (C8) and arithmetic conditions (CC).
    frame = lambda m: m.between(0xFFC0, 0xFFCF) & ~m.isin(0xFFC4, 0xFFC8, 0xFFCC)
    # Fill bytes (FF before a marker) are stepped over one by one; a marker alone has no length.
    size = lambda at: F.when(marker(at) == 0xFFFF, 1).when(marker(at).between(0xFFD0, 0xFFD8) | (marker(at) == 0xFF01), 2).otherwise(2 + _number(content, at + 2, 2))
    step = lambda at, _: F.when(at.isNull() | frame(marker(at)), at).when(marker(at) >= 0xFF00, at + size(at))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), F.lit(2), step)
    return F.element_at(F.transform(F.array(found), lambda at: F.when(frame(marker(at)), at)), 1)


def pixels(content: Column) -> Column:
    """struct<media, width, height> of PNG, JPEG, GIF and extended WebP files by their headers; null for others and broken ones."""
    sized = lambda media, w, h: F.struct(F.lit(media).alias("media"), w.alias("width"), h.alias("height"))
    webp = lambda at: _number(content, at, 3, True) + 1
    jpeg = F.element_at(F.transform(F.array(_jpeg_frame(content)), lambda at: sized("image/jpeg", _number(content, at + 7, 2), _number(content, at + 5, 2))), 1)
    found = (
        F.when(_begins(content, PNG) & _begins(content, "49484452", 12), sized("image/png", _number(content, 16, 4), _number(content, 20, 4)))
        .when(_begins(content, JPEG), jpeg)
        .when(_begins(content, GIF), sized("image/gif", _number(content, 6, 2, True), _number(content, 8, 2, True)))
        .when(_begins(content, RIFF) & _begins(content, WEBP_EXTENDED, 8), sized("image/webp", webp(24), webp(27)))
    )
    return F.element_at(F.transform(F.array(found), lambda f: F.when((f["width"] > 0) & (f["height"] > 0), f)), 1)


def chosen(images: DataFrame, element: str, order: list[str], content: str = "content", path: str = "path", most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS, most_images: int = MOST_IMAGES) -> DataFrame:
    """The images that go with each element: element, path, media, width, height as shown, downscaled.

    images: element, the columns of `order`, path and content. In order, the first `most_images` of an element that can be read and
    have at most `most_bytes`; a path counts once. An image of a longer side is to be scaled down to `most_pixels`, which makes it a
    PNG (pixels themselves are not touched here). Contents are not shuffled, only what their headers say.
    """
    read = images.select(element, *order, path, F.octet_length(content).alias("size"), pixels(F.col(content)).alias("p")).where(F.col("p").isNotNull() & (F.col("size") <= most_bytes))
    first = read.groupBy(element, path).agg(F.min(F.struct(*order)).alias("at"), F.min_by("p", F.struct(*order)).alias("p"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy(element).orderBy("at", path))).where(F.col("n") <= most_images)
    longest = F.greatest("p.width", "p.height")
    scale = lambda side: F.when(longest > most_pixels, F.floor(side * (F.lit(float(most_pixels)) / longest)).cast("int")).otherwise(side)
    return ranked.select(
        element, path, F.when(longest > most_pixels, "image/png").otherwise(F.col("p.media")).alias("media"),
        scale(F.col("p.width")).alias("width"), scale(F.col("p.height")).alias("height"), (longest > most_pixels).alias("downscaled"),
    )
