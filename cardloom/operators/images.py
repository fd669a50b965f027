"""Images of pages: coverage, choice and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.text import image_base64

COVERAGE, PER_PAGE = 0.20, 5


def with_areas(boxes: DataFrame) -> DataFrame:
    """The area of each box and the share of its page that it covers, not clamped; 0 on a page without area."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    page = F.col("page_width") * F.col("page_height")
    return boxes.withColumn("area", area).withColumn("coverage", F.when(page > 0, area / page).otherwise(F.lit(0.0)))


def page_coverage(boxes: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """Coverage of each page (overlaps count twice) and whether it is significant."""
    page = F.first(F.col("page_width") * F.col("page_height"))
    found = with_areas(boxes).groupBy("doc_id", "page_num").agg(F.sum(F.greatest("area", F.lit(0.0))).alias("covered"), page.alias("page_area"), F.count("*").alias("n_images"))
    share = F.when(F.col("page_area") > 0, F.col("covered") / F.col("page_area")).otherwise(F.lit(0.0))
    return found.select("doc_id", "page_num", "n_images", share.alias("coverage"), (share >= F.lit(threshold)).alias("significant"))


def chosen_images(boxes: DataFrame, threshold: float = COVERAGE, per_page: int = PER_PAGE) -> DataFrame:
    """The first images, by their order on the page, of the pages that images cover enough of."""
    heavy = page_coverage(boxes, threshold).where("significant").select("doc_id", "page_num")
    w = Window.partitionBy("doc_id", "page_num").orderBy("idx")
    return with_areas(boxes).join(heavy, ["doc_id", "page_num"], "left_semi").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_page)


def media_name(doc: str, page: str, idx: str, media_type: str):
    """K7: a file name for an image; the document's id comes first, so documents can share a folder."""
    suffix = F.when(F.contains(F.col(media_type), F.lit("png")), F.lit("png")).otherwise(F.lit("jpg"))
    return F.concat(F.lit("_media/"), F.col(doc).cast("string"), F.lit("_page"), F.col(page).cast("string"), F.lit("_img"), F.col(idx).cast("string"), F.lit("."), suffix)


def flattened(images: DataFrame) -> DataFrame:
    """doc_id and images, all images of all its pages in order (page_num, idx), as one array of media_type and data.

    data: base64 of image_bytes, empty where there are none.
    """
    each = F.struct("page_num", "idx", "media_type", image_base64(F.col("image_bytes")).alias("data"))
    met = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("i"))
    return met.select("doc_id", F.transform("i", lambda x: F.struct(x["media_type"].alias("media_type"), x["data"].alias("data"))).alias("images"))
