"""Uploaded files and new messages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import lazy as F

from ..functions import binary, text as tx
from .ranges import fresh, running_total

MOST_BYTES, STORE_BYTES, UNATTACHED_SECONDS = 10 << 20, 100 << 20, 3600
MOST_ATTACHMENTS, MOST_UPLOADS = 20, 5
#: Media types of uploads.
ACCEPTED_TYPES = ("application/pdf", "image/png", "image/jpeg")


def accept(files: DataFrame) -> DataFrame:
    """(name, content) to accepted uploads: 1 byte to 10 MB, of a known kind by their bytes; with a safe
    name, and the size of images."""
    f = files.where(F.length("content").between(1, MOST_BYTES)).withColumn("media", binary.sniff(F.col("content"))).where("media is not null")
    f = f.withColumn("size", F.length("content").cast("long")).withColumn("wh", binary.image_size(F.col("content"), F.col("media")))
    return f.withColumn("name", tx.safe_filename(F.col("name"), F.col("media"))).withColumns({"width": F.col("wh.width"), "height": F.col("wh.height")}).drop("wh")


def retain(store: DataFrame, now: float, most_bytes: int = STORE_BYTES) -> DataFrame:
    """The files (ord, size, attached, added_at) that stay: unattached ones expire after an hour, then the
    oldest go until the rest fit. Attached files can go, too; their text is in the message already."""
    live = store.where(F.col("attached") | (F.lit(now) - F.col("added_at") <= UNATTACHED_SECONDS))
    (newer,) = fresh(live, "total_newer")
    return running_total(live, "ord", "size", newer).where(F.col(newer) <= most_bytes).drop(newer)


def store_bytes(store: DataFrame) -> DataFrame:
    """One row: how many bytes the store holds."""
    return store.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def accepted_types() -> list[str]:
    """The media types of accepted uploads, sorted."""
    return sorted(ACCEPTED_TYPES)


def claim(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (upload_id, ...) with the stored file's columns; an identifier that is not there is an error."""
    joined = wanted.join(store.withColumn("__there", F.lit(True)), "upload_id", "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no such upload: "), F.col("upload_id")))).otherwise(F.lit(True))
    return joined.where(checked).drop("__there")
