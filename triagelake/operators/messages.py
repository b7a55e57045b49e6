"""New messages from posts: sample files of an example, uploads and plain names; and what is sent of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import lazy as F

from ..functions import text as tx
from ..functions.text import clean
from ..schemas import ATTACHMENT, ATTACHMENT_FIELDS, SPEC_KINDS
from . import attachments as att
from .ranges import row_numbers
from .uploads import MOST_ATTACHMENTS, MOST_UPLOADS

NO_SENDER = "unknown@example.com"
NOTHING, TOO_MANY, GONE = "Add a subject or a body.", f"Attach up to {MOST_UPLOADS} files.", "An uploaded file is no longer in memory. Remove it and add it again."


def struct_of(**fields: Column) -> Column:
    """A normalised attachment with these fields, the others null."""
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in ATTACHMENT_FIELDS.items()])


def names(attachments: Column) -> Column:
    return F.transform(attachments, lambda a: a["name"])


def named_files(typed: Column) -> Column:
    """Attachments from typed names, parted by ; and , (blank ones go; 120 characters of each)."""
    parts = F.filter(F.transform(F.split(F.translate(tx.blank(typed), ";", ","), ","), tx.strip), lambda n: n != "")
    return F.transform(parts, lambda n: struct_of(name=F.substring(clean(F.substring(n, 1, 120)), 1, 120), kind=F.lit("name_only")))


def upload_attachment(u: Column) -> Column:
    """A stored upload as an attachment."""
    return struct_of(
        name=u["name"], kind=F.lit("upload"), media=u["media"], upload_id=u["upload_id"], bytes=u["size"], pages=u["pages"], width=u["width"], height=u["height"], text=u["text"], text_error=u["text_error"]
    )


def upload_public(u: Column) -> Column:
    """What a client gets to know of a stored upload: no bytes and no text."""
    return F.struct(*[u[c].alias(c) for c in ("upload_id", "name", "media", "size", "pages", "width", "height", "text_error")], (F.length(tx.blank(u["text"])) > 0).alias("has_text"))


def example_files(attachments: Column, keep: Column) -> Column:
    """The sample files of an example: specifications whose names are kept; null keeps all."""
    return F.filter(attachments, lambda a: a["kind"].isin(*SPEC_KINDS) & (keep.isNull() | F.array_contains(keep, a["name"])))


def checked(posts: DataFrame, examples: DataFrame, store: DataFrame) -> DataFrame:
    """posts (ord, from_name, from_email, subject, body, names, example, example_files, uploads) with
    `attachments` and `error`.

    example is the place of an example from 0 on, as text; other text names none. Attachments are the
    example's files, then the uploads in the order asked for, then the typed names; 20 at most. An upload that
    is not in the store, more than 5 of them, and a post without subject and body are errors (null
    otherwise). examples: ord, attachments. store: upload_id and the fields of an upload. Both are joined by
    their keys; nulls match nothing."""
    ex = examples.select(F.col("ord").cast("long").alias("__ex"), F.col("attachments").alias("__sample"))
    place = F.when(F.regexp_like(tx.strip(F.col("example")), F.lit("^[0-9]{1,9}$")), tx.strip(F.col("example")).cast("long"))
    p = posts.withColumn("__place", place).join(ex, F.col("__place") == F.col("__ex"), "left")
    wanted = posts.select("ord", F.posexplode("uploads").alias("pos", "upload_id"))
    stored = store.select("upload_id", upload_attachment(F.struct(*[F.col(c) for c in ("name", "media", "upload_id", "size", "pages", "width", "height", "text", "text_error")])).alias("a"))
    files = wanted.join(stored, "upload_id", "left").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]).alias("__files"), F.bool_or(F.col("a").isNull()).alias("__gone"))
    p = p.join(files, "ord", "left")
    none = F.array().cast(f"array<{ATTACHMENT}>")
    given = F.concat(F.coalesce(example_files(F.col("__sample"), F.col("example_files")), none), F.coalesce(F.filter("__files", lambda a: a.isNotNull()), none), named_files(F.col("names")))
    bare = (tx.strip(tx.blank(F.col("subject"))) == "") & (tx.strip(tx.blank(F.col("body"))) == "")
    error = F.when(bare, F.lit(NOTHING)).when(F.size("uploads") > MOST_UPLOADS, F.lit(TOO_MANY)).when(F.coalesce("__gone", F.lit(False)), F.lit(GONE))
    return p.select(*posts.columns, F.slice(given, 1, MOST_ATTACHMENTS).alias("attachments"), error.alias("error"))


def new_messages(posts: DataFrame, taken: DataFrame, examples: DataFrame, store: DataFrame, received: str | None = None) -> DataFrame:
    """Posts without an error as messages. Identifiers L01, L02, ... go on in the order of ord where they are
    free (taken: id); posts and free numbers are numbered in range buckets, so no task takes all of them."""
    p = checked(posts, examples, store).where("error is null")
    p = p.select(
        "ord",
        tx.strip(tx.blank(F.col("from_name"))).alias("from_name"),
        F.coalesce(F.nullif(tx.strip(tx.blank(F.col("from_email"))), F.lit("")), F.lit(NO_SENDER)).alias("from_email"),
        tx.strip(tx.blank(F.col("subject"))).alias("subject"),
        tx.strip(tx.blank(F.col("body"))).alias("body"),
        "attachments",
    )
    spark = posts.sparkSession
    used = taken.where(F.regexp_like("id", F.lit("^L[0-9]{2,}$"))).select(F.col("id").alias("new_id")).distinct()
    many = p.count() + used.count()
    free = spark.range(1, many + 1).select(F.format_string("L%02d", "id").alias("new_id"), F.col("id").alias("n")).join(used, "new_id", "left_anti")
    both = row_numbers(p, "ord", "k").join(row_numbers(free, "n", "k"), "k")
    return both.select(F.col("new_id").alias("id"), F.lit(received).alias("received"), *p.columns, F.lit(True).alias("live"))


def attachment_at(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, idx) with `attachment` and what sent_of gives. messages holds the inbox and the examples
    (X1, X2, ...), each id once; an unknown message or a place out of range gives nulls."""
    return sent_of(asked.join(messages.select("id", "attachments"), "id", "left")).drop("attachments")


def sent_of(at: DataFrame) -> DataFrame:
    """at (attachments, idx) with the `attachment` at the place and, of what is sent of it to the model, `file`,
    `text`, whether it was cut (`truncated`) and how long it is as a whole (`full_chars`)."""
    one = F.when(F.col("idx") >= 0, F.get("attachments", F.col("idx")))
    sent = F.when(F.col("idx") >= 0, F.get(att.entries(F.col("attachments")), F.col("idx")))
    out = at.select("*", one.alias("attachment"), sent.alias("sent"))
    text, there = F.col("sent.content"), F.col("attachment").isNotNull()
    whole = att.full_text(F.col("attachment"))
    # what is cut ends in the mark; a text may end so by itself
    cut = F.when(F.endswith(text, F.lit("[truncated]")), text != tx.squeeze(whole)).otherwise(F.lit(False))
    return out.select(*at.columns, "attachment", F.col("sent.file").alias("file"), text.alias("text"), F.when(there, cut).alias("truncated"), F.when(there, F.length(whole)).alias("full_chars"))


def public(messages: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Messages with their attachments described instead of raw. An uploaded file is available while its
    upload_id is in the store."""
    base = F.concat(F.lit("/api/att/"), F.col("id"), F.lit("/"))
    m = messages
    if store is not None:
        kept = store.select(F.col("upload_id").alias("__there")).distinct()
        asked = messages.select("id", F.explode(F.filter("attachments", lambda a: a["kind"] == "upload")).alias("a")).select("id", F.col("a.upload_id").alias("__there"))
        there = asked.join(kept, "__there", "left_semi").groupBy("id").agg(F.collect_set("__there").alias("__kept"))
        m = messages.join(there, "id", "left")
        still = lambda a: (a["kind"] != "upload") | F.coalesce(F.array_contains("__kept", a["upload_id"]), F.lit(False))
    else:
        still = lambda a: F.lit(True)
    described = F.transform("attachments", lambda a, i: att.describe(a, F.concat(base, i.cast("string")), still(a)))
    return m.select(*[c for c in messages.columns if c != "attachments"], described.alias("attachments"))


__all__ = ["attachment_at", "checked", "example_files", "named_files", "names", "new_messages", "public", "sent_of", "upload_attachment", "upload_public"]
