"""The inbox, the shop's configuration, saved answers and uploaded files."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tidy_lines
from ..operators import attachments as att
from ..schemas import ANSWERS, Lane, Shop
from .client import parse_settings

EMAIL = "id string, received string, from_name string, from_email string, subject string, body string, attachments array<variant>, expected struct<lane:string>, live boolean"
INBOX = f"struct<emails:array<struct<{EMAIL.replace(' ', ':').replace(',:', ',')}>>,paste_examples:array<struct<{EMAIL.replace(' ', ':').replace(',:', ',')}>>>"
#: Limits of reading PDF text.
PDF_PAGES, PDF_CHARS, PDF_SECONDS, PDF_MEMORY = 40, 60_000, 25.0, 1 << 30


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """One row a message: the inbox (`emails`) and the examples (`paste_examples`, as X1, X2, ...) of JSON
    documents, in document order (ord). An attachment is a name or an object. Unreadable documents give
    no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", INBOX).alias("d"))
    sample = docs.select(F.posexplode("d.emails").alias("ord", "e"), F.lit("inbox").alias("origin"))
    examples = docs.select(F.posexplode("d.paste_examples").alias("ord", "e"), F.lit("example").alias("origin"))
    both = sample.unionByName(examples)
    given = F.when(F.col("origin") == "example", F.format_string("X%d", F.col("ord") + 1)).otherwise(F.col("e.id"))
    return both.select(
        "origin", F.col("ord").cast("long").alias("ord"), given.alias("id"), *[f"e.{c}" for c in ("received", "from_name", "from_email", "subject", "body")],
        att.normalise(F.col("e.attachments")).alias("attachments"), F.col("e.expected.lane").alias("expected_lane"), F.coalesce("e.live", F.lit(False)).alias("live"),
    )


def read_config(spark: SparkSession, path: str) -> Shop:
    """The shop of a JSON configuration document; what it leaves out keeps its default."""
    raw = json.loads(spark.read.text(path, wholetext=True).first().value)
    lanes = raw.get("lanes", {})
    lane = lambda d: Lane(d["id"], d["name"], d["owner"], d.get("role", ""), next((v for k, v in d.items() if k.endswith("description")), ""))
    kept = {k: lane(lanes[k]) for k in ("itar", "orders", "review", "filtered") if k in lanes}
    if "estimating" in lanes:
        kept["estimating"] = [lane(x) for x in lanes["estimating"]]
    if name := raw.get("shop", {}).get("name"):
        kept["name"] = name
    customers = [(c["domain"], c.get("name"), c.get("tier"), c.get("account_manager")) for c in raw.get("customers", [])]
    return Shop(**kept, customers=customers, thresholds=raw.get("thresholds", {}), **({"sla_days": raw["sla_business_days"]} if "sla_business_days" in raw else {}))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, record fields) of a saved-answers document ({"records": {key: record}}): objects with answers
    only; an unreadable document gives no rows."""
    fields = "email_id:string,saved_at:string,answers:variant,model:string,latency_ms:double,input_tokens:long,output_tokens:long,cost_usd:double,cost_is_estimate:boolean,list_price_usd:double,generation_id:string,request_id:string"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<records:map<string,variant>>").alias("d"))
    rows = docs.select(F.explode("d.records").alias("key", "r")).where(F.startswith(F.schema_of_variant("r"), F.lit("OBJECT")))
    rows = rows.where(F.startswith(F.schema_of_variant(F.variant_get("r", "$.answers", "variant")), F.lit("OBJECT")))
    out = rows.select("key", F.from_json(F.to_json("r"), f"struct<{fields}>").alias("r")).select("key", "r.*")
    return out.withColumn("answers", F.from_json(answers_as_arrays(F.to_json("answers")), ANSWERS))


@F.pandas_udf(T.StringType())
def answers_as_arrays(answers: pd.Series) -> pd.Series:
    """Probabilities of an answers object as an array of (key, p): Spark's maps have no order, ties need one."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        raw = json.loads(text)
        for a in raw.values():
            if isinstance(a, dict) and isinstance(a.get("probabilities"), dict):
                a["probabilities"] = [{"key": k, "p": v} for k, v in a["probabilities"].items()]
        return json.dumps(raw)

    return answers.map(one)


def write_records(records: DataFrame, path: str) -> None:
    """Saved answers as JSON lines sorted by key. A job's files appear together when it commits."""
    records.orderBy("key").write.mode("overwrite").json(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "content")


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a KEY=VALUE file: comments, `export `, quotes and trailing ` #` remarks. Such files
    belong to the driver and are hidden from Spark's readers by their names."""
    with open(path, encoding="utf-8", errors="replace") as f:
        return spark.createDataFrame(list(parse_settings(f.read()).items()), "name string, value string")


PDF_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("pages", T.IntegerType()), T.StructField("error", T.StringType())])


#: What reads one file: its own process, so that a broken file costs no more than its time and memory.
READER = """
import io, json, resource, sys
pages, chars, memory = map(int, sys.argv[1:])
resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
out = {"text": "", "pages": None, "error": None}
try:
    from pypdf import PdfReader
    found = PdfReader(io.BytesIO(sys.stdin.buffer.read())).pages
    out["pages"] = len(found)
    for page in found[:pages]:
        out["text"] += (page.extract_text() or "") + "\\n"
        if len(out["text"]) > chars:
            break
    out["text"] = out["text"][:chars]
except ImportError:
    out["error"] = "no PDF reader is installed"
except BaseException as e:
    out["error"] = (str(e) or type(e).__name__)[:200]
print(json.dumps(out))
"""


def read_pdf(data: bytes | None, seconds: float = PDF_SECONDS, memory: int = PDF_MEMORY, reader: str = READER) -> tuple[str, int | None, str | None]:
    """(text, pages, error) of one PDF file. Never raises: whatever goes wrong is the error's text."""
    import subprocess
    import sys

    if data is None:
        return "", None, "no content"
    try:
        done = subprocess.run([sys.executable, "-c", reader, str(PDF_PAGES), str(PDF_CHARS), str(memory)], input=data, capture_output=True, timeout=seconds)
        got = json.loads(done.stdout)
        return got["text"], got["pages"], got["error"]
    except subprocess.TimeoutExpired:
        return "", None, f"reading took longer than {seconds:g} seconds"
    except (OSError, ValueError, KeyError):
        return "", None, "the reader ended without an answer"


@F.pandas_udf(PDF_TEXT)
def _pdf_text(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_pdf(c) for c in contents], columns=["text", "pages", "error"]).astype({"pages": "Int32"})


def pdf_text(files: DataFrame) -> DataFrame:
    """files (content, media) with text, pages and text_error. Without a reader library the error says so."""
    read = files.withColumn("__t", F.when(F.col("media") == "pdf", _pdf_text("content")))
    return read.withColumns({"text": tidy_lines(F.col("__t.text")), "pages": F.col("__t.pages"), "text_error": F.col("__t.error")}).drop("__t")


def run_id() -> str:
    return uuid.uuid4().hex[:12]
