"""What lets queries grow with their tables: how work is dealt, and what is not made."""

from collections import Counter

import duckdb
import pytest

from triagelake.functions import lazy as F, text
from triagelake.operators import layout, render
from triagelake.plans import bridge, queries, sql
from triagelake.schemas import ATTACHMENT_FIELDS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_larger_files_are_dealt_in_more_parts(spark, sf, monkeypatch):
    """a task's share stays as large as it is, however large the table."""
    monkeypatch.setattr(bridge, "TASK_BYTES", 1 << 10)
    parts = bridge.spread(bridge.table(spark, sf, "orders")).rdd.getNumPartitions()
    assert parts > 2 * spark.sparkContext.defaultParallelism


def test_only_the_answers_asked_for_are_made(spark, sf):
    """the other seven answers cost more than this one."""
    one = bridge.inbox(spark, sf, ("email_type",))
    assert one.schema["answers"].dataType.names == ["email_type"]
    made = plan(queries.queries()["top2_types"](spark, sf))
    assert "Generate" in made and "export_controlled" not in made and "__volume" not in made
    assert bridge.inbox(spark, sf).schema["answers"].dataType.names == list(bridge.ANSWERED)


@pytest.mark.parametrize("name", ["customer_tier_lookup", "unmatched_senders", "message_state", "state_files"])
def test_no_answers_where_none_are_used(spark, sf, name):
    """Spark does not prune a generator, so these queries made every message's answers for nothing."""
    assert "inline" not in plan(queries.queries()[name](spark, sf))


def test_widths_are_dealt_over_all_cores(spark, sf):
    """a small file is one split, which was one task."""
    assert queries.queries()["text_widths"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["mesh_bbox", "render_files"])
def test_drawing_is_dealt_over_all_cores(spark, sf, name):
    """a small file is one split, which was one task."""
    assert queries.queries()[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_meshes_of_a_batch_are_those_of_its_solids():
    """all sizes of a shape at once, to the last digit; shapes come as they are known, unknown or null."""
    shapes, sizes = [*render.LOOKS, "ring", "bushing", "spacer", "disc", "block", None], [[4.0, 3.0, 1.25], [0.25, 0.125, 0.5], [7.0], None]
    asked = [(shape, size) for size in sizes for shape in shapes]
    made = render._meshes(*map(list, zip(*asked))).to_pylist()
    for (shape, size), m in zip(asked, made, strict=True):
        s = render.solid(shape, size)
        assert m == {"vertices": [[round(c, 4) for c in p] for p in s.points], "faces": s.faces, "bbox": s.bbox(), "centroid": [round(c, 4) for c in s.centroid()]}


def test_pictures_of_equal_parts_are_drawn_once(monkeypatch):
    """parts of one shape and size share their views; texts stay their own."""
    drawn = []
    monkeypatch.setattr(layout, "_views", lambda *a: drawn.append(a))
    layout._pictures.cache_clear()
    spec = {**dict.fromkeys(ATTACHMENT_FIELDS), "kind": "drawing", "shape": "gear", "size": [4.0, 3.0, 1.0], "units": "in", "legend_text": "", "box_labels": ["4", "3", "1"]}
    files = [layout.make({**spec, "title": t, "shape": s}) for t, s in (("ONE", "gear"), ("TWO", "anvil"))]
    layout._pictures.cache_clear()
    assert len(drawn) == 1 and "ONE" in files[0][2] and "TWO" in files[1][2] and files[0][4] is None


@pytest.mark.parametrize("said", [None, "", " \n ", "ends in [truncated]", "x" * 1800, "x" * 1801])
def test_sent_text_of_odd_files(spark, tmp_path, said):
    """files without a text, or with the mark of their own; a document's identifier may be null or occur twice."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'src1')", [(1, said), (1, said), (None, "a b"), (2, "plain")])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = con.sql("SELECT id, file, digest, truncated, full_chars FROM (" + sql.oracle_sql()["sent_text"] + ")").fetchall()
    got = queries.queries()["sent_text"](spark, str(tmp_path)).select("id", "file", "digest", "truncated", "full_chars").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_files_are_joined_without_a_broadcast(spark, sf):
    """F8: Spark takes the attachments for small by their file, and would send them all to every executor."""
    assert "Broadcast" not in queries.queries()["files_once"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_tidy_lines_takes_no_line_apart(spark, sf):
    """two characters tell an edge, and a word is two characters in a row; no split of each line."""
    made = plan(queries.queries()["tidy_lines"](spark, sf))
    assert "forall" not in made and made.count("split(") == 1
    t = F.lit("  ab c \n a b \nx\ty \n\u3000zzz\x1c\n\nq  rs")
    assert spark.range(1).select(text.tidy_lines(t)).first()[0] == "ab c\nzzz\nq rs"
