"""DuckDB SQL for the queries: written from the rules, apart from the engine; values are those of sql_values."""

from __future__ import annotations

import re

from . import sql_values as values
from .more_sql import more_sql
from .policy_sql import _pct, _text, action_sql, decision_cte, trace_sql

#: White space that Java's and Python's strip take away, as a character class of RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _clean(c: str) -> str:
    return f"regexp_replace(translate(coalesce({c}, ''), chr(13) || chr(10) || chr(9) || '—–‘’“”', '   --''''\"\"'), '[\\x00-\\x1f]', '', 'g')"


def _squeeze(c: str) -> str:
    return _strip(f"regexp_replace(regexp_replace({c}, '[ \\t\\f\\x0B]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g')")


def _measure(x: str, units: str = "units") -> str:
    return f"CASE WHEN {units}='mm' THEN CASE WHEN {x} < 100 THEN regexp_replace(printf('%.1f', {x}), '\\.?0+$', '') ELSE printf('%.0f', {x}) END ELSE regexp_replace(printf('%.3f', {x}), '^0\\.', '.') END"


#: The shapes, in the order in which mesh_bbox's parts take them.
SHAPES = "plate block bracket housing cover manifold heatsink fixture enclosure structural_fitting impeller implant contoured shaft pin disc nozzle threaded_fitting bushing spacer ring weldment sheet_metal casting assembly".split()
#: Wording that marks controlled data.
MARKED = r"(?i)\b(itar|arms export control|export administration regulations|eccn|cui|controlled unclassified|dfars 252\.204-7012|u\.s\. persons only)\b"

PARTS = "p AS (SELECT p_partkey, p_name, p_brand, p_type, split_part(p_name, ' ', -1) AS shape, p_size::DOUBLE AS s1, p_size/2.0::DOUBLE AS s2, p_size/4.0::DOUBLE AS s3, CASE WHEN p_partkey%2=0 THEN 'mm' ELSE 'in' END AS units FROM part)"
R3, R2 = "('bushing','spacer','ring')", "('shaft','pin','disc','nozzle','threaded_fitting')"
#: Clamped dimensions: a bore below what is around it.
DIMS = f"q AS (SELECT *, greatest(s1, 0.001::DOUBLE) AS d1, greatest(s2, 0.001::DOUBLE) AS d2, greatest(CASE WHEN shape IN {R3} AND s3 >= s2 THEN s2*0.5::DOUBLE ELSE s3 END, 0.001::DOUBLE) AS d3, CASE WHEN units='mm' THEN 'MM' ELSE 'IN' END AS u FROM p)"


def _size_phrase() -> str:
    a, b, c = (_measure(f"d{i}") for i in (1, 2, 3))
    return (
        f"CASE WHEN shape IN {R3} THEN 'Ø' || {b} || ' OD x Ø' || {c} || ' ID x ' || {a} || ' LONG (' || u || ')' "
        f"WHEN shape IN {R2} THEN 'Ø' || {b} || ' x ' || {a} || CASE WHEN shape='disc' THEN ' THICK (' ELSE ' LONG (' END || u || ')' ELSE {a} || ' x ' || {b} || ' x ' || {c} || ' (' || u || ')' END"
    )


def _bbox_phrase() -> str:
    a, b, c = (_measure(f"d{i}") for i in (1, 2, 3))
    return f"CASE WHEN shape IN {R3} OR shape IN {R2} THEN {a} || ' x ' || {b} || ' x ' || {b} ELSE {a} || ' x ' || {b} || ' x ' || {c} END || ' ' || u"


PROPRIETARY = "'PROPRIETARY AND CONFIDENTIAL. THE INFORMATION IN THIS DOCUMENT IS THE PROPERTY OF ACME. DO NOT REPRODUCE IT OR USE IT FOR ANY PURPOSE OTHER THAN QUOTING OR MAKING PARTS FOR ACME WITHOUT WRITTEN PERMISSION.'"


def _lines(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10))"


def _messages() -> str:
    tier = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in values.TIERS.items()) + " END"
    name = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{s.title()}'" for s in values.TIERS) + " END"
    return f"m AS (SELECT o_orderkey AS id, o_custkey, c_mktsegment, {tier} AS tier, {name} AS name FROM orders JOIN customer ON o_custkey=c_custkey)"


def _layer(odd: int) -> str:
    return f"(SELECT user_id || ':' || event_type AS key, max(event_id) AS saved_at, arg_max(value, event_id) AS value FROM events WHERE event_id%2={odd} GROUP BY 1)"


def _has(pattern: str, text: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


SAID = f"said AS (SELECT doc_id, source, coalesce(text, '') || ({_text(values.PHRASES)})[doc_id%{len(values.PHRASES)}+1] AS text FROM documents)"


def _rules() -> str:
    body, subject, text = "body", "subject", "whole"
    kind = (
        f"CASE WHEN {_has(values.PITCH, body)} THEN 'vendor_or_solicitation' WHEN {_has(values.PO, body)} AND NOT {_has(values.ASKS, body)} THEN 'purchase_order' "
        f"WHEN {_has(values.QUOTE_SUBJECT, subject)} AND NOT {_has(values.ORDER_SUBJECT, subject)} THEN CASE WHEN {_has(values.REVISED_SUBJECT, subject)} THEN 'quote_revision' ELSE 'new_rfq' END "
        f"WHEN {_has(values.FOLLOWUP, body)} THEN 'order_followup' WHEN {_has(values.REVISED, body)} THEN 'quote_revision' WHEN {_has(values.QUOTE, body)} THEN 'new_rfq' ELSE 'other' END"
    )
    process = "CASE " + " ".join(f"WHEN {_has(p, src)} THEN '{lane}'" for src in (body, text) for lane, p in values.PROCESSES) + " ELSE 'mixed_or_unclear' END"
    most = f"list_max(list_transform(regexp_extract_all({text}, '{values.COUNTED}', 1), lambda x: replace(x, ',', '')::BIGINT))"
    export = f"CASE WHEN {_has(values.EXPORT_PITCH[0], text)} AND {_has(values.EXPORT_PITCH[1], text)} THEN 0.55 WHEN {_has(values.EXPORT, text)} THEN 0.92 ELSE 0.04 END::DOUBLE"
    level = f"CASE WHEN {_has(values.URGENCY[2], body)} THEN 3 WHEN {_has(values.URGENCY[1], body)} THEN 2 WHEN {_has(values.URGENCY[0], body)} THEN 1 ELSE 0 END"
    return f"""WITH {SAID}, s AS (SELECT doc_id, lower('s' || source) AS subject, lower('s' || source || ' ' || text) AS body, lower('{{"subject":"s' || source || '","body":"' || text || '","attachments":"none"}}') AS whole FROM said),
      a AS (SELECT doc_id, {kind} AS kind, {process} AS process, {most} AS most, {level} AS level, {export} AS export_p, CASE WHEN {_has(values.QUANTITY, text)} THEN 0.88 ELSE 0.12 END::DOUBLE AS quantity_p FROM s)
      SELECT doc_id, kind, process, CASE WHEN most IS NULL THEN 'not_stated' WHEN most > 250 THEN 'production' WHEN most > 10 THEN 'low_volume' ELSE 'prototype' END AS volume,
      round(level*0.76 + (6 - level)*0.08, 4)::DOUBLE AS score, export_p, quantity_p FROM a"""


def _routed() -> str:
    """Rules and policy in one: the rules' strengths leave a few cases of the policy. A vague text is unsure; no
    confidence reaches the exemption's bar; no sender is a known customer."""
    rules = _rules()
    body = f"CASE WHEN length({_strip('text')}) > 8000 THEN substring({_strip('text')}, 1, 8000) || ' [truncated]' ELSE coalesce({_strip('text')}, '') END"
    start = f"""WITH {SAID}, t AS (SELECT doc_id, source, {body} AS b FROM said), s AS (SELECT doc_id, lower('s' || source) AS subject, lower('s' || source || ' ' || b) AS body, lower('{{"from":"' || source || ' <' || source || '@x.example.com>","subject":"s' || source || '","body":"' || b || '","attachments":"none"}}') AS whole FROM t),"""
    found = rules[rules.index("a AS (SELECT doc_id, ") :].replace("SELECT doc_id, CASE", f"SELECT doc_id, {_has(values.VAGUE, 'body')} AS vague, CASE", 1)
    found = found[: found.rindex("SELECT doc_id, kind")]
    return f"""{start} {found}, l AS (SELECT *, most > 250 AS production, CASE WHEN export_p >= 0.5 THEN 'itar' WHEN vague THEN 'review' WHEN kind IN ('vendor_or_solicitation','other') THEN 'filtered' WHEN kind IN ('purchase_order','order_followup') THEN 'orders' WHEN process = 'mixed_or_unclear' THEN 'review' ELSE process END AS lane FROM a),
      p AS (SELECT lane, CASE WHEN lane = 'filtered' THEN NULL WHEN level = 3 THEN 'P1' WHEN lane = 'orders' OR (lane = 'itar' AND kind IN ('purchase_order','order_followup')) THEN 'P2' WHEN level = 2 OR production THEN 'P2' ELSE 'P3' END AS priority FROM l)
      SELECT lane, priority, count(*) AS n FROM p GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    d = decision_cte()
    d8 = decision_cte({"email_type_confidence": 0.8})[len("\nWITH ") :]
    tlab = _text(values.EMAIL_TYPES.values())
    renamed = re.sub(r"(?m)(^|[ ,(])(o|w|s|s2|s3|s4|s5|s6|s7|s8|s9|s10|d) AS \(", r"\1z\2 AS (", d8)
    renamed = re.sub(r"FROM (o|w|s|s2|s3|s4|s5|s6|s7|s8|s9|s10)\n", r"FROM z\1\n", renamed)
    both = f"{d}, {renamed}"
    labels = _text([*(x.upper() for x in values.DOC_TYPES), "DOCUMENT"])
    cad = _text(values.CAD_ENDINGS)
    notdraw = values.NOT_A_DRAWING
    guess = f"{_text(values.PROCESS_LABELS.values())}[prw1]"
    budget = "list_reduce(list_prepend({'left': 6000::BIGINT, 'n': 0::BIGINT, 'out': ''}, list_transform(texts, lambda t: {'left': 0::BIGINT, 'n': length(t), 'out': t})), lambda a, b: {'left': a.left - CASE WHEN b.n > least(1800, greatest(200, a.left)) THEN length(regexp_replace(substring(b.out, 1, least(1800, greatest(200, a.left))), '\\s+$', '')) + 12 ELSE b.n END, 'n': 0::BIGINT, 'out': a.out || CASE WHEN a.out = '' THEN '' ELSE ',' END || CASE WHEN b.n > least(1800, greatest(200, a.left)) THEN length(regexp_replace(substring(b.out, 1, least(1800, greatest(200, a.left))), '\\s+$', '')) + 12 ELSE b.n END})"
    tidy = _squeeze(f"array_to_string(list_filter(list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || 'A' || chr(10) || '12' || chr(10) || 'D D' || chr(10)), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {_strip('l')}), lambda l: length(l) > 2 AND len(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: length(w) > 1)) > 0), chr(10))".replace("{{", "{").replace("}}", "}"))
    noisy = "('  ' || replace(text, ' the ', chr(9) || chr(9) || '“the” — ') || chr(10) || ' ' || chr(10) || chr(10) || 'end ')"
    due = "(day + (least(isodow(day)-1, 4) - (isodow(day)-1) + n + 2*((least(isodow(day)-1, 4) + n)//5))::INT)"
    item = "CASE WHEN event_id%5<>0 THEN (['review','orders','turning'])[event_id%3+1] END AS lane, CASE WHEN event_id%4<>0 THEN event_id%3=1 END AS good, CASE WHEN event_id%9=0 THEN 0.0::DOUBLE ELSE round(value,3) END AS lat, CASE WHEN event_id%2=0 THEN round(value,3)/1000 END AS cost, round(value,3)/500 AS price, CASE WHEN event_id%7<>0 THEN event_id%2=1 END AS est"
    po = """lines AS (SELECT l_orderkey AS id, l_partkey, l_quantity::BIGINT AS qty, replace(printf('%.2f', l_extendedprice/l_quantity), ',', '')::DOUBLE AS price, strftime(l_shipdate, '%Y-%m-%d') AS due,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS i FROM lineitem)"""
    drawing = _lines(
        "'ENGINEERING DRAWING (PDF)'",
        "'TITLE BLOCK: Acme. TITLE: ' || p_name || '. DWG NO: ' || p_partkey || ' REV ' || CASE WHEN p_partkey%3<>0 THEN 'B' ELSE '' END || '. SCALE 1:1. SHEET 1 OF 1.'",
        "'MATERIAL: ' || p_type",
        "'FINISH: NONE'",
        "CASE WHEN units='mm' THEN 'UNLESS OTHERWISE SPECIFIED: DIMENSIONS IN MILLIMETERS. TOLERANCES: X.X ±0.2  X.XX ±0.05  ANGLES ±0.5°' ELSE 'UNLESS OTHERWISE SPECIFIED: DIMENSIONS IN INCHES. TOLERANCES: .XX ±.01  .XXX ±.005  ANGLES ±0.5°' END",
        f"'OVERALL SIZE: ' || {_size_phrase()}",
        "'FEATURES: ' || p_brand || '; 2X HOLES'",
        "'NOTES: 1. BREAK EDGES 2. CLEAN \"PARTS\"'",
        f"CASE WHEN p_partkey%5=0 THEN {PROPRIETARY} END",
    )
    model = _lines(
        "'3D CAD MODEL (STEP AP214)'",
        "'PART: ' || p_partkey || ' REV ' || CASE WHEN p_partkey%3<>0 THEN 'B' ELSE '-' END || ', ' || p_name",
        f"'UNITS: ' || CASE WHEN units='mm' THEN 'MILLIMETER' ELSE 'INCH' END || '. BOUNDING BOX: ' || {_bbox_phrase()} || '.'",
        "'ORIGINATING SYSTEM: CAD 1.'",
        f"CASE WHEN p_partkey%5=0 THEN {PROPRIETARY} END",
    )
    rfq_line = "'P/N ' || p_partkey || ' REV A, ' || p_name || ', MATERIAL ' || p_type || ', QUANTITIES ' || CASE WHEN p_size > 5 THEN format('{:,}', (p_size*100)::BIGINT) || ' / 5,000' ELSE 'NOT STATED' END || ', rush.'"
    safe_in = "(CASE WHEN p_partkey%2=0 THEN 'C:\\a\\' ELSE '../b/' END || replace(p_name, ' ', '  <') || CASE WHEN p_partkey%3=0 THEN '.PDF' WHEN p_partkey%3=1 THEN '.txt' ELSE '' END)"
    return {
        "lane_decision": f"{d} SELECT k AS id, lane, is_rfq, lane <> 'review' AS auto_routed, CASE WHEN restricted THEN 'ITAR / CUI likelihood' ELSE 'Confidence' END AS meter, round(CASE WHEN restricted THEN ex WHEN asked THEN least(route, prwc) ELSE route END, 6) AS value, 0.5::DOUBLE AS threshold FROM d",
        "lane_counts": f"{d} SELECT lane, count(*) AS n FROM d GROUP BY lane",
        "review_reasons": f"{d} SELECT k AS id, reason FROM d WHERE lane='review'",
        "all_reasons": f"{d} SELECT k AS id, lane_name, owner, reason FROM d",
        "flag_list": f"{d} SELECT k AS id, array_to_string(flags, ',') AS flags, array_to_string(missing, '|') AS missing FROM d",
        "priority_due": f"{d} SELECT k AS id, priority, why AS priority_reason, due::VARCHAR AS due_date, due_kind FROM d",
        "friendly_due": f"{d} SELECT k AS id, due_label FROM d",
        "reply_action": action_sql(),
        "trace_steps": trace_sql(),
        "process_guess": f"{d} SELECT k AS id, pr AS choice, {guess} AS label, round(prwp1, 6) AS p FROM d",
        "threshold_change": f"{both} SELECT d.k AS id, d.lane AS lane_before, zd.lane AS lane_after FROM d JOIN zd ON d.k = zd.k WHERE d.lane <> zd.lane",
        "customer_tier_lookup": f"WITH {_messages()} SELECT id, name, tier FROM m",
        "unmatched_senders": f"WITH {_messages()} SELECT id, lower(c_mktsegment) || '.example.com' AS domain FROM m WHERE tier IS NULL",
        "answer_key_accuracy": f"{d} SELECT count(*) AS graded, count(*) FILTER (lane = (['milling_3axis','orders','review'])[k%3+1]) AS matches FROM d",
        "top2_types": f"{d} SELECT k AS id, {tlab}[etw1] || ' ' || {_pct('etwp1')} || ' vs ' || {tlab}[etw2] || ' ' || {_pct('etwp2')} AS top2 FROM d",
        "pair_confidence": f"{d} SELECT k AS id, round(pairc, 6) AS confidence FROM d WHERE pairc IS NOT NULL",
        "expected_urgency": f"{d} SELECT k AS id, round(score, 6) AS score, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (4*(list_max(urw)/urs) - 1.0::DOUBLE)/3.0::DOUBLE)), 6) AS confidence FROM d",
        "po_total": f"WITH {po} SELECT id, round(sum(qty*price ORDER BY i), 2) AS total FROM lines GROUP BY id",
        "po_text": f"""WITH {po}, g AS (SELECT id, string_agg('LINE ' || i || ': P/N ' || l_partkey || ', item, QTY ' || format('{{:,}}', qty) || ' AT $' || format('{{:,.2f}}', price) || ' EACH, DUE ' || due || '.', chr(10) ORDER BY i) AS body, sum(qty*price ORDER BY i) AS total FROM lines GROUP BY id)
          SELECT id, 'PURCHASE ORDER ' || id || ' FROM Acme - Co' || chr(10) || 'DATE: 2026-09-01. BUYER: Ana. TERMS: NET 30.' || chr(10) || body || chr(10) || 'ORDER TOTAL: $' || format('{{:,.2f}}', total) AS text FROM g""",
        "drawing_text": f"WITH {PARTS}, {DIMS} SELECT p_partkey, {drawing} AS text FROM q",
        "model_text": f"WITH {PARTS}, {DIMS} SELECT p_partkey, {model} AS text FROM q",
        "rfq_form_text": f"SELECT p_partkey, 'REQUEST FOR QUOTATION R-' || p_partkey || ' FROM Acme' || chr(10) || 'DATE: 2026-09-01. RESPOND BY: 2026-09-10. BUYER: Ana.' || chr(10) || 'LINE 1: ' || {rfq_line} || chr(10) || 'LINE 2: ' || {rfq_line} || chr(10) || 'TERMS: NET 30' AS text FROM part",
        "document_text": f"SELECT doc_id, md5({labels}[doc_id%10+1] || ': Doc ' || doc_id || chr(10) || lang || ': ' || source || ' line - two ' || {_clean('text')}) AS digest FROM documents",
        "cad_detection": f"""WITH n AS (SELECT p_partkey, 'Part' || p_partkey || (['','_po','-rfq','cert_','support'])[p_partkey%5+1] || '.' || (['step','pdf','STP','jpg','dwg','zip'])[p_partkey%6+1] AS name, (['name_only','upload','drawing','po'])[p_partkey%4+1] AS kind FROM part)
          SELECT p_partkey, name, CASE WHEN kind='drawing' THEN true WHEN kind='po' THEN false WHEN kind='upload' AND p_partkey%8<>1 THEN false
            ELSE list_contains({cad}, lower('.' || split_part(name, '.', -1))) OR (lower(name) LIKE '%.pdf' AND NOT regexp_matches(lower(name), '{notdraw}')) END AS cad FROM n""",
        "marked_documents": f"""WITH t AS (SELECT doc_id, {_strip('text')} AS plain, {_strip("CASE doc_id%3 WHEN 0 THEN 'Note: ITAR' || chr(10) WHEN 1 THEN 'SITAR, U.S. PERSONS ONLY. ' ELSE 'SITAR and cuisine. ' END || text")} AS marked FROM documents)
          SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(plain, '{MARKED}') THEN 'plain.pdf' END, CASE WHEN regexp_matches(marked, '{MARKED}') THEN 'marked.pdf' END], lambda x: x IS NOT NULL), ',') AS names FROM t""",
        "clean_squeeze": f"SELECT doc_id, md5({_clean(noisy)}) AS cleaned, md5({_squeeze(noisy)}) AS squeezed FROM documents",
        "body_truncation": f"WITH b AS (SELECT doc_id, {_strip('text')} AS t FROM documents), c AS (SELECT doc_id, CASE WHEN length(t) > 8000 THEN substring(t, 1, 8000) || ' [truncated]' ELSE t END AS b FROM b) SELECT doc_id, length(b)::INT AS n, md5(b) AS digest FROM c",
        "text_budget": f"WITH c AS (SELECT conv_id, list(repeat(text, 6) ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id) SELECT conv_id, ({budget}).out AS lengths FROM c",
        "tidy_lines": f"SELECT doc_id, md5({tidy}) AS digest FROM documents",
        "message_state": f"""WITH o AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, c_mktsegment, c_name FROM orders JOIN customer ON o_custkey=c_custkey), b AS (SELECT doc_id, {_strip('text')} AS t FROM documents),
          f AS (SELECT o.*, coalesce(CASE WHEN length(t) > 8000 THEN substring(t, 1, 8000) || ' [truncated]' ELSE t END, '') AS body,
            list_filter([CASE WHEN id%3=0 THEN '{{"file":"part' || id || '.step","content":"(attached to the email; only the file name is available, not its contents)"}}' WHEN id%3=1 THEN '{{"file":"rfq_form.pdf","content":"(attached to the email; only the file name is available, not its contents)"}}' END,
              CASE WHEN id%10=0 THEN '{{"file":"scan' || id || '.pdf","content":"Notes. ITAR controlled."}}' END], lambda x: x IS NOT NULL) AS fs FROM o LEFT JOIN b ON doc_id = id)
          SELECT id, CASE WHEN id%4=0 THEN 'Purchasing Team' WHEN id%4=1 THEN 'Dr. Ana ' || c_name ELSE c_name END || ' <buyer' || o_custkey || '@' || lower(c_mktsegment) || '.example.com>' AS sender,
            CASE WHEN id%8=0 THEN '(no subject)' ELSE 'Order ' || id || ' ' || o_orderpriority END AS subject, md5(body) AS body, md5(CASE WHEN len(fs) = 0 THEN 'none' ELSE '[' || array_to_string(fs, ',') || ']' END) AS attachments FROM f""",
        "cache_merge": f"WITH a AS {_layer(0)}, b AS {_layer(1)} SELECT key, coalesce(b.saved_at, a.saved_at) AS saved_at, round(CASE WHEN b.key IS NULL THEN a.value ELSE b.value END, 6) AS value FROM a FULL JOIN b USING (key)",
        "cache_hits_misses": f"WITH a AS {_layer(0)}, b AS {_layer(1)} SELECT a.key, CASE WHEN b.key IS NULL THEN 'miss' ELSE 'hit' END AS outcome FROM a LEFT JOIN b ON a.key=b.key",
        "latest_record": "SELECT user_id::VARCHAR AS key, max(event_id) AS saved_at, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
        "cache_size": "SELECT count(DISTINCT user_id || ':' || event_type) AS cache_size FROM events",
        "change_feed": f"{both} SELECT d.k AS id, 'changed' AS change FROM d JOIN zd ON d.k = zd.k WHERE d.lane <> zd.lane OR d.priority IS DISTINCT FROM zd.priority",
        "version_feed": "WITH e AS (SELECT user_id AS id, event_id%16 AS version, max(event_type) AS sig FROM events GROUP BY 1, 2), l AS (SELECT *, lag(sig) OVER (PARTITION BY id ORDER BY version) AS b FROM e) SELECT id, max(version) AS changed_at FROM l WHERE b IS NULL OR b <> sig GROUP BY id",
        "board_stats": f"""WITH i AS (SELECT {item} FROM events), m AS (SELECT list_sort(list(lat)) AS v FROM i WHERE lane IS NOT NULL AND lat <> 0)
          SELECT count(*) AS total, count(lane) AS routed, count(*) FILTER (lane <> 'review') AS auto, count(*) FILTER (lane = 'review') AS review, count(good) FILTER (lane IS NOT NULL) AS graded, count(*) FILTER (lane IS NOT NULL AND good) AS matches,
            round(avg(lat) FILTER (lane IS NOT NULL AND lat <> 0), 4) AS avg_latency_ms, round(sum(coalesce(cost, 0)) FILTER (lane IS NOT NULL), 4) AS cost_usd, round(sum(price) FILTER (lane IS NOT NULL), 4) AS list_price_usd,
            round((SELECT v[len(v)//2+1] FROM m), 4) AS median_latency_ms, bool_or(lane IS NOT NULL AND NOT coalesce(est, true)) AS cost_reported FROM i""",
        "upload_retention": "WITH s AS (SELECT doc_id, n_chars AS size, lang, source FROM documents WHERE doc_id%3=0 OR 6000 - doc_id%100*60 <= 3600), t AS (SELECT *, sum(size) OVER (ORDER BY doc_id DESC) AS total FROM s) SELECT doc_id, size, lang, source FROM t WHERE total <= 1000000",
        "content_sniff": "SELECT page_id, CASE WHEN page_id%4 IN (0, 1) THEN 'pdf' WHEN page_id%4=2 THEN 'png' END AS media FROM pages",
        "png_sizes": "SELECT p_partkey, p_partkey + 7 AS width, p_size::BIGINT AS height FROM part",
        "rules_decider": _rules(),
        "routed_documents": _routed(),
        "url_hosts": r"SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
        "error_kinds": """WITH e AS (SELECT ([400,401,402,403,404,418,422,429,500,503,529])[event_id%11+1]::INT AS status, event_id%2=0 AS plan FROM events)
          SELECT status, CASE WHEN status=403 AND plan THEN 'billing' WHEN status IN (401,403) THEN 'auth' WHEN status=402 THEN 'billing' WHEN status=429 THEN 'rate_limit' WHEN status IN (400,422) THEN 'validation' WHEN status=404 THEN 'not_found'
            WHEN status IN (503,529) THEN 'overloaded' WHEN status>=500 THEN 'server' ELSE 'bad_response' END AS kind, count(*) AS n FROM e GROUP BY 1, 2""",
        "error_messages": "SELECT event_id, CASE WHEN event_id%4=3 THEN 'not json' ELSE event_type END AS message FROM events",
        "safe_filenames": f"""WITH b AS (SELECT p_partkey, regexp_replace(replace(split_part(replace({safe_in}, chr(92), '/'), '/', -1), '<', ''), '\\s+', ' ', 'g') AS n FROM part)
          SELECT p_partkey, CASE WHEN lower(n) LIKE '%.pdf' THEN n WHEN n LIKE '%.txt' THEN regexp_replace(n, '\\.txt$', '.pdf') ELSE n || '.pdf' END AS name FROM b""",
        "first_names": "SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN split_part(c_name, ' ', 1) WHEN 1 THEN 'there' WHEN 2 THEN 'there' ELSE 'there' END AS first FROM customer",
        "business_days": f"WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey%12+1 AS n FROM orders), p AS (SELECT o_orderkey, day, {due} AS due FROM o) SELECT o_orderkey, due::VARCHAR AS due, CASE WHEN due = day + 1 THEN 'tomorrow' ELSE strftime(due, '%a, %b %-d') END AS label FROM p",
        "size_phrases": f"WITH {PARTS}, {DIMS} SELECT p_partkey, {_size_phrase()} AS size, {_bbox_phrase()} AS box FROM q",
        "queue_order": "SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN -(o_orderkey//10) ELSE o_orderkey//10 END AS batch, o_orderkey%10 AS position FROM orders",
        "mesh_bbox": f"""WITH p AS (SELECT p_partkey, ({_text(SHAPES)})[p_partkey%25+1] AS shape, p_size::DOUBLE AS s1, p_size/2.0::DOUBLE AS s2, p_size/4.0::DOUBLE AS s3, 'in' AS units FROM part), {DIMS}
          SELECT p_partkey, shape, round(d1, 4) AS x, round(d2, 4) AS y, round(CASE WHEN shape IN {R3} OR shape IN {R2} THEN d2 ELSE d3 END, 4) AS z, true AS all_used FROM q""",
        "render_files": "SELECT p_partkey, 'application/pdf' AS media, 1::INT AS pages, '%PDF-1.4' AS head, true AS long_enough, true AS numbered, NULL::VARCHAR AS error FROM part",
        "described": f"""WITH {PARTS}, {DIMS}, j AS (SELECT *, '{{"name":"d.pdf","kind":"model",' || CASE WHEN p_partkey%5=0 THEN '"legend":"proprietary",' ELSE '' END || '"company":"Acme","title":"' || p_name || '","part_number":"' || p_partkey || '",' || CASE WHEN p_partkey%3<>0 THEN '"rev":"B",' ELSE '' END
            || '"shape":"' || shape || '","units":"' || units || '","size":[' || s1 || ',' || s2 || ',' || s3 || '],"material":"' || p_type || '","callouts":["' || p_brand || '","2X\\tHOLES"],"notes":["BREAK EDGES","CLEAN “PARTS”"],"originating_system":"CAD 1"}}' AS spec FROM q)
          SELECT p_partkey, 'model' AS kind, '3D model' AS label, 'step' AS media, least(700, length({model}))::INT AS preview_chars, '/att/' || p_partkey || '/file?v=' || substring(sha1(spec), 1, 10) AS url FROM j""",
        **more_sql(),
    }


__all__ = ["oracle_sql"]
