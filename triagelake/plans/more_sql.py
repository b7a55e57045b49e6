"""DuckDB SQL for more_queries. Every value is written out here; nothing is taken from the engine."""

from __future__ import annotations

#: Widths of the characters from space to tilde, as the font publishes them.
PLAIN = "278,278,355,556,556,889,667,191,333,333,389,584,278,333,278,278,556,556,556,556,556,556,556,556,556,556,278,278,584,584,584,556,1015,667,667,722,722,667,611,778,722,278,500,667,556,833,722,778,667,778,722,667,611,722,667,944,667,667,611,278,278,278,469,556,333,556,556,500,556,556,278,556,556,222,222,500,222,833,556,556,556,556,333,500,278,556,500,722,500,500,500,334,260,334,584"
BOLD = "278,333,474,556,556,889,722,238,333,333,389,584,278,333,278,278,556,556,556,556,556,556,556,556,556,556,333,333,584,584,584,611,975,722,722,722,722,667,611,778,722,278,556,722,611,833,722,778,667,778,722,667,611,722,667,944,667,667,611,333,278,333,584,556,333,556,611,556,611,556,333,611,611,278,278,556,278,889,611,611,611,611,389,556,333,611,556,778,556,556,500,389,280,389,584"


def _units(text: str, table: str) -> str:
    return f"list_sum(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = 'Ø' THEN 778 WHEN c = '±' THEN 584 WHEN c = '°' THEN 400 ELSE ([{table}])[ascii(c) - 31] END))"



VERSIONS = "e AS (SELECT user_id AS id, event_id%16 AS version, max(event_type) AS sig FROM events GROUP BY 1, 2), l AS (SELECT *, lag(sig) OVER (PARTITION BY id ORDER BY version) AS b FROM e), v AS (SELECT id, max(version) AS changed_at FROM l WHERE b IS NULL OR b <> sig GROUP BY id)"
HINTS = "CASE kind WHEN 'auth' THEN 'Check the API key.' WHEN 'rate_limit' THEN 'Too many calls; they are paced and tried again.' WHEN 'validation' THEN 'The request was not accepted; check the question set.' WHEN 'overloaded' THEN 'The service is busy; try again.' WHEN 'server' THEN 'The service had an error; try again.' ELSE 'The answer was not understood.' END"
TEXT_OF = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}]+$', '', 'g'), '[ \t\f\x0B]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'))"


def more_sql() -> dict[str, str]:
    bar = "repeat('#', round_even(p*20, 0)::INT) || repeat('.', 20 - round_even(p*20, 0)::INT)"
    return {
        "bootstrap": """SELECT 'message' AS part, o_orderkey AS ord, '{"id":"E' || o_orderkey || '","subject":"' || o_orderpriority || '","attachments":[]}' AS value FROM orders
          UNION ALL SELECT * FROM (VALUES ('lane', 0, '{"id":"milling_3axis","name":"3-Axis Milling","owner":"Ana Estimator","role":"Estimator","group":"estimating"}'), ('lane', 1, '{"id":"milling_5axis","name":"5-Axis & Complex","owner":"Ben Estimator","role":"Senior Estimator","group":"estimating"}'),
            ('lane', 2, '{"id":"turning","name":"Turning & Swiss","owner":"Cem Estimator","role":"Estimator","group":"estimating"}'), ('lane', 3, '{"id":"itar","name":"ITAR / CUI Restricted","owner":"Dana Restricted","role":"Export-controlled quoting, U.S. persons only","group":"estimating"}'),
            ('lane', 4, '{"id":"orders","name":"Orders & Customer Service","owner":"Eli Service","role":"Customer Service","group":"other"}'), ('lane', 5, '{"id":"review","name":"Needs Human Review","owner":"Fay Reviewer","role":"Quoting Manager","group":"other"}'),
            ('lane', 6, '{"id":"filtered","name":"Filtered: Not Customer Work","owner":"Auto-archive","role":"No reply","group":"other"}'), ('uploads', 0, '{"max_files":5,"max_bytes":10485760,"types":["application/pdf","image/jpeg","image/png"]}'))
          UNION ALL SELECT 'threshold', i, '{"name":"' || n || '","value":' || v || '}' FROM (VALUES (0, 'email_type_confidence', '0.5'), (1, 'process_confidence', '0.5'), (2, 'export_control_restrict', '0.5'), (3, 'itar_exempt_confidence', '0.8'), (4, 'export_control_warn', '0.2'), (5, 'rush_score', '2.3'),
            (6, 'soon_score', '1.5'), (7, 'quantity_given', '0.5'), (8, 'drawings_provided', '0.5'), (9, 'outside_processing', '0.6'), (10, 'volume_confidence', '0.35')) AS t(i, n, v)""",
        "first_answers": f"""WITH a(ord, question, pos, key, p) AS (VALUES (0, 'email_type', 0, 'new_rfq', 0.82::DOUBLE), (0, 'email_type', 1, 'quote_revision', 0.036), (0, 'email_type', 2, 'purchase_order', 0.036), (0, 'email_type', 3, 'order_followup', 0.036), (0, 'email_type', 4, 'vendor_or_solicitation', 0.036), (0, 'email_type', 5, 'other', 0.036),
            (1, 'process', 0, 'turning', 0.78), (1, 'process', 1, 'milling_3axis', 0.0733), (1, 'process', 2, 'milling_5axis', 0.0733), (1, 'process', 3, 'mixed_or_unclear', 0.0733), (2, 'export_controlled', 0, 'true', 0.92), (3, 'urgency', 0, '0', 0.08), (3, 'urgency', 1, '1', 0.08), (3, 'urgency', 2, '2', 0.08), (3, 'urgency', 3, '3', 0.76),
            (4, 'quantity_given', 0, 'true', 0.88), (5, 'drawings_provided', 0, 'true', 0.15), (6, 'outside_processing', 0, 'true', 0.85), (7, 'volume', 0, 'production', 0.7), (7, 'volume', 1, 'prototype', 0.1), (7, 'volume', 2, 'low_volume', 0.1), (7, 'volume', 3, 'not_stated', 0.1))
          SELECT ord, question, pos, key, p, {bar} AS bar FROM a""",
        "files_once": "SELECT p_partkey, 'application/pdf' AS media, 1::INT AS pages, true AS drawn, NULL::VARCHAR AS error FROM part",
        "run_split": """WITH a AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey AS k, o_orderkey%1000 AS n, (['idle','queued','running','done','error'])[o_orderkey%5+1] AS status FROM orders)
          SELECT id, CASE WHEN status='queued' OR (status='running' AND k%2<>0) THEN 'skip' WHEN status='running' THEN 'again' WHEN k%7<>0 AND n IN (SELECT c_custkey FROM customer WHERE c_custkey < 500) THEN 'cached' ELSE 'queued' END AS outcome FROM a""",
        "run_request": """WITH a AS (SELECT o_orderkey AS k, o_orderkey%5000 IN (SELECT c_custkey FROM customer) AS saved FROM orders)
          SELECT k::VARCHAR AS id, CASE WHEN (k%2=0 OR k%3=0) THEN CASE WHEN saved THEN 'done' ELSE 'queued' END ELSE 'idle' END AS status, CASE WHEN (k%2=0 OR k%3=0) AND saved THEN 'cache' END AS source,
            CASE WHEN saved THEN NULL WHEN k%2=0 THEN 1 WHEN k%3=0 THEN -2 END::BIGINT AS batch, CASE WHEN NOT saved AND (k%2=0 OR k%3=0) THEN k END AS pos FROM a""",
        "board_delta": f"WITH {VERSIONS}, f AS (SELECT user_id AS id, min(event_id%16) AS added_at FROM events GROUP BY 1) SELECT id, changed_at, added_at > 11 AS added FROM v JOIN f USING (id) WHERE changed_at > 11",
        "board_state": """WITH i AS (SELECT event_id%3<>0 AS done, round(value, 2) AS lat FROM events), m AS (SELECT list_sort(list(lat)) AS v FROM i WHERE done AND lat <> 0)
          SELECT 15 AS version, false AS "full", true AS with_order, count(*) AS total, count(*) FILTER (done) AS routed, round((SELECT v[len(v)//2+1] FROM m), 4) AS median_latency_ms, 0.0::DOUBLE AS cost_usd FROM i""",
        "board_entry": """SELECT event_id AS id, (['idle','queued','done','error','done'])[event_id%5+1] AS status, CASE WHEN event_id%5=3 THEN 'server' END AS error,
          CASE WHEN event_id%5 IN (2,4) AND event_id%10<>4 THEN event_type END AS model, CASE WHEN event_id%5 IN (2,4) AND event_id%10<>4 THEN round(value, 2) END AS latency_ms FROM events""",
        "board_json": f"""WITH {VERSIONS} SELECT '{{"id":' || id || ',"changed_at":' || changed_at || '}}' AS value FROM v""",
        "board_counters": "SELECT count(*) FILTER (event_id%3=0) AS cache_hits, count(*) FILTER (event_id%4=0) AS queue_length, count(*) FILTER (event_type='click') AS calls FROM events",
        "memo_misses": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey%5=0 OR o_orderkey%7=0 OR o_orderkey%13=0 OR o_orderkey%17=0",
        "normal_records": """SELECT event_id, 'm' AS model, round(value*2, 1) AS latency_ms, event_id AS input_tokens, CASE WHEN event_id%2=0 THEN 7 END::BIGINT AS output_tokens,
          round(CASE WHEN event_id%2=0 THEN round(value, 2) ELSE event_id*4.2e-8 END, 8) AS cost_usd, event_id%2<>0 AS cost_is_estimate, round(event_id*4.2e-8, 8)::DOUBLE AS list_price_usd, CASE WHEN event_id%2=0 THEN 'g' END AS generation_id FROM events""",
        "normal_responses": """WITH e AS (SELECT event_id, (event_id%10)/10.0::DOUBLE AS a, event_id%4<>0 AS whole FROM events)
          SELECT event_id, CASE WHEN NOT whole THEN 'bad_response' END AS error, CASE WHEN event_id%3=0 THEN 'req' END AS request_id, CASE WHEN whole THEN CASE WHEN a >= 0.5 THEN 'a' ELSE 'b' END END AS choice, CASE WHEN whole THEN greatest(a, 0.5::DOUBLE) END AS p,
            CASE WHEN whole THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2*greatest(a, 0.5::DOUBLE) - 1)), 6) END AS confidence, CASE WHEN whole THEN (event_id%9)/10.0::DOUBLE END AS sure FROM e""",
        "error_records": f"""WITH s AS (SELECT event_id, event_type, ([400,401,429,503,500,418,529])[event_id%7+1]::INT AS status FROM events),
          k AS (SELECT *, CASE status WHEN 400 THEN 'validation' WHEN 401 THEN 'auth' WHEN 429 THEN 'rate_limit' WHEN 503 THEN 'overloaded' WHEN 529 THEN 'overloaded' WHEN 500 THEN 'server' ELSE 'bad_response' END AS kind FROM s)
          SELECT event_id, CASE event_id%5 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN 'body.x: bad' WHEN 3 THEN 'plain text' ELSE 'HTTP ' || status END AS message, kind, status,
            CASE event_id%6 WHEN 0 THEN round((event_id%7000)/1000.0::DOUBLE, 3) WHEN 1 THEN (event_id%50)::DOUBLE WHEN 2 THEN 90.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE END AS retry_after, {HINTS} AS hint FROM k""",
        "key_hints": "SELECT c_custkey, CASE WHEN c_custkey%2=0 THEN substring(c_name, 1, 6) || '...(' || length(c_name) || ' chars)' ELSE '(short key)' END AS hint FROM customer",
        "known_requests": "SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT user_id FROM events)",
        "cache_upsert": """WITH a AS (SELECT user_id || ':' || event_type AS key, max(event_id) AS saved_at, arg_max(value, event_id) AS value FROM events WHERE event_id%3=0 GROUP BY 1), b AS (SELECT user_id || ':' || event_type AS key, max(event_id) AS saved_at, arg_max(value, event_id) AS value FROM events WHERE event_id%3<>0 GROUP BY 1)
          SELECT key, saved_at, round(value, 6) AS value FROM b UNION ALL SELECT key, saved_at, round(value, 6) FROM a WHERE key NOT IN (SELECT key FROM b)""",
        "cache_export": "SELECT user_id::VARCHAR AS key, coalesce(max(event_id) FILTER (event_id%2=1), max(event_id)) AS saved_at FROM events GROUP BY 1 ORDER BY 1",
        "cache_key": """SELECT doc_id, substring(sha256('{"model":"m","questions":"q","state":{"from":"' || source || '","subject":"s","body":"' || lang || '","attachments":"none"},"url":"https://x.example.com"}'), 1, 32) AS key FROM documents""",
        "saved_answers": "SELECT doc_id, CASE WHEN doc_id%2=0 THEN 'saved' ELSE 'rules' END AS source, CASE WHEN regexp_matches(source || ' ' || lang, 'promo|expo|lunch|parking|resume|webinar|newsletter|hiring|staffing') THEN 'vendor_or_solicitation' ELSE 'other' END AS kind FROM documents",
        "posted_messages": """WITH p AS (SELECT DISTINCT conv_id AS k FROM conversations), f AS (SELECT k, CASE WHEN k%4 < 3 THEN CASE WHEN k%2=0 THEN 1 ELSE 2 END ELSE 0 END AS sample, CASE WHEN k%9=0 THEN 6 ELSE k%2 END AS wanted, k%100 < 70 AND k%100 IN (SELECT doc_id FROM documents) AS there, 2*(k%12) AS named FROM p)
          SELECT k AS ord, CASE WHEN k%5=0 AND k%10=0 THEN 'Add a subject or a body.' WHEN wanted > 5 THEN 'Attach up to 5 files.' WHEN wanted > 0 AND NOT there THEN 'An uploaded file is no longer in memory. Remove it and add it again.' END AS error,
            least(20, sample + CASE WHEN there THEN wanted ELSE 0 END + named)::INT AS files FROM f""",
        "new_message_ids": """WITH t AS (SELECT c_custkey AS n FROM customer WHERE c_custkey%3=0), g AS (SELECT range AS n FROM range(1, (SELECT count(*) FROM orders) + (SELECT count(*) FROM t) + 1) WHERE range NOT IN (SELECT n FROM t)),
          f AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM g), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) SELECT printf('L%02d', n) AS id, o_orderkey AS ord, 'unknown@example.com' AS from_email FROM o JOIN f USING (k)""",
        "sent_text": f"""WITH t AS (SELECT doc_id, text, {TEXT_OF} AS t FROM documents) SELECT doc_id::VARCHAR AS id, 'f.pdf' AS file,
          md5(CASE WHEN length(t) > 1800 THEN regexp_replace(substring(t, 1, 1800), '\\s+$', '') || ' [truncated]' ELSE t END) AS digest, length(t) > 1800 AS truncated, length(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '', 'g'))::INT AS full_chars FROM t""",
        "attachment_texts": """SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN '(image file, ' || p_size || ' x 7 px; there is no text to read)' WHEN 1 THEN '(image file; there is no text to read)' WHEN 2 THEN '(PDF file; its text could not be read: broken)'
          WHEN 3 THEN '(PDF file with no text layer, for example a scan; there is no text to read)' ELSE '(attached to the email; only the file name is available, not its contents)' END AS text FROM part""",
        "claimed_uploads": "SELECT doc_id AS upload_id, lang, n_chars FROM labels JOIN documents USING (doc_id)",
        "store_bytes": "SELECT sum(n_chars)::BIGINT AS bytes FROM documents",
        "text_widths": f"""WITH t AS (SELECT p_partkey, p_name || ' Ø±° ' || p_type AS t FROM part), u AS (SELECT p_partkey, {_units('t', PLAIN)} AS a, {_units('t', BOLD)} AS b FROM t)
          SELECT p_partkey, round(a*9.0::DOUBLE/1000, 4) AS plain, round(b*7.0::DOUBLE/1000, 4) AS bold, greatest(4.5::DOUBLE, least(9.0::DOUBLE, floor(60.0::DOUBLE*1000/a/0.25)*0.25))::DOUBLE AS size FROM u""",
        "lane_dimension": """SELECT * FROM (VALUES (0, 'milling_3axis', '3-Axis Milling', 'Ana Estimator', 'Estimator', 'estimating'), (1, 'milling_5axis', '5-Axis & Complex', 'Ben Estimator', 'Senior Estimator', 'estimating'), (2, 'turning', 'Turning & Swiss', 'Cem Estimator', 'Estimator', 'estimating'),
          (3, 'itar', 'ITAR / CUI Restricted', 'Dana Restricted', 'Export-controlled quoting, U.S. persons only', 'estimating'), (4, 'orders', 'Orders & Customer Service', 'Eli Service', 'Customer Service', 'other'), (5, 'review', 'Needs Human Review', 'Fay Reviewer', 'Quoting Manager', 'other'), (6, 'filtered', 'Filtered: Not Customer Work', 'Auto-archive', 'No reply', 'other')) AS t(ord, id, name, owner, role, "group")""",
        "question_options": """WITH q(name, type, keys) AS (VALUES ('email_type', 'choice', ['new_rfq','quote_revision','purchase_order','order_followup','vendor_or_solicitation','other']), ('process', 'choice', ['milling_3axis','milling_5axis','turning','mixed_or_unclear']), ('export_controlled', 'noul', ['true','false']), ('urgency', 'score', ['0','1','2','3']),
          ('quantity_given', 'noul', ['true','false']), ('drawings_provided', 'noul', ['true','false']), ('outside_processing', 'noul', ['true','false']), ('volume', 'choice', ['prototype','low_volume','production','not_stated'])) SELECT name, type, (generate_subscripts(keys, 1) - 1)::INT AS pos, unnest(keys) AS key FROM q""",
        "bars": """WITH n AS (SELECT c_custkey, c_name, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal/10000))*20, 0)::INT AS n FROM customer) SELECT c_custkey, repeat('#', n) || repeat('.', 20 - n) AS bar, '&lt;a b=&quot;&amp;''&quot;&gt;' || c_name AS markup FROM n""",
        "state_files": """WITH o AS (SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey=c_custkey), f AS (SELECT k, (CASE WHEN k%3=0 THEN ['part' || k || '.step'] WHEN k%3=1 THEN ['rfq_form.pdf'] ELSE [] END) || (CASE WHEN k%10=0 THEN ['scan' || k || '.pdf'] ELSE [] END) AS fs FROM o), u AS (SELECT k AS id, (generate_subscripts(fs, 1) - 1)::INT AS pos, unnest(fs) AS file FROM f)
          SELECT id, pos, file, CASE WHEN file LIKE 'scan%' THEN length('Notes. ITAR controlled.') ELSE length('(attached to the email; only the file name is available, not its contents)') END::INT AS chars FROM u""",
        "file_status": "SELECT p_partkey, CASE WHEN p_partkey%11=0 OR p_partkey%3=2 THEN 404 WHEN p_partkey%3=1 AND p_partkey%2<>0 THEN 410 WHEN p_partkey%13=0 THEN 500 ELSE 200 END AS status FROM part",
    }


__all__ = ["more_sql"]
