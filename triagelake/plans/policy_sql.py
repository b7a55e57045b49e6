"""DuckDB SQL of the policy over the bridge's messages: written from the rules, apart from the engine."""

from __future__ import annotations

from .sql_values import BARS, EMAIL_TYPES, LANES, MODEL_NAME, PROCESS_LABELS, REVIEWER, SHOP_NAME, TIERS, TODAY, VOLUMES


def _array(values: list[str]) -> str:
    return "[" + ", ".join(values) + "]"


def _text(values) -> str:
    return _array([f"'{v}'" for v in values])


def _pct(x: str) -> str:
    return f"(round_even(({x})*100, 0)::INT || '%')"


def _weights() -> str:
    kind = [f"1 + (k*{2 * i + 7} + {13 * i})%41 + CASE WHEN k%5<>0 AND k%6={i} THEN 400 ELSE 0 END + CASE WHEN k%5=0 AND (k//5)%3={i // 2} THEN 150 ELSE 0 END" for i in range(6)]
    process = [f"1 + (k*{2 * i + 11} + {17 * i})%37 + CASE WHEN k%7<>0 AND (k//6)%4={i} THEN 250 ELSE 0 END" for i in range(4)]
    volume = [f"1 + (k*{2 * i + 23} + {29 * i})%31 + CASE WHEN k%9<>0 AND (k//24)%4={i} THEN 250 ELSE 0 END" for i in range(4)]
    urgency = [f"1 + (k*{2 * i + 13} + {7 * i})%23 + CASE WHEN (k//3)%4={i} THEN 200 ELSE 0 END" for i in range(4)]
    return f"{_array(kind)} AS etw, {_array(process)} AS prw, {_array(volume)} AS vow, {_array(urgency)} AS urw"


def _stats(w: str, n: int) -> str:
    """First and second option by weight (ties in order), their shares, and the confidence."""
    total = f"list_sum({w})::DOUBLE"
    return (
        f"list_position({w}, list_max({w})) AS {w}1, list_max({w}) / {total} AS {w}p1, "
        f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({n} * (list_max({w}) / {total}) - 1.0::DOUBLE) / {n - 1}.0::DOUBLE)) AS {w}c, "
        f"list_transform({w}, lambda x, i: CASE WHEN i = list_position({w}, list_max({w})) THEN -1 ELSE x END) AS {w}r"
    )


def decision_cte(bars: dict[str, float] | None = None) -> str:
    """WITH ... d AS (one row a message, with everything the policy says)."""
    th = {**BARS, **(bars or {})}
    t = {k: f"{v}::DOUBLE" for k, v in th.items()}
    types, processes, volumes = list(EMAIL_TYPES), list(PROCESS_LABELS), list(VOLUMES)
    tlab, plab, vlab = _text(EMAIL_TYPES.values()), _text(PROCESS_LABELS.values()), _text(VOLUMES.values())
    name_of = "CASE lane " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x, _ in LANES) + " END"
    owner_of = "CASE lane " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, _, x in LANES) + " END"
    tier = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in TIERS.items()) + " END"
    model, today = MODEL_NAME, f"DATE '{TODAY}'"
    exempt = max(th["itar_exempt_confidence"], th["email_type_confidence"])

    def top(w: str, lab: str) -> str:
        return f"({lab}[{w}1] || ' ' || {_pct(w + 'p1')} || ' vs ' || {lab}[{w}2] || ' ' || {_pct(w + 'p2')})"

    both = "(etwp1 + etwp2)"
    return f"""
WITH o AS (
  SELECT o_orderkey AS k, o_custkey, o_orderpriority, c_mktsegment, c_name, {tier} AS tier FROM orders JOIN customer ON o_custkey = c_custkey
), w AS (SELECT *, {_weights()} FROM o
), s AS (
  SELECT *, {_stats('etw', 6)}, {_stats('prw', 4)}, {_stats('vow', 4)}, list_sum(urw)::DOUBLE AS urs,
    (k*37%101)/200.0::DOUBLE + CASE WHEN k%11=0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS ex,
    (k*53%101)/100.0::DOUBLE AS qty, (k*59%101)/100.0::DOUBLE AS drw, (k*61%101)/100.0::DOUBLE AS osp
  FROM w
), s2 AS (
  SELECT *, list_position(etwr, list_max(etwr)) AS etw2, list_max(etwr)/list_sum(etw)::DOUBLE AS etwp2, list_position(prwr, list_max(prwr)) AS prw2, list_max(prwr)/list_sum(prw)::DOUBLE AS prwp2,
    0.0::DOUBLE + 0*(urw[1]/urs) + 1*(urw[2]/urs) + 2*(urw[3]/urs) + 3*(urw[4]/urs) AS score,
    {_text(types)}[etw1] AS et, {_text(processes)}[prw1] AS pr, {_text(volumes)}[vow1] AS vo,
    (CASE WHEN k%3=0 THEN ['part' || k || '.step'] ELSE [] END) || (CASE WHEN k%10=0 THEN ['scan' || k || '.pdf'] ELSE [] END) AS cad
  FROM s
), s3 AS (
  SELECT *, CASE WHEN (etw1-1)//2 = (etw2-1)//2 AND etw1 <= 4 AND etw2 <= 4 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (6*{both} - 1.0::DOUBLE)/5.0::DOUBLE)) END AS pairc, et IN ('new_rfq','quote_revision') AS is_rfq FROM s2
), s4 AS (SELECT *, greatest(etwc, coalesce(pairc, etwc)) AS route FROM s3
), s5 AS (
  SELECT *, ex >= {t['export_control_restrict']} AND NOT (etwc >= {exempt}::DOUBLE AND et IN ('vendor_or_solicitation','other')) AS restricted, route >= {t['email_type_confidence']} AS sure,
    pr <> 'mixed_or_unclear' AND prwc >= {t['process_confidence']} AS pok FROM s4
), s6 AS (
  SELECT *, CASE WHEN restricted THEN 'itar' WHEN NOT sure THEN 'review' WHEN et IN ('vendor_or_solicitation','other') THEN 'filtered' WHEN et IN ('purchase_order','order_followup') THEN 'orders' WHEN NOT pok THEN 'review' ELSE pr END AS lane,
    (NOT restricted AND sure AND is_rfq) AS asked,
    CASE WHEN restricted THEN 'Export-controlled technical data. Only U.S. persons may handle it, so it skips the shared queues.'
      WHEN NOT sure THEN '{model} is unsure what kind of email this is: ' || {top('etw', tlab)} || '.'
      WHEN et IN ('vendor_or_solicitation','other') THEN {tlab}[etw1] || ', not customer work.'
      WHEN et IN ('purchase_order','order_followup') THEN {tlab}[etw1] || ' for an existing job.'
      WHEN pr = 'mixed_or_unclear' THEN 'Mixed processes or not enough detail to pick an estimator.'
      WHEN prwc < {t['process_confidence']} THEN '{model} is torn between estimators: ' || {top('prw', plab)} || '.'
      ELSE {plab}[prw1] || ' work, ' || {_pct('prwp1')} || ' probability.' END AS reason,
    score >= {t['rush_score']} AS rush, score >= {t['soon_score']} AS soon,
    is_rfq AND len(cad)=0 AND drw < {t['drawings_provided']} AS nodrw, is_rfq AND qty < {t['quantity_given']} AS noqty,
    vo = 'production' AND vowc >= {t['volume_confidence']} AS production, coalesce(tier = 'A', false) AS tier_a FROM s5
), s7 AS (
  SELECT *,
    list_filter([CASE WHEN rush AND lane<>'filtered' THEN 'rush' END, CASE WHEN lane='itar' THEN 'itar' END, CASE WHEN lane<>'itar' AND ex >= {t['export_control_warn']} THEN 'itar_check' END,
      CASE WHEN nodrw THEN 'missing_drawings' END, CASE WHEN noqty THEN 'missing_qty' END, CASE WHEN is_rfq AND osp >= {t['outside_processing']} THEN 'outside_processing' END,
      CASE WHEN is_rfq AND vowc >= {t['volume_confidence']} AND vo <> 'not_stated' THEN 'volume:' || {vlab}[vow1] END], lambda x: x IS NOT NULL) AS flags,
    list_filter([CASE WHEN nodrw THEN 'drawings (PDF plus STEP if you have it)' END, CASE WHEN noqty THEN 'the quantities you want quoted' END], lambda x: x IS NOT NULL) AS missing,
    (lane = 'orders' OR (lane = 'itar' AND et IN ('purchase_order','order_followup'))) AS waiting FROM s6
), s8 AS (
  SELECT *, CASE WHEN lane='filtered' THEN NULL WHEN rush THEN 'P1' WHEN is_rfq AND tier_a AND production THEN 'P1' WHEN waiting THEN 'P2' WHEN soon OR tier_a OR production THEN 'P2' ELSE 'P3' END AS priority,
    CASE WHEN lane='filtered' THEN '' WHEN rush THEN 'rush language' WHEN is_rfq AND tier_a AND production THEN 'A-tier customer and production volume' WHEN waiting THEN 'customer is waiting on an existing order'
      WHEN soon OR tier_a OR production THEN array_to_string(list_filter([CASE WHEN soon THEN 'short turnaround' END, CASE WHEN tier_a THEN 'A-tier customer' END, CASE WHEN production THEN 'production volume' END], lambda x: x IS NOT NULL), ', ')
      ELSE 'standard request' END AS why, (lane='orders' OR (lane='itar' AND NOT is_rfq)) AS reply_only FROM s7
), s9 AS (SELECT *, CASE WHEN reply_only THEN 0 WHEN priority='P1' THEN 0 WHEN priority='P2' THEN 2 ELSE 5 END AS days FROM s8
), s10 AS (
  SELECT *, CASE WHEN priority IS NOT NULL THEN CASE WHEN days > 0 THEN ({today} + (least(isodow({today})-1, 4) - (isodow({today})-1) + days + 2*((least(isodow({today})-1, 4) + days)//5))::INT) ELSE {today} END END AS due,
    {name_of} AS lane_name, {owner_of} AS owner FROM s9
), d AS (
  SELECT *, CASE WHEN due IS NULL THEN NULL WHEN due = {today} THEN 'today' WHEN due = {today} + 1 THEN 'tomorrow' ELSE strftime(due, '%a, %b %-d') END AS due_label, CASE WHEN due IS NULL THEN NULL WHEN reply_only THEN 'reply' ELSE 'quote' END AS due_kind FROM s10
)
"""


def trace_sql() -> str:
    th, model = BARS, MODEL_NAME
    tlab, plab = _text(EMAIL_TYPES.values()), _text(PROCESS_LABELS.values())
    bar = lambda n: f"{round(th[n] * 100)}%"
    where = "CASE WHEN k%10=0 AND ex >= 0.2::DOUBLE THEN ' Export-control wording found in scan' || k || '.pdf.' ELSE '' END"
    together = f"CASE WHEN pairc > etwc THEN ' ' || {tlab}[etw1] || ' and ' || {tlab}[etw2] || ' go to the same place: together ' || {_pct('etwp1 + etwp2')} || ', confidence ' || {_pct('pairc')} || '.' ELSE '' END"
    steps = f"""[
      {{'label': 'Export-controlled?', 'detail': '{model}: ' || {_pct('ex')} || ' likely ITAR / CUI. Restricted queue at {bar('export_control_restrict')} or above.' || {where}, 'outcome': CASE WHEN restricted THEN 'stop' ELSE 'pass' END}},
      {{'label': 'What kind of email?', 'detail': CASE WHEN restricted THEN '{model}: ' || {tlab}[etw1] || ' (' || {_pct('etwp1')} || '). Restricted handling applies either way.'
         ELSE '{model}: ' || {tlab}[etw1] || ' (' || {_pct('etwp1')} || '), confidence ' || {_pct('etwc')} || '.' || {together} || ' Auto-route bar is {bar('email_type_confidence')}.' END,
         'outcome': CASE WHEN restricted THEN 'info' WHEN sure THEN 'pass' ELSE 'stop' END}},
      CASE WHEN asked THEN {{'label': 'Which estimator?', 'detail': '{model}: ' || {plab}[prw1] || ' (' || {_pct('prwp1')} || '), confidence ' || {_pct('prwc')} || '. Auto-route bar is {bar('process_confidence')}.', 'outcome': CASE WHEN pok THEN 'pass' ELSE 'stop' END}} END,
      CASE WHEN is_rfq THEN {{'label': 'Anything missing?', 'detail': 'CAD / drawing files attached: ' || CASE WHEN len(cad) > 0 THEN array_to_string(cad, ', ') ELSE 'none' END || '. {model}: drawings provided ' || {_pct('drw')} || ', quantity stated ' || {_pct('qty')} || '.', 'outcome': CASE WHEN len(missing) > 0 THEN 'warn' ELSE 'pass' END}} END,
      CASE WHEN priority IS NOT NULL THEN {{'label': 'Priority', 'detail': priority || ': ' || why || '. ' || CASE due_kind WHEN 'reply' THEN 'Reply' ELSE 'Quote' END || ' due ' || due_label || '.', 'outcome': 'info'}} END,
      {{'label': 'Route', 'detail': lane_name || ' (' || owner || '). ' || reason, 'outcome': CASE WHEN lane='review' THEN 'review' ELSE 'done' END}}]"""
    return decision_cte() + f", t AS (SELECT k, list_filter({steps}, lambda x: x IS NOT NULL) AS steps FROM d), u AS (SELECT k, generate_subscripts(steps, 1) AS i, unnest(steps) AS s FROM t) SELECT k AS id, (i - 1)::INT AS pos, s.label AS label, s.detail AS detail, s.outcome AS outcome FROM u"


def action_sql() -> str:
    tlab, plab = _text(EMAIL_TYPES.values()), _text(PROCESS_LABELS.values())
    name = SHOP_NAME
    hi = "'Hi ' || CASE WHEN k%4=0 THEN 'there' WHEN k%4=1 THEN 'Ana' ELSE c_name END || ',' || chr(10) || chr(10)"
    received = """CASE WHEN k%8=0 THEN 'your email' ELSE 'your email "Order ' || k || ' ' || o_orderpriority || '"' END"""
    sign, service = f"chr(10) || chr(10) || 'Best,' || chr(10) || '{name} Quoting Team'", f"chr(10) || chr(10) || 'Best,' || chr(10) || '{name} Customer Service Team'"
    promise = "CASE WHEN due_label IS NOT NULL THEN ' You''ll have our quote by ' || due_label || '.' ELSE '' END"
    first = "split_part(owner, ' ', 1)"
    top = lambda w, lab: f"({lab}[{w}1] || ' ' || {_pct(w + 'p1')} || ' vs ' || {lab}[{w}2] || ' ' || {_pct(w + 'p2')})"
    order = "et IN ('purchase_order','order_followup')"
    title = f"""CASE WHEN lane='filtered' THEN 'Archive. No reply needed.'
      WHEN lane='orders' THEN CASE WHEN et='purchase_order' THEN 'Enter the PO in the ERP and send an order acknowledgment (' || owner || ')' ELSE 'Look up the order in the ERP and reply (' || owner || ')' END
      WHEN lane='itar' THEN CASE WHEN is_rfq OR {order} THEN 'Move to the restricted ITAR folder and notify ' || owner || '. Do not forward attachments outside the controlled environment.' ELSE owner || ' reviews this in the restricted ITAR folder before anyone replies. Do not forward it outside the controlled environment.' END
      WHEN lane='review' THEN owner || ' ({REVIEWER}) confirms where this goes. {MODEL_NAME}''s best guesses: ' || CASE WHEN is_rfq THEN {top('prw', plab)} ELSE {top('etw', tlab)} END || '.'
      WHEN len(missing) > 0 THEN 'Assign to ' || owner || ' and request the missing information' ELSE 'Assign to ' || owner || ' and send the acknowledgment' END"""
    draft = f"""CASE WHEN lane IN ('filtered','review') THEN NULL
      WHEN lane='orders' THEN CASE WHEN et='purchase_order' THEN {hi} || 'Thanks for the order. We received ' || {received} || ' and ' || {first} || ' is entering it now. We''ll confirm the ship date by end of day.' || {service}
        ELSE {hi} || 'Thanks for checking in. ' || {first} || ' is pulling up the order details now and will get back to you by end of day with an update.' || {service} END
      WHEN lane='itar' THEN CASE WHEN is_rfq THEN {hi} || 'Thanks for the RFQ. We received ' || {received} || ' and it is being handled by our export-controlled quoting team (U.S. persons only).' || {promise} || {sign}
        WHEN {order} THEN {hi} || 'Thanks for your note. We received ' || {received} || ' and our export-controlled team (U.S. persons only) will get back to you by end of day.' || {service} END
      ELSE {hi} || 'Thanks for the RFQ. We received ' || {received} || ' and ' || {first} || ' on our ' || lane_name || ' team is reviewing it now.'
        || CASE WHEN len(missing) > 0 THEN ' To give you an accurate price, could you send ' || array_to_string(missing, ' and ') || '?' ELSE {promise} END || {sign} END"""
    return decision_cte() + f", e AS (SELECT k, o_custkey, c_mktsegment, {title} AS title, {draft} AS draft FROM d) SELECT k AS id, title, CASE WHEN draft IS NOT NULL THEN 'buyer' || o_custkey || '@' || lower(c_mktsegment) || '.example.com' END AS send_to, draft FROM e"
