"""Values of the rules as the SQL knows them: written out here, apart from the engine, so that a wrong one on
either side shows. Fixed values, in the order in which they count."""


import datetime as dt

EMAIL_TYPES = {
    "new_rfq": "New RFQ",
    "quote_revision": "Quote revision",
    "purchase_order": "Purchase order",
    "order_followup": "Order follow-up",
    "vendor_or_solicitation": "Vendor / solicitation",
    "other": "Other",
}
VOLUMES = {
    "prototype": "Prototype",
    "low_volume": "Low volume",
    "production": "Production",
    "not_stated": "Qty not stated",
}
DOC_TYPES = ("Resume", "Brochure", "Certificate", "Invoice", "Packing slip", "Letter", "Spec sheet", "Report", "Newsletter")
PROCESS_LABELS = {
    "milling_3axis": "3-Axis Milling",
    "milling_5axis": "5-Axis & Complex",
    "turning": "Turning & Swiss",
    "mixed_or_unclear": "Mixed / unclear",
}
#: Lanes: id, name, owner.
LANES = (
    ("milling_3axis", "3-Axis Milling", "Ana Estimator"),
    ("milling_5axis", "5-Axis & Complex", "Ben Estimator"),
    ("turning", "Turning & Swiss", "Cem Estimator"),
    ("itar", "ITAR / CUI Restricted", "Dana Restricted"),
    ("orders", "Orders & Customer Service", "Eli Service"),
    ("review", "Needs Human Review", "Fay Reviewer"),
    ("filtered", "Filtered: Not Customer Work", "Auto-archive"),
)
REVIEWER, SHOP_NAME, MODEL_NAME = "Quoting Manager", "The Shop", "Model"
BARS = {
    "email_type_confidence": 0.5,
    "process_confidence": 0.5,
    "export_control_restrict": 0.5,
    "itar_exempt_confidence": 0.8,
    "export_control_warn": 0.2,
    "rush_score": 2.3,
    "soon_score": 1.5,
    "quantity_given": 0.5,
    "drawings_provided": 0.5,
    "outside_processing": 0.6,
    "volume_confidence": 0.35,
}
TIERS = {
    "BUILDING": "A",
    "AUTOMOBILE": "A",
    "MACHINERY": "B",
    "HOUSEHOLD": "C",
}
TODAY = dt.date(2026, 9, 3)
CAD_ENDINGS = (".step", ".stp", ".igs", ".iges", ".sldprt", ".sldasm", ".x_t", ".x_b", ".dxf", ".dwg", ".prt", ".ipt", ".iam", ".stl", ".3mf", ".par", ".catpart")
NOT_A_DRAWING = r"(?i)(^|[^a-z])(po|purchase|invoice|cert|certs|coc|resume|cv|brochure|catalog|quote_form|rfq|form|linecard|newsletter|packing|slip|statement|remit|ncr|rma|terms)([^a-z]|$)"
#: Words of the keyword rules.
EXPORT = r"\bitar\b|\bcui\b|\bear\b|eccn|export|dfars|u\.s\. persons|arms export"
QUANTITY = r"\b\d[\d,]*\s*(pcs|pieces|each|ea|units|parts)\b|qty|quantit|annual|/yr|per year|\d+\s*/\s*\d+"
PITCH = r"new job|resume|hiring|staffing|promo|% off|webinar|newsletter|expo|demo this week|our services|unsubscribe|lunch|parking|gift card|verify your account"
PO = r"\bpo\b|purchase order|please proceed|award"
ASKS = r"quote|rfq|pricing"
QUOTE_SUBJECT = r"\brfq\b|quote|pricing|price"
ORDER_SUBJECT = r"\bpo\b|status|tracking|invoice"
REVISED_SUBJECT = r"\bre:|revis|rev [a-z]\b.*(update|now)|update"
FOLLOWUP = r"status|tracking|ship date|shipped|certs|certification|invoice|fai report|on track|rma|nonconform|change order"
REVISED = r"rev [a-z]\b.*(update|revise)|revised|revision|update(d)? quote"
QUOTE = r"quote|rfq|pricing|price|can you make"
COUNTED = r"\b(\d[\d,]{0,6})\s*(?:pcs|pieces|each|ea|/yr|per year|units)"
VAGUE = r"can you make|what would .* cost|can you do this"
EXPORT_PITCH = (r"we are itar registered|itar registered", r"our services|we offer|special pricing|capabilit")
URGENCY = (
    r"due|by \w+ \d|within|weeks",
    r"this week|by friday|end of the week|few days",
    r"urgent|asap|line down|aog|rush|expedite|today|tomorrow",
)
PROCESSES = (
    ("mixed_or_unclear", r"weld|fabricat|sheet metal|casting|foundry|3d print|injection mold|molded"),
    ("milling_5axis", r"5-axis|five-axis|impeller|implant|contour|sculpt|compound|blade|vane|wing rib|structural fitting"),
    ("turning", r"shaft|\bpins?\b|bushing|spacer|lathe|turn(ed|ing)|swiss|nozzle|gear blank|roller|\bstuds?\b"),
    ("milling_3axis", r"plate|bracket|block|housing|cover|manifold|heat sink|heatsink|fixture|enclosure"),
)
#: What the queries over documents add to a text.
PHRASES = (
    "", " Please quote 500 pcs of the anodized shaft, due next month.", " RFQ: 25 each of the 5-axis impeller, attached drawing.", " Purchase order 77, please proceed. Need it today.", " What is the status of our order, is it shipped?",
    " Our services: we are ITAR registered, special pricing.", " ITAR data, see rev b, please revise. Quote by Friday 3.", " Can you make this bracket? 5 / 10 / 20", " Weld and casting work, quote please, urgent.", " Revised model, update quote for the housing, 12 pcs this week.",
    " CUI, PO attached.", " We offer staffing and hiring.",
)
