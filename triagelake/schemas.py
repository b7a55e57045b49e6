"""Row types, and the shop's configuration as data."""

from __future__ import annotations

from dataclasses import dataclass, field

OPTION = "array<struct<key:string,p:double>>"
CHOICE = f"struct<choice:string,p:double,confidence:double,confidence_estimated:boolean,probabilities:{OPTION}>"
SCORE = f"struct<score:double,confidence:double,confidence_estimated:boolean,probabilities:{OPTION},legend:map<string,string>>"
NOUL = "struct<p:double>"
ANSWERS = f"struct<email_type:{CHOICE},process:{CHOICE},export_controlled:{NOUL},urgency:{SCORE},quantity_given:{NOUL},drawings_provided:{NOUL},outside_processing:{NOUL},volume:{CHOICE}>"
RECORD = f"key string, email_id string, saved_at string, answers {ANSWERS}, model string, latency_ms double, input_tokens long, output_tokens long, cost_usd double, cost_is_estimate boolean, list_price_usd double, generation_id string, request_id string"

#: A normalised attachment: every field of every kind, null where it is not used.
ATTACHMENT_FIELDS: dict[str, str] = {
    **dict.fromkeys(("name", "kind", "legend", "company", "eccn", "title", "part_number", "rev", "date", "author", "shape", "units"), "string"),
    "size": "array<double>",
    **dict.fromkeys(("scale", "sheet", "drawn_by", "material", "finish", "tolerances"), "string"),
    "callouts": "array<string>",
    "notes": "array<string>",
    "revisions": "array<struct<rev:string,description:string,date:string>>",
    **dict.fromkeys(("schema", "originating_system", "rfq_number", "respond_by", "buyer", "buyer_email", "buyer_phone", "company_address", "terms"), "string"),
    "requirements": "array<string>",
    "rfq_lines": "array<struct<part_number:string,rev:string,description:string,material:string,finish:string,quantities:array<double>,notes:string>>",
    **dict.fromkeys(("po_number", "po_rev", "quote_ref", "ship_via", "ship_to"), "string"),
    "po_lines": "array<struct<part_number:string,rev:string,description:string,qty:string,unit_price:string,due:string>>",
    "doc_type": "string",
    "subtitle": "string",
    "sections": "array<struct<heading:string,lines:array<string>>>",
    "media": "string",
    "upload_id": "string",
    "bytes": "long",
    "pages": "int",
    "width": "int",
    "height": "int",
    "text": "string",
    "text_error": "string",
}
ATTACHMENT = "struct<" + ",".join(f"{k}:{v}" for k, v in ATTACHMENT_FIELDS.items()) + ">"

SPEC_KINDS = ("drawing", "model", "rfq_form", "po", "document")
#: Labels.
KIND_LABELS = {
    "drawing": "Drawing", "model": "3D model", "rfq_form": "RFQ form", "po": "Purchase order",
    "document": "Document", "upload": "Uploaded file", "name_only": "File name only",
}
DOC_TYPE_LABELS = {
    "resume": "Resume", "brochure": "Brochure", "cert": "Certificate", "invoice": "Invoice",
    "packing_slip": "Packing slip", "letter": "Letter", "spec": "Spec sheet", "report": "Report",
    "newsletter": "Newsletter",
}
EMAIL_TYPE_LABELS = {
    "new_rfq": "New RFQ", "quote_revision": "Quote revision", "purchase_order": "Purchase order",
    "order_followup": "Order follow-up", "vendor_or_solicitation": "Vendor / solicitation", "other": "Other",
}
VOLUME_LABELS = {"prototype": "Prototype", "low_volume": "Low volume", "production": "Production", "not_stated": "Qty not stated"}
#: The policy's default thresholds.
THRESHOLDS = {
    "email_type_confidence": 0.5, "process_confidence": 0.5, "export_control_restrict": 0.5,
    "itar_exempt_confidence": 0.8, "export_control_warn": 0.2, "rush_score": 2.3, "soon_score": 1.5,
    "quantity_given": 0.5, "drawings_provided": 0.5, "outside_processing": 0.6, "volume_confidence": 0.35,
}
SLA_DAYS = {"P1": 0, "P2": 2, "P3": 5}


@dataclass(frozen=True)
class Lane:
    id: str
    name: str
    owner: str
    role: str = ""
    description: str = ""


@dataclass
class Shop:
    """Everything a deployment sets: lanes, customers (domain, name, tier, account_manager), bars."""

    name: str = "The Shop"
    estimating: list[Lane] = field(
        default_factory=lambda: [
            Lane("milling_3axis", "3-Axis Milling", "Ana Estimator", "Estimator"),
            Lane("milling_5axis", "5-Axis & Complex", "Ben Estimator", "Senior Estimator"),
            Lane("turning", "Turning & Swiss", "Cem Estimator", "Estimator"),
        ]
    )
    itar: Lane = Lane("itar", "ITAR / CUI Restricted", "Dana Restricted", "Export-controlled quoting, U.S. persons only")
    orders: Lane = Lane("orders", "Orders & Customer Service", "Eli Service", "Customer Service")
    review: Lane = Lane("review", "Needs Human Review", "Fay Reviewer", "Quoting Manager")
    filtered: Lane = Lane("filtered", "Filtered: Not Customer Work", "Auto-archive", "No reply")
    customers: list[tuple[str, str, str, str]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)
    sla_days: dict[str, int] = field(default_factory=lambda: dict(SLA_DAYS))
    #: How reasons and traces name the model that answers.
    model_name: str = "Model"

    def lanes(self) -> list[tuple[Lane, str]]:
        """Each lane with its group, in display order."""
        return [*((x, "estimating") for x in self.estimating), (self.itar, "estimating"), (self.orders, "other"), (self.review, "other"), (self.filtered, "other")]

    def process_labels(self) -> dict[str, str]:
        return {x.id: x.name for x in self.estimating} | {"mixed_or_unclear": "Mixed / unclear"}

    def bars(self, live: dict[str, float] | None = None) -> dict[str, float]:
        """Defaults, then the shop's, then live ones; unknown names are left out, values clamped (0..3 for
        the two urgency scores, else 0..1)."""
        merged = {**THRESHOLDS, **self.thresholds, **(live or {})}
        return {k: max(0.0, min(3.0 if k in ("rush_score", "soon_score") else 1.0, float(v))) for k, v in merged.items() if k in THRESHOLDS}
