"""Attachments: one typed struct for every kind, their text, and the text budget of a message."""

from __future__ import annotations

from pyspark.sql import Column

from ..functions import lazy as F

from ..functions import geometry, text as tx
from ..functions.text import blank, clean
from ..schemas import ATTACHMENT_FIELDS, DOC_TYPE_LABELS, KIND_LABELS, SPEC_KINDS

PER_FILE, TOTAL, LEAST = 1800, 6000, 200
#: Endings of CAD files, and words that say a PDF is not a drawing.
CAD_ENDINGS = (
    ".step", ".stp", ".igs", ".iges", ".sldprt", ".sldasm", ".x_t", ".x_b",
    ".dxf", ".dwg", ".prt", ".ipt", ".iam", ".stl", ".3mf", ".par", ".catpart",
)
NOT_A_DRAWING = r"(?i)(^|[^a-z])(po|purchase|invoice|cert|certs|coc|resume|cv|brochure|catalog|quote_form|rfq|form|linecard|newsletter|packing|slip|statement|remit|ncr|rma|terms)([^a-z]|$)"
#: Fixed value: wording that marks controlled data.
EXPORT_MARKINGS = r"(?i)\b(itar|arms export control|export administration regulations|eccn|cui|controlled unclassified|dfars 252\.204-7012|u\.s\. persons only)\b"
MARKED_FROM_NAME_ONLY = "(attached to the email; only the file name is available, not its contents)"
NO_TEXT = "(PDF file with no text layer, for example a scan; there is no text to read)"


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def normalise(attachments: Column) -> Column:
    """array<variant> of bare names and objects to array<struct>: names cleaned and cut at 120
    characters, a missing kind is name_only, a bare string is a name. Null is an empty array."""

    def one(v: Column) -> Column:
        is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        bare = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
        fields = []
        for name, kind in ATTACHMENT_FIELDS.items():
            if name == "name":
                given = F.coalesce(F.nullif(_field(v, "name", "string"), F.lit("")), F.lit("attachment"))
                c = F.substring(clean(F.when(is_object, given).otherwise(bare)), 1, 120)
            elif name == "kind":
                c = F.when(is_object, F.coalesce(_field(v, "kind", "string"), F.lit("name_only"))).otherwise(F.lit("name_only"))
            elif name in ("rfq_lines", "po_lines"):
                c = F.when(_field(v, "kind", "string") == name.split("_")[0].replace("rfq", "rfq_form"), _field(v, "lines", kind))
            elif name == "bytes":
                c = F.when(_field(v, "kind", "string") == "upload", _field(v, "size", kind))
            else:
                c = F.when(is_object, _field(v, name, kind))
            fields.append(c.alias(name))
        return F.struct(*fields)

    return F.filter(F.transform(F.coalesce(attachments, F.array().cast("array<variant>")), one), lambda a: a.isNotNull())


def media(a: Column) -> Column:
    k = a["kind"]
    return F.when(k.isin("drawing", "rfq_form", "po", "document"), F.lit("pdf")).when(k == "model", F.lit("step")).when(k == "upload", a["media"])


def is_cad(name: Column, kind: Column, upload_media: Column) -> Column:
    """Drawings and models by kind; plain names and uploaded PDFs by their ending and words."""
    end, low = tx.extension(name), tx.strip(F.lower(name))
    by_name = end.isin(*CAD_ENDINGS) | ((end == ".pdf") & ~F.regexp_like(low, F.lit(NOT_A_DRAWING)))
    return F.coalesce(
        F.when(kind.isin("drawing", "model"), F.lit(True)).when(kind.isin("rfq_form", "po", "document"), F.lit(False)).when((kind == "upload") & ~F.coalesce(upload_media == "pdf", F.lit(False)), F.lit(False)).otherwise(by_name),
        F.lit(False),
    )


def cad_names(attachments: Column) -> Column:
    return F.transform(F.filter(attachments, lambda a: is_cad(a["name"], a["kind"], a["media"])), lambda a: a["name"])


def marked_names(attachments: Column) -> Column:
    """Names of attachments whose own text (before the budget) carries an export marking."""
    return F.transform(F.filter(attachments, lambda a: F.regexp_like(full_text(a), F.lit(EXPORT_MARKINGS))), lambda a: a["name"])


def _has(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _if(c: Column, *parts: str | Column) -> Column:
    """The parts, where c is there; else nothing."""
    return F.when(_has(c), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(F.lit(""))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), clean(x))), " ")


def _or(c: Column, default: str | Column) -> Column:
    return clean(F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default))


def legend_text(kind: Column, company: Column, eccn: Column, contact: Column) -> Column:
    """The legend of a file by its kind. The legends' wording."""
    owner = F.coalesce(F.nullif(F.upper(clean(company)), F.lit("")), F.lit("THE OWNER"))
    code = F.coalesce(F.nullif(F.upper(clean(eccn)), F.lit("")), F.lit("9E610"))
    who = F.upper(clean(contact))
    return (
        F.when(
            kind == "itar",
            F.lit(
                "WARNING: THIS DOCUMENT CONTAINS TECHNICAL DATA WHOSE EXPORT IS RESTRICTED BY THE ARMS EXPORT CONTROL ACT (TITLE 22, U.S.C., SEC 2751, ET SEQ.) AND THE INTERNATIONAL TRAFFIC IN ARMS REGULATIONS (ITAR, 22 CFR 120-130). EXPORT, OR RELEASE TO A FOREIGN PERSON, WITHOUT AN APPROVED LICENSE OR EXEMPTION IS A VIOLATION OF U.S. LAW. U.S. PERSONS ONLY."
            ),
        )
        .when(
            kind == "ear",
            _say(
                "WARNING: THIS DOCUMENT CONTAINS TECHNOLOGY SUBJECT TO THE EXPORT ADMINISTRATION REGULATIONS (EAR, 15 CFR 730-774), ECCN ",
                code,
                ". EXPORT, REEXPORT, OR RELEASE TO A FOREIGN PERSON WITHOUT AUTHORIZATION FROM THE U.S. DEPARTMENT OF COMMERCE IS PROHIBITED.",
            ),
        )
        .when(
            kind == "cui",
            _say(
                "CUI. CONTROLLED BY: ",
                owner,
                ". CUI CATEGORY: CTI (CONTROLLED TECHNICAL INFORMATION). DISTRIBUTION STATEMENT D: DISTRIBUTION AUTHORIZED TO THE DEPARTMENT OF DEFENSE AND U.S. DOD CONTRACTORS ONLY. HANDLE PER DFARS 252.204-7012 AND NIST SP 800-171.",
                _if(who, " POC: ", who, "."),
            ),
        )
        .when(
            kind == "proprietary",
            _say("PROPRIETARY AND CONFIDENTIAL. THE INFORMATION IN THIS DOCUMENT IS THE PROPERTY OF ", owner, ". DO NOT REPRODUCE IT OR USE IT FOR ANY PURPOSE OTHER THAN QUOTING OR MAKING PARTS FOR ", owner, " WITHOUT WRITTEN PERMISSION."),
        )
        .otherwise(F.lit(""))
    )


def _legend(a: Column) -> Column:
    return legend_text(a["legend"], a["company"], a["eccn"], F.coalesce(F.nullif(a["drawn_by"], F.lit("")), a["buyer"]))


# Fixed values in the five texts that follow: the templates' wording, which is what the model reads.


def drawing_text(a: Column) -> Column:
    revisions = F.array_join(F.transform(a["revisions"], lambda r: tx.strip(_say(clean(r["rev"]), " ", clean(r["description"]), " ", clean(r["date"])))), "; ")
    features = F.array_join(F.transform(a["callouts"], clean), "; ")
    return tx.join_lines(
        [
            F.lit("ENGINEERING DRAWING (PDF)"),
            _say(
                "TITLE BLOCK: ", clean(a["company"]), ". TITLE: ", clean(a["title"]), ". DWG NO: ", clean(a["part_number"]), " REV ", clean(a["rev"]),
                ". SCALE ", _or(a["scale"], "1:1"), ". SHEET ", _or(a["sheet"], "1 OF 1"), ".", _if(a["drawn_by"], " DRAWN: ", clean(a["drawn_by"]), " ", clean(a["date"]), "."),
            ),
            _say("MATERIAL: ", clean(a["material"])),
            _say("FINISH: ", _or(a["finish"], "NONE")),
            _say("UNLESS OTHERWISE SPECIFIED: DIMENSIONS IN ", F.when(a["units"] == "mm", F.lit("MILLIMETERS")).otherwise(F.lit("INCHES")), ". TOLERANCES: ", _or(a["tolerances"], geometry.default_tolerances(a["units"]))),
            _say("OVERALL SIZE: ", geometry.size_phrase(a["size"], a["shape"], a["units"])),
            _if(features, "FEATURES: ", features),
            _if(_numbered(a["notes"]), "NOTES: ", _numbered(a["notes"])),
            _if(revisions, "REVISIONS: ", revisions),
            _legend(a),
        ]
    )


def model_text(a: Column) -> Column:
    return tx.join_lines(
        [
            _say("3D CAD MODEL (STEP ", _or(a["schema"], "AP214"), ")"),
            _say("PART: ", clean(a["part_number"]), " REV ", _or(a["rev"], "-"), _if(a["title"], ", ", clean(a["title"]))),
            _say("UNITS: ", F.when(a["units"] == "mm", F.lit("MILLIMETER")).otherwise(F.lit("INCH")), ". BOUNDING BOX: ", geometry.bbox_phrase(a["size"], a["shape"], a["units"]), "."),
            _if(a["originating_system"], "ORIGINATING SYSTEM: ", clean(a["originating_system"]), "."),
            _legend(a),
        ]
    )


def rfq_form_text(a: Column) -> Column:
    def line(x: Column, i: Column) -> Column:
        return _say(
            "LINE ", (i + 1).cast("string"), ": P/N ", clean(x["part_number"]), _if(x["rev"], " REV ", clean(x["rev"])), ", ", clean(x["description"]),
            _if(x["material"], ", MATERIAL ", clean(x["material"])), _if(x["finish"], ", FINISH ", clean(x["finish"])),
            ", QUANTITIES ", tx.quantity_list(x["quantities"]), _if(x["notes"], ", ", clean(x["notes"])), ".",
        )

    return tx.join_lines(
        [
            _say("REQUEST FOR QUOTATION ", clean(a["rfq_number"]), " FROM ", clean(a["company"])),
            _say("DATE: ", clean(a["date"]), ". RESPOND BY: ", clean(a["respond_by"]), ". BUYER: ", clean(a["buyer"]), _if(a["buyer_email"], " (", clean(a["buyer_email"]), ")"), "."),
            F.array_join(F.transform(a["rfq_lines"], line), "\n"),
            _if(_numbered(a["requirements"]), "REQUIREMENTS: ", _numbered(a["requirements"])),
            _if(a["terms"], "TERMS: ", clean(a["terms"])),
            _legend(a),
        ]
    )


def po_total(lines: Column) -> Column:
    """The sum of quantity times price, in the lines' order."""
    return F.coalesce(F.aggregate(lines, F.lit(0.0), lambda s, x: s + tx.number(x["qty"]) * tx.number(x["unit_price"])), F.lit(0.0))


def po_text(a: Column) -> Column:
    def line(x: Column, i: Column) -> Column:
        return _say(
            "LINE ", (i + 1).cast("string"), ": P/N ", clean(x["part_number"]), _if(x["rev"], " REV ", clean(x["rev"])), ", ", clean(x["description"]),
            ", QTY ", F.format_number(tx.number(x["qty"]), 0), " AT $", F.format_number(tx.number(x["unit_price"]), 2), " EACH, DUE ", clean(x["due"]), ".",
        )

    return tx.join_lines(
        [
            _say("PURCHASE ORDER ", clean(a["po_number"]), " FROM ", clean(a["company"])),
            _say(
                "DATE: ", clean(a["date"]), ". BUYER: ", clean(a["buyer"]), ".", _if(a["quote_ref"], " QUOTE REF: ", clean(a["quote_ref"]), "."),
                _if(a["terms"], " TERMS: ", clean(a["terms"]), "."), _if(a["ship_via"], " SHIP VIA: ", clean(a["ship_via"]), "."),
            ),
            F.array_join(F.transform(a["po_lines"], line), "\n"),
            _say("ORDER TOTAL: $", F.format_number(po_total(a["po_lines"]), 2)),
            _if(_numbered(a["notes"]), "NOTES: ", _numbered(a["notes"])),
            _legend(a),
        ]
    )


def document_text(a: Column) -> Column:
    section = lambda s: _say(clean(s["heading"]), ": ", F.array_join(F.coalesce(F.transform(s["lines"], clean), F.array()), " "))
    kind = F.when(a["doc_type"].isin(*DOC_TYPE_LABELS), F.upper(tx.label_of(a["doc_type"], DOC_TYPE_LABELS))).otherwise(F.lit("DOCUMENT"))
    return tx.join_lines([_say(kind, ": ", clean(a["title"])), clean(a["subtitle"]), F.array_join(F.filter(F.transform(a["sections"], section), lambda s: F.trim(s) != ""), "\n"), _legend(a)])


def full_text(a: Column) -> Column:
    """What a reader of the file would read, before the budget."""
    size = F.when(F.coalesce(a["width"], F.lit(0)) * F.coalesce(a["height"], F.lit(0)) > 0, _say(", ", a["width"].cast("string"), " x ", a["height"].cast("string"), " px")).otherwise(F.lit(""))
    image = _say("(image file", size, "; there is no text to read)")
    own = tx.strip(blank(a["text"]))
    upload = F.when(F.coalesce(a["media"].isin("png", "jpg"), F.lit(False)), image).when(own != "", own).when(_has(a["text_error"]), _say("(PDF file; its text could not be read: ", a["text_error"], ")")).otherwise(F.lit(NO_TEXT))
    k = a["kind"]
    return (
        F.when(k == "drawing", drawing_text(a))
        .when(k == "model", model_text(a))
        .when(k == "rfq_form", rfq_form_text(a))
        .when(k == "po", po_text(a))
        .when(k == "document", document_text(a))
        .when(k == "upload", upload)
        .otherwise(F.lit(MARKED_FROM_NAME_ONLY))
    )


def within_budget(texts: Column, per_file: int = PER_FILE, total: int = TOTAL, least: int = LEAST) -> Column:
    """Each text cut at what is left of the budget when its turn comes (never below `least`); the mark
    counts too. The limit of one depends on those before it, so this is a fold, not a prefix sum."""
    start = F.struct(F.lit(total).cast("int").alias("left"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        cut = tx.shorten(t, F.least(F.lit(per_file), F.greatest(F.lit(least), acc["left"])))
        return F.struct((acc["left"] - F.length(cut)).cast("int").alias("left"), F.array_append(acc["out"], cut).alias("out"))

    return F.aggregate(texts, start, step, lambda acc: acc["out"])


def entries(attachments: Column) -> Column:
    """(file, content) of each attachment, squeezed and within the budget."""
    texts = within_budget(F.transform(attachments, lambda a: tx.squeeze(full_text(a))))
    return F.transform(attachments, lambda a, i: F.struct(a["name"].alias("file"), F.get(texts, i).alias("content")))


def state(from_name: Column, from_email: Column, subject: Column, body: Column, attachments: Column) -> Column:
    """What the model is asked about: sender, subject, body (8,000 characters), attachments or `none`."""
    sender = tx.strip(_say(tx.strip(blank(from_name)), " <", tx.strip(blank(from_email)), ">"))
    listed = F.when(F.size(attachments) > 0, F.to_json(entries(attachments))).otherwise(F.lit("none"))
    return F.struct(sender.alias("from"), tx.strip(blank(subject)).alias("subject"), tx.shorten(tx.strip(blank(body)), 8000, rstrip=False).alias("body"), listed.alias("attachments"))


def describe(a: Column, base_url: Column, available: Column) -> Column:
    """What a client gets to show: labels, links with a content hash, and a preview of 700 characters."""
    kind = F.coalesce(a["kind"], F.lit("name_only"))
    tag = F.substring(F.sha1(F.to_json(a)), 1, 10)
    there = available & (kind.isin(*SPEC_KINDS) | (kind == "upload"))
    link = lambda what: F.when(there, _say(base_url, "/", what, "?v=", tag))
    text = full_text(a)
    return F.struct(
        a["name"].alias("name"), kind.alias("kind"), tx.label_of(kind, KIND_LABELS).alias("label"), media(a).alias("media"), there.alias("available"),
        link("file").alias("url"), F.when(kind.isin(*SPEC_KINDS), link("thumb.svg")).alias("thumb"), F.when(kind == "model", link("mesh.json")).alias("mesh"),
        F.substring(text, 1, 700).alias("preview"), (F.length(text) > 700).alias("more"),
    )
