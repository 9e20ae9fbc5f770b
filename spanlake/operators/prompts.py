"""Prompts for language models that find, correct or judge mentions, as columns of messages.

A message list is array<struct<role, content>>. Instructions are the same for all rows of a call and are built once; texts stay
in the engine. The wording is this library's own: pass a guideline to replace it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES, SUBTYPES
from ..functions.outputs import render_segments, segments
from .spans import render_tagged

# The formats an answer can have.
FORMATS = ("json_strings", "json_anchored", "inline_tags", "segments")

MEANINGS = {
    "PATIENT": "names of the patient or of relatives", "DOCTOR": "names of clinicians", "USERNAME": "log-in names", "PROFESSION": "what the patient works as", "HOSPITAL": "clinics and hospitals", "ORGANIZATION": "employers and other bodies",
    "STREET": "street and number", "CITY": "towns", "STATE": "federal states", "COUNTRY": "countries", "ZIP": "postal codes", "LOCATION-OTHER": "buildings, sights, other places", "AGE": "ages", "DATE": "dates, also parts of one, but no durations",
    "PHONE": "telephone numbers", "FAX": "fax numbers", "EMAIL": "mail addresses", "URL": "web addresses", "IPADDR": "network addresses", "SSN": "social security numbers", "MEDICALRECORD": "chart numbers", "HEALTHPLAN": "insurance numbers",
    "ACCOUNT": "account numbers", "LICENSE": "licence numbers", "VEHICLE": "vehicle numbers and plates", "DEVICE": "device serials", "BIOID": "biometric marks", "IDNUM": "any other number that points to a person",
}
GUIDELINE = "Mark whatever identifies a person in the clinical note below, under these labels:\n" + "\n".join(f"{c}: " + "; ".join(f"{s} ({MEANINGS[s]})" for s in group) for c, group in CATEGORIES.items()) + (
    "\nMark each place a mention stands at, repeats, headers and signatures included, and quote it letter by letter."
    " Words for a role (the patient, the nurse), drugs, diseases and units are no identifiers."
)
_TAGS = 'Put each mention between <PHI type="LABEL"> and </PHI> and change nothing else: no word added, dropped, moved or corrected, no fences.'
INSTRUCTIONS = {
    "json_strings": 'Answer with one JSON object and nothing else: {"spans": [{"text": "...", "label": "LABEL"}, ...]}. One item per different mention; it counts for all its places.',
    "json_anchored": 'Answer with one JSON object and nothing else: {"spans": [{"text": "...", "label": "LABEL", "before": "..."}, ...]}. One item per place, in the order of the text; before holds the one to four words that stand right before it.',
    "inline_tags": "Answer with the whole text. " + _TAGS,
    "segments": "The text comes as segments, each with its number in square brackets. Answer with the same segments, one a line, each after its number. " + _TAGS,
}
EDITOR = "The text was pre-tagged by a program. Correct it: tag what was missed, untag what is no identifier, mend labels and edges."
FOCUS = "The program knows no such labels, so look for them closely: "
VERIFIER = 'Does the candidate identify a person, as the guideline has it? Answer with one JSON object and nothing else: {"is_phi": true or false, "label": "LABEL" or null}.'


def load_guideline(path: str | None = None, text: str | None = None) -> str:
    """The text if given, else the file's, else the library's own."""
    return text if text is not None else Path(path).read_text(encoding="utf-8") if path is not None else GUIDELINE


def system_text(form: str, labels=SUBTYPES, guideline: str | None = None) -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}; there are {', '.join(FORMATS)}")
    return f"{load_guideline(text=guideline)}\n\nLabels: {', '.join(labels)}.\n{INSTRUCTIONS[form]}"


def editor_text(labels=SUBTYPES, guideline: str | None = None, focus=()) -> str:
    head, last = load_guideline(text=guideline), f"\n{FOCUS}{', '.join(focus)}" if focus else ""
    return f"{head}\n\n{EDITOR}\nLabels: {', '.join(labels)}.\n{INSTRUCTIONS['inline_tags']}{last}"


def verifier_text(guideline: str | None = None) -> str:
    return f"{load_guideline(text=guideline)}\n\n{VERIFIER}"


def messages(system: str, user: Column) -> Column:
    """A null text is asked about as an empty one."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(one("system", F.lit(system)), one("user", F.coalesce(user, F.lit(""))))


def extraction(docs: DataFrame, form: str, labels=SUBTYPES, guideline: str | None = None, longest: int = 1500) -> DataFrame:
    """(doc_id, messages): one prompt a document; docs has one row an id."""
    system = system_text(form, labels, guideline)
    if form == "segments":
        docs = docs.select("doc_id").join(render_segments(segments(docs, longest)), "doc_id", "left")
    return docs.select("doc_id", messages(system, F.col("text")).alias("messages"))


def editor(docs: DataFrame, spans: DataFrame, labels=SUBTYPES, guideline: str | None = None, focus=()) -> DataFrame:
    """(doc_id, messages): the document with a detector's spans as tags, to be corrected."""
    return render_tagged(docs, spans).select("doc_id", messages(editor_text(labels, guideline, focus), F.col("text")).alias("messages"))


def verifier_asked(docs: DataFrame, spans: DataFrame, context: int = 200) -> DataFrame:
    """(doc_id, start, end, label, user): what a verifier is asked about each span, with up to `context` characters on both sides."""
    d = spans.select("doc_id", "start", "end", "label").join(docs.select("doc_id", "text"), "doc_id")
    begin = F.greatest(F.lit(0), F.col("start") - context)
    cut = lambda a, n: F.substring(F.col("text"), a + 1, n)
    mention = cut(F.col("start"), F.col("end") - F.col("start"))
    left, right = cut(begin, F.col("start") - begin), cut(F.col("end"), F.lit(context))
    user = F.concat(F.lit("Text around it: ..."), left, F.lit("[["), mention, F.lit("]]"), right, F.lit('...\nCandidate: "'), mention, F.lit('", label '), F.col("label"))
    return d.select("doc_id", "start", "end", "label", user.alias("user"))


def verifier(docs: DataFrame, spans: DataFrame, guideline: str | None = None, context: int = 200) -> DataFrame:
    """(doc_id, start, end, label, messages): each span with up to `context` characters on both sides, to be judged."""
    return verifier_asked(docs, spans, context).select("doc_id", "start", "end", "label", messages(verifier_text(guideline), F.col("user")).alias("messages"))


#: What JSON writes for the characters it may not hold as they are.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
RARE = {"\b": "\\b", "\f": "\\f"} | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in "\n\t\r\b\f"}


def json_string(text: Column) -> Column:
    """A JSON string, letters outside ASCII as they are."""

    def replaced(c: Column, table: dict) -> Column:
        for char, escape in table.items():
            c = F.replace(c, F.lit(char), F.lit(escape))
        return c

    common = replaced(text, ESCAPES)
    whole = F.when(text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), replaced(common, RARE)).otherwise(common)
    return F.concat(F.lit('"'), whole, F.lit('"'))


def messages_json(column: Column) -> Column:
    """The list as JSON: keys in order, ", " and ": " between."""
    each = lambda m: F.concat(F.lit('{"content": '), json_string(m["content"]), F.lit(', "role": '), json_string(m["role"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(column, each), ", "), F.lit("]"))


def prompt_hash(column: Column) -> Column:
    """The first 16 digits of the SHA-256 of the list's JSON."""
    return F.substring(F.sha2(messages_json(column), 256), 1, 16)


def hash_of(system: str, user: Column) -> Column:
    """prompt_hash(messages(system, user)); the system's part of the JSON is written once, not for every row."""
    head = '[{"content": ' + json.dumps(system, ensure_ascii=False) + ', "role": "system"}, {"content": '
    return F.substring(F.sha2(F.concat(F.lit(head), json_string(F.coalesce(user, F.lit(""))), F.lit(', "role": "user"}]')), 256), 1, 16)
