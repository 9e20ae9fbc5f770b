"""Label taxonomies as small lookup tables, and functions over label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories of the i2b2 2014 scheme with their subtypes.
CATEGORIES = {
    "NAME": ("PATIENT", "DOCTOR", "USERNAME"),
    "PROFESSION": ("PROFESSION",),
    "LOCATION": ("HOSPITAL", "ORGANIZATION", "STREET", "CITY", "STATE", "COUNTRY", "ZIP", "LOCATION-OTHER"),
    "AGE": ("AGE",),
    "DATE": ("DATE",),
    "CONTACT": ("PHONE", "FAX", "EMAIL", "URL", "IPADDR"),
    "ID": ("SSN", "MEDICALRECORD", "HEALTHPLAN", "ACCOUNT", "LICENSE", "VEHICLE", "DEVICE", "BIOID", "IDNUM"),
}
# Subtypes outside the HIPAA view.
NOT_HIPAA = ("DOCTOR", "PROFESSION", "HOSPITAL", "ORGANIZATION", "STATE", "COUNTRY")
# The privacy filter's label of each subtype; none where it has no such label.
OPF_OF = {
    "PATIENT": "private_person",
    "DOCTOR": "private_person",
    "USERNAME": None,
    "PROFESSION": None,
    "HOSPITAL": None,
    "ORGANIZATION": None,
    "STREET": "private_address",
    "CITY": "private_address",
    "STATE": "private_address",
    "COUNTRY": None,
    "ZIP": "private_address",
    "LOCATION-OTHER": "private_address",
    "AGE": None,
    "DATE": "private_date",
    "PHONE": "private_phone",
    "FAX": "private_phone",
    "EMAIL": "private_email",
    "URL": "private_url",
    "IPADDR": None,
    "SSN": "account_number",
    "MEDICALRECORD": "account_number",
    "HEALTHPLAN": "account_number",
    "ACCOUNT": "account_number",
    "LICENSE": "account_number",
    "VEHICLE": "account_number",
    "DEVICE": "account_number",
    "BIOID": None,
    "IDNUM": "account_number",
}
# The category of each of the privacy filter's labels.
OPF_CATEGORY = {"private_person": "NAME", "private_date": "DATE", "private_address": "LOCATION", "private_phone": "CONTACT", "private_email": "CONTACT", "private_url": "CONTACT", "account_number": "ID", "secret": None}
# The subtype of each normalised label of the open PII model; none where it is no PHI here.
OPENMED = {
    "accountnumber": "ACCOUNT",
    "age": "AGE",
    "apikey": None,
    "bankroutingnumber": "IDNUM",
    "biometricidentifier": "BIOID",
    "bloodtype": None,
    "certificatelicensenumber": "LICENSE",
    "city": "CITY",
    "companyname": "ORGANIZATION",
    "coordinate": "LOCATION-OTHER",
    "country": "COUNTRY",
    "county": "LOCATION-OTHER",
    "creditcard": "ACCOUNT",
    "creditdebitcard": "ACCOUNT",
    "cvv": None,
    "date": "DATE",
    "dateofbirth": "DATE",
    "datetime": "DATE",
    "deviceidentifier": "DEVICE",
    "educationlevel": None,
    "email": "EMAIL",
    "employeeid": "IDNUM",
    "faxnumber": "FAX",
    "firstname": "PATIENT",
    "gender": None,
    "healthplanbeneficiarynumber": "HEALTHPLAN",
    "hospital": "HOSPITAL",
    "ipaddress": "IPADDR",
    "ipv4": "IPADDR",
    "ipv6": "IPADDR",
    "language": None,
    "lastname": "PATIENT",
    "licensenumber": "LICENSE",
    "macaddress": "DEVICE",
    "maritalstatus": None,
    "medicalrecordnumber": "MEDICALRECORD",
    "name": "PATIENT",
    "nationality": None,
    "occupation": "PROFESSION",
    "organization": "ORGANIZATION",
    "passportnumber": "IDNUM",
    "phonenumber": "PHONE",
    "pin": None,
    "raceethnicity": None,
    "religion": None,
    "sexuality": None,
    "ssn": "SSN",
    "state": "STATE",
    "streetaddress": "STREET",
    "swiftcode": "IDNUM",
    "time": None,
    "url": "URL",
    "vin": "VEHICLE",
}

SUBTYPES = tuple(s for group in CATEGORIES.values() for s in group)
CATEGORY_OF = {s: c for c, group in CATEGORIES.items() for s in group}
HIPAA = tuple(s for s in SUBTYPES if s not in NOT_HIPAA)
UNSUPPORTED = tuple(s for s in SUBTYPES if OPF_OF[s] is None)
LEVELS = ("subtype", "category", "binary")
BUCKETS = ("0", "1-10", "11-50", "51-200", ">200")
TABLES = {"opf": OPF_OF, "opf_category": OPF_CATEGORY, "openmed": OPENMED}


def literal_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast("string"))])


def strip_prefix(tag: Column) -> Column:
    return F.regexp_replace(tag, r"(?i)^[BIESLU]-", "")


def normalised(label: Column, strip: bool = True) -> Column:
    return F.regexp_replace(F.lower(strip_prefix(label) if strip else label), "[^a-z0-9]", "")


def map_label(label: Column, table: dict, strict: bool = False) -> Column:
    """The table's value for the label itself, else for its normalised form without prefix, else with it; null if none (an error if strict)."""
    m = literal_map(table)
    out = F.lit(None).cast("string") if not strict else F.raise_error(F.concat(F.lit("unknown label "), label)).cast("string")
    for key in (normalised(label, False), normalised(label), label):
        out = F.when(F.map_contains_key(m, key), m[key]).otherwise(out)
    return out


def relabel(label: Column, level: str) -> Column:
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    return label if level == "subtype" else F.coalesce(literal_map(CATEGORY_OF)[label], label) if level == "category" else F.lit("PHI")


def frequency_bucket(n: Column) -> Column:
    return F.when(n < 0, F.raise_error(F.lit("negative count")).cast("string")).when(n == 0, "0").when(n <= 10, "1-10").when(n <= 50, "11-50").when(n <= 200, "51-200").otherwise(">200")


def bioes_tags(labels) -> list[str]:
    return ["O", *[f"{p}-{x}" for x in labels for p in "BIES"]]


def infer_table(labels) -> str | None:
    """Which table a model's labels need: none, "opf_category" or "openmed"; an error where that isn't clear."""
    import re

    names = {re.sub(r"(?i)^[BIESLU]-", "", x) for x in labels if x != "O"}
    if not names:
        raise ValueError("no entity labels")
    if names <= {*SUBTYPES, *CATEGORIES, "INSTITUTIONAL", "PHI"}:
        return None
    if names <= set(OPF_CATEGORY):
        return "opf_category"
    known = sum(re.sub("[^a-z0-9]", "", x.lower()) in OPENMED for x in names)
    if 2 * known >= len(names):
        return "openmed"
    raise ValueError(f"no table for the labels {sorted(names)}")


def is_hipaa(label: Column, surface: Column) -> Column:
    """In the HIPAA view: AGE from 90, DATE with more than a year, else by subtype."""
    age = F.regexp_extract(surface, r"[0-9]{1,3}", 0)
    year = surface.rlike(r"^[^\p{L}\p{N}_]*(1[89]|20)[0-9]{2}[^\p{L}\p{N}_]*$")
    return F.when(label == "AGE", (age != "") & (age.try_cast("int") >= 90)).when((label == "DATE") & year, False).otherwise(label.isin(*HIPAA))
