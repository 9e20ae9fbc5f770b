r"""Format-preserving pseudonyms for personal data, by a keyed Feistel network. Only built-in SQL functions run.

Validated numbers and dates are permuted within their own format: a payment card (Luhn digit correct) becomes another
card with a correct Luhn digit, a phone number another phone number, and so for social security numbers, IPv4
addresses and calendar dates. A value's free part is a pair (L, R) in Z_a x Z_b; ROUNDS rounds add a keyed SHA-256 of
one half to the other, modulo its size, which is a permutation for any a and b. Under one key, equal values get
equal pseudonyms in all documents and different values different ones, so links stay; invert=True undoes it for whoever
has the key. Mail names, access keys and passwords aren't numbers: they become keyed digests of their form and length,
the same for the same value.

Area and exchange codes of phone numbers are any three digits, given out or not.

What only looks alike stays: 13 to 19 digits with a wrong Luhn digit, impossible dates, octets above 255. Dates outside
1900-01-01 to 2099-12-30 stay too.

A narrow pass without shuffle; texts without a digit, an @ or the key word of a secret are passed on after one quick test. Patterns are anchored at
their left edge, so the search is linear in the text's length.

Cases: a null text stays null and an empty one empty, with no finds; very long texts are treated whole; repeated rows
each; doc_id may be null; other columns are ignored by pseudonymise() and kept by replace_column(); an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Where the session names the secret key. Without it, texts get the key of tests, which is in this file: anyone can undo it.
KEY_SETTING = "spark.spanlake.pii.key"
TEST_KEY = "spanlake-pseudonyms-1"
ROUNDS = 8
KINDS = ("email", "card", "phone", "ssn", "ip", "date", "secret")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,}",
    "secret": r"AKIA[A-Z0-9]{16}|(?:password|passwd|secret|token|api_key)\s?[=:]\s?\x22?[A-Za-z0-9]{16,64}\x22?",
    "phone": r"(?:\+1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}",
    "date": r"(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9]\.[01]?[0-9]\.(?:19|20)[0-9]{2}|[01]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2}",
    "ssn": r"[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "card": r"[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{13,19}",
}
#: A find begins where no letter, digit or +._%- stands before (a closing bracket may), and ends before no letter or digit.
ANY = r"(?<![A-Za-z0-9._%+\-])(?:" + "|".join(PATTERNS.values()) + r")(?![A-Za-z0-9]|[.\-][0-9])"


#: Every find has a digit, an @ or, if its secret is all letters, one of these.
QUICK = "[0-9@]|AKIA|password|passwd|secret|token|api_key"


def _is(kind: str) -> str:
    return f"h rlike r'^(?:{PATTERNS[kind]})$'"


def _text_of(key: str) -> str:
    return "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"


# a date find as a date, or null
_DATE = """to_date(CASE WHEN contains(h, '-') THEN try_to_timestamp(h, 'yyyy-MM-dd') WHEN contains(h, '.') THEN try_to_timestamp(h, 'd.M.yyyy') ELSE try_to_timestamp(h, 'M/d/yyyy') END)"""


def _feistel(key: str, invert: bool) -> str:
    """x: a struct (k, h, d, l, r, a, b) with the halves l, r below a, b; the result has l and r permuted."""

    def mask(i: str, half: str, size: str) -> str:
        return f"pmod(CAST(conv(substr(sha2(concat({_text_of(key)}, ':', x.k, ':', x.n, ':', {i}, ':', {half}), 256), 1, 14), 16, 10) AS BIGINT), {size})"

    sign = "-" if invert else "+"
    rounds = f"sequence({ROUNDS}, 1)" if invert else f"sequence(1, {ROUNDS})"
    step = f"""CASE WHEN i % 2 = 1 THEN named_struct('l', pmod(s.l {sign} {mask('i', 's.r', 'x.a')}, x.a), 'r', s.r)
                    ELSE named_struct('l', s.l, 'r', pmod(s.r {sign} {mask('i', 's.l', 'x.b')}, x.b)) END"""
    return f"aggregate({rounds}, named_struct('l', x.l, 'r', x.r), (s, i) -> {step})"


def _pseudonyms(text: str, key: str, invert: bool) -> str:
    """SQL for array<struct<k, h, p>>: kind, find and pseudonym of each find in order; k is '' where the find isn't valid."""
    finds = f"""transform(regexp_extract_all({text}, r'({ANY})', 1), h -> named_struct('h', h, 'd', regexp_replace(h, '[^0-9]', ''), 'k',
        CASE WHEN {_is('email')} THEN 'email' WHEN {_is('secret')} THEN 'secret' WHEN {_is('phone')} THEN 'phone'
             WHEN {_is('date')} THEN IF(datediff({_DATE}, DATE'1900-01-01') BETWEEN 0 AND 73047, 'date', '')
             WHEN {_is('ssn')} THEN IF(substr(h, 1, 3) IN ('000', '666') OR substr(h, 5, 2) = '00' OR substr(h, 8) = '0000', '', 'ssn')
             WHEN {_is('ip')} THEN 'ip' WHEN luhn_check(regexp_replace(h, '[^0-9]', '')) THEN 'card' ELSE '' END))"""
    day = f"CAST(datediff({_DATE.replace('(h', '(x.h').replace('s(h', 's(x.h').replace('p(h', 'p(x.h')}, DATE'1900-01-01') AS BIGINT)"
    octet = lambda i: f"CAST(split(x.h, '[.]')[{i}] AS BIGINT)"
    mid = "(length(x.d) - 2)"
    area = "CAST(substr(x.d, 1, 3) AS BIGINT)"
    half = f"""transform({finds}, x -> CASE x.k
        WHEN 'card' THEN named_struct('k', x.k, 'h', x.h, 'd', x.d, 'n', CAST(length(x.d) AS STRING), 'l', CAST(substr(x.d, 2, {mid} div 2) AS BIGINT), 'r', CAST(substr(x.d, 2 + {mid} div 2, {mid} - {mid} div 2) AS BIGINT), 'a', CAST(pow(10, {mid} div 2) AS BIGINT), 'b', CAST(pow(10, {mid} - {mid} div 2) AS BIGINT))
        WHEN 'phone' THEN named_struct('k', x.k, 'h', x.h, 'd', x.d, 'n', '', 'l', CAST(substr(x.d, -10, 3) AS BIGINT), 'r', CAST(substr(x.d, -7) AS BIGINT), 'a', 1000L, 'b', 10000000L)
        WHEN 'ssn' THEN named_struct('k', x.k, 'h', x.h, 'd', x.d, 'n', '', 'l', {area} - IF({area} > 666, 2, 1), 'r', (CAST(substr(x.d, 4, 2) AS BIGINT) - 1) * 9999 + CAST(substr(x.d, 6) AS BIGINT) - 1, 'a', 898L, 'b', 989901L)
        WHEN 'ip' THEN named_struct('k', x.k, 'h', x.h, 'd', x.d, 'n', '', 'l', {octet(0)} * 256 + {octet(1)}, 'r', {octet(2)} * 256 + {octet(3)}, 'a', 65536L, 'b', 65536L)
        WHEN 'date' THEN named_struct('k', x.k, 'h', x.h, 'd', x.d, 'n', '', 'l', {day} div 397, 'r', {day} % 397, 'a', 184L, 'b', 397L)
        ELSE named_struct('k', x.k, 'h', x.h, 'd', x.d, 'n', '', 'l', 0L, 'r', 0L, 'a', 1L, 'b', 1L) END)"""
    turned = f"transform({half}, x -> named_struct('k', x.k, 'h', x.h, 'd', x.d, 'f', {_feistel(key, invert)}))"
    body = "concat(substr(x.d, 1, 1), lpad(CAST(x.f.l AS STRING), (length(x.d) - 2) div 2, '0'), lpad(CAST(x.f.r AS STRING), length(x.d) - 2 - (length(x.d) - 2) div 2, '0'))"
    card = f"concat({body}, element_at(filter(array('0', '1', '2', '3', '4', '5', '6', '7', '8', '9'), c -> luhn_check(concat({body}, c))), 1))"
    grouped = f"IF(substr(x.h, 5, 1) rlike '[0-9]', {card}, concat_ws(substr(x.h, 5, 1), substr({card}, 1, 4), substr({card}, 5, 4), substr({card}, 9, 4), substr({card}, 13, 4)))"
    piece = lambda i: f"regexp_extract(x.h, r'^((?:[+]1[ .-]?)?[(]?)[0-9]{{3}}([^0-9]{{1,2}})[0-9]{{3}}([^0-9])[0-9]{{4}}$', {i})"
    phone = f"concat({piece(1)}, lpad(CAST(x.f.l AS STRING), 3, '0'), {piece(2)}, lpad(CAST(x.f.r div 10000 AS STRING), 3, '0'), {piece(3)}, lpad(CAST(x.f.r % 10000 AS STRING), 4, '0'))"
    ssn = "concat(lpad(CAST(x.f.l + IF(x.f.l + 1 >= 666, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(x.f.r div 9999 + 1 AS STRING), 2, '0'), '-', lpad(CAST(x.f.r % 9999 + 1 AS STRING), 4, '0'))"
    ip = "concat_ws('.', x.f.l div 256, x.f.l % 256, x.f.r div 256, x.f.r % 256)"
    moved = "date_add(DATE'1900-01-01', CAST(x.f.l * 397 + x.f.r AS INT))"
    # the number of digits of day and month as they were
    date = f"""CASE WHEN contains(x.h, '-') THEN date_format({moved}, 'yyyy-MM-dd') WHEN contains(x.h, '.') THEN date_format({moved}, IF(x.h rlike '^[0-9]{{2}}[.][0-9]{{2}}[.]', 'dd.MM.yyyy', 'd.M.yyyy'))
        ELSE date_format({moved}, IF(x.h rlike '^[0-9]{{2}}/[0-9]{{2}}/', 'MM/dd/yyyy', 'M/d/yyyy')) END"""
    digest = lambda v: f"sha2(concat({_text_of(key)}, ':', {v}), 256)"
    name = "substring_index(x.h, '@', 1)"
    email = f"concat(substr(translate({digest(name)}, '0123456789', 'ghijklmnop'), 1, length({name})), '@', substring_index(x.h, '@', -1))"
    value = "regexp_extract(x.h, r'([A-Za-z0-9]{16,64})\\x22?$', 1)"
    secret = f"IF(startswith(x.h, 'AKIA'), concat('AKIA', upper(substr(translate({digest('x.h')}, '0189', 'ghij'), 1, 16))), replace(x.h, {value}, substr({digest(value)}, 1, length({value}))))"
    if invert:
        email = secret = "x.h"
    return f"""transform({turned}, x -> named_struct('k', x.k, 'h', x.h, 'p', CASE x.k WHEN 'card' THEN {grouped} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {ssn}
        WHEN 'ip' THEN {ip} WHEN 'date' THEN {date} WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} ELSE x.h END))"""


def finds(text: str = "text", key: str = TEST_KEY, invert: bool = False) -> Column:
    """The finds of a text column: array of (k: kind, '' if not valid; h: the find; p: its pseudonym)."""
    none = "CAST(array() AS ARRAY<STRUCT<k: STRING, h: STRING, p: STRING>>)"
    return F.expr(f"CASE WHEN {text} rlike '{QUICK}' THEN {_pseudonyms(text, key, invert)} ELSE {none} END")


def rebuilt(text: str, found: str) -> Column:
    """The text with each find replaced by its pseudonym."""
    return F.expr(f"CASE WHEN size({found}) > 0 THEN array_join(flatten(zip_with(split({text}, r'{ANY}', -1), transform({found}, x -> x.p), (g, p) -> array(g, coalesce(p, '')))), '') ELSE {text} END")


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None) or TEST_KEY


def pseudonymise(docs: DataFrame, key: str | None = None, invert: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of finds of each kind. The key is the session's if none is given."""
    key = key or session_key(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("found", finds("text", key, invert))
    return d.select("doc_id", rebuilt("text", "found").alias("text"), *[F.expr(f"CAST(size(filter(found, x -> x.k = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS])


def replace_column(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The same rows and columns, with pseudonyms in text, and n_chars in step with it. The key is the session's if none is given."""
    key = key or session_key(docs.sparkSession)
    d = docs.withColumn("__found", finds("text", key)).withColumn("text", rebuilt("text", "__found"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.size("__found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.drop("__found")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir))
