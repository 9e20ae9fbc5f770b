"""Reading and writing documents with spans."""

import hashlib
import json

import pytest

from spanlake.sources import records

XML = "<deIdi2b2><TEXT><![CDATA[Ann & Bo, 3/4/2019]]></TEXT><TAGS>{}</TAGS></deIdi2b2>"
TAG = '<NAME id="P0" start="{}" end="{}" text="{}" TYPE="PATIENT" comment=""/><MEDS start="0" end="1"/>'


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(TAG.format(0, 3, "Ann")))
    (tmp_path / "b.xml").write_text(XML.format(TAG.format(6, 8, "Bob")))
    rows = {r.doc_id: r for r in records.read_xml(spark, str(tmp_path), False).collect()}
    assert [(s.start, s.end, s.label, s.text) for s in rows["a"].spans] == [(0, 3, "PATIENT", "Ann")] and rows["a"].mismatches == 0
    assert rows["b"].spans[0].text == "Bo" and rows["b"].mismatches == 1 and rows["b"].text == "Ann & Bo, 3/4/2019"
    with pytest.raises(Exception, match="isn't at"):
        records.read_xml(spark, str(tmp_path)).collect()


def test_notes(spark, tmp_path):
    text = 'A "quoted" note,\nwith two lines. ' * 10
    (tmp_path / "n.csv").write_text('id,transcription\n1,short\n2,\n3,"  ' + text.replace('"', '""') + '"\n')
    got = records.read_notes(spark, f"{tmp_path}/n.csv").collect()
    sha = hashlib.sha1(text.strip().encode()).hexdigest()[:8]
    assert [(r.doc_id, r.text) for r in got] == [(f"mts-00002-{sha}", text.strip())]


def test_jsonl_and_opf(spark, tmp_path):
    span = {"start": 0, "end": 3, "label": "PATIENT", "text": "Ann", "source": "gold", "score": None}
    lines = [{"doc_id": "a", "text": "Ann: Ann", "spans": [span, span | {"start": 5, "end": 8}, span | {"label": "AGE"}]}, {"doc_id": "b", "text": ""}]
    (tmp_path / "in.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    docs = records.read_jsonl(spark, f"{tmp_path}/in.jsonl")
    assert {r.doc_id: len(r.spans) for r in docs.collect()} == {"a": 3, "b": 0}
    records.write_jsonl(docs, f"{tmp_path}/out")
    assert sorted(map(repr, records.read_jsonl(spark, f"{tmp_path}/out").collect())) == sorted(map(repr, docs.collect()))
    opf = records.to_opf(docs)
    assert {r.doc_id: r.spans for r in opf.collect()}["a"] == {"private_person: Ann": [[0, 3], [5, 8]]}
    back = records.from_opf(opf).select("doc_id", "start", "end", "label", "text").collect()
    assert sorted(map(tuple, back)) == [("a", 0, 3, "private_person", "Ann"), ("a", 5, 8, "private_person", "Ann")]
    assert records.invalid(docs).count() == 0
    broken = spark.createDataFrame([("c", "ab", [(0, 3, "X", "", "", None), (1, 1, "X", "", "", None), (0, 1, "", "", "", None), (0, 1, "X", "b", "", None), (0, 1, "X", "a", "", None)])], f"doc_id string, text string, spans array<{records.SPAN}>")
    assert records.invalid(broken).count() == 4
