"""Record dumps in XML, as repositories write them."""

import pytest

from corpusmill.runtime import scratch_path
from corpusmill.sources import records

DUMP = """<?xml version="1.0" encoding="UTF-8"?>
<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>
<record>
  <header><identifier>oai:x:1</identifier><datestamp>2020-01-05T00:00:00Z</datestamp>
    <setSpec>com_1</setSpec><setSpec>col_2</setSpec></header>
  <metadata><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">
    <dc:title xml:lang="id">Judul &amp; Isi</dc:title><dc:title>Second title</dc:title>
    <dc:creator>A, B</dc:creator><dc:creator>C, D</dc:creator>
    <dc:subject>law</dc:subject><dc:subject>tax</dc:subject>
    <dc:description>First
line</dc:description><dc:description>Other</dc:description>
    <dc:date>2015</dc:date><dc:date>2016-01-01</dc:date><dc:type>Thesis</dc:type>
    <dc:language>id</dc:language></oai_dc:dc></metadata>
</record>
<record>
  <header status="deleted"><identifier>oai:x:2</identifier><datestamp>2020-02-01T00:00:00Z</datestamp><setSpec>com_1</setSpec></header>
</record>
<record>
  <header><identifier>oai:x:3</identifier><datestamp>2020-03-01</datestamp><setSpec>com_1</setSpec></header>
  <metadata><oai_dc:dc><dc:title>T1</dc:title></oai_dc:dc></metadata>
</record>
</ListRecords></OAI-PMH>
"""


@pytest.fixture(scope="module")
def path(spark):
    folder = scratch_path(spark, "dump")
    spark.createDataFrame([(DUMP,)], "value string").coalesce(1).write.text(folder)
    return folder


def test_fields(spark, path):
    rows = {r["identifier"]: r for r in records.load_records(spark, path).collect()}
    assert set(rows) == {"oai:x:1", "oai:x:3"}
    one = rows["oai:x:1"]
    assert one["title"] == "Judul & Isi" and one["abstract"] == "First\nline"
    assert one["authors"] == "A, B; C, D" and one["subjects"] == "law; tax"
    assert one["date"] == "2015" and one["publisher"] == "" and one["types"] == "Thesis"
    assert rows["oai:x:3"]["title"] == "T1" and rows["oai:x:3"]["abstract"] == ""


def test_selection_is_inclusive(spark, path):
    def ids(*args, **kw):
        return sorted(r["identifier"] for r in records.load_records(spark, path, *args, **kw).collect())

    assert ids("col_2") == ["oai:x:1"]
    assert ids(None, "2020-01-05", "2020-01-05") == ["oai:x:1"]
    assert ids(None, "2020-03-01") == ["oai:x:3"]
    assert ids(max_records=1) == ["oai:x:1"]


def test_sets(spark, path):
    sets = records.list_sets(records.read_records(spark, path)).collect()
    assert {r["set_spec"]: r["n"] for r in sets} == {"com_1": 3, "col_2": 1}
