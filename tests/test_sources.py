import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from listwarden import schemas
from listwarden.operators import quality, stats, tables
from listwarden.plans import reload, reports
from listwarden.sources import files, seeds, xml_lists

OFAC = """<?xml version="1.0"?>
<sanctions xmlns="https://example.org/ENHANCED_XML">
 <publishInformation><publishDate>2024-05-06</publishDate></publishInformation>
 <entities>
  <entity id="12345">
   <entityType>Individual</entityType>
   <names><name><translations><translation>
     <formattedFullName> John Doe </formattedFullName><formattedFirstName>John</formattedFirstName><formattedLastName>Doe</formattedLastName>
   </translation></translations></name>
   <name><translations><translation><formattedFullName>Johnny</formattedFullName></translation></translations></name>
   <name><translations><translation><formattedFullName>John Doe</formattedFullName></translation></translations></name></names>
   <idDocuments><idDocument><type>Passport</type><number>X12345678</number><issuedByCountry>Panama</issuedByCountry></idDocument>
     <idDocument><type>ID</type></idDocument></idDocuments>
   <identityDocuments><identityDocument><documentNumber>D-9</documentNumber></identityDocument></identityDocuments>
   <features>
     <feature><type featureTypeId="8">Date of Birth</type><value>1970-01-01</value><reliability>High</reliability></feature>
     <feature><type>Nationality Country</type><value>Panama</value></feature>
     <feature><type>Nationality Country</type><value>Cuba</value></feature>
     <feature><type>Digital Currency Address - XBT</type><value>bc1</value></feature>
   </features>
   <relationships><relationship><relatedEntity entityId="67890">Other</relatedEntity><relationshipType>Associate</relationshipType></relationship></relationships>
   <addresses><address><city>Colon</city><country>Panama</country></address><address></address></addresses>
   <sanctionsPrograms><sanctionsProgram>SDGT</sanctionsProgram><sanctionsProgram>IRAN</sanctionsProgram></sanctionsPrograms>
  </entity>
  <entity><entityType>Entity</entityType><names><name><translations><translation><formattedFullName>No Id</formattedFullName></translation></translations></name></names></entity>
  <entity id="7"><entityType>Vessel</entityType><names></names></entity>
 </entities>
</sanctions>"""

UN = """<?xml version="1.0"?>
<CONSOLIDATED_LIST dateGenerated="2024-03-04T05:06:07Z">
 <INDIVIDUALS><INDIVIDUAL>
  <DATAID>1</DATAID><FIRST_NAME>Ali</FIRST_NAME><SECOND_NAME>bin</SECOND_NAME><THIRD_NAME>Said</THIRD_NAME>
  <REFERENCE_NUMBER>QDi.001</REFERENCE_NUMBER><UN_LIST_TYPE>Al-Qaida</UN_LIST_TYPE><NATIONALITY><VALUE>Yemen</VALUE></NATIONALITY>
  <INDIVIDUAL_ALIAS><QUALITY>Good</QUALITY><ALIAS_NAME>Abu Ali</ALIAS_NAME></INDIVIDUAL_ALIAS>
  <INDIVIDUAL_ALIAS><ALIAS_NAME>Abu Ali</ALIAS_NAME></INDIVIDUAL_ALIAS>
  <INDIVIDUAL_DOCUMENT><NUMBER>P1</NUMBER></INDIVIDUAL_DOCUMENT>
 </INDIVIDUAL><INDIVIDUAL><FIRST_NAME>No id</FIRST_NAME></INDIVIDUAL></INDIVIDUALS>
 <ENTITIES><ENTITY><DATAID>2</DATAID><FIRST_NAME>Trading Co</FIRST_NAME><REFERENCE_NUMBER>KPe.015</REFERENCE_NUMBER>
  <UN_LIST_TYPE>DPRK</UN_LIST_TYPE><ENTITY_ALIAS><ALIAS_NAME>TC</ALIAS_NAME></ENTITY_ALIAS><ENTITY_ADDRESS><COUNTRY>China</COUNTRY></ENTITY_ADDRESS></ENTITY>
  <ENTITY><DATAID>3</DATAID><FIRST_NAME>Odd</FIRST_NAME><REFERENCE_NUMBER>none</REFERENCE_NUMBER></ENTITY></ENTITIES>
</CONSOLIDATED_LIST>"""


@pytest.fixture
def lists(tmp_path):
    (tmp_path / "ofac.xml").write_text(OFAC)
    (tmp_path / "un.xml").write_text(UN)
    return str(tmp_path / "ofac.xml"), str(tmp_path / "un.xml")


def test_ofac_fields(spark, lists):
    rows = xml_lists.read_ofac(spark, lists[0]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.entity_id, r.entity_type, r.primary_name, r.aliases) == ("12345", "individual", "John Doe", ["Johnny"])
    assert (r.first_name, r.last_name, r.date_of_birth, r.nationality) == ("John", "Doe", "1970-01-01", "Cuba")
    assert [(d.type, d.number, d.issuing_country) for d in r.identity_documents] == [("Passport", "X12345678", "Panama"), ("Unknown", "D-9", None)]
    assert r.features[0].type_id == "8" and r.features[0].reliability == "High"
    assert [(x.related_entity_id, x.relationship_type) for x in r.relationships] == [("67890", "Associate")]
    assert len(r.addresses) == 1 and r.countries == ["Cuba", "Panama"] and r.crypto_addresses == ["bc1"]
    assert r.program == "SDGT; IRAN"


def test_un_fields(spark, lists):
    rows = {r.entity_id: r for r in xml_lists.read_un(spark, lists[1]).collect()}
    assert set(rows) == {"1", "2", "3"}
    ali = rows["1"]
    assert (ali.primary_name, ali.last_name, ali.aliases) == ("Ali bin Said", "Said", ["Abu Ali", "Abu Ali"])
    assert (ali.un_list_type, ali.un_country_code, ali.un_committee, ali.nationality) == ("QDi", "QD", "Al-Qaida", "Yemen")
    assert ali.identity_documents[0].type == "Unknown"
    assert (rows["2"].un_list_type, rows["2"].countries, rows["2"].entity_type) == ("KPe", ["China"], "entity")
    assert rows["3"].un_list_type is None
    codes = stats.discovered_codes(xml_lists.read_un(spark, lists[1]))
    assert {(r.kind, r.code) for r in codes.collect()} == {("country_code", "QD"), ("country_code", "KP"), ("list_type", "Al-Qaida"), ("list_type", "DPRK")}


def test_external_entity_is_not_read(spark, tmp_path):
    (tmp_path / "secret").write_text("SECRET")
    evil = f"""<?xml version="1.0"?><!DOCTYPE s [<!ENTITY x SYSTEM "file://{tmp_path}/secret">]>
    <sanctions><entity id="1"><names><name><translations><translation><formattedFullName>A &x;</formattedFullName></translation></translations></name></names></entity></sanctions>"""
    (tmp_path / "evil.xml").write_text(evil)
    try:
        text = str(xml_lists.read_ofac(spark, str(tmp_path / "evil.xml")).collect())
    except PySparkException as error:
        text = str(error)
    assert "SECRET" not in text


def test_malformed_share(spark, lists):
    row = quality.malformation_rate(xml_lists.read_ofac_raw(spark, lists[0]), "_id").first()
    assert (row.entity_count, row.malformed_count, row.is_error) == (3, 1, True)


def test_reload_and_publish(spark, lists, tmp_path):
    from listwarden.config import DEFAULT

    strict = reload.reload_lists(spark, *lists)
    assert {r.source for r in strict.entities.collect()} == {"UN"} and strict.refused == ("OFAC",)
    told = {r.source: (r.success, list(r.errors), list(r.warnings)) for r in strict.report.collect()}
    assert told == {"OFAC": (False, ["1 of 3 entities have no id (33.33%)"], []), "UN": (True, [], [])}
    done = reload.reload_lists(spark, *lists, config=DEFAULT.with_(malformed_percent=50))
    report = {r.source: r for r in done.report.collect()}
    assert (report["OFAC"].total_entities, report["UN"].entities_added, report["UN"].individuals) == (1, 3, 1)
    folder = str(tmp_path / "published")
    with pytest.raises(ValueError, match="OFAC"):
        reload.publish_reload(strict, folder, "v1")
    reload.publish_reload(strict, folder, "v1", accept_refused=True)
    assert reload.current(spark, folder).count() == 3
    reload.publish_reload(done, folder, "v2")
    assert reload.current(spark, folder).count() == 4
    kept = reload.reload_lists(spark, *lists, previous=reload.current(spark, folder))
    assert kept.entities.count() == 4 and all(r.entities_removed == 0 for r in kept.report.collect())
    again = reload.reload_lists(spark, *lists, previous=reload.current(spark, folder), config=DEFAULT.with_(malformed_percent=50))
    assert all(r.entities_added == r.entities_updated == r.entities_removed == 0 for r in again.report.collect())


def test_list_metadata(spark, lists):
    ofac = files.list_metadata(spark, lists[0], "OFAC", ["entity"], "publishInformation", version="Enhanced XML").first()
    un = files.list_metadata(spark, lists[1], "UN", ["INDIVIDUAL", "ENTITY"], root_tag="CONSOLIDATED_LIST").first()
    assert (ofac.record_count, str(ofac.last_update)[:10]) == (3, "2024-05-06")
    assert (un.record_count, str(un.last_update)[:10]) == (4, "2024-03-04")
    assert ofac.sha256 == hashlib.sha256(OFAC.encode()).hexdigest()


def test_list_metadata_of_several_files(spark, tmp_path):
    entity = '<entity id="{}"><names/></entity>'
    for name, count, date in (("a", 2, "2024-01-01"), ("b", 3, "2024-02-02")):
        text = "".join(entity.format(k) for k in range(count))
        (tmp_path / f"{name}.xml").write_text(f"<sanctions><publishInformation><publishDate>{date}</publishDate></publishInformation>{text}</sanctions>")
    rows = files.list_metadata(spark, f"{tmp_path}/*.xml", "OFAC", ["entity"], "publishInformation").collect()
    assert {r.file_name: (r.record_count, str(r.last_update)[:10]) for r in rows} == {"a.xml": (2, "2024-01-01"), "b.xml": (3, "2024-02-02")}


def test_equal_rows_and_line_breaks_of_a_request_file(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('nombre,cedula\nSame,1\nSame,1\n"Jane\nDoe",2\n', encoding="utf-8")
    rows = files.read_requests(spark, str(path)).collect()
    assert sorted(r.name for r in rows) == ["Jane\nDoe", "Same", "Same"] and len({r.request_id for r in rows}) == 3


def test_row_schema(spark, tmp_path):
    (tmp_path / "row.xsd").write_text(
        '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="entity"><xs:complexType><xs:sequence><xs:element name="name" type="xs:string"/>'
        '</xs:sequence><xs:attribute name="id" type="xs:integer"/></xs:complexType></xs:element></xs:schema>'
    )
    (tmp_path / "l.xml").write_text('<s><entity id="1"><name>a</name></entity><entity id="x"><name>b</name></entity><entity id="3"><other/></entity></s>')
    refused = xml_lists.invalid_rows(spark, str(tmp_path / "l.xml"), "entity", str(tmp_path / "row.xsd"))
    assert refused.count() == 2 and quality.validation_totals(refused).first().errors == 2


def test_request_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Nombre, CEDULA ,pais\nKhalil Pareja ,114488,\n,1,x\n"Doe, ""J""",9,Perú\n', encoding="utf-8")
    rows = files.read_requests(spark, str(path)).orderBy("name").collect()
    assert [(r.name, r.document_number, r.country) for r in rows] == [('Doe, "J"', "9", "Perú"), ("Khalil Pareja", "114488", None)]
    (tmp_path / "bad.csv").write_text("name,x\na,b\n")
    with pytest.raises(files.HeaderError):
        files.read_requests(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises((files.HeaderError, PySparkException)):
        files.read_requests(spark, str(tmp_path / "empty.csv"))


def test_audit_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"screening_id":"1","input":{"name":"x"}}\nnot json\n')
    assert [r.screening_id for r in files.read_audit(spark, str(path)).collect()] == ["1"]
    with pytest.raises(Exception, match="(?i)malformed|cannot|FAILED_READ"):
        files.read_audit(spark, str(path), strict=True).collect()


def test_hash_states(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.xml").write_text(name)
    digest = hashlib.sha256(b"a").hexdigest()
    known = spark.createDataFrame([("a.xml", digest), ("b.xml", "0")], "file_name string, known_hash string")
    states = files.hash_verification(files.file_digests(spark, str(tmp_path)), known).collect()
    assert {r.file_name: r.status for r in states} == {"a.xml": "ok", "b.xml": "mismatch", "c.xml": "new"}
    assert files.list_files(spark, str(tmp_path)).count() == 3


def test_seeds(spark):
    empty = spark.createDataFrame([], "code string, name string, authority string, description string, is_active boolean")
    first = seeds.seed_programs(empty)
    assert first.count() == 13 and seeds.seed_programs(first).count() == 13
    assert seeds.programs(spark, with_schema_script=True).count() == 16
    assert seeds.seed_data_sources(spark.createDataFrame([("UN",)], "code string")).count() == 4
    assert seeds.seed_sample_entities(spark.createDataFrame([], "external_id string, source string")).count() == 3


def test_export_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', None, "x", True, 2, "AUTO_ESCALATE"), ("d", "1", None, False, 0, None)],
                               "name string, document_number string, country string, is_hit boolean, hit_count int, recommendation string")
    reports.write_export(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert '"a ""b"", c",,x,COINCIDENCIA,2,AUTO_ESCALATE' in text and "d,1,,LIMPIO,0,APPROVE" in text


def test_schema_message_levels(spark):
    df = spark.createDataFrame([("Missing Required x",), ("unexpected element",), ("other",)], "message string")
    for strictness, expected in (("strict", [3, 0]), ("normal", [1, 1]), ("lenient", [0, 2])):
        from listwarden.config import DEFAULT

        row = quality.validation_totals(df, DEFAULT.with_(xsd_strictness=strictness)).first()
        assert [row.errors, row.warnings] == expected


def test_entity_schema(spark, lists):
    assert xml_lists.read_lists(spark, *lists).columns == [f.name for f in spark.createDataFrame([], schemas.ENTITY).schema]
    related = tables.related_entities(
        xml_lists.read_ofac(spark, lists[0]).select("entity_id", F.inline("relationships")), xml_lists.read_lists(spark, *lists)
    ).first()
    assert related.related_name is None and related.related_entity_id == "67890"
