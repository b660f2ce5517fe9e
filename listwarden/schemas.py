"""Explicit schemas. No source is read by inference."""

from __future__ import annotations

OFAC_ENTITY = """
_id STRING,
entityType STRING,
names STRUCT<name: ARRAY<STRUCT<translations: STRUCT<translation: ARRAY<STRUCT<
  formattedFullName: STRING, formattedFirstName: STRING, formattedLastName: STRING>>>>>>,
idDocuments STRUCT<idDocument: ARRAY<STRUCT<type: STRING, number: STRING, issuedByCountry: STRING,
  issueDate: STRING, expirationDate: STRING, note: STRING>>>,
identityDocuments STRUCT<identityDocument: ARRAY<STRUCT<type: STRING, documentNumber: STRING,
  issuingCountry: STRING, issueDate: STRING, expirationDate: STRING>>>,
features STRUCT<feature: ARRAY<STRUCT<type: STRUCT<_VALUE: STRING, _featureTypeId: STRING>,
  value: STRING, reliability: STRING>>>,
relationships STRUCT<relationship: ARRAY<STRUCT<relatedEntity: STRUCT<_VALUE: STRING, _entityId: STRING>,
  relationshipType: STRING, fromDate: STRING, toDate: STRING>>>,
addresses STRUCT<address: ARRAY<STRUCT<addressLine1: STRING, addressLine2: STRING, city: STRING,
  stateProvince: STRING, postalCode: STRING, country: STRING, region: STRING>>>,
sanctionsPrograms STRUCT<sanctionsProgram: ARRAY<STRING>>
"""

OFAC_HEADER = "publishDate STRING"

_UN_ADDRESS = "ARRAY<STRUCT<STREET: STRING, CITY: STRING, STATE_PROVINCE: STRING, COUNTRY: STRING>>"

UN_INDIVIDUAL = f"""
DATAID STRING, FIRST_NAME STRING, SECOND_NAME STRING, THIRD_NAME STRING, FOURTH_NAME STRING,
REFERENCE_NUMBER STRING, UN_LIST_TYPE STRING, DATE_OF_BIRTH STRING, COMMENTS1 STRING,
NATIONALITY STRUCT<VALUE: ARRAY<STRING>>,
INDIVIDUAL_ALIAS ARRAY<STRUCT<ALIAS_NAME: STRING, QUALITY: STRING>>,
INDIVIDUAL_DOCUMENT ARRAY<STRUCT<TYPE_OF_DOCUMENT: STRING, NUMBER: STRING, ISSUING_COUNTRY: STRING,
  DATE_OF_ISSUE: STRING, NOTE: STRING>>,
INDIVIDUAL_ADDRESS {_UN_ADDRESS}
"""

UN_ENTITY = f"""
DATAID STRING, FIRST_NAME STRING, REFERENCE_NUMBER STRING, UN_LIST_TYPE STRING, COMMENTS1 STRING,
ENTITY_ALIAS ARRAY<STRUCT<ALIAS_NAME: STRING>>,
ENTITY_ADDRESS {_UN_ADDRESS}
"""

DOCUMENT = "type: STRING, number: STRING, issuing_country: STRING, issue_date: STRING, expiration_date: STRING, note: STRING"
FEATURE = "type: STRING, value: STRING, type_id: STRING, reliability: STRING"
RELATIONSHIP = "related_entity_id: STRING, relationship_type: STRING, from_date: STRING, to_date: STRING"
ADDRESS = (
    "line1: STRING, line2: STRING, city: STRING, state_province: STRING, postal_code: STRING, "
    "country: STRING, region: STRING"
)

ENTITY = f"""
source STRING, entity_id STRING, entity_type STRING, primary_name STRING, all_names ARRAY<STRING>,
aliases ARRAY<STRING>, first_name STRING, last_name STRING,
identity_documents ARRAY<STRUCT<{DOCUMENT}>>, features ARRAY<STRUCT<{FEATURE}>>,
date_of_birth STRING, place_of_birth STRING, nationality STRING, citizenship STRING, gender STRING,
title STRING, vessel_imo STRING, aircraft_registration STRING, crypto_addresses ARRAY<STRING>,
relationships ARRAY<STRUCT<{RELATIONSHIP}>>, addresses ARRAY<STRUCT<{ADDRESS}>>,
countries ARRAY<STRING>, sanctions_programs ARRAY<STRING>, program STRING,
un_list_type STRING, un_country_code STRING, un_committee STRING, un_reference_number STRING, remarks STRING
"""

# What screening reads of an entity.
SCREENED_ENTITY = [
    "source", "entity_id", "entity_type", "primary_name", "all_names", "identity_documents",
    "vessel_imo", "date_of_birth", "nationality", "citizenship", "countries",
]

REQUEST = """
request_id STRING, name STRING, document_number STRING, document_type STRING, date_of_birth STRING,
nationality STRING, country STRING
"""

AUDIT = """
screening_id STRING, timestamp STRING,
input STRUCT<name: STRING, document: STRING, country: STRING, dob: STRING, nationality: STRING>,
operator STRING,
result STRUCT<is_hit: BOOLEAN, match_count: LONG, top_score: DOUBLE>,
is_hit BOOLEAN, match_count LONG, decision STRING,
list_versions ARRAY<STRUCT<source: STRING, hash: STRING, last_update: STRING, record_count: LONG>>,
config MAP<STRING, STRING>
"""

ALLOWED = {
    "entity_type": ["individual", "entity", "vessel", "aircraft"],
    "data_source_type": ["OFAC", "UN", "EU", "UK", "OTHER"],
    "screening_status": ["pending", "processing", "completed", "failed"],
    "recommendation_type": ["AUTO_ESCALATE", "MANUAL_REVIEW", "LOW_CONFIDENCE_REVIEW", "AUTO_CLEAR"],
    "audit_action": [
        "CREATE", "READ", "UPDATE", "DELETE", "SCREEN", "BULK_SCREEN", "DATA_UPDATE", "LOGIN",
        "LOGOUT", "CONFIG_CHANGE",
    ],
}
