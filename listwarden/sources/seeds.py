"""Reference rows that a new installation starts with, and their insertion where absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listwarden.operators.tables import insert_absent

# Fixed values: (code, name, authority, description)
PROGRAMS = [
    ("SDGT", "Specially Designated Global Terrorist", "OFAC", "Persons who commit, threaten to commit, or support terrorism"),
    ("SDNTK", "Specially Designated Narcotics Trafficker Kingpin Act", "OFAC", "Foreign drug kingpins and their organizations"),
    ("SDN", "Specially Designated Nationals and Blocked Persons", "OFAC", "General OFAC sanctions list"),
    ("CYBER2", "Malicious Cyber-Enabled Activities", "OFAC", "Cyber-related sanctions"),
    ("IRAN", "Iran Sanctions", "OFAC", "Iran-related sanctions"),
    ("RUSSIA", "Russia Sanctions", "OFAC", "Russia-related sanctions"),
    ("SYRIA", "Syria Sanctions", "OFAC", "Syria-related sanctions"),
    ("VENEZUELA", "Venezuela Sanctions", "OFAC", "Venezuela-related sanctions"),
    ("CUBA", "Cuba Sanctions", "OFAC", "Cuba-related sanctions"),
    ("DPRK", "North Korea Sanctions", "OFAC", "North Korea-related sanctions"),
    ("UN-CONSOLIDATED", "UN Consolidated Sanctions", "UN", "United Nations consolidated sanctions list"),
    ("UN-TALIBAN", "UN Taliban Sanctions", "UN", "Taliban and Al-Qaeda sanctions"),
    ("UN-ISIL", "UN ISIL/Da'esh Sanctions", "UN", "ISIL/Da'esh and Al-Qaeda sanctions"),
]

# Programs of the schema script that the loader's list does not have.
SCHEMA_PROGRAMS = [
    ("FSE", "Foreign Sanctions Evaders", "OFAC", "Foreign persons involved in sanctions evasion"),
    ("SSI", "Sectoral Sanctions Identifications", "OFAC", "Russian sectoral sanctions"),
    ("UN-1718", "UN Security Council Resolution 1718", "UN", "UN DPRK sanctions regime"),
]

# Fixed values: (code, name, source_type, download_url, file_format, is_active, update_frequency_days, validate_xsd)
DATA_SOURCES = [
    ("OFAC", "OFAC SDN Enhanced List", "OFAC", "https://sanctionslistservice.ofac.treas.gov/api/PublicationPreview/exports/SDN_ENHANCED.ZIP", "xml", True, 1, True),
    ("UN", "UN Consolidated List", "UN", "https://scsanctions.un.org/resources/xml/en/consolidated.xml", "xml", True, 1, True),
    ("EU", "EU Consolidated List", "EU", "https://webgate.ec.europa.eu/fsd/fsf/public/files/xmlFullSanctionsList/content", "xml", False, 7, None),
    ("UK", "UK Consolidated List", "UK", "https://ofsistorage.blob.core.windows.net/publishlive/ConList.xml", "xml", False, 7, None),
]

# Fixed values: (external_id, source, entity_type, primary_name, first_name, last_name, nationality, date_of_birth, vessel_type, vessel_flag, vessel_imo)
SAMPLE_ENTITIES = [
    ("SAMPLE-001", "OTHER", "individual", "Sample Test Person", "Sample", "Person", "United States", "1980-01-15", None, None, None),
    ("SAMPLE-002", "OTHER", "entity", "Sample Test Corporation Ltd", None, None, "Panama", None, None, None, None),
    ("SAMPLE-003", "OTHER", "vessel", "MV Sample Vessel", None, None, None, None, "Cargo", "Panama", "9999999"),
]


def programs(spark: SparkSession, with_schema_script: bool = False) -> DataFrame:
    rows = PROGRAMS + (SCHEMA_PROGRAMS if with_schema_script else [])
    return spark.createDataFrame(
        [(*row, True) for row in rows],
        "code STRING, name STRING, authority STRING, description STRING, is_active BOOLEAN",
    )


def data_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DATA_SOURCES,
        "code STRING, name STRING, source_type STRING, download_url STRING, file_format STRING, is_active BOOLEAN, "
        "update_frequency_days INT, validate_xsd BOOLEAN",
    )


def sample_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SAMPLE_ENTITIES,
        "external_id STRING, source STRING, entity_type STRING, primary_name STRING, first_name STRING, last_name STRING, "
        "nationality STRING, date_of_birth STRING, vessel_type STRING, vessel_flag STRING, vessel_imo STRING",
    )


def seed_programs(existing: DataFrame) -> DataFrame:
    return insert_absent(existing, programs(existing.sparkSession), ["code"])


def seed_data_sources(existing: DataFrame) -> DataFrame:
    return insert_absent(existing, data_sources(existing.sparkSession), ["code"])


def seed_sample_entities(existing: DataFrame) -> DataFrame:
    return insert_absent(existing, sample_entities(existing.sparkSession), ["external_id", "source"])
