import random

import pytest
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, FALLBACK, JoinLimits, ScreeningConfig, Weights
from listwarden.operators import decision, quality, screening
from listwarden.plans import bulk
from tests import model

ENTITY = (
    "source string, entity_id string, entity_type string, primary_name string, all_names array<string>, "
    "identity_documents array<struct<type:string,number:string>>, vessel_imo string, date_of_birth string, "
    "nationality string, citizenship string, countries array<string>"
)
REQUEST = (
    "request_id int, name string, document_number string, document_type string, date_of_birth string, "
    "nationality string, country string"
)
FIRST = ["Mohamed", "Ali", "José", "Maria", "García", "Li", "Wei", "李明", "Владимир", "Hassan", "Smith", "Jon", "John", "Smyth"]


def data(seed, requests=60, entities=80):
    rng = random.Random(seed)
    name = lambda: " ".join(rng.choice(FIRST) for _ in range(rng.randint(1, 3)))
    number = lambda: f"P{rng.choice('- .')}{rng.randint(1, 12)}"
    maybe = lambda v, p=0.5: v if rng.random() < p else None
    listed = []
    for i in range(entities):
        names = list(dict.fromkeys(name() for _ in range(rng.randint(1, 3))))
        docs = [{"type": rng.choice(["Passport", "ID"]), "number": number()} for _ in range(rng.randint(0, 2))]
        countries = [c for c in ("Panama", "Iran", "Federal Germany") if rng.random() < 0.3]
        listed.append({
            "source": rng.choice(["OFAC", "UN"]), "entity_id": str(i), "entity_type": rng.choice(["individual", "entity", "vessel"]),
            "primary_name": names[0], "all_names": names, "identity_documents": docs, "vessel_imo": maybe(number(), 0.1),
            "date_of_birth": maybe(f"{rng.randint(1970, 1976)}-01-01"), "nationality": maybe("Cuba", 0.3), "citizenship": maybe("Iran", 0.2), "countries": countries,
        })
    asked = [{
        "request_id": i, "name": name(), "document_number": maybe(number().lower()), "document_type": maybe(rng.choice(["passport", "id", "visa"])),
        "date_of_birth": maybe(str(rng.randint(1970, 1976))), "nationality": maybe(rng.choice(["PANAMA", "Germany", "USA"])), "country": maybe("cuba", 0.3),
    } for i in range(requests)]
    return asked, listed


def frames(spark, asked, listed):
    pick = lambda rows, ddl: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in _columns(ddl)) for r in rows], ddl)
    return pick(asked, REQUEST), pick(listed, ENTITY)


def _columns(ddl):
    depth, start, out = 0, 0, []
    for i, ch in enumerate(ddl + ","):
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def check(spark, asked, listed, config):
    requests, entities = frames(spark, asked, listed)
    got = {}
    for r in screening.screen(requests, entities, config).orderBy("request_id", "match_rank").collect():
        got.setdefault(r.request_id, []).append((r.source, r.entity_id, round(r.overall, 6), r.match_layer, r.flags, r.recommendation, r.matched_name, r.matched_document))
    expected = {
        a["request_id"]: [(h[0], h[1], round(h[2], 6), *h[3:]) for h in model.screen(a, listed, config)] for a in asked
    }
    expected = {k: v for k, v in expected.items() if v}
    assert expected and got == expected


MIXED = ScreeningConfig(name_threshold=70, weights=Weights(name=0.7, document=0.2, dob=0.1), match_limit=4)


@pytest.mark.parametrize("seed, config", [(1, DEFAULT), (2, FALLBACK), (3, MIXED)], ids=["default", "fallback", "mixed"])
def test_screen_equals_the_model(spark, seed, config):
    check(spark, *data(seed), config)


def test_screen_on_the_shuffled_path(spark):
    check(spark, *data(4), DEFAULT.with_(limits=JoinLimits(broadcast_bytes=0, block_rows=3)))


def test_one_hot_name_and_one_hot_number(spark):
    """A third of all requests and entities share a name and a number."""
    asked, listed = data(5, 30, 60)
    for i, row in enumerate(asked):
        if i % 3 == 0:
            row.update(name="Maria García", document_number="N/A", document_type="visa" if i % 2 else None)
    for i, row in enumerate(listed):
        if i % 3 == 0:
            row.update(primary_name="Maria Garcia", all_names=["Maria Garcia"], identity_documents=[{"type": "Passport", "number": "n-a"}])
    check(spark, asked, listed, DEFAULT)


@pytest.mark.parametrize("a, b, expected", [("1985-01-15", "1985-06-20", 100), ("1985", "1986", 80), ("1985", "1990", 0), ("1985", "", 0)])
def test_dob_score(spark, a, b, expected):
    from listwarden.functions.names import dob_year

    assert spark.range(1).select(decision.dob_score(dob_year(F.lit(a)), dob_year(F.lit(b)))).first()[0] == expected


def test_nationality_affix_rule(spark):
    flag = lambda wanted, listed: spark.range(1).select(
        decision.nationality_flag(F.array(*map(F.lit, wanted)), F.array(*map(F.lit, listed)))
    ).first()[0]
    assert flag(["USA"], ["JERUSALEM", "ISRAEL"]) is None
    assert flag(["GERMANY"], ["FEDERAL GERMANY"]) == "NATIONALITY_SUBSTRING_MATCH_INFO"
    assert flag(["IRAN"], ["IRAN"]) == "NATIONALITY_EXACT_MATCH_INFO"


def test_validation_codes(spark):
    rows = [
        ("a", None, None, "NAME_TOO_SHORT"), ("x" * 201, None, None, "NAME_TOO_LONG"), ("Jo<hn", None, None, "BLOCKED_CHARACTERS"),
        ("Jo​hn", None, None, "CONTROL_CHARACTER"), ("John", "01/02/1980", None, "INVALID_DOB_FORMAT"),
        ("John", "1980-01", "1" * 51, "DOCUMENT_TOO_LONG"), ("John", None, "a/b", "INVALID_DOCUMENT_FORMAT"), ("李明", "1980", "A-1.2", None),
    ]
    df = spark.createDataFrame(rows, "name string, date_of_birth string, document_number string, expected string")
    assert quality.with_validation(df).filter("NOT (error_code <=> expected)").count() == 0
    latin = DEFAULT.with_(input_rules=type(DEFAULT.input_rules)(allow_unicode_names=False))
    assert [r[0] for r in df.filter("name = 'John' OR name LIKE 'Jo_hn'").select(quality.error_code(latin)).collect()].count("INVALID_FORMAT") == 1


def test_bulk_run(spark, tmp_path):
    asked, listed = data(6, 20, 40)
    asked.append({**asked[0], "request_id": 99, "name": "<script>"})
    requests, entities = frames(spark, asked, listed)
    run = bulk.bulk_screen(requests, entities)
    hits = sum(bool(model.screen(a, listed, DEFAULT)) for a in asked[:-1])
    assert run.summary.first().asDict() == {"total_screened": 20, "total_hits": hits, "hit_rate": f"{hits / 20 * 100:.2f}%"}
    assert [r.request_id for r in run.rejects.collect()] == [99]
    bulk.write_bulk(run, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/hits").count() == hits
    with pytest.raises(quality.InvalidRequests):
        bulk.bulk_screen(requests, entities, fail_fast=True)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        ScreeningConfig(weights=Weights(name=0.5))


def test_repeated_rows_share_their_matches(spark):
    asked, listed = data(7, 10, 40)
    requests, entities = frames(spark, asked + asked, listed)
    matches = screening.screen(requests, entities)
    results = screening.screening_results(requests, matches).collect()
    expected = {a["request_id"]: len(model.screen(a, listed, DEFAULT)) for a in asked}
    assert len(results) == 20 and all(r.hit_count == len(r.matches or []) == expected[r.request_id] for r in results)


def test_prepared_list_serves_up_to_its_limit(spark):
    asked, listed = data(8, 5, 20)
    requests, entities = frames(spark, asked, listed)
    prepared = screening.prepare_list(entities, DEFAULT.with_(match_limit=2))
    assert screening.screen(requests, prepared, DEFAULT.with_(match_limit=2)).count() > 0
    with pytest.raises(ValueError, match="prepared for 2"):
        screening.screen(requests, prepared)


def test_grid_copies_follow_the_data_not_the_tasks(spark):
    from listwarden.operators.candidates import in_grid

    probe = spark.range(90).select(F.concat(F.lit("r"), "id").alias("request_key"), F.lit(5).alias("len"))
    build = spark.range(60).select(F.concat(F.lit("l"), "id").alias("list_key"), F.when(F.col("id") < 50, 5).otherwise(6).alias("len"))
    before, sizes = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in ("4", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        asked, listed = in_grid(probe, build, 10)
        sizes.append((asked.count(), listed.count(), asked.join(listed, ["len", "list_block", "request_block"]).count()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[0] == sizes[1] == (90 * 5, 50 * 9, 90 * 50)
