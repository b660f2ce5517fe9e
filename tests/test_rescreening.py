import random


from listwarden.config import DEFAULT
from listwarden.operators import rescreening, screening

WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath"]
KINDS = ["individual", "entity", "vessel"]


def _entity(rng, number):
    name = " ".join(rng.sample(WORDS, 2)) + rng.choice(["", "s", "a"])
    return {
        "source": rng.choice(["OFAC", "UN"]) if number >= 0 else "UN", "entity_id": str(number), "entity_type": rng.choice(KINDS), "primary_name": name,
        "all_names": [name, " ".join(rng.sample(WORDS, 2))][: rng.choice([1, 2])], "identity_documents": [{"type": "Passport", "number": f"P{rng.randrange(40)}"}] if rng.random() < 0.4 else [],
        "vessel_imo": None, "date_of_birth": f"{rng.randrange(1950, 1954)}-01-01", "countries": [rng.choice(["Iran", "Cuba"])], "nationality": rng.choice(["Panama", None]), "citizenship": None,
    }


def _frame(spark, rows):
    kinds = "source string, entity_id string, entity_type string, primary_name string, all_names array<string>, identity_documents array<struct<type:string,number:string>>, vessel_imo string, date_of_birth string, countries array<string>, nationality string, citizenship string"
    return spark.createDataFrame(rows, kinds)


def _requests(spark, rng, n=40):
    rows = [(k, " ".join(rng.sample(WORDS, 2)) if k % 9 else "am b", f"p-{rng.randrange(40)}" if k % 3 == 0 else None, rng.choice([None, "passport", "visa"]), "1951" if k % 2 else None, rng.choice(["Iran", None]), None) for k in range(n)]
    rows.append((n, "nobody knows", None, None, None, None, None))
    return spark.createDataFrame(rows, "request_id long, name string, document_number string, document_type string, date_of_birth string, nationality string, country string")


def _sorted(frame):
    return sorted(map(str, frame.select("request_id", "match_rank", "source", "entity_id", "overall", "match_layer", "flags", "matched_name", "matched_document").collect()))


def _versions(rng, steps):
    rows = {k: _entity(rng, k) for k in range(150)}
    out = [list(rows.values())]
    for step in range(steps):
        for k in rng.sample(sorted(rows), 25):
            del rows[k]
        for k in rng.sample(sorted(rows), 15):
            rows[k] = {**_entity(rng, k), "source": rows[k]["source"]}
        rows.update({k: _entity(rng, k) for k in range(1000 * (step + 1), 1000 * (step + 1) + 20)})
        out.append(list(rows.values()))
    return out


def test_carried_over_thrice_equals_full_runs(spark):
    rng = random.Random(4)
    requests, versions = _requests(spark, rng), _versions(rng, 3)
    config = DEFAULT.with_(match_limit=4)
    state = rescreening.start(requests, _frame(spark, versions[0]), config, reserve=3)
    assert _sorted(rescreening.best_matches(requests, state)) == _sorted(screening.screen(requests, _frame(spark, versions[0]), config))
    again = []
    for old, new in zip(versions, versions[1:]):
        before, now = _frame(spark, old), _frame(spark, new)
        state = rescreening.carry_over(state, rescreening.changes(before, now), now)
        assert _sorted(rescreening.best_matches(requests, state)) == _sorted(screening.screen(requests, now, config))
        again.append(state.recomputed)
    assert 0 < sum(again) < 3 * 41  # some reserves were used up, not all


def test_no_change_and_empty_lists(spark):
    rng = random.Random(5)
    requests, rows = _requests(spark, rng), _versions(rng, 0)[0]
    full, none = _frame(spark, rows), _frame(spark, [])
    state = rescreening.start(requests, full)
    same = rescreening.carry_over(state, rescreening.changes(full, full), full)
    assert same.recomputed == 0 and _sorted(rescreening.best_matches(requests, same)) == _sorted(rescreening.best_matches(requests, state))
    emptied = rescreening.carry_over(state, rescreening.changes(full, none), none)
    assert rescreening.best_matches(requests, emptied).count() == 0
    filled = rescreening.carry_over(emptied, rescreening.changes(none, full), full)
    assert _sorted(rescreening.best_matches(requests, filled)) == _sorted(rescreening.best_matches(requests, state))


def test_what_a_version_brought(spark):
    rng = random.Random(6)
    requests, versions = _requests(spark, rng), _versions(rng, 1)
    runs = [screening.screen(requests, _frame(spark, v)) for v in versions]
    told = {(r.request_id, r.source, r.entity_id): r.outcome for r in rescreening.differences(*runs).collect()}
    plain = [{(r.request_id, r.source, r.entity_id): (r.overall, r.match_layer, r.recommendation, r.matched_name) for r in run.collect()} for run in runs]
    expected = {k: "new" if k not in plain[0] else "gone" if k not in plain[1] else "changed" for k in plain[0].keys() | plain[1].keys() if plain[0].get(k) != plain[1].get(k)}
    assert told == expected and set(told.values()) >= {"new", "gone"}
