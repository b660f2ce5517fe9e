import random
import time
from listwarden.llm import decontaminate

ITEM = " ".join(f"w{k}" for k in range(20))


def _run(spark, docs, items):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, n int")
    return frame, spark.createDataFrame(items, "item_id long, text string")


def _judged(spark, docs, items, **more):
    frame, benchmark = _run(spark, docs, items)
    return sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.judge(frame, benchmark, **more).collect())


def test_windows_short_items_overlaps_and_odd_rows(spark):
    docs = [
        (1, "x " * 5 + ITEM.upper().replace(" ", "...") + " y" * 200), (2, " ".join(ITEM.split()[:12])), (3, None), (4, "?!"), (5, "it is short item here"),
        (6, "short-item " * 3), (7, "short-item " * 3), (7, "other"), (None, ITEM), (8, ITEM), (8, ITEM), (9, "z " * 100_000 + ITEM),
    ]
    items = [(10, ITEM), (9, ITEM + " more"), (3, "Short item"), (4, None), (5, " "), (10, ITEM)]
    expected = sorted([
        (1, 225, 20, ["10", "9"], True), (2, 12, 0, [], False), (3, 0, 0, [], False), (4, 0, 0, [], False), (5, 5, 2, ["3"], True), (6, 6, 6, ["3"], True),
        (7, 6, 6, ["3"], True), (7, 1, 0, [], False), (-1, 20, 20, ["10", "9"], True), (8, 20, 20, ["10", "9"], True), (8, 20, 20, ["10", "9"], True),
        (9, 100_020, 20, ["10", "9"], False),
    ])
    assert _judged(spark, docs, items) == expected
    assert _judged(spark, docs, items, broadcast_windows=0, broadcast_documents=0) == expected


def test_clean_keeps_columns_and_other_rows(spark):
    frame, benchmark = _run(spark, [(1, ITEM), (1, "fine"), (None, ITEM), (2, None)], [(1, ITEM)])
    got = decontaminate.clean(frame, benchmark)
    assert got.columns == frame.columns and sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, "fine"), (2, "")]


def test_empty_tables(spark):
    assert _judged(spark, [], [(1, ITEM)]) == []
    assert _judged(spark, [(1, ITEM)], []) == [(1, 20, 0, [], False)]


def test_a_long_contaminated_document_in_time(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(32))) for k in range(60)]
    text = " ".join(rng.choice(items)[1] for _ in range(1600))
    docs = spark.createDataFrame([(1, text), (2, "own words only " * 20_000)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in decontaminate.judge(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - start < 60
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (51_200, 51_200, 60, True) and got[2].n_hit == 0
