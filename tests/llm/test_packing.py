import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from listwarden.llm import packing

TEXTS = [None, "", "a", "The cat sat. " * 900, "é ü 漢字 \n\n  x\t\t" * 50, " " * 3000 + "end", "one <|endoftext|> two", "x" * 20_000, "The cat sat. " * 900, "a"]


def test_ids_pieces_and_places(spark):
    rows = [(k if k != 2 else None, t, 7, "z") for k, t in enumerate(TEXTS)] + [(9, "a", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id string")
    got = packing.pack_documents(docs, 256).toPandas()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text, _, _ in rows[:-2]:
        own = got[got["doc_id"].isna() if doc_id is None else got["doc_id"] == doc_id].sort_values("piece")
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in own["ids"]])
        assert ids.tolist() == exact.encode(text or "", add_special_tokens=False).ids + [2]
        assert own["start"].tolist() == [0, *own["length"].cumsum()[:-1]] and set(own["length"][1:]) <= {256}
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 256
    assert len(got[got["doc_id"] == 9]) == 2


def _best_fit_decreasing(histogram):
    free, count = [0] * 1025, 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = next((r for r in range(length, 1025) if free[r]), None)
            if room is None:
                room, count = 1024, count + 1
            else:
                free[room] -= 1
            free[room - length] += 1
    return count


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(3)
    for histogram in ({5: 3}, {1024: 4, 512: 5}, {600: 10, 424: 7, 3: 1000}, {int(k): int(n) for k, n in zip(rng.integers(1, 1024, 300), rng.integers(1, 30, 300))}):
        plan = packing.plan(histogram)
        sequences = {}
        for length, rows in plan.groupby("length"):
            ends = [*rows["first"].iloc[1:], histogram[length]]
            for row, end in zip(rows.itertuples(), ends):
                assert (end - row.first) % row.times == 0
                for nth in range(end - row.first):
                    sequences.setdefault(row.sequence + nth // row.times, []).append((row.offset + nth % row.times * length, length))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(sequences) <= _best_fit_decreasing(histogram)


def test_fullest_is_the_best_subset_sum():
    assert dict(packing.fullest([7, 5, 3], {7: 1, 5: 1, 3: 1}, 9)) == {5: 1, 3: 1}
    assert dict(packing.fullest([4], {4: 9}, 14)) == {4: 3}
    assert packing.fullest([9], {9: 1}, 8) == []


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
