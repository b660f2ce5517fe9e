from listwarden.llm import pii

DE, GB, NO = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
#: text and the account numbers in it
CASES = [
    (f"IBAN {DE} BIC COBADEFFXXX", [DE]), (f"bank {NO} 250 EUR", [NO]), (f"IBAN {DE} {GB} {NO}", [DE, GB, NO]), (f"account NR12 {GB} ACME LTD", [GB]),
    (f"é IBAN {DE.replace(' ', '')} BIC", [DE.replace(" ", "")]), (f"IBAN {DE}", [DE]), (f"IBAN {DE}X BIC", []), ("IBAN DE89 3704 0044 0532 0130 01 BIC", []),
    (f"bank {'AB12 ' * 2_000}{DE} BIC", [DE]),
]


def test_account_numbers_before_capitals_and_numbers(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: [CASES[r.doc_id][0][s.start : s.end] for s in r.found if s.kind == "iban"] for r in pii.detect(docs).collect()}
    assert [got[k] for k in range(len(CASES))] == [numbers for _, numbers in CASES]
