from checks import views as V
from listwarden.operators import screening


def test_a_list_is_stored_as_it_is_prepared(spark, sf_dir, tmp_path):
    listed = V.nested_entities(spark, sf_dir)
    plain, stored = screening.prepare_list(listed), screening.prepare_list(listed, folder=str(tmp_path))
    read = screening.read_prepared(spark, str(tmp_path))
    for name in screening.TABLES:
        rows = [sorted(map(str, getattr(p, name).collect())) for p in (plain, stored, read)]
        assert rows[0] == rows[1] == rows[2] and rows[0]
    assert all(getattr(plain, n) == getattr(read, n) for n in screening.SIZES)
