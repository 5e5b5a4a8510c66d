import pytest
from oracle import bags, connect

from lexwarden.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name not in ORACLE:
        assert name in ("p3_found", "p3_value_counts")  # checked below
        return
    ours, theirs = bags(df, con, ORACLE[name])
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_packed_values_against_their_fields(spark, sf_dir, con):
    """Every value stands in its field in the order of its place; fields without separators hold one."""
    for name, key, field in (("nemotron_raw", "raw_id", "violated_categories"), ("predictions", "pred_id", "safety_categories")):
        texts = dict(con.execute(f"SELECT {key}, {field} FROM {name}").fetchall())
        rows = catalog.queries()["p3_found"](spark, sf_dir).where(f"field = '{field}'").orderBy("row_key", "pos").collect()
        values = {}
        for r in rows:
            values.setdefault(r.row_key, []).append(r.value)
            assert r.pos == len(values[r.row_key])
        assert values
        for row_key, found in values.items():
            assert len(found) >= 2
            at = 0
            plain = texts[row_key].replace('""', '"').replace("\\", "")
            for value in found:
                at = plain.find(value, at)
                assert at >= 0, (texts[row_key], found)
                at += len(value)
    counts = {(r.field, r.value): r.n_values for r in catalog.queries()["p3_value_counts"](spark, sf_dir).collect()}
    assert sum(counts.values()) >= len(rows)
