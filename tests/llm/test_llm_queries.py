from collections import Counter, defaultdict

import pytest
from oracle import bags, connect

from lexwarden.llm import queries as Q
from lexwarden.llm.garble import examine
from lexwarden.llm.overlap import near_same
from lexwarden.llm.wording import bare, marked
from lexwarden.session import table


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, sf_dir, con, name):
    ours, theirs = bags(Q.queries()[name](spark, sf_dir), con, Q.oracle_sql()[name])
    assert ours == theirs


def run(spark, sf_dir, name):
    return Q.queries()[name](spark, sf_dir).collect()


def test_report_and_sample_agree(spark, sf_dir, con):
    report = {r.target_id: r for r in run(spark, sf_dir, "p1_report")}
    sample = run(spark, sf_dir, "p1_sample")
    targets = con.execute("SELECT target_id, plan, sample_size FROM sample_targets").fetchall()
    assert set(report) == {t for t, _, _ in targets}
    assert len(sample) == len({(r.plan, r.example_id) for r in sample}) == sum(r.drawn for r in report.values())
    drawn = Counter(r.plan for r in sample)
    assert all(drawn[plan] <= max(size, sum(1 for _, p, _ in targets if p == plan)) for _, plan, size in targets)
    assert all(r.met == (r.available >= r.wanted) and r.drawn <= r.available and (r.missing == 0) == r.met for r in report.values())
    assert {r.target_id for r in run(spark, sf_dir, "p1_found")} == {k for k, r in report.items() if not r.met}


def test_defects_by_language_agree(spark, sf_dir):
    found, report = run(spark, sf_dir, "p2_found"), run(spark, sf_dir, "p2_report")
    assert found and Counter(r.defect for r in found) == sum((Counter({r.defect: r.n_records}) for r in report), Counter())


def test_pairs_and_their_report_agree(spark, sf_dir, con):
    found = {(r.row_id_a, r.row_id_b) for r in run(spark, sf_dir, "p4_found")}
    rows = {k: (split, source, prompt) for k, split, source, prompt in con.execute("SELECT row_id, source_split, dataset_source, prompt FROM canonical_examples").fetchall()}
    forms = {k: marked(v[2] or "") for k, v in rows.items()}
    train, held = [k for k, v in rows.items() if v[0] == "train"], [k for k, v in rows.items() if v[0] in ("valid", "test")]
    want = {(min(a, b), max(a, b)) for a in train for b in held if forms[a] and abs(len(forms[a]) - len(forms[b])) * 8 <= max(len(forms[a]), len(forms[b])) and near_same(forms[a], forms[b])}
    assert found == want
    report = run(spark, sf_dir, "p4_report")
    assert sum(r.n_pairs for r in report) == len(found)


def test_splits_keep_sources_together(spark, sf_dir, con):
    assigned = {r.row_id: r.assigned_split for r in run(spark, sf_dir, "p5_splits")}
    assert len(assigned) == con.execute("SELECT count(*) FROM canonical_examples").fetchone()[0] and None not in assigned.values()
    keys = con.execute(f"SELECT row_id, k FROM ({Q._SOURCE_SQL})").fetchall()
    places = defaultdict(set)
    for row, key in keys:
        places[key].add(assigned[row])
    assert all(len(p) == 1 for p in places.values())
    assert sum(r.n_rows for r in run(spark, sf_dir, "p5_report")) == len(assigned)


def test_tokens_and_their_budget_agree(spark, sf_dir, con):
    tokens, budget = run(spark, sf_dir, "p6_tokens"), run(spark, sf_dir, "p6_budget")
    total = [c for c in budget[0].__fields__ if "token" in c][0]
    count = [c for c in tokens[0].__fields__ if "token" in c][0]
    assert sum(getattr(r, total) for r in budget) == sum(getattr(r, count) or 0 for r in tokens) > 0
    ids = {r.doc_id: r.ids for r in run(spark, sf_dir, "p7_ids")}
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert set(ids) == set(texts) and all((ids[k] == []) == (not v) for k, v in texts.items())


def test_passages_and_reports_agree(spark, sf_dir, con):
    texts, items = (dict(con.execute(q).fetchall()) for q in ("SELECT doc_id, text FROM documents", "SELECT item_id, text FROM eval_items"))
    passages = run(spark, sf_dir, "p8_passages")
    assert {(r.doc_id, r.item_id) for r in passages} == {tuple(r) for r in run(spark, sf_dir, "p8_found")}
    for r in passages:
        passage = bare(texts[r.doc_id][r.passage_from : r.passage_to])
        item = bare(items[r.item_id])
        grams = {item[i : i + 3] for i in range(len(item) - 2)}
        assert sum(passage[i : i + 3] in grams for i in range(len(passage) - 2)) >= 0.7 * (len(passage) - 2)
    assert sum(r.n_doc_items for r in run(spark, sf_dir, "p8_report")) == len(passages)


def test_restored_texts_differ_and_are_right(spark, sf_dir, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    restored = run(spark, sf_dir, "p9_restored")
    assert {r.doc_id for r in restored} == {r.doc_id for r in run(spark, sf_dir, "p9_found")}
    for r in restored:
        assert r.restored is None or r.restored != texts[r.doc_id] and examine(r.restored) is None


@pytest.fixture
def empty_dir(spark, sf_dir, tmp_path):
    for name in ("nemotron_raw", "canonical_examples", "sea_examples", "predictions", "documents", "eval_items", "sample_targets", "split_targets"):
        table(spark, sf_dir, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert Q.queries()[name](spark, empty_dir).count() == 0


def test_no_row_twice(spark, sf_dir):
    for name in ("p2_found", "p4_found", "p5_found", "p7_ids", "p8_found", "p9_found", "p1_found"):
        df = Q.queries()[name](spark, sf_dir)
        keys = [c for c in df.columns if c not in ("ids", "defect")]
        assert df.count() == df.select(*keys).distinct().count(), name
