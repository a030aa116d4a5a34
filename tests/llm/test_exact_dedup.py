from collections import defaultdict

import pytest

from tallyforge.llm.exact_dedup import dedup_groups, drop_copies

SCHEMA = "doc_id bigint, text string, digest string, rank int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("support", [0.0001, 0.3])
def test_groups(spark, support):
    rows = [(5, "a b"), (3, "a \t\n b"), (9, ""), (8, None), (7, " "), (1, "x" * 300_000), (2, "é"), (3, "a b"), (None, "é")]
    rows += [(100 + i, "hot  text") for i in range(50)]
    got = dedup_groups(rows_of(spark, rows), support=support).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert sorted(len(v) for v in by.values()) == [1, 1, 2, 2, 3, 50]
    for members in by.values():
        assert sum(m.kept for m in members) == 1
        assert {m.group_size for m in members} == {len(members)}
        assert {m.keep_id for m in members} == {min(m.doc_id for m in members if m.doc_id is not None)}


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    docs = rows_of(spark, [(1, "a"), (1, "a"), (2, "a"), (3, None), (4, ""), (None, "q"), (5, "z")])
    got = drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect() if r.text is not None) == [(-1, "q"), (1, "a"), (5, "z")]
    assert got.where("doc_id = 3").count() == 1 and got.count() == 4


def test_empty(spark):
    assert dedup_groups(rows_of(spark, [])).count() == 0
    assert drop_copies(rows_of(spark, [])).count() == 0
