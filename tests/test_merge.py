import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.errors import DuplicateKeys, NullKey, SchemaMismatch, UnprocessedKeys
from sluice.operators import layout, merge, validate

SCHEMA = "a long, b float, c string, seen string"
COMPARE = ["a", "b", "c"]


def rows(spark, keys, changed=(), seen="old"):
    return spark.createDataFrame([(k, float(k), f"s{k}" + ("-modified" if k in changed else ""), seen) for k in keys], SCHEMA)


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "a long")


def packed(df, file_rows):
    found = layout.with_file_index(df.withColumn("_part", F.lit("0")), ["a"], file_rows).orderBy("a").collect()
    out = {}
    for r in found:
        out.setdefault(r["_file"], []).append((r.a, r.c))
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("small", [True, False])
def test_merge_of_files(spark, small):
    got = merge.merge(rows(spark, [0, 1, 2, 3, 10]), rows(spark, [3, 4], [3]), ["a"], COMPARE, keys(spark, [2, 3, 4]), broadcast_new=small)
    assert packed(got, 2) == [[(0, "s0"), (1, "s1")], [(3, "s3-modified"), (4, "s4")], [(10, "s10")]]


def test_merge_of_records(spark):
    got = merge.merge(rows(spark, [0, 1, 2]), rows(spark, [3, 4]), ["a"], COMPARE, keys(spark, [2, 3, 4]))
    assert packed(got, 2) == [[(0, "s0"), (1, "s1")], [(3, "s3"), (4, "s4")]]


def test_equal_rows_keep_the_old_row_whole(spark):
    got = merge.merge(rows(spark, [1, 2]), rows(spark, [1, 2], [2], seen="new"), ["a"], COMPARE)
    assert {r.a: r.seen for r in got.collect()} == {1: "old", 2: "new"}


@pytest.mark.parametrize(("base", "new", "gone", "want"), [([1, 9], [1], [1, 9], [1]), ([5], [3, 7], [3, 5, 7], [3, 7]), ([1, 2], [], [1], [2]), ([], [], [], [])])
def test_deletes(spark, base, new, gone, want):
    got = merge.merge(rows(spark, base), rows(spark, new), ["a"], COMPARE, keys(spark, gone))
    assert sorted(r.a for r in got.collect()) == want


small_maps = st.dictionaries(st.integers(0, 12), st.one_of(st.none(), st.integers(0, 2)), max_size=10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(small_maps, small_maps, st.sets(st.integers(0, 12)), st.booleans())
def test_merge_is_the_table_of_actions(spark, base, new, gone, small):
    frame = lambda d: spark.createDataFrame(list(d.items()), "a long, b int")
    found = merge.classify(frame(base), frame(new), ["a"], ["a", "b"], keys(spark, gone), broadcast_new=small)
    got = {r[0]: r[1] for r in found.select(F.coalesce("s.a", "b.a"), merge.ACTION).collect()}
    want = {k: "inserted" if k not in base else "unchanged" if base[k] == new[k] else "updated" for k in new}
    want |= {k: "deleted" if k in gone else "untouched" for k in base if k not in new}
    assert got == want
    state = {r.a: r.b for r in merge.apply(found).collect()}
    assert state == {k: new.get(k, base.get(k)) for k, action in want.items() if action != "deleted"}


def test_schemas_must_be_equal(spark):
    with pytest.raises(SchemaMismatch):
        merge.merge(rows(spark, [1]), keys(spark, [1]), ["a"], ["a"])


def test_batch_checks(spark):
    processed = keys(spark, [0, 1, 2, 3])
    validate.check_batch(keys(spark, [0, 1, 2]), ["a"], processed)
    with pytest.raises(DuplicateKeys):
        validate.check_batch(keys(spark, [0, 1, 1, 2]), ["a"], processed)
    with pytest.raises(UnprocessedKeys):
        validate.check_batch(keys(spark, [0, 1, 2]), ["a"], keys(spark, [0, 2, 3]))
    with pytest.raises(NullKey):
        validate.check_batch(keys(spark, [0, None]), ["a"], processed)


def test_late_rows_are_refused(spark):
    frame = lambda v: spark.createDataFrame(v, "a long, v int, _produced_ts long")
    base = frame([(1, 1, 5), (2, 1, 5), (3, 1, 5)])
    new = frame([(1, 2, 4), (2, 2, 5), (3, 2, 6), (4, 2, 1)])
    got = merge.merge(base, new, ["a"], ["v", "_produced_ts"], merge_filter=merge.newer())
    assert {r.a: r.v for r in got.collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_small_batches_leave_the_base_unshuffled(spark):
    found = merge.classify(spark.range(1000).toDF("a"), keys(spark, [1]), ["a"], ["a"], broadcast_new=True)
    assert "Exchange hashpartitioning" not in found.select("b")._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_field_ids(spark):
    found = layout.with_field_ids(rows(spark, [1])).schema
    assert [f.metadata["parquet.field.id"] for f in found] == [0, 1, 2, 3]
