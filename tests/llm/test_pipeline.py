import corpus_pipeline
from conftest_data import DATA
from odd import no_docs, odd_docs
from pyspark.sql import functions as F
from test_near_dup import brute

from sluice.llm import mixing, packing
from sluice.llm.common import read


def test_stages_by_brute_force(spark):
    docs = read(spark, DATA, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, DATA)
    assert kept.columns == columns
    want = {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept.collect()} == want
    kept = stages["exact_dedup"](spark, kept, DATA)
    last = {}
    for i in want:
        last[rows[i].text] = max(i, last.get(rows[i].text, -1))
    want = set(last.values())
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns
    kept = stages["near_dup"](spark, docs.where(docs.doc_id.isin(list(want))), DATA)
    want = {c for _, c, *_ in brute([(i, rows[i].text) for i in sorted(want)])}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns
    left = docs.where(docs.doc_id.isin(list(want)))
    mixed = stages["mixing"](spark, left, DATA)
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect() if r.copies}
    found = {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == copies and mixed.columns == columns
    pieces = corpus_pipeline.run(spark, DATA)
    words = packing.word_ids(packing.TOKENIZER)
    total = {}
    for r in pieces.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: n * (len(words.ids(rows[i].text)) // 2 + 1) for i, n in copies.items()}


def through(spark, rows, folder):
    rows.write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, ids on several rows and extra columns with clashing names."""
    got = through(spark, odd_docs(spark), tmp_path / "odd")
    assert got and {r.doc_id for r in got} <= {5, 7, 9, 10, None, 12, 13}
    pieces = {(r.doc_id, r.start, r.sequence_id, r.offset) for r in got}
    assert len(pieces) == len(got)


def test_no_labels_of_language(spark, tmp_path):
    rows = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in through(spark, rows, tmp_path / "none")} <= {5, 7, 9, 10, None, 12, 13}
    kept = corpus_pipeline.identify_language(spark, rows, "")
    assert kept.columns == rows.columns and kept.count() == 10


def test_empty_table(spark, tmp_path):
    assert through(spark, no_docs(spark), tmp_path / "empty") == []
