"""The pipeline: stages in order, columns kept, decisions as the operators make them."""

import corpus_pipeline as p
import __spark_entry__ as entry
from logloom.llm import decontaminate, line_dedup, packing, simhash_dedup, toxicity
from logloom.llm.common import staged, table
from logloom.llm.registry import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_and_their_decisions(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    outs = [docs]
    for _, stage in p.STAGES:
        outs.append(staged(stage(spark, outs[-1], SF), "test-stage"))
        if len(outs) < 6:
            assert outs[-1].columns == docs.columns and outs[-1].dtypes == docs.dtypes
    model, thresholds = toxicity.fit(docs, table(spark, SF, "labels"))
    scorer = toxicity.Scorer(model)
    assert texts(outs[1]) == sorted(
        ((r.doc_id, r.text) for r in docs.collect() if scorer.score(r.text or "") < thresholds.get(r.lang, thresholds[""])), key=str
    )
    assert [i for i, _ in texts(outs[2])] == [i for i, _ in texts(outs[1])]
    assert texts(outs[2]) == texts(line_dedup.dedup_lines(outs[1], ratio=p.SOURCE_LINE_RATIO))
    components = {(r.doc_id): r.component_id for r in simhash_dedup.near_duplicates(outs[2]).collect()}
    assert [i for i, _ in texts(outs[3])] == sorted(set(components.values()), key=str)
    leaked = {r.doc_id for r in decontaminate.find_leaks(outs[3], table(spark, SF, "benchmark")).collect()}
    assert [i for i, _ in texts(outs[4])] == [i for i, _ in texts(outs[3]) if i not in leaked]
    assert {r.doc_id for r in outs[5].collect()} == {i for i, _ in texts(outs[4])}
    whole = p.run(spark, SF)
    assert whole.columns == outs[5].columns and whole.count() == outs[5].count()


def test_a_large_group_of_copies_ends_as_one_full_document(spark):
    """1,000 copies in 10,000 rows, and three copies in a small source; menu lines still go."""
    copy = "\n".join(f"line {k} of the copied text tells of matter {k * k}" for k in range(8))
    small = "first line of a text in a small source\nand its second line"
    rows = [(i, copy, "en", "big", 0) for i in range(1000)]
    rows += [(i, f"menu of the site\nbody {i} speaks of {i * 7919} and {i * 104729}", "en", "big", 0) for i in range(1000, 10_000)]
    rows += [(20_000 + i, small, "en", "small", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lined = staged(p.drop_boilerplate(spark, docs, SF), "test-copies")
    assert lined.where("text LIKE '%menu of the site%'").count() == 0 and lined.count() == len(rows)
    kept = p.drop_near_copies(spark, lined, SF)
    assert [r.doc_id for r in kept.where(F.col("text") == copy).collect()] == [0]
    assert [r.doc_id for r in kept.where(F.col("text") == small).collect()] == [20_000]
    assert kept.where("text = ''").count() == 0


def test_odd_documents(spark):
    rows = [
        (None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "line\n" * 50_000, "en", None, 9),
        (4, "some words of a text", "xx", "s", 20), (4, "some words of a text", "xx", "s", 20),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in p.STAGES:
            docs = staged(stage(spark, docs, SF), "test-odd")
    full = spark.createDataFrame(rows, schema)
    kept = simhash_dedup.keep_one(full).collect()
    assert len(kept) == 3  # no words (three rows and one empty text), the long text, the short one
    assert packing.pack(full).count() >= len(rows)


def test_everything_is_registered():
    assert set(QUERIES) == {
        "op1_decontaminate", "op2_chat_format", "op3_token_counts", "op4_warc", "op5_substring_dedup", "op6_toxicity", "op7_simhash_dedup",
        "op8_quality_rules", "op9_line_dedup", "op10_pack",
    }
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    assert entry.queries()["pipeline"] is p.run
