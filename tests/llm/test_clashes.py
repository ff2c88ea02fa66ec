"""Extra columns named like the operators' own ones pass through every operator and stage unchanged."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from broadsheet import llm
from broadsheet.llm import mixing, pagetext, quality, sharding, simhash, substring, warc

#: Every name with an underscore in front that the subpackage's code holds, some of its plain ones, and an odd one.
NAMES = sorted({n for f in Path(llm.__file__).parent.glob("*.py") for n in re.findall(r"[\"'.](_[a-z][a-z0-9_]*)[\"'.\]]", f.read_text())} - {"_metadata"})
EXTRA = [*NAMES, "w0", "word", "d0", "u", "v", "m", "node", "component", "size", "bands", "marks", "od.d `name`", "_Spans_"]

TEXTS = ["one two three four five six", None, "", "one two three four five six", "Quite another text, with other words."]


def extended(spark, rows, schema):
    plain = spark.createDataFrame(rows, schema)
    extra = [name for name in EXTRA if name.lower() not in {c.lower() for c in plain.columns}]
    return plain.selectExpr("*", *[f"'{at}' AS `{name.replace('`', '``')}`" for at, name in enumerate(extra)]), extra


def check(result, extra, added=()):
    for name in extra:
        assert result.columns.count(name) == 1
    for row in result.collect():
        for at, name in enumerate(extra):
            assert name in added or row[name] == str(at), name


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (1, None, "en", "s", 0)]
    return extended(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(0, 1), (4, 0), (2, 1)], "doc_id long, quality int")


def test_document_operators(docs, labels):
    df, extra = docs
    model, _ = quality.train(df, labels, rounds=1)
    check(quality.score(df, model), extra, ["_scores"])
    check(quality.keep_good(df, labels, threshold=0.0, rounds=1), extra)
    check(mixing.plan_mix(df), extra, ["_plan"])
    check(mixing.mix_documents(df), extra)
    check(sharding.with_slots(sharding.assign_shards(df, sharding.layout(3))), extra)
    check(simhash.drop_near_duplicates(df), extra)
    check(simhash.drop_near_duplicates(df, jaccard=0.8), extra)
    check(substring.dedup_substrings(df), extra, ["_spans"])


def test_page_operators(spark):
    rows = [(1, "http://a.example/1", "<p>x</p><p>y</p>"), (2, "http://a.example/2", "<p>x</p><p>z</p>"), (3, None, None), (None, "u", "<p>x</p>"), (2, "http://a.example/2", "<p>x</p><p>z</p>")]
    df, extra = extended(spark, rows, "page_id long, url string, html string")
    check(pagetext.extract_text(df), extra, ["_text"])
    assert warc.archive_round_trip(df).count() == len(rows)


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_extra_columns_nulls_and_repeated_rows(spark, docs, labels, tmp_path, at):
    df, extra = docs
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    result = corpus_pipeline.STAGES[at][1](spark, df, str(tmp_path))
    assert result.columns == df.columns
    check(result, extra)
    assert corpus_pipeline.STAGES[at][1](spark, df.limit(0), str(tmp_path)).count() == 0


def test_last_stage_takes_extra_columns_nulls_and_an_empty_table(spark, docs):
    df, _ = docs
    stage = corpus_pipeline.STAGES[-1][1]
    rows = stage(spark, df, "").collect()
    assert len(rows) == df.count() and all(r.round_trip for r in rows)
    assert stage(spark, df.limit(0), "").count() == 0
