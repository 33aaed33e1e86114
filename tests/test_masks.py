"""Mask patterns, rule lookup, PII detection by name."""

import pytest
from pyspark.sql import functions as F

from branchdata.operators import catalog as CT
from branchdata.operators import masking as M


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "alice@example.com", "555-123-4567", "x"), (2, None, "12", "y"), (3, "c@d.e", None, "z")],
        "id int, email string, ssn string, note string")


def test_static_mask_fills_nulls_and_quotes(spark, people):
    out = M.mask_frame(people, "people", {"people.email": "it's hidden"}, id_col="id")
    assert [r.email for r in out.orderBy("id").collect()] == ["it's hidden"] * 3


def test_id_mask_and_last4(spark, people):
    rules = {"email": "masked_{{id}}@example.com", "people.ssn": "***-**-{{last4}}"}
    out = M.mask_frame(people, "people", rules, id_col="id").orderBy("id").collect()
    assert [r.email for r in out] == ["masked_1@example.com", "masked_2@example.com", "masked_3@example.com"]
    # NULL stays NULL, short values are kept whole
    assert [r.ssn for r in out] == ["***-**-4567", "***-**-12", None]
    assert [r.note for r in out] == ["x", "y", "z"]


def test_both_placeholders_in_one_pattern(spark, people):
    out = M.mask_frame(people, "people", {"people.ssn": "{{id}}:{{last4}}:{{id}}"}, id_col="id")
    assert out.orderBy("id").first().ssn == "1:4567:1"


def test_column_placeholder_gives_name_not_value(spark, people):
    out = M.mask_frame(people, "people", {"people.note": "<{{note}}>"}, id_col="id")
    assert {r.note for r in out.collect()} == {"<note>"}


def test_table_rule_beats_bare_rule(spark, people):
    out = M.mask_frame(people, "people", {"email": "BARE", "PEOPLE.EMAIL": "TABLE"}, id_col="id")
    assert {r.email for r in out.collect()} == {"TABLE"}


def test_fail_closed(spark, people):
    with pytest.raises(ValueError):
        M.mask_frame(people, "people", {"people.missing": "x"}, id_col="id")
    with pytest.raises(ValueError):
        M.mask_frame(people, "people", {"email": "m_{{id}}"}, id_col=None)


def test_nested_rules_flatten():
    assert M.flatten_rules({"users": {"Email": "a"}, "phone": "b"}) == {"users.email": "a", "phone": "b"}


def test_pii_names_first_rule_wins(spark):
    frame = spark.createDataFrame([], "email string, client_ip string, zip string, description string, "
                                      "company_name string, first_name string, name string")
    cat = CT.catalog_of(spark, {"t": frame})
    got = {r.column_name: r.rule for r in M.pii_detect(cat).collect()}
    # substring matching: description hits "ip", company_name hits "pan"; plain name is not hit
    assert got == {"email": "email", "client_ip": "ip", "zip": "address", "description": "ip",
                   "company_name": "card", "first_name": "name"}
    word = {r.column_name: r.rule for r in M.pii_detect(cat, match="word").collect()}
    assert "description" not in word and "company_name" not in word and word["client_ip"] == "ip"


def test_masked_values_never_stored_raw(spark, people, tmp_path):
    path = str(tmp_path / "m")
    M.mask_frame(people, "people", {"email": "masked_{{id}}@example.com"}, id_col="id").write.parquet(path)
    stored = spark.read.parquet(path)
    leaks = M.leak_check(people, stored, "id", ["email"]).first().leaks
    assert leaks == 0


def test_static_mask_prunes_raw_column(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "secret")], "id int, s string").write.parquet(path)
    plan = M.mask_frame(spark.read.parquet(path), "t", {"t.s": "***"}, id_col="id")._jdf \
        .queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in plan


def test_masks_keep_the_column_type(spark):
    rows = spark.sql("select 7L as id, 12.5D as pay, date'2024-05-06' as born, 'x' as note")
    rules = {"t.pay": "0", "t.born": "1970-01-01", "t.note": "n{{id}}"}
    out = M.mask_frame(rows, "t", rules, id_col="id")
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "double", "date", "string"]
    r = out.first()
    assert (r.pay, str(r.born), r.note) == (0.0, "1970-01-01", "n7")
    text = M.mask_frame(rows, "t", {"t.pay": "hidden"}, as_text=("pay",))
    assert text.schema["pay"].dataType.simpleString() == "string" and text.first().pay == "hidden"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        M.mask_frame(rows, "t", {"t.pay": "hidden"}).collect()
