"""Compaction gives the same answers, can be run again, and switches only to what is whole."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from walletlens.operators import reports, scoring
from walletlens.sources import report_store
from walletlens.sources.report_files import read_reports
from walletlens.sources.tables import given_candidates


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    scored = scoring.score_candidates(given_candidates(spark, sf_dir)).filter("user_id < '3'")
    first = reports.assemble_reports(scoring.override_approach(scored, {}))
    return first.cache(), reports.assemble_reports(scoring.best_approach(scored)).cache()


def shown(df):
    return sorted(map(repr, reports.report_rows(df).collect()))


def test_same_answers_before_and_after(spark, made, tmp_path):
    store = str(tmp_path / "store")
    report_store.store_reports(made[0], store, dt.datetime(2024, 2, 1))
    report_store.store_reports(made[1].filter("metadata.user_id < '2'"), store, dt.datetime(2024, 2, 2))
    before = shown(report_store.read_store(spark, store))
    assert before
    assert report_store.compact(spark, store) == 1
    assert shown(report_store.read_store(spark, store)) == before
    users = report_store.read_store(spark, store).count()
    lines = spark.read.text(f"{store}/generation-1").count()
    assert lines == users < spark.read.text(f"{store}/generation-0").count()
    # An older run than the compacted versions replaces nothing, a newer one does.
    report_store.store_reports(made[0], store, dt.datetime(2024, 1, 1))
    assert shown(report_store.read_store(spark, store)) == before
    report_store.store_reports(made[1], store, dt.datetime(2024, 2, 3))
    after = shown(report_store.read_store(spark, store))
    assert after != before and report_store.compact(spark, store) == 2
    assert shown(report_store.read_store(spark, store)) == after
    assert report_store.drop_generations(spark, store) == [0, 1]
    assert report_store.drop_generations(spark, store) == []
    assert shown(report_store.read_store(spark, store, 2024, "January")) == after
    assert report_store.read_store(spark, store, 2023).count() == 0


def test_a_compaction_that_failed_changes_nothing_and_can_be_run_again(spark, made, tmp_path):
    store = str(tmp_path / "store")
    report_store.store_reports(made[1], store, dt.datetime(2024, 2, 1))
    before = shown(report_store.read_store(spark, store))
    # What a lost job leaves: a part of the next generation without its mark.
    half = made[0].limit(1).select("*", F.lit(None).cast("timestamp_ntz").alias("run_ts"), F.lit(2024).alias("year"), F.lit("May").alias("month"))
    half.write.partitionBy("year", "month").json(f"{store}/generation-1")
    assert report_store.generations(spark, store) == [0]
    assert shown(report_store.read_store(spark, store)) == before
    assert report_store.compact(spark, store) == 1
    assert shown(report_store.read_store(spark, store)) == before
    assert shown(read_reports(spark, f"{store}/generation-1")) == before


def test_older_files_keep_their_fields(spark, tmp_path):
    (tmp_path / "store" / "generation-0" / "year=2025" / "month=April").mkdir(parents=True)
    old = '{"metadata":{"user_id":"u","year":2025,"month":"April"},"report_components":{"a":"text"},"evaluation":{"a":{"ethical_flag":"Safe","confidence":0.5,"similarity_score":0.25}},"chosen_approaches":{"a":"few_shot"}}'
    (tmp_path / "store" / "generation-0" / "year=2025" / "month=April" / "r.json").write_text(old + "\n")
    store = str(tmp_path / "store")
    before = shown(report_store.read_store(spark, store))
    report_store.compact(spark, store)
    assert shown(report_store.read_store(spark, store)) == before and "few_shot" in before[0]
