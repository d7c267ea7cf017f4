"""Registered queries on prompts, scoring and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.functions.text import PLACEHOLDER
from walletlens.functions.vectors import dot
from walletlens.operators import reports, scoring
from walletlens.operators.generation import ask_once, generate, summary_writer
from walletlens.operators.profile import profile_text
from walletlens.operators.prompts import COMPONENTS, catalogue_rows, fan_out
from walletlens.plans import oracle
from walletlens.session import scratch_path
from walletlens.sources.report_files import read_reports, write_reports
from walletlens.sources.report_store import compact, drop_generations, read_store, store_reports
from walletlens.sources.tables import event_transactions, given_candidates, table


def _prompts(spark: SparkSession, sf_dir: str, components: list[str] | None = None) -> DataFrame:
    return fan_out(profile_text(event_transactions(spark, sf_dir)).filter("has_data"), components)


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five components, also the three that reports leave out by default."""
    return _prompts(spark, sf_dir, COMPONENTS).drop("profile_text")


def generated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = generate(_prompts(spark, sf_dir), summary_writer())
    return outputs.select("user_id", "year", "month", "component", "approach", "output_text")


def _failing_for(factory, ending: str):
    """A generator that cannot answer in one style for users whose id ends like this."""

    def made():
        answer = factory()

        def checked(batch):
            bad = batch["profile_text"].str.contains(rf"^User \d*{ending} ") & (batch["approach"] == "few_shot")
            if bad.any():
                raise RuntimeError("no answer")
            return answer(batch)

        return checked

    return made


def answers_asked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of even users are asked by a generator that fails at some, then all of them by one that does not."""
    ledger, prompts = scratch_path(spark, "answers"), _prompts(spark, sf_dir)
    even = prompts.filter("CAST(user_id AS BIGINT) % 2 = 0")
    ask_once(even, _failing_for(summary_writer(), "0"), ledger, "summary-1")
    found = ask_once(prompts, summary_writer(), ledger, "summary-1", waves=2)
    again = ask_once(prompts, _failing_for(summary_writer(), ""), ledger, "summary-1")
    keys = ["user_id", "year", "month", "component", "approach"]
    again = again.select(*keys, F.col("n_asked").alias("n_asked_later"))
    return found.join(again, keys).select(*keys, "output_text", "error", "n_asked", "n_asked_later")


def template_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_candidates(spark, sf_dir).select(
        "user_id",
        "component",
        "approach",
        dot(F.col("template_embedding"), F.col("output_embedding")).alias("similarity"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_candidates(given_candidates(spark, sf_dir))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "user_id", "year", "month", "component", "approach", "ethical_flag", "similarity", "score"
    )


def best_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_approach(_scored(spark, sf_dir)).select(
        "user_id", "year", "month", "component", "approach", "score"
    )


def approach_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for a style of their summary; everyone else gets the fallback."""
    asked = table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS user_id",
        "2024 AS year",
        "1 AS month",
        "'executive_summary' AS component",
        "CASE WHEN c_acctbal > 5000 THEN 'few_shot' ELSE 'zero_shot' END AS approach",
    )
    return scoring.override_approach(_scored(spark, sf_dir), asked).select(
        "user_id", "year", "month", "component", "approach", "similarity", "requested"
    )


def component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.component_metrics(scoring.best_approach(_scored(spark, sf_dir)))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.assemble_reports(scoring.best_approach(_scored(spark, sf_dir)))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_rows(_reports(spark, sf_dir))


def _written_reports(spark: SparkSession, sf_dir: str) -> str:
    """An earlier run of fixed approaches, then the run that replaces it."""
    root = scratch_path(spark, "reports")
    fallback = scoring.override_approach(_scored(spark, sf_dir), {})
    write_reports(reports.assemble_reports(fallback), root, dt.datetime(2024, 2, 1))
    write_reports(_reports(spark, sf_dir), root, dt.datetime(2024, 2, 2))
    return root


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_rows(read_reports(spark, _written_reports(spark, sf_dir)))


def report_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run, compacted; the run that replaces it; compacted again, and old generations dropped."""
    store = scratch_path(spark, "report-store")
    fallback = scoring.override_approach(_scored(spark, sf_dir), {})
    store_reports(reports.assemble_reports(fallback), store, dt.datetime(2024, 2, 1))
    compact(spark, store)
    store_reports(_reports(spark, sf_dir), store, dt.datetime(2024, 2, 2))
    compact(spark, store)
    drop_generations(spark, store)
    return reports.report_rows(read_store(spark, store))


def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _written_reports(spark, sf_dir)
    return reports.report_display(read_reports(spark, root, year=2024, month="January"))


def report_lookup_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's report out of all."""
    written = read_reports(spark, _written_reports(spark, sf_dir))
    return reports.report_display(written, user_id="1", year=2024, month="January")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic IS NOT NULL")
    return table(spark, sf_dir, "documents").join(labels, "doc_id")


def fitted_safety(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, IsotonicRegressionModel]:
    """The classifier, fitted on the training part of the labelled documents, and its calibration on another part."""
    training, calibration, _ = scoring.labelled_parts(_labelled(spark, sf_dir), "doc_id")
    model = scoring.fit_safety(training)
    return model, scoring.fit_calibration(model, calibration)


def safety_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, calibration = fitted_safety(spark, sf_dir)
    return scoring.classify(model, documents, "text", calibration).drop("text")


def safety_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often flags are right on labelled documents that neither fit has seen, by confidence."""
    model, calibration = fitted_safety(spark, sf_dir)
    _, _, holdout = scoring.labelled_parts(_labelled(spark, sf_dir), "doc_id")
    return scoring.reliability(scoring.classify(model, holdout, "text", calibration))


def _embedder(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """The learned embedding, fitted on the conversations, saved and read back."""
    path = scratch_path(spark, "embedder")
    scoring.save_embedder(scoring.fit_word_embedder(table(spark, sf_dir, "conversations").select("text")), path)
    return scoring.load_embedder(path)


def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    embedded = scoring.embed(_embedder(spark, sf_dir), turns, "text", "embedding")
    return embedded.select("conv_id", "turn", "embedding")


def winner_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report job: profiles to nested reports, shown flat."""
    safety, calibration = fitted_safety(spark, sf_dir)
    made = reports.generate_reports(
        event_transactions(spark, sf_dir),
        summary_writer(),
        safety,
        embedder=_embedder(spark, sf_dir),
        calibration=calibration,
    )
    return reports.report_rows(made)


_CATALOGUE = "component, component_rank, approach, approach_rank, template"
_RENDERED = f"""SELECT user_id, year, month, component, component_rank, approach, approach_rank,
  replace(template, '{PLACEHOLDER}', profile_text) AS prompt
FROM profiles, (VALUES {oracle.values(catalogue_rows(COMPONENTS))}) AS c({_CATALOGUE})
WHERE has_data"""
_TITLES = "CASE component WHEN 'executive_summary' THEN 'Executive Summary' ELSE 'Recommendations' END"

QUERIES = {
    "prompt_render": (
        prompt_render,
        f"WITH {oracle.EVENTS}, {oracle.PROFILE} {_RENDERED}",
    ),
    "generated_text": (
        generated_text,
        f"""WITH {oracle.EVENTS}, {oracle.PROFILE} SELECT user_id, year, month, component, approach,
          {_TITLES} || ' (' || replace(approach, '_', ' ') || ')' || chr(10) || profile_text
            AS output_text
        FROM profiles, (VALUES ('executive_summary'), ('recommendations')) AS c(component),
          (VALUES ('zero_shot'), ('few_shot'), ('chain_of_thought')) AS a(approach)
        WHERE has_data""",
    ),
    "answers_asked_once": (
        answers_asked_once,
        f"""WITH {oracle.EVENTS}, {oracle.PROFILE}, asked AS (
          SELECT *, CASE WHEN approach = 'few_shot' AND CAST(user_id AS BIGINT) % 10 = 0 THEN 2 ELSE 1 END AS times
          FROM profiles, (VALUES ('executive_summary'), ('recommendations')) AS c(component),
            (VALUES ('zero_shot'), ('few_shot'), ('chain_of_thought')) AS a(approach)
          WHERE has_data)
        SELECT user_id, year, month, component, approach,
          {_TITLES} || ' (' || replace(approach, '_', ' ') || ')' || chr(10) || profile_text AS output_text,
          CAST(NULL AS VARCHAR) AS error, CAST(times AS BIGINT) AS n_asked, CAST(times AS BIGINT) AS n_asked_later
        FROM asked""",
    ),
    "template_similarity": (
        template_similarity,
        f"WITH {oracle.CANDIDATES} SELECT user_id, component, approach, similarity FROM candidates",
    ),
    "candidate_scores": (
        candidate_scores,
        f"""WITH {oracle.CANDIDATES} SELECT user_id, year, month, component, approach, ethical_flag,
        similarity, score FROM scored""",
    ),
    "best_approach": (
        best_approach,
        f"WITH {oracle.CANDIDATES} SELECT user_id, year, month, component, approach, score FROM best",
    ),
    "approach_override": (
        approach_override,
        f"""WITH {oracle.CANDIDATES},
        asked AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'executive_summary' AS component,
          CASE WHEN c_acctbal > 5000 THEN 'few_shot' ELSE 'zero_shot' END AS style FROM customer)
        SELECT s.user_id, year, month, s.component, approach, similarity,
          style IS NOT NULL AS requested
        FROM scored s LEFT JOIN asked a ON a.user_id = s.user_id AND a.component = s.component
        WHERE approach = coalesce(style, 'chain_of_thought')""",
    ),
    "component_metrics": (
        component_metrics,
        f"""WITH {oracle.CANDIDATES} SELECT user_id, year, month, component, approach, ethical_flag,
          CAST(printf('%.2f', confidence) AS DOUBLE) AS confidence,
          CAST(printf('%.2f', similarity) AS DOUBLE) AS similarity_score FROM best""",
    ),
    "report_rows": (report_rows, f"WITH {oracle.CANDIDATES} {oracle.REPORT_ROWS}"),
    "report_roundtrip": (report_roundtrip, f"WITH {oracle.CANDIDATES} {oracle.REPORT_ROWS}"),
    "report_compaction": (report_compaction, f"WITH {oracle.CANDIDATES} {oracle.REPORT_ROWS}"),
    "report_lookup": (
        report_lookup,
        f"""WITH {oracle.CANDIDATES}, flat AS ({oracle.REPORT_ROWS})
        SELECT user_id, year, month, {_TITLES} AS title, approach, ethical_flag, confidence,
          similarity_score, output_text FROM flat""",
    ),
    "report_lookup_user": (
        report_lookup_user,
        f"""WITH {oracle.CANDIDATES}, flat AS ({oracle.REPORT_ROWS})
        SELECT user_id, year, month, {_TITLES} AS title, approach, ethical_flag, confidence,
          similarity_score, output_text FROM flat WHERE user_id = '1'""",
    ),
    "safety_classifier": (safety_classifier, None),
    "safety_reliability": (safety_reliability, None),
    "text_embedding": (text_embedding, None),
    "winner_reuse": (winner_reuse, None),
}
