"""Streams run to completion over the available input and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.cascades import FULL_CASCADE
from tallyspark.catalog.extract import ADDRESS_SQL, DEVICE_SQL
from tallyspark.catalog.neighbours import CAND
from tallyspark.catalog.summaries import MATCHED
from tallyspark.operators import cascade, neighbours, summary
from tallyspark.streaming import jobs

C = F.col


@query("k1_incremental_rule_cascade", f"WITH {FULL_CASCADE} SELECT row_pos, account_name, categorization_source, matched_rule_id, confidence_score, needs_review_reason, transaction_fingerprint FROM cat")
def k1(i):
    stream = jobs.transaction_stream(i.spark, i.sf_dir)
    out = jobs.categorise_stream(
        stream, i.spark, lambda batch: cascade.categorise(batch, i.rules, i.check_register, None, i.model_proposal), summary.is_matched()
    )
    return out.select("row_pos", "account_name", "categorization_source", "matched_rule_id", "confidence_score", "needs_review_reason", "transaction_fingerprint")


@query("k1_running_matched", f"WITH {FULL_CASCADE} SELECT 3 AS batches, count(*) AS n, count_if({MATCHED}) AS matched FROM cat")
def k1_running(i):
    stream = jobs.transaction_stream(i.spark, i.sf_dir, 3)
    out = jobs.categorise_stream(
        stream, i.spark, lambda batch: cascade.categorise(batch, i.rules, i.check_register, None, i.model_proposal), summary.is_matched()
    )
    return jobs.progress(out).agg(F.count("*").alias("batches"), F.sum("n").alias("n"), F.max("running_matched").alias("matched"))


@query("k2_incremental_similarity", f"WITH {CAND} SELECT client_id, txn_id AS query_id, best.category, tier FROM best")
def k2(i):
    stream = jobs.table_stream(i.spark, i.sf_dir, "embeddings")

    def label(batch):
        history = i.ledger_vectors
        rows = i.query_vectors.join(batch.select(C("vec_id").alias("txn_id")), "txn_id", "left_semi")
        return neighbours.best_candidate(neighbours.candidates(rows, history, 50, True)).select("client_id", "query_id", "best.category", "best.tier")

    out = jobs.categorise_stream(stream, i.spark, label, C("tier").isNotNull())
    return out.select("client_id", "query_id", "category", "tier")


@query("k3_account_messages", """WITH g AS (SELECT bank, coalesce(account_number, 'NA') AS account, count(*) AS n FROM bank_txn GROUP BY ALL)
SELECT bank, account, unnest(['start', 'batch', 'complete']) AS message, unnest([0, n, n]) AS n FROM g""")
def k3(i):
    out = jobs.account_messages(jobs.transaction_stream(i.spark, i.sf_dir), i.spark)
    return out.groupBy("bank", "account", "message").agg(F.sum("n").alias("n"))


@query("k4_event_enrichment", f"SELECT event_id, {ADDRESS_SQL} AS ip, {DEVICE_SQL} FROM (SELECT *, lower(user_agent) AS ua FROM web_event) e")
def k4(i):
    out = jobs.batch_sink(jobs.enrich_events(jobs.event_stream(i.spark, i.sf_dir)), i.spark)
    return out.select("event_id", C("ipAddress").alias("ip"), "device", "browser", "os")


@query("k5_event_validity", f"SELECT event_id, event_type IN {q.in_list(K.VALID_EVENT_TYPES)} AND status IN {q.in_list(K.VALID_STATUSES)} AS is_valid FROM web_event")
def k5(i):
    stored = jobs.batch_sink(jobs.enrich_events(jobs.event_stream(i.spark, i.sf_dir)), i.spark)
    valid, quarantine = jobs.split_valid(stored)
    return valid.select("event_id", F.lit(True).alias("is_valid")).unionByName(quarantine.select("event_id", F.lit(False).alias("is_valid")))
