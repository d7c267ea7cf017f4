"""Literal rows shared by the tests."""

from __future__ import annotations

import datetime as dt

from walletlens.schema import TRANSACTION_SCHEMA

SAMPLE_USER = "d962c87b-e29c-41f0-8f04-5f5e9df339ab"
SAMPLE_TAG = "PROFESSIONAL_HUSTLERS, LOAN_AND_GAMING, PRUDENT_PLANNERS"

# The twelve transactions of the sample user, all of 2025-04-01.
SAMPLE_AMOUNTS = [
    ("SPEND", "SEND MONEY", 13.4046),
    ("SPEND", "MAYA SHOP", 10.9305),
    ("CASH-IN", "BANK TRANSFER", 554.8722),
    ("CASH-IN", "SEND MONEY", 92.5013),
    ("SPEND", "SEND MONEY", 92.2523),
    ("CASH-IN", "BANK TRANSFER", 101.9942),
    ("SPEND", "SEND MONEY", 138.6472),
    ("SPEND", "SEND MONEY", 193.9093),
    ("SPEND", "QR", 68.8981),
    ("CASH-IN", "BANK TRANSFER", 216.1749),
    ("SPEND", "QR", 45.3339),
    ("SPEND", "QR", 117.0478),
]


def transaction(user, moment, kind, method, amount, tag=""):
    return (user, moment, kind, method, amount, tag, moment.year, moment.month)


def transactions(spark, rows):
    return spark.createDataFrame(rows, TRANSACTION_SCHEMA)


def sample(spark):
    day = dt.datetime(2025, 4, 1)
    return transactions(
        spark,
        [transaction(SAMPLE_USER, day, kind, method, x, SAMPLE_TAG) for kind, method, x in SAMPLE_AMOUNTS],
    )
