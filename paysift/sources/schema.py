"""Declared schemas and fixed vocabularies.

Nothing is inferred at read time: the transactions schema is declared, and
the feature list is fixed so every engine (Spark, the SQL oracle, a model)
sees the same column order.
"""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "isFraud"
LEAKAGE_COLS = ["isFlaggedFraud"]
KEY = "txn_id"

# Raw payment columns in source order.
RAW_COLUMNS = [
    "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
    "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
]

TXN_SCHEMA = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])

# The five payment types (sorted) and the two high-risk ones.
TXN_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
HIGH_RISK_TYPES = ["TRANSFER", "CASH_OUT"]

# Numeric columns of the raw table.
BALANCE_COLS = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
MONEY_COLS = ["amount"] + BALANCE_COLS

# Columns that get a log1p feature, in output order.
LOG_TARGETS = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
               "newbalanceDest", "abs_error_orig", "abs_error_dest"]

# The 41 model features in catalogue order, then the target.
FEATURE_COLUMNS = [
    "step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
    "newbalanceDest", "balance_diff_orig", "balance_diff_dest",
    "amount_to_balance_ratio", "is_zero_balance", "error_orig", "error_dest",
    "abs_error_orig", "abs_error_dest", "type_CASH_IN", "type_CASH_OUT",
    "type_DEBIT", "type_PAYMENT", "type_TRANSFER", "is_high_risk_type", "hour",
    "day", "is_night", "txn_count_sender", "avg_amount_sender",
    "max_amount_sender", "std_amount_sender", "txn_count_receiver",
    "avg_amount_receiver", "txn_per_step_sender", "amt_per_step_sender",
    "high_amount_flag", "high_amount_and_zero_balance",
    "high_amount_and_high_risk_type", "log_amount", "log_oldbalanceOrg",
    "log_newbalanceOrig", "log_oldbalanceDest", "log_newbalanceDest",
    "log_abs_error_orig", "log_abs_error_dest",
]

# Feature groups for the phase summary (A10): group name -> feature names.
FEATURE_GROUPS = {
    "original": ["step", "amount", "oldbalanceOrg", "newbalanceOrig",
                 "oldbalanceDest", "newbalanceDest"],
    "basic": ["balance_diff_orig", "balance_diff_dest", "amount_to_balance_ratio",
              "is_zero_balance"],
    "balance_error": ["error_orig", "error_dest", "abs_error_orig", "abs_error_dest"],
    "type": ["type_CASH_IN", "type_CASH_OUT", "type_DEBIT", "type_PAYMENT",
             "type_TRANSFER", "is_high_risk_type"],
    "temporal": ["hour", "day", "is_night"],
    "sender": ["txn_count_sender", "avg_amount_sender", "max_amount_sender",
               "std_amount_sender"],
    "receiver": ["txn_count_receiver", "avg_amount_receiver"],
    "velocity": ["txn_per_step_sender", "amt_per_step_sender"],
    "interaction": ["high_amount_flag", "high_amount_and_zero_balance",
                    "high_amount_and_high_risk_type"],
    "log": ["log_amount", "log_oldbalanceOrg", "log_newbalanceOrig",
            "log_oldbalanceDest", "log_newbalanceDest", "log_abs_error_orig",
            "log_abs_error_dest"],
}

SCORES_SCHEMA = "model STRING, split STRING, txn_id STRING, label INT, score DOUBLE"
THRESHOLD_SCHEMA = T.StructType([T.StructField("optimal_threshold", T.DoubleType())])
