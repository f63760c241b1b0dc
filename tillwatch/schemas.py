"""Closed vocabularies and record types of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
CONFIDENCE = ("low", "medium", "high")
ROLES = ("gateway", "orchestrator", "local_method_provider", "bnpl", "wallet", "acquirer_processor", "tokenizer")
PSP_ROLES = ("gateway", "orchestrator", "local_method_provider")
SIGNAL_TYPES = ("script_src", "network_host", "iframe_src", "form_action", "js_global", "html_pattern", "header", "cookie", "favicon", "platform_plugin", "checkout_label")
CHECKOUT_PAGES = ("checkout", "payment_step")
FAILED_SCANS = ("blocked", "timeout", "error")
REACHED = "reached_payment_step"

PAGE_SIGNALS = T.StructType(
    [
        T.StructField("page_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cookie_names", T.ArrayType(T.StringType())),
        T.StructField("script_srcs", T.ArrayType(T.StringType())),
        T.StructField("iframe_srcs", T.ArrayType(T.StringType())),
        T.StructField("form_actions", T.ArrayType(T.StringType())),
        T.StructField("network_hosts", T.ArrayType(T.StringType())),
        T.StructField("js_globals", T.ArrayType(T.StringType())),
        T.StructField("favicon_sha256", T.StringType()),
        T.StructField("checkout_labels", T.ArrayType(T.StringType())),
    ]
)

RULE = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("target_type", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("signal_type", T.StringType(), False),
        T.StructField("match", T.StringType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("page_scope", T.StringType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("needs_verification", T.BooleanType(), False),
    ]
)


def confidence_rank(level: Column) -> Column:
    """low 0, medium 1, high 2; anything else null."""
    return F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2)
