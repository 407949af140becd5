"""Settings that are read from the session."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession

from ..functions import text as X


class Settings(NamedTuple):
    log_requests: bool  #: spark.textfacts.requests.log: on unless it is 0 or false
    request_chars: int  #: spark.textfacts.requests.maxChars: how much of the parameters is logged; 0 or less is all
    workspace: str | None  #: spark.textfacts.workspace: the folder that is loaded where none is named


def enabled(value: str | None) -> bool:
    return (value or "").lower() not in ("0", "false")


def settings(spark: SparkSession) -> Settings:
    get = lambda name: spark.conf.get(f"spark.textfacts.{name}", None)
    try:
        chars = int(get("requests.maxChars") or X.RPC_CHARS)
    except ValueError:
        chars = X.RPC_CHARS
    return Settings(enabled(get("requests.log")), chars, get("workspace") or None)
