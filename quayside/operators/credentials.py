"""Looks for credential shapes in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: what counts as a credential -------------------------------------------------
SECRET_NAMES = [
    "password",
    "passwd",
    "token",
    "access_token",
    "access_key",
    "account_key",
    "client_secret",
    "connection_string",
    "sas_token",
]
ACCOUNT_KEY_SETTING = r"(?i)fs\.azure\.account\.key\."
CONTAINER_SCHEMES = ["abfs", "abfss"]

SECRET_KEY = r"(?i)(?:^|[._-])(?:" + "|".join(SECRET_NAMES) + r")(?:$|[._-])"
# A name in front of "=" or ":". It starts where no name character precedes, which keeps the scan linear.
ASSIGNED_NAME = r"""(?<![A-Za-z0-9._-])([A-Za-z0-9._-]++)["']?\s*[=:]"""
URI = r"""(?<![A-Za-z0-9+.-])([A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]+)"""
USER_INFO = r"\A[^:]+://([^/?#]*)@"
QUERY = r"\A[^?#]*\?([^#]*)"
# Text that contains none of these cannot match anything below.
SUSPICIOUS = "(?i)://|fs[.]azure|" + "|".join(sorted({n for n in SECRET_NAMES if "token" not in n})) + "|token"


def secret_names(text: Column) -> Column:
    """How many assigned names are credential names."""
    names = F.regexp_extract_all(text, F.lit(ASSIGNED_NAME), F.lit(1))
    return F.size(F.filter(names, lambda name: name.rlike(SECRET_KEY)))


def account_key_settings(text: Column) -> Column:
    """How many assigned names set a storage account key."""
    names = F.regexp_extract_all(text, F.lit(ASSIGNED_NAME), F.lit(1))
    return F.size(F.filter(names, lambda name: name.rlike(ACCOUNT_KEY_SETTING)))


def _exposes(uri: Column) -> Column:
    """User info, a password or a query; the user part of a storage container address is its container."""
    user_info = F.regexp_extract(uri, USER_INFO, 1)
    user, password = F.regexp_extract(user_info, r"\A([^:]*)", 1), F.regexp_extract(user_info, r"\A[^:]*:(.*)", 1)
    container = F.lower(F.regexp_extract(uri, r"\A([^:]+)", 1)).isin(*CONTAINER_SCHEMES) & (password == "")
    return (
        ((user != "") & ~container) | (password != "") | (F.regexp_extract(uri, QUERY, 1) != "")
    )


def credential_uris(text: Column) -> Column:
    """How many URIs carry credentials."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(URI), F.lit(1)), _exposes))


def credential_scan(frame: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """Rows of ``frame`` whose ``column`` shows a credential shape, with counts but never the text."""
    text = F.col(column)
    counts = {
        "secret_names": secret_names(text),
        "account_key_settings": account_key_settings(text),
        "credential_uris": credential_uris(text),
    }
    return (
        frame.where(text.rlike(SUSPICIOUS))
        .select(
            F.lit(label).alias("source"), F.col(key).alias("id"), *[value.alias(n) for n, value in counts.items()]
        )
        .where(" + ".join(counts) + " > 0")
    )
