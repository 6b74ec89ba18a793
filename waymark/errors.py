"""Error codes, exceptions, and the removal of secrets from messages."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes that callers match on.
INVALID_PARAMS = "InvalidParams"
INTERNAL_ERROR = "InternalError"
GEOCODING_FAILED = "GeocodingFailed"
ROUTE_FAIL = "ROUTE_FAIL"
CLUSTER_FAIL = "CLUSTER_FAIL"
GEOMETRY_FAIL = "GEOMETRY_FAIL"
PROVIDER_CONFIG = "PROVIDER_CONFIG"
TIMEOUT = "TIMEOUT"
UPSTREAM_ERROR = "UPSTREAM_ERROR"

# Query parameters that hold secrets.
SECRET_NAMES = ("key", "access_token", "token", "api_key", "apikey")
MASK = "REDACTED"

#: What ends a URL that stands in other text.
_OUTSIDE = r"""\s"'\\"""
#: What is masked, behind a group that stays: the value of a secret parameter, and what precedes the host. They are read
#: by Python, Java and RE2 alike.
PARAMETER = rf"([?&](?i:{'|'.join(SECRET_NAMES)})=)[^&#{_OUTSIDE}]*"
USER_INFO = rf"(://)[^@/{_OUTSIDE}]+@"


class DomainError(ValueError):
    """Input that an algorithm cannot work on. ``reason`` is a short code such as EMPTY."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


class ServiceError(RuntimeError):
    """Failure with one of the public codes; ``details`` are for callers, ``retryable`` for the HTTP client."""

    def __init__(self, code: str, message: str, details: dict | None = None, retryable: bool = True):
        super().__init__(message)
        self.code, self.details, self.retryable = code, details, retryable

    def as_dict(self) -> dict:
        out = {"code": self.code, "message": str(self)}
        return out if self.details is None else {**out, "details": self.details}


def redact(text: str) -> str:
    """``text`` without values of secret parameters and credentials of URLs."""
    return re.sub(USER_INFO, rf"\1{MASK}@", re.sub(PARAMETER, rf"\1{MASK}", text))


def redact_column(text: Column) -> Column:
    """``redact`` as an expression."""
    return F.regexp_replace(F.regexp_replace(text, PARAMETER, f"$1{MASK}"), USER_INFO, f"$1{MASK}@")


def redact_url(url: str) -> str:
    """A URL whose credentials and secret parameters are masked; text that is no URL is treated as any text."""
    try:
        parts = urlsplit(url)
        host = parts.netloc.rpartition("@")[2]
        if not parts.scheme or not host:
            return redact(url)
    except ValueError:
        return redact(url)
    query = parse_qsl(parts.query, keep_blank_values=True)
    if any(name.lower() in SECRET_NAMES for name, _ in query):
        masked = urlencode([(n, MASK if n.lower() in SECRET_NAMES else v) for n, v in query], quote_via=quote)
    else:
        masked = parts.query
    return urlunsplit(parts._replace(netloc=f"{MASK}@{host}" if "@" in parts.netloc else host, query=masked))


def as_service_error(error: BaseException, fallback: str = INTERNAL_ERROR) -> ServiceError:
    """Coded errors stay as they are, domain errors become InvalidParams, all others get ``fallback``."""
    if isinstance(error, ServiceError):
        return error
    return ServiceError(INVALID_PARAMS if isinstance(error, DomainError) else fallback, redact(str(error)))
