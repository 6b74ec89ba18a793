"""Settings of the services, from a mapping such as the environment."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from waymark.errors import PROVIDER_CONFIG, ServiceError
from waymark.sources.http import DEFAULT_USER_AGENT


@dataclass(frozen=True)
class Config:
    geocoding_provider: str = "nominatim"
    geocoding_api_key: str | None = None
    osrm_url: str = "https://router.project-osrm.org"
    osrm_max_table_size: int = 100
    default_speed_kmh: float = 40.0
    user_agent: str = DEFAULT_USER_AGENT
    public_api_min_interval_ms: int = 1000
    log_level: str = "info"
    cache_ttl_s: int = 300
    http_timeout_ms: int = 10_000
    http_retries: int = 2
    route_search_time_budget_ms: int = 1500
    environment: str = "production"


# Name of each setting, its field, its type, and the range or the values it may have.
SETTINGS = {
    "GEOCODING_PROVIDER": ("geocoding_provider", str, ("nominatim", "google", "mapbox")),
    "GEOCODING_API_KEY": ("geocoding_api_key", str, (1, 10_000)),
    "OSRM_URL": ("osrm_url", str, r"(?i)https?://.+"),
    "OSRM_MAX_TABLE_SIZE": ("osrm_max_table_size", int, (2, 10_000)),
    "HAVERSINE_SPEED_KMH": ("default_speed_kmh", float, (1e-300, 300)),
    "ROUTE_SEARCH_TIME_BUDGET_MS": ("route_search_time_budget_ms", int, (50, 30_000)),
    "GEO_USER_AGENT": ("user_agent", str, (1, 256)),
    "PUBLIC_API_MIN_INTERVAL_MS": ("public_api_min_interval_ms", int, (1000, 60_000)),
    "LOG_LEVEL": ("log_level", str, ("debug", "info", "warn", "error")),
    "CACHE_TTL_SECONDS": ("cache_ttl_s", int, (1, 2**53)),
    "HTTP_TIMEOUT_MS": ("http_timeout_ms", int, (1, 2**53)),
    "HTTP_RETRIES": ("http_retries", int, (0, 5)),
    "NODE_ENV": ("environment", str, ("development", "production", "test")),
}


def load_config(values: Mapping[str, str]) -> Config:
    """Settings that are not given have their defaults; all faults are reported together.

    The time budget of the route search is read for compatibility; searches here are bounded by counted evaluations.
    """
    fields, faults = {}, []
    for name, (target, kind, allowed) in SETTINGS.items():
        if name not in values:
            continue
        text = values[name]
        try:
            value = kind(float(text)) if kind is int and float(text).is_integer() else kind(text)
        except (ValueError, OverflowError):
            faults.append(f"{name}: expected {'an integer' if kind is int else 'a number'}")
            continue
        if isinstance(allowed, str):
            if not re.fullmatch(allowed, value):
                faults.append(f"{name}: must be an http(s) URL")
        elif isinstance(allowed[0], str):
            if value not in allowed:
                faults.append(f"{name}: must be one of {', '.join(allowed)}")
        elif not allowed[0] <= (len(value) if kind is str else value) <= allowed[1]:
            faults.append(f"{name}: out of range {allowed[0]:g}..{allowed[1]:g}")
        fields[target] = value
    if faults:
        raise ServiceError(PROVIDER_CONFIG, f"Invalid environment: {'; '.join(faults)}")
    config = Config(**{**fields, "osrm_url": fields.get("osrm_url", Config.osrm_url).rstrip("/")})
    if config.geocoding_provider != "nominatim" and config.geocoding_api_key is None:
        raise ServiceError(PROVIDER_CONFIG, f"GEOCODING_API_KEY is required for provider {config.geocoding_provider}")
    return config
