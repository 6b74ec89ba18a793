"""Geocoding: clients of three providers behind one interface, lookups over DataFrames, and an offline gazetteer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.errors import GEOCODING_FAILED, INVALID_PARAMS, PROVIDER_CONFIG, ServiceError, as_service_error
from waymark.functions.geojson import number_text
from waymark.sources.cache import LruCache, Lookup
from waymark.sources.config import Config
from waymark.sources.http import HttpClient, Response

# Addresses of the providers.
NOMINATIM = "https://nominatim.openstreetmap.org"
GOOGLE = "https://maps.googleapis.com/maps/api/geocode/json"
MAPBOX = "https://api.mapbox.com/geocoding/v5/mapbox.places"
#: Characters that a query keeps as they are, besides letters, digits and ``_.-~``.
SAFE = "!*'()"
HIT = "struct<lat:double,lng:double,display_name:string,provider:string>"


@dataclass(frozen=True)
class Hit:
    lat: float
    lng: float
    display_name: str
    provider: str


def _number(x: object) -> float | None:
    """A finite number, also one written as text."""
    if isinstance(x, bool) or not isinstance(x, (int, float, str)) or x == "":
        return None
    try:
        value = float(x)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _hit(lat: object, lng: object, name: object, provider: str) -> Hit | None:
    a, b = _number(lat), _number(lng)
    if a is None or b is None:
        return None
    return Hit(a, b, name if isinstance(name, str) else f"{number_text(a)},{number_text(b)}", provider)


class Provider:
    """Requests and answers of one provider; ``hits`` raises where an answer is an error."""

    name = ""
    headers: dict[str, str] = {}
    needs_key = False

    def forward(self, address: str, limit: int, key: str) -> str:
        raise NotImplementedError

    def reverse(self, lat: float, lng: float, key: str) -> str:
        raise NotImplementedError

    def hits(self, answer: Response, reverse: bool) -> list[Hit | None]:
        raise NotImplementedError


class Nominatim(Provider):
    name = "nominatim"
    headers = {"Accept": "application/json"}

    def forward(self, address: str, limit: int, key: str) -> str:
        return f"{NOMINATIM}/search?format=jsonv2&limit={limit}&q={quote(address, safe=SAFE)}"

    def reverse(self, lat: float, lng: float, key: str) -> str:
        return f"{NOMINATIM}/reverse?format=jsonv2&lat={number_text(lat)}&lon={number_text(lng)}"

    def hits(self, answer: Response, reverse: bool) -> list[Hit | None]:
        rows = [answer.body] if reverse else answer.body
        found = [_hit(_dict(r).get("lat"), _dict(r).get("lon"), _dict(r).get("display_name"), self.name) for r in rows] if isinstance(rows, list) else None
        if answer.status != 200 or found is None or (reverse and found == [None]):
            raise ServiceError(GEOCODING_FAILED, f"Nominatim {'reverse geocoding' if reverse else 'search'} failed", {"status": answer.status})
        return found


class Google(Provider):
    name = "google"
    needs_key = True

    def forward(self, address: str, limit: int, key: str) -> str:
        return f"{GOOGLE}?address={quote(address, safe=SAFE)}&key={key}"

    def reverse(self, lat: float, lng: float, key: str) -> str:
        return f"{GOOGLE}?latlng={number_text(lat)},{number_text(lng)}&key={key}"

    def hits(self, answer: Response, reverse: bool) -> list[Hit | None]:
        body = _dict(answer.body)
        if answer.status == 200 and body.get("status") == "ZERO_RESULTS":
            return []
        if answer.status != 200 or body.get("status") != "OK" or not isinstance(body.get("results"), list):
            raise ServiceError(GEOCODING_FAILED, "Google geocoding failed", {"status": answer.status, "providerStatus": body.get("status")})
        at = lambda r: _dict(_dict(_dict(r).get("geometry")).get("location"))
        return [_hit(at(r).get("lat"), at(r).get("lng"), _dict(r).get("formatted_address"), self.name) for r in body["results"]]


class Mapbox(Provider):
    name = "mapbox"
    needs_key = True

    def forward(self, address: str, limit: int, key: str) -> str:
        return f"{MAPBOX}/{quote(address, safe=SAFE)}.json?limit={limit}&access_token={key}"

    def reverse(self, lat: float, lng: float, key: str) -> str:
        return f"{MAPBOX}/{number_text(lng)},{number_text(lat)}.json?limit=1&access_token={key}"

    def hits(self, answer: Response, reverse: bool) -> list[Hit | None]:
        features = _dict(answer.body).get("features")
        if answer.status != 200 or not isinstance(features, list):
            raise ServiceError(GEOCODING_FAILED, "Mapbox geocoding failed", {"status": answer.status})
        centers = [(r, _dict(r).get("center")) for r in features]
        return [_hit(c[1], c[0], r.get("place_name"), self.name) for r, c in centers if isinstance(c, list) and len(c) >= 2]


PROVIDERS = {p.name: p for p in (Nominatim(), Google(), Mapbox())}


class GeocodingClient:
    """Forward and reverse lookups of the configured provider; equal lookups are made once while the cache holds them."""

    def __init__(self, http: HttpClient, config: Config = Config(), cache: LruCache | None = None):
        self.http, self.config, self.provider = http, config, PROVIDERS[config.geocoding_provider]
        self._lookup = Lookup(LruCache(ttl_s=config.cache_ttl_s) if cache is None else cache)

    def _hits(self, url: Callable[[str], str], reverse: bool) -> list[Hit]:
        if self.provider.needs_key and self.config.geocoding_api_key is None:
            raise ServiceError(PROVIDER_CONFIG, "GEOCODING_API_KEY is required")
        answer = self.http.request(url(self.config.geocoding_api_key or ""), headers=self.provider.headers, timeout_ms=self.config.http_timeout_ms, retries=self.config.http_retries)
        found = [h for h in self.provider.hits(answer, reverse) if h is not None]
        if not found:
            raise ServiceError(GEOCODING_FAILED, "No geocoding results")
        return found

    def forward(self, address: str, limit: int = 1) -> list[Hit]:
        def load() -> list[Hit]:
            found = self._hits(lambda key: self.provider.forward(address, limit, key), False)
            return found[:limit] if self.provider.name == "google" else found

        return self._lookup(f"forward:{self.provider.name}:{limit}:{address}", load)

    def reverse(self, lat: float, lng: float) -> Hit:
        return self._lookup(f"reverse:{self.provider.name}:{lat},{lng}", lambda: self._hits(lambda key: self.provider.reverse(lat, lng, key), True)[0])


def geocode(requests: DataFrame, client: Callable[[], GeocodingClient], tasks: int = 1) -> DataFrame:
    """``requests`` (address, or lat and lng, and limit) with ``hits`` (array) and ``error``.

    Equal requests are looked up once and joined back. ``client`` makes a client on the worker; with one task, the
    default, one client spaces all requests to a rate-limited host.
    """
    keys = ["address", "lat", "lng", "limit"]
    r = requests.withColumn("address", F.trim("address")).withColumn("limit", F.coalesce(F.col("limit").cast("int"), F.lit(1)))
    r = r.withColumn("lat", F.col("lat").cast("double")).withColumn("lng", F.col("lng").cast("double"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append(([asdict(h) for h in _look_up(own, row)], None))
                except Exception as error:  # noqa: BLE001
                    out.append((None, str(as_service_error(error, GEOCODING_FAILED))))
            yield batch.assign(hits=[h for h, _ in out], error=[e for _, e in out])

    looked = r.select(*keys).distinct().coalesce(tasks).mapInPandas(call, f"address string, lat double, lng double, limit int, hits array<{HIT}>, error string")
    same = [r[k].eqNullSafe(looked[k]) for k in keys]
    return r.join(looked, same[0] & same[1] & same[2] & same[3], "left").select(*(r[c] for c in r.columns), looked["hits"], looked["error"])


def _look_up(client: GeocodingClient, row: dict) -> list[Hit]:
    address = None if pd.isna(row["address"]) else row["address"]
    lat, lng = (None if pd.isna(row[k]) else float(row[k]) for k in ("lat", "lng"))
    if (lat is None) != (lng is None):
        raise ServiceError(INVALID_PARAMS, "lat and lng must be provided together")
    if (address is None) == (lat is None):
        raise ServiceError(INVALID_PARAMS, "Provide either address (forward) or lat+lng (reverse), not both or neither")
    return client.forward(address, int(row["limit"])) if address is not None else [client.reverse(lat, lng)]


def gazetteer_lookup(requests: DataFrame, gazetteer: DataFrame, address: str = "address") -> DataFrame:
    """Offline geocoding: ``requests`` joined to a table (address, lat, lng), without regard to case or outer spaces.

    Requests without an entry keep null coordinates.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    places = gazetteer.select(key("address").alias("_key"), "lat", "lng").dropDuplicates(["_key"])
    return requests.withColumn("_key", key(address)).join(places, "_key", "left").drop("_key")
