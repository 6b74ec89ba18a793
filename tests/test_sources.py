from __future__ import annotations

import json

import pytest

from waymark.errors import ServiceError
from waymark.sources import geocoding as geo
from waymark.sources.cache import LruCache, Lookup
from waymark.sources.config import Config, load_config
from waymark.sources.http import Answer, HttpClient, retry_after_ms
from waymark.sources.travel import OsrmClient, parallel_road_costs, road_costs


class Fake:
    """A transport that gives prepared answers, the last one again and again."""

    def __init__(self, *answers):
        self.answers, self.urls = list(answers), []

    def __call__(self, method, url, headers, body, timeout_s):
        self.urls.append(url)
        found = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(found, Exception):
            raise found
        status, value, *more = found
        text = value if isinstance(value, str) else json.dumps(value)
        return Answer(status, more[0] if more else {}, [text.encode()])


def client(*answers, **options):
    fake, waits = Fake(*answers), []
    return HttpClient(transport=fake, sleep=waits.append, clock=lambda: 0.0, **options), fake, waits


def test_retries():
    http, fake, waits = client((500, ""), (429, ""), (200, {"a": 1}))
    assert http.request("http://h/x").body == {"a": 1} and waits == [0.2, 2.0]
    http, fake, waits = client((503, "busy"))
    answer = http.request("http://h/x", retries=1)
    assert (answer.status, answer.body, len(fake.urls)) == (503, "busy", 2)
    http, fake, waits = client((429, "", {"retry-after": "3"}), (200, ""))
    assert http.request("http://h/x").body is None and waits == [3.0]
    http, fake, waits = client((429, "", {"retry-after": "30"}))
    assert http.request("http://h/x").status == 429 and waits == []
    http, fake, waits = client(TimeoutError())
    with pytest.raises(ServiceError) as error:
        http.request("http://h/x?key=S", retries=1)
    assert error.value.code == "TIMEOUT" and "key=REDACTED" in str(error.value) and len(fake.urls) == 2
    http, *_ = client(OSError("refused"))
    with pytest.raises(ServiceError, match="refused"):
        http.request("http://h/x", retries=0)


def test_size_limit():
    http, fake, _ = client((200, "x" * 50), max_bytes=10)
    with pytest.raises(ServiceError, match="exceeded 10 bytes"):
        http.request("http://h/x")
    assert len(fake.urls) == 1
    http, fake, _ = client((200, "", {"content-length": "99"}), max_bytes=10)
    with pytest.raises(ServiceError):
        http.request("http://h/x")


def test_spacing():
    http, fake, waits = client((200, {}), spacing_ms={"slow": 1000})
    for _ in range(3):
        http.request("http://slow/x")
        http.request("http://quick/x")
    assert waits == [1.0, 1.0]


@pytest.mark.parametrize(("text", "want"), [("3", 3000), ("soon", None), ("  ", None), (None, None), ("-1", 0)])
def test_retry_after(text, want):
    assert retry_after_ms(text) == want
    assert retry_after_ms("Thu, 01 Jan 1970 00:00:10 GMT", 0) == 10_000


def test_cache():
    cache = LruCache(max_weight=5)
    cache.set("a", 1, 3)
    cache.set("b", 2, 3)
    assert cache.get("a") is None and cache.get("b") == 2
    cache.set("c", 3, 6)
    assert cache.get("c") is None and cache.weight == 3
    now = [0.0]
    cache = LruCache(max_entries=2, ttl_s=10, clock=lambda: now[0])
    for k in "ab":
        cache.set(k, k)
    cache.get("a")
    cache.set("c", "c")
    assert cache.get("b") is None and cache.get("a") == "a" and len(cache) == 2
    now[0] = 11
    assert cache.get("a") is None and len(cache) == 1
    cache.clear()
    assert len(cache) == 0 and cache.weight == 0


def test_lookup_keeps_no_failures():
    calls = []

    def load():
        calls.append(1)
        if len(calls) == 1:
            raise ValueError
        return "x"

    look = Lookup(LruCache())
    with pytest.raises(ValueError):
        look("k", load)
    assert look("k", load) == look("k", load) == "x" and len(calls) == 2


def test_lookup_shares_a_load():
    import threading

    started, go, calls = threading.Event(), threading.Event(), []
    look = Lookup(LruCache())

    def load():
        calls.append(1)
        started.set()
        go.wait(5)
        return 7

    found = []
    threads = [threading.Thread(target=lambda: found.append(look("k", load))) for _ in range(4)]
    threads[0].start()
    started.wait(5)
    for t in threads[1:]:
        t.start()
    go.set()
    for t in threads:
        t.join(5)
    assert found == [7] * 4 and len(calls) == 1


TABLE = {"code": "Ok", "distances": [[0, 500], [500, 0]], "durations": [[0, 60], [60, 0]]}


def test_osrm():
    http, fake, _ = client((200, TABLE))
    osrm = OsrmClient(http, Config(osrm_url="http://osrm"))
    points = [(1.0, 2.0), (3.5, 4.0)]
    km, minutes = osrm.table(points)
    assert km[0, 1] == 0.5 and minutes[0, 1] == 1
    osrm.table(points)
    assert fake.urls == ["http://osrm/table/v1/driving/2,1;4,3.5?annotations=duration,distance"]
    http, fake, _ = client((200, {"code": "Ok", "distances": [[1]], "durations": [[1]]}))
    OsrmClient(http, Config(osrm_url="http://osrm")).table(points[:1], points[1:])
    assert fake.urls[0].endswith("&sources=0&destinations=1")


@pytest.mark.parametrize(
    ("answer", "message"),
    [
        ((200, {**TABLE, "distances": [[0, None], [1, 0]]}), "no road route"),
        ((200, {**TABLE, "distances": [[0]]}), "table request failed"),
        ((200, {**TABLE, "code": "NoTable"}), "table request failed"),
        ((400, "bad"), "table request failed"),
    ],
)
def test_osrm_failures(answer, message):
    http, *_ = client(answer)
    with pytest.raises(ServiceError, match=message) as error:
        OsrmClient(http).table([(0, 0), (1, 1)])
    assert error.value.code == "ROUTE_FAIL"
    with pytest.raises(ServiceError, match="exceeds OSRM_MAX_TABLE_SIZE=100"):
        OsrmClient(http).table([(0, 0)] * 101)


def test_nominatim():
    http, fake, _ = client((200, [{"lat": "1.5", "lon": "2.5", "display_name": "Somewhere"}, {"lat": "x", "lon": "1"}]))
    g = geo.GeocodingClient(http)
    assert g.forward("a b&c", 2) == [geo.Hit(1.5, 2.5, "Somewhere", "nominatim")]
    g.forward("a b&c", 2)
    assert fake.urls == ["https://nominatim.openstreetmap.org/search?format=jsonv2&limit=2&q=a%20b%26c"]
    http, *_ = client((200, {"lat": 1, "lon": 2}))
    assert geo.GeocodingClient(http).reverse(1, 2).display_name == "1,2"
    for answer, call in (((200, []), lambda c: c.forward("x")), ((500, []), lambda c: c.forward("x")), ((200, {"error": "?"}), lambda c: c.reverse(0, 0))):
        http, *_ = client(answer)
        with pytest.raises(ServiceError):
            call(geo.GeocodingClient(http, Config(http_retries=0)))


def test_google():
    place = lambda n: {"geometry": {"location": {"lat": 1, "lng": 2}}, "formatted_address": n}
    config = Config(geocoding_provider="google", geocoding_api_key="K")
    http, fake, _ = client((200, {"status": "OK", "results": [place("A"), place("B"), {}, place("C")]}))
    assert [h.display_name for h in geo.GeocodingClient(http, config).forward("x", 2)] == ["A", "B"]
    http, *_ = client((200, {"status": "ZERO_RESULTS", "results": []}))
    with pytest.raises(ServiceError, match="No geocoding results"):
        geo.GeocodingClient(http, config).forward("x")
    http, *_ = client((200, {"status": "DENIED"}))
    with pytest.raises(ServiceError, match="Google geocoding failed"):
        geo.GeocodingClient(http, config).reverse(1, 2)
    with pytest.raises(ServiceError, match="GEOCODING_API_KEY is required"):
        geo.GeocodingClient(http, Config(geocoding_provider="google")).forward("x")


def test_mapbox():
    config = Config(geocoding_provider="mapbox", geocoding_api_key="K")
    http, fake, _ = client((200, {"features": [{"center": [2, 1], "place_name": "P"}, {"center": ["x"]}]}))
    g = geo.GeocodingClient(http, config)
    assert g.forward("x/y") == [geo.Hit(1, 2, "P", "mapbox")]
    assert fake.urls[0].startswith("https://api.mapbox.com/geocoding/v5/mapbox.places/x%2Fy.json?limit=1&")
    assert g.reverse(1, 2).display_name == "P"


def _offline_geocoder():
    return geo.GeocodingClient(HttpClient(transport=Fake((200, [{"lat": 1, "lon": 2}])), sleep=lambda s: None))


def test_geocode_table(spark):
    rows = [("Berlin", None, None, 1), (" Berlin ", None, None, 1), (None, None, None, None), ("x", 1.0, 2.0, 1), (None, 1.0, None, 1)]
    found = geo.geocode(spark.createDataFrame(rows, "address string, lat double, lng double, limit int"), _offline_geocoder).collect()
    assert len(found) == 5 and [h.display_name for h in next(r for r in found if r.address == "Berlin").hits] == ["1,2"]
    assert {r.error for r in found if r.hits is None} == {
        "lat and lng must be provided together", "Provide either address (forward) or lat+lng (reverse), not both or neither",
    }


def _offline_osrm():
    return OsrmClient(HttpClient(transport=Fake((200, TABLE)), sleep=lambda s: None), Config(osrm_url="http://osrm"))


def test_road_costs(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.0, 1.0), ("b", 0, 0.0, 0.0)], "request_id string, idx int, lat double, lng double")
    for of in (road_costs, parallel_road_costs):
        found = of(df, _offline_osrm).collect()
        assert {(r.i, r.j): r.km for r in found if r.request_id == "a"} == {(0, 0): 0, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 0}
        assert [r.error for r in found if r.request_id == "b"] == ["OSRM table request failed"]


def test_gazetteer(spark):
    places = spark.createDataFrame([("Paris", 48.9, 2.4)], "address string, lat double, lng double")
    asked = spark.createDataFrame([(1, " paris"), (2, "Rome"), (3, None)], "id int, address string")
    assert [r.lat for r in geo.gazetteer_lookup(asked, places).orderBy("id").collect()] == [48.9, None, None]


def test_config():
    assert load_config({}) == Config()
    assert load_config({"OSRM_URL": "http://x//", "HTTP_RETRIES": "0"}).osrm_url == "http://x"
    with pytest.raises(ServiceError, match="OSRM_URL: must be an http.* HTTP_RETRIES: out of range 0..5"):
        load_config({"OSRM_URL": "ftp://x", "HTTP_RETRIES": "9"})
    with pytest.raises(ServiceError, match="GEOCODING_API_KEY is required"):
        load_config({"GEOCODING_PROVIDER": "google"})


def test_log_lines():
    import io

    from waymark.logs import get_logger

    out = io.StringIO()
    log = get_logger("warn", out)
    log.info("hidden")
    log.warning("retry", extra={"fields": {"url": "http://h?key=S", "attempt": 1}})
    line = json.loads(out.getvalue())
    assert (line["level"], line["msg"], line["url"], line["attempt"]) == ("warn", "retry", "http://h?key=REDACTED", 1)
