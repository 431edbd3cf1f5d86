"""Address ranges against a bisection over the sorted ranges."""

import bisect
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import screening

RANGES = "ip_start long, ip_end long, ip6_start string, ip6_end string, country_code string"


def hexed(n):
    return f"{n:032x}"


def model(address, v4, v6):
    try:
        parsed = ipaddress.ip_address(address)
    except ValueError:
        return None
    known = v4 if parsed.version == 4 else v6
    at = bisect.bisect_right(known, (int(parsed), float("inf"))) - 1
    return known[at][2] if at >= 0 and int(parsed) <= known[at][1] else None


def ranges_within(low, width, n, rng):
    """``n`` ranges with gaps, in order."""
    step = width // n
    return [(low + i * step, low + i * step + rng.randrange(step), f"C{rng.randrange(50)}") for i in range(n)]


@pytest.mark.parametrize("dense", [200, 200_000])
def test_countries_of_addresses(spark, dense):
    """Also where 200,000 ranges lie under one 16-bit prefix."""
    rng = random.Random(dense)
    prefix = 0x2001 << 112
    v6 = [(5, 9, "AA"), *ranges_within(prefix, 1 << 112, dense, rng), (0xFF << 120, (0xFF << 120) + 10, "ZZ")]
    v4 = ranges_within(10 << 24, 1 << 24, 300, rng)
    rows = [(a, b, None, None, c) for a, b, c in v4] + [(None, None, hexed(a), hexed(b).upper(), c) for a, b, c in v6]
    texts = [str(ipaddress.IPv6Address(prefix + rng.randrange(1 << 112))) for _ in range(1500)]
    texts += [str(ipaddress.IPv6Address(end)) for r in rng.sample(v6, 150) for end in (r[0], r[1], r[1] + 1)]
    texts += [str(ipaddress.IPv4Address((10 << 24) + rng.randrange(1 << 25))) for _ in range(500)]
    texts += ["::", "::5", "::9", "::a", "9.255.255.255", "0.0.0.0", "255.255.255.255", "unknown", "", "ffff::"] + ["10.1.2.3"] * 400
    requests = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "request_id long, client_ip string")
    ranges = spark.createDataFrame(rows, RANGES)
    got = {r["request_id"]: r["country_code"] for r in screening.with_country(requests, ranges).collect()}
    assert len(got) == len(texts) + 1 and got[len(texts)] is None
    assert [got[i] for i in range(len(texts))] == [model(t, v4, v6) for t in texts]


def test_countries_without_ranges_or_requests(spark):
    requests = spark.createDataFrame([(1, "10.0.0.1")], "request_id long, client_ip string")
    ranges = spark.createDataFrame([], RANGES)
    assert [tuple(r) for r in screening.with_country(requests, ranges).select("request_id", "country_code").collect()] == [(1, None)]
    assert screening.with_country(requests.limit(0), ranges.drop("ip6_start", "ip6_end")).count() == 0


def test_last_start_carries_over_empty_stretches(spark):
    """One start before a thousand points in many partitions."""
    points = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("key"))
    starts = spark.createDataFrame([("00003", "a"), ("00500", "b")], "key string, range string")
    got = {r["key"]: r["range"] for r in screening.last_start(points, starts).collect()}
    assert got == {f"{i:05d}": None if i < 3 else "a" if i < 500 else "b" for i in range(1000)}
