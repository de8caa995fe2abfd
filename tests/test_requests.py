import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import requests

HOSTS = [
    "127.0.0.1", "192.168.0.50", "192.168.1.10", "10.0.0.5", "8.8.8.8", "010.0.0.1", "256.1.1.1", "1.2.3", "testclient", "testclient:80", "10.0.0.5:80", "", "::", "::1", "1::", "2001:db8::5", "2001:DB8:0:0::5",
    "2001:db8:0:0:0:0:0:5", "2001:db8::ffff:10.0.0.1", "::ffff:10.0.0.1", "::ffff:10.0.0.256", "fe80::1%eth0", "fe80::1%", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9",
    "1:2", ":::", "1::2::3", "12345::", "g::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "10.0.0.1::", " 10.0.0.1",
]


def plain(host, networks):
    nets = requests.parse_networks(networks)
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return True
    return not nets or any(address in n for n in nets)


def allowed(spark, hosts, networks):
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string")
    return [r["ok"] for r in frame.select("i", requests.ip_allowed(F.col("host"), networks).alias("ok")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "networks",
    ["127.0.0.1/32, nonsense, 192.168.0.0/24", "10.0.0.0/8,2001:db8::/32", "::/0", "0.0.0.0/0", "0.0.0.0/0,2001:db8::5", "10.0.0.0/8,::/0", "ffff::/16,8000::/1", "::1/128,fe80::/64", "1:2:3:4:5:6:7:8/127,2001:db8::/65,fe80::1", "", "ALL", " * ", "x"],
)
def test_hosts_as_the_standard_library_reads_them(spark, networks):
    assert allowed(spark, [*HOSTS, None], networks) == [*(plain(h, networks) for h in HOSTS), True]


def test_sentinels():
    assert [requests.parse_networks(x) for x in ("", "*", "all", "ALL", " * ", "0.0.0.0/0", ["::/0"], [])] == [[]] * 8
    assert len(requests.parse_networks("127.0.0.1/32, none, 192.168.0.0/24")) == 2


def test_ten_thousand_networks(spark):
    """As many terms as there are lengths of prefixes."""
    rnd = random.Random(1)
    networks = [f"{rnd.randrange(1, 224)}.{rnd.randrange(256)}.{rnd.randrange(256)}.0/{rnd.choice([20, 22, 24])}" for _ in range(5_000)]
    networks += [f"2001:{rnd.randrange(1 << 16):x}:{rnd.randrange(1 << 16):x}::/{rnd.choice([40, 48])}" for _ in range(5_000)]
    inside = [str(ipaddress.ip_network(n, strict=False)[5]) for n in rnd.sample(networks, 60)]
    others = [f"{rnd.randrange(1, 224)}.{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}" for _ in range(60)]
    nets = requests.parse_networks(networks)
    want = [any(ipaddress.ip_address(h) in n for n in nets) for h in inside + others]
    assert allowed(spark, inside + others, networks) == want and all(want[:60]) and not all(want)
    frame = spark.createDataFrame([("1.2.3.4",)], "host string").select(requests.ip_allowed(F.col("host"), networks).alias("ok"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" OR ") < 20 and "Python" not in plan
