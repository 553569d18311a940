"""Addresses and blocks against Python's own reading of them."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidewatch.operators import addresses, policy


def number(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{int(ip) | (0xFFFF << 32 if ip.version == 4 else 0):032x}"


ODD = [
    "10.0.0.1", "010.0.0.1", "10.0.0.256", "10.0.0", "10.0.0.1.2", "", "::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1", "1:", "12345::", "g::", "2001:DB8::A", "::ffff:10.1.2.3", "::10.1.2.3", "1:2:3:4:5:6:10.1.2.3",
    "1:2:3:4:5:6:7:10.1.2.3", "::ffff:10.1.2.256", "::ffff:0a01:0203", "fe80::1%eth0", ":::", "1:2:3::4:5:6:7:8", "0.0.0.0", "255.255.255.255", " 10.0.0.1",
]


def test_reading_of_addresses(spark):
    rng = random.Random(8)
    texts = ODD + [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(60)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(30)]
    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", addresses.digits(F.col("ip")).alias("d")).collect()
    assert {r.ip: r.d for r in got} == {t: number(t) if "%" not in t else None for t in texts}


def held(ip, block):
    """As a reader of blocks does that takes mapped addresses for what they map."""
    plain = lambda a: a.ipv4_mapped if a.version == 6 and a.ipv4_mapped is not None else a
    try:
        address = plain(ipaddress.ip_address(ip))
        if "/" not in block:
            return plain(ipaddress.ip_address(block)) == address
        net = ipaddress.ip_network(block, strict=False)
    except ValueError:
        return False
    if net.version == 6 and plain(net.network_address).version == 4 and net.prefixlen >= 96:
        net = ipaddress.ip_network(f"{plain(net.network_address)}/{net.prefixlen - 96}", strict=False)
    return address.version == net.version and address in net


def test_blocks(spark):
    rng = random.Random(9)
    ips = ["10.1.2.3", "10.200.0.1", "::ffff:10.1.2.3", "2001:db8::1", "2001:db8:8000::1", "2001:db9::", "::1", "junk", "0.0.0.0"]
    nets = ["10.0.0.0/8", "10.1.2.3", "10.1.2.0/31", "10.1.2.3/32", "0.0.0.0/0", "::/0", "2001:db8::/32", "2001:db8::/33", "2001:db8:8000::/33", "::1", "::1/128", "::ffff:10.0.0.0/104", "::ffff:0:0/96", "::ffff:10.1.2.3", "10.0.0.0/33", "2001:db8::/129", "x/8", "10.0.0.0/", "10.0.0.0/8/8", "2001:db8::1/7"]
    nets += [f"{ipaddress.IPv6Address(0x20010DB8 << 96 | rng.getrandbits(96))}/{rng.randrange(129)}" for _ in range(20)]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in ips for b in nets)]
    df = spark.createDataFrame(pairs, "id int, ip string, cidr string")
    want = {i: held(a, b) for i, a, b in pairs}
    assert sum(want.values()) > 20
    assert {r.id: r.x for r in df.select("id", addresses.in_block(F.col("ip"), F.col("cidr")).alias("x")).collect()} == want
    # a pair as a table of one block each
    met = {r.id for r in addresses.longest_match(df.select("id", "ip"), df.select("id", "cidr")).collect()}
    assert met == {i for i, x in want.items() if x}
    assert addresses.longest_match(df.select("id", "ip"), df.select("id", "cidr").where("cidr = 'x/8'")).count() == 0


def test_longest_and_empty_lists(spark):
    table = spark.createDataFrame([(1, "10.0.0.0/8"), (1, "10.1.0.0/16"), (1, "0.0.0.0/0"), (2, "10.1.0.0/16")], "id int, cidr string")
    asked = spark.createDataFrame([(1, "10.1.9.9"), (1, "11.0.0.1"), (2, "10.2.0.0"), (3, "10.1.0.0"), (None, "10.1.0.0")], "id int, ip string")
    assert {(r.id, r.ip): r.cidr for r in addresses.longest_match(asked, table).collect()} == {(1, "10.1.9.9"): "10.1.0.0/16", (1, "11.0.0.1"): "0.0.0.0/0"}
    lists = spark.createDataFrame([(0, [], "x"), (1, ["2001:db8::/32"], "2001:db8::1"), (2, ["2001:db8::/32"], "10.0.0.1")], "id int, c array<string>, ip string")
    assert [r.x for r in lists.orderBy("id").select(policy.allowed_address(F.col("c"), F.col("ip")).alias("x")).collect()] == [True, True, False]
