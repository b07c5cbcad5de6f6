"""U1 URL parts vs urllib.parse; F4/F5/F7 address predicates vs Python regex; request lines."""
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from loglens.functions.ip import ipv4_to_long, is_public, is_strict_ip, looks_like_ip
from loglens.functions.urls import request_page, request_query, url_host, url_path


def test_url_parts_match_urlparse(spark):
    rng = random.Random(9)
    hosts = ["www.Example.com", "a.b", "10.0.0.1", "h:8080", "user@h.org:81", "[::1]:80", "x_y.com"]
    paths = ["", "/", "/a/b.html", "/a;p/b;q", "/x|y^z", "/caf%C3%A9", "/a b"]
    urls = [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(paths)}"
            f"{rng.choice(['', '?q=1', '?a=b&c=d', '#frag', '?x#y'])}" for _ in range(500)]
    urls += ["mail.example.com:443", "www.example.com/path", "/relative/only", "http://", "http:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: (r.h, r.p) for r in df.select("u", url_host("u").alias("h"), url_path("u").alias("p")).collect()}
    for u in urls:
        pr = urlparse(u)
        assert got[u][0] == pr.hostname, u
        if pr.scheme in ("http", "https", "ftp"):
            assert got[u][1] == pr.path, u


def test_request_line_page_and_query(spark):
    cases = [("GET /shop/item.php?id=1 HTTP/1.1", "/shop/item.php", "id=1"),
             ("GET /index.html HTTP/1.1", "/index.html", ""),
             ("GET /a;jsessionid=1?x=1 HTTP/1.0", "/a", "x=1"),
             ("POST http://h/a?b=c#frag HTTP/1.1", "http://h/a", "b=c"),
             ("GET /p?q=a b HTTP/1.1", "/p", "q=a b"),
             ("-", None, "")]
    df = spark.createDataFrame([(c[0],) for c in cases], "r string")
    got = [(r.p, r.q) for r in df.select(request_page("r").alias("p"), request_query("r").alias("q")).collect()]
    assert got == [(c[1], c[2]) for c in cases]


def octet(text):
    return 1 <= len(text) <= 3 and text.isdigit() and int(text) <= 255


def starts_with_address(text):
    """Four octets (leading zeros allowed) at the start, the last not run into a word."""
    parts = text.split(".", 3)
    if len(parts) < 4 or not all(octet(p) for p in parts[:3]):
        return False
    n = next((i for i, c in enumerate(parts[3]) if not c.isdigit()), len(parts[3]))
    after = parts[3][n:n + 1]
    return octet(parts[3][:n]) and not (after.isalnum() or after == "_")


def is_address(text):
    """Exactly four octets without leading zeros, the first not 0."""
    parts = text.split(".")
    return len(parts) == 4 and all(octet(p) and p == str(int(p)) for p in parts) and parts[0] != "0"


def test_ip_predicates(spark):
    rng = random.Random(4)
    parts = ["0", "1", "9", "10", "99", "100", "199", "200", "249", "255", "256", "300", "01", "a", ""]
    vals = [".".join(rng.choice(parts) for _ in range(rng.choice([3, 4, 4, 5]))) + rng.choice(["", ".evil.com", ":80", "x"])
            for _ in range(2000)] + ["1.2.3.4.evil.com", " 10.0.0.1 ", "192.168.1.7", "172.16.0.1", "0.0.0.0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r.v: (r.a, r.b, r.c, r.n) for r in df.select("v", looks_like_ip("v").alias("a"), is_strict_ip("v").alias("b"),
                                                        is_public("v").alias("c"), ipv4_to_long("v").alias("n")).collect()}
    for v in vals:
        a, b, c, n = got[v]
        assert a == starts_with_address(v), v                                  # D26: prefix-anchored
        assert b == is_address(v.strip()), v
        assert c == (v != "0.0.0.0" and not v.startswith(("192.168.1.", "10.", "172.16."))), v
        if b:
            p = [int(x) for x in v.strip().split(".")]
            assert n == (p[0] << 24) + (p[1] << 16) + (p[2] << 8) + p[3]
        else:
            assert n is None
    assert got["1.2.3.4.evil.com"][0] is True and got["1.2.3.4.evil.com"][1] is False
