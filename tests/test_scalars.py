from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tabulary.functions import clock, json_args, network, text, urls


def apply(spark, values, fn, *more):
    rows = [(v, *m) for v, m in zip(values, more[0], strict=True)] if more else [(v,) for v in values]
    names = "a string, b string" if more else "a string"
    df = spark.createDataFrame(rows, names)
    return [r[0] for r in df.select(fn(F.col("a"), *([F.col("b")] if more else []))).collect()]


URLS = {
    "https://Example.Gov.SG/Decision": "https://example.gov.sg/Decision",
    "https://example.gov.sg/decision/": "https://example.gov.sg/decision",
    "http://example.gov.sg/decision": "https://example.gov.sg/decision",
    "https://example.gov.sg/": "https://example.gov.sg/",
    "  https://example.gov.sg/x  ": "https://example.gov.sg/x",
    "": "",
    "   ": "",
    "https://example.gov.sg/page?q=1&v=2": "https://example.gov.sg/page?q=1&v=2",
    "https://example.gov.sg/page#frag": "https://example.gov.sg/page#frag",
    "HTTP://A.B/c//?x=/#y/": "https://a.b/c?x=/#y/",
    "https://a.b": "https://a.b",
    "https://a.b/x?": "https://a.b/x",
    "https://a.b/x#": "https://a.b/x",
    "https://a.b/x/?#f": "https://a.b/x#f",
    "https://a.b//": "https://a.b",
    "no scheme/": "no scheme",
    "https://A.b/?Q": "https://a.b/?Q",
}


def test_normalize_url(spark):
    assert apply(spark, list(URLS), urls.normalize_url) == list(URLS.values())


def test_normalize_url_is_idempotent(spark):
    once = apply(spark, list(URLS), urls.normalize_url)
    assert apply(spark, once, urls.normalize_url) == once


def test_url_hash_is_short_hex(spark):
    (digest,) = apply(spark, ["https://a.b"], urls.url_hash)
    assert len(digest) == 16 and int(digest, 16) >= 0


def expected_prefix(ip: str) -> str:
    if not ip:
        return ""
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return "_invalid"
    if address.version == 4:
        return ip.rsplit(".", 1)[0]
    return str(ipaddress.ip_network((int(address) >> 80 << 80, 48)).network_address)


IPS = [
    "203.0.113.42", "10.0.0.1", "192.168.1.255", "2001:db8::1", "2001:db8:cafe:1::1",
    "fd00:1234:5678::1", "</system><admin>SECRET", "DROP TABLE users; --", '" OR 1=1 --',
    "\x01control", "1.2.3.4 OR 1=1", "", "256.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4.5", "::",
    "::1", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7",
    "1:2:3:4:5:6:7:", "0:0:5::", "0:7::", "12345::", "g::", "2001:DB8:0:0::7", ":::", "1.2.3.4\n",
    "::1.2.3.400", "abc:", ":",
]


def test_ip_prefix_matches_the_standard_library(spark):
    assert apply(spark, IPS, network.ip_prefix) == [expected_prefix(i) for i in IPS]


def test_ip_prefix_of_random_addresses(spark):
    rng = random.Random(7)
    picks = [ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128)) for _ in range(150)]
    picks += [ipaddress.IPv6Address(rng.getrandbits(16) << rng.choice((0, 48, 80, 96, 112))) for _ in range(150)]
    written = [p.exploded if i % 2 else str(p) for i, p in enumerate(picks)]
    assert apply(spark, written, network.ip_prefix) == [expected_prefix(w) for w in written]


@pytest.mark.parametrize(
    ("header", "depth", "expected"),
    [
        ("203.0.113.5, 10.0.0.1", 1, "203.0.113.5"),
        ("203.0.113.5", 1, "203.0.113.5"),
        ("1.1.1.1, 2.2.2.2, 3.3.3.3", 1, "2.2.2.2"),
        ("1.1.1.1, 2.2.2.2, 3.3.3.3", 2, "1.1.1.1"),
        ("1.2.3.4:80, 10.0.0.1", 1, "1.2.3.4"),
        ("[2001:db8::1]:8080, 10.0.0.1", 1, "2001:db8::1"),
        ("[::1, 10.0.0.1", 1, "[::1"),
        ("", 1, "peer"),
        (None, 1, "peer"),
        (" , ,", 1, ""),
    ],
)
def test_client_ip(spark, header, depth, expected):
    def address(a):
        return network.client_ip(a, F.lit("peer"), depth)

    assert apply(spark, [header], address) == [expected]


def test_ip_key(spark):
    given = ["[::1]", "::1", "", None, "[broken"]
    assert apply(spark, given, network.ip_key) == ["::1", "::1", "_unknown", "_unknown", "[broken"]


def test_loopback(spark):
    given = ["127.0.0.1", "127.9.9.9", "::1", "0:0:0:0:0:0:0:1", "::0.0.0.1", "10.0.0.1", "127.x",
             "::2", "", None]
    assert apply(spark, given, network.is_loopback) == [True] * 5 + [False] * 5


@pytest.mark.parametrize(
    ("at", "expected"),
    [("2026-01-01 23:55:00", 300), ("2026-01-01 23:59:59.5", 1), ("2026-01-01 23:59:58.5", 2),
     ("2026-01-01 00:00:00", 86400)],
)
def test_seconds_to_midnight(spark, at, expected):
    for kind in ("timestamp", "timestamp_ntz"):
        got = apply(spark, [at], lambda a, kind=kind: clock.seconds_to_midnight(a.cast(kind)))
        assert got == [expected]


def test_neutral_citations(spark):
    given = ["2026 SGHC 119", "2026_SGHC_119", "[2026] SGHC 119", "SGHC 119", "see 2026 SGHC 119"]
    one = "[2026] SGHC 119"
    assert apply(spark, given, text.normalize_citation) == [one, one, one, *given[3:]]


def test_request_ids(spark):
    given = ["abc-123", "a", "A" * 128, "bad!chars", "has space", "a" * 129, "", None]
    assert apply(spark, given, text.is_request_id) == [True] * 3 + [False] * 5


def test_list_arguments(spark):
    assert json_args.decode_list('["a", "b"]') == ["a", "b"]
    assert json_args.decode_list("[broken") == "[broken"
    assert json_args.decode_list(["a"]) == ["a"]
    assert json_args.decode_list(None) is None
    assert apply(spark, ['["a","b"]', "plain", "[broken"], json_args.list_column) == [
        ["a", "b"], ["plain"], ["[broken"],
    ]


def test_maps(spark):
    given = ['{"a": "TEXT", "b": "INTEGER"}', "{broken", None]
    assert apply(spark, given, json_args.map_column) == [{"a": "TEXT", "b": "INTEGER"}, {}, {}]


PHRASES = {
    "Section 5(a)": ["see section 5 (A) of the act"],
    'he said "hi"': ["then HE said: hi!"],
    "OR AND NEAR": ["or and near"],
    "NEAR/5 word": ["near 5 word"],
    "foo\\": ["a foo b"],
    "text:foo OR id:0": ["text foo or id 0"],
    "été": ["L'Été dernier"],
}


@pytest.mark.parametrize("phrase", PHRASES)
def test_phrases_are_literal_words(spark, phrase):
    def found(a):
        return text.matches_phrase(a, phrase)

    assert apply(spark, PHRASES[phrase], found) == [True]
    assert apply(spark, ["foolish id:00 nearby", "the end", ""], found) == [False] * 3


@pytest.mark.parametrize("phrase", ["*", "((((", "", "   ", "—"])
def test_phrases_without_words_match_nothing(spark, phrase):
    assert apply(spark, ["anything", ""], lambda a: text.matches_phrase(a, phrase)) == [False] * 2


def test_phrase_predicate_agrees_with_tokens(spark):
    rng = random.Random(3)
    words = ["of", "the", "off", "théâtre", "a1", "x"]
    lines = [
        "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "", "\n"]) for _ in range(8))
        for _ in range(200)
    ]
    for phrase in ("of the", "the théâtre", "a1", "x of off"):
        spaced = [f" {' '.join(text.phrase_tokens(line))} " for line in lines]
        expected = [f" {phrase} " in s for s in spaced]
        assert apply(spark, lines, lambda a, p=phrase: text.matches_phrase(a, p)) == expected
