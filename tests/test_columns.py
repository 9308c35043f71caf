import base64

import pytest
from helpers import column
from pyspark.sql import functions as F

from leafmeter.functions import columns as C
from leafmeter.limits import BOT_PATTERNS

BOTS = [
    # Named crawlers and link previews.
    "Telegrambot (preview fetcher)",
    "Mozilla/5.0 (compatible; YandexBot/9.9; +https://search.example)",
    "Embedly/7 link card",
    "WHATSAPP/9.1",
    # Words that end in bot, and other telling words.
    "Example-Robot 3",
    "tiny bot",
    "bot\u0439",
    "site-crawler/0.1",
    "Some Spider 12",
    # Scripted clients and headless browsers.
    "wget 1.0",
    "okhttp/5.0.0",
    "Java/21.0.4",
    "node-fetch/3",
    "Mozilla/5.0 (Windows NT 10.0) HeadlessChrome/130.0.1.2",
]
HUMANS = [
    # Browsers, and browsers inside apps.
    "Mozilla/5.0 (X11; Fedora; Linux x86_64; rv:130.0) Gecko/20100101 Firefox/130.0",
    "Mozilla/5.0 (Linux; Android 13; Tablet) AppleWebKit/537.36 Chrome/119.0.0.1 [Reader/Android;v3]",
    # The fragment inside a longer word, or with a look-alike letter.
    "CUBOT_P40 phone",
    "bottle",
    "slac\u212abots_x",
    "",
    None,
]


def test_bot_rule(spark):
    assert column(spark, BOTS, C.is_bot) == [True] * len(BOTS)
    assert column(spark, HUMANS, C.is_bot) == [False] * len(HUMANS)


def test_every_pattern_is_found_by_itself(spark):
    texts = ["X" + p.replace(r"\b", "").upper() + " y" for p in BOT_PATTERNS]
    found = column(spark, texts, C.bot_patterns_found)
    assert len(BOT_PATTERNS) == 51
    assert all(p in f for p, f in zip(BOT_PATTERNS, found))


WRITTEN = {
    None: None,
    "": None,
    "https://www.shop.example/find?word=a b": "shop.example",
    "https://forum.site.example/t/77": "forum.site.example",
    "http://localhost:8080/x/y": "localhost",
    "https://exa_mple.com/": "exa_mple.com",
    "mailto:a@b.c": None,
    "about:blank": None,
    "https://": "other",
    "https://ex ample.com/": "other",
    "https://WWW.Garden.ORG/": "garden.org",
    "http://[::1]:80/": "[::1]",
    "https://www./": None,
    "not a url at all": "other",
    "example.com": "other",
    "https://user:p@ss@host.com:9999/x": "host.com",
    "https://host.com:99999/": "other",
    "https:\\\\a.b\\c": "a.b",
    "https:example.com": "example.com",
    "https:///example.com": "example.com",
    "https://:80/": "other",
    "https://a.b:/": "a.b",
    "file:///etc/x": None,
    "file://srv/x": "srv",
    "file://localhost/x": None,
    "android-app://org.reader.app/": "org.reader.app",
    "app:///y": None,
    "  https://a.b/ \n": "a.b",
    "ht\ntp://a.com": "a.com",
    "://x": "other",
}
LABELS = {
    None: "direct",
    "": "direct",
    "other": "other",
    "forum.site.example": "forum.site.example",
    "localhost": "localhost",
    "a.b.c.example": "a.b.c.example",
    "exa_mple.com": "other",
    "[::1]": "other",
    "not a url at all": "other",
    "-a.com": "other",
    "a-.com": "other",
    "a..com": "other",
    "a.com.": "other",
    "A-1.Com": "A-1.Com",
    "https://www.google.com/x": "google.com",
    "about:blank": "direct",
}


def test_referrer_written(spark):
    assert column(spark, list(WRITTEN), C.referrer_written) == list(WRITTEN.values())
    long = "https://" + "a" * 300 + ".example/"
    assert [len(x) for x in column(spark, [long], C.referrer_written)] == [253]


def test_referrer_label(spark):
    assert column(spark, list(LABELS), C.referrer_label) == list(LABELS.values())


def test_referrer_round_trip(spark):
    raw = ["https://www.reddit.com/r/webdev/", "http://localhost:3000/p", "not a url at all", ""]
    stored = column(spark, raw, C.referrer_written)
    labels = column(spark, raw, lambda x: C.referrer_label(C.referrer_written(x)))
    assert labels == [s or "direct" for s in stored]


KEYS = {
    "shares/abc123.html": ("abc123", 1),
    "shares/abc123/v2.html": ("abc123", 2),
    "shares/abc123/v999.html": ("abc123", 999),
    "shares/abc123/sub/v2.html": ("abc123", 2),
    "shares/abc123/v0.html": ("abc123", None),
    "shares/abc123/v1.html": ("abc123", None),
    "shares/abc123/v007.html": ("abc123", None),
    "shares/abc123/v99999999999999999999.html": ("abc123", None),
    "shares/abc123/v9007199254740991.html": ("abc123", 2**53 - 1),
    "shares/abc123/v9007199254740992.html": ("abc123", None),
    "shares/abc123/notes.txt": ("abc123", None),
    "shares/abc123/v2.html.bak": ("abc123", None),
    "shares/abc123/xv2.html": ("abc123", None),
    "shares/v2.html": ("v2", 1),
    "elsewhere/v2.html": (None, None),
    "": (None, None),
}


def test_object_keys(spark):
    slugs = column(spark, list(KEYS), C.key_slug)
    versions = column(spark, list(KEYS), C.key_version)
    assert list(zip(slugs, versions)) == list(KEYS.values())
    made = column(spark, [-3, 0, 1, 2, 47], lambda v: C.object_key(F.lit("s"), v), "bigint")
    assert made == ["shares/s.html"] * 3 + ["shares/s/v2.html", "shares/s/v47.html"]


def test_client_ip_falls_through_on_null_only(spark):
    df = spark.createDataFrame(
        [(1, "1.1.1.1", "2.2.2.2"), (2, None, " 2.2.2.2 , 3.3.3.3"), (3, None, None), (4, "", "2.2.2.2")],
        "i int, a string, b string",
    )
    got = [r[0] for r in df.orderBy("i").select(C.client_ip(F.col("a"), F.col("b"))).collect()]
    assert got == ["1.1.1.1", "2.2.2.2", "0.0.0.0", ""]


def test_client_channel(spark):
    agents = ["share-mcp/1", "share-skill/2", "curl/8", "CURL/8", "Mozilla/5.0", "Edge", "x", "", None]
    want = ["mcp", "skill", "curl", "other", "web", "web", "other", "other", "other"]
    assert column(spark, agents, C.client_channel) == want


@pytest.mark.parametrize(
    "plain, want",
    [
        ("17:abc", (17, "abc")),
        (":abc", (0, "abc")),
        ("1.0:abc", (1, "abc")),
        ("1e3:abc", (1000, "abc")),
        ("17:a:b", (17, "a:b")),
        ("1.5:abc", None),
        ("abc:abc", None),
        ("123:", None),
        ("nocolon", None),
    ],
)
def test_cursor_decoding(spark, plain, want):
    padded = base64.b64encode(plain.encode()).decode()
    got = column(spark, [padded, padded.rstrip("=")], C.decode_cursor)
    assert [g and tuple(g) for g in got] == [want, want]


def test_bad_cursors(spark):
    assert column(spark, ["++", "a", "!!!!", "MTc6YWJj=", "", None], C.decode_cursor) == [None] * 6


def test_cursor_round_trip(spark):
    df = spark.range(50).select("id", F.concat(F.lit("s~?>"), "id").alias("slug"))
    cursor = C.encode_cursor(F.col("id") * 977, F.col("slug"))
    back = df.select("id", "slug", cursor.alias("c"), C.decode_cursor(cursor).alias("d")).collect()
    assert all(r.d == (r.id * 977, r.slug) and not set(r.c) & set("+/=") for r in back)
