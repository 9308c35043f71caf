"""Constants every job takes its defaults from."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400


@dataclass(frozen=True)
class Limits:
    """Tunable limits; the defaults are fixed values of the service the data comes from."""

    max_html_bytes: int = 1_000_000
    upload_gap_seconds: int = 30
    pending_age_seconds: int = 300
    keep_versions: int = 10
    write_attempts: int = 3
    pii_retention_seconds: int = 90 * DAY
    top_referrers: int = 5
    top_locations: int = 8
    trend_days: int = 30
    page_default: int = 50
    page_max: int = 100
    claim_tokens: int = 50
    rate_window_seconds: int = 60
    list_per_ip: int = 60
    list_per_key: int = 30
    write_per_ip: int = 30
    device_saves: int = 200
    browser_saves: int = 50
    reason_chars: int = 2_000
    sniff_chars: int = 4_096
    referrer_chars: int = 253


LIMITS = Limits()

# Stored states and formats of the data.
SHARE_STATUSES = ("pending", "committed", "deleted")
REPORT_STATUSES = ("open", "actioned", "dismissed")
SERVED_SLUG = r"^[a-z0-9]{8,16}$"
KEY_PREFIX = "key_"
SYNC_KEY_BEARER = rf"^Bearer\s+{KEY_PREFIX}[A-Za-z0-9_-]{{43}}$"
CLIENT_PREFIXES = (("share-mcp/", "mcp"), ("share-skill/", "skill"), ("curl/", "curl"))
BROWSER_WORDS = r"(?i)mozilla|chrome|safari|firefox|edge|webkit"
MAX_VERSION = 2**53 - 1

# User-agent fragments of crawlers, link previews and scripted clients.
BOT_PATTERNS = (
    "slackbot",
    "discordbot",
    "twitterbot",
    "telegrambot",
    "whatsapp/",
    "facebookexternalhit",
    "linkedinbot",
    "redditbot",
    "skypeuripreview",
    "embedly",
    "iframely",
    "nuzzel",
    "vkshare",
    "flipboardproxy",
    "googlebot",
    "google-inspectiontool",
    "bingbot",
    "yandexbot",
    "duckduckbot",
    "baiduspider",
    "applebot",
    "ahrefsbot",
    "semrushbot",
    "petalbot",
    "bytespider",
    "gptbot",
    "oai-searchbot",
    "chatgpt-user",
    "claudebot",
    "anthropic-ai",
    "perplexitybot",
    "ccbot",
    r"bot\b",
    "crawler",
    "spider",
    "slurp",
    "headlesschrome",
    "phantomjs",
    "monitoring",
    "uptimerobot",
    "pingdom",
    "curl/",
    "wget",
    "python-requests",
    "python-urllib",
    "go-http-client",
    "node-fetch",
    "axios/",
    "okhttp",
    "libwww-perl",
    "java/",
)
