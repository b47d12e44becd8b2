"""Values that must equal the published data contract for right results.

Everything here is a fixed value: status words, file-name patterns, text patterns and word lists.
Logic lives elsewhere.
"""

from __future__ import annotations

# --- fixed values: instruments ---------------------------------------------------------------
BENCHMARK_SYMBOL = "BTCUSDT"
TAGGED_SYMBOL = "ETHUSDT"
STABLECOIN_UNDERLYINGS = ["USDT", "USDC", "BUSD", "TUSD", "FDUSD", "USDP", "DAI", "UST", "USTC"]
QUOTE_ASSET = "USDT"
CONTRACT_TYPE = "PERPETUAL"
MARKET_FAMILY = "USDM"
PRODUCT_FAMILY = "FUTURES"

# --- fixed values: lifecycle status words ----------------------------------------------------
ANCHOR_BASIS = "first_observed_binance_futures_trade"
LEGACY_ANCHOR_BASIS = "legacy_pre_research_start_adjudicated"
EXACT_LAUNCH_BASIS = "exact_official_original_launch"
TRADE_EVIDENCE_STATUS = "checksum_verified_official_binance_futures_trade"
IN_SCOPE = "in_scope_crypto_perpetual"
BENCHMARK_ONLY = "benchmark_only"
UNRESOLVED = "unresolved"
FRONTIER_ONLY = "frontier_daily_candidate_only_no_monthly_archive_blocking"
TERMINATION_DISPOSITION = "binance_usdm_futures_termination"
ACCEPTED_CUTOFF = "accepted_exact_cutoff"
NO_RELIABLE_CUTOFF = "reviewed_no_reliable_cutoff"
CURRENT_EPISODE = "not_applicable_current_episode"
CONFLICTING_CUTOFF = "unresolved_conflicting_evidence"
READY_DELISTING_STATES = [
    "not_applicable_currently_trading",
    "exact_applicable_announcement_publication",
    "official_search_completed_no_reliable_announcement_timestamp",
    "resolved_multi_episode_currently_trading",
    "resolved_multi_episode_terminated",
    "reviewed_terminal_episode",
]

# --- fixed values: research splits -----------------------------------------------------------
SPLIT_NAMES = ["development", "validation", "final_holdout"]
DEFAULT_SPLITS = [
    ("development", "2020-01-01T00:00:00Z", "2023-06-30T23:59:59.999999Z"),
    ("validation", "2023-07-01T00:00:00Z", "2024-12-31T23:59:59.999999Z"),
    ("final_holdout", "2025-01-01T00:00:00Z", None),
]
DEFAULT_ALLOWED_SPLITS = ["development"]

# --- fixed values: object keys ---------------------------------------------------------------
MONTHLY_BAR_KEY = (
    r"^data/futures/um/monthly/klines/(?<symbol>[^/\\]{1,128})/(?<interval>1h)/"
    r"\k<symbol>-\k<interval>-(?<period>20[0-9]{2}-(?:0[1-9]|1[0-2]))\.zip\z"
)
DAILY_BAR_KEY = (
    r"^data/futures/um/daily/klines/(?<symbol>[^/\\]{1,128})/(?<interval>1h)/"
    r"\k<symbol>-1h-(?<period>20[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))\.zip\z"
)
DAILY_TRADE_KEY = (
    r"^data/futures/um/daily/trades/(?<symbol>[^/\\]{1,128})/(?<interval>)"
    r"\k<symbol>-trades-(?<period>20[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))\.zip\z"
)
MONTHLY_BAR_ROOT = "data/futures/um/monthly/klines/"
DAILY_BAR_ROOT = "data/futures/um/daily/klines/"
CHECKSUM_SUFFIX = ".CHECKSUM"

# --- fixed values: article text patterns (Java regular expressions) ---------------------------
DIRECT_SYMBOL = r"(?<![A-Z0-9])([A-Z0-9]{2,60}(?:USDT|BUSD|USDC))(?![A-Z0-9])"
SLASH_SYMBOL = r"(?U)(?<![A-Z0-9])([A-Z0-9]{1,60})\s*/\s*USDT(?![A-Z0-9])"
MARGINED_SYMBOL = r"(?iuU)(?<![A-Z0-9])([A-Z0-9]{1,60})\s+USDT-Margined\s+Contracts?\b"
SHARED_SYMBOLS = (
    r"(?U)(?<![A-Z0-9])([A-Z0-9]{1,20}(?:\s*(?:,|and)\s*[A-Z0-9]{1,20})+)"
    r"\s+USDT-Margined\s+Contracts?\b"
)
SHARED_BASE = r"([A-Z0-9]{1,20})"
DATE_FIRST = (
    r"(?iuU)(20\d{2}[-/]\d{2}[-/]\d{2})\s+(?:at\s+)?(\d{1,2}:\d{2}(?::\d{2})?)\s*(AM|PM)?\s*\(UTC\)"
)
TIME_FIRST = (
    r"(?iuU)(\d{1,2}:\d{2}(?::\d{2})?)\s*(AM|PM)?\s*\(UTC\)\s*(?:on\s+)(20\d{2}[-/]\d{2}[-/]\d{2})"
)
STRUCTURED_LAUNCH = (
    r"(?iuU)(20\d{2}[-/]\d{2}[-/]\d{2})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*(AM|PM)?\s*\(UTC\)\s*:?\s*"
    r"([A-Z0-9]{2,60}(?:USDT|USDC|BUSD))\s+Perpetual\s+Contract"
)
LEGACY_LAUNCH = (
    r"(?iuU)([A-Z0-9]{2,60}(?:USDT|USDC|BUSD))\s+Launch\s+Time\s*:?[ ]*"
    r"(20\d{2}[-/]\d{2}[-/]\d{2})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*(AM|PM)?\s*\(UTC\)"
)
LAUNCH_ACTION = (
    r"(?iuU)\b(?:will\s+)?(?:launch(?:es)?|list(?:s)?|introduce(?:s)?|begin\s+trading|"
    r"trading\s+(?:will\s+)?start)\b"
)
DELIST_ACTION = (
    r"(?iuU)\b(?:will\s+)?(?:delist(?:ing)?|cease\s+trading|settle|close\s+all\s+positions|"
    r"terminate(?:s|d)?\s+(?:the\s+)?contract)\b"
)
# One of these is part of whatever the action patterns match.
LAUNCH_STEMS = ["launch", "list", "introduce", "begin", "trading"]
DELIST_STEMS = ["delist", "cease", "settle", "close", "terminate"]
ROW_FILLER = r"(?iuU)\b(?:and|or|UTC)\b|[\s:;,()\-/]"
MIXED_PURPOSE_MARKERS = [
    "copy trading", "trading bot", "futures grid", "maintenance", "system upgrade",
    "temporary suspension", "multi-assets", "portfolio margin",
]
VENUE_TERM = "binance futures"
MARGINED_MARKET_TERM = "usdⓢ-m"
PARAMETER_TERMS = [
    "leverage and margin tiers", "leverage & margin tiers", "funding rate settlement frequency",
    "tick size", "contract specifications", "parameter update",
]
OPERATIONAL_TERMS = ["maintenance", "system upgrade", "temporary suspension"]
MULTI_ASSET_TERMS = ["portfolio margin", "multi-assets mode", "multi-assets"]
LAUNCH_CLASS = "original_perpetual_launch"
DELISTING_CLASS = "delisting_or_settlement"

# --- fixed values: paging --------------------------------------------------------------------
TAIL_PAGE_HOURS = 1500
