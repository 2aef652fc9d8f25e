"""Fixed schemas of the tables that enter and leave the engine."""

from __future__ import annotations

BAR = (
    "symbol string, timeframe string, ts timestamp, open double, high double, "
    "low double, close double, volume bigint"
)

NESTED_CANDLES = (
    "candles array<struct<time:string,complete:boolean,volume:bigint,"
    "mid:struct<o:string,h:string,l:string,c:string>>>"
)

BROKER_RATES = "time bigint, open double, high double, low double, close double, tick_volume bigint"

CALENDAR_FEED = (
    "result array<struct<time:bigint,country:string,title:string,actual:double,"
    "forecast:double,previous:double,importance:int>>"
)

NEWS_CSV = "date string, title string"

NEWS_FEED = "datetime bigint, headline string"

_REQUEST_BAR = (
    "array<struct<time:bigint,open:double,high:double,low:double,close:double,volume:bigint>>"
)

SCORING_REQUEST = (
    f"pair string, ohlcv_m5 {_REQUEST_BAR}, ohlcv_h1 {_REQUEST_BAR}, ohlcv_h4 {_REQUEST_BAR}, "
    "events array<struct<time:bigint,event_name:string,country:string,actual:double,"
    "forecast:double,previous:double>>"
)

SCORING_RESPONSE = (
    "pair string, prediction string, confidence double, "
    "probabilities struct<BUY:double,SELL:double,HOLD:double>"
)

TRADE_LOG = (
    "ts timestamp, symbol string, action string, confidence double, entry double, sl double, "
    "tp double, ob_context string, fvg_context string, regime string, atr double, spread double"
)

# Configured pairs, class codes, currency and country codes.
PAIRS = ["EUR_USD", "GBP_USD", "USD_JPY", "AUD_USD", "XAU_USD", "USD_CAD", "USD_CHF", "NZD_USD"]
CLASS_BUY, CLASS_SELL, CLASS_HOLD = 0, 1, 2
CURRENCY_COUNTRY = {
    "EUR": "EU",
    "USD": "US",
    "GBP": "GB",
    "JPY": "JP",
    "AUD": "AU",
    "CAD": "CA",
    "CHF": "CH",
    "NZD": "NZ",
}
SYMBOL_ALIASES = {
    "BTCUSD": "EUR_USD",
    "BTC_USD": "EUR_USD",
    "XBTUSD": "EUR_USD",
}
