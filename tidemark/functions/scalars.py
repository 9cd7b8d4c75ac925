"""Scalar functions of the domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories in use, in the order in which a market's tags are tried. Fixed values.
CATEGORIES = ("sports", "politics", "crypto", "economics", "culture", "weather", "tech", "world")


def condition_id(raw: Column) -> Column:
    r"""Hex ids written as ``0x...`` or ``\x...`` become lower-case ``0x...``; anything else stays."""
    return F.when(raw.rlike(r"^(?:0x|\\x)[0-9a-fA-F]+$"), F.concat(F.lit("0x"), F.lower(F.substring(raw, 3, 1000)))).otherwise(raw)


def dedupe_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by pipes; a null part is empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def fixed(value: Column, places: int = 6) -> Column:
    """Decimal text with a fixed number of places."""
    return value.cast(f"decimal(28,{places})").cast("string")


def fee(shares: Column, price: Column, rate: Column, exponent: Column) -> Column:
    """Fee of a fill, half-even to four places; nothing at prices outside (0, 1)."""
    raw = shares * price * rate * F.pow(price * (1 - price), exponent)
    return F.when((price > 0) & (price < 1), F.bround(raw, 4)).otherwise(F.lit(0.0))


def category(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(raw)), F.lit("")), F.lit("unclassified"))


def category_of_tags(tags: Column) -> Column:
    """First tag, in tag order, that names a category."""
    low = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.coalesce(F.try_element_at(F.filter(low, lambda t: t.isin(*CATEGORIES)), F.lit(1)), F.lit("unclassified"))


def structure_type(n_tokens: Column, neg_risk: Column, event_id: Column) -> Column:
    pair = n_tokens == 2
    return F.when(pair & neg_risk & event_id.isNotNull(), "negRisk-event-member").when(pair, "binary").otherwise("unclassified")


def directional(q0: Column, q1: Column) -> Column:
    return q0 - q1


def bond(q0: Column, q1: Column) -> Column:
    return F.least(q0, q1)


def context_status(age_s: Column, most: int = 30) -> Column:
    return (
        F.when(age_s.isNull(), "missing").when(age_s > most, "stale").when(age_s <= 2, "excellent")
        .when(age_s <= 5, "good").when(age_s <= 10, "usable").otherwise("weak")
    )


def price_bucket(price: Column) -> Column:
    """Decile of a price from 0 to 9."""
    return F.least(F.floor(price * 10), F.lit(9)).cast("long")


def bucket_midpoint(bucket: Column) -> Column:
    return (bucket + 0.5) / 10


def time_bucket(seconds: Column) -> Column:
    """Bucket of the wait for the other leg; bounds belong to the longer bucket."""
    return (
        F.when(seconds.isNull(), "not_completed").when(seconds < 10, "under_10s").when(seconds < 60, "under_60s").when(seconds < 300, "1m_5m")
        .when(seconds < 900, "5m_15m").when(seconds < 3600, "15m_60m").otherwise("over_60m")
    )


def cost_bucket(cost: Column) -> Column:
    """Bucket of what a complete set costs."""
    return (
        F.when(cost.isNull(), "unknown").when(cost < 0.90, "lt_0_90").when(cost < 0.95, "0_90_0_95").when(cost < 0.98, "0_95_0_98")
        .when(cost <= 1.00, "0_98_1_00").otherwise("gt_1_00")
    )


def volume_bucket(usdc: Column) -> Column:
    return F.when(usdc < 100, "<100").when(usdc < 500, "100-500").when(usdc < 1000, "500-1000").otherwise(">=1000")


def event_phase(progress: Column) -> Column:
    return (
        F.when(progress < 0, "pregame").when(progress < 0.35, "early_live").when(progress.between(0.45, 0.60), "halftime")
        .when(progress <= 1, "late_live").otherwise("post_event")
    )


def close_path(reason: Column, last_type: Column) -> Column:
    """How an episode ended, from why it closed and the type of its last event."""
    return (
        F.when(reason == "open", "OPEN")
        .when(reason == "flat", F.when(last_type == "TRADE", "SELL").when(last_type == "MERGE", "MERGE").otherwise("MIXED"))
        .when(
            reason == "resolution",
            F.when(last_type.isin("REDEEM", "REDEEM_PAYOUT"), "REDEEM").when(last_type == "RESOLUTION_SETTLEMENT", "RESOLUTION").otherwise("UNKNOWN"),
        )
        .otherwise("UNKNOWN")
    )


def traded_token(maker_asset: Column, taker_asset: Column) -> Column:
    """The outcome token of a fill: asset 0 is the collateral."""
    return F.when(maker_asset == "0", taker_asset).otherwise(maker_asset)


def traded_amount(maker_asset: Column, maker_amount: Column, taker_amount: Column) -> Column:
    return F.when(maker_asset == "0", taker_amount).otherwise(maker_amount)


def collateral_amount(maker_asset: Column, taker_asset: Column, maker_amount: Column, taker_amount: Column) -> Column:
    """What was paid in collateral; nothing where neither asset is, null where they are unknown."""
    return F.when(maker_asset.isNull() | taker_asset.isNull(), None).when(maker_asset == "0", maker_amount).when(taker_asset == "0", taker_amount).otherwise(F.lit(0))


def drift_bps(before: Column, after: Column) -> Column:
    return (after - before) / F.nullif(before, F.lit(0.0)) * 10000


def signed_by_side(value: Column, side: Column) -> Column:
    """The value in the favour of who traded: as it is for a buy, negated otherwise."""
    return F.when(side == "BUY", value).otherwise(-value)


def transfer_class(sender: Column, receiver: Column, wallet: Column, null_address: str = "0x" + "0" * 40) -> Column:
    return (
        F.when((sender == null_address) & (receiver == wallet), "MINT").when((sender == wallet) & (receiver == null_address), "BURN")
        .when(receiver == wallet, "TRANSFER_IN").when(sender == wallet, "TRANSFER_OUT").otherwise("OTHER")
    )


def cluster_verdict(total: Column, matched: Column, delay: Column, same_token: Column, candidate_first: Column, same_event: Column, size_ratio: Column) -> Column:
    """What a candidate's matched trades say of it and its leader; delays in seconds, shares from 0 to 1."""
    size_ok = (size_ratio > 0) & size_ratio.between(0.5, 2.0)
    return (
        F.when((total == 0) | (matched == 0), "independent")
        .when((delay <= 5) & (same_token >= 0.5) & size_ok, "same_system_candidate")
        .when((delay > 5) & (delay <= 300) & (same_token >= 0.3) & (candidate_first <= 0.2), "follower")
        .when((same_event >= 0.3) & (same_token < 0.3), "shared_signal")
        .when(matched / total >= 0.1, "research_candidate").otherwise("independent")
    )


def research_priority(overlap: Column, closed_cycles: Column, profit_week: Column) -> Column:
    """Two fifths overlap, three tenths closed cycles, three tenths a week's profit up to 10,000."""
    return overlap * 0.4 + closed_cycles * 0.3 + F.least(F.greatest(profit_week, F.lit(0.0)), F.lit(10000.0)) / 10000 * 0.3


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def saturating(value: Column, half: float) -> Column:
    return value / (value + F.lit(half))


def trade_price(price: Column, usdc: Column, shares: Column) -> Column:
    """The stated price if it is positive, else what was paid a share."""
    return F.when(price > 0, price).otherwise(F.abs(F.try_divide(usdc, F.nullif(shares, F.lit(0.0)))))


def inventory_action(qty_before: Column, other_before: Column, delta: Column) -> Column:
    return (
        F.when((delta > 0) & (other_before > qty_before), "forms set").when(delta > 0, "increases directional")
        .when(delta < 0, "reduces directional").otherwise("none")
    )


def fill_role(maker: Column, taker: Column, wallet: Column, exchanges: tuple[str, ...] = ("exchange",)) -> Column:
    """A fill whose taker is the exchange itself was taken by the wallet that is its maker."""
    return (
        F.when((maker == wallet) & taker.isin(*exchanges), "taker").when(maker == wallet, "maker")
        .when(taker == wallet, "taker").otherwise("ambiguous")
    )


def day_of(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def keyword_match(words: tuple[str, ...], *values: Column) -> Column:
    """Whether any of the words stands in the values, lower-cased and with white space as single spaces."""
    whole = F.regexp_replace(F.lower(F.concat_ws(" ", *values)), r"\s+", " ")
    hit = F.lit(False)
    for w in words:
        hit = hit | whole.contains(w)
    return hit


def json_list(raw: Column) -> Column:
    """A JSON list of text; anything else is an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
