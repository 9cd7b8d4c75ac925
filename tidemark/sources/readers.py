"""Readers: raw payloads become typed rows. Schemas are explicit, bad values become nulls, nothing is inferred."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars

ACTIVITY = "proxyWallet string, timestamp long, conditionId string, type string, size string, usdcSize string, transactionHash string, price string, asset string, side string, outcomeIndex int"
BOOK = "bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>"
POINTS = "array<struct<t:string,ts:string,timestamp:string,p:string,price:string>>"
POSITION = "asset string, conditionId string, size string, avgPrice string, curPrice string, currentValue string, realizedPnl string, title string, outcome string"
#: Names under which a portfolio's value may stand, in the order in which they are tried. Fixed values.
VALUE_KEYS = ("value", "totalValue", "portfolioValue", "currentValue")
#: Signatures of the two layouts of a fill's log. Fixed values.
FILL_V1 = "OrderFilled(bytes32,address,address,uint256,uint256,uint256,uint256,uint256)"
FILL_V2 = "OrderFilled(bytes32,address,address,uint8,uint256,uint256,uint256,uint256,bytes32,bytes32)"
KNOWN_TYPES = ("TRADE", "SPLIT", "MERGE", "REDEEM", "REWARD", "MAKER_REBATE", "TAKER_REBATE")


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Activity pages (JSON arrays, plain or gzip) as raw rows."""
    return spark.read.schema(ACTIVITY).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def normalise_activity(raw: DataFrame) -> DataFrame:
    """Ledger rows with signed deltas, and a dedupe key that keeps byte-identical rows apart by a running number.

    Unknown types are kept with zero deltas. A row that a later page repeats has the same key.
    """
    size, usdc = (F.coalesce(F.col(c).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)")) for c in ("size", "usdcSize"))
    kind, side = F.upper(F.trim("type")), F.upper(F.trim("side"))
    out = raw.select(
        F.lower("proxyWallet").alias("wallet"), kind.alias("event_type"), F.col("timestamp").alias("ts"), F.col("transactionHash").alias("tx_hash"),
        scalars.condition_id(F.col("conditionId")).alias("condition_id"), F.nullif("asset", F.lit("")).alias("token_id"), F.nullif(side, F.lit("")).alias("side"),
        size.alias("size"), usdc.alias("usdc_size"), F.col("price").try_cast("decimal(20,6)").alias("price"),
    )
    zero = F.lit(0).cast("decimal(20,6)")
    buys, sells = F.col("side") == "BUY", F.col("side") == "SELL"
    out_of, into = F.col("event_type").isin("MERGE", "REDEEM"), F.col("event_type") == "SPLIT"
    pays = F.col("event_type").isin("REWARD", "MAKER_REBATE", "TAKER_REBATE")
    shares = F.when(buys | into, F.col("size")).when(sells | out_of, -F.col("size")).otherwise(zero)
    cash = F.when(buys | into, -F.col("usdc_size")).when(sells | out_of | pays, F.col("usdc_size")).otherwise(zero)
    known = F.col("event_type").isin(*KNOWN_TYPES)
    out = out.withColumns({"delta_shares": F.when(known, shares).otherwise(zero), "delta_usdc": F.when(known, cash).otherwise(zero)})
    parts = ["wallet", "event_type", "ts", "tx_hash", "condition_id", "token_id", "side", "size", "usdc_size"]
    same = Window.partitionBy(*parts).orderBy("price")
    out = out.withColumn("duplicate_index", F.row_number().over(same) - 1)
    return out.withColumn("dedupe_key", scalars.dedupe_key(*(F.col(p) for p in [*parts, "duplicate_index"])))


def _levels(side: Column, best_first_down: bool) -> Column:
    typed = F.transform(side, lambda x: F.struct(x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size")))
    real = F.filter(typed, lambda x: x["price"].isNotNull())
    ordered = F.array_sort(real, lambda a, b: F.signum(b["price"] - a["price"]).cast("int") if best_first_down else F.signum(a["price"] - b["price"]).cast("int"))
    return F.slice(F.coalesce(ordered, F.array().cast("array<struct<price:double,size:double>>")), 1, 10)


def parse_books(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Order books from JSON: ten best levels a side, best prices, spread, mid, depth at one and five levels, imbalance."""
    j = F.from_json(payload, BOOK)
    out = raw.withColumn("_j", j).withColumns({"bids": _levels(F.col("_j.bids"), True), "asks": _levels(F.col("_j.asks"), False)}).drop("_j")

    def depth(side: str, n: int) -> Column:
        return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda a, x: a + x["size"])

    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    out = out.withColumns({"best_bid": bid, "best_ask": ask, "bid_depth_top1": depth("bids", 1), "ask_depth_top1": depth("asks", 1), "bid_depth_top5": depth("bids", 5), "ask_depth_top5": depth("asks", 5)})
    total = F.col("bid_depth_top5") + F.col("ask_depth_top5")
    return out.withColumns({
        "spread": F.col("best_ask") - F.col("best_bid"), "mid": (F.col("best_ask") + F.col("best_bid")) / 2,
        "imbalance": F.try_divide(F.col("bid_depth_top5") - F.col("ask_depth_top5"), F.nullif(total, F.lit(0.0))),
    })


def parse_history(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Price points ``ts, price`` of a JSON history, with the row's other columns.

    A payload is a list of points or an object with a ``history`` list; a point names its time ``t``, ``ts`` or ``timestamp`` and its
    price ``p`` or ``price``, as numbers or text. Points without both, and payloads of another form, give no rows.
    """
    rest = [c for c in raw.columns if c != payload]
    listed = F.coalesce(F.from_json(F.get_json_object(payload, "$.history"), POINTS), F.from_json(payload, POINTS))
    points = raw.select(*rest, F.explode(listed).alias("x"))
    ts = F.coalesce(*(F.col(f"x.{c}") for c in ("t", "ts", "timestamp")))
    price = F.coalesce("x.p", "x.price")
    out = points.select(*rest, ts.try_cast("double").cast("long").alias("ts"), price.try_cast("double").alias("price"))
    return out.where("ts is not null and price is not null")


_ROUNDS = 24


def _keccak_constants() -> list[int]:
    """Round constants by the degree-eight shift register that defines them."""
    out, state = [], 1
    for _ in range(_ROUNDS):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state >> 7 else 0)
        out.append(value)
    return out


_RC = _keccak_constants()
_MASK = (1 << 64) - 1


def _permuted(a: list[list[int]]) -> list[list[int]]:
    def turn(v: int, n: int) -> int:
        n %= 64
        return ((v << n) | (v >> (64 - n))) & _MASK

    for rc in _RC:
        parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        a = [[a[x][y] ^ parity[x - 1] ^ turn(parity[(x + 1) % 5], 1) for y in range(5)] for x in range(5)]
        moved = [[0] * 5 for _ in range(5)]
        moved[0][0] = a[0][0]
        x, y = 1, 0
        for t in range(24):
            moved[y][(2 * x + 3 * y) % 5] = turn(a[x][y], (t + 1) * (t + 2) // 2)
            x, y = y, (2 * x + 3 * y) % 5
        a = [[moved[x][y] ^ (~moved[(x + 1) % 5][y] & moved[(x + 2) % 5][y] & _MASK) for y in range(5)] for x in range(5)]
        a[0][0] ^= rc
    return a


def keccak256(data: bytes, rate: int = 136) -> bytes:
    """Keccak-256 with the original padding, as event topics use it."""
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 1) % rate)
    padded[-1] |= 0x80
    state = [[0] * 5 for _ in range(5)]
    for start in range(0, len(padded), rate):
        for k in range(rate // 8):
            state[k % 5][k // 5] ^= int.from_bytes(padded[start + 8 * k : start + 8 * k + 8], "little")
        state = _permuted(state)
    return b"".join(state[k % 5][k // 5].to_bytes(8, "little") for k in range(4))


@F.arrow_udf(T.StringType())
def keccak_hex(text: pa.Array) -> pa.Array:
    """Topic hash of an event signature as 0x hex."""
    return pa.array(["0x" + keccak256(t.encode()).hex() if t is not None else None for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def hex_to_decimal(text: pa.Array) -> pa.Array:
    """256-bit hex words as decimal text; no numeric type of Spark holds them."""
    return pa.array([str(int(t, 16)) if t else None for t in text.to_pylist()], pa.string())


def _amount(word: Column) -> Column:
    """A 256-bit amount in units of six places, exact up to 38 digits; null beyond."""
    return (hex_to_decimal(word).try_cast("decimal(38,0)").cast("double") / F.lit(1_000_000)).cast("double")


def decode_order_filled(logs: DataFrame, v1: str | None = None, v2: str | None = None) -> DataFrame:
    """Fills from logs with ``topics`` (array of hex words) and ``data`` (hex): ids as decimal text, amounts in units.

    The first topic says which layout the data has. The first has maker asset, taker asset, maker amount, taker amount, fee;
    the second has side (0: the maker buys, 1: it sells), token, maker amount, taker amount, fee. ``layout`` is 1 or 2; a
    log of another topic, with fewer topics or words than its layout, or of another side has a null layout and null fields.
    """
    topics = {1: v1 or "0x" + keccak256(FILL_V1.encode()).hex(), 2: v2 or "0x" + keccak256(FILL_V2.encode()).hex()}
    data, first = F.regexp_replace("data", "^0x", ""), F.lower(F.get("topics", F.lit(0)))

    def word(k: int) -> Column:
        return F.substring(data, k * 64 + 1, 64)

    def address(k: int) -> Column:
        return F.concat(F.lit("0x"), F.lower(F.right(F.get("topics", F.lit(k)), F.lit(40))))

    words = F.floor(F.length(data) / 64)
    side = F.ltrim(word(0), F.lit("0"))
    known = (F.size("topics") >= 4) & F.col("data").isNotNull()
    layout = F.when(known & (first == topics[1]) & (words >= 5), 1).when(known & (first == topics[2]) & (words >= 7) & side.isin("", "1"), 2)
    rest = [c for c in logs.columns if c not in ("topics", "data")]
    out = logs.select(*rest, "topics", "data", layout.alias("layout"))
    l1, l2 = F.col("layout") == 1, F.col("layout") == 2
    maker = F.when(l1, hex_to_decimal(word(0))).when(l2, F.when(side == "", F.lit("0")).otherwise(hex_to_decimal(word(1))))
    taker = F.when(l1, hex_to_decimal(word(1))).when(l2, F.when(side == "", hex_to_decimal(word(1))).otherwise(F.lit("0")))
    any_ = F.col("layout").isNotNull()
    return out.select(
        *rest, "layout", F.when(any_, F.lower(F.get("topics", F.lit(1)))).alias("order_hash"), F.when(any_, address(2)).alias("maker"), F.when(any_, address(3)).alias("taker"),
        maker.alias("maker_asset_id"), taker.alias("taker_asset_id"),
        *(F.when(any_, _amount(word(k))).alias(n) for k, n in ((2, "maker_amount"), (3, "taker_amount"), (4, "fee"))),
    )


def parse_positions(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Positions that a venue states, from JSON arrays: one row each with decimals; a row without an asset is left out.

    A number that is missing or unreadable is zero; ``has_avg_price`` and ``has_realized`` say whether it was there.
    """
    rest = [c for c in raw.columns if c != payload]
    rows = raw.select(*rest, F.explode(F.from_json(payload, f"array<struct<{', '.join(c.replace(' ', ':') for c in POSITION.split(', '))}>>")).alias("p"))

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"p.{name}").try_cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)"))

    names = {"size": "size", "avg_price": "avgPrice", "cur_price": "curPrice", "current_value": "currentValue", "realized_pnl": "realizedPnl"}
    return rows.where("p.asset is not null and p.asset != ''").select(
        *rest, F.col("p.asset").alias("token_id"), F.lower(F.nullif("p.conditionId", F.lit(""))).alias("condition_id"), *(number(v).alias(k) for k, v in names.items()),
        F.col("p.title").alias("title"), F.col("p.outcome").alias("outcome"), F.col("p.avgPrice").isNotNull().alias("has_avg_price"), F.col("p.realizedPnl").isNotNull().alias("has_realized"),
    )


def parse_value(payload: Column) -> Column:
    """A portfolio's value from JSON: a number, an object that holds it under one of the known names, or a list of either."""

    def of_object(j: Column) -> Column:
        found = F.coalesce(*(F.get_json_object(j, f"$.{k}") for k in VALUE_KEYS))
        return F.coalesce(F.coalesce(found, F.trim(j, F.lit('"'))).try_cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)"))

    items = F.from_json(payload, "array<string>")
    zero = F.lit(0).cast("decimal(38,8)")
    total = F.aggregate(F.transform(items, of_object), zero, lambda a, x: (a + x).cast("decimal(38,8)"))
    return F.when(F.ltrim(payload).startswith("["), F.coalesce(total, zero)).otherwise(of_object(payload).cast("decimal(38,8)"))


#: Columns of an exported fill that are numbers, and times. Fixed values.
FILL_NUMBERS = (
    "fill_price", "fill_size", "delta_usdc", "book_before_age_s", "best_bid_before", "best_ask_before", "spread_before", "mid_before",
    "book_after_age_s", "best_bid_after", "best_ask_after", "spread_after", "mid_after", "edge_vs_mid_before", "estimated_edge_usdc",
)
FILL_TIMES = ("trade_utc", "book_before_utc", "book_after_utc")


def clean_fills(fills: DataFrame, label: str) -> DataFrame:
    """Fills of an exported CSV made fit for use; every row stays.

    Numbers and times are typed (unreadable ones become null), role, side and context in lower case; added are
    ``wallet_label``, ``notional``, ``signed_shares`` (null for another side), and whether the book before the fill is at most
    60 (``valid_before_book``) or 15 seconds old (``strict_before_book``). Missing columns are an error.
    """
    lower = ("role", "side", "context_status")
    if missing := sorted({*FILL_NUMBERS, *FILL_TIMES, *lower} - set(fills.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = fills.withColumn("wallet_label", F.lit(label))
    out = out.withColumns({c: F.col(c).try_cast("double") for c in FILL_NUMBERS} | {c: F.col(c).try_cast("timestamp") for c in FILL_TIMES})
    out = out.withColumns({c: F.lower(c) for c in lower})
    age = F.col("book_before_age_s")
    return out.withColumns({
        "notional": F.abs("delta_usdc"),
        "signed_shares": F.when(F.col("side") == "buy", F.col("fill_size")).when(F.col("side") == "sell", -F.col("fill_size")),
        "valid_before_book": F.coalesce(age <= 60, F.lit(False)),
        "strict_before_book": F.coalesce(age <= 15, F.lit(False)),
    })


def block_at(blocks: DataFrame, ts: int) -> DataFrame:
    """The first block at or after a time."""
    return blocks.where(F.col("ts") >= ts).agg(F.min_by("number", F.struct("ts", "number")).alias("number"), F.min("ts").alias("ts"))


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header and a stated schema; missing required columns are an error before anything runs."""
    out = spark.read.option("header", True).schema(schema).csv(path)
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def optional_table(spark: SparkSession, name: str, columns: tuple[str, ...] = ()) -> DataFrame | None:
    """A table of the catalog if it exists with these columns."""
    if not spark.catalog.tableExists(name):
        return None
    df = spark.table(name)
    return df if set(columns) <= set(df.columns) else None
