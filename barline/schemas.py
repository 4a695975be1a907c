"""Explicit schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T

QTY = T.DecimalType(15, 6)
FEE = T.DecimalType(10, 2)
MONEY = T.DecimalType(15, 2)
METRIC = T.DecimalType(20, 8)

PRICE_FIELDS = ("open", "high", "low", "close", "volume")

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_FIELDS]
)

REPORTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("mack", T.StringType()),
        T.StructField("tenbaocao", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("nguon", T.StringType()),
        T.StructField("ngaykn", T.TimestampType()),
        T.StructField("rsnganh", T.StringType()),
    ]
)

POSITIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("quantity", QTY),
        T.StructField("purchase_price", QTY),
        T.StructField("purchase_date", T.DateType()),
        T.StructField("notes", T.StringType()),
    ]
)

CLOSE_REQUESTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("position_id", T.LongType()),
        T.StructField("quantity_to_close", QTY),
        T.StructField("closing_price", QTY),
        T.StructField("closing_date", T.DateType()),
        T.StructField("fees", FEE),
        T.StructField("notes", T.StringType()),
    ]
)

# The keys a sector import may carry (data contract of the import file).
SECTOR_METRICS = (
    "smg", "dif", "dif_w", "dif_m", "dif_3m", "vonhoa_d", "eps_d", "pe_d", "pb_d", "roa_ttm",
    "roe_ttm", "lnst_yoy_ttm", "doanhthuthuan_ttm", "lnst_ttm", "ocf_ttm", "lnst_yoy_q",
    "novay_q", "tonkho_q", "phaithu_q", "tts_q", "vcsh_q",
)
