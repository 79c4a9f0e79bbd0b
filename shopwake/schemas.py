"""Explicit schemas of the logical tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


DEVICE = _struct(brand=S, plat=S, platv=S, softv=S, device=S, userkey=S)
GIS = _struct(ip=S)

# ``ts`` is read as text so that whole, fractional and quoted epochs all parse;
# ``keywords`` is read as text because senders use arrays and plain strings.
LOG_JSON = _struct(
    log_id=S,
    log_type=S,
    user_id=S,
    order_id=S,
    product_id=S,
    opa=S,
    ts=S,
    keywords=S,
    userAgent=S,
    gis=GIS,
    device=DEVICE,
    province=S,
    city=S,
)

SALES = _struct(
    id=S,
    order_id=S,
    user_id=S,
    user_name=S,
    product_id=S,
    size=S,
    item_id=S,
    sale_amount=T.DecimalType(10, 2),
    sale_num=L,
    total_amount=T.DecimalType(10, 2),
    product_name=S,
    ds=S,
    ts=S,
    insert_time=L,
    op=S,
    cdc_timestamp=L,
)

GMV_TOPN = _struct(
    order_date=S,
    window_start=T.TimestampNTZType(),
    window_end=T.TimestampNTZType(),
    gmv=T.DecimalType(38, 2),
    top5_ids=S,
    top5_product_ids=S,
)

USER_INFO_BASE = _struct(
    id=I,
    user_id=S,
    uname=S,
    phone_num=S,
    birthday=S,
    gender=I,
    address=S,
    ts=S,
)

USER_INFO_ENHANCED = _struct(
    ts=L,
    id=L,
    user_id=S,
    uname=S,
    phone_num=S,
    birthday=T.DateType(),
    gender=I,
    address=S,
    age_group=S,
    constellation=S,
)

USER_INFO_ENVELOPE = _struct(
    data=T.ArrayType(
        _struct(
            user_id=S, uname=S, gender=I, age_group=S, constellation=S, birthday=S
        )
    ),
    type=S,
    ts=L,
)

# ``total_amount`` stays text: it may hold a number, text or a code.
COMMENT_ROW = _struct(
    order_id=S, user_id=S, product_id=S, total_amount=S, ds=S, ts=L, comment=S
)

ORDERS_PORTRAIT = _struct(
    order_id=S,
    user_id=S,
    product_id=S,
    total_amount=S,
    product_name=S,
    product_class=S,
    ds=S,
    ts=S,
    comment=S,
)

COMMENT_RESULT = _struct(
    order_id=S,
    user_id=S,
    product_id=S,
    ds=S,
    ts=S,
    is_insulting=B,
    user_comment=S,
    db=S,
    schema=S,
    table=S,
    sensitive_level=S,
    is_blocked=B,
    blacklist_duration_days=I,
    triggered_keyword=S,
    total_amount=D,
    consumption_level=S,
)

CHANGE_SOURCE = T.StructType(
    [T.StructField(n, S) for n in ("db", "schema", "table")]
)


def change_envelope(row: T.StructType) -> T.StructType:
    """Change-event envelope around rows of the given schema."""
    return _struct(before=row, after=row, op=S, source=CHANGE_SOURCE, ts_ms=L)


IP_RANGES = _struct(start_ip=L, end_ip=L, region=S)
CITY_PROVINCE = _struct(city=S, province=S)
LEXICON = _struct(word=S, level=S)
WIDE_CELL = _struct(row_key=S, family=S, qualifier=S, value=S)
