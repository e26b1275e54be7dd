from orderlytics.functions.columns import (  # noqa: F401
    COUNT_DEC,
    MONEY,
    MONEY_SUM,
    amount,
    day,
    day_name,
    day_number,
    iso_dow,
    label,
    money,
    money_total,
    month_start,
    out_num,
    percent,
    ratio,
    round2,
)
