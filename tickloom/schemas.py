"""Fixed schemas of the files that are read, as DDL."""

# The twelve columns of a kline row, in file order.
KLINES = (
    "`Open Time` bigint, Open string, High string, Low string, Close string, Volume string, "
    "`Close Time` bigint, `Quote Asset Volume` string, `Number of Trades` bigint, "
    "`Taker Buy Base Asset Volume` string, `Taker Buy Quote Asset Volume` string, Ignore string")

EXCHANGE = "exchange string, symbols array<struct<symbol:string,status:string>>"
