"""Ledger-shaped views over the given tables.

The registered queries need orders, executions, ticks and so on. These views derive them
from the tables in SQL that reads the same in Spark and in the checking engine, so both
sides start from the same rows. `$name` stands for a table.
"""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import DataFrame, SparkSession

from tidebook.schemas import MARKET_CODES
from tidebook.sources.tables import TABLES, read_table

_MARKET_20 = "case o_custkey % 20 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MARKET_CODES)) + " end"
MARKET_22 = (
    "case o_custkey % 22 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MARKET_CODES)) + " else 'KRW-NONE' end"
)
_EXEC_MARKET = "case l_orderkey % 22 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MARKET_CODES)) + " else 'KRW-NONE' end"
_DAY = "substr(cast(o_orderdate as string), 1, 10) || 'T00:00:00.000Z'"
_KEY = "cast(o_orderkey as string)"

VIEWS = {
    "v_order": """
        select o_orderkey as order_id, 'req-' || cast(o_orderkey as string) as client_request_id,
               o_orderpriority as market_code,
               case when o_custkey % 2 = 0 then 'BUY' else 'SELL' end as side,
               cast(o_totalprice as decimal(24,8)) as price,
               cast(1 + o_orderkey % 50 as decimal(24,8)) as quantity,
               case when o_orderstatus = 'F' then cast(0 as decimal(24,8))
                    when o_orderstatus = 'O' then cast(1 + o_orderkey % 50 as decimal(24,8))
                    else cast((1 + o_orderkey % 50) * 0.5 as decimal(24,8)) end as remaining_quantity,
               case when o_orderstatus = 'O' and o_custkey % 5 = 0 then 'CANCELED' when o_orderstatus = 'O' then 'ACCEPTED'
                    when o_orderstatus = 'P' then 'PARTIALLY_FILLED' else 'FILLED' end as status,
               case when o_custkey % 3 = 0 then 'REPLAY' else 'PAPER_TRADING' end as mode,
               o_orderdate as submitted_at,
               case when o_custkey % 3 = 0 then o_orderkey - 1 - o_custkey % 7 end as source_order_id
        from $orders""",
    "v_exec": """
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                 || '-' || cast(l_suppkey as string) as execution_id,
               l_returnflag as market_code, l_orderkey as buy_order_id, l_orderkey + l_linenumber as sell_order_id,
               cast(l_extendedprice as decimal(24,8)) as price, cast(l_quantity as decimal(24,8)) as quantity,
               case when l_suppkey % 3 = 0 then 'REPLAY' else 'PAPER_TRADING' end as mode, l_shipdate as executed_at
        from $lineitem""",
    "v_fill": """
        select l_orderkey as buy_order_id, l_orderkey + l_linenumber as sell_order_id,
               cast(l_extendedprice as decimal(24,8)) as price, cast(l_quantity * 0.1 as decimal(24,8)) as quantity,
               l_shipdate as executed_at
        from $lineitem""",
    "v_sample": "select user_id, event_id, ts, value from $events",
    "v_tick": """
        select event_type as market_code, value as price, ts, cast(1 + event_id % 50 as double) as volume,
               case event_id % 3 when 0 then 'BID' when 1 then 'ASK' else 'MID' end as ask_bid, event_id as sequential_id
        from $events""",
    "v_text_order": f"""
        select o_orderkey as order_id, {MARKET_22} as market_code,
               case when o_custkey % 11 = 0 then 'HOLD' when o_custkey % 2 = 0 then 'BUY' else 'SELL' end as side,
               case when o_orderkey % 13 = 0 then 'abc' when o_orderkey % 17 = 0 then '0'
                    when o_orderkey % 19 = 0 then cast(o_totalprice as string)
                    else cast(cast(round(o_totalprice / 50) * 50 as bigint) as string) end as price,
               case when o_orderkey % 23 = 0 then '-1' when o_orderkey % 29 = 0 then ''
                    else cast(1 + o_orderkey % 50 as string) end as quantity,
               case o_custkey % 4 when 0 then 'REPLAY' when 1 then 'PAPER_TRADING' when 2 then 'OTHER' end as mode
        from $orders""",
    "v_price": """
        select o_orderkey as order_id,
               case o_orderkey % 12 when 0 then o_totalprice * 100e0 when 1 then o_totalprice * 10e0 when 2 then o_totalprice
                    when 3 then o_totalprice * 1e-1 when 4 then o_totalprice * 1e-2 when 5 then o_totalprice * 1e-3
                    when 6 then o_totalprice * 1e-4 when 7 then o_totalprice * 1e-5 when 8 then o_totalprice * 1e-6
                    when 9 then o_totalprice * 1e-7 when 10 then o_totalprice * 1e-8 else o_totalprice * 1e-9 end as price
        from $orders""",
    "v_order_raw": f"""
        select o_orderkey as message_id,
               case when o_orderkey % 41 = 0 then 'not json'
                    when o_orderkey % 37 = 0 then '{{"type":"WEIRD","orderId":"ord_' || {_KEY} || '"}}'
                    when o_orderkey % 31 = 0 then '{{"type":"CANCEL","orderId":"ord_' || {_KEY} || '","market":"'
                         || o_orderpriority || '","canceledAt":"' || {_DAY} || '"}}'
                    when o_orderkey % 29 = 0 then '{{"type":"NEW","orderId":"ord_' || {_KEY} || '","price":12.5}}'
                    when o_orderkey % 23 = 0 then '{{"type":"NEW","orderId":"ord_' || {_KEY}
                    else '{{"type":"NEW","orderId":"ord_' || {_KEY} || '","market":"' || o_orderpriority || '","side":"'
                         || case when o_custkey % 2 = 0 then 'BUY' else 'SELL' end || '","price":"'
                         || cast(o_totalprice as string) || '","quantity":"' || cast(1 + o_orderkey % 50 as string)
                         || '","acceptedAt":"' || {_DAY} || '","clientRequestId":"","mode":"REPLAY","extra":[{{"market":3}}],"meta":{{"price":1,"type":null}}}}' end as body
        from $orders""",
    "v_exec_raw": """
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                 || '-' || cast(l_suppkey as string) as message_id,
               case when l_partkey % 41 = 0 then '[]' when l_partkey % 37 = 0 then '{"market":"A","quantity":3}'
                    else '{"market":"' || l_returnflag || '","buyOrderId":"ord_' || cast(l_orderkey as string)
                         || '","sellOrderId":"ord_' || cast(l_orderkey + l_linenumber as string) || '","price":"'
                         || cast(l_extendedprice as string) || '","quantity":"' || cast(l_quantity as string) || '"}' end as body
        from $lineitem""",
    "v_order_topic": f"""
        select o_orderkey * 2 as message_id,
               case when o_orderkey % 41 = 0 then 'not json'
                    when o_orderkey % 37 = 0 then '{{"type":"WEIRD","orderId":"ord_' || {_KEY} || '"}}'
                    else '{{"type":"NEW","orderId":"ord_' || {_KEY} || '","market":"' || {MARKET_22} || '","side":"'
                         || case when o_custkey % 2 = 0 then 'BUY' else 'SELL' end || '","price":"'
                         || cast(o_totalprice as string) || '","quantity":"' || cast(1 + o_orderkey % 9 as string)
                         || '","acceptedAt":"' || {_DAY} || '","clientRequestId":"","mode":"REPLAY"}}' end as body
        from $orders
        union all
        select o_orderkey * 2 + 1, '{{"type":"CANCEL","orderId":"ord_' || {_KEY} || '","market":"' || {MARKET_22}
               || '","canceledAt":"' || {_DAY} || '"}}'
        from $orders where o_orderstatus = 'O'""",
    "v_exec_topic": f"""
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                 || '-' || cast(l_suppkey as string) as message_id,
               case when l_partkey % 41 = 0 then '[]'
                    else '{{"market":"' || {_EXEC_MARKET} || '","buyOrderId":"ord_' || cast(l_orderkey as string)
                         || '","sellOrderId":"ord_' || cast(l_orderkey + l_linenumber as string) || '","price":"'
                         || cast(l_extendedprice as string) || '","quantity":"' || cast(1 + l_linenumber % 2 as string) || '"}}' end as body
        from $lineitem""",
    "v_assign_raw": """
        select event_id as message_id,
               case when event_id % 41 = 0 then '{"type":' when event_id % 37 = 0 then '{"type":"OTHER"}'
                    else '{"type":"' || case when event_id % 4 = 0 then 'RELEASED' else 'ASSIGNED' end || '","market":"'
                         || event_type || '","engineInstanceId":"engine-' || cast(user_id % 5 as string) || '","at":"'
                         || substr(cast(ts as string), 1, 10) || 'T00:00:00.000Z"}' end as body
        from $events""",
    "v_ledger_event": """
        select 'NEW' as type, o_orderkey as order_id, o_orderpriority as market_code,
               case when o_custkey % 2 = 0 then 'BUY' else 'SELL' end as side,
               cast(o_totalprice as decimal(24,8)) as price, cast(1 + o_orderkey % 50 as decimal(24,8)) as quantity,
               case when o_custkey % 3 = 0 then 'REPLAY' else 'PAPER_TRADING' end as mode, o_orderdate as submitted_at,
               'req-' || cast(o_orderkey as string) as client_request_id, cast(null as bigint) as source_order_id,
               cast(null as timestamp) as canceled_at, o_orderkey * 4 as offset_no
        from $orders
        union all
        select 'NEW', o_orderkey, o_orderpriority, 'BUY', cast(1 as decimal(24,8)), cast(1 as decimal(24,8)), 'REPLAY',
               o_orderdate + interval '1' day, 'again', cast(null as bigint), cast(null as timestamp), o_orderkey * 4 + 1
        from $orders where o_orderstatus = 'F'
        union all
        select 'CANCEL', o_orderkey, o_orderpriority, null, null, null, null, cast(null as timestamp), null, null,
               o_orderdate + interval '30' day, o_orderkey * 4 + 2
        from $orders where o_orderstatus = 'O'
        union all
        select 'CANCEL', o_orderkey, o_orderpriority, null, null, null, null, cast(null as timestamp), null, null,
               o_orderdate + interval '60' day, o_orderkey * 4 + 3
        from $orders where o_orderstatus = 'O' and o_custkey % 2 = 0""",
    "v_cancel": """
        select o_orderkey * 2 as cancel_id, o_orderkey + o_custkey % 3 as order_id, o_orderdate + interval '400' day as canceled_at
        from $orders where o_orderstatus <> 'F'
        union all
        select o_orderkey * 2 + 1, o_orderkey + o_custkey % 3, o_orderdate + interval '900' day
        from $orders where o_orderstatus = 'O'""",
    "v_book": """
        select event_type as market_code, case when user_id % 4 = 0 then 'SELL' else 'BUY' end as side, event_id as order_id,
               cast(value as decimal(24,8)) as price, cast(1 + event_id % 50 as decimal(24,8)) as quantity, event_id as offset_no
        from $events where user_id % 2 = 0""",
    "v_incoming": """
        select event_type as market_code, case when user_id % 4 = 1 then 'BUY' else 'SELL' end as side, event_id as order_id,
               cast(value as decimal(24,8)) as price, cast(500 as decimal(24,8)) as quantity
        from $events where user_id % 2 = 1""",
    "v_beat": "select user_id as run_id, ts from $events",
    "v_outcome": """
        select user_id as run_id, ts + interval '20' minute as at_ts,
               case when event_id % 3 = 0 then 'COMPLETED' when event_id % 3 = 1 then 'STOPPED' else 'FAILED' end as status,
               event_type as message
        from $events where event_type = 'purchase'""",
    "v_run": """
        select o_orderkey as run_id, case when o_custkey % 3 = 0 then 'replayengine' else 'trader' end as owner,
               case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'IN_PROGRESS'
                    else case when o_custkey % 2 = 0 then 'STOPPED' else 'FAILED' end end as status,
               o_orderdate as started_at,
               case when o_orderstatus <> 'O' then o_orderdate + interval '1' day end as ended_at
        from $orders""",
    "v_request": """
        select event_type || '-' || cast(user_id % 3 as string) as client_request_id, ts, event_id,
               case when event_type = 'error' then 'rejected_backpressure' when event_type = 'signup' then 'canceled'
                    else 'accepted' end as outcome
        from $events""",
    "v_delivered": """
        select event_type as market_code, event_id as arrival,
               event_id - case when event_id % 10 = 0 then 25 when event_id % 10 = 1 then 12 else 0 end as offset
        from $events""",
    "v_counter": "select user_id, event_id, ts, cast(event_id % 1000 as double) as value, event_type from $events",
    "v_resource": "select event_type as workload, user_id as pod, ts, value from $events",
    "v_lag": """
        select event_type as reader, user_id as part, cast(substr(cast(ts as string), 1, 13) || ':00:00' as timestamp) as ts,
               event_id as latest_offset, event_id + 20 - cast(floor(value) as bigint) as committed_offset
        from $events""",
    "v_assign": """
        select case when event_id % 4 = 0 then 'RELEASED' else 'ASSIGNED' end as type, event_type as market_code,
               'engine-' || cast(user_id % 5 as string) as engine_instance_id, ts as at_ts, event_id as offset_no
        from $events
        union all
        select 'ASSIGNED', event_type, 'engine-' || cast(user_id % 5 as string), ts, event_id + 30
        from $events where event_id % 4 = 1""",
    "v_record": f"""
        select {_MARKET_20} as market_code, 1700000000000 + o_orderkey * 700 - (o_custkey % 5) * 1000 as ts,
               o_orderkey as position, case when o_custkey % 2 = 0 then 'BUY' else 'SELL' end as side,
               cast(o_totalprice as string) as price, cast(1 + o_orderkey % 50 as string) as quantity,
               'ord_' || {_KEY} as order_id
        from $orders""",
    "v_new_order": f"""
        select 'NEW' as type, o_orderkey as order_id, {MARKET_22} as market_code,
               case when o_custkey % 2 = 0 then 'BUY' else 'SELL' end as side,
               cast(o_totalprice as decimal(24,8)) as price, cast(1 + o_orderkey % 50 as decimal(24,8)) as quantity,
               case when o_custkey % 3 = 0 then 'REPLAY' else 'PAPER_TRADING' end as mode, o_orderdate as submitted_at,
               'req-' || cast(o_orderkey as string) as client_request_id, o_orderkey * 2 as offset_no
        from $orders
        union all
        select 'NEW', o_orderkey, {MARKET_22}, 'BUY', cast(1 as decimal(24,8)), cast(1 as decimal(24,8)), 'REPLAY',
               o_orderdate + interval '1' day, 'req-' || cast(o_orderkey as string), o_orderkey * 2 + 1
        from $orders where o_orderstatus = 'F'""",
    "v_dim_order": f"select o_orderkey as order_id, {MARKET_22} as market_code from $orders",
    "v_live_order": """
        select event_id as order_id, ts as submitted_at, event_type as market_code,
               case event_type when 'view' then 'ACCEPTED' when 'click' then 'PARTIALLY_FILLED' else 'FILLED' end as status
        from $events where event_type in ('view', 'click', 'signup')""",
    "v_live_exec": "select event_id as execution_id, ts as executed_at from $events where event_type = 'purchase'",
    "v_live_dropped": "select ts from $events where event_type = 'error'",
    "v_decision": """
        select event_id, case when event_id % 17 = 0 then '' else event_type end as market_code,
               case event_id % 7 when 0 then 'HOLD' when 1 then 'SELL' else 'BUY' end as side,
               case when event_id % 13 = 0 then -value else value end as price,
               cast(event_id % 11 as double) as quantity
        from $events""",
}
# Reserved words of the checking engine: the views say offset_no and at_ts.
RENAMED = {"offset_no": "offset", "at_ts": "at"}


def with_views(sql: str, tables: dict[str, str]) -> str:
    """`sql` with the views it names put in front."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    heads = ", ".join(f"{name} as ({VIEWS[name]})" for name in used)
    body = sql.strip()
    for head in ("with recursive ", "with "):
        if used and body.startswith(head):
            body = f"{head}{heads}, {body[len(head):]}"
            break
    else:
        body = f"with {heads} {body}" if used else body
    return Template(body).substitute(tables)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame; only the tables it reads are opened."""
    names = {table: f"tidebook_{table}" for table in TABLES}
    sql = with_views(f"select * from {name}", names)
    for table, alias in names.items():
        if re.search(rf"\b{alias}\b", sql):
            read_table(spark, folder, table).createOrReplaceTempView(alias)
    return spark.sql(sql).withColumnsRenamed(RENAMED)


def oracle_text(sql: str) -> str:
    return with_views(sql, {table: table for table in TABLES})
