"""Registered queries: intake, validation, order figures, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import ticks
from tidebook.operators import integrity as checks
from tidebook.operators import orders, replay, runs
from tidebook.plans.registry import iso_sql, query
from tidebook.schemas import MARKETS, TICK_TIERS
from tidebook.sources import decode

RUN = ("REPLAY", "1996-01-01", "2001-01-01")
RUN_SQL = "mode = 'REPLAY' and submitted_at >= timestamp '1996-01-01' and submitted_at < timestamp '2001-01-01'"
RUN_EXEC_SQL = "mode = 'REPLAY' and executed_at >= timestamp '1996-01-01' and executed_at < timestamp '2001-01-01'"
OPEN_SQL = "status in ('ACCEPTED', 'PARTIALLY_FILLED')"
MARKETS_SQL = "(values " + ", ".join(f"({i}, '{c}', '{n}', '{s}')" for i, (c, n, s) in enumerate(MARKETS)) + \
    ") dim(market_index, market_code, korean_name, symbol)"
TIERS_SQL = "(values " + ", ".join(f"({low!r}::double, {tick:.8f}::double, {d})" for low, tick, d in TICK_TIERS) + \
    ") tiers(low, tick, decimals)"
COUNTS_SQL = f"count(*) as accepted, count(*) filter (where status = 'FILLED') as filled, count(*) filter (where {OPEN_SQL}) as unfilled"


# ---- decoding ----------------------------------------------------------------------------

def _decode_sql(view, fields, types):
    picked = ", ".join(f"nullif(case when j is not null then json_extract_string(j, '$.{f}') end, '') as {f}" for f in fields)
    texts = " and ".join(f"coalesce(json_type(j, '$.{f}'), 'VARCHAR') = 'VARCHAR'" for f in fields)
    kind = f" and coalesce(json_extract_string(j, '$.type'), '') in {types}" if types else ""
    return f"""
        select message_id, {picked}
        from (select message_id, case when json_valid(body) then body::json end as j from {view})
        where j is not null and json_type(j) = 'OBJECT' and {texts}{kind}""".replace("$.", "$$.")


_ORDER_FIELDS = ("type", "orderId", "market", "side", "price", "quantity", "acceptedAt", "clientRequestId", "mode", "canceledAt", "sourceOrderId")
_EXEC_FIELDS = ("market", "buyOrderId", "sellOrderId", "price", "quantity")
_ASSIGN_FIELDS = ("type", "market", "engineInstanceId", "at")


@query("decode_orders", _decode_sql("v_order_raw", _ORDER_FIELDS, "('NEW', 'CANCEL')"))
def _(v):
    return decode.decode_orders(v.v_order_raw).filter("not rejected").drop("body", "rejected")


@query("decode_executions", _decode_sql("v_exec_raw", _EXEC_FIELDS, None))
def _(v):
    return decode.decode_executions(v.v_exec_raw).filter("not rejected").drop("body", "rejected")


@query("decode_assignments", _decode_sql("v_assign_raw", _ASSIGN_FIELDS, "('ASSIGNED', 'RELEASED')"))
def _(v):
    return decode.decode_assignments(v.v_assign_raw).filter("not rejected").drop("body", "rejected")


@query("rejected_messages", """
    select body from v_order_raw
    where not json_valid(body) or coalesce(json_extract_string(case when json_valid(body) then body end, '$$.type'), '') not in ('NEW', 'CANCEL')
       or coalesce(json_type(case when json_valid(body) then body end, '$$.price'), 'VARCHAR') <> 'VARCHAR'""")
def _(v):
    return decode.rejects(decode.decode_orders(v.v_order_raw))


# ---- market dimension --------------------------------------------------------------------

@query("market_dim", f"""
    select market_index, dim.market_code, korean_name, symbol, count(o.order_id) as orders
    from {MARKETS_SQL} left join v_dim_order o on o.market_code = dim.market_code group by 1, 2, 3, 4""")
def _(v):
    return orders.market_listing(v.v_dim_order)


@query("market_semi", f"select order_id, market_code from v_dim_order where market_code in (select market_code from {MARKETS_SQL})")
def _(v):
    return orders.market_semi(v.v_dim_order)


@query("shard_slice", f"""
    select o.order_id, o.market_code, (market_index % 4)::bigint as shard
    from v_dim_order o join {MARKETS_SQL} on o.market_code = dim.market_code""")
def _(v):
    return replay.with_shard(v.v_dim_order, 4).filter(F.col("shard").isNotNull())


# ---- validation and ticks ----------------------------------------------------------------

_P, _Q = "try_cast(price as double)", "try_cast(quantity as double)"


@query("validate_orders", f"""
    with priced as (select *, {_P} as p, {_Q} as q from v_text_order),
    ticked as (select t.*, r.tick from priced t left join {TIERS_SQL.replace('tiers(', 'r(')}
                 on r.low <= p qualify row_number() over (partition by order_id order by r.low desc) = 1)
    select order_id, market_code, side, price, quantity,
           case when market_code not in (select market_code from {MARKETS_SQL}) then 'INVALID_MARKET'
                when side not in ('BUY', 'SELL') then 'INVALID_SIDE'
                when p is null or p <= 0 then 'INVALID_PRICE'
                when abs(p / tick - round(p / tick)) >= 1e-6 then 'INVALID_PRICE_UNIT'
                when q is null or q <= 0 then 'INVALID_QUANTITY' end as error_code
    from ticked""")
def _(v):
    return orders.validate_orders(v.v_text_order.drop("mode"))


_TICKED = f"""(select order_id, price, r.tick, r.decimals from v_price left join {TIERS_SQL.replace('tiers(', 'r(')}
    on r.low <= price qualify row_number() over (partition by order_id order by r.low desc) = 1)"""


@query("tick_tier", f"select order_id, price, tick, decimals::bigint as decimals from {_TICKED}")
def _(v):
    return ticks.with_ticks(v.v_price, "price").drop("ratio")


@query("tick_valid", f"select order_id, abs(price / tick - round(price / tick)) < 1e-6 as valid from {_TICKED}")
def _(v):
    return ticks.with_ticks(v.v_price, "price").select("order_id", ticks.on_tick(F.col("ratio")).alias("valid"))


@query("round_to_tick", f"""
    select order_id, case decimals {' '.join(f"when {d} then cast(cast(round(price / tick) * tick as decimal(30,{d})) as varchar)" for d in range(9))} end as price_text,
           '0.12345679' as quantity_text
    from {_TICKED}""")
def _(v):
    return ticks.with_price_text(v.v_price, "price").select(
        "order_id", "price_text", ticks.quantity_text(F.lit(0.123456789)).alias("quantity_text")
    )


@query("default_mode", "select order_id, case when mode = 'REPLAY' then 'REPLAY' else 'PAPER_TRADING' end as mode from v_text_order")
def _(v):
    return v.v_text_order.select("order_id", orders.default_mode(F.col("mode")).alias("mode"))


_BAD = "market_code = '' or side not in ('BUY', 'SELL') or price <= 0 or quantity <= 0"


@query("sanitize_decisions", f"select *, ({_BAD}) as skipped from v_decision")
def _(v):
    return orders.sanitize_decisions(v.v_decision)


@query("decision_counts", f"select count(*) filter (where not ({_BAD})) as kept, count(*) filter (where {_BAD}) as skipped from v_decision")
def _(v):
    return orders.decision_counts(v.v_decision)


# ---- order figures -----------------------------------------------------------------------

@query("order_summary", f"select {COUNTS_SQL} from v_order where {RUN_SQL}")
def _(v):
    return orders.order_summary(v.v_order, *RUN)


@query("summary_by_market", f"select market_code, {COUNTS_SQL} from v_order where {RUN_SQL} group by 1")
def _(v):
    return orders.summary_by_market(v.v_order, *RUN)


@query("summary_by_side", f"select side, count(*) as orders from v_order where {RUN_SQL} group by 1")
def _(v):
    return orders.summary_by_side(v.v_order, *RUN)


@query("pending_orders", f"select count(*) as pending_orders from v_order where {OPEN_SQL}")
def _(v):
    return orders.pending_orders(v.v_order)


@query("orders_by_status", """
    select s.status, count(o.order_id) as orders
    from (values ('ACCEPTED'), ('PARTIALLY_FILLED'), ('FILLED'), ('CANCELED')) s(status)
    left join v_live_order o on o.status = s.status and o.submitted_at >= timestamp '2024-02-01' - interval 60000 minute
    group by 1""")
def _(v):
    return orders.orders_by_status(v.v_live_order, "2024-02-01", minutes=60000)


@query("unresolved_orders", f"select order_id, market_code from v_order where {RUN_SQL} and {OPEN_SQL}")
def _(v):
    return orders.unresolved_orders(v.v_order, *RUN)


@query("all_unresolved", f"select order_id, market_code from v_order where {OPEN_SQL}")
def _(v):
    return orders.all_unresolved(v.v_order)


@query("cleanup_cancels", f"""
    select 'CANCEL' as type, order_id::varchar as "orderId", market_code as market, '2001-09-01T00:00:00.000Z' as "canceledAt"
    from v_order where {OPEN_SQL}""")
def _(v):
    return orders.cleanup_cancels(v.v_order, "2001-09-01")


@query("fill_share", f"""
    select market_code, count(*) as accepted, count(*) filter (where status = 'FILLED') as filled,
           floor(count(*) filter (where status = 'FILLED') / count(*) * 100 + 0.5)::bigint as fill_percent,
           floor(count(*) filter (where {OPEN_SQL}) / count(*) * 100 + 0.5)::bigint as unfilled_percent,
           floor(count(*) filter (where side = 'BUY') / count(*) * 100 + 0.5)::bigint as buy_percent,
           floor(count(*) filter (where side = 'SELL') / count(*) * 100 + 0.5)::bigint as sell_percent
    from v_order where {RUN_SQL} group by 1""")
def _(v):
    return orders.fill_share(v.v_order, *RUN)


_SECONDS = "(epoch(timestamp '2001-01-01') - epoch(timestamp '1996-01-01'))"


@query("run_verdict", f"""
    select *, case when average_tps >= 10000 and fill_rate >= 90 then 'pass' else 'fail' end as verdict from (
    select count(*) as accepted, count(*) filter (where status = 'FILLED') as filled,
           count(*) / {_SECONDS} as average_tps,
           count(*) filter (where status = 'FILLED') / greatest(count(*), 1) * 100 as fill_rate
    from v_order where {RUN_SQL})""")
def _(v):
    return orders.run_verdict(v.v_order, *RUN)


@query("intake_outcomes", "select outcome, count(*) as requests from v_request group by 1")
def _(v):
    return orders.intake_outcomes(v.v_request)


# ---- integrity ---------------------------------------------------------------------------

def _over_sql(where="true"):
    return f"""with traded as (select unnest([buy_order_id, sell_order_id]) as order_id, quantity from v_exec where {where}),
        done as (select order_id, sum(quantity) as total from traded group by order_id)
        select count(*) as duplicate_executions from done join v_order o using (order_id) where done.total > o.quantity"""


def _reversal_sql(where="true"):
    def later(side):
        return f"exists (select 1 from v_order o where o.order_id = x.{side}_order_id and o.submitted_at > x.executed_at)"

    return f"""select count(*) as sequence_reversals from (select * from v_exec where {where}) x
        where {later('buy')} or {later('sell')}"""


def _filled_sql(where="true"):
    return f"""with sides as (select side, sum(quantity - remaining_quantity) as done from v_order where {where} group by side),
        both_sides as (select coalesce(sum(done) filter (side = 'BUY'), 0) as b, coalesce(sum(done) filter (side = 'SELL'), 0) as s from sides)
        select b::double as buy_filled, s::double as sell_filled, b - s between -1e-6 and 1e-6 as balanced from both_sides"""


_LOSS = f"""select count(*) as accepted, (select count(*) from v_record) as planned,
    greatest(0, (select count(*) from v_record) - count(*)) as order_loss from v_order where {RUN_SQL}"""


@query("overfilled", _over_sql())
def _(v):
    return checks.overfilled(v.v_order, v.v_exec)


@query("sequence_reversals", _reversal_sql())
def _(v):
    return checks.sequence_reversals(v.v_order, v.v_exec)


@query("filled_totals", _filled_sql())
def _(v):
    return checks.filled_totals(v.v_order)


@query("order_loss", _LOSS)
def _(v):
    return checks.order_loss(v.v_order, v.v_record, *RUN)


@query("integrity", f"""
    select a.*, b.*, c.*, d.order_loss from ({_over_sql(RUN_EXEC_SQL)}) a, ({_reversal_sql(RUN_EXEC_SQL)}) b,
           ({_filled_sql(RUN_SQL)}) c, ({_LOSS}) d""")
def _(v):
    return checks.integrity(v.v_order, v.v_exec, *RUN, planned=v.v_record)


@query("fills", """
    select buy_order_id as order_id, 'BUY' as side, quantity::double as quantity from v_exec
    union all select sell_order_id, 'SELL', quantity::double from v_exec""")
def _(v):
    return checks.fills(v.v_exec)


# ---- runs --------------------------------------------------------------------------------

@query("run_history", f"""
    select run_id, owner, status, {iso_sql('started_at')} as started_at, {iso_sql('ended_at')} as ended_at from v_run
    where owner = 'replayengine' and ended_at is not null order by v_run.ended_at desc, run_id desc limit 5""")
def _(v):
    return runs.run_history(v.v_run)


@query("recent_runs", f"""
    select run_id, owner, status, {iso_sql('started_at')} as started_at, {iso_sql('ended_at')} as ended_at,
           row_number() over (order by v_run.started_at desc, run_id desc) - 1 as slot
    from v_run order by v_run.started_at desc, run_id desc limit 3""")
def _(v):
    return runs.recent_runs(v.v_run)


@query("run_labels", f"""
    select run_id, owner, status, {iso_sql('started_at')} as started_at, {iso_sql('ended_at')} as ended_at,
           case when status = 'IN_PROGRESS' and row_number() over (order by v_run.started_at desc, run_id desc) = 1 then '실행 중'
                when status = 'IN_PROGRESS' then '오류 추정 종료' when status = 'COMPLETED' then '정상 종료'
                when status = 'STOPPED' then '사용자 중지' else '오류로 종료' end as label
    from v_run""")
def _(v):
    return runs.run_labels(v.v_run)


@query("run_sessions", f"""
    with marked as (select run_id, ts, case when ts - lag(ts) over w < interval 21600 second then 0 else 1 end as b
                    from v_beat window w as (partition by run_id order by ts)),
    numbered as (select *, sum(b) over (partition by run_id order by ts rows unbounded preceding) as s from marked),
    sessions as (select run_id, s, min(ts) as a, max(ts) as z, count(*) as beats from numbered group by 1, 2),
    latest as (select run_id, at_ts, status, message from v_outcome qualify row_number() over (partition by run_id order by at_ts desc) = 1),
    judged as (select s.*, l.at_ts, l.status, l.message, coalesce(l.at_ts >= a and l.at_ts < z + interval 21600 second, false) as rel,
                      z + interval 21600 second as expires from sessions s left join latest l on l.run_id = s.run_id)
    select run_id, {iso_sql('a')} as started_at, beats,
           case when rel then status when expires <= timestamp '2024-01-30' then 'FAILED' else 'IN_PROGRESS' end as status,
           {iso_sql("case when rel then at_ts when expires <= timestamp '2024-01-30' then expires end")} as ended_at,
           case when rel then message when expires <= timestamp '2024-01-30' then '{runs.EXPIRED_NOTE}' end as message
    from judged""")
def _(v):
    return runs.run_sessions(v.v_beat, v.v_outcome, "2024-01-30", ttl=21600)
