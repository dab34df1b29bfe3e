"""Registered queries: rates, latency, series, samples, candles, replays."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidebook.operators import ledger, metrics, replay, series
from tidebook.plans.catalog_orders import OPEN_SQL
from tidebook.plans.registry import iso_sql, query
from tidebook.schemas import MARKET_CODES

SPAN = ("1995-01-01", "2002-01-01")
SPAN_SQL = "between timestamp '1995-01-01' and timestamp '2002-01-01' - interval 1 microsecond"
SPAN_SECONDS = "(epoch(timestamp '2002-01-01') - epoch(timestamp '1995-01-01'))"
DAY = ("2024-01-10T06:00:00", "2024-01-11T05:59:59.500")
DAY_SQL = ">= timestamp '2024-01-10 06:00:00' and {} < timestamp '2024-01-11 05:59:59.5'"
LABEL = "'%Y-%m-%dT%H:%M:00Z'"


# ---- rates and latency -------------------------------------------------------------------

@query("tps", f"""
    select (select count(*) from v_order where submitted_at {SPAN_SQL}) / {SPAN_SECONDS} as accept_tps,
           (select count(*) from v_exec where executed_at {SPAN_SQL}) / {SPAN_SECONDS} as execution_tps""")
def _(v):
    return metrics.tps(v.v_order, v.v_exec, run=SPAN)


_P99 = """
    with latency as (
        select epoch_us(e.executed_at) - greatest(epoch_us(b.submitted_at), epoch_us(s.submitted_at)) as us
        from v_exec e join v_order b on b.order_id = e.buy_order_id join v_order s on s.order_id = e.sell_order_id),
    ranked as (select us, row_number() over (order by us) as r, count(*) over () as n from latency)
    select max(us) filter (where r = greatest(cast(floor(0.99 * n::double) as bigint), 1)) / 1000.0::double as p99_ms,
           count(*) as sample_count from ranked"""


@query("latency_p99", _P99)
def _(v):
    return metrics.latency_p99(v.v_order, v.v_exec, run=SPAN)


_INTERVALS = """
    opens as (select market_code, engine_instance_id, at_ts, min(offset_no) as o from v_assign where type = 'ASSIGNED' group by 1, 2, 3),
    closes as (select market_code, engine_instance_id, at_ts, offset_no as o from v_assign where type = 'RELEASED'),
    ends as (select a.market_code, a.engine_instance_id, a.at_ts, lead(a.at_ts) over m as next_at, lead(a.o) over m as next_o,
                    c.at_ts as own_at, c.o as own_o
             from opens a asof left join closes c on a.market_code = c.market_code
              and a.engine_instance_id = c.engine_instance_id and a.o < c.o
             window m as (partition by a.market_code order by a.o)),
    spans as (select market_code, engine_instance_id, at_ts as assigned_at,
                     case when own_o is not null and (next_o is null or own_o < next_o) then own_at else next_at end as released_at
              from ends)"""


@query("assignment_intervals", f"""
    with {_INTERVALS}
    select market_code, engine_instance_id, {iso_sql('assigned_at')} as assigned_at, {iso_sql('released_at')} as released_at from spans""")
def _(v):
    return ledger.assignment_intervals(v.v_assign)


@query("engines", f"""
    with {_INTERVALS}
    select engine_instance_id, count(distinct market_code) as market_count,
           string_agg(market_code || '@' || {iso_sql('assigned_at')}, ',' order by market_code) as markets
    from spans where released_at is null group by 1""")
def _(v):
    held = ledger.engines(ledger.assignment_intervals(v.v_assign))
    stamp = "transform(markets, m -> concat(m.market_code, '@', date_format(m.assigned_at, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")))"
    return held.select("engine_instance_id", F.size("markets").alias("market_count"), F.array_join(F.expr(stamp), ",").alias("markets"))


@query("dashboard", f"""
    with {_INTERVALS}, latency as (
        select epoch_us(e.executed_at) - greatest(epoch_us(b.submitted_at), epoch_us(s.submitted_at)) as us
        from v_exec e join v_order b on b.order_id = e.buy_order_id join v_order s on s.order_id = e.sell_order_id),
    ranked as (select us, row_number() over (order by us) as r, count(*) over () as n from latency)
    select (select count(*) from v_order where submitted_at {SPAN_SQL}) / {SPAN_SECONDS} as accept_tps,
           (select count(*) from v_exec where executed_at {SPAN_SQL}) / {SPAN_SECONDS} as execution_tps,
           (select count(*) from v_order where {OPEN_SQL}) as pending_orders,
           (select max(us) filter (where r = greatest(cast(floor(0.99 * n::double) as bigint), 1)) / 1000.0::double from ranked) as p99_ms,
           (select count(*) from ranked) as sample_count,
           (select count(distinct engine_instance_id) from spans where released_at is null) as running_engines,
           'last_run' as window_source""")
def _(v):
    return metrics.dashboard(v.v_order, v.v_exec, ledger.assignment_intervals(v.v_assign), run=SPAN)


# ---- series ------------------------------------------------------------------------------

def _bucketed(view, ts, width, name, where):
    return f"select cast(floor(epoch({ts}) / {width}) * {width} as bigint) as b, count(*) as {name} from {view} where {where} group by 1"


def _series_sql(first, last, width, parts):
    joins = " ".join(f"left join ({sql}) p_{name} on p_{name}.b = g.b" for name, sql in parts)
    names = ", ".join(f"coalesce(p_{name}.{name}, 0) as {name}" for name, _ in parts)
    return f"""select strftime(make_timestamp(g.b * 1000000), {LABEL}) as bucket_start, {names}
        from (select unnest(generate_series({first}, {last}, {width})) as b) g {joins}"""


_FIRST, _LAST = "epoch(timestamp '2024-01-10 06:00:00')::bigint", "epoch(timestamp '2024-01-11 05:30:00')::bigint"


def _day_part(view, ts, width, name):
    return name, _bucketed(view, ts, width, name, f"{ts} {DAY_SQL.format(ts)}")


@query("throughput_series", _series_sql(_FIRST, _LAST, 1800, [
    _day_part("v_live_order", "submitted_at", 1800, "orders"), _day_part("v_live_exec", "executed_at", 1800, "executions")]))
def _(v):
    return metrics.throughput_series(v.v_live_order, v.v_live_exec, *DAY)


@query("throughput_with_dropped", _series_sql(_FIRST, _LAST, 1800, [
    _day_part("v_live_order", "submitted_at", 1800, "orders"), _day_part("v_live_exec", "executed_at", 1800, "executions"),
    _day_part("v_live_dropped", "ts", 1800, "dropped")]))
def _(v):
    return metrics.throughput_with_dropped(v.v_live_order, v.v_live_exec, v.v_live_dropped, *DAY)


@query("dropped_series", _series_sql(_FIRST, "epoch(timestamp '2024-01-11 05:59:00')::bigint", 60, [
    ("dropped", _bucketed("v_live_dropped", "ts", 60, "dropped",
                          "ts >= timestamp '2024-01-10 06:00:00' and ts < timestamp '2024-01-11 06:00:00'"))]))
def _(v):
    return metrics.dropped_series(v.v_live_dropped, *DAY)


@query("minute_series", _series_sql(
    "epoch(timestamp '2024-01-01 00:01:00')::bigint", "epoch(timestamp '2024-01-31 00:00:00')::bigint", 60, [
        ("orders", _bucketed("v_live_order", "submitted_at", 60, "orders", "true")),
        ("executions", _bucketed("v_live_exec", "executed_at", 60, "executions", "true"))]))
def _(v):
    return metrics.minute_series(v.v_live_order, v.v_live_exec, "2024-01-31T00:00:30", minutes=30 * 24 * 60)


# ---- metric samples ----------------------------------------------------------------------

_NEWEST = "(select event_type, user_id, max_by(value, event_id) as value from v_counter group by 1, 2)"


@query("metric_rollup", f"select event_type, round(sum(value), 6) as total, count(*) as series from {_NEWEST} where event_type <> 'error' group by 1")
def _(v):
    rolled = metrics.metric_rollup(v.v_counter, ["event_type", "user_id"], "event_type", "event_id", F.col("event_type") != "error")
    return rolled.withColumn("total", F.round("total", 6))


@query("restarts_top", f"""
    select user_id, floor(sum(value))::bigint as restarts from {_NEWEST} group by 1 having sum(value) > 0
    order by restarts desc, user_id limit 20""")
def _(v):
    return metrics.restarts_top(v.v_counter, ["event_type", "user_id"], "user_id", "event_id")


@query("counter_rate", f"""
    with steps as (select ts, value, lag(value) over (partition by user_id order by ts, event_id) as before from v_counter)
    select strftime(make_timestamp(cast(floor(epoch(ts) / 60) * 60 as bigint) * 1000000), {LABEL}) as bucket_start,
           sum(case when value >= before then value - before else value end) / 60.0::double as rate
    from steps where before is not null group by 1""")
def _(v):
    return metrics.counter_rate(v.v_counter, ["user_id"], ["ts", "event_id"])


@query("resource_hourly", """
    with stepped as (select workload, pod, ts, value, cast(floor(epoch(ts) / 300) * 300 as bigint) as step from v_resource),
    newest as (select * from stepped qualify row_number() over (partition by workload, pod, step order by ts desc, value desc) = 1),
    steps as (select workload, step, sum(value) as total from newest group by 1, 2)
    select workload, strftime(make_timestamp(step * 1000000) + interval 9 hour, '%Y-%m-%d %H:00 KST') as hour_kst,
           round(avg(total), 6) as total_avg, round(max(total), 6) as total_max from steps group by 1, 2""")
def _(v):
    rolled = metrics.resource_hourly(v.v_resource)
    return rolled.withColumns({c: F.round(c, 6) for c in ("total_avg", "total_max")})


@query("consumer_lag", f"""
    select reader, {iso_sql('ts')} as ts, sum(greatest(latest_offset - committed_offset, 0))::bigint as lag from v_lag group by reader, v_lag.ts""")
def _(v):
    return metrics.consumer_lag(v.v_lag)


# ---- candles, histories, lags, flags ------------------------------------------------------

def _candle_sql(unit):
    return f"""
        select market_code, epoch(date_trunc('{unit}', ts))::bigint as start, min_by(price, sequential_id) as open, max(price) as high,
               min(price) as low, max_by(price, sequential_id) as close, sum(volume) as volume
        from (select * from v_tick) group by 1, 2"""


@query("ohlcv", " union all ".join(f"select '{u}' as unit, * from ({_candle_sql(u)})" for u in series.CANDLE_UNITS))
def _(v):
    out = None
    for unit, candles in series.all_candles(v.v_tick).items():
        candles = candles.select(F.lit(unit).alias("unit"), *candles.columns)
        out = candles if out is None else out.unionByName(candles)
    return out


def _tagged_sql():
    def candle(unit):
        return f"""select market_code, 'candle_{unit}' as type, start * 1000 as ts, open, high, low, close, volume,
            null::double as price, null::varchar as side from ({_candle_sql(unit)})"""
    return f"""{candle('second')} union all {candle('minute')}
        union all select market_code, 'trade_tick', epoch_us(ts) // 1000, null, null, null, null, volume, price,
               case ask_bid when 'BID' then 'BUY' when 'ASK' then 'SELL' else ask_bid end from v_tick"""


def _stream(v):
    candles = series.all_candles(v.v_tick)
    return series.build_stream(candles["second"], candles["minute"], v.v_tick)


@query("build_stream", _tagged_sql())
def _(v):
    return series.in_time_order(_stream(v))


@query("event_type_counts", f"select type, count(*) as events from ({_tagged_sql()}) group by 1")
def _(v):
    return series.event_type_counts(_stream(v))


@query("current_price", f"select market_code, type, ts, coalesce(price, close) as current_price from ({_tagged_sql()})")
def _(v):
    return _stream(v).select(
        "market_code", "type", "ts", series.current_price(F.col("type"), F.col("price"), F.col("close")).alias("current_price")
    )


@query("latest_events", f"""
    select * from ({_tagged_sql()}) where type = 'candle_minute' order by ts desc, market_code limit 50""")
def _(v):
    return series.latest_events(_stream(v), "candle_minute", tie=("market_code",))


@query("trade_page", f"""
    select execution_id, buy_order_id, sell_order_id, price::double as price, quantity::double as quantity, {iso_sql('executed_at')} as executed_at
    from v_exec where market_code = 'A' and (v_exec.executed_at, execution_id) < (timestamp '2001-06-01', '5')
    order by v_exec.executed_at desc, execution_id desc limit 50""")
def _(v):
    page = series.trade_page(v.v_exec, "A", cursor=(datetime(2001, 6, 1, tzinfo=timezone.utc), "5"))
    return page.drop("market_code", "mode")


@query("kst_day_slice", """
    select event_id, user_id, value from v_sample
    where ts >= timestamp '2024-01-14 15:00:00' and ts < timestamp '2024-01-15 15:00:00'""")
def _(v):
    return series.kst_day_slice(v.v_sample, "2024-01-15").select("event_id", "user_id", "value")


@query("kst_days", """
    select strftime(ts + interval 9 hour, '%Y-%m-%d') as trade_date, count(*) as rows from v_sample group by 1""")
def _(v):
    return series.by_kst_day(v.v_sample).groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))


@query("range_filter", "select order_id, market_code, ts from v_record where ts >= 1700000500000")
def _(v):
    return series.range_filter(v.v_record, from_ts=1700000500000).select("order_id", "market_code", "ts")


@query("hysteresis", """
    with marks as (select *, case when value >= 100 then 1 when value <= 20 then 0 end as mark from v_sample)
    select user_id, event_id, value, coalesce(last_value(mark ignore nulls) over (partition by user_id order by ts, event_id
           rows unbounded preceding), 0) = 1 as active from marks""")
def _(v):
    return series.hysteresis(v.v_sample, ["user_id"], ["ts", "event_id"], 100, 20).drop("ts")


@query("backpressure_flag", """
    with polled as (select reader, ts, sum(greatest(latest_offset - committed_offset, 0)) as value from v_lag group by 1, 2),
    worst as (select 1 as pipeline, ts, max(value) as value from polled group by 2),
    marks as (select *, case when value >= 200 then 1 when value <= 100 then 0 end as mark from worst)
    select ts_text as ts, value::bigint as value, active from (
    select strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as ts_text, value, coalesce(last_value(mark ignore nulls) over (order by ts rows unbounded preceding), 0) = 1 as active
    from marks)""")
def _(v):
    lag = metrics.consumer_lag(v.v_lag).withColumnRenamed("lag", "value").withColumn("pipeline", F.lit(1))
    worst = series.max_over_readers(lag, ["pipeline"])
    return series.hysteresis(worst, ["pipeline"], ["ts"], 200, 100).drop("pipeline")


@query("market_load", """
    with seen as (select market_code, arrival, "offset" as o, lag("offset") over w as po, ts, lag(ts) over w as pt
                  from (select d.*, s.ts from v_delivered d join v_sample s on s.event_id = d.arrival)
                  window w as (partition by market_code order by ts, arrival))
    select market_code, arrival, o as "offset",
           coalesce(case when o > po and epoch_us(ts) > epoch_us(pt) then (o - po) / ((epoch_us(ts) - epoch_us(pt)) / 1000000.0::double) end, 0.0) as load
    from seen""")
def _(v):
    readings = v.v_delivered.join(v.v_sample.select(F.col("event_id").alias("arrival"), "ts"), "arrival")
    return series.market_load(readings, ["ts", "arrival"]).drop("ts")


@query("gauge_trend", """
    select user_id, event_id, value, value - lag(value) over (partition by user_id order by ts, event_id) as delta from v_sample""")
def _(v):
    return series.gauge_trend(v.v_sample, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("asof_delta", """
    select a.user_id, a.event_id, a.value, b.value as before, a.value - b.value as delta
    from v_sample a asof left join v_sample b on a.user_id = b.user_id and a.ts - interval 60 second >= b.ts""")
def _(v):
    return series.asof_delta(v.v_sample, ["user_id"], "event_id").drop("ts")


@query("price_history", """
    select market_code, string_agg(cast(cast(price as decimal(18,2)) as varchar), ',' order by sequential_id) as prices,
           max_by(price, sequential_id) as price
    from (select * from v_tick qualify row_number() over (partition by market_code order by ts desc, sequential_id desc) <= 30) group by 1""")
def _(v):
    kept = series.price_history(v.v_tick, ["ts", "sequential_id"])
    return kept.withColumn("prices", F.expr("array_join(transform(prices, p -> cast(cast(p as decimal(18,2)) as string)), ',')"))


_TIER_OF = "(case when {p} >= 100 then 0.1 when {p} >= 10 then 0.01 when {p} >= 1 then 0.001 when {p} >= 0.1 then 0.0001 when {p} >= 0.01 then 0.00001 else 0.000001 end)::double"
_PLACES = "case when {p} >= 100 then 1 when {p} >= 10 then 2 when {p} >= 1 then 3 when {p} >= 0.1 then 4 when {p} >= 0.01 then 5 else 6 end"
_TEXT = "case d " + " ".join(f"when {d} then cast(cast(r as decimal(30,{d})) as varchar)" for d in range(1, 7)) + " end"


@query("quote_ladder", f"""
    with last as (select market_code, cast(floor(epoch(ts) / 2) * 2 as bigint) as interval_start, max_by(price, sequential_id) as price from v_tick group by 1, 2),
    quoted as (select market_code, interval_start, 'BUY' as side, price * (1 - 0.002::double) as q from last
               union all select market_code, interval_start, 'SELL', price * (1 + 0.002::double) from last),
    rounded as (select *, round(q / {_TIER_OF.format(p='q')}) * {_TIER_OF.format(p='q')} as r, {_PLACES.format(p='q')} as d from quoted)
    select market_code, interval_start, side, {_TEXT} as price, '0.01000000' as quantity from rounded""")
def _(v):
    return series.quote_ladder(v.v_tick, "sequential_id")


# ---- replays and reconciliation ------------------------------------------------------------

_PREVIEW = f"""select sum(n)::bigint as total_orders, count(*) as markets_with_records, {len(MARKET_CODES)}::bigint as markets_total,
    max(span) / 1000 as max_event_span_seconds from (select market_code, count(*) as n, max(ts) - min(ts) as span from v_record group by 1)"""


@query("replay_preview", _PREVIEW)
def _(v):
    return replay.replay_preview(v.v_record)


_SCHEDULE = """
    gaps as (select *, greatest(coalesce(ts - lag(ts) over (partition by market_code order by position), 0), 0) as gap from v_record),
    plan as (select *, sum(gap) over (partition by market_code order by position rows unbounded preceding)::bigint as waited from gaps)"""


@query("replay_schedule", f"with {_SCHEDULE} select market_code, order_id, waited / 1000 / 100.0::double as planned_seconds from plan")
def _(v):
    return replay.replay_schedule(v.v_record, speed=100).select("market_code", "order_id", "planned_seconds")


@query("replay_duration", f"with {_SCHEDULE} select market_code, max(waited / 1000 / 100.0::double) as duration_seconds from plan group by 1")
def _(v):
    return replay.replay_duration(replay.replay_schedule(v.v_record, speed=100))


@query("replay_progress", f"""
    select accepted, total_orders, least(100, floor(accepted / total_orders * 100 + 0.5))::bigint as count_percent,
           least(100, floor(((epoch(timestamp '1996-01-03') - epoch(timestamp '1996-01-01')) / (max_event_span_seconds / 0.001::double)) * 100 + 0.5))::bigint as time_percent
    from (select count(*) as accepted from v_order where mode = 'REPLAY' and submitted_at >= timestamp '1996-01-01' and submitted_at < timestamp '1996-01-03'),
         ({_PREVIEW})""")
def _(v):
    return replay.replay_progress(v.v_order, v.v_record, "REPLAY", "1996-01-01", "1996-01-03", speed=0.001)


@query("replay_lineage", """
    with r as (select market_code, source_order_id from v_order where mode = 'REPLAY'),
    s as (select order_id, market_code from v_order where mode <> 'REPLAY'),
    a as (select r.market_code, count(*) as replayed, count(*) filter (where s.order_id is null) as missing,
                 count(*) filter (where s.market_code = r.market_code) as same_market
          from r left join s on s.order_id = r.source_order_id group by 1),
    b as (select market_code, count(*) as sources from s group by 1),
    m as (select coalesce(a.market_code, b.market_code) as market_code, coalesce(replayed, 0) as replayed, coalesce(missing, 0) as missing,
                 coalesce(same_market, 0) as same_market, coalesce(sources, 0) as sources
          from a full join b on a.market_code = b.market_code)
    select *, replayed / sum(replayed) over () as replay_ratio, sources / sum(sources) over () as source_ratio from m""")
def _(v):
    return replay.replay_lineage(v.v_order)


@query("ledger_reconcile", """
    select coalesce(a.market_code, b.market_code) as market_code, coalesce(e, 0) as events, coalesce(o, 0) as stored,
           coalesce(e, 0) - coalesce(o, 0) as difference
    from (select market_code, count(*) as e from v_ledger_event where type = 'NEW' group by 1) a
    full join (select market_code, count(*) as o from v_text_order group by 1) b on a.market_code = b.market_code""")
def _(v):
    new_events = v.v_ledger_event.filter(F.col("type") == "NEW")
    return metrics.reconcile(["market_code"], new_events, v.v_text_order, "events", "stored")


@query("replay_rate_error", f"""
    with {_SCHEDULE}, planned as (select cast(floor(waited / 1000 / 100.0::double) as bigint) as second, count(*) as scheduled from plan group by 1),
    got as (select (ts - 1699999990000) // 100000 as second, count(*) as accepted from v_record group by 1)
    select p.second, coalesce(accepted, 0) as accepted, scheduled, abs(coalesce(accepted, 0) - scheduled) / scheduled as error,
           abs(coalesce(accepted, 0) - scheduled) / scheduled <= 0.05 as within_target
    from planned p left join got g on g.second = p.second""")
def _(v):
    scheduled = replay.replay_schedule(v.v_record, speed=100).select(F.floor("planned_seconds").alias("second"))
    accepted = v.v_record.select(F.expr("(ts - 1699999990000) div 100000").alias("second"))
    return metrics.replay_rate_error(accepted, scheduled)
