"""Registered queries: ledger, books, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import book, ledger, series
from tidebook.plans import flows
from tidebook.plans.catalog_metrics import _candle_sql, _tagged_sql
from tidebook.plans.catalog_orders import MARKETS_SQL
from tidebook.plans.fixtures import MARKET_22
from tidebook.plans.registry import ORACLES, iso_sql, query
from tidebook.session import small_tasks, work_folder
from tidebook.sources import decode, files
from tidebook.sources.tables import stream_table
from tidebook.streaming import accept, jobs, sessions
from tidebook.streaming import ledger as stream_ledger

FILL_ORDER = ["executed_at", "quantity", "price"]


# ---- ledger ------------------------------------------------------------------------------

def _fills_once(where="true"):
    """First execution per pair."""
    return f"""(select * from v_fill where {where}
        qualify row_number() over (partition by buy_order_id, sell_order_id order by executed_at, quantity, price) = 1)"""


def _ledger_sql(events="true", fills="true"):
    return f"""
        select n.order_id, n.market_code, n.side, n.price, n.quantity, n.mode, n.submitted_at, n.client_request_id,
               n.source_order_id, n.offset_no as opened, n.quantity - coalesce(f.filled, 0) as remaining_quantity,
               case when n.quantity - coalesce(f.filled, 0) <= 0 then 'FILLED' when c.order_id is not null then 'CANCELED'
                    when f.filled > 0 then 'PARTIALLY_FILLED' else 'ACCEPTED' end as status,
               case when n.quantity - coalesce(f.filled, 0) > 0 then c.canceled_at end as canceled_at
        from (select * from v_ledger_event where type = 'NEW' and {events}
              qualify row_number() over (partition by order_id order by offset_no) = 1) n
        left join (select * from v_ledger_event where type = 'CANCEL' and {events}
              qualify row_number() over (partition by order_id order by offset_no) = 1) c on c.order_id = n.order_id
        left join (select order_id, sum(quantity) as filled from (
                     select buy_order_id as order_id, quantity from {_fills_once(fills)}
                     union all select sell_order_id, quantity from {_fills_once(fills)}) group by 1) f on f.order_id = n.order_id"""


_LEDGER_SHOWN = f"""
    select order_id, market_code, side, price::double as price, quantity::double as quantity, mode, {iso_sql('submitted_at')} as submitted_at,
           client_request_id, source_order_id, opened, remaining_quantity::double as remaining_quantity, status, {iso_sql('canceled_at')} as canceled_at
    from ({_ledger_sql()})"""


@query("order_ledger", _LEDGER_SHOWN)
def _(v):
    return ledger.order_ledger(v.v_ledger_event, v.v_fill, "offset", FILL_ORDER)


def _known(kind, market):
    """Messages of a topic that can be read and are of a market of the dimension."""
    topic = "v_order_topic" if kind else "v_exec_topic"
    typed = f"json_extract_string(body, '$$.type') = '{kind}'" if kind else "body like '{%'"
    return f"""(select body::json as body, message_id from (select message_id, case when json_valid(body) and {typed} then body end as body from {topic})
               where body is not null and body::json->>'$$.{market}' <> 'KRW-NONE')"""


@query("ledger_from_messages", f"""
    with opened as (select body->>'$$.orderId' as order_id, body->>'$$.market' as market_code, (body->>'$$.quantity')::decimal(24,8) as quantity from {_known('NEW', 'market')}),
    stopped as (select distinct body->>'$$.orderId' as order_id from {_known('CANCEL', 'market')}),
    done as (select distinct body->>'$$.buyOrderId' as b, body->>'$$.sellOrderId' as s, (body->>'$$.quantity')::decimal(24,8) as q from {_known(None, 'market')}),
    filled as (select order_id, sum(q) as filled from (select b as order_id, q from done union all select s, q from done) group by 1)
    select o.order_id, market_code, (quantity - coalesce(filled, 0))::double as remaining_quantity,
           case when quantity <= coalesce(filled, 0) then 'FILLED' when c.order_id is not null then 'CANCELED'
                when filled > 0 then 'PARTIALLY_FILLED' else 'ACCEPTED' end as status
    from opened o left join filled f on f.order_id = o.order_id left join stopped c on c.order_id = o.order_id""")
def _(v):
    orders = v.v_order_topic.withColumnRenamed("message_id", "offset")
    executions = v.v_exec_topic.withColumnRenamed("message_id", "offset")
    return flows.ledger_from_messages(orders, executions).select("order_id", "market_code", "remaining_quantity", "status")


@query("replay_plan", """
    with days as (select *, make_timestamp(ts * 1000) + interval 9 hour as kst from v_record where market_code in ('KRW-BTC', 'KRW-LA', 'KRW-SLX', 'KRW-WLD', 'KRW-AI')),
    chosen as (select * from days where strftime(kst, '%Y-%m-%d') = '2023-11-15')
    select market_code as market_code, order_id, (ts - min(ts) over (partition by market_code)) / 1000 / 500.0::double as planned_seconds from chosen""")
def _(v):
    root = work_folder(v.spark)
    rows = v.v_record.select(F.col("market_code").alias("market"), "ts", "side", "price", "quantity", "order_id")
    files.write_order_records(rows, root, reset=True)
    plan = flows.replay_plan(v.spark, root, "2023-11-15", speed=500, shard=(1, 4))
    return plan.select("market_code", "order_id", "planned_seconds")


@query("dedup_executions", f"""
    select buy_order_id, sell_order_id, price::double as price, quantity::double as quantity, {iso_sql('executed_at')} as executed_at
    from {_fills_once()} where not exists (select 1 from v_exec x where x.mode = 'REPLAY'
        and x.buy_order_id = _q.buy_order_id and x.sell_order_id = _q.sell_order_id)""".replace(") where not exists", ") _q where not exists"))
def _(v):
    return ledger.dedup_executions(v.v_fill, FILL_ORDER, stored=v.v_exec.filter(F.col("mode") == "REPLAY"))


@query("resolve_mode", """
    select e.execution_id, e.buy_order_id, e.sell_order_id, e.quantity::double as quantity, coalesce(b.mode, s.mode) as mode,
           b.order_id is not null as buy_found, s.order_id is not null as sell_found, coalesce(b.mode <> s.mode, false) as mode_mismatched
    from v_exec e left join v_order b on b.order_id = e.buy_order_id left join v_order s on s.order_id = e.sell_order_id""")
def _(v):
    return ledger.resolve_mode(v.v_exec.select("execution_id", "buy_order_id", "sell_order_id", "quantity"), v.v_order)


@query("trace_order", f"""
    with touched as (select buy_order_id as order_id, * from v_exec union all
                     select sell_order_id, * from v_exec where sell_order_id <> buy_order_id)
    select o.order_id, o.market_code, o.side, o.quantity::double as quantity, o.status, t.buy_order_id, t.sell_order_id,
           {iso_sql('t.executed_at')} as executed_at, t.quantity::double as executed_quantity
    from v_order o left join touched t on t.order_id = o.order_id""")
def _(v):
    return ledger.trace_orders(v.v_order.select("order_id", "market_code", "side", "quantity", "status"), v.v_exec)


@query("insert_orders", f"""
    with batch as (select * from v_new_order where market_code <> 'KRW-NONE' qualify row_number() over (partition by order_id order by offset_no) = 1),
    stored as (select order_id, client_request_id from v_order where mode = 'REPLAY')
    select order_id, client_request_id, market_code, side, price::double as price, quantity::double as quantity, mode, {iso_sql('submitted_at')} as submitted_at
    from batch where order_id not in (select order_id from stored) and client_request_id not in (select client_request_id from stored)""")
def _(v):
    stored = v.v_order.filter(F.col("mode") == "REPLAY")
    fresh = ledger.insert_orders(v.v_new_order, stored)
    return fresh.select("order_id", "client_request_id", "market_code", "side", "price", "quantity", "mode", "submitted_at")


@query("idempotent_orders", """
    with recursive numbered as (select client_request_id as k, ts, event_id from v_request),
    nxt as (select a.event_id, min_by(b.event_id, (b.ts, b.event_id)) as next_id
            from numbered a join numbered b on a.k = b.k and b.ts > a.ts + interval 3600 second group by 1),
    chain as (select min_by(event_id, (ts, event_id)) as event_id from numbered group by k
              union select n.next_id from chain c join nxt n on n.event_id = c.event_id where n.next_id is not null)
    select r.client_request_id, r.event_id from v_request r join chain c on c.event_id = r.event_id""")
def _(v):
    requests = v.v_request.select("client_request_id", "ts", "event_id")
    return ledger.accepted_requests(requests, "client_request_id", "event_id").select("client_request_id", "event_id")


@query("offset_dedup", """
    select market_code, arrival, "offset" from (select *, max("offset") over (partition by market_code order by arrival
        rows between unbounded preceding and 1 preceding) as seen from v_delivered) where seen is null or "offset" > seen""")
def _(v):
    return ledger.offset_dedup(v.v_delivered, "arrival")


@query("cancel_outcome", f"""
    with sides as (select buy_order_id as order_id, quantity, executed_at from v_fill union all select sell_order_id, quantity, executed_at from v_fill),
    judged as (select c.cancel_id, c.order_id, c.canceled_at, o.quantity as ordered,
                      o.quantity - coalesce((select sum(s.quantity) from sides s where s.order_id = c.order_id and s.executed_at <= c.canceled_at), 0) as left_over
               from v_cancel c left join v_order o on o.order_id = c.order_id),
    firsts as (select order_id, min_by(cancel_id, (canceled_at, cancel_id)) as first_id, min_by(left_over, (canceled_at, cancel_id)) as first_left
               from judged where left_over > 0 group by 1)
    select j.order_id, j.cancel_id,
           case when ordered is null then 'ORDER_NOT_FOUND' when left_over <= 0 then 'ORDER_ALREADY_FILLED'
                when cancel_id = first_id then 'CANCELED' else 'ALREADY_CANCELED' end as outcome,
           case when left_over > 0 then first_left::double end as canceled_quantity
    from judged j left join firsts f on f.order_id = j.order_id""")
def _(v):
    return ledger.cancel_outcomes(v.v_cancel, v.v_order, v.v_fill)


# ---- books -------------------------------------------------------------------------------

_AT = "timestamp '1998-07-01'"
_BOOK_SQL = f"""
    select market_code, side, order_id, trunc(price, 8) as price, remaining_quantity as quantity, opened as "offset"
    from ({_ledger_sql(f"coalesce(canceled_at, submitted_at) <= {_AT}", f"executed_at <= {_AT}")})
    where status in ('ACCEPTED', 'PARTIALLY_FILLED')"""


def _book(v):
    return book.book_at(v.v_ledger_event, v.v_fill, "1998-07-01", "offset", FILL_ORDER)


@query("book_at", f'select market_code, side, order_id, price::double as price, quantity::double as quantity, "offset" from ({_BOOK_SQL})')
def _(v):
    return book.book_snapshot(_book(v))


@query("book_size", f"select market_code, count(*) as resting_orders from ({_BOOK_SQL}) group by rollup(market_code)")
def _(v):
    return book.book_size(_book(v))


@query("book_levels", """
    with levels as (select market_code, side, price, sum(quantity) as quantity from v_book group by 1, 2, 3),
    ranked as (select *, row_number() over (partition by market_code, side order by case when side = 'BUY' then -price else price end) as level from levels)
    select market_code, side, price::double as price, quantity::double as quantity, level from ranked where level <= 20""")
def _(v):
    return book.book_levels(v.v_book)


@query("sweep_fill", """
    with queue as (select *, coalesce(sum(quantity) over (partition by market_code, side order by case when side = 'BUY' then -price else price end, offset_no
                                rows between unbounded preceding and 1 preceding), 0) as before from v_book)
    select i.market_code, case when i.side = 'BUY' then i.order_id else q.order_id end as buy_order_id,
           case when i.side = 'BUY' then q.order_id else i.order_id end as sell_order_id, q.price::double as price,
           least(q.quantity, i.quantity - q.before)::double as quantity
    from v_incoming i join queue q on q.market_code = i.market_code and q.side <> i.side and q.before < i.quantity
     and case when i.side = 'BUY' then q.price <= i.price else q.price >= i.price end""")
def _(v):
    return book.sweep_fill(v.v_book, v.v_incoming)


# ---- files -------------------------------------------------------------------------------

@query("write_order_records", "select market_code as market, ts, side, price, quantity, order_id from v_record")
def _(v):
    root = work_folder(v.spark)
    rows = v.v_record.select(F.col("market_code").alias("market"), "ts", "side", "price", "quantity", "order_id")
    files.flush_order_records(rows.filter(F.col("side") == "BUY"), root, "run", 0)
    for _ in range(2):  # the second flush is repeated, which leaves one copy
        files.flush_order_records(rows.filter(F.col("side") == "SELL"), root, "run", 1)
    return files.read_order_records(v.spark, root).drop("trade_date")


@query("read_order_records", f"""
    select market_code as market, strftime(make_timestamp(ts * 1000) + interval 9 hour, '%Y-%m-%d') as trade_date, count(*) as orders,
           min(ts) as first_ts, max(ts) as last_ts from v_record group by 1, 2""")
def _(v):
    root = work_folder(v.spark)
    rows = v.v_record.select(F.col("market_code").alias("market"), "ts", "side", "price", "quantity", "order_id")
    files.write_order_records(rows, root, reset=True)
    return files.read_order_records(v.spark, root).groupBy("market", "trade_date").agg(
        F.count(F.lit(1)).alias("orders"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


_STAMP_SQL = "strftime({}, '%Y%m%dT%H%M%SZ')"
_PATHS_SQL = f"""select distinct event_type || '/' || {_STAMP_SQL.format("date_trunc('hour', ts)")} || '_x_orders.json' as path,
    strftime(date_trunc('hour', ts) + interval 9 hour, '%Y-%m-%d') as d from v_counter"""


def _stamp(ts):
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


@query("replay_dates", f"select distinct d as date from ({_PATHS_SQL})")
def _(v):
    paths = v.v_counter.select(
        F.concat(F.col("event_type"), F.lit("/"), _stamp(F.date_trunc("hour", "ts")), F.lit("_x_orders.json")).alias("path")
    )
    return files.replay_dates(paths)


_BATCH_UNITS = (("days", "day"), ("weeks", "week"), ("months", "month"), ("years", "year"))


def _batch_candles(v):
    candles = series.all_candles(v.v_tick)
    return {name: candles[unit] for name, unit in _BATCH_UNITS}


@query("build_candle_batch", " union all ".join(
    f"select market_code as market, '{name}' as unit, start * 1000 as ts, open, high, low, close, volume from ({_candle_sql(unit)})"
    for name, unit in _BATCH_UNITS))
def _(v):
    documents = files.build_candle_batch(_batch_candles(v))
    return files.explode_batch(documents)


@query("read_market_files", f"""
    select market_code as market, count(*) as candles, round(sum(volume), 6) as volume, min(start * 1000) as first_ts
    from (select * from ({_candle_sql('day')}) union all select * from ({_candle_sql('month')}) union all select * from ({_candle_sql('week')})
          union all select * from ({_candle_sql('year')})) group by 1""")
def _(v):
    root = work_folder(v.spark)
    documents = files.build_candle_batch(_batch_candles(v))
    documents = files.with_range(documents, "2024-01-01T00:00:00+09:00", "2024-02-01T00:00:00+09:00")
    files.write_documents(documents, root, "batch", "2024-01-31")
    return files.read_candle_batch(v.spark, root, day="2024-01-31").groupBy("market").agg(
        F.count(F.lit(1)).alias("candles"), F.round(F.sum("volume"), 6).alias("volume"), F.min("ts").alias("first_ts")
    )


@query("read_stream_files", f"""
    select market_code as market, strftime(make_timestamp(ts * 1000) + interval 9 hour, '%Y-%m-%d') as trade_date, type, ts, open, high, low, close,
           volume, price, side from ({_tagged_sql()})""")
def _(v):
    root = work_folder(v.spark)
    candles = series.all_candles(v.v_tick)
    stream = series.build_stream(candles["second"], candles["minute"], v.v_tick)
    files.write_stream_rows(stream, root)
    return files.read_stream_rows(v.spark, root)


_STORED_SQL = """select distinct market_code, strftime(make_timestamp(ts * 1000) + interval 9 hour, '%Y-%m-%d') as d,
    case when side = 'BUY' then 'batch' else 'stream' end as kind from v_record"""


@query("dataset_coverage", f"""
    with stored as ({_STORED_SQL}), dates as (select distinct d from stored)
    select *, batch_exists and stream_exists as all_exist from (select dim.market_code, dates.d as trade_date,
           exists (select 1 from stored s where s.market_code = dim.market_code and s.d = dates.d and kind = 'batch') as batch_exists,
           exists (select 1 from stored s where s.market_code = dim.market_code and s.d = dates.d and kind = 'stream') as stream_exists
    from {MARKETS_SQL} cross join dates)""")
def _(v):
    from tidebook.functions.clock import kst_date

    # Half of the paths are document names, the others folders the library writes.
    day = kst_date(F.timestamp_millis("ts"))
    kind = F.when(F.col("side") == "BUY", "batch").otherwise("stream")
    begin, end = (F.date_format(d, "yyyyMMdd'T'HHmmss") for d in (day, F.date_add(day, 1)))
    named = F.concat_ws("/", F.lit("data"), "market_code", F.concat(F.concat_ws("_", begin, end, kind), F.lit(".json")))
    folder = F.format_string("data/kind=%s/folder=%s/trade_date=%s/part-00000.json", kind, F.col("market_code"), day.cast("string"))
    paths = v.v_record.select(F.when(F.col("ts") % 2 == 0, named).otherwise(folder).alias("path"))
    dates = v.v_record.select(kst_date(F.timestamp_millis("ts")).alias("trade_date")).distinct()
    return files.dataset_coverage(dates, files.stored_days(paths))


@query("collect_outcome", """
    select strftime(ts + interval 9 hour, '%Y-%m-%d') as trade_date, count(*) filter (where event_type <> 'error') as ok,
           count(*) filter (where event_type = 'error') as error from v_counter group by 1""")
def _(v):
    results = series.by_kst_day(v.v_counter).withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    return files.collect_outcome(results)


# ---- streams -----------------------------------------------------------------------------

_FILE_ROWS = 1 << 19


def _drained(v, run, *topics):
    """Drain a stream over topics whose rows arrive in micro-batches, by a number from 0 on.

    `topics` are pairs of rows and that number; `run` starts the stream over one streaming frame for each. The rows
    of a number are written by the tasks that read them, however many, and one start takes them up in one micro-batch.
    """
    roots = [f"{work_folder(v.spark)}/in" for _ in topics]
    numbers = {row[0] for rows, number in topics for row in rows.select(number).distinct().collect()}
    for n in sorted(numbers, key=lambda n: (n is None, n)):
        for (rows, number), root in zip(topics, roots):
            rows.filter(number.eqNullSafe(F.lit(n))).write.option("maxRecordsPerFile", _FILE_ROWS).mode("append").parquet(root)
        streams = [v.spark.readStream.schema(rows.schema).parquet(root) for (rows, _), root in zip(topics, roots)]
        run(*streams).awaitTermination()


def _folders(v):
    root = work_folder(v.spark)
    return f"{root}/table", f"{root}/checkpoint"


@query("archive_stream", """
    select event_id, event_type as market_code, value, strftime(max(ts) over (partition by event_id % 3, flush), '%Y-%m-%d') as archived_on, flush
    from (select *, (row_number() over (partition by event_id % 3 order by event_id) - 1) // 500 as flush from v_counter)""")
def _(v):
    table, checkpoint = _folders(v)
    messages = v.v_counter.select(
        F.to_json(F.struct("event_id", "value")).alias("body"), F.col("ts").alias("ingested_at"),
        F.col("event_type").alias("market_code"), F.col("event_id").alias("offset"),
    )
    _drained(v, lambda arriving: jobs.archive_stream(arriving, table, checkpoint, drain=True), (messages, F.pmod("offset", F.lit(3))))
    stored = v.spark.read.schema("body string, market_code string, archived_on string, flush bigint").json(table)
    found = F.from_json("body", "event_id bigint, value double")
    return stored.withColumn("message", found).select("message.event_id", "market_code", "message.value", "archived_on", "flush")


@query("live_counts", f"""
    select event_type, {iso_sql("date_trunc('minute', ts)")} as minute, count(*) as orders from v_counter group by 1, 2
    union all select event_type, null, count(*) from v_counter group by 1""")
def _(v):
    root, checkpoint = _folders(v)
    rows = v.v_counter.select("event_type", "ts", "event_id")

    def run(arriving):
        counts = jobs.live_counts(arriving, "ts", "orders", "event_type")
        return jobs.upsert_stream(counts, root, checkpoint, ["event_type", "minute"], drain=True)

    _drained(v, run, (rows, F.pmod("event_id", F.lit(3))))
    return jobs.current_rows(v.spark, root, ["event_type", "minute"])


@query("ingest_stream", f"""
    select 'ord_' || cast(o_orderkey as string) as order_id, market_code, o_totalprice as price
    from (select *, {MARKET_22} as market_code from $orders) where market_code <> 'KRW-NONE'""")
def _(v):
    root, checkpoint = _folders(v)
    key = F.col("o_orderkey").cast("string")
    body = F.to_json(F.struct(
        F.lit("NEW").alias("type"), F.concat(F.lit("ord_"), key).alias("orderId"), F.expr(MARKET_22).alias("market"),
        F.lit("BUY").alias("side"), F.col("o_totalprice").cast("string").alias("price"), F.lit("1").alias("quantity"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("acceptedAt"),
        F.concat(F.lit("req-"), key).alias("clientRequestId"), F.lit("REPLAY").alias("mode"),
    ))
    messages = stream_table(v.spark, v.folder, "orders").select(body.alias("body"), F.col("o_orderkey").alias("offset"))
    # Every message is delivered twice.
    messages = messages.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    rows = decode.order_rows(decode.decode_orders(messages), "offset")
    jobs.ingest_stream(rows, root, checkpoint, drain=True).awaitTermination()
    return jobs.order_store(v.spark, root).newest("orders").select("order_id", "market_code", F.col("price").cast("double"))


@query("order_ledger_stream", _LEDGER_SHOWN)
def _(v):
    root, checkpoint = _folders(v)
    small_tasks(v.spark)
    # Orders and their cancels arrive apart; copies of an execution's pair arrive together, the first one counts.
    fills = v.v_fill.withColumn("offset", F.unix_micros("executed_at")).drop("price")

    def run(events, executions):
        return stream_ledger.start(stream_ledger.ledger_job(events, executions, root, checkpoint), True, jobs.INGEST_INTERVAL)

    _drained(v, run, (v.v_ledger_event, F.pmod("offset", F.lit(2))), (fills, F.pmod("sell_order_id", F.lit(2))))
    return stream_ledger.current_ledger(stream_ledger.ledger_store(v.spark, root))


@query("accept_stream")
def _(v):
    root, checkpoint = _folders(v)
    requests = v.v_request.select("client_request_id", "ts", "event_id")
    # Each micro-batch has rows of the whole time, so all but the first bring late ones.

    def run(arriving):
        return stream_ledger.start(accept.accept_job(arriving, root, checkpoint, id_column="event_id"), True, jobs.INGEST_INTERVAL)

    _drained(v, run, (requests, F.pmod("event_id", F.lit(5))))
    answered = accept.answered_requests(accept.accept_store(v.spark, root))
    return answered.select(F.col("key").alias("client_request_id"), F.col("id").alias("event_id"))


@query("run_sessions_stream")
def _(v):
    root, checkpoint = _folders(v)

    def run(beats, reports):
        return stream_ledger.start(sessions.session_job(beats, reports, root, checkpoint, ttl=21600), True, jobs.INGEST_INTERVAL)

    _drained(v, run, (v.v_beat, F.pmod(F.unix_seconds("ts"), F.lit(3))), (v.v_outcome, F.pmod(F.unix_seconds("at"), F.lit(3))))
    return sessions.current_sessions(sessions.session_store(v.spark, root), "2024-01-30", ttl=21600)


# The streams give what the batch forms give.
ORACLES |= {"accept_stream": ORACLES["idempotent_orders"], "run_sessions_stream": ORACLES["run_sessions"]}
