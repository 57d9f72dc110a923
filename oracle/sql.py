"""One DuckDB statement per registered query, over the same Parquet tables.

Shared pieces are CTEs by name; `query()` puts the needed ones, in order, in front of a SELECT.
"""

from __future__ import annotations

import re


def _at(extra: str) -> str:
    return f"(o_orderdate + to_seconds((o_orderkey*7919)%86400{extra}))"


def _pit(source: str, key: str, days: int, extra: str = "") -> str:
    """Brute-force window per target row: a range join."""
    return f"""
    select t.order_id, count(h.order_id) as n, coalesce(avg(h.minutes), 0) as a{extra}
    from {source} t left join hist h
      on h.{key} = t.{key}
     and h.delivered_at < date_trunc('second', t.created_at)
     and h.delivered_at >= date_trunc('second', t.created_at) - interval {days} day
    group by t.order_id"""


HAVERSINE = """6371.0*2*atan2(
  sqrt(pow(sin(radians({b}.delivery_latitude-{a}.latitude)/2),2)
    +cos(radians({a}.latitude))*cos(radians({b}.delivery_latitude))
     *pow(sin(radians({b}.delivery_longitude-{a}.longitude)/2),2)),
  sqrt(1-(pow(sin(radians({b}.delivery_latitude-{a}.latitude)/2),2)
    +cos(radians({a}.latitude))*cos(radians({b}.delivery_latitude))
     *pow(sin(radians({b}.delivery_longitude-{a}.longitude)/2),2))))"""

MORE_AGGS = """, coalesce(sum(h.minutes),0) as s, coalesce(min(h.minutes),0) as lo,
    coalesce(max(h.minutes),0) as hi, coalesce(stddev_samp(h.minutes),0) as sd"""

CTES: dict[str, str] = {
    "fx_orders": f"""
    select o_orderkey as order_id, o_custkey as customer_id, f.store_id,
      cast(floor(o_totalprice) as bigint) as total,
      {_at('')} as created_at,
      case when o_orderstatus<>'P' then {_at('+60+o_orderkey%240')} end as confirmed_at,
      case when o_orderstatus='F' then {_at('+600+(o_orderkey*31+o_custkey*17)%4800')} end
        as delivered_at,
      47e0+((o_orderkey*31+o_custkey)%10000)/2e4 as delivery_latitude,
      -122e0-((o_orderkey*17+o_custkey*3)%10000)/2e4 as delivery_longitude
    from orders left join
      (select l_orderkey, min(l_suppkey) as store_id from lineitem group by l_orderkey) f
      on o_orderkey=f.l_orderkey""",
    "fx_stores": """
    select s_suppkey as store_id,
      case when s_suppkey%17<>5 then 47e0+((s_suppkey*7919)%10000)/2e4 end as latitude,
      case when s_suppkey%17<>5 then -122e0-((s_suppkey*104729)%10000)/2e4 end as longitude
    from supplier""",
    "fx_items": "select l_orderkey as order_id, cast(l_quantity as bigint) as quantity from lineitem",
    "qty": "select order_id, cast(sum(quantity) as bigint) as quantity from fx_items group by order_id",
    "hist": """
    select *, date_diff('microsecond', created_at, delivered_at)/6e7 as minutes
    from fx_orders where delivered_at is not null""",
    "confirmed": """
    select o.order_id, o.customer_id, o.store_id, o.created_at, s.latitude, s.longitude,
      o.delivery_latitude, o.delivery_longitude, o.total, coalesce(q.quantity, 1) as quantity
    from fx_orders o left join fx_stores s on o.store_id=s.store_id
      left join qty q on q.order_id=o.order_id
    where o.delivered_at is null and o.created_at is not null and o.confirmed_at is not null
      and s.latitude is not null and s.longitude is not null""",
    # Features of delivered orders.
    "ps": _pit("hist", "store_id", 30),
    "pc": _pit("hist", "customer_id", 30),
    "tf": f"""
    select o.order_id, o.customer_id, o.store_id, o.created_at, o.delivered_at,
      o.minutes as delivery_time_minutes,
      ps.a as restaurant_avg_delivery_minutes_30d, ps.n as restaurant_order_count_30d,
      pc.n as customer_order_count_30d, pc.a as customer_avg_delivery_minutes_30d,
      {HAVERSINE.format(a='s', b='o')} as distance_km,
      cast(hour(o.created_at) as bigint) as hour_of_day,
      cast(isodow(o.created_at)-1 as bigint) as day_of_week,
      isodow(o.created_at) >= 6 as is_weekend,
      o.total, coalesce(q.quantity, 1) as quantity
    from hist o join ps on ps.order_id=o.order_id join pc on pc.order_id=o.order_id
      left join fx_stores s on s.store_id=o.store_id left join qty q on q.order_id=o.order_id""",
    # Features of confirmed orders.
    "cs": _pit("confirmed", "store_id", 30),
    "cc": _pit("confirmed", "customer_id", 30),
    "cf": f"""
    select o.*, cs.a as restaurant_avg_delivery_minutes_30d, cs.n as restaurant_order_count_30d,
      cc.n as customer_order_count_30d,
      {HAVERSINE.format(a='o', b='o')} as distance_km,
      cast(hour(o.created_at) as bigint) as hour_of_day,
      cast(isodow(o.created_at)-1 as bigint) as day_of_week,
      isodow(o.created_at) >= 6 as is_weekend
    from confirmed o join cs on cs.order_id=o.order_id join cc on cc.order_id=o.order_id""",
    # Two rule model versions over delivered orders.
    "preds": """
    select tf.*, v.model_version,
      case when restaurant_order_count_30d>0 then restaurant_avg_delivery_minutes_30d else 45 end
        + 1.5e0*coalesce(distance_km, 0) + v.shift as predicted_delivery_minutes,
      v.stored_at + to_seconds(order_id%86400) as stored_at
    from tf, (values ('rule-1', 0e0, timestamp '2024-01-02 00:00:00'),
                     ('rule-2', 1e0, timestamp '2024-01-03 00:00:00'))
      v(model_version, shift, stored_at)""",
    "errs": """
    select *, delivery_time_minutes as actual_delivery_minutes,
      predicted_delivery_minutes-delivery_time_minutes as error,
      abs(predicted_delivery_minutes-delivery_time_minutes) as absolute_error,
      abs(predicted_delivery_minutes-delivery_time_minutes)/delivery_time_minutes*100
        as percentage_error
    from preds""",
    "reqlog": """
    select event_id as request_id, ts, user_id as order_id,
      case when event_type<>'error' then 10e0+(event_id*37)%80 end as prediction,
      case when event_type='error' then 'failed: '||props end as error,
      value as latency_ms
    from events""",
    # Drift samples in long form, one per query kind.
    "ev_long": """
    select 'value' as feature, ts < timestamp '2024-01-21 00:00:00' as is_ref, value
    from events where value is not null""",
    "tf_long": """
    select feature, is_ref, value from (
      select created_at < timestamp '1998-04-01 00:00:00' as is_ref,
        restaurant_avg_delivery_minutes_30d, restaurant_order_count_30d::double
          as restaurant_order_count_30d, customer_order_count_30d::double
          as customer_order_count_30d, distance_km, hour_of_day::double as hour_of_day,
        day_of_week::double as day_of_week, is_weekend::int::double as is_weekend,
        total::double as total, quantity::double as quantity
      from tf) unpivot (value for feature in (restaurant_avg_delivery_minutes_30d,
        restaurant_order_count_30d, customer_order_count_30d, distance_km, hour_of_day,
        day_of_week, is_weekend, total, quantity))""",
    "pd_long": """
    (select 'predictions' as feature, true as is_ref, predicted_delivery_minutes as value
     from preds where model_version='rule-1')
    union all
    select 'predictions', false, predicted_delivery_minutes from
      (select predicted_delivery_minutes from preds where model_version='rule-2'
       order by stored_at desc, order_id desc limit 500)""",
    "life_events": """
    select order_id, customer_id, total,
      case when confirmed_at is not null then order_id%50 end as driver_id, event_type, event_at
    from (
      select *, unnest(['placed','assigned','picked_up','delivered','cancelled']) as event_type,
        unnest([created_at, confirmed_at,
          case when delivered_at is not null then confirmed_at+interval 120 second end,
          delivered_at,
          case when confirmed_at is null and order_id%7=0
            then created_at+interval 900 second end]) as event_at
      from fx_orders) where event_at is not null""",
}


def _ks(long: str) -> dict[str, str]:
    return {
        "kt": f"""
    select feature, count(*) filter (is_ref) as n_ref, count(*) filter (not is_ref) as n_cur,
      avg(value) filter (is_ref) as m_ref, avg(value) filter (not is_ref) as m_cur,
      min(value) as low, max(value) as high
    from {long} group by feature""",
        "kv": f"""
    select feature, value, count(*) filter (is_ref) as r, count(*) filter (not is_ref) as c
    from {long} group by feature, value""",
        "kd": """
    select feature, max(abs(f_ref-f_cur)) as d from (
      select kv.feature,
        sum(r) over w / n_ref::double as f_ref, sum(c) over w / n_cur::double as f_cur
      from kv join kt on kt.feature=kv.feature
      window w as (partition by kv.feature order by value)) group by feature""",
        "kl": """
    select kt.*, kd.d, kd.d*sqrt(n_ref*n_cur/(n_ref+n_cur)::double) as lam
    from kt join kd on kd.feature=kt.feature""",
        "kp": """
    select feature, n_ref, n_cur, m_ref, m_cur, d,
      case when lam < 0.2 then 1e0 else least(greatest(2*(
        select sum(case when k%2=1 then 1e0 else -1e0 end*exp(-2e0*k*k*lam*lam))
        from range(1,101) t(k)), 0e0), 1e0) end as p
    from kl""",
        "ks": """
    select feature as feature_name, 'ks_test' as test_name, d as statistic, p as p_value,
      p < 0.05 as is_drifted, 0.05e0 as threshold, m_ref as reference_mean, m_cur as current_mean
    from kp""",
    }


def _psi(long: str) -> dict[str, str]:
    return {
        "pb": f"""
    select l.feature, case when high=low then 1 else
        least(10, greatest(1, ceil((value-low)/((high-low)/10))))::int end as bin,
      count(*) filter (is_ref) as r, count(*) filter (not is_ref) as c
    from {long} l join kt on kt.feature=l.feature group by all""",
        "pg": """
    select kt.feature, low, high, m_ref, m_cur, n_ref, n_cur,
      greatest(coalesce(r,0)/n_ref::double, 1e-4) as r,
      greatest(coalesce(c,0)/n_cur::double, 1e-4) as c
    from kt join range(1,11) b(bin) on true
      left join pb on pb.feature=kt.feature and pb.bin=b.bin""",
        "psis": """
    select feature, any_value(n_ref) as n_ref, any_value(n_cur) as n_cur,
      any_value(m_ref) as m_ref, any_value(m_cur) as m_cur,
      case when any_value(high)=any_value(low) then 0e0 else sum((c-r)*(c/r)) end as psi_ratio,
      case when any_value(high)=any_value(low) then 0e0 else sum((c-r)*ln(c/r)) end as psi_log
    from pg group by feature""",
        "psi": """
    select feature as feature_name, 'psi' as test_name, psi_ratio as statistic,
      1-least(psi_ratio/0.2e0, 1e0) as p_value, psi_ratio > 0.2 as is_drifted,
      0.2e0 as threshold, m_ref as reference_mean, m_cur as current_mean
    from psis""",
    }


DRIFT_ROUND = """feature_name, test_name, round(statistic,6) as statistic,
  round(p_value,6) as p_value, is_drifted, threshold, round(reference_mean,6) as reference_mean,
  round(current_mean,6) as current_mean"""


def query(select: str, **extra: str) -> str:
    """`select` with every CTE it needs, directly or through others, in front."""
    known = {**CTES, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\b\w+\b", text))
        for name, body in known.items():
            if name in words and name not in needed:
                needed.append(name)
                visit(body)

    visit(select)
    order = list(known)
    needed.sort(key=order.index)
    ctes = ",\n".join(f"{name} as ({known[name]})" for name in needed)
    return f"with {ctes}\n{select}" if ctes else select


def rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.strip()},{digits}) as {n.strip()}" for n in names.split(","))


TF_COLUMNS = f"""order_id, created_at, {rounded('''delivery_time_minutes,
  restaurant_avg_delivery_minutes_30d''')}, restaurant_order_count_30d, customer_order_count_30d,
  {rounded('customer_avg_delivery_minutes_30d, distance_km')}, hour_of_day, day_of_week,
  is_weekend, total, quantity"""


def _snapshot(key: str, as_of: str = "2000-06-01 00:00:00") -> str:
    return query(f"""
    select {key}, timestamp '{as_of}' as computed_at, 30 as window_days,
      round(avg(minutes),6) as avg_delivery_minutes, count(*) as order_count
    from hist where {key} is not null and delivered_at < timestamp '{as_of}'
      and delivered_at >= timestamp '{as_of}' - interval 30 day
    group by {key}""")


def _as_of(key: str, entities: str, as_of: str = "2000-06-01 00:00:00") -> str:
    return f"""
    select e.{key}, coalesce(avg(h.minutes),0) as a, count(h.order_id) as n
    from {entities} e left join hist h on h.{key}=e.{key}
      and h.delivered_at < timestamp '{as_of}'
      and h.delivered_at >= timestamp '{as_of}' - interval 30 day
    group by e.{key}"""


CUSTOMERS = "(select distinct customer_id from fx_orders)"

ONLINE = f"""
    select 'restaurant' as entity_type, store_id::varchar as entity_id, unnest(
        ['restaurant_avg_delivery_minutes_30d','restaurant_order_count_30d']) as feature_name,
      unnest([a, n::double]) as value from sf
    union all
    select 'customer', customer_id::varchar,
      unnest(['customer_avg_delivery_minutes_30d','customer_order_count_30d']),
      unnest([a, n::double]) from uf"""

ONLINE_CTES = {"sf": _as_of("store_id", "fx_stores"), "uf": _as_of("customer_id", CUSTOMERS), "online": ONLINE}


LIFE = """
    select order_id, customer_id, total, case when confirmed_at is not null then order_id%50 end
        as driver_id, created_at as placed_at, confirmed_at as assigned_at,
      case when delivered_at is not null then confirmed_at+interval 120 second end as picked_up_at,
      delivered_at, case when confirmed_at is null and order_id%7=0
        then created_at+interval 900 second end as cancelled_at
    from fx_orders"""


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    out["scan_orders"] = query("select * from fx_orders")
    out["order_distance"] = query(f"""
    select o.order_id, round({HAVERSINE.format(a='s', b='o')},6) as distance_km
    from fx_orders o left join fx_stores s on s.store_id=o.store_id""")
    out["order_time_features"] = query("""
    select order_id, cast(hour(created_at) as bigint) as hour_of_day,
      cast(isodow(created_at)-1 as bigint) as day_of_week, isodow(created_at)>=6 as is_weekend
    from fx_orders""")
    out["delivery_minutes"] = query(
        "select order_id, round(minutes,6) as delivery_time_minutes from hist")
    out["training_base"] = query("""
    select order_id, customer_id, store_id, created_at,
      round(minutes,6) as delivery_time_minutes from hist
    where created_at >= timestamp '1995-01-01 00:00:00'
      and created_at < (select max(created_at) from fx_orders)""")
    out["confirmed_orders"] = query("select * from confirmed")
    out["confirmed_orders_limit"] = query(
        "select * from confirmed order by created_at desc, order_id limit 50")
    out["null_policies"] = query("""
    select o.order_id, coalesce(q.quantity,1) as quantity_or_one,
      case when coalesce(q.quantity,0)%10=0 then 1 else q.quantity end as request_quantity,
      coalesce(round(o.confirm_minutes,6),0) as zero_if_null,
      coalesce(round(o.confirm_minutes,6),-1) as model_input
    from (select *, date_diff('microsecond', created_at, confirmed_at)/6e7 as confirm_minutes
          from fx_orders) o left join qty q on q.order_id=o.order_id""")
    out["features_json_roundtrip"] = query("""
    select order_id, round(restaurant_avg_delivery_minutes_30d,6) as avg_minutes,
      restaurant_order_count_30d as store_count, round(distance_km,6) as distance_km,
      is_weekend, quantity from tf""")
    out["parse_created_at"] = query("""
    select order_id, case when order_id%11=0 then null else date_trunc('second', created_at) end
        as created_at,
      case when order_id%11=0 then 'bad creation time' end as reason,
      case when order_id%11<>0 then strftime(created_at, '%Y-%m-%dT%H:%M:%S') end as iso_text
    from fx_orders""")
    out["explode_requests"] = query("""
    select order_id//20 as request_id, order_id, customer_id, total,
      case when order_id%4=0 then 1 else order_id%4 end as quantity,
      date_trunc('second', created_at) as created_at from fx_orders
    union all
    select order_id//20, -order_id-1, customer_id, total, 1, date_trunc('second', created_at)
    from fx_orders""")
    requests = """
    select order_id//20 as request_id, unnest([order_id, -order_id-1]) as order_id,
      case when order_id%11=0 then 'no creation time'
           when s.latitude is null then 'no coordinates' end as error
    from fx_orders o left join fx_stores s on s.store_id=o.store_id"""
    out["batch_outcome"] = query("""
    select request_id, count(*) as total_orders, count(*) filter (error is null) as successful,
      count(error) as failed from req group by request_id""", req=requests)
    out["batch_errors"] = query(
        "select request_id, order_id, error from req where error is not null", req=requests)
    out["split_valid_rejected"] = query("""
    select o.order_id, o.store_id is not null and s.latitude is not null and o.total >= 50000
        and o.confirmed_at is not null as is_valid,
      concat_ws(',', case when o.store_id is null then 'no store' end,
        case when s.latitude is null then 'no coordinates' end,
        case when o.total < 50000 then 'small total' end,
        case when o.confirmed_at is null then 'unconfirmed' end) as reasons
    from fx_orders o left join fx_stores s on s.store_id=o.store_id""")
    out["required_columns"] = query("""
    select c as column_name, s as status, n as null_count from (
      select unnest(['order_id','customer_id','store_id','created_at','delivered_at','latitude',
          'longitude','delivery_latitude','delivery_longitude','total','quantity',
          'confirmed_at']) as c,
        unnest(['present','present','present','present','present','missing','missing','present',
          'present','present','missing','extra']) as s,
        unnest([0, 0, count(*)-count(store_id), 0, count(*)-count(delivered_at), null, null, 0, 0,
          0, null, count(*)-count(confirmed_at)]) as n
      from fx_orders)""")
    profile = []
    for table, source, columns in (
        ("order_items", "fx_items", "order_id bigint, quantity bigint"),
        ("orders", "fx_orders", "order_id bigint, customer_id bigint, store_id bigint, "
         "total bigint, created_at timestamp, confirmed_at timestamp, delivered_at timestamp, "
         "delivery_latitude double, delivery_longitude double"),
        ("stores", "fx_stores", "store_id bigint, latitude double, longitude double"),
    ):
        for name, kind in (c.split() for c in columns.split(", ")):
            key = name.endswith("_id")
            distinct = f"count(distinct {name})" if key else "cast(null as bigint)"
            unique = f"count(distinct {name})=count(*)" if key else "false"
            profile.append(f"""
    select '{table}' as table_name, '{name}' as column_name, '{kind}' as data_type,
      count(*) as row_count, count(*)-count({name}) as null_count,
      cast(min({name}) as varchar) as min_value, cast(max({name}) as varchar) as max_value,
      {distinct} as distinct_count, {unique} as is_key from {source}""")
    out["table_profile"] = query(" union all ".join(profile))
    out["table_sample"] = query("select * from fx_orders order by order_id limit 3")
    out["csv_roundtrip"] = query("""
    select 'orders' as table_name, count(*) as row_count,
      cast(sum(total) as bigint) as checksum from fx_orders
    union all select 'stores', count(*), cast(sum(store_id) as bigint) from fx_stores
    union all select 'order_items', count(*), cast(sum(quantity) as bigint) from fx_items""")
    out["order_date_range"] = query("""
    select count(*) as order_count, min(created_at) as min_created_at,
      max(created_at) as max_created_at from fx_orders""")
    out["order_quantity"] = query("""
    select o.order_id, coalesce(q.quantity,1) as quantity
    from fx_orders o left join qty q on q.order_id=o.order_id""")
    out["training_join_item_grain"] = query("""
    select o.order_id, o.store_id, i.quantity, round(s.latitude,6) as latitude
    from hist o left join fx_stores s on s.store_id=o.store_id
      left join fx_items i on i.order_id=o.order_id""")
    out["conform_orders"] = query("""
    select o.order_id, o.customer_id, s.store_id, o.created_at, o.delivered_at, s.latitude,
      s.longitude, o.delivery_latitude, o.delivery_longitude, o.total, i.quantity
    from hist o left join fx_stores s on s.store_id=o.store_id
      left join fx_items i on i.order_id=o.order_id""")
    out["relationship_coverage"] = query("""
    select 'order_items' as child_table, 'order_id' as child_column, 'orders' as parent_table,
      'order_id' as parent_column, count(*) as child_rows, count(i.order_id) as child_rows_with_key,
      count(o.order_id) as matched_rows, count(distinct i.order_id) as distinct_keys,
      count(distinct case when o.order_id is null then i.order_id end) as orphan_keys,
      1::bigint as max_parent_copies
    from fx_items i left join fx_orders o on o.order_id=i.order_id
    union all
    select 'orders', 'store_id', 'stores', 'store_id', count(*), count(o.store_id),
      count(s.store_id), count(distinct o.store_id),
      count(distinct case when s.store_id is null then o.store_id end), 1::bigint
    from fx_orders o left join fx_stores s on o.store_id=s.store_id""")
    for name, key, prefix in (("store", "ps", "restaurant"), ("customer", "pc", "customer")):
        out[f"pit_{name}_features"] = query(f"""
    select order_id, round(a,6) as {prefix}_avg_delivery_minutes_30d,
      n as {prefix}_order_count_30d from {key}""")
    out["rolling_store_7d_30d"] = query("""
    select ps.order_id, round(p7.a,6) as avg_7d, p7.n as count_7d, round(ps.a,6) as avg_30d,
      ps.n as count_30d from ps join p7 on p7.order_id=ps.order_id""",
        p7=_pit("hist", "store_id", 7))
    for name, value, source in (
        ("distinct_customers", "count(distinct h.customer_id)", "customers"),
        ("median", "round(coalesce(quantile_disc(h.minutes, 0.5), 0), 6)", "median"),
    ):
        windows = (f"""
    (select t.order_id, {value} as {source}_{days}d from hist t left join hist h
      on h.store_id=t.store_id and h.delivered_at < date_trunc('second', t.created_at)
     and h.delivered_at >= date_trunc('second', t.created_at) - interval {days} day
    group by t.order_id)""" for days in (7, 30))
        out[f"rolling_store_{name}"] = query("select * from" + " join".join(
            f"{w} w{i}" + (" using (order_id)" if i else "") for i, w in enumerate(windows)))
    out["training_features"] = query(f"select {TF_COLUMNS} from tf")
    out["training_features_week"] = query(f"""
    select {TF_COLUMNS} from tf
    where created_at >= timestamp '1996-03-04 00:00:00' and created_at < timestamp '1996-03-11 00:00:00'""")
    out["training_features_item_grain"] = query(f"""
    select tf.order_id, created_at, {rounded('delivery_time_minutes, restaurant_avg_delivery_minutes_30d')},
      restaurant_order_count_30d, customer_order_count_30d,
      {rounded('customer_avg_delivery_minutes_30d, distance_km')}, hour_of_day, day_of_week,
      is_weekend, total, i.quantity
    from tf left join fx_items i on i.order_id=tf.order_id""")
    out["order_features"] = query(f"""
    select order_id, {rounded('restaurant_avg_delivery_minutes_30d')}, restaurant_order_count_30d,
      customer_order_count_30d, {rounded('distance_km')}, hour_of_day, day_of_week, is_weekend,
      total, quantity from cf""")
    out["order_features_newest"] = query(f"""
    select order_id, {rounded('restaurant_avg_delivery_minutes_30d')}, restaurant_order_count_30d,
      customer_order_count_30d, {rounded('distance_km')}, hour_of_day, day_of_week, is_weekend,
      total, quantity from cf order by created_at desc, order_id limit 200""")
    out["registry_features"] = query("""
    select x7.order_id, round(x7.a,6) as restaurant_avg_delivery_minutes_7d,
      round(x30.a,6) as restaurant_avg_delivery_minutes_30d, x30.n as restaurant_order_count_30d,
      round(x30.s,6) as restaurant_sum_30d, round(x30.lo,6) as restaurant_min_30d,
      round(x30.hi,6) as restaurant_max_30d, round(x30.sd,6) as restaurant_stddev_30d,
      round(x7.hi,6) as restaurant_max_7d,
      pc.n as customer_order_count_30d, round(pc.a,6) as customer_avg_delivery_minutes_30d
    from x7 join x30 on x30.order_id=x7.order_id join pc on pc.order_id=x7.order_id""",
        x7=_pit("hist", "store_id", 7, MORE_AGGS), x30=_pit("hist", "store_id", 30, MORE_AGGS))
    out["store_features_as_of"] = query("""
    select store_id, round(a,6) as avg_delivery_minutes, n as order_count from sf""", **ONLINE_CTES)
    out["customer_features_as_of"] = query("""
    select customer_id, round(a,6) as avg_delivery_minutes, n as order_count from uf""", **ONLINE_CTES)
    out["materialize_store_features"] = _snapshot("store_id")
    out["materialize_customer_features"] = _snapshot("customer_id")
    out["materialized_entity_count"] = query("""
    select count(distinct store_id) as entities from hist where store_id is not null
      and delivered_at < timestamp '2000-06-01 00:00:00'
      and delivered_at >= timestamp '2000-06-01 00:00:00' - interval 30 day""")
    for key, name in (("store_id", "store"), ("customer_id", "customer")):
        out[f"{name}_features_from_tiles"] = query(" union all ".join(f"""
    select {key}, round(avg(minutes),6) as avg_delivery_minutes, count(*) as order_count,
      timestamp '{at}' as computed_at, 30 as window_days
    from hist where {key} is not null and delivered_at < timestamp '{at}'
      and delivered_at >= timestamp '{at}' - interval 30 day
    group by {key}""" for at in ("2000-06-01 00:00:00", "2000-06-02 06:30:00")))
    out["active_entities"] = query("""
    select e.d as as_of_day, w.days as window_days, count(distinct store_id) as stores,
      count(distinct customer_id) as customers
    from (values (date '2000-05-15'), (date '2000-06-01'), (date '2000-06-15')) e(d),
      (values (1), (7), (30)) w(days), hist
    where delivered_at < e.d and delivered_at >= e.d - to_days(w.days)
    group by all""")
    out["online_snapshot"] = query("""
    select entity_type, entity_id, feature_name, round(value,6) as value,
      timestamp '2000-06-01 00:00:00' as updated_at, timestamp '2000-06-02 00:00:00' as expires_at
    from online""", **ONLINE_CTES)
    out["online_lookup"] = query("""
    select c.order_id, case when c.store_id%5<>0 then round(sf.a,6) end
        as restaurant_avg_delivery_minutes_30d,
      case when c.store_id%5<>0 then sf.n::double end as restaurant_order_count_30d
    from confirmed c left join sf on sf.store_id=c.store_id""", **ONLINE_CTES)
    out["features_with_fallback"] = query("""
    select c.order_id,
      round(case when c.store_id%5<>0 then sf.a else c.restaurant_avg_delivery_minutes_30d end,6)
        as restaurant_avg_delivery_minutes_30d,
      case when c.store_id%5<>0 then sf.n else c.restaurant_order_count_30d end::double
        as restaurant_order_count_30d,
      case when c.customer_id%3<>0 then uf.n else c.customer_order_count_30d end::double
        as customer_order_count_30d,
      round(c.distance_km,6) as distance_km, c.hour_of_day, c.is_weekend
    from cf c left join sf on sf.store_id=c.store_id
      left join uf on uf.customer_id=c.customer_id""", **ONLINE_CTES)
    out["feature_freshness"] = query("""
    select name as feature_name, 1 as version,
      sha256('{"entity":"' || entity || '","aggregation":"'
        || case when name like '%avg%' then 'mean' when name like '%count%' then 'count' else 'none' end || '"'
        || case when name like '%30d' then ',"window_days":30' when name like '%7d' then ',"window_days":7' else '' end
        || ',"dtype":"' || case when name like '%count%' or name in ('hour_of_day','day_of_week') then 'int'
             when name = 'is_weekend' then 'bool' else 'float' end || '"}') as definition_hash, freshness,
      case when entity='restaurant' then timestamp '2000-06-01 00:00:00'
           when entity='customer' then timestamp '2000-05-30 00:00:00' end as last_computed_at,
      case when entity='restaurant' then (select count(distinct store_id) from hist
             where store_id is not null and delivered_at < timestamp '2000-06-01 00:00:00'
             and delivered_at >= timestamp '2000-06-01 00:00:00' - interval 30 day)
           when entity='customer' then (select count(distinct customer_id) from hist
             where delivered_at < timestamp '2000-05-30 00:00:00'
             and delivered_at >= timestamp '2000-05-30 00:00:00' - interval 30 day)
           end as row_count,
      case when entity='restaurant' then 43200 when entity='customer' then 216000 end::bigint
        as age_seconds,
      case entity when 'restaurant' then 'fresh' when 'customer' then 'stale' else 'fresh' end
        as status
    from (values ('restaurant_avg_delivery_minutes_30d','restaurant','daily'),
      ('restaurant_order_count_30d','restaurant','daily'),
      ('restaurant_avg_delivery_minutes_7d','restaurant','daily'),
      ('customer_order_count_30d','customer','daily'),
      ('customer_avg_delivery_minutes_30d','customer','daily'),
      ('distance_km','order','static'), ('hour_of_day','order','static'),
      ('day_of_week','order','static'), ('is_weekend','order','static')) f(name, entity, freshness)""")
    # Scoring and predictions.
    out["rule_scores"] = query("""
    select order_id, model_version, round(predicted_delivery_minutes,6)
      as predicted_delivery_minutes from preds""")
    out["batch_score"] = query("""
    select order_id, customer_id, store_id, created_at as prediction_timestamp,
      round(case when restaurant_order_count_30d>0 then restaurant_avg_delivery_minutes_30d
        else 45 end+1.5e0*distance_km,6) as predicted_delivery_minutes,
      'rule-1' as model_version from cf""")
    updated = """
    select order_id, model_version, predicted_delivery_minutes
        + case when model_version='rule-1' and order_id%3=0 then 2 else 0 end as minutes,
      case when model_version='rule-1' and order_id%3=0 then stored_at + interval 5 day
        else stored_at end as stored_at, created_at
    from preds"""
    out["upsert_predictions"] = query("""
    select order_id, model_version, round(minutes,6) as predicted_delivery_minutes, stored_at,
      created_at as prediction_timestamp from upd""", upd=updated)
    out["latest_prediction_per_order"] = query("""
    select order_id, model_version, round(predicted_delivery_minutes,6)
      as predicted_delivery_minutes from preds where model_version='rule-2'""")
    out["prediction_stats"] = query("""
    select count(*) as total_predictions, count(distinct order_id) as unique_orders,
      round(avg(predicted_delivery_minutes),6) as avg_prediction_minutes,
      round(min(predicted_delivery_minutes),6) as min_prediction_minutes,
      round(max(predicted_delivery_minutes),6) as max_prediction_minutes,
      min(created_at) as earliest_prediction, max(created_at) as latest_prediction from preds""")
    out["recent_predictions"] = query("""
    select order_id, customer_id, store_id, round(predicted_delivery_minutes,6)
      as predicted_delivery_minutes, created_at as prediction_timestamp, model_version,
      stored_at as created_at
    from preds order by stored_at desc, order_id, model_version limit 100""")
    out["predictions_vs_actuals"] = query("""
    select order_id, model_version, round(predicted_delivery_minutes,6)
      as predicted_delivery_minutes, round(delivery_time_minutes,6) as actual_delivery_minutes
    from preds""")
    out["prediction_errors"] = query(f"""
    select order_id, model_version, {rounded('error, absolute_error, percentage_error')} from errs""")
    out["accuracy_overall"] = query("""
    select count(*) as n, round(avg(absolute_error),6) as mae,
      round(sqrt(avg(error*error)),6) as rmse, round(avg(percentage_error),6)
      as mean_percentage_error, count(*) filter (actual_delivery_minutes=0) as zero_actuals,
      round(median(absolute_error),6) as median_absolute_error from errs""")
    out["accuracy_bands"] = query("""
    select m::bigint as minutes, count(*) filter (absolute_error<=m) as "within",
      round(100e0*count(*) filter (absolute_error<=m)/count(*),6) as "percent"
    from errs, (values (5),(10),(15)) b(m) group by m""")
    by_store = """
    select store_id, count(*) as num_orders, round(avg(absolute_error),6) as avg_error,
      round(avg(predicted_delivery_minutes),6) as avg_predicted,
      round(avg(actual_delivery_minutes),6) as avg_actual from errs group by store_id"""
    out["accuracy_by_store"] = query(by_store)
    out["best_stores"] = query(
        "select * from bs order by avg_error, store_id nulls first limit 10", bs=by_store)
    out["worst_stores"] = query(
        "select * from bs order by avg_error desc, store_id nulls first limit 5", bs=by_store)
    for name, direction in (("best", ""), ("worst", " desc")):
        out[f"{name}_predictions"] = query(f"""
    select order_id, model_version,
      {rounded('predicted_delivery_minutes, actual_delivery_minutes, absolute_error')}
    from errs order by errs.absolute_error{direction}, order_id, model_version limit 5""")
    out["error_describe"] = query(" union all ".join(f"""
    select '{c}' as column_name, count({c}) as count, count(*)-count({c}) as null_count,
      round(avg({c}),6) as mean, round(stddev_samp({c}),6) as std, round(min({c}),6) as min,
      round(quantile_cont({c},0.25),6) as q25, round(median({c}),6) as median,
      round(quantile_cont({c},0.75),6) as q75, round(max({c}),6) as max from errs"""
        for c in ("error", "absolute_error")))
    out["accuracy_by_week"] = query("""
    select time_bucket(interval 7 day, delivered_at, timestamp '1970-01-01 00:00:00')
        as week_start, count(*) as n, round(avg(absolute_error),6) as mae,
      round(avg(error),6) as bias from errs group by 1""")
    out["regression_metrics"] = query("""
    select model_version, count(*) as n, round(avg(absolute_error),6) as mae,
      round(sqrt(avg(error*error)),6) as rmse, round(1-sum(error*error)/(var_pop(actual_delivery_minutes)*count(*)),6) as r2
    from errs where ('0x'||substr(md5(order_id::varchar),1,8))::bigint%100 < 20
    group by model_version""")
    out["train_test_split"] = query("""
    select order_id, ('0x'||substr(md5(order_id::varchar),1,8))::bigint%100 < 20 as is_test
    from hist""")
    out["monitor_error_stats"] = query("""
    select round(avg(absolute_error),6) as mae, round(avg(error),6) as mean_error,
      count(*) as n_samples from errs having count(*) >= 10""")
    # Logs.
    out["request_stats"] = query("""
    select count(*) as total_requests, count(prediction) as successful_requests,
      count(error) as error_requests,
      round(avg(latency_ms) filter (prediction is not null),6) as avg_latency_ms,
      round(avg(prediction),6) as avg_prediction_minutes,
      (select latency_ms from ok where i = (select floor(count(*)*0.5) from ok)) as p50_latency_ms,
      (select latency_ms from ok where i = (select floor(count(*)*0.95) from ok)) as p95_latency_ms
    from reqlog""", ok="""
    select latency_ms, row_number() over (order by latency_ms)-1 as i from reqlog
    where prediction is not null""")
    out["recent_log_window"] = query("""
    select request_id, ts, latency_ms from reqlog order by ts desc, request_id desc limit 1000""")
    # Drift.
    out["ks_drift"] = query(f"select {DRIFT_ROUND} from ks", **_ks("ev_long"))
    out["psi_drift"] = query("""
    select feature, n_ref, n_cur, round(m_ref,6) as reference_mean, round(m_cur,6)
      as current_mean, round(psi_ratio,6) as psi_ratio, round(psi_log,6) as psi_log
    from psis""", **_ks("ev_long"), **_psi("ev_long"))
    both = {**_ks("tf_long"), **_psi("tf_long")}
    out["drift_all_features"] = query(
        f"select {DRIFT_ROUND} from (select * from ks union all select * from psi)", **both)
    out["drift_from_profile"] = out["drift_all_features"]
    out["drift_report"] = query("""
    select count(*) as total_tests, count(*) filter (is_drifted) as drifted_count,
      count(*) filter (is_drifted) > 0 as drift_detected,
      coalesce(string_agg(feature_name||':'||test_name, ',' order by feature_name||':'||test_name)
        filter (is_drifted), '') as drifted_features
    from (select * from ks union all select * from psi)""", **both)
    out["prediction_drift"] = query(f"select {DRIFT_ROUND} from ks", **_ks("pd_long"))
    numeric = [c for c in (
        "restaurant_avg_delivery_minutes_30d", "restaurant_order_count_30d",
        "customer_order_count_30d", "distance_km", "hour_of_day", "day_of_week", "total",
        "quantity")]
    out["drift_reference_profile"] = query(" union all ".join(f"""
    select '{c}' as feature, round(avg({c}),6) as mean, round(stddev_samp({c}),6) as std,
      round(min({c})::double,6) as min, round(max({c})::double,6) as max,
      round(median({c}),6) as median from tf""" for c in numeric))
    # Validation.
    out["validate_orders"] = query("""
    select 'order_id:unique' as rule, (select count(*) from (select order_id from vo
        group by order_id having count(*)>1)) as violations
""" + "".join(f"""
    union all select '{c}:not_null', count(*) filter ({c} is null) from vo""" for c in (
        "order_id", "customer_id", "store_id", "created_at", "delivery_latitude",
        "delivery_longitude", "latitude", "longitude", "total", "quantity")) + """
    union all select 'total:min:0', count(*) filter (total < 0) from vo
    union all select 'quantity:min:1', count(*) filter (quantity < 1) from vo""", vo="""
    select o.*, s.latitude, s.longitude, coalesce(q.quantity,1) as quantity
    from fx_orders o left join qty q on q.order_id=o.order_id
      left join fx_stores s on s.store_id=o.store_id""")
    rules = [("delivery_time_minutes", "min", 0), ("restaurant_avg_delivery_minutes_30d", "min", 0),
             ("restaurant_order_count_30d", "min", 0), ("customer_order_count_30d", "min", 0),
             ("distance_km", "min", 0), ("hour_of_day", "min", 0), ("hour_of_day", "max", 23),
             ("day_of_week", "min", 0), ("day_of_week", "max", 6), ("total", "min", 0),
             ("quantity", "min", 1)]
    out["validate_training_features"] = query("""
    select 'order_id:unique' as rule, (select count(*) from (select order_id from items
      group by order_id having count(*)>1)) as violations""" + "".join(f"""
    union all select '{c}:{k}:{b}', count(*) filter ({c} {'<' if k == 'min' else '>'} {b})
      from items""" for c, k, b in rules) + "".join(f"""
    union all select '{c}:not_null', count(*) filter ({c} is null) from items""" for c in (
        "order_id", "restaurant_order_count_30d", "customer_order_count_30d", "distance_km",
        "hour_of_day", "day_of_week", "is_weekend", "total", "quantity")), items="""
    select tf.* exclude (quantity), i.quantity from tf
      left join fx_items i on i.order_id=tf.order_id""")
    # Streams: the batch result of each job.
    out["stream_score"] = query("""
    select c.order_id, c.store_id, round(case when sf.n>0 then sf.a else 45 end
      +1.5e0*c.distance_km,6) as predicted_delivery_minutes, c.created_at as prediction_timestamp
    from (select o.*, """ + HAVERSINE.format(a="s", b="o") + """ as distance_km, s.latitude
          from fx_orders o join fx_stores s on s.store_id=o.store_id
          where s.latitude is not null) c
      left join sf on sf.store_id=c.store_id""", **ONLINE_CTES)
    out["order_lifecycle"] = query(LIFE)
    out["stream_store_metrics"] = query("""
    select store_id, window_start, cast(sum(n) as bigint) as n, round(sum(m)/sum(n),6) as avg_minutes
    from (select store_id, day - to_days(b::int) as window_start, n, m
          from (select store_id, date_trunc('day', delivered_at)::timestamp as day, count(*) as n,
                  sum(minutes) as m from hist group by 1,2) d, range(0,30) r(b))
    group by all""")
    growth = "(1.01e0/0.99e0)"
    ranked = """
    select date_trunc('hour', ts) as w, latency_ms as v,
      row_number() over (partition by date_trunc('hour', ts) order by latency_ms) - 1 as i,
      count(*) over (partition by date_trunc('hour', ts)) as n
    from reqlog where prediction is not null"""
    shares = ", ".join(
        f"max(case when i = floor(n*{q}e0) then round(pow({growth}, ceil(ln(v)/ln{growth}))*2/({growth}+1), 6) end) as p{p}_latency_ms"
        for p, q in ((50, 0.5), (95, 0.95)))
    out["stream_request_stats"] = query(f"""
    select r.*, p50_latency_ms, p95_latency_ms from (
      select date_trunc('hour', ts) as window_start, count(*) as total_requests,
        count(prediction) as successful_requests, count(error) as error_requests,
        round(avg(latency_ms) filter (prediction is not null),6) as avg_latency_ms
      from reqlog group by 1) r
    left join (select w, {shares} from latency_ranks group by w) on w = window_start""", latency_ranks=ranked)
    out["stream_actuals_match"] = query("""
    select order_id, model_version, round(predicted_delivery_minutes,6)
      as predicted_delivery_minutes, created_at as prediction_timestamp, delivered_at,
      round(delivery_time_minutes,6) as delivery_time_minutes
    from preds where delivered_at >= created_at and delivered_at <= created_at + interval 1 hour""")
    out["stream_dedup"] = query("""
    select order_id, model_version, round(predicted_delivery_minutes,6)
      as predicted_delivery_minutes from preds""")
    out["stream_monitor"] = out["stream_monitor_state"] = query("""
    select model_version, count(*) as n, round(avg(predicted_delivery_minutes),6)
      as avg_prediction, count(*) as n_actuals, round(avg(absolute_error),6) as mae,
      round(avg(error),6) as mean_error
    from (select *, row_number() over (partition by model_version
            order by created_at desc, order_id desc) as i from errs)
    where i <= 1000 group by model_version""")
    # Closures: a timer goes off once the final watermark, an hour behind the last event, is beyond it.
    out["order_closures"] = query("""
    select * exclude (due) from (
      select order_id, customer_id, total, driver_id, placed_at, assigned_at, picked_up_at, delivered_at,
        cancelled_at,
        case when delivered_at is not null then 'delivered' when cancelled_at is not null
          then 'cancelled' else 'abandoned' end as outcome,
        coalesce(delivered_at, cancelled_at, greatest(placed_at, assigned_at) + interval 48 hour) as closed_at,
        case when coalesce(delivered_at, cancelled_at) is null then closed_at
          else closed_at + interval 1 hour end as due
      from life) where due < (select max(greatest(placed_at, assigned_at, picked_up_at, delivered_at,
        cancelled_at)) - interval 1 hour from life)""", life=LIFE)
    arrived = """
    select *, case when order_id%50=0 then 4 else (delivered_at >= timestamp '1996-05-01')::int
      + (delivered_at >= timestamp '1997-09-01')::int + (delivered_at >= timestamp '1999-01-01')::int
      + (delivered_at >= timestamp '2000-04-01')::int end as batch_id from hist"""
    ledger = """
    select b.batch_id, (select max(delivered_at) from arrived p where p.batch_id < b.batch_id - 1) - interval 1 hour
      as watermark from (select distinct batch_id from arrived) b"""
    lates = {"arrived": arrived, "marks": ledger}
    out["stream_late_rows"] = query("""
    select order_id, store_id, delivered_at, watermark from arrived join marks using (batch_id)
    where delivered_at <= watermark""", **lates)
    out["stream_late_ledger"] = query("""
    select batch_id::bigint as batch_id, count(*) as rows, count(*) filter (delivered_at <= watermark) as late_rows,
      max(delivered_at) as greatest, any_value(watermark) as watermark
    from arrived join marks using (batch_id) group by batch_id""", **lates)
    out["stream_days_with_late"] = query("""
    select store_id, date_trunc('day', delivered_at)::timestamp as day, count(*) as n,
      round(sum(minutes), 6) as minutes from hist group by 1, 2""")
    return out
