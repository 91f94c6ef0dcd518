"""DuckDB oracles, written from the operator semantics, not from
the DataFrame code. Each is the shared view prefix + its own CTEs + SELECT.

Output conventions (same as ``slipway.plans.queries.report``): doubles
round(x, 6); timestamps strftime '%Y-%m-%d %H:%M:%S'; dates '%Y-%m-%d'.
"""

from __future__ import annotations

from oracles.prefix import q

ORACLES: dict[str, str] = {}


def ts(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {alias or c.split('.')[-1]}"


def ds(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') as {alias or c.split('.')[-1]}"


def r(c: str, alias: str | None = None) -> str:
    return f"round(cast({c} as double), 6) as {alias or c.split('.')[-1]}"


def reg(name: str, *parts: str) -> None:
    ORACLES[name] = q(*parts)


# ---------------------------------------------------------------- shared CTEs
OSA = """osa as (
  select oi.order_id, oi.seller_id, o.purchase, o.estimated, o.is_late,
         min(oi.shipping_limit) as shipping_limit, count(*) as n_items,
         sum(oi.price) as total_price, sum(oi.freight_value) as total_freight,
         avg(p.weight_g) as avg_weight_g,
         cast(max(p.length_cm * p.height_cm * p.width_cm) as double) as max_volume_cm3,
         min(p.category) as category, min(c.customer_state) as customer_state,
         min(c.customer_zip) as customer_zip, min(s.seller_state) as seller_state,
         min(s.seller_zip) as seller_zip
  from v_order_items oi
  join v_orders o on o.order_id = oi.order_id
  join v_products p on p.product_id = oi.product_id
  join v_customers c on c.customer_id = o.customer_id
  join v_sellers s on s.seller_id = oi.seller_id
  where o.is_late is not null
  group by oi.order_id, oi.seller_id, o.purchase, o.estimated, o.is_late)"""

FEAT = """feat as (
  select *,
    (epoch_us(estimated) - epoch_us(purchase)) / 86400e6 as promised_days,
    (epoch_us(shipping_limit) - epoch_us(purchase)) / 86400e6 as shipping_limit_days,
    cast(hour(purchase) as integer) as purchase_hour,
    cast(isodow(purchase) - 1 as integer) as purchase_dow,
    cast(month(purchase) as integer) as purchase_month,
    case when isodow(purchase) >= 6 then 1 else 0 end as purchase_is_weekend,
    total_freight / nullif(total_price, 0) as freight_ratio,
    total_price / nullif(n_items, 0) as price_per_item,
    avg_weight_g / nullif(max_volume_cm3, 0) as density,
    case when avg_weight_g is null then null else ln(1 + greatest(avg_weight_g, 0)) end as log_weight,
    case when max_volume_cm3 is null then null else ln(1 + greatest(max_volume_cm3, 0)) end as log_volume,
    case when seller_state = customer_state then 1 else 0 end as same_state,
    abs(cast(customer_zip as double) - cast(seller_zip as double)) as zip_gap,
    floor(cast(seller_zip as double) / 1000) as seller_zip_region,
    floor(cast(customer_zip as double) / 1000) as customer_zip_region,
    cast(purchase as date) as pday
  from osa)"""

HIST = """hs_daily as (select seller_id as k, pday as d, count(*) as n, sum(is_late) as late from feat group by all),
hs as (select k, d, cast(sum(n) over (partition by k order by d) as bigint) as cum_n,
       cast(sum(late) over (partition by k order by d) as bigint) as cum_late from hs_daily),
ht_daily as (select customer_state as k, pday as d, count(*) as n, sum(is_late) as late from feat group by all),
ht as (select k, d, cast(sum(n) over (partition by k order by d) as bigint) as cum_n,
       cast(sum(late) over (partition by k order by d) as bigint) as cum_late from ht_daily),
feat2 as (select f.*, f.pday - 30 as asof_d from feat f),
hist as (
  select f.order_id, f.seller_id,
         a.cum_n as seller_prior_orders, a.cum_late / nullif(a.cum_n, 0) as seller_prior_late_rate
  from feat2 f asof left join hs a on f.seller_id = a.k and f.asof_d >= a.d),
hist2 as (
  select f.order_id, f.seller_id,
         b.cum_n as state_prior_orders, b.cum_late / nullif(b.cum_n, 0) as state_prior_late_rate
  from feat2 f asof left join ht b on f.customer_state = b.k and f.asof_d >= b.d)"""

TOPCAT = """catn as (select category, count(*) as n from feat where category is not null group by 1),
topcat as (select category from catn order by n desc, category asc limit 20)"""

FT = """ft as (
  select f.order_id, f.seller_id, f.n_items, f.total_price, f.total_freight,
         case when f.category in (select category from topcat) then f.category else 'other' end as category,
         f.customer_state, f.seller_state, f.promised_days, f.shipping_limit_days,
         f.shipping_limit_days / nullif(f.promised_days, 0) as handover_share,
         f.purchase_hour, f.purchase_dow, f.purchase_month, f.purchase_is_weekend,
         f.freight_ratio, f.price_per_item, f.density, f.log_weight, f.log_volume,
         f.same_state, f.zip_gap, f.seller_zip_region, f.customer_zip_region,
         h.seller_prior_orders, h.seller_prior_late_rate, h2.state_prior_orders, h2.state_prior_late_rate,
         cast(f.is_late as integer) as is_late_delivery, f.purchase as as_of_date
  from feat f
  join hist h on h.order_id = f.order_id and h.seller_id = f.seller_id
  join hist2 h2 on h2.order_id = f.order_id and h2.seller_id = f.seller_id
  where f.promised_days is not null and f.promised_days > 0)"""

ROLLUP = """mx as (select max(as_of_date) as m from ft),
recent as (select ft.* from ft, mx where ft.as_of_date >= mx.m - interval 90 day),
sc as (select seller_id, 1e0 / (1e0 + promised_days) as raw from recent),
sr0 as (select seller_id, avg(raw) as raw, avg(raw) as risk_score, count(*) as n_orders from sc group by 1 having count(*) >= 5),
cuts as (select quantile_cont(raw, 0.5) as c50, quantile_cont(raw, 0.8) as c80, quantile_cont(raw, 0.95) as c95 from sr0),
roll as (select sr0.*, case when raw >= c95 then 'critical' when raw >= c80 then 'high' when raw >= c50 then 'medium' else 'low' end as risk_band from sr0, cuts)"""

FT_ALL = (OSA, FEAT, HIST, TOPCAT, FT)
ROLL_ALL = FT_ALL + (ROLLUP,)

FT_COLS = ["order_id", "seller_id", "n_items", r("total_price"), r("total_freight"), "category", "customer_state",
           "seller_state", r("promised_days"), r("shipping_limit_days"), r("handover_share"), "purchase_hour",
           "purchase_dow", "purchase_month", "purchase_is_weekend", r("freight_ratio"), r("price_per_item"),
           r("density"), r("log_weight"), r("log_volume"), "same_state", r("zip_gap"), r("seller_zip_region"),
           r("customer_zip_region"), "seller_prior_orders", r("seller_prior_late_rate"), "state_prior_orders",
           r("state_prior_late_rate"), "is_late_delivery", ts("as_of_date")]


def sel(cols, frm: str) -> str:
    return "select " + ", ".join(cols) + " " + frm


# ---------------------------------------------------------------- sources
reg("s01_dimension_scan", "select customer_id, customer_state, customer_zip from v_customers")
reg("s02_orders_scan", sel(["order_id", "customer_id", "order_status", ts("purchase"), ts("estimated"),
                            ts("delivered"), r("delay_days"), "is_late"], "from v_orders"))
reg("s03_items_scan", sel(["order_id", "order_item_id", "product_id", "seller_id", ts("shipping_limit"),
                           r("price"), r("freight_value")], "from v_order_items"))
reg("s04_reviews_dedupe",
    "rd as (select *, row_number() over (partition by review_id, order_id order by created, review_score, comment) as rn from v_reviews)",
    sel(["review_id", "order_id", "review_score", ts("created"), "comment"], "from rd where rn = 1"))
reg("s15_serving_sellers", *ROLL_ALL,
    "select seller_id, seller_state, seller_zip from v_sellers where seller_id in (select seller_id from roll)")

# ---------------------------------------------------------------- labels / features
reg("p01_label", sel(["order_id", r("delay_days"), "is_late"], "from v_orders"))
reg("j01_star_join_aggregate", OSA,
    sel(["order_id", "seller_id", ts("purchase"), ts("estimated"), "is_late", ts("shipping_limit"), "n_items",
         r("total_price"), r("total_freight"), r("avg_weight_g"), r("max_volume_cm3"), "category",
         "customer_state", "customer_zip", "seller_state", "seller_zip"], "from osa"))
reg("p04_promise_features", OSA, FEAT,
    sel(["order_id", "seller_id", r("promised_days"), r("shipping_limit_days"),
         r("shipping_limit_days / nullif(promised_days, 0)", "handover_share")], "from feat"))
reg("p05_calendar_features", OSA, FEAT,
    "select order_id, seller_id, purchase_hour, purchase_dow, purchase_month, purchase_is_weekend from feat")
reg("p06_shipment_features", OSA, FEAT,
    sel(["order_id", "seller_id", r("freight_ratio"), r("price_per_item"), r("density"), r("log_weight"),
         r("log_volume")], "from feat"))
reg("p07_route_features", OSA, FEAT,
    sel(["order_id", "seller_id", "same_state", r("zip_gap"), r("seller_zip_region"), r("customer_zip_region")],
        "from feat"))
reg("j07_lagged_history", OSA, FEAT, HIST,
    sel(["h.order_id", "h.seller_id", "seller_prior_orders", r("seller_prior_late_rate"), "state_prior_orders",
         r("state_prior_late_rate")],
        "from hist h join hist2 h2 on h.order_id = h2.order_id and h.seller_id = h2.seller_id"))
reg("a06_daily_running_counts", OSA,
    """dd as (select seller_id, cast(date_diff('day', date '1970-01-01', cast(purchase as date)) as integer) as day_no,
              count(*) as n, cast(sum(is_late) as bigint) as late from osa group by all)""",
    """select seller_id, day_no, n, late,
              cast(sum(n) over (partition by seller_id order by day_no) as bigint) as cum_n,
              cast(sum(late) over (partition by seller_id order by day_no) as bigint) as cum_late from dd""")
reg("a09_collapse_categories", OSA, FEAT, TOPCAT,
    "select order_id, seller_id, case when category in (select category from topcat) then category else 'other' end as category from feat")
reg("s14_order_feature_table", *FT_ALL, sel(FT_COLS, "from ft"))
reg("p11_trailing_window", *FT_ALL,
    "mx as (select max(as_of_date) as m from ft)",
    sel(["order_id", "seller_id", ts("as_of_date")], "from ft, mx where ft.as_of_date >= mx.m - interval 90 day"))
reg("p12_min_activity", *FT_ALL,
    "select seller_id, count(*) as n_rows from ft group by 1 having count(*) >= 50")
reg("j08_asof_events",
    "clicks as (select event_id, user_id, ts from events where event_type = 'click')",
    "views as (select user_id, ts as view_ts, value as view_value from events where event_type = 'view')",
    sel(["c.event_id", "c.user_id", ts("v.view_ts"), r("v.view_value")],
        "from clicks c asof left join views v on c.user_id = v.user_id and c.ts >= v.view_ts"))
reg("j09_semi_join_active",
    "act as (select seller_id from v_order_items group by 1 having count(*) >= 600)",
    "select seller_id, seller_state, seller_zip from v_sellers where seller_id in (select seller_id from act)")
reg("j04_left_join_sellers", *ROLL_ALL,
    sel(["r.seller_id", "s.seller_state", "s.seller_zip", r("r.risk_score"), "r.risk_band"],
        "from roll r left join v_sellers s on s.seller_id = r.seller_id"))
reg("j11_realign_scores", *FT_ALL,
    """select count(*) as n_rows, count(*) filter (where s.score is null) as n_missing
       from ft left join v_scores s on s.order_id = ft.order_id and s.seller_id = ft.seller_id""")

# ---------------------------------------------------------------- aggregates
SDO = """sdo as (select oi.seller_id, cast(o.purchase as date) as order_date, count(*) as orders_n,
                 cast(sum(o.is_late) as bigint) as late_n, avg(o.delay_days) as avg_delay_days
          from v_orders o join v_order_items oi on oi.order_id = o.order_id
          where o.is_late is not null group by 1, 2)"""
SDR = """sdr as (select oi.seller_id, cast(r.created as date) as review_date, avg(r.review_score) as avg_review_score,
                 count(*) filter (where r.review_score <= 2) as bad_reviews_n, count(*) as reviews_n
          from v_reviews r join v_order_items oi on oi.order_id = r.order_id
          where r.created is not null group by 1, 2)"""
SIGW = """sigw as (select seller_state, signal_date,
                  avg(value) filter (where source = 'weather') as weather_severity,
                  avg(value) filter (where source = 'port') as port_congestion,
                  avg(value) filter (where source = 'commodity') as commodity_volatility
           from v_signals group by 1, 2)"""

reg("a02_seller_day_orders", SDO, sel(["seller_id", ds("order_date"), "orders_n", "late_n", r("avg_delay_days")], "from sdo"))
reg("a03_seller_day_reviews", SDR,
    sel(["seller_id", ds("review_date"), r("avg_review_score"), "bad_reviews_n", "reviews_n"], "from sdr"))
reg("a04_signals_pivot", SIGW,
    sel(["seller_state", ds("signal_date"), r("weather_severity"), r("port_congestion"), r("commodity_volatility")],
        "from sigw"))
reg("a04_events_pivot",
    """ep as (select cast(ts as date) as d,
              avg(value) filter (where event_type = 'click') as click,
              avg(value) filter (where event_type = 'view') as "view",
              avg(value) filter (where event_type = 'purchase') as purchase,
              avg(value) filter (where event_type = 'error') as error,
              avg(value) filter (where event_type = 'signup') as signup from events group by 1)""",
    sel([ds("d"), r("click"), r('"view"', "view"), r("purchase"), r("error"), r("signup")], "from ep"))
reg("a05_seller_span", SDO,
    sel(["seller_id", ds("min(order_date)", "first_day"), ds("max(order_date)", "last_day"),
         "cast(sum(orders_n) as bigint) as lifetime_orders"], "from sdo group by seller_id"))
reg("a07_seller_rollup", *ROLL_ALL, sel(["seller_id", r("raw"), r("risk_score"), "n_orders"], "from roll"))
reg("x01_score_and_publish", *ROLL_ALL, sel(["seller_id", r("raw"), r("risk_score"), "n_orders", "risk_band"], "from roll"))
reg("e13_quantile_bands",
    "c as (select quantile_cont(score, 0.5) as c50, quantile_cont(score, 0.8) as c80, quantile_cont(score, 0.95) as c95 from v_scores)",
    """select order_id, seller_id, case when score >= c95 then 'critical' when score >= c80 then 'high'
              when score >= c50 then 'medium' else 'low' end as risk_band from v_scores, c""")
K01 = sel(["r.seller_id", r("r.raw"), r("r.risk_score"), "r.n_orders", "r.risk_band", "s.seller_state"],
          "from roll r left join v_sellers s on s.seller_id = r.seller_id {w} order by r.risk_score desc, r.seller_id limit 500")
reg("k01_ranked_sellers", *ROLL_ALL, K01.format(w=""))
reg("k01_ranked_sellers_band", *ROLL_ALL, K01.format(w="where r.risk_band = 'high'"))
reg("k06_predictions_order", *ROLL_ALL,
    "select seller_id, row_number() over (order by raw desc, seller_id) as position, risk_band from roll")
reg("a10_band_counts", *ROLL_ALL,
    sel(["risk_band", "n", "total", r("avg_risk")],
        "from (select risk_band, count(*) as n from roll group by 1) b, (select count(*) as total, avg(risk_score) as avg_risk from roll) t"))
STATE = """st as (select s.seller_state as state, count(*) as count, avg(r.risk_score) as avg_risk,
                 count(*) filter (where r.risk_band = 'critical') as critical_count
          from roll r left join v_sellers s on s.seller_id = r.seller_id
          where s.seller_state is not null group by 1)"""
reg("a11_state_summary", *ROLL_ALL, STATE, sel(["state", "count", r("avg_risk"), "critical_count"], "from st"))
reg("k05_top_states", *ROLL_ALL, STATE,
    sel(["state", "count", r("avg_risk"), "critical_count"], "from st order by avg_risk desc, state limit 12"))
reg("a12_risk_histogram", *ROLL_ALL,
    """h as (select least(cast(floor(risk_score * 20) as integer), 19) as bin, count(*) as c
          from roll where risk_score between 0 and 1 group by 1)""",
    "select cast(g.i as integer) as bin, coalesce(h.c, 0) as count from range(20) g(i) left join h on h.bin = g.i")
reg("a13_states_and_span",
    sel(["distinct seller_state", ds("(select min(cast(purchase as date)) from v_orders)", "first_day"),
         ds("(select max(cast(purchase as date)) from v_orders)", "last_day")], "from v_sellers"))
reg("a14_signal_provenance",
    """select count(*) as total, count(*) filter (where is_synthetic = 0) as real,
              count(*) filter (where is_synthetic = 1) as generated from v_signals""")
reg("a15_base_rate", SDO, r("sum(late_n) / sum(orders_n)", "p0").join(["select ", " from sdo"]))
reg("a16_class_distribution", *FT_ALL,
    sel(["is_late_delivery", r("count(*) * 100.0 / (select count(*) from ft)", "pct")], "from ft group by 1"))
reg("a18_monthly_late_rate", *FT_ALL,
    sel([ds("last_day(cast(as_of_date as date))", "month_end"), r("avg(cast(is_late_delivery as double))", "late_rate")],
        "from ft group by 1"))
reg("u01_union_signals",
    """u as (select * from v_signals where is_synthetic = 1 union all select * from v_signals where is_synthetic = 0)""",
    sel(["source", "is_synthetic", "count(*) as n", r("sum(value)", "total")], "from u group by 1, 2"))
reg("w17_running_counts_state", OSA,
    """dd as (select customer_state, cast(date_diff('day', date '1970-01-01', cast(purchase as date)) as integer) as day_no,
              count(*) as n, cast(sum(is_late) as bigint) as late from osa group by all)""",
    """select customer_state, day_no,
              cast(sum(n) over (partition by customer_state order by day_no) as bigint) as cum_n,
              cast(sum(late) over (partition by customer_state order by day_no) as bigint) as cum_late from dd""")
reg("p08_promise_filter", *FT_ALL, sel(["count(*) as n_rows", r("min(promised_days)", "min_promised")], "from ft"))


# ---------------------------------------------------------------- seller-day panel
PANEL = """ptot as (select seller_id, sum(orders_n) as tot, min(order_date) as a, max(order_date) as b
                 from sdo group by 1 having sum(orders_n) >= 10),
grid as (select seller_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as as_of_date from ptot),
panel as (select g.seller_id, g.as_of_date, coalesce(s.orders_n, 0) as orders_n, coalesce(s.late_n, 0) as late_n,
                 s.avg_delay_days
          from grid g left join sdo s on s.seller_id = g.seller_id and s.order_date = g.as_of_date)"""


def _trail(col, w, fn="sum"):
    return f"{fn}({col}) over (partition by seller_id order by as_of_date rows between {w} preceding and 1 preceding)"


HISTP = """hp as (select *,
  {cols},
  coalesce(lag(late_n) over (partition by seller_id order by as_of_date), 0) as prev_late
  from panel),
hp2 as (select *, late_rate_7d - late_rate_30d as late_rate_trend,
  coalesce(date_diff('day', max(case when prev_late > 0 then as_of_date end) over
      (partition by seller_id order by as_of_date rows between unbounded preceding and 1 preceding), as_of_date), 9999)
    as days_since_last_late
  from hp)""".format(cols=",\n  ".join(
    f"coalesce({_trail('late_n', w)}, 0) as late_count_{w}d, coalesce({_trail('orders_n', w)}, 0) as order_count_{w}d, "
    f"coalesce({_trail('late_n', w)}, 0) / nullif(coalesce({_trail('orders_n', w)}, 0), 0) as late_rate_{w}d"
    for w in (7, 14, 30)))

REVP = """rp as (select p.*, r.avg_review_score, r.bad_reviews_n from panel p
               left join sdr r on r.seller_id = p.seller_id and r.review_date = p.as_of_date),
rp2 as (select seller_id, as_of_date, {cols} from rp)""".format(cols=", ".join(
    f"{_trail('avg_review_score', w, 'avg')} as review_score_avg_{w}d, "
    f"coalesce({_trail('bad_reviews_n', w)}, 0) as bad_reviews_{w}d" for w in (7, 14, 30)))

SIGP = """sp as (select p.*, s.seller_state from panel p left join v_sellers s on s.seller_id = p.seller_id),
sp1 as (select sp.*, w.weather_severity, w.port_congestion, w.commodity_volatility from sp
        left join sigw w on w.seller_state = sp.seller_state and w.signal_date = sp.as_of_date),
sp2 as (select seller_id, as_of_date, seller_state, {cols} from sp1)""".format(cols=", ".join(
    f"avg({n}) over (partition by seller_id order by as_of_date rows between {w - 1} preceding and current row) as {n}_{w}d"
    for n in ("weather_severity", "port_congestion", "commodity_volatility") for w in (7, 14, 30)))

FWDP = """fp as (select *,
  case when lead(orders_n, 30) over (partition by seller_id order by as_of_date) is not null
       then sum(late_n) over (partition by seller_id order by as_of_date rows between 1 following and 30 following) end as forward_late,
  case when lead(orders_n, 30) over (partition by seller_id order by as_of_date) is not null
       then sum(orders_n) over (partition by seller_id order by as_of_date rows between 1 following and 30 following) end as forward_orders
  from panel),
fp2 as (select *, forward_late / nullif(forward_orders, 0) as forward_rate from fp)"""

PANEL_ALL = (SDO, PANEL)
hist_cols = [f"{k}_{w}d" for w in (7, 14, 30) for k in ("late_count", "order_count", "late_rate")]

reg("w01_seller_day_panel", *PANEL_ALL,
    sel(["seller_id", ds("as_of_date"), "orders_n", "late_n", r("avg_delay_days")], "from panel"))
reg("w01_empty_panel", SDO,
    "select seller_id, strftime(order_date, '%Y-%m-%d') as as_of_date, orders_n, late_n, round(avg_delay_days, 6) as avg_delay_days from sdo where false")
reg("w02_trailing_delivery_counts", *PANEL_ALL, HISTP,
    sel(["seller_id", ds("as_of_date")] + [r(c) if "rate" in c else c for c in hist_cols], "from hp2"))
reg("w03_late_rate_trend", *PANEL_ALL, HISTP, sel(["seller_id", ds("as_of_date"), r("late_rate_trend")], "from hp2"))
reg("w04_days_since_last_late", *PANEL_ALL, HISTP,
    sel(["seller_id", ds("as_of_date"), "cast(days_since_last_late as integer) as days_since_last_late"], "from hp2"))
reg("w05_review_windows", *PANEL_ALL, SDR, REVP,
    sel(["seller_id", ds("as_of_date")] + [x for w in (7, 14, 30) for x in (r(f"review_score_avg_{w}d"), f"bad_reviews_{w}d")],
        "from rp2"))
reg("w06_signal_windows", *PANEL_ALL, SIGW, SIGP,
    sel(["seller_id", ds("as_of_date"), "seller_state"] +
        [r(f"{n}_{w}d") for n in ("weather_severity", "port_congestion", "commodity_volatility") for w in (7, 14, 30)],
        "from sp2"))
PROF = """pr as (select h.seller_id, h.as_of_date, h.late_count_30d, h.order_count_30d, h.late_rate_30d, s.seller_state
               from hp2 h left join v_sellers s on s.seller_id = h.seller_id),
pr2 as (select seller_id, as_of_date,
  sum(late_count_30d) over (partition by seller_id order by as_of_date rows between unbounded preceding and current row)
   / nullif(sum(order_count_30d) over (partition by seller_id order by as_of_date rows between unbounded preceding and current row), 0)
   as lifetime_late_rate,
  avg(late_rate_30d) over (partition by seller_state, as_of_date) as state_peer_late_rate,
  cast(date_diff('day', min(as_of_date) over (partition by seller_id), as_of_date) as integer) as seller_tenure_days,
  seller_state
  from pr)"""
reg("w07_w09_profile_features", *PANEL_ALL, HISTP, PROF,
    sel(["seller_id", ds("as_of_date"), r("lifetime_late_rate"), r("state_peer_late_rate"), "seller_tenure_days"],
        "from pr2"))
reg("w10_forward_sums", *PANEL_ALL, FWDP,
    sel(["seller_id", ds("as_of_date"), "cast(forward_late as bigint) as forward_late",
         "cast(forward_orders as bigint) as forward_orders", r("forward_rate")], "from fp2"))
HALVES = """hv as (select seller_id, as_of_date,
  case when lead(orders_n, 15) over w is not null then sum(late_n) over (w rows between 1 following and 15 following) end as l1,
  case when lead(orders_n, 15) over w is not null then sum(orders_n) over (w rows between 1 following and 15 following) end as o1,
  case when lead(orders_n, 30) over w is not null then sum(late_n) over (w rows between 16 following and 30 following) end as l2,
  case when lead(orders_n, 30) over w is not null then sum(orders_n) over (w rows between 16 following and 30 following) end as o2
  from panel window w as (partition by seller_id order by as_of_date))"""
reg("w11_offset_window_sum", *PANEL_ALL, HALVES,
    sel(["seller_id", ds("as_of_date")] + [f"cast({c} as bigint) as {c}" for c in ("l1", "o1", "l2", "o2")], "from hv"))
LABEL = """lab as (select *, case when forward_orders is null or forward_orders < 5 then null
                           when forward_rate >= 0.15 then 1 else 0 end as high_late_rate_next_30d from fp2)"""
reg("w12_forward_label", *PANEL_ALL, FWDP, LABEL,
    sel(["seller_id", ds("as_of_date"), "cast(forward_orders as bigint) as forward_orders",
         r("forward_rate", "late_rate_next_30d"), "high_late_rate_next_30d"], "from lab"))

L09_COLS = (["f.seller_id", ds("f.as_of_date")] + [r(c) if "rate" in c else c for c in hist_cols] +
            [r("late_rate_trend"), "cast(days_since_last_late as integer) as days_since_last_late"] +
            [x for w in (7, 14, 30) for x in (r(f"review_score_avg_{w}d"), f"bad_reviews_{w}d")] +
            ["sp2.seller_state"] +
            [r(f"{n}_{w}d") for n in ("weather_severity", "port_congestion", "commodity_volatility") for w in (7, 14, 30)] +
            [r("lifetime_late_rate"), r("state_peer_late_rate"), "seller_tenure_days", "high_late_rate_next_30d"])
reg("l09_seller_day_feature_table", *PANEL_ALL, HISTP, SDR, REVP, SIGW, SIGP, PROF, FWDP, LABEL,
    sel(L09_COLS, """from lab f
        join hp2 using (seller_id, as_of_date) join rp2 using (seller_id, as_of_date)
        join sp2 using (seller_id, as_of_date) join pr2 using (seller_id, as_of_date)
        where high_late_rate_next_30d is not null"""))

reg("l01_any_late_label", *PANEL_ALL, FWDP,
    sel(["seller_id", ds("as_of_date"), """case when forward_orders is null or forward_orders < 1 then null
         when forward_late >= 1 then 1 else 0 end as y"""], "from fp2"))
reg("l02_rate_label", *PANEL_ALL, FWDP,
    sel(["seller_id", ds("as_of_date"), """case when forward_orders < 5 or forward_rate is null then null
         when forward_rate >= 0.25 then 1 else 0 end as y"""], "from fp2"))
P0 = "p0 as (select sum(late_n) / sum(orders_n) as p0 from fp2)"
reg("l03_shrunk_label", *PANEL_ALL, FWDP, P0,
    "sh as (select fp2.*, (forward_late + p0 * 20.0) / (forward_orders + p0 * 20.0 + (1 - p0) * 20.0) as shrunk from fp2, p0)",
    sel(["seller_id", ds("as_of_date"), r("shrunk"), """case when forward_orders is null or forward_orders < 5 then null
         when shrunk >= 0.25 then 1 else 0 end as y"""], "from sh"))
reg("l04_zscore_label", *PANEL_ALL, FWDP, P0,
    "zs as (select fp2.*, (forward_late - forward_orders * p0) / sqrt(forward_orders * p0 * (1 - p0)) as excess from fp2, p0)",
    sel(["seller_id", ds("as_of_date"), r("case when isnan(excess) or isinf(excess) then null else excess end", "excess"),
         """case when forward_orders is null or forward_orders < 5 then null
         when excess >= 1.0 then 1 else 0 end as y"""], "from zs"))
reg("l05_stratified_label", *PANEL_ALL, FWDP,
    """el as (select seller_id, as_of_date, forward_rate, forward_orders, date_trunc('month', as_of_date) as month,
              row_number() over (partition by date_trunc('month', as_of_date) order by forward_orders, seller_id, as_of_date) as rk,
              count(*) over (partition by date_trunc('month', as_of_date)) as n
              from fp2 where forward_orders >= 5)""",
    """eb as (select *, cast(greatest(ceil((rk - 1) * 10.0 / greatest(n - 1, 1)), 1) - 1 as integer) as vol_bin from el)""",
    """ep as (select *, case when forward_rate is null then null else
              (rank() over (partition by month, vol_bin order by forward_rate)
               + (count(*) over (partition by month, vol_bin, forward_rate) - 1) / 2.0)
              / count(forward_rate) over (partition by month, vol_bin) end as pct from eb)""",
    sel(["f.seller_id", ds("f.as_of_date"), "ep.vol_bin", r("ep.pct"),
         "case when ep.forward_rate is null then null when ep.pct >= 0.8 then 1 else 0 end as y"],
        "from fp2 f left join ep on ep.seller_id = f.seller_id and ep.as_of_date = f.as_of_date"))
reg("l07_split_half_reliability", *PANEL_ALL, HALVES,
    "rr as (select l1 / o1 as r1, l2 / o2 as r2 from hv where o1 >= 5 and o2 >= 5 and l1 is not null and l2 is not null)",
    "rk as (select r1, r2, rank() over (order by r1) + (count(*) over (partition by r1) - 1) / 2.0 as a1, rank() over (order by r2) + (count(*) over (partition by r2) - 1) / 2.0 as a2 from rr)",
    """select count(*) as n, case when count(*) >= 500 then round(corr(r1, r2), 6) end as pearson,
              case when count(*) >= 500 then round(corr(a1, a2), 6) end as spearman from rk""")

VOL = """pg as (select d as signal_date, p.value from days left join v_prices p using (d)),
pf as (select signal_date, coalesce(
         last_value(value ignore nulls) over (order by signal_date rows between unbounded preceding and current row),
         first_value(value ignore nulls) over (order by signal_date rows between current row and unbounded following)) as value
       from pg),
pr0 as (select *, value / lag(value) over (order by signal_date) - 1 as ret from pf),
pv as (select *, case when count(ret) over (order by signal_date rows between 13 preceding and current row) >= 2
                 then stddev_samp(ret) over (order by signal_date rows between 13 preceding and current row) end as vol from pr0),
mm as (select min(vol) as lo, max(vol) as hi from pv),
ps as (select signal_date, case when hi > lo then (vol - lo) / (hi - lo) else vol * 0 end as scaled from pv, mm),
md as (select median(scaled) as med from ps),
vol as (select signal_date, round(least(greatest(coalesce(scaled, med), 0.0), 1.0), 4) as value from ps, md)"""
reg("w15_price_volatility", VOL, sel([ds("signal_date"), r("value")], "from vol"))
reg("w16_fill_prices", VOL, sel([ds("signal_date"), r("value")], "from pf"))
reg("j10_replicate_series", VOL,
    sel(["s.seller_state", ds("v.signal_date"), "'commodity' as source", r("v.value"), "0 as is_synthetic"],
        "from vol v, (select distinct seller_state from v_sellers) s"))
reg("s18_event_props", "select event_id, event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")

NUMERIC_FT = ["n_items", "total_price", "total_freight", "promised_days", "shipping_limit_days", "handover_share",
              "purchase_hour", "purchase_dow", "purchase_month", "purchase_is_weekend", "freight_ratio",
              "price_per_item", "density", "log_weight", "log_volume", "same_state", "zip_gap", "seller_zip_region",
              "customer_zip_region", "seller_prior_orders", "seller_prior_late_rate", "state_prior_orders",
              "state_prior_late_rate"]
reg("a17_label_correlations", *FT_ALL,
    "cw as (select " + ", ".join(f"corr(cast({c} as double), cast(is_late_delivery as double)) as {c}" for c in NUMERIC_FT) + " from ft)",
    "cl as (unpivot cw on " + ", ".join(NUMERIC_FT) + " into name feature value corr)",
    "select feature, round(corr, 6) as corr, round(abs(corr), 6) as abs_corr from cl where corr is not null order by abs(corr) desc, feature limit 10")
reg("a19_grouped_describe", *FT_ALL,
    sel(["is_late_delivery", "count(promised_days) as count", r("avg(promised_days)", "mean"),
         r("stddev_samp(promised_days)", "std"), r("min(promised_days)", "min"), r("max(promised_days)", "max"),
         r("quantile_cont(promised_days, 0.25)", "p25"), r("quantile_cont(promised_days, 0.5)", "p50"),
         r("quantile_cont(promised_days, 0.75)", "p75")], "from ft group by 1"))
FT_ALLCOLS = ["order_id", "seller_id", "n_items", "total_price", "total_freight", "category", "customer_state",
              "seller_state"] + NUMERIC_FT[3:] + ["is_late_delivery", "as_of_date"]
reg("a20_missing_share", *FT_ALL,
    "mw as (select " + ", ".join(f"avg(case when {c} is null then 1.0 else 0.0 end) * 100 as {c}" for c in FT_ALLCOLS) + " from ft)",
    "ml as (unpivot mw on " + ", ".join(FT_ALLCOLS) + " into name feature value missing_pct)",
    "select feature, round(missing_pct, 6) as missing_pct from ml where missing_pct > 0")


# ---------------------------------------------------------------- evaluation on (y, score)
SC = "sc0 as (select order_id, seller_id, order_id * 1000000 + seller_id as id, y, score from v_scores)"
CURVE = """g as (select score, count(*) as n, sum(y) as pos from sc0 group by 1),
cv as (select score, n, pos, n - pos as neg,
        sum(n) over (order by score desc) as cum_n, sum(pos) over (order by score desc) as cum_pos,
        sum(n) over () as nt, sum(pos) over () as p from g)"""
reg("e01_e03_ranking_metrics", SC, CURVE,
    "ar as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as ar from sc0)",
    """mw as (select (sum(ar) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0)
                 / (count(*) filter (where y = 1) * count(*) filter (where y = 0)) as roc_auc from ar)""",
    """select round(max(abs((p - cum_pos + pos) / greatest(p, 1) - ((nt - p) - (cum_n - cum_pos) + neg) / greatest(nt - p, 1))), 6) as ks_statistic,
              round((select roc_auc from mw), 6) as roc_auc,
              round(sum(pos / p * (cum_pos / cum_n)), 6) as pr_auc from cv""")
RN_DESC = "rd as (select *, row_number() over (order by score desc, id) as rn, count(*) over () as n, sum(y) over () as p from sc0)"
reg("e04_capture_at_k", SC, RN_DESC,
    "ks as (select unnest([0.05, 0.10, 0.20]) as k)",
    """select k, cast(greatest(round_even(n * k, 0), 1) as bigint) as n_reviewed,
              round(sum(y) / greatest(p, 1), 6) as capture,
              round(sum(y) / greatest(round_even(n * k, 0), 1), 6) as precision,
              round(sum(y) / greatest(p, 1) / k, 6) as lift
       from rd, ks where rn <= greatest(round_even(n * k, 0), 1) group by k, n, p""")
reg("k02_top_k_rows", SC, RN_DESC,
    "select order_id, seller_id, rn from rd where rn <= greatest(round_even(n * 0.1, 0), 1)")
BINS = """ra as (select *, row_number() over (order by score, id) as r, count(*) over () as n from sc0),
bn as (select *, cast(greatest(ceil((r - 1) * 10.0 / greatest(n - 1, 1)), 1) - 1 as integer) as bin from ra),
rel as (select bin, avg(score) as mean_predicted, avg(cast(y as double)) as observed_rate, count(*) as n from bn group by 1)"""
reg("w13_equal_count_bins", SC, BINS, "select order_id, seller_id, bin from bn")
reg("e05_reliability_table", SC, BINS, sel(["bin", r("mean_predicted"), r("observed_rate"), "n"], "from rel"))
reg("e06_expected_calibration_error", SC, BINS,
    "select round(sum(n * 1.0 / (select sum(n) from rel) * abs(mean_predicted - observed_rate)), 6) as ece from rel")
THR = """tm as (select count(*) as n_eval,
   count(*) filter (where score >= {t} and y = 1) as true_positives,
   count(*) filter (where score >= {t} and y = 0) as false_positives,
   count(*) filter (where score < {t} and y = 1) as false_negatives,
   count(*) filter (where score < {t} and y = 0) as true_negatives,
   avg(cast(y as double)) as base_rate, min(score) as mn, max(score) as mx, avg((score - y) * (score - y)) as b
   from sc0)"""
reg("e07_e08_threshold_metrics", SC, THR.format(t=0.05),
    sel(["n_eval", "true_positives", "false_positives", "false_negatives", "true_negatives", r("base_rate"),
         r("coalesce(true_positives / nullif(true_positives + false_positives, 0), 0)", "precision"),
         r("coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0)", "recall"),
         r("coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0)", "f1"),
         r("case when mn >= 0 and mx <= 1 then b end", "brier"),
         "case when mn >= 0 and mx <= 1 then 1 else 0 end as is_probability",
         r("(true_positives + false_positives) / n_eval", "alert_volume")], "from tm"))
reg("e09_f1_optimal_threshold", SC, CURVE,
    "f as (select score, cum_pos / cum_n as pr, cum_pos / greatest(p, 1) as rc from cv)",
    "f2 as (select *, 2 * pr * rc / (pr + rc + 1e-9) as f1 from f)",
    sel([r("score", "optimal_threshold"), r("pr", "precision_at_optimal"), r("rc", "recall_at_optimal"),
         r("f1", "f1_at_optimal")], "from f2 order by f1 desc, score asc limit 1"))
COST = """th as (select distinct unnest(quantile_cont(score, [{qs}])) as threshold from sc0),
cc as (select threshold, count(*) filter (where y = 1 and score < threshold) as fn,
              count(*) filter (where y = 0 and score >= threshold) as fp from th, sc0 group by 1),
cc2 as (select *, fn * 10.0 + fp * 1.0 as total_cost from cc)""".format(qs=", ".join(str(i / 100) for i in range(1, 100)))
reg("e10_cost_curve", SC, COST, sel([r("threshold"), "fn", "fp", r("total_cost")], "from cc2"))
reg("e10_cost_optimal_threshold", SC, COST,
    "bl as (select count(*) filter (where y = 1) * 10.0 as baseline_cost_no_model from sc0)",
    sel([r("threshold", "cost_optimal_threshold"), r("total_cost"), r("baseline_cost_no_model"),
         r("1.0 - total_cost / greatest(baseline_cost_no_model, 1e-9)", "cost_reduction")],
        "from (select * from cc2 order by total_cost, threshold limit 1) b, bl"))

MODELS = """ml as (select 'promise' as model, id, y, score from sc0
  union all select 'hashed', id, y, ((order_id * 7919 + seller_id * 31) % 1000) / 1e3 from sc0
  union all select 'inverse', id, y, 1.0 - score from sc0),
mg as (select model, score, count(*) as n, sum(y) as pos from ml group by 1, 2),
mc as (select *, sum(n) over (partition by model order by score desc) as cum_n,
        sum(pos) over (partition by model order by score desc) as cum_pos,
        sum(n) over (partition by model) as nt, sum(pos) over (partition by model) as p from mg),
mrank as (select model, round(sum(pos / p * (cum_pos / cum_n)), 6) as pr_auc,
        round(sum((n - pos) * (cum_pos - pos / 2.0)) / (max(p) * max(nt - p)), 6) as roc_auc,
        round(max(abs((p - cum_pos + pos) / greatest(p, 1) - ((nt - p) - (cum_n - cum_pos) + (n - pos)) / greatest(nt - p, 1))), 6) as ks_statistic
        from mc group by 1)"""
reg("e11_model_comparison", SC, MODELS,
    """mr as (select *, row_number() over (partition by model order by score desc, id) as rn,
                     row_number() over (partition by model order by score, id) as ra,
                     count(*) over (partition by model) as n, sum(y) over (partition by model) as p from ml)""",
    """cap as (select model,
        sum(y) filter (where rn <= greatest(round_even(n * 0.1, 0), 1)) / greatest(max(p), 1) as capture_at_10pct,
        sum(y) filter (where rn <= greatest(round_even(n * 0.2, 0), 1)) / greatest(max(p), 1) as capture_at_20pct,
        count(*) filter (where score >= 0.5 and y = 1) as tp, count(*) filter (where score >= 0.5 and y = 0) as fp,
        count(*) filter (where score < 0.5 and y = 1) as fn, avg((score - y) * (score - y)) as b,
        min(score) as mn, max(score) as mx from mr group by 1)""",
    """mb as (select model, cast(greatest(ceil((ra - 1) * 10.0 / greatest(n - 1, 1)), 1) - 1 as integer) as bin, score, y from mr)""",
    """me as (select model, sum(c * 1.0 / t * abs(mp - orate)) as ece from
        (select model, bin, count(*) as c, sum(count(*)) over (partition by model) as t, avg(score) as mp, avg(cast(y as double)) as orate
         from mb group by 1, 2) x group by 1)""",
    sel(["m.model", "m.pr_auc", "m.roc_auc", "m.ks_statistic", r("capture_at_10pct"), r("capture_at_10pct / 0.1", "lift_at_10pct"),
         r("capture_at_20pct"), r("case when mn >= 0 and mx <= 1 then b end", "brier"), r("me.ece", "ece"),
         r("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "f1"), r("coalesce(tp / nullif(tp + fp, 0), 0)", "precision"),
         r("coalesce(tp / nullif(tp + fn, 0), 0)", "recall")],
        "from mrank m join cap using (model) join me using (model)"))
reg("e19_quality_gate", SC, MODELS,
    "select model as best_model, pr_auc, case when pr_auc >= 0.13 then 1 else 0 end as passed from mrank order by pr_auc desc, model desc limit 1")
reg("e12_fixed_band", SC,
    """select order_id, seller_id, case when score >= 0.08 then 'critical' when score >= 0.05 then 'high'
              when score >= 0.03 then 'medium' else 'low' end as band from sc0""")
ABL_COLS = ["promised_days", "zip_gap", "purchase_hour", "n_items", "total_price"]
reg("e20_single_column_ablation", *FT_ALL,
    "al as (unpivot (select order_id * 1000000 + seller_id as id, is_late_delivery as y, " +
    ", ".join(f"cast({c} as double) as {c}" for c in ABL_COLS) + " from ft) on " + ", ".join(ABL_COLS) +
    " into name feature value x)",
    """a1 as (select feature, y, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as ar from al)""",
    """auc as (select feature, (sum(ar) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0)
                 / (count(*) filter (where y = 1) * count(*) filter (where y = 0)) as auc0 from a1 group by 1)""",
    "al2 as (select al.feature, al.y, case when auc0 < 0.5 then -x else x end as score, auc0 < 0.5 as fl from al join auc using (feature))",
    """g2 as (select feature, score, count(*) as n, sum(y) as pos from al2 group by 1, 2),
c2 as (select *, sum(n) over (partition by feature order by score desc) as cum_n, sum(pos) over (partition by feature order by score desc) as cum_pos,
        sum(n) over (partition by feature) as nt, sum(pos) over (partition by feature) as p from g2)""",
    sel(["feature", r("sum(pos / p * (cum_pos / cum_n))", "pr_auc"),
         r("sum((n - pos) * (cum_pos - pos / 2.0)) / (max(p) * max(nt - p))", "roc_auc"),
         r("max(abs((p - cum_pos + pos) / greatest(p, 1) - ((nt - p) - (cum_n - cum_pos) + (n - pos)) / greatest(nt - p, 1)))", "ks_statistic"),
         "cast(max(case when feature in (select feature from auc where auc0 < 0.5) then 1 else 0 end) as integer) as flipped"],
        "from c2 group by feature"))
reg("a23_score_quantiles", SC,
    "qv as (select [{qs}] as qs, quantile_cont(score, [{qs}]) as vs from sc0)".format(qs=", ".join(str(i / 100) for i in range(1, 100))),
    "select round(qs[i], 6) as q, round(vs[i], 6) as value from qv, range(1, 100) t(i)")

SPLITPTS = """nn as (select count(*) as n from ft),
srt as (select as_of_date, row_number() over (order by as_of_date) - 1 as i from ft),
pts as (select (select as_of_date from srt, nn where i = round_even((n - 1) * 0.8, 0)) as test_start,
               (select as_of_date from srt, nn where i = round_even((n - 1) * 0.7000000000000001, 0)) as calib_start)"""
reg("a22_nearest_date_quantiles", *FT_ALL, SPLITPTS, sel([ts("test_start"), ts("calib_start")], "from pts"))
BLOCK = """blk as (select ft.*, case when as_of_date >= test_start then 'test'
            when as_of_date >= calib_start and as_of_date < test_start - interval 30 day then 'calib'
            when as_of_date < calib_start - interval 30 day then 'train' end as block from ft, pts)"""
reg("m01_purged_split", *FT_ALL, SPLITPTS, BLOCK, "select order_id, seller_id, block from blk")
reg("m02_chronological_split", *FT_ALL,
    """nn as (select count(*) as n from ft),
srt as (select as_of_date, row_number() over (order by as_of_date) - 1 as i from ft),
pts as (select (select as_of_date from srt, nn where i = round_even((n - 1) * 0.8, 0)) as t0)""",
    "select order_id, seller_id, case when as_of_date >= t0 then 'test' when as_of_date < t0 then 'train' end as block from ft, pts")
reg("m03_forward_folds", *FT_ALL,
    "ri as (select order_id, seller_id, row_number() over (order by as_of_date, order_id * 1000000 + seller_id) - 1 as row_idx, count(*) over () as n from ft)",
    "rf as (select *, n // 4 as tsz from ri)",
    """select order_id, seller_id, row_idx, case
         when row_idx >= n - 3 * tsz and row_idx < n - 2 * tsz then 1
         when row_idx >= n - 2 * tsz and row_idx < n - 1 * tsz then 2
         when row_idx >= n - 1 * tsz and row_idx < n then 3 end as test_fold from rf""")
reg("u03_blocks_disjoint", *FT_ALL, SPLITPTS, BLOCK,
    """select a as block_a, b as block_b, (select count(*) from (
         select order_id, seller_id from blk where block = a intersect select order_id, seller_id from blk where block = b)) as n_common
       from (values ('train', 'calib'), ('train', 'test'), ('calib', 'test')) v(a, b)""")
reg("k08_recent_rows", *FT_ALL,
    "select order_id, seller_id from ft order by as_of_date desc, order_id * 1000000 + seller_id desc limit 80000")
NUMC = ["n_items", "total_price", "promised_days", "handover_share", "freight_ratio", "density", "zip_gap",
        "seller_prior_late_rate"]
reg("m04_numeric_prep", *FT_ALL, SPLITPTS, BLOCK,
    "md as (select " + ", ".join(f"median({c}) as {c}" for c in NUMC) + " from blk where block = 'train')",
    "imp as (select blk.order_id, blk.seller_id, blk.block, " +
    ", ".join(f"coalesce(cast(blk.{c} as double), md.{c}) as {c}" for c in NUMC) + " from blk, md)",
    "ms as (select " + ", ".join(f"avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}" for c in NUMC) +
    " from imp where block = 'train')",
    sel(["order_id", "seller_id"] + [r(f"({c} - m_{c}) / s_{c}", c) for c in NUMC], "from imp, ms"))
CATS = ["category", "customer_state", "seller_state"]
reg("m05_one_hot_long", *FT_ALL, SPLITPTS, BLOCK,
    " , ".join(f"""mo_{c} as (select {c} as v from blk where block = 'train' and {c} is not null group by 1 order by count(*) desc, {c} limit 1),
lv_{c} as (select distinct coalesce({c}, (select v from mo_{c})) as v from blk where block = 'train')""" for c in CATS),
    " union all ".join(f"""select order_id, seller_id, '{c}' as "column", coalesce({c}, (select v from mo_{c})) as level from blk
        where coalesce({c}, (select v from mo_{c})) in (select v from lv_{c})""" for c in CATS))
reg("m07_class_weights", *FT_ALL, SPLITPTS, BLOCK,
    """tw as (select count(*) as n, count(*) filter (where is_late_delivery = 1) as pos,
              count(*) filter (where is_late_delivery = 0) as neg from blk where block = 'train')""",
    sel(["n", "pos", "neg", r("n / (2.0 * neg)", "w_neg"), r("n / (2.0 * pos)", "w_pos"), r("neg / pos", "scale_pos_weight")],
        "from tw"))
REFCUR = """nn as (select count(*) as n from ft),
srt as (select as_of_date, row_number() over (order by as_of_date) - 1 as i from ft),
cutp as (select as_of_date as cut from srt, nn where i = floor(n * 0.5)),
rc as (select ft.*, case when as_of_date < cut then 'reference' else 'current' end as "window" from ft, cutp)"""
reg("d01_reference_current_split", *FT_ALL, REFCUR,
    sel(['"window"', "count(*) as n", ts("min(as_of_date)", "first"), ts("max(as_of_date)", "last")], 'from rc group by 1'))
DRIFT = """lvv as (unpivot (select "window", """ + ", ".join(f"cast({c} as double) as {c}" for c in NUMC) + """ from rc)
          on """ + ", ".join(NUMC) + """ into name feature value value),
dg as (select feature, value, count(*) filter (where "window" = 'reference') as nr,
              count(*) filter (where "window" = 'current') as nc from lvv where value is not null group by 1, 2),
dc as (select *, sum(nr) over (partition by feature order by value) * 1.0 / sum(nr) over (partition by feature) as fr,
              sum(nc) over (partition by feature order by value) * 1.0 / sum(nc) over (partition by feature) as fc,
              lead(value) over (partition by feature order by value) - value as gap,
              sum(nr) over (partition by feature) as n_reference, sum(nc) over (partition by feature) as n_current from dg),
dsd as (select feature, stddev_pop(value) as sd from lvv where "window" = 'reference' and value is not null group by 1),
dd as (select dc.feature, sum(coalesce(abs(fr - fc) * gap, 0)) / nullif(max(sd), 0) as wasserstein, max(abs(fr - fc)) as ks,
              cast(max(n_reference) as bigint) as n_reference, cast(max(n_current) as bigint) as n_current
       from dc left join dsd using (feature) group by 1)"""
reg("d02_drift_distances", *FT_ALL, REFCUR, DRIFT,
    sel(["feature", r("wasserstein"), r("ks"), "n_reference", "n_current"], "from dd"))
reg("d03_d04_drift_summary", *FT_ALL, REFCUR, DRIFT,
    sel(["feature", r("wasserstein", "value"), "case when wasserstein > 0.1 then 1 else 0 end as drifted",
         "(select count(*) from dd) as n_features", "(select count(*) filter (where wasserstein > 0.1) from dd) as n_drifted",
         r("(select count(*) filter (where wasserstein > 0.1) from dd) * 1.0 / (select count(*) from dd)", "share_drifted")],
        "from dd"))
reg("e16_calibration_report", SC,
    "cc0 as (select *, score * score as cal from sc0)",
    """cbin as (select *, cast(greatest(ceil((row_number() over (order by score, id) - 1) * 10.0 / greatest(count(*) over () - 1, 1)), 1) - 1 as integer) as b1,
                    cast(greatest(ceil((row_number() over (order by cal, id) - 1) * 10.0 / greatest(count(*) over () - 1, 1)), 1) - 1 as integer) as b2 from cc0)""",
    """e1 as (select sum(c * 1.0 / t * abs(mp - orate)) as ece_raw from (select b1, count(*) as c, sum(count(*)) over () as t, avg(score) as mp, avg(cast(y as double)) as orate from cbin group by 1))""",
    """e2 as (select sum(c * 1.0 / t * abs(mp - orate)) as ece_cal from (select b2, count(*) as c, sum(count(*)) over () as t, avg(cal) as mp, avg(cast(y as double)) as orate from cbin group by 1))""",
    sel([r("avg((score - y) * (score - y))", "brier_raw"), r("avg(cast(y as double))", "base_rate"),
         r("avg((cal - y) * (cal - y))", "brier_cal"), r("(select ece_raw from e1)", "ece_raw"),
         r("(select ece_cal from e2)", "ece_cal"), r("avg(score)", "mean_raw"), r("avg(cal)", "mean_cal")], "from cc0"))


# ---------------------------------------------------------------- text, retrieval, attribution
def _chunks(src: str, idc: str, size: int, ov: int) -> str:
    return f"""ch as (select {idc}, text, length(text) as n from {src}),
chs as (select {idc}, case when n <= {size} then [0] else range(0, n, {size - ov}) end as starts, text from ch),
chx as (select {idc}, unnest(starts) as st, generate_subscripts(starts, 1) - 1 as chunk_idx, text from chs)"""


reg("t01_chunk_documents", _chunks("documents", "doc_id", 512, 50),
    """select doc_id, chunk_idx, doc_id || '_chunk' || chunk_idx as chunk_id,
              case when length(text) <= 512 then text else substring(text, st + 1, 512) end as text from chx""")
reg("t01_chunk_conversations",
    "cv0 as (select conv_id * 1000 + turn as msg_id, text from conversations)", _chunks("cv0", "msg_id", 300, 50),
    """select msg_id, chunk_idx, msg_id || '_chunk' || chunk_idx as chunk_id,
              case when length(text) <= 300 then text else substring(text, st + 1, 300) end as text from chx""")
reg("t03_review_documents",
    """rj as (select oi.seller_id, s.seller_state, r.review_score, r.comment, r.created, r.order_id
             from v_reviews r join v_order_items oi on oi.order_id = r.order_id join v_sellers s on s.seller_id = oi.seller_id
             where r.comment is not null and r.comment <> ''
             order by r.created desc, r.order_id, oi.seller_id limit 2000)""",
    "rk as (select *, row_number() over (order by created desc, order_id, seller_id) - 1 as i from rj)",
    """select 'review_' || i || '_' || seller_id as id,
              'Customer review for seller ' || seller_id || ' (state ' || seller_state || ') on ' || strftime(created, '%Y-%m-%d')
              || ': ' || review_score || '/5 stars (' || case when review_score <= 2 then 'negative' when review_score >= 4 then 'positive' else 'neutral' end
              || '). Comment: ' || substring(comment, 1, 300) as text,
              cast(seller_id as varchar) as seller_id, 'customer_review' as source from rk""")
TOK = r"""tk as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents),
tc as (select doc_id, term, count(*) as tf from tk group by 1, 2),
nd as (select count(distinct doc_id) as n from documents),
tst as (select term, count(*) as df, sum(tf) as ttf from tc group by 1),
voc as (select term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from tst, nd
        where df >= 2 and df <= 0.6 * n order by ttf desc, term limit 4096)"""
reg("t05_tfidf_vocabulary", TOK, sel(["term", "df", r("idf")], "from voc"))
reg("t05_tfidf_documents", TOK,
    "tw as (select tc.doc_id, tc.term, tc.tf * voc.idf as w from tc join voc using (term))",
    sel(["doc_id", "term", r("w / sqrt(sum(w * w) over (partition by doc_id))", "weight")], "from tw"))
NN = """dist as (select c.query_id, e.vec_id,
                list_sum([(cast(x as double) - c.qv[i]) * (cast(x as double) - c.qv[i]) for x, i in e.embedding]) as distance
         from embeddings e, cen c {w}),
nn as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from dist)"""
reg("t06_top_k_nearest",
    "ex0 as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)",
    "cen as (select label as query_id, list(a order by i) as qv from (select label, i, avg(v) as a from ex0 group by 1, 2) group by 1)",
    NN.format(w=""), sel(["query_id", "vec_id", r("distance"), "rank"], "from nn where rank <= 4"))
reg("t06_top_k_filtered",
    "ex0 as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)",
    "cen as (select label as query_id, list(a order by i) as qv from (select label, i, avg(v) as a from ex0 group by 1, 2) group by 1)",
    NN.format(w="where e.label = 1"), sel(["query_id", "vec_id", r("distance"), "rank"], "from nn where rank <= 4"))
reg("t08_grounded_answers",
    "ex0 as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)",
    "cen as (select label as query_id, list(a order by i) as qv from (select label, i, avg(v) as a from ex0 group by 1, 2) group by 1)",
    NN.format(w=""),
    """ctx as (select query_id, count(*) as n_sources, string_agg('- ' || d.text, chr(10) || chr(10) order by rank) as context
              from nn join documents d on d.doc_id = nn.vec_id where rank <= 4 group by 1)""",
    """select c.query_id, coalesce(n_sources, 0) as n_sources,
              case when context is null then 'No relevant information found in the knowledge base for this question.'
                   else 'Retrieved context:' || chr(10) || chr(10) || context end as answer,
              case when context is null then 0 else 1 end as grounded
       from cen c left join ctx using (query_id)""")
COEFS = {"promised_days": -0.05, "handover_share": 0.8, "zip_gap": 0.00001, "n_items": 0.1,
         "freight_ratio": 2.0, "purchase_hour": 0.01}
ATTR = ("""amx as (select max(as_of_date) as m from ft),
arecent as (select ft.* from ft, amx where ft.as_of_date >= amx.m - interval 90 day),
bg as (select """ + ", ".join(f"avg(cast({c} as double)) as {c}" for c in COEFS) + """ from arecent),
att as (""" + " union all ".join(
    f"select r.order_id, r.seller_id, '{c}' as feature, {v!r} * (cast(r.{c} as double) - bg.{c}) as contribution from arecent r, bg"
    for c, v in COEFS.items()) + """),
sm as (select seller_id, feature, avg(contribution) as contribution from att group by 1, 2),
tops as (select seller_id, feature, contribution, row_number() over (partition by seller_id order by abs(contribution) desc, feature) as k from sm)""")
reg("x03_linear_attribution", *FT_ALL, ATTR, sel(["order_id", "seller_id", "feature", r("contribution")], "from att"))
reg("a08_seller_mean_attribution", *FT_ALL, ATTR, sel(["seller_id", "feature", r("contribution")], "from sm"))
reg("x06_global_importance", *FT_ALL, ATTR, sel(["feature", r("avg(abs(contribution))", "importance")], "from att group by 1"))

reg("k03_top_drivers", *FT_ALL, ATTR, sel(["seller_id", "cast(k as integer) as rank", "feature", r("contribution")], "from tops where k <= 5"))
reg("k05_biggest_driver", *ROLL_ALL, ATTR,
    """select t.seller_id, t.feature, case when t.contribution > 0 then 'raises' else 'lowers' end as direction
       from tops t where k = 1 and t.seller_id in (select seller_id from roll)""")
reg("x07_explanation_lookup", *ROLL_ALL, ATTR,
    """select r.seller_id, round(r.risk_score, 6) as risk_score, r.risk_band,
              (select count(*) from tops t where t.seller_id = r.seller_id and k <= 5) as n_drivers,
              (select feature from tops t where t.seller_id = r.seller_id and k = 1) as top_feature
       from roll r where r.seller_id = (select min(seller_id) from roll)""")
reg("t02_prediction_documents", *ROLL_ALL, ATTR,
    """dr as (select seller_id, string_agg(feature || ' (' || case when contribution > 0 then 'raises' else 'lowers' end
                  || ' risk, impact ' || printf('%.2f', abs(round(contribution, 6))) || ')', '; ' order by k) as ft
             from tops where k <= 5 group by 1)""",
    """select 'prediction_' || r.seller_id as id,
              'Seller ' || r.seller_id || ' in zip ' || s.seller_zip || ', state ' || s.seller_state
              || ', has a current delivery-risk score of ' || printf('%.2f', r.risk_score) || ' (' || r.risk_band
              || ' risk). Model used: promise-formula. Key contributing factors: ' || coalesce(dr.ft, '') || '.' as text,
              cast(r.seller_id as varchar) as seller_id, 'prediction' as source
       from roll r left join v_sellers s on s.seller_id = r.seller_id left join dr on dr.seller_id = r.seller_id""")


# ---------------------------------------------------------------- cleaning, catalog, run log
reg("p13_nonempty_text", "select review_id, order_id from v_reviews where comment is not null and comment <> ''")
reg("p15_handle_missing", *FT_ALL,
    "mdn as (select median(density) as d, median(log_weight) as lw, median(seller_prior_late_rate) as sp from ft)",
    sel(["order_id", "seller_id", r("coalesce(density, d)", "density"), r("coalesce(log_weight, lw)", "log_weight"),
         r("coalesce(seller_prior_late_rate, sp)", "seller_prior_late_rate")],
        "from ft, mdn where order_id is not null and seller_id is not null"))
reg("p16_winsorise", *FT_ALL,
    """qq as (select quantile_cont(total_price, 0.25) as a1, quantile_cont(total_price, 0.75) as a3,
                     quantile_cont(zip_gap, 0.25) as b1, quantile_cont(zip_gap, 0.75) as b3,
                     quantile_cont(density, 0.25) as c1, quantile_cont(density, 0.75) as c3 from ft)""",
    sel(["order_id", "seller_id",
         r("least(greatest(total_price, a1 - 1.5 * (a3 - a1)), a3 + 1.5 * (a3 - a1))", "total_price"),
         r("least(greatest(zip_gap, b1 - 1.5 * (b3 - b1)), b3 + 1.5 * (b3 - b1))", "zip_gap"),
         r("case when density is null then null else least(greatest(density, c1 - 1.5 * (c3 - c1)), c3 + 1.5 * (c3 - c1)) end", "density")],
        "from ft, qq"))
reg("p18_drop_duplicates",
    """dd as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as rn
              from lineitem)""",
    sel(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("l_quantity")], "from dd where rn = 1"))
reg("p18_exact_distinct", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
reg("s12_reload_counts", """select 'sellers' as table_name, count(*) as n_rows from v_sellers
    union all select 'customers', count(*) from v_customers union all select 'products', count(*) from v_products
    union all select 'orders', count(*) from v_orders union all select 'order_items', count(*) from v_order_items
    union all select 'reviews', count(*) from v_reviews union all select 'external_signals', count(*) from v_signals""")
RUNS = """runs as (select model, pr_auc, roc_auc, row_number() over (order by pr_auc desc, model desc) as version from mrank)"""
reg("s21_run_log", SC, MODELS, RUNS,
    "select model, pr_auc, roc_auc, case when version = 1 then 'Production' else 'Archived' end as stage from runs")
reg("x11_live_model", SC, MODELS, RUNS,
    "select 'ok' as status, model as model_name, 'Production' as model_stage from runs where version = 1")
reg("s17_series_payload_parse", sel([ds("d", "date"), r("value")], "from v_prices"))
reg("p03_safe_coercion",
    """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(value, 6) as value,
              try_cast(json_extract_string(props, '$.k') as bigint) as k, try_cast(event_type as double) as type_as_number
       from events""")
reg("l08_persistence_auc", *PANEL_ALL, HISTP, FWDP,
    "sw as (select unnest([5, 10, 20, 30, 50]) as min_n)",
    """hf as (select f.seller_id, f.as_of_date, f.forward_rate, f.forward_orders, h.late_rate_30d
              from fp2 f join hp2 h using (seller_id, as_of_date))""",
    """e0 as (select sw.min_n, hf.*, date_trunc('month', as_of_date) as month,
              row_number() over (partition by sw.min_n, date_trunc('month', as_of_date) order by forward_orders, seller_id, as_of_date) as rk,
              count(*) over (partition by sw.min_n, date_trunc('month', as_of_date)) as n
              from hf, sw where forward_orders >= sw.min_n)""",
    "e1 as (select *, cast(greatest(ceil((rk - 1) * 10.0 / greatest(n - 1, 1)), 1) - 1 as integer) as vol_bin from e0)",
    """e2 as (select *, (rank() over (partition by min_n, month, vol_bin order by forward_rate)
              + (count(*) over (partition by min_n, month, vol_bin, forward_rate) - 1) / 2.0)
              / count(forward_rate) over (partition by min_n, month, vol_bin) as pct from e1 where forward_rate is not null)""",
    "e3 as (select *, case when pct >= 0.8 then 1 else 0 end as y from e2)",
    "cnt as (select min_n, count(*) as n_rows from e3 group by 1 having count(*) >= 3000)",
    """sp0 as (select e3.*, row_number() over (partition by e3.min_n order by as_of_date) - 1 as i, cnt.n_rows
               from e3 join cnt using (min_n))""",
    "tst as (select min_n, max(as_of_date) filter (where i = round_even((n_rows - 1) * 0.8, 0)) as t0 from sp0 group by 1)",
    """blk2 as (select e3.min_n, e3.y, e3.late_rate_30d,
               case when as_of_date >= t0 then 'test' when as_of_date < t0 - interval 30 day then 'train' end as block
               from e3 join tst using (min_n))""",
    "md2 as (select min_n, median(late_rate_30d) filter (where block = 'train') as med from blk2 group by 1)",
    "te as (select b.min_n, b.y, coalesce(b.late_rate_30d, m.med) as s from blk2 b join md2 m using (min_n) where block = 'test')",
    "ok as (select min_n, count(*) as test_rows from te group by 1 having count(*) >= 500 and count(distinct y) = 2)",
    """ar2 as (select te.min_n, y, rank() over (partition by te.min_n order by s) + (count(*) over (partition by te.min_n, s) - 1) / 2.0 as ar
               from te join ok using (min_n))""",
    """select a.min_n, c.n_rows, o.test_rows,
              round((sum(ar) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0)
                    / (count(*) filter (where y = 1) * count(*) filter (where y = 0)), 6) as persistence_auc
       from ar2 a join cnt c using (min_n) join ok o using (min_n) group by a.min_n, c.n_rows, o.test_rows""")
reg("w18_sequence_windows", *FT_ALL,
    """sq as (select order_id, seller_id, as_of_date,
              coalesce(cast(handover_share as double), 0) + 2 * coalesce(cast(freight_ratio as double), 0)
              + 3 * coalesce(cast(same_state as double), 0) + 4 * coalesce(cast(purchase_is_weekend as double), 0)
              + 5 * coalesce(cast(log_weight as double), 0) as v,
              row_number() over (partition by seller_id order by as_of_date, order_id) as rn from ft)""",
    """sq2 as (select *, sum(v) over w as s1, sum(rn * v) over w as s2, count(*) over w as c
               from sq window w as (partition by seller_id order by rn rows between 30 preceding and 1 preceding))""",
    """select order_id, seller_id, c as n_real,
              round(coalesce(31 * s1 - (rn * s1 - s2), 0) / 1e4, 6) as checksum from sq2""")
T02_DOCS = """pdoc as (select 'prediction_' || r.seller_id as id,
              'Seller ' || r.seller_id || ' in zip ' || s.seller_zip || ', state ' || s.seller_state
              || ', has a current delivery-risk score of ' || printf('%.2f', r.risk_score) || ' (' || r.risk_band
              || ' risk). Model used: promise-formula. Key contributing factors: ' || coalesce(dr.ft, '') || '.' as text,
              cast(r.seller_id as varchar) as seller_id, 'prediction' as source
       from roll r left join v_sellers s on s.seller_id = r.seller_id left join dr on dr.seller_id = r.seller_id)"""
T03_DOCS = """rdoc as (select 'review_' || i || '_' || seller_id as id,
              'Customer review for seller ' || seller_id || ' (state ' || seller_state || ') on ' || strftime(created, '%Y-%m-%d')
              || ': ' || review_score || '/5 stars (' || case when review_score <= 2 then 'negative' when review_score >= 4 then 'positive' else 'neutral' end
              || '). Comment: ' || substring(comment, 1, 300) as text,
              cast(seller_id as varchar) as seller_id, 'customer_review' as source from rk)"""
reg("t04_index_build", *ROLL_ALL, ATTR,
    """dr as (select seller_id, string_agg(feature || ' (' || case when contribution > 0 then 'raises' else 'lowers' end
                  || ' risk, impact ' || printf('%.2f', abs(round(contribution, 6))) || ')', '; ' order by k) as ft
             from tops where k <= 5 group by 1)""", T02_DOCS,
    """rj as (select oi.seller_id, s.seller_state, r.review_score, r.comment, r.created, r.order_id
             from v_reviews r join v_order_items oi on oi.order_id = r.order_id join v_sellers s on s.seller_id = oi.seller_id
             where r.comment is not null and r.comment <> ''
             order by r.created desc, r.order_id, oi.seller_id limit 2000)""",
    "rk as (select *, row_number() over (order by created desc, order_id, seller_id) - 1 as i from rj)", T03_DOCS,
    "alld as (select * from pdoc union all select * from rdoc)",
    _chunks("alld", "id", 512, 50).replace("select id, text, length(text) as n from alld",
                                          "select id, text, length(text) as n, seller_id, source from alld")
    .replace("select id, case when n <= 512 then [0] else range(0, n, 462) end as starts, text from ch",
             "select id, case when n <= 512 then [0] else range(0, n, 462) end as starts, text, seller_id, source from ch")
    .replace("select id, unnest(starts) as st, generate_subscripts(starts, 1) - 1 as chunk_idx, text from chs",
             "select id, unnest(starts) as st, generate_subscripts(starts, 1) - 1 as chunk_idx, text, seller_id, source from chs"),
    """select id || '_chunk' || chunk_idx as chunk_id,
              case when length(text) <= 512 then text else substring(text, st + 1, 512) end as text, seller_id, source from chx""")
reg("t06_text_retrieval", _chunks("documents", "doc_id", 512, 50),
    """ck as (select doc_id || '_chunk' || chunk_idx as chunk_id,
              case when length(text) <= 512 then text else substring(text, st + 1, 512) end as text from chx)""",
    r"""ctk as (select chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from ck),
ctc as (select chunk_id, term, count(*) as tf from ctk group by 1, 2),
cnd as (select count(*) as n from ck),
cst as (select term, count(*) as df, sum(tf) as ttf from ctc group by 1),
cvoc as (select term, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from cst, cnd
         where df >= 2 and df <= 0.6 * n order by ttf desc, term limit 4096),
cw0 as (select chunk_id, term, tf * idf as w from ctc join cvoc using (term)),
cw as (select chunk_id, term, w / sqrt(sum(w * w) over (partition by chunk_id)) as wd from cw0),
qtk as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from benchmark),
qtc as (select query_id, term, count(*) as tf from qtk group by 1, 2),
qw0 as (select query_id, term, tf * idf as w from qtc join cvoc using (term)),
qw as (select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as wq from qw0)""",
    """dots as (select query_id, chunk_id, round(2.0 - 2.0 * sum(wq * wd), 9) as distance from qw join cw using (term) group by 1, 2),
rk2 as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from dots)""",
    sel(["query_id", "chunk_id", r("distance"), "rank"], "from rk2 where rank <= 4"))
reg("x09_summary_kpis", *ROLL_ALL, SC, MODELS, RUNS,
    """h as (select least(cast(floor(risk_score * 20) as integer), 19) as bin, count(*) as c
          from roll where risk_score between 0 and 1 group by 1)""",
    """select count(*) as total, round(avg(risk_score), 6) as avg_risk,
              count(*) filter (where risk_band = 'low') as n_low, count(*) filter (where risk_band = 'medium') as n_medium,
              count(*) filter (where risk_band = 'high') as n_high, count(*) filter (where risk_band = 'critical') as n_critical,
              (select count(*) from h) as hist_nonempty_bins, (select sum(c) from h) as hist_total,
              (select count(distinct s.seller_state) from roll r2 join v_sellers s using (seller_id)) as n_states,
              (select model from runs where version = 1) as best_model,
              (select pr_auc from runs where version = 1) as best_pr_auc
       from roll""")
reg("x10_metrics_listing", SC, MODELS, RUNS,
    """select m.model, m.pr_auc, m.roc_auc, m.ks_statistic, case when r.version = 1 then 1 else 0 end as is_best
       from mrank m join runs r using (model)""")
reg("x02_winner_resolution", SC, MODELS, RUNS,
    """select model as winner, case when model = 'lstm' then 'boosted_trees' else model end as scorer,
              case when model in ('ensemble', 'lstm') then 'boosted_trees' else model end as explainer
       from runs where version = 1""")
reg("l06_label_screen", *PANEL_ALL, FWDP, P0,
    """el as (select seller_id, as_of_date, forward_rate, forward_orders, date_trunc('month', as_of_date) as month,
              row_number() over (partition by date_trunc('month', as_of_date) order by forward_orders, seller_id, as_of_date) as rk,
              count(*) over (partition by date_trunc('month', as_of_date)) as n
              from fp2 where forward_orders >= 5)""".replace("el as", "el0 as"),
    "eb0 as (select *, cast(greatest(ceil((rk - 1) * 10.0 / greatest(n - 1, 1)), 1) - 1 as integer) as vol_bin from el0)",
    """ep0 as (select *, case when forward_rate is null then null else
              (rank() over (partition by month, vol_bin order by forward_rate)
               + (count(*) over (partition by month, vol_bin, forward_rate) - 1) / 2.0)
              / count(forward_rate) over (partition by month, vol_bin) end as pct from eb0)""",
    """cands as (
  select 'any_late' as candidate, seller_id, as_of_date,
         case when forward_orders is null or forward_orders < 1 then null when forward_late >= 1 then 1 else 0 end as y from fp2
  union all select 'rate_15', seller_id, as_of_date,
         case when forward_orders < 5 or forward_rate is null then null when forward_rate >= 0.15 then 1 else 0 end from fp2
  union all select 'shrunk_15', seller_id, as_of_date,
         case when forward_orders is null or forward_orders < 5 then null
              when (forward_late + p0 * 20.0) / (forward_orders + p0 * 20.0 + (1 - p0) * 20.0) >= 0.15 then 1 else 0 end from fp2, p0
  union all select 'zscore_1', seller_id, as_of_date,
         case when forward_orders is null or forward_orders < 5 then null
              when (forward_late - forward_orders * p0) / sqrt(forward_orders * p0 * (1 - p0)) >= 1.0 then 1 else 0 end from fp2, p0
  union all select 'stratified_20', f.seller_id, f.as_of_date,
         case when ep.forward_rate is null then null when ep.pct >= 0.8 then 1 else 0 end
  from fp2 f left join ep on ep.seller_id = f.seller_id and ep.as_of_date = f.as_of_date)""".replace(
        "from fp2 f left join ep", "from fp2 f left join ep0 ep"),
    "tot as (select count(*) as total from panel)",
    "lab as (select * from cands where y is not null)",
    "cn as (select candidate, count(*) as n_labelled from lab group by 1 having count(*) >= 5000)",
    "sp1 as (select lab.*, cn.n_labelled, row_number() over (partition by lab.candidate order by as_of_date) - 1 as i from lab join cn using (candidate))",
    "t0 as (select candidate, max(as_of_date) filter (where i = round_even((n_labelled - 1) * 0.8, 0)) as t0 from sp1 group by 1)",
    """bk as (select s.candidate, s.y, s.n_labelled, case when as_of_date >= t0 then 'test'
               when as_of_date < t0 - interval 30 day then 'train' end as block from sp1 s join t0 using (candidate))""",
    """select candidate, max(n_labelled) as n_labelled, round(max(n_labelled) * 100.0 / max(total), 6) as labelled_pct,
              round(avg(case when block = 'train' then cast(y as double) end), 6) as train_base,
              round(avg(case when block = 'test' then cast(y as double) end), 6) as test_base,
              count(*) filter (where block = 'test') as test_rows
       from bk, tot group by candidate
       having count(*) filter (where block = 'test') >= 1000 and count(distinct case when block = 'test' then y end) = 2""")
reg("d02_population_stability", *FT_ALL, REFCUR,
    """lv2 as (unpivot (select "window", """ + ", ".join(f"cast({c} as double) as {c}" for c in NUMC) + """ from rc)
          on """ + ", ".join(NUMC) + """ into name feature value value)""",
    "lvn as (select * from lv2 where value is not null)",
    "edg as (select feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from lvn where \"window\" = 'reference' group by 1)",
    "bnd as (select l.feature, l.\"window\", len(list_filter(e.edges, lambda x: x < l.value)) as bin from lvn l join edg e using (feature))",
    """cnt2 as (select feature, bin, count(*) filter (where "window" = 'reference') as nr,
               count(*) filter (where "window" = 'current') as nc from bnd group by 1, 2)""",
    "grd as (select feature, unnest(range(0, 10)) as bin from edg)",
    """pp as (select g.feature, g.bin, coalesce(c.nr, 0) as nr, coalesce(c.nc, 0) as nc from grd g left join cnt2 c using (feature, bin))""",
    """pp2 as (select feature, greatest(nr * 1.0 / sum(nr) over (partition by feature), 1e-4) as pr,
               greatest(nc * 1.0 / sum(nc) over (partition by feature), 1e-4) as pc from pp)""",
    "select feature, round(sum((pc - pr) * ln(pc / pr)), 6) as psi from pp2 group by 1")


# ---------------------------------------------------------------- stored results, refusals, full serving results
reg("m08_smote_counts", *FT_ALL, SPLITPTS, BLOCK,
    "tw as (select is_late_delivery as label, count(*) as c from blk where block = 'train' group by 1)",
    "select label, (select max(c) from tw) as n_rows, (select max(c) from tw) - c as n_synthetic from tw")
reg("s20_artifact_roundtrip", *FT_ALL, SPLITPTS, BLOCK,
    "select count(*) as n_rows, 0 as n_different from blk where block = 'test'")
reg("s12_load_tables", "select table_name, n_rows, 2 as n_versions from (" + " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows from {v}" for t, v in (
        ("sellers", "v_sellers"), ("customers", "v_customers"), ("products", "v_products"), ("orders", "v_orders"),
        ("order_items", "v_order_items"), ("reviews", "v_reviews"), ("external_signals", "v_signals"))) + ")")
reg("s01_seller_csv_scan", "select seller_id, seller_zip, seller_state from v_sellers")
reg("s09_table_store_steps", SC, "no as (select count(*) as n from v_orders)",
    "ns as (select count(*) as n from v_signals)",
    "th0 as (select count(distinct t) as n from (select unnest(quantile_cont(score, [" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "])) as t from sc0))",
    """select 'S16 create all' as step, 8 as n_rows union all select 'S09 replace then append', 2 * n from no
       union all select 'S07 limit', 10 union all select 'S08 select', n from no union all select 'S13 snapshot', 2 * n from no
       union all select 'S06 files present', 1 union all select 'S11 csv to table', n from ns
       union all select 'S19 cost curve', n from th0 union all select 'S10 truncate', 0""")
reg("s14_feature_store", *FT_ALL,
    "fm as (select strftime(as_of_date, '%Y-%m') as month, count(*) as n_rows, sum(promised_days) as p from ft group by 1)",
    sel(["month", "n_rows", r("p", "promised_days"), "case when month = (select max(month) from fm) then 1 else 0 end as rewritten"], "from fm"))
reg("p02_category_translation",
    """select product_id, case when category is not null and right(category, 1) <> '3' then 'group_' || lower(replace(category, '#', '_'))
              else category end as category from v_products""")
reg("p17_fix_types", "select o_orderkey, case when o_orderkey % 7 = 0 then null else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as day, "
    "cast(o_custkey as varchar) as customer from orders")
reg("s18_news_payloads",
    "dn as (select *, cast(floor(doc_id / 20) as bigint) as payload_id, row_number() over (partition by cast(floor(doc_id / 20) as bigint) order by doc_id) - 1 as place from documents)",
    """select payload_id, cast(place as integer) as place, source || ' ' || lang as title, sha256(text) as description_sha,
              strftime(date '2024-01-01' + cast(doc_id % 365 as integer), '%Y-%m-%d') as published_at, source, 0 as bad
       from dn where payload_id % 17 <> 3
       union all select distinct payload_id, null, null, null, null, null, 1 from dn where payload_id % 17 = 3""")
reg("s18_weather_payloads",
    """select event_id as payload_id, case when event_id % 19 <> 4 and event_id % 11 <> 0 then event_type end as condition,
              case when event_id % 19 <> 4 and event_id % 13 <> 0 then round(value, 6) end as wind_speed,
              strftime(ts, '%Y-%m-%d') as fetched_at, case when event_id % 19 = 4 then 1 else 0 end as bad from events""")
reg("s18_raw_observations", sel(["strftime(d, '%Y-%m-%d') as date", r("value")], "from v_prices"))
reg("j11_realign_strict", *FT_ALL,
    sel(["ft.order_id", "ft.seller_id", r("promised_days"), r("s.score", "score")],
        "from ft join v_scores s on s.order_id = ft.order_id and s.seller_id = ft.seller_id"))
_E11 = ORACLES["e11_model_comparison"]
_AT = _E11.rindex("\nselect") + 1
_E11_CTES, _E11_LAST = _E11[:_AT].rstrip(), _E11[_AT:]
_LIFT = f"""{_E11_CTES},
full11 as ({_E11_LAST}),
lift11 as (select model, sum(pos / p * (cum_pos / cum_n)) / (max(p) * 1.0 / max(nt)) as pr_auc_lift from mc group by 1)
"""
ORACLES["e11_comparison_strict"] = _LIFT + "select full11.*, round(pr_auc_lift, 6) as pr_auc_lift from full11 join lift11 using (model)"
ORACLES["x10_metrics_full"] = _LIFT + """select full11.*, round(pr_auc_lift, 6) as pr_auc_lift,
  (select model from mrank order by pr_auc desc, model desc limit 1) as best_model from full11 join lift11 using (model)"""
_A17 = [*NUMERIC_FT, "is_late_delivery"]
reg("a17_correlation_matrix", *FT_ALL,
    "cx as (select " + ", ".join(
        f"{{'n': regr_count(cast({a} as double), cast({b} as double)), 'r': corr(cast({a} as double), cast({b} as double))}} as c{i}_{j}"
        for i, a in enumerate(_A17) for j, b in enumerate(_A17)) + " from ft)",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, c{i}_{j}.n as n, case when isfinite(c{i}_{j}.r) then round(c{i}_{j}.r, 6) end as r from cx"
        for i, a in enumerate(_A17) for j, b in enumerate(_A17)))
reg("e14_isotonic_blocks", SC,
    "g14 as (select round(score, 4) as s, count(*) as n, sum(y) as p from sc0 group by 1)",
    "c14 as (select s, n, p, row_number() over (order by s) as i, sum(n) over (order by s) as cn, sum(p) over (order by s) as cp from g14)",
    "m14 as (select a.i as a, b.i as b, (b.cp - a.cp + a.p) * 1.0 / (b.cn - a.cn + a.n) as m from c14 a join c14 b on b.i >= a.i)",
    "lo14 as (select a, b as i, min(m) over (partition by a order by b desc) as v from m14)",
    "select s as score, n, round(max(v), 6) as calibrated from lo14 join c14 using (i) group by s, n")
reg("e16_reliability_curves", SC,
    "cc0 as (select *, score * score as cal from sc0)",
    """cbin as (select *, cast(greatest(ceil((row_number() over (order by score, id) - 1) * 10.0 / greatest(count(*) over () - 1, 1)), 1) - 1 as integer) as b1,
                    cast(greatest(ceil((row_number() over (order by cal, id) - 1) * 10.0 / greatest(count(*) over () - 1, 1)), 1) - 1 as integer) as b2 from cc0)""",
    """select 'raw' as curve, b1 as bin, round(avg(score), 6) as mean_predicted, round(avg(cast(y as double)), 6) as observed_rate, count(*) as n from cbin group by b1
       union all select 'calibrated', b2, round(avg(cal), 6), round(avg(cast(y as double)), 6), count(*) from cbin group by b2""")
reg("x01_published_predictions", *ROLL_ALL, ATTR,
    sel(["roll.seller_id", r("roll.raw", "raw"), r("roll.risk_score", "risk_score"), "n_orders", "risk_band", "'promise-formula' as model_name",
         "strftime((select m from mx), '%Y-%m-%d %H:%M:%S') as predicted_at", "cast(k as integer) as rank", "feature", r("contribution")],
        "from roll join tops on tops.seller_id = roll.seller_id where k <= 5"))
reg("x07_explanation_drivers", *ROLL_ALL, ATTR,
    sel(["roll.seller_id", r("roll.risk_score", "risk_score"), "risk_band", "cast(k as integer) as rank", "feature", r("contribution")],
        """from roll join tops on tops.seller_id = roll.seller_id
           where k <= 5 and (roll.seller_id = (select min(seller_id) from roll) or roll.seller_id = (select max(seller_id) from roll))"""))
reg("x09_summary_full", *ROLL_ALL, STATE,
    """h9 as (select least(cast(floor(risk_score * 20) as integer), 19) as bin, count(*) as c from roll where risk_score between 0 and 1 group by 1)""",
    """select 'total' as section, 'all' as key, cast(count(*) as double) as value, round(avg(risk_score), 6) as extra from roll
       union all select 'band', risk_band, count(*), null from roll group by risk_band
       union all select 'histogram', cast(b as varchar), coalesce(c, 0), null from (select unnest(range(20)) as b) left join h9 on h9.bin = b
       union all select 'state', state, count, round(avg_risk, 6) from st
       union all select 'state_critical', state, critical_count, null from st""")
reg("s21_run_log_versions", SC,
    """lg as (select 'run-1' as run_id, * from sc0 where order_id % 2 = 0 union all select 'run-2', * from sc0)""",
    """lm as (select run_id, 'promise' as model, y, score from lg union all select run_id, 'hashed', y, ((order_id * 7919 + seller_id * 31) % 1000) / 1e3 from lg
       union all select run_id, 'inverse', y, 1.0 - score from lg)""",
    "lgp as (select run_id, model, score, count(*) as n, sum(y) as pos from lm group by all)",
    """lc as (select *, sum(n) over (partition by run_id, model order by score desc) as cum_n, sum(pos) over (partition by run_id, model order by score desc) as cum_pos,
        sum(n) over (partition by run_id, model) as nt, sum(pos) over (partition by run_id, model) as p from lgp)""",
    """lr as (select run_id, model, sum(pos / p * (cum_pos / cum_n)) as pr_auc, sum((n - pos) * (cum_pos - pos / 2.0)) / (max(p) * max(nt - p)) as roc_auc from lc group by all)""",
    "lb as (select *, row_number() over (partition by run_id order by pr_auc desc, model desc) as k from lr)",
    """select run_id, model, round(pr_auc, 6) as pr_auc, round(roc_auc, 6) as roc_auc,
              case when k = 1 then cast(right(run_id, 1) as integer) end as version,
              case when k = 1 and run_id = 'run-2' then 'Production' when k = 1 then 'Archived' end as stage from lb""")
_T04 = ORACLES["t04_index_build"]
_T04_AT = _T04.rindex("select id || '_chunk'")
ORACLES["t04_vector_index"] = _T04[:_T04_AT].rstrip() + """,
ck4 as (""" + _T04[_T04_AT:] + r"""),
tk4 as (select chunk_id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from ck4),
tc4 as (select chunk_id, source, term, count(*) as tf from tk4 group by all),
nd4 as (select count(*) as n from ck4 where source = 'prediction'),
ts4 as (select term, count(*) as df, sum(tf) as ttf from tc4 where source = 'prediction' group by 1),
vc4 as (select term, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from ts4, nd4 where df >= 2 and df <= 0.6 * n order by ttf desc, term limit 4096),
tw4 as (select chunk_id, count(*) as n_terms, sum(tf * idf) / sqrt(sum(tf * idf * tf * idf)) as weight_sum from tc4 join vc4 using (term) group by 1)
select ck4.chunk_id, ck4.text, ck4.seller_id, ck4.source, case when ck4.source = 'prediction' then roll.risk_band end as risk_band,
       coalesce(n_terms, 0) as n_terms, round(coalesce(weight_sum, 0), 6) as weight_sum
from ck4 left join tw4 using (chunk_id) left join roll on cast(roll.seller_id as varchar) = ck4.seller_id"""
reg("t08_grounded_prompts",
    "ex0 as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)",
    "cen as (select label as query_id, list(a order by i) as qv from (select label, i, avg(v) as a from ex0 group by 1, 2) group by 1)",
    NN.format(w=""),
    """ctx as (select query_id, count(*) as n_sources, string_agg('- ' || d.text, chr(10) || chr(10) order by rank) as context
              from nn join documents d on d.doc_id = nn.vec_id where rank <= 4 and query_id <> 3 group by 1)""",
    """select c.query_id, coalesce(n_sources, 0) as n_sources, case when context is null then 0 else 1 end as grounded,
              case when context is null then 'No relevant information found in the knowledge base for this question.'
                   else 'Answer the question about supplier risk from the context below only. If the context does not answer it, say so.'
                        || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10)
                        || 'Question: What is known about group ' || c.query_id || '?' end as prompt
       from cen c left join ctx using (query_id)""")
reg("x04_additivity_check", *FT_ALL, SPLITPTS, BLOCK,
    "bx as (select * from blk where block is not null)",
    """select count(*) as n_rows, 0 as n_violations, 0.0 as max_abs_gap from bx
       where as_of_date >= (select max(as_of_date) from bx) - interval 90 day""")
