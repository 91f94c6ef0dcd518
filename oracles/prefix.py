"""Shared CTE prefix: the domain views written as DuckDB SQL.

This is the SQL text of ``slipway/sources/views.py`` (FIXTURES.md §2). Every
oracle starts with it so both engines begin from identical rows.
"""

PREFIX = """with v_sellers as (select s_suppkey as seller_id, n_name as seller_state, (s_suppkey * 7919) % 100000 as seller_zip from supplier join nation on s_nationkey = n_nationkey),
v_customers as (select c_custkey as customer_id, n_name as customer_state, (c_custkey * 104729) % 100000 as customer_zip from customer join nation on c_nationkey = n_nationkey),
v_products as (select p_partkey as product_id, p_brand as category, case when p_partkey % 97 = 0 then null else p_size * 1e2 end as weight_g, p_size as length_cm, 1 + p_partkey % 40 as height_cm, 1 + p_partkey % 25 as width_cm from part),
o0 as (select o_orderkey, o_custkey, o_orderstatus, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) as purchase, o_orderdate + to_days(cast(case o_orderpriority when '1-URGENT' then 10 when '2-HIGH' then 20 when '3-MEDIUM' then 30 when '4-NOT SPECIFIED' then 45 else 60 end as int)) as estimated from orders),
o1 as (select *, case when o_orderstatus = 'P' then null else purchase + to_days(cast((o_orderkey * 31 + o_custkey * 17) % 28 as int)) end as delivered from o0),
v_orders as (select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as order_status, purchase, estimated, delivered, (epoch_us(delivered) - epoch_us(estimated)) / 86400e6 as delay_days, case when delivered is null then null when delivered > estimated then 1 else 0 end as is_late from o1),
v_order_items as (select l.l_orderkey as order_id, row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate) as order_item_id, l.l_partkey as product_id, l.l_suppkey as seller_id, o.purchase + to_days(cast(1 + l.l_linenumber % 7 as int)) as shipping_limit, l.l_extendedprice as price, l.l_extendedprice * l.l_tax as freight_value from lineitem l join o0 o on l.l_orderkey = o.o_orderkey),
v_reviews as (select o.order_id as review_id, o.order_id, 1 + (o.order_id * 13 + o.customer_id) % 5 as review_score, o.delivered + to_days(cast(1 as int)) as created, d.text as comment from v_orders o left join documents d on d.doc_id = o.order_id where o.delivered is not null),
span as (select cast(min(purchase) as date) as a, cast(max(purchase) as date) as b from v_orders),
days as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from span),
v_signals as (select n_name as seller_state, d as signal_date, source, ((n_nationkey * 37 + date_diff('day', date '1970-01-01', d) * k) % 1000) / 1e3 as value, case when k = 3 then 0 else 1 end as is_synthetic from nation cross join days cross join (select 'weather' as source, 7 as k union all select 'port', 11 union all select 'commodity', 3) s),
v_prices as (select d, value from (select cast(purchase as date) as d, avg(o_totalprice) as value from o0 join orders using (o_orderkey) group by 1) x where date_diff('day', date '1970-01-01', d) % 7 not in (2, 3)),
v_scores as (select order_id, seller_id, max(is_late) as y, max(1e0 / (1e0 + (epoch_us(estimated) - epoch_us(purchase)) / 86400e6)) as score from v_order_items join v_orders using (order_id) where is_late is not null group by order_id, seller_id)"""


def q(*ctes_and_final: str) -> str:
    """PREFIX + extra CTEs + final SELECT.

    q("x as (select ...)", "y as (...)", "select ... from y") ->
    "with <views>, x as (...), y as (...) select ... from y"
    """
    *ctes, final = ctes_and_final
    extra = "".join(",\n" + c.strip() for c in ctes)
    return PREFIX + extra + "\n" + final.strip()
