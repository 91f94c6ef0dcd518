"""Queries: seller-day panel, windows, forward labels, label studies, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.operators import labels as lb
from slipway.operators import panel as pn
from slipway.operators import signals as sg
from slipway.plans.queries import dom, register, report
from slipway.plans.stored import stored_day_orders, stored_features
from slipway.session import cut_lineage

WS = [7, 14, 30]


def _panel(d):
    return pn.seller_day_panel(stored_day_orders(d), 10)


def _hist(d):
    return pn.delivery_history(_panel(d), WS)


def _fwd(d):
    return lb.attach_forward(_panel(d))


@register("w01_seller_day_panel")
def w01(spark, sf):
    return report(_panel(dom(spark, sf)))


@register("w01_empty_panel")
def w01e(spark, sf):
    d = dom(spark, sf)
    none = d.orders.filter(F.lit(False))
    return report(pn.seller_day_panel(pn.seller_day_orders(none, d.order_items), 1))


@register("w02_trailing_delivery_counts")
def w02(spark, sf):
    h = _hist(dom(spark, sf))
    cols = [f"{k}_{w}d" for w in WS for k in ("late_count", "order_count", "late_rate")]
    return report(h.select("seller_id", "as_of_date", *cols))


@register("w03_late_rate_trend")
def w03(spark, sf):
    return report(_hist(dom(spark, sf)).select("seller_id", "as_of_date", "late_rate_trend"))


@register("w04_days_since_last_late")
def w04(spark, sf):
    return report(_hist(dom(spark, sf)).select("seller_id", "as_of_date", "days_since_last_late"))


@register("w05_review_windows")
def w05(spark, sf):
    d = dom(spark, sf)
    day_orders = stored_day_orders(d)
    p = pn.review_features(pn.seller_day_panel(day_orders, 10, pn.seller_day_reviews(d.reviews, d.order_items)), None, WS)
    return report(p.select("seller_id", "as_of_date", *[f"{k}_{w}d" for w in WS for k in ("review_score_avg", "bad_reviews")]))


@register("w06_signal_windows")
def w06(spark, sf):
    d = dom(spark, sf)
    p = pn.signal_features(_panel(d), d.sellers, pn.signals_wide(d.signals), WS)
    return report(p.select("seller_id", "as_of_date", "seller_state",
                           *[f"{n}_{w}d" for n in pn.SIGNAL_NAMES.values() for w in WS]))


@register("w07_w09_profile_features")
def w07(spark, sf):
    d = dom(spark, sf)
    p = pn.signal_features(_hist(d), d.sellers, pn.signals_wide(d.signals), [7])
    p = pn.profile_features(p)
    return report(p.select("seller_id", "as_of_date", "lifetime_late_rate", "state_peer_late_rate",
                           "seller_tenure_days"))


@register("w10_forward_sums")
def w10(spark, sf):
    f = _fwd(dom(spark, sf))
    return report(f.select("seller_id", "as_of_date", "forward_late", "forward_orders", "forward_rate"))


@register("w11_offset_window_sum")
def w11(spark, sf):
    return report(lb.split_halves(_panel(dom(spark, sf))))


@register("w12_forward_label")
def w12(spark, sf):
    p = pn.attach_label(_panel(dom(spark, sf)), 30, 0.15, 5)
    return report(p.select("seller_id", "as_of_date", "forward_orders", "late_rate_next_30d", pn.TARGET))


@register("l09_seller_day_feature_table")
def l09(spark, sf):
    return report(pn.seller_day_feature_table(dom(spark, sf)))


@register("l01_any_late_label")
def l01(spark, sf):
    return report(lb.any_late(_fwd(dom(spark, sf))).select("seller_id", "as_of_date", "y"))


@register("l02_rate_label")
def l02(spark, sf):
    return report(lb.rate_label(_fwd(dom(spark, sf)), 0.25, 5).select("seller_id", "as_of_date", "y"))


@register("l03_shrunk_label")
def l03(spark, sf):
    f = _fwd(dom(spark, sf))
    p0 = lb.base_rate(f)
    return report(lb.shrunk_label(f, 0.25, 20.0, 5, p0).select("seller_id", "as_of_date", "shrunk", "y"))


@register("l04_zscore_label")
def l04(spark, sf):
    f = _fwd(dom(spark, sf))
    p0 = lb.base_rate(f)
    return report(lb.zscore_label(f, 1.0, 5, p0).select("seller_id", "as_of_date", "excess", "y"))


@register("l05_stratified_label")
def l05(spark, sf):
    f = cut_lineage(_fwd(dom(spark, sf)))
    return report(lb.stratified_label(f, 0.2, 5).select("seller_id", "as_of_date", "vol_bin", "pct", "y"))


@register("l07_split_half_reliability")
def l07(spark, sf):
    return report(lb.split_half_reliability(_panel(dom(spark, sf)), 5, 500))


@register("w15_price_volatility")
def w15(spark, sf):
    d = dom(spark, sf)
    return report(sg.daily_volatility(d.prices, d.days))


@register("w16_fill_prices")
def w16(spark, sf):
    d = dom(spark, sf)
    g = d.days.select(F.col("d").alias("signal_date")).join(
        d.prices.select(F.col("d").alias("signal_date"), "value"), "signal_date", "left")
    return report(sg.fill_forward_back(g, "signal_date", "value"))


@register("j10_replicate_series")
def j10(spark, sf):
    d = dom(spark, sf)
    vol = sg.daily_volatility(d.prices, d.days)
    return report(sg.replicate_to_states(vol, d.sellers))


@register("s18_event_props")
def s18(spark, sf):
    return report(sg.parse_props(dom(spark, sf).t("events")))


@register("a17_label_correlations")
def a17(spark, sf):
    """Pearson correlation of every numeric order feature with the label."""
    from slipway.operators.eda import label_correlations
    return report(label_correlations(stored_features(dom(spark, sf)).drop("_rid"), "is_late_delivery"))


@register("a19_grouped_describe")
def a19(spark, sf):
    from slipway.operators.eda import grouped_describe
    return report(grouped_describe(stored_features(dom(spark, sf)).drop("_rid"), "is_late_delivery", "promised_days"))


@register("a20_missing_share")
def a20(spark, sf):
    from slipway.operators.eda import missing_share
    return report(missing_share(stored_features(dom(spark, sf)).drop("_rid")))


@register("s17_series_payload_parse")
def s17(spark, sf):
    """Daily price series landed as monthly JSON payloads ('.' = missing),
    parsed back to (date, value) with the gaps dropped."""
    from slipway.sources.io import landed_series_payloads
    d = dom(spark, sf)
    grid = d.days.join(d.prices, "d", "left")
    return report(sg.parse_series_payload(landed_series_payloads(grid, "d", "value")))


@register("p03_safe_coercion")
def p03(spark, sf):
    """Text fields coerced to typed columns; unparsable values become NULL."""
    e = dom(spark, sf).t("events")
    s = e.select("event_id", F.col("ts").cast("string").alias("ts_s"), F.col("value").cast("string").alias("v_s"),
                 F.get_json_object("props", "$.k").alias("k_s"), F.col("event_type").alias("t_s"))
    return report(s.select("event_id", F.try_to_timestamp("ts_s").alias("ts"), F.col("v_s").try_cast("double").alias("value"),
                           F.col("k_s").try_cast("long").alias("k"), F.col("t_s").try_cast("double").alias("type_as_number")))


@register("l08_persistence_auc")
def l08(spark, sf):
    d = dom(spark, sf)
    p = lb.attach_forward(pn.delivery_history(_panel(d), WS))  # windows of columns that are not kept are not computed
    return report(lb.persistence_auc(cut_lineage(p.select("seller_id", "as_of_date", "forward_orders", "forward_rate", "late_rate_30d"))))


# small-magnitude features keep the fingerprint well inside double precision
SEQ_FEATURES = ["handover_share", "freight_ratio", "same_state", "purchase_is_weekend", "log_weight"]


@register("w18_sequence_windows")
def w18(spark, sf):
    from slipway.operators.sequences import sequence_checksum, sequence_windows
    f = stored_features(dom(spark, sf)).drop("_rid")
    s = sequence_windows(f, SEQ_FEATURES, block=256)
    return report(s.select("order_id", "seller_id", F.col("n_real").cast("long").alias("n_real"),
                           (sequence_checksum() / F.lit(1e4)).alias("checksum")))


@register("l06_label_screen")
def l06(spark, sf):
    d = dom(spark, sf)
    f = cut_lineage(_fwd(d))
    p0 = lb.base_rate(f)
    cands = {"any_late": lb.any_late(f), "rate_15": lb.rate_label(f, 0.15, 5),
             "shrunk_15": lb.shrunk_label(f, 0.15, 20.0, 5, p0), "zscore_1": lb.zscore_label(f, 1.0, 5, p0),
             "stratified_20": lb.stratified_label(f, 0.2, 5)}
    return report(lb.label_screen(f, cands))
