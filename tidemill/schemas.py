"""Record schemas. Field names are fixed values of the data model; money is decimal(16,2)."""

from __future__ import annotations

LOG = (
    "common struct<mid:string,vc:string,ch:string,ar:string,is_new:string>, "
    "page struct<page_id:string,last_page_id:string,item:string,during_time:bigint>, "
    "start map<string,string>, displays array<struct<item_type:string,item:string>>, ts bigint"
)
CHANGE = "`table` string, type string, data map<string,string>"
#: Changes with rows of any fields, their values as they came.
OPEN_CHANGE = "`table` string, type string, data map<string,variant>"
CONFIG = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string"
CONFIG_CHANGE = f"database string, `table` string, type string, data struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in CONFIG.split(', ')))}>"
DEBEZIUM = "op string, source struct<db:string,`table`:string>, after map<string,string>"
_MONEY = "decimal(16,2)"
ORDER_INFO = (
    f"id bigint, province_id bigint, order_status string, user_id bigint, total_amount {_MONEY}, activity_reduce_amount {_MONEY}, "
    f"coupon_reduce_amount {_MONEY}, original_total_amount {_MONEY}, feight_fee {_MONEY}, expire_time string, create_time string, "
    "operate_time string, create_date string, create_hour string"
)
ORDER_DETAIL = (
    f"id bigint, order_id bigint, sku_id bigint, order_price {_MONEY}, sku_num bigint, sku_name string, create_time string, "
    f"split_total_amount {_MONEY}, split_activity_amount {_MONEY}, split_coupon_amount {_MONEY}"
)
PAYMENT_INFO = f"id bigint, order_id bigint, user_id bigint, total_amount {_MONEY}, subject string, payment_type string, create_time string, callback_time string"
SKU_EVENT = f"sku_id bigint, order_id bigint, refund_amount {_MONEY}, appraise string, create_time string"

ORDER_WIDE = (
    "detail_id order_id sku_id order_price sku_num sku_name province_id order_status user_id total_amount activity_reduce_amount "
    "coupon_reduce_amount original_total_amount feight_fee split_feight_fee split_activity_amount split_coupon_amount split_total_amount "
    "expire_time create_time operate_time create_date create_hour province_name province_area_code province_iso_code province_3166_2_code "
    "user_age user_gender spu_id tm_id category3_id spu_name tm_name category3_name"
).split()
PAYMENT_WIDE = (
    "payment_id subject payment_type payment_create_time callback_time detail_id order_id sku_id order_price sku_num sku_name province_id "
    "order_status user_id total_amount activity_reduce_amount coupon_reduce_amount original_total_amount feight_fee split_feight_fee "
    "split_activity_amount split_coupon_amount split_total_amount order_create_time province_name province_area_code province_iso_code "
    "province_3166_2_code user_age user_gender spu_id tm_id category3_id spu_name tm_name category3_name"
).split()
VISITOR_STATS = "stt edt vc ch ar is_new uv_ct pv_ct sv_ct uj_ct dur_sum ts".split()
PRODUCT_STATS = (
    "stt edt sku_id sku_name sku_price spu_id spu_name tm_id tm_name category3_id category3_name display_ct click_ct favor_ct cart_ct "
    "order_sku_num order_amount order_ct payment_amount paid_order_ct refund_order_ct refund_amount comment_ct good_comment_ct ts"
).split()
PROVINCE_STATS = "stt edt province_id province_name area_code iso_code iso_3166_2 order_amount order_count ts".split()
KEYWORD_STATS = "keyword ct source stt edt ts".split()

#: Codes: a good comment, and the source of searched keywords.
APPRAISE_GOOD, KEYWORD_SEARCH = "1201", "SEARCH"
#: Sink kinds of the routing table.
TO_DIMENSION, TO_TOPIC = "hbase", "kafka"
