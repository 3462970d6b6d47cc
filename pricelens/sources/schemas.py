"""Explicit schemas for every table (no schema inference anywhere)."""

from pyspark.sql import types as T

S, D, L, I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CATALOGUE_PRICES = _struct(("item_code", S), ("ie_trade", D), ("ie_high", D), ("ie_mid", D),
                           ("ie_low", D), ("ie_base", D), ("ie_edm", D), ("ie_anew", D))
LANDED_COSTS = _struct(("item_code", S), ("landed_cost_euro", D), ("plus_5_percent", D))
SALES_RAW = _struct(("customer_code", S), ("customer_name", S), ("region", S),
                    ("invoice_number", S), ("document_type", S), ("invoice_date", S),
                    ("item_code", S), ("item_description", S), ("quantity", D),
                    ("currency", S), ("unit_price", D), ("line_total", D))
SALES = _struct(("invoice_number", S), ("invoice_date", S), ("customer_code", S),
                ("customer_name", S), ("item_code", S), ("item_description", S),
                ("quantity", D), ("currency", S), ("unit_price", D), ("line_total", D),
                ("document_type", S), ("is_rebate", I), ("is_return", I), ("is_sample", I),
                ("unit_type", S), ("data_quality_issue", S))
CUSTOMER_PRODUCT_KEYS = _struct(("customer_code", S), ("customer_name", S), ("buying_group", S),
                                ("region", S), ("account_manager", S))
PALLET_SIZES = _struct(("item_code", S), ("pallet_quantity", L), ("carton_quantity", L),
                       ("single_quantity", L))

# Source-file headers mapped to table columns (fixed values: the files' own headers).
CATALOGUE_HEADERS = {"ITEM CODE": "item_code", "IE Trade": "ie_trade", "IE High": "ie_high",
                     "IE Mid": "ie_mid", "IE Low": "ie_low", "IE Base": "ie_base",
                     "IE EDM": "ie_edm", "IE ANEW": "ie_anew"}
LANDED_COST_HEADERS = {"ITEM CODE": "item_code", "Landed cost Euro": "landed_cost_euro",
                       "Plus 5%": "plus_5_percent"}
SALES_HEADERS = {"Customer Code": "customer_code", "Customer Name": "customer_name",
                 "Region": "region", "Document Number": "invoice_number",
                 "Document Type": "document_type", "Document Date": "invoice_date",
                 "Item SKU": "item_code", "Item Description": "item_description",
                 "Item Quantity": "quantity", "Currency": "currency", "Price": "unit_price"}
CUSTOMER_HEADERS = {"Code": "customer_code", "Name": "customer_name",
                    "Buying Group": "buying_group", "Region": "region",
                    "Account Manager": "account_manager"}
PALLET_HEADERS = {"ITEM CODE": "item_code", "Pallet Quantity": "pallet_quantity",
                  "Carton Quantity ": "carton_quantity", "Single Quantity": "single_quantity"}
