"""DuckDB SQL text shared by every oracle: the fixture adapter, the cleaning rules and
the enriched fact, written as CTEs over the driver's pre-registered views.

These strings are the independent side of the correctness check: they restate the
rules in plain SQL rather than calling any Spark code.
"""

ADAPTER_CTES = r"""
li AS (
  SELECT l.*, (l_orderkey + l_linenumber) % 40 AS b,
         floor(l_extendedprice * (1 - l_discount) / l_quantity * 100e0) / 100e0 AS px
  FROM lineitem l),
sales_raw AS (
  SELECT
    CASE WHEN b = 9 THEN NULL ELSE 'C' || CAST(o_custkey AS VARCHAR) END AS customer_code,
    CASE WHEN l_linenumber = 7 THEN upper(c_name) ELSE c_name END AS customer_name,
    r_name AS region,
    CAST(l_orderkey AS VARCHAR) AS invoice_number,
    CAST(NULL AS VARCHAR) AS document_type,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS invoice_date,
    CASE WHEN b = 10 THEN 'IEZ' || CAST(l_partkey AS VARCHAR) || ' ' ELSE 'IEZ' || CAST(l_partkey AS VARCHAR) END AS item_code,
    CASE WHEN b = 11 THEN NULL ELSE p_name END AS item_description,
    CASE WHEN b IN (0, 1, 2, 7) THEN -l_quantity WHEN b = 6 THEN l_quantity + 0.5e0
         WHEN b = 8 THEN NULL ELSE l_quantity END AS quantity,
    CASE WHEN r_name = 'EUROPE' THEN 'GBP' WHEN r_name = 'ASIA' THEN 'Eur' ELSE 'EUR' END AS currency,
    CASE WHEN b IN (3, 7) THEN -px WHEN b = 4 THEN 0e0 WHEN b = 5 THEN 0.05e0 ELSE px END AS unit_price
  FROM li
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey),
sales_raw2 AS (SELECT *, quantity * unit_price AS line_total FROM sales_raw),
part_copies AS (
  SELECT p.*, c.copy, p_partkey * 2 + c.copy AS load_key
  FROM part p JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c ON c.copy = 0 OR p_partkey % 20 = 1),
landed_costs_raw AS (
  SELECT load_key, 'IEZ' || CAST(p_partkey AS VARCHAR) AS item_code,
         CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE floor(p_retailprice * 120e0) / 100e0 END + copy * 0.05e0 AS landed_cost_euro
  FROM part_copies WHERE p_partkey % 15 <> 0),
landed_costs_raw2 AS (SELECT *, landed_cost_euro * 1.05e0 AS plus_5_percent FROM landed_costs_raw),
catalogue_raw AS (
  SELECT load_key, 'IEZ' || CAST(p_partkey AS VARCHAR) AS item_code,
    floor(p_retailprice * 300e0) / 100e0 + copy * 0.05e0 AS ie_trade,
    floor(p_retailprice * 280e0) / 100e0 + copy * 0.05e0 AS ie_high,
    floor(p_retailprice * 260e0) / 100e0 + copy * 0.05e0 AS ie_mid,
    floor(p_retailprice * 240e0) / 100e0 + copy * 0.05e0 AS ie_low,
    floor(p_retailprice * 220e0) / 100e0 + copy * 0.05e0 AS ie_base,
    floor(p_retailprice * 200e0) / 100e0 + copy * 0.05e0 AS ie_edm,
    floor(p_retailprice * 180e0) / 100e0 + copy * 0.05e0 AS ie_anew
  FROM part_copies WHERE p_partkey % 4 <> 0),
customer_product_keys AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customer_code, c_name AS customer_name,
         c_mktsegment AS buying_group, r_name AS region, 'AM' || CAST(c_nationkey AS VARCHAR) AS account_manager
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_custkey % 50 <> 0),
pallet_raw AS (
  SELECT 'IEZ' || CAST(p_partkey AS VARCHAR) AS item_code, CAST(40 AS BIGINT) AS pallet_quantity,
         CAST(10 AS BIGINT) AS carton_quantity, CAST(1 AS BIGINT) AS single_quantity
  FROM part WHERE p_partkey % 10 = 0
  UNION ALL SELECT '', NULL, NULL, NULL),
"""

CLEANING_CTES = r"""
conv AS (
  SELECT customer_code, customer_name, invoice_number, invoice_date, item_code, item_description,
         quantity AS raw_quantity, currency AS raw_currency,
         CASE WHEN line_total < 0 THEN 'CRN' ELSE 'INV' END AS document_type,
         CASE WHEN currency = 'GBP' THEN unit_price * 1.15e0 ELSE unit_price END AS unit_price,
         CASE WHEN currency = 'GBP' THEN line_total * 1.15e0 ELSE line_total END AS line_total,
         CASE WHEN currency IN ('GBP', 'Eur') THEN 'EUR' ELSE currency END AS currency
  FROM sales_raw2),
ruled AS (
  SELECT *,
    CASE WHEN document_type = 'CRN' AND (unit_price < 0 OR raw_quantity > 0) THEN 1 ELSE 0 END AS is_rebate,
    CASE WHEN document_type = 'CRN' AND raw_quantity < 0 THEN 1 ELSE 0 END AS is_return,
    CASE WHEN document_type = 'INV' AND raw_quantity >= 0 AND raw_quantity % 1 <> 0 THEN 'meter' END AS unit_type,
    CASE WHEN (document_type = 'INV' AND unit_price > 0 AND unit_price < 0.1e0)
           OR (unit_price = 0 AND raw_quantity > 0) THEN 1 ELSE 0 END AS is_sample,
    CASE WHEN document_type = 'INV' AND raw_quantity < 0
         THEN 'Negative quantity on invoice - converted to positive' END AS data_quality_issue,
    CASE WHEN document_type = 'INV' AND raw_quantity < 0 THEN abs(raw_quantity) ELSE raw_quantity END AS quantity
  FROM conv),
name_counts AS (
  SELECT customer_code, customer_name, count(*) AS cnt FROM sales_raw2
  WHERE customer_code IS NOT NULL GROUP BY customer_code, customer_name),
std_names AS (
  SELECT customer_code, customer_name AS standard_name FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_code ORDER BY cnt DESC, customer_name ASC NULLS LAST) AS rn
    FROM name_counts) WHERE rn = 1),
sales AS (
  SELECT r.invoice_number, r.invoice_date, r.customer_code, n.standard_name AS customer_name, r.item_code,
         r.item_description, r.quantity, r.currency, r.unit_price, r.line_total, r.document_type,
         r.is_rebate, r.is_return, r.is_sample, r.unit_type, r.data_quality_issue
  FROM ruled r LEFT JOIN std_names n ON r.customer_code = n.customer_code),
landed_costs AS (
  SELECT item_code, landed_cost_euro, plus_5_percent FROM (
    SELECT *, row_number() OVER (PARTITION BY item_code ORDER BY load_key) AS rn FROM landed_costs_raw2
    WHERE item_code IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT item_code, landed_cost_euro, plus_5_percent FROM landed_costs_raw2 WHERE item_code IS NULL),
catalogue_prices AS (
  SELECT item_code, ie_trade, ie_high, ie_mid, ie_low, ie_base, ie_edm, ie_anew FROM (
    SELECT *, row_number() OVER (PARTITION BY item_code ORDER BY load_key) AS rn FROM catalogue_raw
    WHERE item_code IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT item_code, ie_trade, ie_high, ie_mid, ie_low, ie_base, ie_edm, ie_anew FROM catalogue_raw
  WHERE item_code IS NULL),
pallet_sizes AS (SELECT * FROM pallet_raw WHERE item_code IS NOT NULL AND item_code <> ''),
fact AS (
  SELECT s.*, lc.landed_cost_euro, cp.ie_base, cp.ie_trade, cp.ie_high, cp.ie_mid, cp.ie_low, cp.ie_edm, cp.ie_anew,
    CASE WHEN cp.ie_base IS NOT NULL AND cp.ie_base > 0 AND s.quantity <> 0
         THEN ((s.quantity * cp.ie_base) - s.line_total) / (s.quantity * cp.ie_base) * 100
         ELSE 0e0 END AS discount_percent,
    s.quantity * coalesce(lc.landed_cost_euro, 0e0) AS line_cost
  FROM sales s LEFT JOIN landed_costs lc ON s.item_code = lc.item_code
  LEFT JOIN catalogue_prices cp ON s.item_code = cp.item_code)
"""


def with_base(body: str) -> str:
    """Prefix a query body (which may start with more ``name AS (...)`` CTEs followed by
    a final SELECT) with the shared CTEs."""
    return "WITH " + ADAPTER_CTES + CLEANING_CTES + body


# SQL spellings of the Spark helpers in pricelens.functions.metrics.
def msum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,6))) AS DOUBLE)"


def r2(x: str, scale: int = 2) -> str:
    return f"CAST(ROUND(CAST(COALESCE({x}, 0e0) AS DECIMAL(38,10)), {scale}) AS DOUBLE)"


def margin(rev: str, cost: str) -> str:
    return (f"CAST(ROUND(CAST(COALESCE({rev}, 0e0) AS DECIMAL(38,6)) - CAST(COALESCE({cost}, 0e0) AS DECIMAL(38,6)), 2)"
            " AS DOUBLE)")


def margin_pct(rev: str, cost: str) -> str:
    return (f"CASE WHEN COALESCE({rev}, 0e0) = 0 THEN 0e0 ELSE "
            + r2(f"(COALESCE({rev}, 0e0) - COALESCE({cost}, 0e0)) / COALESCE({rev}, 0e0) * 100") + " END")


def ratio0(num: str, den: str) -> str:
    return f"CASE WHEN COALESCE({den}, 0e0) = 0 THEN 0e0 ELSE COALESCE({num}, 0e0) / ({den}) END"


def avg2(total: str, count: str) -> str:
    return r2(ratio0(total, f"CAST({count} AS DOUBLE)"))


def pct2(value: str, total: str) -> str:
    return r2(ratio0(value, total) + " * 100")


WIN = "invoice_date BETWEEN '1995-01-01' AND '2001-08-01'"


def fine_mean(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(28,10))) AS DOUBLE) / COUNT({x})"


def lines(returns: bool = True, samples: bool = True, docs=("INV", "CRN")) -> str:
    """WHERE clause of the base filters over ``fact``."""
    cond = ["document_type IN (" + ", ".join(f"'{d}'" for d in docs) + ")", WIN]
    if not samples:
        cond.append("is_sample = 0")
    if not returns:
        cond.append("is_return = 0")
    return " AND ".join(cond)


def b2(name: str, returns: bool = True, samples: bool = True) -> str:
    return f"""{name} AS (
  SELECT customer_code, customer_name, {msum('quantity')} AS total_quantity, {msum('line_total')} AS total_revenue,
         {msum('line_cost')} AS total_cost, count(*) AS transaction_count, count(DISTINCT item_code) AS unique_products
  FROM fact WHERE {lines(returns, samples)} AND customer_code IS NOT NULL
  GROUP BY customer_code, customer_name)"""


def b3(name: str, returns: bool = True, samples: bool = True, tier: str | None = None) -> str:
    extra = f", {tier} AS catalogue_price" if tier else ""
    extra_g = f", {tier}" if tier else ""
    return f"""{name} AS (
  SELECT item_code, landed_cost_euro, ie_trade AS catalogue_price_trade{extra},
         coalesce(max(item_description), 'Unknown') AS product_description,
         {msum('quantity')} AS total_quantity, {msum('line_total')} AS total_revenue,
         {msum('line_cost')} AS total_cost, count(*) AS transaction_count,
         count(DISTINCT customer_code) AS unique_customers
  FROM fact WHERE {lines(returns, samples)}
  GROUP BY item_code, landed_cost_euro, ie_trade{extra_g})"""


def m1(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT customer_code, customer_name, total_revenue, total_cost,
         {margin('total_revenue', 'total_cost')} AS gross_margin,
         {margin_pct('total_revenue', 'total_cost')} AS margin_percent,
         transaction_count, unique_products, {avg2('total_revenue', 'transaction_count')} AS avg_order_value,
         total_quantity
  FROM {src})"""


def m2(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT item_code, product_description, total_quantity AS quantity_sold, total_revenue AS revenue,
         total_cost AS cost, {margin('total_revenue', 'total_cost')} AS margin,
         {margin_pct('total_revenue', 'total_cost')} AS margin_percent,
         unique_customers, transaction_count, {avg2('total_quantity', 'transaction_count')} AS avg_order_quantity
  FROM {src})"""


def newest(value: str, keys: str, src: str, name: str) -> str:
    """K20 pick: the value on the newest line per group (see operators.facts.newest)."""
    return f"""{name} AS (
  SELECT {keys}, {value} AS newest_value FROM (
    SELECT {keys}, {value}, row_number() OVER (PARTITION BY {keys}
      ORDER BY invoice_date DESC NULLS LAST, invoice_number DESC NULLS LAST, {value} DESC NULLS LAST) AS rn
    FROM {src}) WHERE rn = 1)"""


def exact_mean(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(28,10))) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE))"


def exact_covar(x: str, y: str) -> str:
    m, k = (f"CAST(floor(({v}) * 1000000 + 0.5e0) AS HUGEINT)" for v in (x, y))
    sm, sk, n = f"SUM({m})", f"SUM({k})", f"COUNT({x})"
    p, q = (f"(({s} - {s} % {n}) // {n})" for s in (sm, sk))
    rest = [f"(CAST({s} % {n} AS DOUBLE) / {n})" for s in (sm, sk)]
    c = f"(SUM({m} * {k}) - {p} * {sk} - {q} * ({sm} - {n} * {p}))"
    double = f"(CAST(({c} - {c} % 1000000000) // 1000000000 AS DOUBLE) * 1e9 + CAST({c} % 1000000000 AS DOUBLE))"
    return f"(({double} / {n} - {rest[0]} * {rest[1]}) / 1000000 / 1000000)"


def exact_std(x: str) -> str:
    return f"sqrt(greatest({exact_covar(x, x)}, 0e0))"
