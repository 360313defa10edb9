"""SQL building blocks: each entry is one CTE with the CTEs it reads."""

from ledgerleaf import fixed_values as fv
from ledgerleaf.sources import statements as st


def lit(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


MERCHANT_LIST = sql_list([m for lab in st.LABELS for m in st.MERCHANTS[lab]])
KEYWORD_LIST = sql_list([w for lab in st.LABELS for w in st.KEYWORDS[lab]])

TX = f"""
  SELECT k AS row_id, 'TX' || lpad((CASE WHEN k % 67 = 1 THEN k - 1 ELSE k END)::VARCHAR, 10, '0') AS transaction_id,
    value_date,
    CAST(value_date + (CASE WHEN k % 37 = 0 THEN -1 WHEN k % 41 = 0 THEN 9 ELSE k % 4 END)::INTEGER AS DATE) AS posted_at,
    CAST(CASE WHEN k % 43 = 0 THEN 0 ELSE price END AS DECIMAL(18,2)) AS amount,
    CASE WHEN k % 47 = 0 THEN 'USD' ELSE 'INR' END AS currency,
    CASE WHEN (true_label LIKE 'INCOME%') <> (k % 61 = 0) THEN 'CR' ELSE 'DR' END AS dr_cr,
    CASE WHEN k % 59 = 0 THEN NULL WHEN k % 53 = 0 THEN '' ELSE merchant END AS merchant_name,
    reference,
    CASE WHEN k % 31 = 0 THEN NULL WHEN k % 19 = 0 THEN replace(lower(line), ' ', ' / ') ELSE line END AS narrative,
    channel, account_type, city, keyword_hit, category_id,
    display AS category_display_name, true_label
  FROM (
    SELECT *, LAYOUT_CASE AS line
    FROM (
      SELECT *, CASE channel WHEN 'UPI' THEN 'UPI' || lpad((k % 100000000)::VARCHAR, 8, '0')
          WHEN 'CARD' THEN 'CARD' || lpad((k % 1000000)::VARCHAR, 6, '0')
          WHEN 'POS' THEN 'POS' || lpad((k % 1000000)::VARCHAR, 6, '0')
          WHEN 'NETBANKING' THEN 'NB' || lpad((k % 10000000)::VARCHAR, 7, '0')
          WHEN 'NEFT' THEN 'NEFT' || lpad((k % 10000000)::VARCHAR, 7, '0')
          ELSE 'AUTO' || lpad((k % 1000000)::VARCHAR, 6, '0') END AS reference,
        CASE WHEN k % 23 = 0 THEN left(merchant, -1) ELSE merchant END AS spelled,
        display_names[label_no] AS display
      FROM (
        SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS value_date, round(o_totalprice, 2) AS price,
          o_orderkey % 16 + 1 AS label_no,
          {sql_list(st.LABELS)}[o_orderkey % 16 + 1] AS true_label,
          {sql_list(st.LABELS)}[(CASE WHEN o_orderkey % 29 = 0 THEN (o_orderkey + 1) % 16 ELSE o_orderkey % 16 END) + 1] AS category_id,
          {MERCHANT_LIST}[(o_orderkey % 16) * 4 + (o_orderkey // 16) % 4 + 1] AS merchant,
          {KEYWORD_LIST}[(o_orderkey % 16) * 3 + (o_orderkey // 64) % 3 + 1] AS keyword_hit,
          {sql_list(st.CHANNEL_CYCLE)}[(o_orderkey // 16) % 6 + 1] AS channel,
          {sql_list(st.PLACES)}[c_nationkey % {len(st.PLACES)} + 1] AS city,
          {sql_list(st.PAYERS)}[(o_orderkey // 5) % {len(st.PAYERS)} + 1] AS payer,
          {sql_list(st.ACCOUNTS)}[(o_orderkey // 11) % 3 + 1] AS account_type,
          DISPLAY_LIST AS display_names
        FROM orders JOIN customer ON o_custkey = c_custkey)))
"""
_display = sql_list([" ".join(w.capitalize() for w in lab.lower().split("_")) for lab in st.LABELS])
_layouts = " ".join(f"WHEN {i} THEN concat_ws(' ', {', '.join(parts)})" for i, parts in enumerate(st.LAYOUTS))
_refund = f"CASE WHEN true_label = {lit(fv.REFUND_LABEL)} AND k % 5 = 0 THEN {lit(fv.REFUND_PREFIX)} ELSE '' END"
TX = TX.replace("DISPLAY_LIST", _display).replace("LAYOUT_CASE", f"{_refund} || CASE (k // 3) % {len(st.LAYOUTS)} {_layouts} END")
