"""SQL counterpart of every deterministic query.

Written from the definitions, in other terms than the Spark plans: full grids
instead of histograms, row numbers instead of hash bands, long tables
instead of arrays.
"""

from __future__ import annotations

import json
import struct
import re

from ledgerleaf import fixed_values as fv
from ledgerleaf.operators.taxonomy import DEFAULT_FILE
from ledgerleaf.sources import statements as st
from oracles.fixture_sql import TX, lit, sql_list

STOP = sql_list(fv.NOISE_TOKENS + fv.CITY_STOP)
B0, B1 = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def rx(pattern: str) -> str:
    r"""Pattern with explicit borders in place of \b."""
    pattern = re.sub(r"^\\b", lambda m: B0, pattern)
    pattern = re.sub(r"\\b$", lambda m: B1, pattern)
    return pattern


def found(text: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {lit('(?i)' + rx(p))})" for p in patterns) + ")"


def found_alternatives(text: str, pattern: str) -> str:
    """Split a top-level alternation so that borders apply to each part."""
    parts, depth, cur = [], 0, ""
    for ch in pattern:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "|" and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return found(text, *parts, cur)


def hit(bucket: str, text: str = "coalesce(narrative, '')") -> str:
    return found(text, *fv.LEXICON[bucket])


def coarse_hit(key: str, text: str = "coalesce(narrative, '')") -> str:
    return "(" + " OR ".join(hit(b, text) for b, c in fv.LEXICON_COARSE.items() if c == key) + ")"


def rule_case(text: str) -> str:
    whens = []
    for name, pattern, absent, _ in fv.OVERRIDE_RULES:
        cond = found_alternatives(text, pattern)
        if absent:
            cond += f" AND NOT {found_alternatives(text, absent)}"
        whens.append(f"WHEN {cond} THEN {lit(name)}")
    return f"CASE {' '.join(whens)} END"


RULE_LABEL = "CASE rule " + " ".join(f"WHEN {lit(n)} THEN {lit(t)}" for n, _, _, t in fv.OVERRIDE_RULES) + " END"


def draw(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || ':{salt}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def coarse_case(label: str) -> str:
    whens = " ".join(f"WHEN {label} = {lit(f)} THEN {lit(c)}" for c, kids in fv.HIERARCHY.items() for f in kids)
    return (f"CASE {whens} WHEN {label} IN ({', '.join(lit(x) for x in fv.GUESSED_SHOPPING)}) THEN 'SHOPPING' "
            f"WHEN {label} LIKE 'UTILITIES\\_%' ESCAPE '\\' THEN 'UTILITIES' ELSE 'OTHER_MISC' END")


def raw_tokens(text: str) -> str:
    return (r"flatten(list_transform(list_filter(regexp_extract_all(lower(coalesce(" + text + r", '')), '[\p{L}\p{N}]+'), "
            r"lambda r: NOT regexp_full_match(r, '\p{Nd}{3,}')), lambda r: regexp_extract_all(r, '[a-z0-9]+')))")


def tokens(text: str) -> str:
    return f"list_filter({raw_tokens(text)}, lambda t: NOT list_contains({STOP}, t))"


FITTED = {}     # bucket -> labels, with at least two labels present in the lines
for _lab in st.LABELS:
    _c = next((c for c, kids in fv.HIERARCHY.items() if _lab in kids), "OTHER_MISC")
    FITTED.setdefault(_c, []).append(_lab)
SOLO = {b: k[0] for b, k in FITTED.items() if len(k) == 1}
COARSE = sorted(FITTED)
FITTED = {b: sorted(k) for b, k in FITTED.items() if len(k) > 1}


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows)


HEADS = values([("''", lit(next(c for c in COARSE if lab in FITTED.get(c, [SOLO.get(c)]))), lit(lab)) for lab in st.LABELS]
               + [(lit(b), lit(lab), lit(lab)) for b, kids in FITTED.items() for lab in kids])


def grid(rule: str) -> list[float]:
    """The 101 cut points from 0.05 to 0.95; the newer rule keeps single precision."""
    points = [*(i * ((0.95 - 0.05) / 100) + 0.05 for i in range(100)), 0.95]
    return [struct.unpack("f", struct.pack("f", x))[0] for x in points] if rule == "v7" else points


def grid_sql(rule: str) -> str:
    return values([(str(i + 1), f"{x!r}e0" if "e" not in repr(x) else repr(x)) for i, x in enumerate(grid(rule))])


def floor_case(cls: str, floors: dict) -> str:
    return f"CASE {cls} " + " ".join(f"WHEN {lit(c)} THEN {v}e0" for c, v in floors.items()) + " END"


def search(pairs: str, keys: str, rule: str = "v7") -> str:
    """Every grid point for every key."""
    if rule == "v7":
        f1 = ("2.0e0 * (tp / greatest(called, 1e-12)) * (tp / greatest(positives, 1e-12)) / "
              "greatest(tp / greatest(called, 1e-12) + tp / greatest(positives, 1e-12), 1e-12)")
        nothing = f"{grid(rule)[0]!r}e0"
    else:
        f1 = "2.0e0 * tp / greatest(called + positives, 1e-12)"
        nothing = "0.5e0"
    return f"""
      SELECT {keys}, positives, n,
        CASE WHEN positives = 0 OR positives = n THEN 0.0e0 ELSE f1 END AS best_f1,
        CASE WHEN positives = 0 OR positives = n THEN 0.5e0 WHEN f1 > 0 THEN t ELSE {nothing} END AS threshold
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY f1 DESC, i) AS rn
        FROM (SELECT *, {f1} AS f1 FROM (
          SELECT {keys}, i, t, sum(CASE WHEN p >= t THEN y ELSE 0 END)::DOUBLE AS tp,
            sum(CASE WHEN p >= t THEN 1 ELSE 0 END)::DOUBLE AS called, sum(y)::BIGINT AS positives, count(*) AS n
          FROM ({pairs}) CROSS JOIN ({grid_sql(rule)}) g(i, t) GROUP BY {keys}, i, t)))
      WHERE rn = 1"""


def tf_of(source: str) -> str:
    return f"""SELECT row_id, term, count(*) AS tf FROM (
        SELECT row_id, 'w__' || unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term
        FROM (SELECT row_id, list_filter(toks, lambda t: length(t) >= 2) AS w FROM toks_{source})
        UNION ALL
        SELECT row_id, 'c__' || substr(' ' || t || ' ', i, k) FROM (
          SELECT row_id, t, k, unnest(range(1, length(t) + 4 - k)) AS i
          FROM (SELECT row_id, unnest(toks) AS t FROM toks_{source}) CROSS JOIN (VALUES (3), (4), (5)) v(k)))
      GROUP BY ALL"""


def vocab_of(stats: str, words: int, chars: int) -> str:
    return f"""SELECT term, df, total, (row_number() OVER (ORDER BY starts_with(term, 'c__'), term) - 1)::INTEGER AS idx
      FROM (SELECT *, row_number() OVER (PARTITION BY left(term, 1) ORDER BY total DESC, term) AS rn FROM {stats} WHERE df >= 2)
      WHERE rn <= CASE left(term, 1) WHEN 'w' THEN {words} ELSE {chars} END"""


def idf_of(vocab: str, source: str) -> str:
    return f"SELECT *, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM {vocab}"


def tfidf_of(tf: str, vocab: str) -> str:
    return f"""SELECT row_id, term, idx, v / sqrt(sum(v * v) OVER (PARTITION BY row_id, left(term, 1))) AS value
      FROM (SELECT row_id, term, idx, CASE WHEN starts_with(term, 'w__') THEN 1 + ln(tf) ELSE tf END * idf AS v
            FROM {tf} JOIN {vocab} USING (term))"""


def every_branch(summary: str, rows: str) -> str:
    """Also rows without a known term of a branch, as a feature matrix has them."""
    return f"""SELECT row_id, branch, coalesce(n_terms, 0) AS n_terms, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2, coalesce(peak, 0) AS peak
      FROM (SELECT row_id, branch FROM {rows} CROSS JOIN (VALUES ('w'), ('c')) b(branch)) LEFT JOIN ({summary}) s USING (row_id, branch)"""


TRAINED = """SELECT true_label, count(*) AS total_rows, count(*) AS proper_rows, TRUE AS accurate FROM lines GROUP BY true_label"""

P6 = ", ".join(f"max(CASE WHEN cls = {lit(c)} THEN p END) AS p_{c}" for c in COARSE)
RAISED = ", ".join(f"p_{c} + CASE WHEN {coarse_hit(c, chr(40) + 'coalesce(text, ' + chr(39) * 2 + ')' + chr(41))} THEN 0.08e0 ELSE 0.0e0 END AS r_{c}"
                   if c in fv.LEXICON_COARSE.values() else f"p_{c} + 0.0e0 AS r_{c}" for c in COARSE)
TOTAL = " + ".join(f"r_{c}" for c in COARSE)
BOOSTED = ", ".join(f"round(r_{c} / ({TOTAL}), 6) AS p_{c}" for c in COARSE)
TOP_P = f"greatest({', '.join(f'p_{c}' for c in COARSE)})"
TOP_C = "CASE " + " ".join(f"WHEN p_{c} = {TOP_P} THEN {lit(c)}" for c in COARSE) + " END"

TAXONOMY = json.loads(DEFAULT_FILE.read_text())
TAX = "SELECT * FROM (" + values([
    [lit(r["id"]), lit(r["display_name"]), lit(r["group"]), lit(r["parent_id"]) if r["parent_id"] else "NULL",
     lit(r["budget_bucket"]), lit(r["default_direction"]), str(r["tax_relevant"]).upper()] for r in TAXONOMY
]) + ") t(id, display_name, grp, parent_id, budget_bucket, default_direction, tax_relevant)"

# name -> (CTEs it reads, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "tx": ([], TX),
    "lines": (["tx"], f"SELECT *, narrative AS text, CASE WHEN {draw('row_id', 'split')} < 0.2 THEN 'test' ELSE 'train' END AS split, "
                      f"{coarse_case('category_id')} AS coarse FROM tx"),
    "train": (["lines"], "SELECT * FROM lines WHERE split = 'train'"),
    "docs": ([], "SELECT doc_id AS row_id, text FROM documents"),
    "o": ([], """
        SELECT round(o_totalprice, 2)::DECIMAL(18, 2) AS amount, 'customer:' || o_custkey AS c, 'nation:' || c_nationkey AS n, 'region:' || n_regionkey AS r
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""),
    "tax": ([], TAX),
    "toks_lines": (["lines"], f"SELECT row_id, {tokens('text')} AS toks FROM lines"),
    "toks_docs": (["docs"], f"SELECT row_id, {tokens('text')} AS toks FROM docs"),
    "tf_lines": (["toks_lines"], tf_of("lines")),
    "tf_docs": (["toks_docs"], tf_of("docs")),
    "stats_docs": (["tf_docs"], "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf_docs GROUP BY term"),
    "vocab_docs": (["stats_docs"], vocab_of("stats_docs", 150000, 100000)),
    "idf_docs": (["vocab_docs", "docs"], idf_of("vocab_docs", "docs")),
    "stats_lines": (["tf_lines"], "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf_lines GROUP BY term"),
    "vocab_lines": (["stats_lines"], vocab_of("stats_lines", 150000, 100000)),
    "idf_lines": (["vocab_lines", "lines"], idf_of("vocab_lines", "lines")),
    "stats_train": (["tf_lines", "train"], "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf_lines "
                                           "WHERE row_id IN (SELECT row_id FROM train) GROUP BY term"),
    "vocab_train": (["stats_train"], vocab_of("stats_train", 150000, 100000)),
    "idf_train": (["vocab_train", "train"], idf_of("vocab_train", "train")),
    "vals": (["tf_lines", "idf_train"], tfidf_of("tf_lines", "idf_train")),
    # complement naive Bayes, long form
    "heads": ([], f"SELECT * FROM ({HEADS}) h(head, cls, label)"),
    "sums": (["vals", "train"], "SELECT term, category_id AS label, sum(value) AS s FROM vals JOIN train USING (row_id) GROUP BY ALL"),
    "mass": (["sums", "heads", "idf_train"], """
        SELECT g.head, g.cls, g.term, coalesce(m.s, 0) AS s
        FROM (SELECT DISTINCT head, cls, term FROM heads CROSS JOIN (SELECT term FROM idf_train)) g
        LEFT JOIN (SELECT head, cls, term, sum(s) AS s FROM sums JOIN heads USING (label) GROUP BY ALL) m USING (head, cls, term)"""),
    "nb": (["mass"], """
        SELECT head, cls, term, ln(sum(comp) OVER (PARTITION BY head, cls)) - ln(comp) AS w
        FROM (SELECT *, sum(s) OVER (PARTITION BY head, term) - s + 0.5 AS comp FROM mass)"""),
    "scores": (["vals", "nb", "lines", "heads"], """
        SELECT g.row_id, g.head, g.cls, coalesce(x.score, 0) AS score
        FROM (SELECT row_id, head, cls FROM lines CROSS JOIN (SELECT DISTINCT head, cls FROM heads)) g
        LEFT JOIN (SELECT row_id, head, cls, sum(value * w) AS score FROM vals JOIN nb USING (term) GROUP BY ALL) x
          USING (row_id, head, cls)"""),
    "proba": (["scores"], """
        SELECT row_id, head, cls, round(e / sum(e) OVER (PARTITION BY row_id, head), 6) AS p
        FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY row_id, head)) AS e FROM scores)"""),
    "pairs": (["proba", "lines"], "SELECT row_id, cls, (cls = coarse)::INT AS y, p FROM proba JOIN lines USING (row_id) WHERE head = ''"),
    "fine_pairs": (["proba", "lines"], "SELECT row_id, head, cls, (cls = category_id)::INT AS y, p FROM proba JOIN lines USING (row_id) WHERE head = coarse"),
    "cal_pairs": (["proba", "train"], """
        SELECT 'coarse' AS level, '' AS bucket, cls, (cls = coarse)::INT AS y, p FROM proba JOIN (
          SELECT *, row_number() OVER (ORDER BY md5(row_id::VARCHAR || ':42'), row_id) AS rn, count(*) OVER () AS n FROM train) USING (row_id)
        WHERE head = '' AND rn <= least(12000, n // 5)
        UNION ALL
        SELECT 'fine', head, cls, (cls = category_id)::INT, p FROM proba JOIN (
          SELECT *, row_number() OVER (PARTITION BY coarse ORDER BY md5(row_id::VARCHAR || ':123'), row_id) AS rn,
            count(*) OVER (PARTITION BY coarse) AS n FROM train) USING (row_id)
        WHERE head = coarse AND rn <= least(n, 2000, greatest(200, floor(n * 0.2e0)))"""),
    "thr": (["cal_pairs"], f"""
        SELECT level, bucket, cls, greatest(threshold, CASE level WHEN 'coarse' THEN {floor_case('cls', fv.COARSE_FLOORS)}
          ELSE {floor_case('cls', fv.FINE_FLOORS)} END) AS threshold FROM ({search('SELECT * FROM cal_pairs', 'level, bucket, cls')})"""),
    "coarse_p": (["proba"], f"SELECT row_id, {P6} FROM proba WHERE head = '' GROUP BY row_id"),
    "boosted": (["coarse_p", "lines"], f"SELECT row_id, {BOOSTED} FROM (SELECT row_id, {RAISED} FROM coarse_p JOIN lines USING (row_id))"),
    "top": (["boosted"], f"SELECT row_id, {TOP_C} AS coarse_top, {TOP_P} AS coarse_confidence FROM boosted"),
    "routed": (["top", "thr"], """
        SELECT row_id, coarse_top, coarse_confidence,
          CASE WHEN coarse_confidence >= coalesce(threshold, 0.2e0) THEN coarse_top ELSE 'OTHER_MISC' END AS coarse_label
        FROM top LEFT JOIN (SELECT * FROM thr WHERE level = 'coarse') t ON t.cls = coarse_top"""),
    "fine": (["routed", "proba", "thr", "lines"], f"""
        SELECT d.*, {rule_case("lower(coalesce(text, ''))")} AS any_rule, text FROM (
          SELECT r.row_id, coarse_top, coarse_confidence, coarse_label, b.cls AS fine_class, b.p AS fine_top,
            coalesce(t.threshold, {floor_case('b.cls', fv.FINE_FLOORS)}, 0.2e0) AS threshold, o.p AS other_p, b.cls IS NOT NULL AS fitted
          FROM routed r
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY row_id, head ORDER BY p DESC, cls) AS rn FROM proba WHERE head <> '') b
            ON b.row_id = r.row_id AND b.head = coarse_label AND b.rn = 1
          LEFT JOIN (SELECT * FROM proba WHERE head <> '' AND cls = 'OTHER') o ON o.row_id = r.row_id AND o.head = coarse_label
          LEFT JOIN (SELECT * FROM thr WHERE level = 'fine') t ON t.bucket = coarse_label AND t.cls = b.cls) d
        JOIN lines USING (row_id)"""),
    "decided": (["fine"], f"""
        SELECT *, CASE WHEN fitted THEN coalesce({RULE_LABEL}, label_raw) ELSE label_raw END AS label,
          CASE WHEN fitted THEN confidence ELSE coarse_confidence END < 0.6 AS needs_review FROM (
        SELECT *, CASE WHEN fitted THEN any_rule END AS rule,
          CASE WHEN fitted THEN CASE WHEN weak THEN 'OTHER' ELSE fine_class END
               ELSE CASE coarse_label {' '.join(f"WHEN {lit(b)} THEN {lit(x)}" for b, x in SOLO.items())} ELSE 'OTHER' END END AS label_raw,
          CASE WHEN fitted THEN CASE WHEN weak THEN other_p ELSE fine_top END
               WHEN coarse_label IN ({', '.join(lit(b) for b in SOLO)}) THEN 0.99e0 ELSE 0.0e0 END AS confidence
        FROM (SELECT *, coalesce(fine_top < threshold AND other_p IS NOT NULL, FALSE) AS weak FROM fine))"""),
    "scored": (["decided", "lines"], "SELECT l.*, d.* EXCLUDE (row_id, text) FROM lines l JOIN decided d USING (row_id)"),
    "explained": (["decided", "vals", "nb"], """
        SELECT row_id, string_agg(term || ':' || c::DECIMAL(24, 9)::DECIMAL(24, 2)::VARCHAR, '; ' ORDER BY c DESC, idx) AS explanation
        FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, idx) AS rn FROM (
          SELECT d.row_id, v.term, v.idx, round(v.value * nb.w, 9) AS c
          FROM decided d JOIN vals v USING (row_id) JOIN nb ON nb.term = v.term AND nb.head = d.coarse_label AND nb.cls = d.fine_class
          WHERE d.needs_review AND d.fitted)) WHERE rn <= 6 GROUP BY row_id"""),
    "per_class": (["scored"], """
        SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
          CASE WHEN 2 * tp + (predicted - tp) + (support - tp) > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1
        FROM (SELECT split, label, sum(s)::BIGINT AS support, sum(q)::BIGINT AS predicted, sum(t)::BIGINT AS tp FROM (
          SELECT split, true_label AS label, 1 AS s, 0 AS q, 0 AS t FROM scored
          UNION ALL SELECT split, label, 0, 1, (label = true_label)::INT FROM scored) GROUP BY ALL)"""),
    "fb": ([], """
        SELECT event_id % (SELECT count(*) FROM orders) AS row_id, event_id, ts,
          CASE WHEN event_type IN ('error', 'view') THEN 'Corrected' ELSE 'Accepted' END AS status,
          CASE event_type WHEN 'error' THEN 'FEES' WHEN 'view' THEN '' END AS corrected_label FROM events"""),
    "fb_latest": (["fb"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ts DESC, event_id DESC) AS rn FROM fb) WHERE rn = 1"),
    "fb_join": (["fb_latest", "scored"], """
        SELECT s.row_id, s.label, coalesce(f.status, 'Not reviewed') AS status,
          CASE WHEN f.status = 'Corrected' THEN CASE WHEN coalesce(trim(corrected_label), '') = '' THEN 'OTHER' ELSE trim(corrected_label) END
               ELSE s.label END AS final_label FROM scored s LEFT JOIN fb_latest f USING (row_id)"""),
    "dq": (["tx", "tax"], f"""
        SELECT *, posted_at - value_date AS gap, count(*) OVER (PARTITION BY transaction_id) AS copies,
          coalesce(CASE category_id {' '.join(f"WHEN {lit(k)} THEN {v[0]}" for k, v in fv.AMOUNTS.items())} END, 150) AS low,
          coalesce(CASE category_id {' '.join(f"WHEN {lit(k)} THEN {v[1]}" for k, v in fv.AMOUNTS.items())} END, 5000) AS high,
          NOT list_contains(CASE category_id {' '.join(f"WHEN {lit(k)} THEN {sql_list(v)}" for k, v in fv.CHANNELS.items())}
            ELSE {sql_list(fv.CHANNELS_DEFAULT)} END, channel) AS odd_channel,
          (SELECT display_name FROM tax WHERE id = category_id) AS expected_name, (SELECT grp FROM tax WHERE id = category_id) AS label_group
        FROM tx"""),
    "dq_flags": (["dq"], """
        SELECT row_id, unnest([
          CASE WHEN gap < 0 THEN 'posted_early' END, CASE WHEN gap >= 7 THEN 'posted_late' END,
          CASE WHEN amount < low OR amount > high THEN 'out_of_range' END, CASE WHEN amount <= 25 THEN 'tiny' END,
          CASE WHEN odd_channel THEN 'odd_channel' END,
          CASE WHEN trim(coalesce(merchant_name, '')) = '' THEN 'missing_merchant_name' END,
          CASE WHEN trim(coalesce(city, '')) = '' THEN 'missing_city' END,
          CASE WHEN trim(coalesce(reference, '')) = '' THEN 'missing_reference' END,
          CASE WHEN trim(coalesce(keyword_hit, '')) = '' THEN 'missing_keyword_hit' END,
          CASE WHEN currency <> 'INR' THEN 'foreign_currency' END,
          CASE WHEN expected_name IS DISTINCT FROM category_display_name THEN 'name_mismatch' END,
          CASE WHEN (dr_cr = 'CR') <> (label_group = 'INCOME') THEN 'direction_mismatch' END,
          CASE WHEN dr_cr = 'CR' AND upper(coalesce(narrative, '')) LIKE 'REFUND %' AND category_id <> 'INCOME_REFUNDS' THEN 'unlabelled_refund' END,
          CASE WHEN copies > 1 THEN 'duplicate' END]) AS rule FROM dq"""),
}

OUT = "label, confidence, coarse_label, coarse_confidence, needs_review"
EDGES = r"[\s\p{Z}\x0B\x1c-\x1f\x85]+"


def trimmed(col: str) -> str:
    return f"regexp_replace({col}, '^{EDGES}|{EDGES}$', '', 'g')"


def branch_summary(value_sql: str) -> str:
    return (f"SELECT row_id, left(term, 1) AS branch, count(*) AS n_terms, round(sum(value), 6) AS l1, "
            f"round(sum(value * value), 6) AS l2, round(max(value), 6) AS peak FROM ({value_sql}) GROUP BY ALL")


NOISE_SQL, CITY_SQL = (", ".join(lit(x) for x in v) for v in (fv.NOISE_TOKENS, fv.CITY_STOP))
_IDS = "|".join(f"{p}[0-9]{{{n}}}" for p, n in [*fv.REFERENCE_FORMATS.values(), fv.REFERENCE_FORMAT_OTHER])
_WEIGHTS = "CASE label " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in fv.LABEL_WEIGHTS.items()) + " ELSE 0.03 END"


def by_split_total(name: str, p: str, r: str, f: str) -> str:
    return (f"SELECT split, 'total' AS kind, '{name}' AS label, round({p}, 6) AS precision, round({r}, 6) AS recall, "
            f"round({f}, 6) AS f1, sum(support)::BIGINT AS support FROM per_class GROUP BY split")


# name -> (CTEs, final SELECT)
ORACLES: dict[str, tuple[list[str], str]] = {
    "scan_transactions": (["tx"], """SELECT transaction_id, value_date, posted_at, amount, currency, dr_cr,
        nullif(merchant_name, '') AS merchant_name, reference, narrative, channel, account_type, city, keyword_hit,
        category_id, category_display_name FROM tx"""),
    "scan_csv_roundtrip": (["docs"], "SELECT row_id, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM docs"),
    "row_count": (["docs"], "SELECT count(*) AS total_rows FROM docs"),
    "text_lines": (["docs"], f"SELECT row_id, line FROM (SELECT row_id, {trimmed('l')} AS line FROM (SELECT row_id, "
                             r"unnest(string_split_regex(text, '\r\n|\r|\n')) AS l FROM docs)) WHERE line <> ''"),
    "text_column": (["tx"], f"SELECT text FROM (SELECT {trimmed(chr(40) + 'coalesce(merchant_name, ' + chr(39) * 2 + ')' + chr(41))} AS text FROM tx) WHERE text <> ''"),
    "scored_output": (["scored"], f"SELECT row_id, transaction_id, narrative, {OUT} FROM scored"),
    "stream_scored_output": (["scored"], f"SELECT row_id, transaction_id, narrative, {OUT} FROM scored"),
    "stream_totals": (["scored"], "SELECT coarse_label, label, count(*) AS total_rows, sum(needs_review::INT)::BIGINT AS flagged FROM scored GROUP BY ALL"),
    "score_nb": (["scored"], f"SELECT row_id, text, true_label, split, {OUT} FROM scored"),
    "model_roundtrip": (["scored"], f"SELECT row_id, text, true_label, split, {OUT} FROM scored"),
    "predictions_json": (["scored", "explained"], """SELECT row_id, to_json({'text': text, 'label': label, 'confidence': confidence,
        'coarse_label': coarse_label, 'coarse_confidence': coarse_confidence, 'needs_review': needs_review,
        'explanation': nullif(explanation, '')})::VARCHAR AS json FROM scored LEFT JOIN explained USING (row_id)"""),
    "display_projection": (["scored"], """SELECT row_id, CASE WHEN length(coalesce(text, '')) <= 40 THEN coalesce(text, '') ELSE left(text, 37) || '...' END AS text,
        label, confidence::DECIMAL(24, 6)::DECIMAL(24, 3)::VARCHAR AS conf, CASE WHEN needs_review THEN 'True' ELSE 'False' END AS needs_review,
        coarse_label AS coarse, coarse_confidence::DECIMAL(24, 6)::DECIMAL(24, 3)::VARCHAR AS coarse_conf FROM scored"""),
    "review_queue": (["scored", "explained"], """SELECT text AS raw_text, true_label AS label, label AS pred, confidence AS pred_proba,
        coalesce(explanation, '') AS explain FROM scored LEFT JOIN explained USING (row_id) WHERE confidence < 0.6"""),
    "metrics_summary": (["scored", "per_class"], """SELECT round(avg(f1), 3) AS macro_f1, round(sum(tp) / sum(support), 3) AS accuracy,
        (SELECT count(*) FROM scored WHERE split = 'train') AS n_train, sum(support)::BIGINT AS n_test FROM per_class WHERE split = 'test'"""),
    "pick_columns": (["tx"], "SELECT row_id, narrative AS raw_text, category_id AS label, 1.0::DOUBLE AS __weight__ FROM tx"),
    "fine_to_coarse": (["tx"], "SELECT row_id, category_id, CASE " + " ".join(
        f"WHEN category_id IN ({', '.join(lit(k) for k in kids)}) THEN {lit(c)}" for c, kids in fv.HIERARCHY.items()) + " ELSE 'OTHER_MISC' END AS coarse FROM tx"),
    "bucket_rows": (["tx"], "SELECT row_id, category_id FROM tx WHERE category_id IN ('TRAVEL', 'FUEL', 'MOBILITY')"),
    "preds_sink": (["scored", "explained"], """SELECT row_id, true_label AS label, label AS pred, confidence AS pred_proba, coalesce(explanation, '') AS explain
        FROM scored LEFT JOIN explained USING (row_id) WHERE split = 'test'"""),
    "confusion_sink": (["scored"], "SELECT true_label AS truth, label AS pred, count(*) AS n FROM scored GROUP BY ALL"),
    "metrics_sink": (["scored", "per_class"], """SELECT round(avg(f1), 3) AS macro_f1, round(sum(tp) / sum(support), 3) AS accuracy,
        (SELECT count(*) FROM scored WHERE split = 'train') AS n_train, sum(support)::BIGINT AS n_test, TRUE AS timed FROM per_class WHERE split = 'test'"""),
    "texts_scored": (["tx"], "SELECT DISTINCT trim(merchant_name) AS text, TRUE AS labelled FROM tx WHERE trim(coalesce(merchant_name, '')) <> ''"),
    "taxonomy_dim": (["tx", "tax"], """SELECT id, display_name, grp AS label_group, parent_id, budget_bucket, tax_relevant, coalesce(n, 0) AS n_lines
        FROM tax LEFT JOIN (SELECT category_id AS id, count(*) AS n FROM tx GROUP BY 1) USING (id)"""),
    "needs_review": (["scored"], "SELECT row_id, fitted, confidence, coarse_confidence, needs_review FROM scored"),
    "normalize_text": (["toks_docs"], "SELECT row_id, array_to_string(toks, ' ') AS normalized FROM toks_docs"),
    "stop_tokens": (["tx"], f"SELECT token, CASE WHEN token IN ({NOISE_SQL}) THEN 'noise' WHEN token IN ({CITY_SQL}) THEN 'city' ELSE 'kept' END AS kind, "
                            f"count(*) AS total FROM (SELECT unnest({raw_tokens('narrative')}) AS token FROM tx) GROUP BY ALL"),
    "word_tokens": (["toks_docs"], "SELECT row_id, len(w)::INT AS n_words, array_to_string(w, ' ') AS words FROM "
                                   "(SELECT row_id, list_filter(toks, lambda t: length(t) >= 2) AS w FROM toks_docs)"),
    "word_ngrams": (["tf_docs"], "SELECT term, sum(tf)::BIGINT AS total FROM tf_docs WHERE starts_with(term, 'w__') GROUP BY term"),
    "char_ngrams": (["tf_docs"], "SELECT term, sum(tf)::BIGINT AS total FROM tf_docs WHERE starts_with(term, 'c__') GROUP BY term"),
    "lexicon_match": (["tx"], "SELECT row_id, " + ", ".join(f"{hit(b)} AS hit_{b}" for b in fv.LEXICON) + ", " + ", ".join(
        f"{coarse_hit(k)} AS coarse_{k}" for k in dict.fromkeys(fv.LEXICON_COARSE.values())) + " FROM tx"),
    "lexicon_join": (["tx"], "SELECT bucket, count(*) AS hits, count(DISTINCT row_id) AS n_lines FROM (" + " UNION ALL ".join(
        f"SELECT {lit(b)} AS bucket, row_id FROM tx WHERE {found('narrative', p)}" for b, pats in fv.LEXICON.items() for p in pats)
        + ") GROUP BY bucket"),
    "lexicon_table": (["tx"], "SELECT bucket, pattern, count(*) AS n_lines FROM (" + " UNION ALL ".join([
        *(f"SELECT {lit(b)} AS bucket, {lit(p)} AS pattern, row_id FROM tx WHERE {found(chr(34) + 'narrative' + chr(34), p)}" for b, ps in fv.LEXICON.items() for p in ps),
        r"SELECT 'nation', '\b' || n_name || '\b', row_id FROM tx, nation WHERE regexp_matches(narrative, '(?i)(^|[^\p{L}\p{N}_])' || n_name || '([^\p{L}\p{N}_]|$)')",
        r"SELECT 'merchant', m, row_id FROM tx, (SELECT DISTINCT lower(merchant_name) AS m FROM tx WHERE regexp_full_match(merchant_name, '[A-Za-z0-9 ]+')) "
        "WHERE contains(lower(narrative), m)"]) + ") GROUP BY ALL"),
    "hard_override": (["tx"], f"SELECT row_id, category_id, rule, coalesce({RULE_LABEL}, category_id) AS label FROM "
                              f"(SELECT *, {rule_case(chr(108) + 'ower(coalesce(narrative, ' + chr(39) * 2 + '))')} AS rule FROM tx)"),
    "explain_parse": (["scored", "explained"], """SELECT row_id, len(parts)::INT AS n_parts, array_to_string(parts, '|') AS parts FROM (
        SELECT row_id, list_filter(list_transform(string_split(coalesce(explanation, ''), ';'), lambda p: trim(p)), lambda p: p <> '')[1:5] AS parts
        FROM scored LEFT JOIN explained USING (row_id))"""),
    "compose_narrative": (["tx"], "SELECT row_id, channel, reference, narrative FROM tx"),
    "reference_extract": (["tx"], f"""SELECT row_id, ext_reference, CASE regexp_extract(ext_reference, '^([A-Z]+)', 1) {' '.join(
        f"WHEN {lit(p)} THEN {lit(c)}" for c, (p, _) in {**fv.REFERENCE_FORMATS, 'OTHER': fv.REFERENCE_FORMAT_OTHER}.items())} ELSE '' END AS ext_channel,
        lower(regexp_extract(u, '(@[A-Z]+)', 1)) AS ext_handle, regexp_extract(u, '\\b({'|'.join(fv.BANK_CODES)})\\b', 1) AS ext_bank,
        regexp_extract(u, '\\b({'|'.join(fv.CARD_NETWORKS)})\\b', 1) AS ext_network
        FROM (SELECT row_id, u, regexp_extract(u, '\\b({_IDS})\\b', 1) AS ext_reference FROM (SELECT row_id, upper(coalesce(narrative, '')) AS u FROM tx))"""),
    "augment_text": (["tx"], f"""SELECT row_id,
        CASE WHEN len(w) > 1 THEN array_to_string(list_concat(w[:i - 1], [w[i + 1], w[i]], w[i + 2:]), ' ') ELSE narrative END AS swapped,
        left(narrative, j - 1) || substr(narrative, j + 1) AS dropped
        FROM (SELECT row_id, narrative, w, floor({draw('row_id', 'words')} * (len(w) - 1))::INT + 1 AS i,
                     floor({draw('row_id', 'letter')} * length(narrative))::INT + 1 AS j
              FROM (SELECT row_id, narrative, string_split(narrative, ' ') AS w FROM tx))"""),
    "term_freq": (["tf_lines"], "SELECT * FROM tf_lines WHERE starts_with(term, 'w__')"),
    "doc_freq": (["stats_docs"], "SELECT term, df, total FROM stats_docs"),
    "vocabulary": (["vocab_docs"], "SELECT term, df, total, idx FROM vocab_docs"),
    "idf": (["idf_docs"], "SELECT term, df, round(idf, 6) AS idf FROM idf_docs"),
    "tfidf_word": (["tf_lines", "idf_lines"], f"SELECT row_id, term, round(value, 6) AS value FROM ({tfidf_of('tf_lines', 'idf_lines')}) WHERE starts_with(term, 'w__')"),
    "tfidf_char": (["tf_lines", "idf_lines"], f"SELECT row_id, term, round(value, 6) AS value FROM ({tfidf_of('tf_lines', 'idf_lines')}) WHERE starts_with(term, 'c__')"),
    "tfidf_union": (["tf_docs", "idf_docs", "docs"], every_branch(branch_summary(tfidf_of("tf_docs", "idf_docs")), "docs")),
    "tfidf_transform": (["vals", "lines"], every_branch(branch_summary("SELECT * FROM vals"), "lines")),
    # trained models: what must hold for every row whatever the last digits of the optimiser
    "coarse_lr": (["lines"], TRAINED),
    "coarse_ovr": (["lines"], TRAINED),
    "coarse_sgd": (["lines"], TRAINED),
    "fit_certificate": (["train"], """
        SELECT bucket, cls, count(*) AS n_rows, round(1e0 / count(*) OVER (PARTITION BY bucket), 2) AS mass, TRUE AS stationary
        FROM (SELECT '' AS bucket, coarse AS cls FROM train WHERE category_id IS NOT NULL
              UNION ALL SELECT coarse, category_id FROM train WHERE category_id IS NOT NULL)
        GROUP BY bucket, cls QUALIFY count(*) OVER (PARTITION BY bucket) > 1"""),
    "score_full": (["lines"], TRAINED),
    "fine_ensemble": (["proba"], "SELECT row_id, head AS bucket, cls, p AS nb_p, TRUE AS mixed FROM proba WHERE head <> ''"),
    "label_union": (["tx"], "SELECT DISTINCT category_id AS label FROM tx"),
    "unmapped_labels": (["tx"], f"SELECT DISTINCT category_id AS label FROM tx WHERE category_id NOT IN ({', '.join(lit(f) for k in fv.HIERARCHY.values() for f in k)})"),
    "augment_hierarchy": (["tx"], "SELECT coarse, fine, 'base' AS origin FROM (" + values([(lit(c), lit(f)) for c, k in fv.HIERARCHY.items() for f in k]) +
                          ") h(coarse, fine) UNION ALL SELECT DISTINCT " + coarse_case("category_id") + ", category_id, 'guessed' FROM tx "
                          f"WHERE category_id NOT IN ({', '.join(lit(f) for k in fv.HIERARCHY.values() for f in k)})"),
    "class_weights": (["tx"], "SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT category_id AS label, count(*) AS n FROM tx GROUP BY 1)"),
    "fine_bucket_kind": (["lines"], f"""SELECT bucket, coalesce(n, 0) AS n_labels, CASE coalesce(n, 0) WHEN 0 THEN 'missing' WHEN 1 THEN 'solo' ELSE 'fitted' END AS kind,
        CASE WHEN n = 1 THEN first_label END AS solo_label, CASE WHEN n = 1 THEN coalesce({floor_case('first_label', fv.FINE_FLOORS)}, 0.2e0) END AS solo_threshold
        FROM ({values([(lit(k),) for k in fv.COARSE_KEYS])}) k(bucket) LEFT JOIN (
          SELECT coarse AS bucket, count(DISTINCT category_id) AS n, min(category_id) AS first_label FROM lines GROUP BY coarse) USING (bucket)"""),
    "train_test_split": (["tx"], """SELECT row_id, CASE WHEN rn <= n - n // 5 THEN 'train' ELSE 'test' END AS band FROM (
        SELECT row_id, row_number() OVER (ORDER BY md5(row_id::VARCHAR || ':42'), row_id) AS rn, count(*) OVER () AS n FROM tx)"""),
    "calibration_sample": (["lines"], """SELECT row_id, 'coarse' AS level, coarse FROM (SELECT *, count(*) OVER () AS n,
          row_number() OVER (ORDER BY md5(row_id::VARCHAR || ':42'), row_id) AS rn FROM lines) WHERE rn <= least(12000, n // 5)
        UNION ALL SELECT row_id, 'fine', coarse FROM (SELECT *, count(*) OVER (PARTITION BY coarse) AS n,
          row_number() OVER (PARTITION BY coarse ORDER BY md5(row_id::VARCHAR || ':123'), row_id) AS rn FROM lines)
        WHERE rn <= least(n, 2000, greatest(200, floor(n * 0.2e0)))"""),
    "stratified_allocation": (["tx"], f"""SELECT row_id, category_id FROM (SELECT row_id, category_id,
          row_number() OVER (PARTITION BY category_id ORDER BY md5(row_id::VARCHAR || ':42'), row_id) AS rn FROM tx)
        JOIN (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY round(share - base, 9) DESC, label) <= 3000 - sum(base) OVER () THEN 1 ELSE 0 END AS quota
          FROM (SELECT label, share, floor(share) AS base FROM (SELECT label, w::DOUBLE * 3000 / (sum(w) OVER ())::DOUBLE AS share
            FROM (SELECT label, {_WEIGHTS}::DECIMAL(9, 4) AS w FROM (SELECT DISTINCT category_id AS label FROM tx)))))
        ON label = category_id WHERE rn <= quota"""),
    "nb_fit": (["nb"], "SELECT term, cls, round(w, 6) AS weight FROM nb WHERE head = ''"),
    "linear_scores": (["scores"], "SELECT row_id, " + ", ".join(f"round(max(CASE WHEN cls = {lit(c)} THEN score END), 6) AS score_{c}" for c in COARSE) +
                      " FROM scores WHERE head = '' GROUP BY row_id"),
    "nb_proba": (["coarse_p"], "SELECT * FROM coarse_p"),
    "argmax_class": (["coarse_p"], f"SELECT row_id, {TOP_C} AS cls FROM coarse_p"),
    "coarse_boost": (["boosted"], "SELECT * FROM boosted"),
    "apply_thresholds": (["top", "thr"], """SELECT row_id, coarse_top AS cls, coarse_confidence AS p, round(coalesce(threshold, 0.2e0), 6) AS threshold,
        coarse_confidence >= coalesce(threshold, 0.2e0) AS reached FROM top LEFT JOIN (SELECT * FROM thr WHERE level = 'coarse') t ON t.cls = coarse_top"""),
    "coarse_route": (["routed"], "SELECT row_id, coarse_top, coarse_confidence, coarse_label FROM routed"),
    "fine_decide": (["decided"], "SELECT row_id, coarse_label, fine_class, label_raw, rule, label, confidence FROM decided"),
    "threshold_floor": (["thr", "tx"], f"""SELECT level, bucket, cls, round(threshold, 6) AS threshold, n_rows FROM (
        SELECT level, bucket, cls, threshold FROM thr) LEFT JOIN (SELECT category_id AS cls, count(*) AS n_rows FROM tx GROUP BY 1) USING (cls)"""),
    "threshold_search": (["pairs", "fine_pairs"], f"""SELECT level, bucket, cls, positives, n, round(best_f1, 6) AS best_f1, round(threshold, 6) AS threshold FROM (
        {search("SELECT 'coarse' AS level, '' AS bucket, cls, y, p FROM pairs UNION ALL SELECT 'fine', head, cls, y, p FROM fine_pairs", 'level, bucket, cls')})"""),
    "threshold_search_v6_fine": (["fine_pairs"], f"""SELECT bucket, cls, positives, n, round(best_f1, 6) AS best_f1,
        round(CASE WHEN positives = 0 OR positives = n THEN threshold ELSE greatest(threshold, {floor_case('cls', fv.FINE_FLOORS_V6)}) END, 6) AS threshold
        FROM ({search('SELECT head AS bucket, cls, y, p FROM fine_pairs', 'bucket, cls', 'v6')})"""),
    "threshold_search_v6": (["pairs"], f"""SELECT cls, positives, n, round(best_f1, 6) AS best_f1,
        round(greatest(threshold, {floor_case('cls', fv.COARSE_FLOORS)}), 6) AS threshold FROM ({search('SELECT * FROM pairs', 'cls', 'v6')})"""),
    "explain_topk": (["explained"], "SELECT row_id, explanation FROM explained"),
    "accuracy_macro_f1": (["per_class"], "SELECT split, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM per_class GROUP BY split"),
    "classification_report": (["per_class"], "SELECT split, 'class' AS kind, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class UNION ALL "
                              + " UNION ALL ".join([
                                  by_split_total("accuracy", *["sum(tp) / sum(support)"] * 3),
                                  by_split_total("macro avg", "avg(precision)", "avg(recall)", "avg(f1)"),
                                  by_split_total("weighted avg", *[f"sum({m} * support) / sum(support)" for m in ("precision", "recall", "f1")])])),
    "confusion_long": (["scored"], "SELECT split, true_label AS truth, label AS pred, count(*) AS n FROM scored GROUP BY ALL"),
    "confusion_wide": (["scored"], "SELECT truth, " + ", ".join(f"count(*) FILTER (pred = {lit(c)}) AS {c}" for c in sorted(st.LABELS)) +
                       " FROM (SELECT true_label AS truth, label AS pred FROM scored) GROUP BY truth"),
    "flagged_pct": (["scored"], "SELECT split, count(*) AS total_rows, sum(needs_review::INT)::BIGINT AS flagged, round(avg(needs_review::INT) * 100, 6) AS flagged_pct FROM scored GROUP BY split"),
    "batch_summary": (["scored"], "SELECT coarse_label, label, count(*) AS total_rows, sum(needs_review::INT)::BIGINT AS flagged, grouping(coarse_label, label)::BIGINT AS level FROM scored GROUP BY ROLLUP (coarse_label, label)"),
    "override_impact": (["scored"], """SELECT coalesce(rule, 'none') AS rule, label_raw, label, count(*) AS total_rows,
        count(*) FILTER (label_raw = true_label) AS right_before, count(*) FILTER (label = true_label) AS right_after FROM scored GROUP BY ALL"""),
    "feedback_latest": (["fb_latest"], "SELECT row_id, event_id, status, corrected_label FROM fb_latest"),
    "feedback_join": (["fb_join"], "SELECT * FROM fb_join"),
    "feedback_accuracy": (["fb_join"], """SELECT *, CASE WHEN accepted + corrected > 0 THEN round(accepted / (accepted + corrected), 6) END AS accepted_share FROM (
        SELECT label, count(*) AS total_rows, count(*) FILTER (status = 'Accepted') AS accepted, count(*) FILTER (status = 'Corrected') AS corrected,
          count(*) FILTER (status = 'Not reviewed') AS not_reviewed FROM fb_join GROUP BY label)"""),
    "taxonomy_enrich": (["tx", "tax"], """SELECT row_id, category_id, display_name AS label_name, grp AS label_group, budget_bucket, default_direction, tax_relevant
        FROM tx LEFT JOIN tax ON id = category_id"""),
    "taxonomy_rollup": (["tx", "tax"], """SELECT coalesce(c.parent_id, c.id) AS top_label, coalesce(p.display_name, c.display_name) AS top_name,
        count(*) AS total_rows, sum(amount)::DOUBLE AS amount FROM tx JOIN tax c ON c.id = category_id LEFT JOIN tax p ON p.id = c.parent_id GROUP BY ALL"""),
    "dq_dates": (["dq"], "SELECT row_id, gap::INT AS post_gap_days, gap < 0 AS posted_early, gap >= 7 AS posted_late FROM dq"),
    "dq_amount": (["dq"], "SELECT row_id, low::INT AS low, high::INT AS high, amount < low OR amount > high AS out_of_range, amount <= 25 AS tiny FROM dq"),
    "dq_amount_bands": (["dq"], """
        SELECT row_id, category_id, band, b.low::BIGINT AS low, b.high::BIGINT AS high FROM dq LEFT JOIN LATERAL (
          SELECT * FROM (VALUES ('under', NULL, dq.low), ('lower', dq.low, (dq.low + dq.high) // 2), ('upper', (dq.low + dq.high) // 2, dq.high),
                                ('over', dq.high, NULL)) x(band, low, high)
          WHERE (x.low IS NULL OR amount >= x.low) AND (x.high IS NULL OR amount < x.high)) b ON TRUE"""),
    "hierarchy_rollup": (["o"], """
        SELECT ancestor, count(*) AS total_rows, sum(amount)::DOUBLE AS amount, max(depth)::INT AS depth FROM (
          SELECT c AS ancestor, amount, 1 AS depth FROM o UNION ALL SELECT n, amount, 2 FROM o UNION ALL SELECT r, amount, 3 FROM o
          UNION ALL SELECT 'all', amount, 4 FROM o) GROUP BY ancestor"""),
    "dq_channel": (["dq"], "SELECT row_id, category_id, channel, odd_channel FROM dq"),
    "dq_missing": (["tx"], "SELECT category_id, " + ", ".join(f"count(*) FILTER (trim(coalesce({c}, '')) = '') AS missing_{c}" for c in ("merchant_name", "city", "reference", "keyword_hit")) + " FROM tx GROUP BY 1"),
    "dq_currency": (["tx"], "SELECT row_id, currency FROM tx WHERE currency <> 'INR'"),
    "dq_label_name": (["dq"], "SELECT row_id, category_id, category_display_name, expected_name FROM dq WHERE expected_name IS DISTINCT FROM category_display_name"),
    "dq_direction": (["dq"], """SELECT row_id, dr_cr, label_group, (dr_cr = 'CR') <> (label_group = 'INCOME') AS direction_mismatch,
        dr_cr = 'CR' AND upper(coalesce(narrative, '')) LIKE 'REFUND %' AND category_id <> 'INCOME_REFUNDS' AS unlabelled_refund FROM dq"""),
    "dq_duplicates": (["dq"], "SELECT row_id, transaction_id, copies FROM dq WHERE copies > 1"),
    "dq_summary": (["dq_flags"], "SELECT rule, count(*) AS total_rows FROM dq_flags WHERE rule IS NOT NULL GROUP BY rule"),
    "labelled_counts": (["lines", "toks_lines"], f"""SELECT category_id, label, count(*) AS total_rows, count(DISTINCT normalized) AS distinct_texts,
        sum(hit::INT)::BIGINT AS lexicon_rows, sum(amount)::DOUBLE AS amount FROM (
          SELECT category_id, amount, array_to_string(toks, ' ') AS normalized, {' OR '.join(hit(b) for b in fv.LEXICON)} AS hit,
            coalesce({RULE_LABEL}, category_id) AS label
          FROM (SELECT *, {rule_case("lower(coalesce(narrative, ''))")} AS rule FROM lines) JOIN toks_lines USING (row_id)) GROUP BY ALL"""),
}


def _with(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    return order


def oracle_queries() -> dict[str, str]:
    out = {}
    for name, (needs, select) in ORACLES.items():
        ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in _with(needs))
        out[name] = f"WITH {ctes}\n{select}"
    return out
