"""DuckDB SQL that recomputes every registered query from the same tables.

The statements are built from relational pieces (one SELECT per column, joins on
column names, one UNION branch per check) that share no logic with the
operators, only the fixed word lists and texts.
"""

from __future__ import annotations

from framewitness.catalog.inputs import (
    CASE_PAIRS,
    CASE_TABLES,
    PLANTED_TERMS,
    PLANTED_WORDS,
    STATEMENTS,
    STORED,
    TABLE_NAMES,
    TEXT_TABLES,
)
from framewitness.functions import fixed, wording

ORACLE: dict[str, str] = {}


def _q(text: str | None) -> str:
    return "NULL::VARCHAR" if text is None else "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]::VARCHAR[]"


def _pct(n: str, d: str) -> str:
    share = f"round(({n})::DOUBLE / ({d})::DOUBLE * 100, 2)"
    return f"CASE WHEN ({d}) = 0 THEN 0.0 ELSE {share} END"


def _any(text: str, terms) -> str:
    return f"list_bool_or(list_transform({_list(terms)}, lambda t: contains({text}, t)))"


# --- datasets: relation and columns (name, type, expression) -------------------

_ORDERS = [
    ("o_orderkey", "integer"),
    ("o_custkey", "integer"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "decimal"),
    ("o_orderdate", "datetime"),
    ("o_orderpriority", "string"),
]
_DOCS = [
    ("doc_id", "integer"),
    ("text", "string"),
    ("lang", "string"),
    ("source", "string"),
    ("n_chars", "integer"),
    ("quality", "integer"),
    ("toxic", "integer"),
]
_EVENTS = [
    ("event_id", "integer"),
    ("ts", "datetime"),
    ("user_id", "integer"),
    ("event_type", "string"),
    ("value", "decimal"),
    ("props", "string"),
]
_SPLIT = "TIMESTAMP '1998-01-01 00:00:00'"
_DATASETS = {
    "orders": ("orders", _ORDERS),
    "orders_recent": (f"(FROM orders WHERE o_orderdate >= {_SPLIT})", _ORDERS),
    "orders_earlier": (f"(FROM orders WHERE o_orderdate < {_SPLIT})", _ORDERS),
    "orders_once": ("orders", _ORDERS),
    "orders_again": (
        "(FROM orders UNION ALL (FROM orders WHERE o_orderstatus = 'P'))",
        _ORDERS,
    ),
    "orders_text": (
        "(SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate)"
        " FROM orders)",
        [(n, "string" if n == "o_orderdate" else t) for n, t in _ORDERS],
    ),
    "docs_now": (
        "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN"
        " (FROM labels WHERE toxic = 0) l ON d.doc_id = l.doc_id)",
        _DOCS,
    ),
    "docs_before": (
        "(SELECT d.*, l.quality, l.toxic FROM documents d"
        " LEFT JOIN labels l ON d.doc_id = l.doc_id)",
        _DOCS,
    ),
    "customers": (
        "(SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey,"
        " c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer)",
        [
            ("custkey", "integer"),
            ("name", "string"),
            ("nationkey", "integer"),
            ("acctbal", "decimal"),
            ("mktsegment", "string"),
        ],
    ),
    "suppliers": (
        "(SELECT s_suppkey AS suppkey, s_name AS name,"
        " s_nationkey::VARCHAR AS nationkey, s_acctbal AS acctbal FROM supplier)",
        [
            ("suppkey", "integer"),
            ("name", "string"),
            ("nationkey", "string"),
            ("acctbal", "decimal"),
        ],
    ),
    "customer": (
        "customer",
        [
            ("c_custkey", "integer"),
            ("c_name", "string"),
            ("c_nationkey", "integer"),
            ("c_acctbal", "decimal"),
            ("c_mktsegment", "string"),
        ],
    ),
    "events": ("events", _EVENTS),
    "events_before": ("events", _EVENTS),
    "events_now": ("(FROM events WHERE event_type <> 'error')", _EVENTS),
    "documents": ("documents", _DOCS[:5]),
    "part": (
        "part",
        [
            ("p_partkey", "integer"),
            ("p_name", "string"),
            ("p_brand", "string"),
            ("p_type", "string"),
            ("p_size", "integer"),
            ("p_retailprice", "decimal"),
        ],
    ),
    "lineitem": (
        "lineitem",
        [
            ("l_orderkey", "integer"),
            ("l_partkey", "integer"),
            ("l_suppkey", "integer"),
            ("l_linenumber", "integer"),
            ("l_quantity", "decimal"),
            ("l_extendedprice", "decimal"),
            ("l_discount", "decimal"),
            ("l_tax", "decimal"),
            ("l_returnflag", "string"),
            ("l_linestatus", "string"),
            ("l_shipdate", "datetime"),
        ],
    ),
}

_DATASETS["region"] = ("region", [("r_regionkey", "integer"), ("r_name", "string")])
_DATASETS["lines_wide"] = (
    "(FROM lineitem JOIN part ON l_partkey = p_partkey"
    " JOIN orders ON l_orderkey = o_orderkey)",
    [*_DATASETS["lineitem"][1], *_DATASETS["part"][1], *_ORDERS],
)

_DATE_TEXT = (
    r"[1-9]\d{3}-\d{2}-\d{2}"
    r"([ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?)?"
)


def _column(dataset: str, position: int, name: str, kind: str) -> str:
    relation = _DATASETS[dataset][0]
    number = f"{name}::DOUBLE" if kind in ("integer", "decimal") else "NULL::DOUBLE"
    total = f"sum({name})::DOUBLE" if kind in ("integer", "decimal") else "NULL::DOUBLE"
    moment = "NULL::TIMESTAMP"
    if kind == "datetime":
        moment = f"{name}::TIMESTAMP"
    elif kind == "string":
        guarded = f"CASE WHEN regexp_full_match({name}, '{_DATE_TEXT}') THEN {name} END"
        moment = f"try_cast({guarded} AS TIMESTAMP)"
    length = f"length({name})" if kind == "string" else "NULL::BIGINT"
    return f"""SELECT '{dataset}' AS dataset_id, {position} AS position,
        '{name}' AS column_name, '{kind}' AS base, count(*) AS row_count,
        count({name}) AS non_null_count, count(DISTINCT {name}) AS unique_count,
        min({number}) AS n_min, max({number}) AS n_max, avg({number}) AS n_avg,
        {total} AS n_sum, count({moment}) AS parsed, min({moment}) AS m_min,
        max({moment}) AS m_max, min(({moment})::DATE) AS d_min,
        max(({moment})::DATE) AS d_max, count(DISTINCT ({moment})::DATE) AS d_count,
        min({length}) AS l_min, max({length}) AS l_max, avg({length}) AS l_avg
        FROM {relation} AS r"""


def _iso(moment: str) -> str:
    return f"""CASE WHEN microsecond({moment}) % 1000000 = 0
        THEN strftime({moment}, '%Y-%m-%dT%H:%M:%S')
        ELSE strftime({moment}, '%Y-%m-%dT%H:%M:%S.%f') END"""


def _profile(*datasets: str) -> str:
    """CTEs raw and prof: one row per column of the named datasets."""
    selects = [
        _column(dataset, position, name, kind)
        for dataset in datasets
        for position, (name, kind) in enumerate(_DATASETS[dataset][1])
    ]
    share = _pct("parsed", "non_null_count")
    number = "kind IN ('integer', 'decimal')"
    return f"""raw AS ({' UNION ALL '.join(selects)}),
    kinds AS (SELECT *, row_count - non_null_count AS null_count, {share} AS parse_share,
        CASE WHEN non_null_count = 0 THEN 'empty' WHEN base <> 'string' THEN base
             WHEN {share} >= 80.0 THEN 'datetime' ELSE 'text' END AS kind FROM raw),
    prof AS (SELECT dataset_id, position, column_name, lower(column_name) AS low,
        kind AS inferred_kind, row_count, non_null_count, null_count,
        {_pct('null_count', 'row_count')} AS null_percentage, unique_count,
        {_pct('unique_count', 'non_null_count')} AS unique_percentage,
        greatest(non_null_count - unique_count, 0) AS duplicate_value_count,
        CASE WHEN {number} THEN n_min END AS num_min,
        CASE WHEN {number} THEN n_max END AS num_max,
        CASE WHEN {number} THEN round(n_avg, 2) END AS num_mean,
        CASE WHEN base IN ('integer', 'decimal') THEN coalesce(n_sum, 0.0) END AS total,
        CASE WHEN kind = 'datetime' THEN parsed::DOUBLE END AS dt_parsed_count,
        CASE WHEN kind = 'datetime' THEN parse_share END AS dt_parse_percentage,
        CASE WHEN kind = 'datetime' THEN {_iso('m_min')} END AS dt_min,
        CASE WHEN kind = 'datetime' THEN {_iso('m_max')} END AS dt_max,
        strftime(d_min, '%Y-%m-%d') AS day_min, strftime(d_max, '%Y-%m-%d') AS day_max,
        CASE WHEN parsed > 0 THEN d_count END AS days,
        date_diff('day', d_min, d_max) + 1 AS expected,
        CASE WHEN parsed > 0 THEN greatest(date_diff('day', d_min, d_max) + 1 - d_count, 0)
            END AS missing,
        CASE WHEN kind = 'text' THEN l_min::DOUBLE END AS txt_min_len,
        CASE WHEN kind = 'text' THEN l_max::DOUBLE END AS txt_max_len,
        CASE WHEN kind = 'text' THEN round(l_avg, 2) END AS txt_avg_len FROM kinds)"""


# --- sources and profile ------------------------------------------------------

ORACLE["src_row_counts"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}"
    for name in TABLE_NAMES
)
ORACLE["dataset_shape"] = """SELECT
    (SELECT count(*) FROM orders) AS row_count,
    (SELECT count(*) FROM (DESCRIBE orders)) AS column_count"""


def _typed(table: str, name: str) -> str:
    text = f"{name}::VARCHAR"
    whole = f"regexp_full_match({text}, '[+-]?[0-9]+')"
    return f"""SELECT '{name}' AS column_name,
        CASE WHEN bool_and({whole}) THEN 'bigint'
             WHEN count(try_cast({text} AS DOUBLE)) = count(*) THEN 'double'
             ELSE 'string' END AS inferred_type,
        count({name}) AS non_null_count FROM {table}"""


ORACLE["intake_type_inference"] = " UNION ALL ".join(
    _typed(table, name)
    for table in ("customer", "documents")
    for name, _ in _DATASETS[table][1]
)


def _from_profile(datasets, select: str, rest: str = "") -> str:
    return f"WITH {_profile(*datasets)} SELECT {select} FROM prof {rest}"


ORACLE["profile_nulls"] = _from_profile(
    ["docs_now"],
    "column_name, row_count, non_null_count, null_count, null_percentage",
)
ORACLE["profile_unique"] = _from_profile(
    ["lineitem"], "column_name, non_null_count, unique_count, unique_percentage"
)
ORACLE["profile_duplicates"] = _from_profile(
    ["lineitem"], "column_name, non_null_count, unique_count, duplicate_value_count"
)
ORACLE["profile_kinds"] = _from_profile(
    ["events", "orders_text"], "dataset_id, column_name, inferred_kind"
)
ORACLE["profile_kind_counts"] = _from_profile(
    ["events", "orders_text"],
    "dataset_id, inferred_kind, count(*) AS column_count",
    "GROUP BY ALL",
)
ORACLE["profile_numeric"] = _from_profile(
    ["part"],
    "column_name, num_min, num_max, num_mean, round(total, 2) AS num_total",
    "WHERE inferred_kind IN ('integer', 'decimal')",
)
ORACLE["profile_datetime"] = _from_profile(
    ["events", "orders_text"],
    """dataset_id, column_name, dt_parsed_count::BIGINT AS dt_parsed_count,
    dt_parse_percentage, dt_min, dt_max, days AS dt_day_count,
    expected AS dt_expected_days, missing AS dt_missing_days""",
    "WHERE inferred_kind = 'datetime'",
)
_TAIL = " at the counter of the branch office where the order was received"
_RECEIVED = f"""SELECT strptime(strftime(o_orderdate, '%Y/%m/%d') || '{_TAIL}',
    '%Y/%m/%d{_TAIL}') AS moment FROM orders"""
ORACLE["profile_long_dates"] = f"""
    SELECT asked, 'datetime' AS inferred_kind, count(moment) AS dt_parsed_count,
        strftime(min(moment), '%Y-%m-%dT%H:%M:%S') AS dt_min,
        strftime(max(moment), '%Y-%m-%dT%H:%M:%S') AS dt_max,
        count(DISTINCT moment::DATE) AS dt_day_count,
        datediff('day', min(moment), max(moment)) + 1 - count(DISTINCT moment::DATE)
            AS dt_missing_days
    FROM ({_RECEIVED}), (VALUES ('dates'), ('unique,dates')) v(asked) GROUP BY asked"""
_BIG = "(l_orderkey::HUGEINT + 9007199254740993)"
ORACLE["profile_big_integers"] = " UNION ALL ".join(
    f"""SELECT asked, '{name}' AS column_name, min({of})::VARCHAR AS num_min_exact,
        max({of})::VARCHAR AS num_max_exact, sum({of})::VARCHAR AS num_total_exact
    FROM lineitem, (VALUES ('numeric'), ('unique,numeric')) v(asked) GROUP BY asked"""
    for name, of in (
        ("big", _BIG),
        ("negative", f"-{_BIG}"),
        ("price", "l_extendedprice::DECIMAL(15,2)"),
    )
)
ORACLE["profile_text_length"] = _from_profile(
    ["documents"],
    """column_name, txt_min_len::BIGINT AS txt_min_len,
    txt_max_len::BIGINT AS txt_max_len, txt_avg_len""",
    "WHERE inferred_kind = 'text'",
)
ORACLE["profile_duplicate_names"] = """
    SELECT * FROM (
        SELECT 'id' AS column_name, 2::BIGINT AS occurrences, false AS is_empty_name,
            2 * count(o_orderkey) AS non_null_count FROM orders
        UNION ALL
        SELECT '', 1, true, count(o_totalprice) FROM orders
        UNION ALL
        SELECT ' ', 1, true, count(o_orderdate) FROM orders)"""
_WHOLE = """position, column_name, inferred_kind, row_count, non_null_count, null_count,
    null_percentage, unique_count, unique_percentage, duplicate_value_count, num_min,
    num_max, num_mean, round(total, 2) AS num_total, dt_parsed_count,
    dt_parse_percentage, dt_min, dt_max, day_min, day_max,
    days::DOUBLE AS dt_day_count, expected::DOUBLE AS dt_expected_days,
    missing::DOUBLE AS dt_missing_days, txt_min_len, txt_max_len, txt_avg_len"""
ORACLE["profile_sketches"] = _from_profile(
    ["lineitem", "events", "documents"],
    """dataset_id, column_name, inferred_kind, row_count, null_count, unique_count,
    true AS within_bound, num_min, num_max, dt_min, dt_max,
    CASE WHEN day_min IS NOT NULL THEN days END::BIGINT AS dt_day_count,
    CASE WHEN day_min IS NOT NULL THEN missing END::BIGINT AS dt_missing_days,
    txt_min_len, txt_max_len""",
)
ORACLE["profile_table_lineitem"] = _from_profile(["lineitem"], _WHOLE)
ORACLE["profile_table_events"] = _from_profile(["events"], _WHOLE)
ORACLE["profile_table_docs"] = _from_profile(["docs_now"], _WHOLE)

# --- cases and routing --------------------------------------------------------


def _folded(text: str) -> str:
    """Lower case, and the letters whose folding has ASCII letters."""
    out = f"lower({text})"
    for letter, folded in fixed.FOLDS.items():
        out = f"replace({out}, '{letter}', '{folded}')"
    return out


_FIXED_STATEMENTS = "VALUES " + ", ".join(
    f"({i}, {_q(s)})" for i, s in enumerate(STATEMENTS)
)


def _statements(relation: str = _FIXED_STATEMENTS) -> str:
    """CTEs stmt and routed: every statement with its type, terms and tokens."""
    types = [t for t in fixed.ISSUE_PRECEDENCE if t in fixed.ISSUE_TERMS]
    terms = ", ".join(
        f"({i}, '{t}', {_list(fixed.ISSUE_TERMS[t])})" for i, t in enumerate(types)
    )
    names = ", ".join(f"('{t}', '{n}')" for t, n in fixed.ROUTE_NAMES.items())
    blank = r"[\s\v\x1c-\x1f\x{85}\p{Z}]*"
    return f"""stmt(idx, statement) AS MATERIALIZED ({relation}),
    folds AS MATERIALIZED (SELECT idx, {_folded('statement')} AS folded FROM stmt),
    terms(rank, issue_type, words) AS (VALUES {terms}),
    routes(issue_type, route_name) AS (VALUES {names}),
    hits AS (SELECT idx, rank, issue_type,
        list_filter(words, lambda w: contains(folded, w)) AS found
        FROM folds CROSS JOIN terms WHERE folded IS NOT NULL),
    best AS (SELECT idx, arg_min(issue_type, rank) AS issue_type,
        arg_min(found, rank) AS found FROM hits WHERE len(found) > 0 GROUP BY idx),
    routed AS (SELECT s.idx, s.statement,
        CASE WHEN s.statement IS NULL OR regexp_full_match(s.statement, '{blank}')
                THEN 'missing_issue_statement'
             ELSE coalesce(b.issue_type, 'general_suspected_issue') END AS issue_type,
        coalesce(b.found, []::VARCHAR[]) AS found,
        list_sort(list_distinct(list_filter(
            regexp_extract_all(coalesce(f.folded, ''), '[a-z0-9]+'),
            lambda w: NOT list_contains({_list(fixed.STOP_WORDS)}, w)))) AS tokens
        FROM stmt s JOIN folds f USING (idx) LEFT JOIN best b USING (idx))"""


def _cases() -> str:
    """CTE cases: one row per event."""
    pairs = ", ".join(
        f"({_q(event)}, {_q(a)}, {_q(b)})" for event, (a, b) in CASE_TABLES.items()
    )
    return f"""chosen(event_type, ds, bs) AS (VALUES {pairs}),
    cases AS (SELECT e.event_id AS case_id, r.*, n.route_name, c.ds, c.bs
        FROM events e JOIN chosen c USING (event_type)
        JOIN routed r ON r.idx = e.event_id % {len(STATEMENTS)}
        JOIN routes n USING (issue_type))"""


def _marked() -> str:
    """The texts of inputs.marked_texts and what they are."""
    every = """SELECT 'd' || doc_id AS case_id, doc_id AS number, lang AS made_of, text
            FROM documents UNION ALL
        SELECT 'c' || conv_id || '/' || turn, conv_id * 7 + turn, role, text
            FROM conversations"""
    term = f"({_list(PLANTED_TERMS)})[number % {len(PLANTED_TERMS)} + 1]"
    words = f"({_list(PLANTED_WORDS)})[number % {len(PLANTED_WORDS)} + 1]"
    planted = f"""left(text, length(text) // 2) || ' ' || {term} || ' ' || {words}
        || substr(text, length(text) // 2 + 1)"""
    return f"""SELECT case_id, made_of,
        CASE WHEN number % 5 = 0 THEN text ELSE {planted} END AS statement FROM ({every})"""


def _text_cases() -> str:
    """CTE cases: one row per text."""
    pairs = ", ".join(
        f"({_q(kind)}, {_q(a)}, {_q(b)})" for kind, (a, b) in TEXT_TABLES.items()
    )
    return f"""chosen(made_of, ds, bs) AS (VALUES {pairs}),
    cases AS (SELECT m.case_id, r.*, n.route_name, c.ds, c.bs
        FROM marked m LEFT JOIN chosen c USING (made_of)
        JOIN routed r ON r.idx = m.case_id JOIN routes n USING (issue_type))"""


def _text_routing() -> str:
    statements = _statements("SELECT case_id, statement FROM marked")
    return f"marked AS MATERIALIZED ({_marked()}), {statements}, {_text_cases()}"


_ROUTED_TEXT = """r.issue_type, route_name,
    CASE WHEN r.issue_type = 'missing_issue_statement' THEN r.issue_type
         ELSE 'classified_for_planning' END AS classification_status,
    array_to_string(found, ',') AS terms, len(tokens) AS token_count,
    md5(array_to_string(tokens, ' ')) AS tokens_md5"""


def _routing(select: str) -> str:
    return f"WITH {_statements()}, {_cases()} {select}"


ORACLE["route_issues"] = _routing(
    """SELECT case_id, issue_type, route_name,
    CASE WHEN issue_type = 'missing_issue_statement' THEN issue_type
         ELSE 'classified_for_planning' END AS classification_status FROM cases"""
)
ORACLE["route_matched_terms"] = _routing(
    """SELECT coalesce(statement, '(none)') AS statement, issue_type,
    array_to_string(found, ',') AS terms, count(*) AS case_count
    FROM cases GROUP BY ALL"""
)
ORACLE["route_issue_tokens"] = _routing(
    """SELECT coalesce(statement, '(none)') AS statement,
    array_to_string(tokens, ',') AS tokens, count(*) AS case_count
    FROM cases GROUP BY ALL"""
)

ORACLE["route_documents"] = f"""WITH {_statements("SELECT doc_id, text FROM documents")}
    SELECT idx AS doc_id, {_ROUTED_TEXT} FROM routed r JOIN routes USING (issue_type)"""
_TURNS = "SELECT {'conv': conv_id, 'turn': turn}, text FROM conversations"
ORACLE["route_conversations"] = f"""WITH {_statements(_TURNS)}
    SELECT idx.conv AS conv_id, idx.turn AS turn, {_ROUTED_TEXT}
    FROM routed r JOIN routes USING (issue_type)"""
ORACLE["route_marked_texts"] = f"""WITH {_text_routing()}
    SELECT case_id, {_ROUTED_TEXT} FROM cases r"""

_CASE_DATASETS = sorted({name for pair in CASE_PAIRS for name in pair})


def _candidates() -> str:
    """CTEs combos and cand: candidate columns of each statement and table."""
    return f"""combos AS (SELECT DISTINCT idx, issue_type, tokens, ds, bs FROM cases),
    cand AS (SELECT c.idx, c.issue_type, c.ds, c.bs, p.* FROM combos c
        JOIN prof p ON p.dataset_id = c.ds WHERE CASE c.issue_type
            WHEN 'duplicate_key' THEN {_any('p.low', fixed.KEY_TERMS)}
            WHEN 'date_gap' THEN p.inferred_kind = 'datetime'
                OR {_any('p.low', fixed.DATE_TERMS)}
            WHEN 'category_shift' THEN {_any('p.low', fixed.CATEGORY_TERMS)}
            WHEN 'total_change' THEN p.inferred_kind IN ('integer', 'decimal')
                OR {_any('p.low', fixed.TOTAL_TERMS)}
            WHEN 'null_increase' THEN _MENTION_
            WHEN 'schema_change' THEN _MENTION_
            ELSE false END)""".replace(
        "_MENTION_",
        """(list_has_any(regexp_extract_all(p.low, '[a-z0-9]+'), c.tokens) OR
            contains(array_to_string(c.tokens, ' '), replace(p.low, '_', ' ')))""",
    )


def _world(select: str, *extra: str, cases: str | None = None) -> str:
    cases = cases or f"{_statements()}, {_cases()}"
    parts = [cases, _profile(*_CASE_DATASETS), _candidates(), *extra]
    return f"WITH {', '.join(parts)} {select}"


ORACLE["candidate_columns"] = _world(
    """SELECT d.ds AS dataset_id, d.issue_type, d.position, d.column_name,
    count(*) AS case_count FROM cases c JOIN cand d
    ON c.idx = d.idx AND c.ds = d.ds AND c.bs IS NOT DISTINCT FROM d.bs GROUP BY ALL"""
)


ORACLE["candidate_columns_texts"] = _world(
    """SELECT c.case_id, d.ds AS dataset_id, d.issue_type, d.position, d.column_name
    FROM cases c JOIN cand d
    ON c.idx = d.idx AND c.ds = d.ds AND c.bs IS NOT DISTINCT FROM d.bs""",
    cases=_text_routing(),
)


def _plan() -> str:
    """CTE planned: the fixed check table."""
    rows = []
    for issue_type, planned in fixed.PLANNED_CHECKS.items():
        for n, (check, baseline, raw) in enumerate(planned, start=1):
            profile = check != fixed.NO_PROFILE_CHECK
            executed = _q(fixed.PLANNED_TO_EXECUTED.get(check))
            rows.append(
                f"('{issue_type}', {n}, '{check}', {baseline}, {raw}, {profile}, {executed})"
            )
    return f"""planned(issue_type, check_ordinal, check_id, requires_baseline,
        requires_raw_dataset, requires_dataset_profile, executed_as)
        AS (VALUES {', '.join(rows)})"""


ORACLE["planned_checks"] = f"""WITH {_statements()}, {_cases()}, {_plan()}
    SELECT issue_type, bs IS NOT NULL AS baseline_available, check_ordinal, check_id,
        requires_baseline, requires_raw_dataset, requires_dataset_profile,
        NOT requires_baseline OR bs IS NOT NULL AS executable,
        CASE WHEN requires_baseline THEN 'baseline_comparison'
             ELSE 'current_dataset_checks' END AS stage, count(*) AS case_count
    FROM cases JOIN planned USING (issue_type) GROUP BY ALL"""
_PROMPTS = ", ".join(
    f"('{t}', {n})"
    for t, prompts in wording.REVIEW_PROMPTS.items()
    for n in range(1, len(prompts) + 1)
)
ORACLE["review_prompts"] = f"""WITH {_statements()}, {_cases()},
    prompts(issue_type, prompt_ordinal) AS (VALUES {_PROMPTS})
    SELECT issue_type, prompt_ordinal, count(*) AS case_count
    FROM cases JOIN prompts USING (issue_type) GROUP BY ALL"""
ORACLE["plan_inputs"] = _routing(
    """SELECT issue_type, bs IS NOT NULL AS baseline_available,
    concat_ws(',', CASE WHEN issue_type <> 'missing_issue_statement'
            THEN 'issue statement' END,
        CASE WHEN ds IS NOT NULL THEN 'current dataset profile' END,
        CASE WHEN bs IS NOT NULL THEN 'baseline dataset' END) AS available,
    concat_ws(',', CASE WHEN issue_type = 'missing_issue_statement'
            THEN 'issue statement' END,
        CASE WHEN bs IS NULL THEN 'baseline dataset or prior-run artifact' END)
        AS missing, count(*) AS case_count FROM cases GROUP BY ALL"""
)

# --- comparison ---------------------------------------------------------------


def _compare(pairs) -> str:
    """CTEs over pairs: m (columns matched by name) and one CTE per section."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    number = "IN ('integer', 'decimal')"
    category = "IN ('text', 'boolean')"
    cs, bs = _pct("c.unique_count", "c.row_count"), _pct("b.unique_count", "b.row_count")

    def changed(section: str, condition: str) -> str:
        return f"{section} AS (SELECT * FROM m WHERE {condition})"

    return f"""pairs(ds, bs) AS (VALUES {values}),
    cu AS (SELECT ds, bs, p.* FROM pairs JOIN prof p ON p.dataset_id = ds),
    ba AS (SELECT ds, bs, p.* FROM pairs JOIN prof p ON p.dataset_id = bs),
    m AS (SELECT coalesce(c.ds, b.ds) AS ds, coalesce(c.bs, b.bs) AS bs,
        coalesce(c.column_name, b.column_name) AS column_name,
        c.column_name IS NOT NULL AS in_c, b.column_name IS NOT NULL AS in_b,
        c.inferred_kind AS ck, b.inferred_kind AS bk,
        c.null_count AS cn, b.null_count AS bn,
        c.null_percentage AS cnp, b.null_percentage AS bnp,
        round(c.null_percentage - b.null_percentage, 2) AS dnull,
        c.total AS ct, b.total AS bt,
        CASE WHEN c.inferred_kind {number} AND b.inferred_kind {number}
            THEN round(c.total - b.total, 2) END AS dnum,
        c.day_min AS cmin, c.day_max AS cmax, b.day_min AS bmin, b.day_max AS bmax,
        c.missing AS cmiss, b.missing AS bmiss,
        CASE WHEN c.inferred_kind = 'datetime' AND b.inferred_kind = 'datetime'
            THEN c.missing - b.missing END AS dmiss,
        CASE WHEN c.inferred_kind = 'datetime' AND b.inferred_kind = 'datetime'
            THEN c.day_min <> b.day_min OR c.day_max <> b.day_max END AS drange,
        c.unique_count AS cuq, b.unique_count AS buq, {cs} AS cshare, {bs} AS bshare,
        CASE WHEN c.inferred_kind {category} AND b.inferred_kind {category}
            AND {cs} <= 50.0 AND {bs} <= 50.0
            THEN c.unique_count - b.unique_count END AS duq,
        c.duplicate_value_count AS cd, b.duplicate_value_count AS bd,
        CASE WHEN {_any('c.low', fixed.KEY_TERMS)}
            THEN c.duplicate_value_count - b.duplicate_value_count END AS ddup
        FROM cu c FULL JOIN ba b
        ON c.ds = b.ds AND c.bs = b.bs AND c.column_name = b.column_name),
    {changed('top_null', 'dnull <> 0')},
    {changed('top_num', 'dnum <> 0')},
    {changed('top_date', 'drange OR dmiss <> 0')},
    {changed('top_cat', 'duq <> 0')},
    {changed('top_dup', 'ddup <> 0')},
    sums AS (SELECT dataset_id, max(row_count) AS n, count(*) AS cols,
        sum(null_count)::BIGINT AS nulls, count(*) FILTER (null_count > 0) AS null_cols,
        count(*) FILTER (inferred_kind {number}) AS numbers,
        count(*) FILTER (inferred_kind = 'datetime') AS dates,
        count(*) FILTER (inferred_kind = 'text') AS texts FROM prof GROUP BY 1),
    sect AS (SELECT ds, bs,
        array_to_string(list(column_name ORDER BY column_name)
            FILTER (NOT in_b), ',') AS added,
        array_to_string(list(column_name ORDER BY column_name)
            FILTER (NOT in_c), ',') AS removed,
        count(*) FILTER (NOT in_b) AS n_added, count(*) FILTER (NOT in_c) AS n_removed,
        count(*) FILTER (in_c AND in_b) AS shared,
        count(*) FILTER (ck <> bk) AS kind_changes,
        count(*) FILTER (dnull > 0) AS null_up, count(*) FILTER (dnull < 0) AS null_down,
        coalesce(max(abs(dnull)), 0.0) AS null_max,
        count(dnum) AS num_n, count(*) FILTER (dnum <> 0) AS num_delta,
        coalesce(max(abs(dnum)), 0.0) AS num_max,
        count(drange) AS date_n, count(*) FILTER (drange) AS date_range,
        count(*) FILTER (dmiss <> 0) AS date_delta,
        count(duq) AS cat_n, count(*) FILTER (duq <> 0) AS cat_delta,
        coalesce(max(abs(duq)), 0) AS cat_max,
        count(ddup) AS dup_n, count(*) FILTER (ddup > 0) AS dup_up,
        coalesce(max(abs(ddup)), 0) AS dup_max
        FROM m GROUP BY ds, bs),
    cmp AS (SELECT s.*, c.n AS c_rows, b.n AS b_rows, c.n - b.n AS d_rows,
        c.cols AS c_cols, b.cols AS b_cols, c.cols - b.cols AS d_cols,
        c.nulls - b.nulls AS d_nulls, c.numbers - b.numbers AS d_numbers,
        c.dates - b.dates AS d_dates, c.texts - b.texts AS d_texts,
        n_added + n_removed + kind_changes + null_up + null_down AS signals
        FROM sect s JOIN sums c ON c.dataset_id = s.ds JOIN sums b ON b.dataset_id = s.bs)"""


def _pair(a: str, b: str, select: str) -> str:
    return f"WITH {_profile(a, b)}, {_compare([(a, b)])} {select}"


_O, _D, _P, _E, _R, _W = (
    ("orders_recent", "orders_earlier"),
    ("docs_now", "docs_before"),
    ("customers", "suppliers"),
    ("events_now", "events_before"),
    ("orders_again", "orders_once"),
    ("lines_wide", "region"),
)
ORACLE["cmp_row_count"] = _pair(
    *_O,
    f"""SELECT ds AS current_id, bs AS baseline_id, c_rows AS current,
    b_rows AS baseline, d_rows AS delta, {_pct('d_rows', 'b_rows')} AS delta_percentage
    FROM cmp""",
)
ORACLE["cmp_column_count"] = _pair(
    *_P,
    f"""SELECT c_rows AS current_rows, b_rows AS baseline_rows, c_cols AS current,
    b_cols AS baseline, d_cols AS delta, {_pct('d_cols', 'b_cols')} AS delta_percentage
    FROM cmp""",
)
_SCHEMA = """SELECT c_cols AS current_column_count, b_cols AS baseline_column_count, added,
    removed, shared AS shared_count, kind_changes AS kind_change_count,
    0::BIGINT AS current_duplicate_names, 0::BIGINT AS baseline_duplicate_names,
    0::BIGINT AS current_empty_names, 0::BIGINT AS baseline_empty_names FROM cmp"""
ORACLE["cmp_schema"] = _pair(*_P, _SCHEMA)
ORACLE["cmp_schema_wide"] = _pair(*_W, _SCHEMA)
ORACLE["cmp_kind_changes"] = _pair(
    *_P,
    """SELECT column_name, ck AS current_kind, bk AS baseline_kind FROM m
    WHERE ck <> bk""",
)
ORACLE["cmp_nulls"] = _pair(
    *_D,
    """SELECT column_name, cn AS current_null_count, bn AS baseline_null_count,
    cnp AS current_null_percentage, bnp AS baseline_null_percentage,
    dnull AS delta_percentage FROM top_null""",
)
ORACLE["cmp_nulls_summary"] = _pair(
    *_D,
    """SELECT shared AS columns_compared, null_up AS columns_higher,
    null_down AS columns_lower, null_max AS max_absolute_delta FROM cmp""",
)
ORACLE["cmp_numeric"] = _pair(
    *_O,
    f"""SELECT column_name, round(ct, 2) AS current_total, round(bt, 2) AS baseline_total,
    dnum AS delta, {_pct('dnum', 'bt')} AS delta_percentage FROM top_num""",
)
ORACLE["cmp_numeric_summary"] = _pair(
    *_O,
    """SELECT num_n AS columns_compared, num_delta AS columns_with_delta,
    num_max AS max_absolute_delta FROM cmp""",
)
ORACLE["cmp_dates"] = _pair(
    *_O,
    """SELECT column_name, cmin AS current_min_date, cmax AS current_max_date,
    bmin AS baseline_min_date, bmax AS baseline_max_date,
    cmiss AS current_missing_days, bmiss AS baseline_missing_days,
    dmiss AS missing_days_delta, drange AS range_changed FROM top_date""",
)
ORACLE["cmp_category_shape"] = _pair(
    *_E,
    """SELECT column_name, cuq AS current_unique_count, buq AS baseline_unique_count,
    duq AS unique_count_delta, cshare AS current_unique_percentage,
    bshare AS baseline_unique_percentage,
    round(cshare - bshare, 2) AS unique_percentage_delta,
    cshare > 50.0 AS current_high_cardinality,
    bshare > 50.0 AS baseline_high_cardinality FROM top_cat""",
)
ORACLE["cmp_duplicates"] = _pair(
    *_R,
    """SELECT column_name, cd AS current_duplicate_count, bd AS baseline_duplicate_count,
    ddup AS duplicate_count_delta FROM top_dup""",
)
_GENERAL = """d_rows AS row_count_delta, d_cols AS column_count_delta,
    d_nulls AS total_null_cell_delta, d_numbers AS numeric_column_count_delta,
    d_dates AS datetime_column_count_delta, d_texts AS text_column_count_delta,
    0::BIGINT AS duplicate_column_name_count_delta,
    0::BIGINT AS empty_column_name_count_delta"""
ORACLE["cmp_general"] = _pair(*_P, f"SELECT {_GENERAL} FROM cmp")
_SIGNAL_COUNTS = """SELECT d_rows AS row_delta, signals AS signal_count,
    shared AS compared_column_count FROM cmp"""
ORACLE["cmp_signal_count"] = _pair(*_P, _SIGNAL_COUNTS)
ORACLE["cmp_signal_count_wide"] = _pair(*_W, _SIGNAL_COUNTS)

# --- evidence -----------------------------------------------------------------


def _assessed() -> str:
    """CTEs ass (assessed columns with fallbacks) and w (their wide measures)."""
    category = f"""({_any('p.low', fixed.CATEGORY_TERMS)} OR (p.inferred_kind = 'text'
        AND {_pct('p.unique_count', 'p.row_count')} <= 50.0))"""
    return f"""tally AS (SELECT c.idx, c.issue_type, c.ds, c.bs, count(d.position) AS n
        FROM combos c LEFT JOIN cand d ON c.idx = d.idx AND c.ds = d.ds
            AND c.bs IS NOT DISTINCT FROM d.bs WHERE c.ds IS NOT NULL GROUP BY ALL),
    dated AS (SELECT dataset_id, count(*) FILTER (inferred_kind = 'datetime') AS k
        FROM prof GROUP BY 1),
    ass AS (SELECT t.idx, t.issue_type, t.ds, t.bs, t.n, p.* FROM tally t
        JOIN prof p ON p.dataset_id = t.ds JOIN dated k ON k.dataset_id = t.ds
        LEFT JOIN cand d ON t.idx = d.idx AND t.ds = d.ds
            AND t.bs IS NOT DISTINCT FROM d.bs AND d.position = p.position
        WHERE CASE WHEN t.issue_type = 'total_change' AND p.total IS NULL THEN false
            WHEN t.n > 0 THEN d.position IS NOT NULL
            WHEN t.issue_type = 'duplicate_key' THEN {_any('p.low', fixed.KEY_TERMS)}
            WHEN t.issue_type = 'null_increase' THEN true
            WHEN t.issue_type = 'date_gap' AND k.k > 0 THEN p.inferred_kind = 'datetime'
            WHEN t.issue_type = 'date_gap' THEN {_any('p.low', fixed.DATE_TERMS)}
            WHEN t.issue_type = 'total_change'
                THEN p.inferred_kind IN ('integer', 'decimal')
            WHEN t.issue_type = 'category_shift' THEN {category}
            ELSE false END),
    w AS (SELECT t.idx, t.issue_type, t.ds, t.bs, t.n AS n_cand, u.*, g.*, a.*,
        c.* EXCLUDE (ds, bs), c.ds IS NOT NULL AS has_b
        FROM tally t JOIN sums u ON u.dataset_id = t.ds
        LEFT JOIN (SELECT idx AS g_idx, ds AS g_ds, bs AS g_bs,
            string_agg(column_name, ',' ORDER BY position) AS cand_names
            FROM cand GROUP BY ALL) g
            ON g_idx = t.idx AND g_ds = t.ds AND g_bs IS NOT DISTINCT FROM t.bs
        LEFT JOIN (SELECT idx AS a_idx, ds AS a_ds, bs AS a_bs, count(*) AS n_ass,
            count(*) FILTER (duplicate_value_count > 0) AS dup_cols,
            max(duplicate_value_count) AS dup_top,
            string_agg(column_name, ',' ORDER BY position)
                FILTER (duplicate_value_count > 0) AS dup_names,
            count(*) FILTER (null_count > 0) AS nul_cols, max(null_count) AS nul_top,
            sum(null_count)::BIGINT AS nul_sum,
            string_agg(column_name, ',' ORDER BY position)
                FILTER (null_count > 0) AS nul_names,
            count(day_min) AS parsed, min(day_min) AS day_first, max(day_max) AS day_last,
            sum(days)::BIGINT AS seen, sum(expected) FILTER (day_min IS NOT NULL)::BIGINT
                AS due, sum(missing)::BIGINT AS gone,
            string_agg(column_name, ',' ORDER BY position)
                FILTER (day_min IS NOT NULL) AS day_names,
            round(min(total), 2) AS sum_low, round(max(total), 2) AS sum_high,
            string_agg(column_name, ',' ORDER BY position) AS ass_names,
            max(unique_count) AS uq_top FROM ass GROUP BY ALL) a
            ON a_idx = t.idx AND a_ds = t.ds AND a_bs IS NOT DISTINCT FROM t.bs
        LEFT JOIN cmp c ON c.ds = t.ds AND c.bs = t.bs)"""


def _names_of(section: str, order: str) -> str:
    return f"""(SELECT string_agg(column_name, ',' ORDER BY {order} column_name)
        FROM {section} x WHERE x.ds = w.ds AND x.bs = w.bs)"""


# check id -> (issue type, is baseline, present, medium, otherwise, related, metrics)
_Z = "coalesce({}, 0)".format
_HIGH = "({share}) > 50.0".format(share=_pct(_Z("uq_top"), "w.n"))
_ITEMS = {
    "duplicate_key_summary": (
        "duplicate_key", 1, "coalesce(dup_cols, 0) > 0", True, "absent", "dup_names",
        [
            ("candidate_column_count", _Z("n_ass")),
            ("columns_with_duplicate_non_null_values", _Z("dup_cols")),
            ("max_duplicate_value_count", _Z("dup_top")),
            ("max_duplicate_value_percentage", _pct(_Z("dup_top"), "w.n")),
        ],
    ),
    "key_null_summary": (
        "duplicate_key", 2, "coalesce(nul_cols, 0) > 0", True, "absent", "nul_names",
        [
            ("candidate_column_count", _Z("n_ass")),
            ("columns_with_null_values", _Z("nul_cols")),
            ("max_null_count", _Z("nul_top")),
            ("max_null_percentage", _pct(_Z("nul_top"), "w.n")),
        ],
    ),
    "current_null_summary": (
        "null_increase", 1, "coalesce(nul_sum, 0) > 0", True, "absent", "nul_names",
        [
            ("assessed_column_count", _Z("n_ass")),
            ("columns_with_nulls", _Z("nul_cols")),
            ("max_null_count", _Z("nul_top")),
            ("max_null_percentage", _pct(_Z("nul_top"), "w.n")),
            ("total_null_cells", _Z("nul_sum")),
            ("total_cells_assessed", "w.n * coalesce(n_ass, 0)"),
        ],
    ),
    "date_range_summary": (
        "date_gap", 1, "coalesce(parsed, 0) > 0", False, "unclear", "day_names",
        [
            ("assessed_date_column_count", _Z("n_ass")),
            ("parsed_date_column_count", _Z("parsed")),
            ("min_date", "text:day_first"),
            ("max_date", "text:day_last"),
            ("observed_unique_date_count", _Z("seen")),
            ("expected_daily_date_count", _Z("due")),
            ("missing_daily_period_count", _Z("gone")),
        ],
    ),
    "date_gap_summary": (
        "date_gap", 2, "coalesce(gone, 0) > 0", True, "absent", "day_names", None,
    ),
    "numeric_total_summary": (
        "total_change", 1, "coalesce(n_ass, 0) > 0", False, "unclear", "ass_names",
        [
            ("assessed_numeric_column_count", _Z("n_ass")),
            ("numeric_columns_with_totals", _Z("n_ass")),
            ("min_column_total", "sum_low"),
            ("max_column_total", "sum_high"),
        ],
    ),
    "row_count_summary": (
        "total_change", 2, "true", False, "absent", "NULL", [("row_count", "w.n")],
    ),
    "current_schema_summary": (
        "schema_change", 1, "true", False, "absent", "cand_names",
        [
            ("column_count", "cols"),
            ("duplicate_column_name_count", "0::BIGINT"),
            ("empty_column_name_count", "0::BIGINT"),
            ("candidate_column_count", "n_cand"),
        ],
    ),
    "categorical_shape_summary": (
        "category_shift", 1, "coalesce(n_ass, 0) > 0", False, "unclear", "ass_names",
        [
            ("assessed_categorical_column_count", _Z("n_ass")),
            ("columns_assessed_count", _Z("n_ass")),
            ("max_unique_count", _Z("uq_top")),
            ("max_unique_percentage", _pct(_Z("uq_top"), "w.n")),
            (
                "any_candidate_categorical_column_has_high_cardinality",
                f"text:CASE WHEN {_HIGH} THEN 'true' ELSE 'false' END",
            ),
        ],
    ),
    "general_profile_signal_summary": (
        "general_suspected_issue", 1, "true", False, "absent", "NULL",
        [
            ("row_count", "w.n"),
            ("column_count", "cols"),
            ("total_null_cells", "nulls"),
            ("columns_with_nulls", "null_cols"),
            ("numeric_column_count", "numbers"),
            ("datetime_column_count", "dates"),
            ("text_column_count", "texts"),
            ("duplicate_column_name_count", "0::BIGINT"),
            ("empty_column_name_count", "0::BIGINT"),
        ],
    ),
    "baseline_duplicate_comparison": (
        "duplicate_key", 3, "dup_up > 0", True, "absent",
        _names_of("top_dup", "abs(ddup) DESC,"),
        [
            ("candidate_columns_compared", "dup_n"),
            ("columns_with_higher_duplicate_count", "dup_up"),
            ("max_duplicate_count_delta", "dup_max"),
        ],
    ),
    "baseline_null_comparison": (
        "null_increase", 2, "null_up > 0", True, "absent",
        _names_of("top_null", "abs(dnull) DESC,"),
        [
            ("columns_compared", "shared"),
            ("columns_with_higher_null_percentage", "null_up"),
            ("columns_with_lower_null_percentage", "null_down"),
            ("max_null_percentage_delta", "null_max"),
        ],
    ),
    "baseline_date_comparison": (
        "date_gap", 3, "date_delta > 0", True, "absent", _names_of("top_date", ""),
        [
            ("columns_compared", "date_n"),
            ("columns_with_range_change", "date_range"),
            ("columns_with_missing_daily_period_delta", "date_delta"),
            ("daily_cadence_assumption", "text:'true'"),
        ],
    ),
    "baseline_total_comparison": (
        "total_change", 3, "num_delta > 0 OR d_rows <> 0", True, "absent",
        _names_of("top_num", "abs(dnum) DESC,"),
        [
            ("current_row_count", "c_rows"),
            ("baseline_row_count", "b_rows"),
            ("row_count_delta", "d_rows"),
            ("numeric_columns_compared", "num_n"),
            ("columns_with_total_delta", "num_delta"),
            ("max_absolute_total_delta", "num_max"),
        ],
    ),
    "baseline_schema_comparison": (
        "schema_change", 2, "n_added + n_removed + kind_changes > 0",
        "n_added + n_removed > 0", "absent",
        "nullif(concat_ws(',', nullif(added, ''), nullif(removed, '')), '')",
        [
            ("current_column_count", "c_cols"),
            ("baseline_column_count", "b_cols"),
            ("shared_column_count", "shared"),
            ("inferred_kind_change_count", "kind_changes"),
        ],
    ),
    "baseline_category_shape_comparison": (
        "category_shift", 2, "cat_delta > 0", True, "absent",
        _names_of("top_cat", "abs(duq) DESC,"),
        [
            ("columns_compared", "cat_n"),
            ("columns_with_unique_count_delta", "cat_delta"),
            ("max_unique_count_delta", "cat_max"),
            ("columns_with_high_cardinality_signal_delta", "0::BIGINT"),
        ],
    ),
    "baseline_general_summary": (
        "general_suspected_issue", 2, "true", False, "absent", "NULL",
        [
            ("row_count_delta", "d_rows"),
            ("column_count_delta", "d_cols"),
            ("total_null_cell_delta", "d_nulls"),
            ("numeric_column_count_delta", "d_numbers"),
            ("datetime_column_count_delta", "d_dates"),
            ("text_column_count_delta", "d_texts"),
            ("duplicate_column_name_count_delta", "0::BIGINT"),
            ("empty_column_name_count_delta", "0::BIGINT"),
        ],
    ),
}


def _metrics(check: str):
    found = _ITEMS[check][6]
    return _ITEMS["date_range_summary"][6] if found is None else found


def _signal(check: str) -> str:
    """signal, signal_strength and related_columns of one check."""
    _, _, present, medium, otherwise, related, _ = _ITEMS[check]
    strong = present if medium is True else medium if medium else "false"
    return f"""'{check}' AS check_id,
        CASE WHEN {present} THEN 'present' ELSE '{otherwise}' END AS signal,
        CASE WHEN {strong} THEN 'medium' ELSE 'low' END AS signal_strength,
        coalesce({related}, '') AS related_columns"""


def _evidence() -> str:
    """CTE ev: one row per statement, table pair and evidence item."""
    branches = []
    for check, (issue_type, ordinal, *_rest) in _ITEMS.items():
        having = "AND has_b" if check.startswith("baseline_") else ""
        branches.append(
            f"""SELECT idx, ds, bs, {ordinal} AS ordinal, {_signal(check)} FROM w
            WHERE issue_type = '{issue_type}' {having}"""
        )
    return f"""ev AS (SELECT *, format('ev-{{:03d}}', ordinal) AS evidence_id
        FROM ({' UNION ALL '.join(branches)}))"""


def _joined_cases(other: str) -> str:
    return f"""cases c JOIN {other} x ON c.idx = x.idx AND c.ds = x.ds
        AND c.bs IS NOT DISTINCT FROM x.bs"""


def _ledger(select: str, *extra: str, cases: str | None = None) -> str:
    more = [_compare(CASE_PAIRS), _assessed(), _evidence(), *extra]
    return _world(select, *more, cases=cases)


def _single(dataset: str, check: str, outputs: str, candidates: str = "false") -> str:
    """One current-table check on one table; w has the single row."""
    issue_type = _ITEMS[check][0]
    return f"""WITH {_profile(dataset)},
    combos AS (SELECT 0 AS idx, '{issue_type}' AS issue_type, '{dataset}' AS ds,
        NULL::VARCHAR AS bs),
    cand AS (SELECT c.idx, c.issue_type, c.ds, c.bs, p.* FROM combos c
        JOIN prof p ON p.dataset_id = c.ds WHERE {candidates}),
    {_compare([(dataset, dataset)])}, {_assessed()}
    SELECT {_signal(check)}, {outputs} FROM w"""


_KEYS = _any("p.low", fixed.KEY_TERMS)


def _measures(check: str, *names: str) -> str:
    parts = []
    for (_, value), name in zip(_metrics(check), names):
        parts.append(f"({value.removeprefix('text:')}) AS {name}")
    return ", ".join(parts)


ORACLE["check_duplicate_keys"] = _single(
    "lineitem",
    "duplicate_key_summary",
    _measures(
        "duplicate_key_summary",
        "candidate_column_count", "affected_columns", "max_count", "max_percentage",
    ),
    _KEYS,
)
ORACLE["check_key_nulls"] = _single(
    "lineitem",
    "key_null_summary",
    _measures(
        "key_null_summary",
        "candidate_column_count", "affected_columns", "max_count", "max_percentage",
    ),
    _KEYS,
)
ORACLE["check_current_nulls"] = _single(
    "docs_now",
    "current_null_summary",
    _measures(
        "current_null_summary",
        "assessed", "with_nulls", "max_null_count", "max_null_percentage",
        "total_null_cells", "total_cells",
    ),
)
for _name, _check in (
    ("check_date_range", "date_range_summary"),
    ("check_date_gaps", "date_gap_summary"),
):
    ORACLE[_name] = _single(
        "orders",
        _check,
        _measures(
            _check,
            "assessed", "parsed", "min_date", "max_date", "observed_days",
            "expected_days", "missing_days",
        ),
        "p.inferred_kind = 'datetime'",
    )
ORACLE["check_numeric_totals"] = _single(
    "orders",
    "numeric_total_summary",
    _measures(
        "numeric_total_summary", "assessed", "with_totals", "min_total", "max_total"
    ),
    "p.total IS NOT NULL",
)
ORACLE["check_row_count"] = f"""SELECT * EXCLUDE (related_columns) FROM
    ({_single('orders', 'row_count_summary', 'w.n AS row_count', 'p.total IS NOT NULL')})"""
ORACLE["check_schema"] = _single(
    "customer",
    "current_schema_summary",
    """cols AS column_count, 0::BIGINT AS duplicate_names, 0::BIGINT AS empty_names,
    n_cand AS candidate_columns,
    (SELECT count(*) FROM prof WHERE inferred_kind = 'integer') AS integer_columns,
    (SELECT count(*) FROM prof WHERE inferred_kind = 'decimal') AS decimal_columns,
    dates AS datetime_columns, texts AS text_columns,
    (SELECT count(*) FROM prof WHERE inferred_kind = 'boolean') AS boolean_columns""",
    "p.low LIKE '%acctbal%'",
)
ORACLE["check_category_shape"] = _single(
    "orders",
    "categorical_shape_summary",
    f"""{_Z('n_ass')} AS assessed, {_Z('uq_top')} AS max_unique,
    {_pct(_Z('uq_top'), 'w.n')} AS max_unique_percentage,
    CASE WHEN {_HIGH} THEN 'true' ELSE 'false' END AS high_cardinality""",
    _any("p.low", fixed.CATEGORY_TERMS),
)
_GENERAL_NAMES = [name for name, _ in _metrics("general_profile_signal_summary")]
ORACLE["check_general_profile"] = f"""SELECT * EXCLUDE (related_columns) FROM
    ({_single('docs_now', 'general_profile_signal_summary',
              _measures('general_profile_signal_summary', *_GENERAL_NAMES))})"""


def _baseline(pair, check: str, *names: str) -> str:
    outputs = _measures(check, *names)
    return f"""WITH {_profile(*pair)}, {_compare([pair])}
    SELECT {_signal(check)}, {outputs} FROM cmp w"""


ORACLE["ev_baseline_duplicates"] = _baseline(
    _R, "baseline_duplicate_comparison",
    "columns_compared", "columns_higher", "max_delta",
)
ORACLE["ev_baseline_nulls"] = _baseline(
    _D, "baseline_null_comparison",
    "columns_compared", "columns_higher", "columns_lower", "max_delta",
)
ORACLE["ev_baseline_dates"] = _baseline(
    _O, "baseline_date_comparison",
    "columns_compared", "columns_with_range_change", "columns_with_delta",
)
ORACLE["ev_baseline_totals"] = _baseline(
    _O, "baseline_total_comparison",
    "current_rows", "baseline_rows", "row_delta", "columns_compared",
    "columns_with_delta", "max_delta",
)
ORACLE["ev_baseline_schema"] = _baseline(
    _P, "baseline_schema_comparison",
    "current_columns", "baseline_columns", "shared_columns", "kind_changes",
)
ORACLE["ev_baseline_schema_wide"] = _baseline(
    _W, "baseline_schema_comparison",
    "current_columns", "baseline_columns", "shared_columns", "kind_changes",
)
ORACLE["ev_baseline_category"] = _baseline(
    _E, "baseline_category_shape_comparison",
    "columns_compared", "columns_with_delta", "max_delta", "flag_changes",
)
_DELTA_NAMES = [name for name, _ in _metrics("baseline_general_summary")]
ORACLE["ev_baseline_general"] = _baseline(
    _P, "baseline_general_summary", *_DELTA_NAMES
)

# --- ledger, hypotheses, findings ---------------------------------------------

_EVIDENCE_ROWS = f"""SELECT c.case_id, c.issue_type, evidence_id, check_id, signal,
    signal_strength, related_columns FROM {_joined_cases('ev')}"""
ORACLE["evidence_ledger"] = _ledger(_EVIDENCE_ROWS)
ORACLE["ledger_texts"] = _ledger(_EVIDENCE_ROWS, cases=_text_routing())
_NOT_RUN = f"""nr AS (SELECT c.case_id, p.check_id,
    CASE WHEN p.requires_baseline THEN 'baseline_unavailable'
         ELSE 'needs_interpretation' END AS reason_code
    FROM cases c JOIN planned p USING (issue_type) WHERE c.ds IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM ev x WHERE c.idx = x.idx AND c.ds = x.ds
        AND c.bs IS NOT DISTINCT FROM x.bs AND x.check_id = p.executed_as))"""
ORACLE["checks_not_run"] = _ledger("SELECT * FROM nr", _plan(), _NOT_RUN)
_COUNTED = f"""ec AS (SELECT c.case_id, count(DISTINCT x.check_id) AS checks,
    count(x.check_id) AS items FROM cases c LEFT JOIN ev x ON c.idx = x.idx
    AND c.ds = x.ds AND c.bs IS NOT DISTINCT FROM x.bs GROUP BY 1),
    nc AS (SELECT case_id, count(*) AS not_run FROM nr GROUP BY 1)"""
ORACLE["ledger_execution"] = _ledger(
    """SELECT case_id, CASE WHEN issue_type = 'missing_issue_statement'
        THEN 'not_executed' ELSE 'checks_executed' END AS status,
    checks AS checks_executed_count, items AS evidence_item_count,
    coalesce(not_run, 0) AS checks_not_run_count, bs IS NOT NULL AS baseline_available
    FROM cases JOIN ec USING (case_id) LEFT JOIN nc USING (case_id)
    WHERE ds IS NOT NULL""",
    _plan(),
    _NOT_RUN,
    _COUNTED,
)


def _hypotheses() -> str:
    """CTE hyp: one row per statement, table pair and rule."""
    rows = [
        f"('{t}', {n}, '{rule['kind']}', {_list(rule['check_ids'])}, '{rule['otherwise']}')"
        for t, rules in wording.HYPOTHESES.items()
        for n, rule in enumerate(rules, start=1)
    ]
    return f"""rules(issue_type, n, kind, check_ids, otherwise) AS (VALUES {', '.join(rows)}),
    met AS (SELECT t.idx, t.ds, t.bs, r.n, r.kind, r.otherwise, t.issue_type,
        count(x.check_id) AS k, min(x.signal) AS signal,
        min(x.signal_strength) AS strength,
        string_agg(x.evidence_id, ',' ORDER BY x.ordinal) AS ids
        FROM tally t JOIN rules r USING (issue_type)
        LEFT JOIN ev x ON x.idx = t.idx AND x.ds = t.ds
            AND x.bs IS NOT DISTINCT FROM t.bs AND list_contains(r.check_ids, x.check_id)
        GROUP BY ALL),
    judged AS (SELECT *, CASE WHEN kind = 'context' THEN 'unclear'
        WHEN k = 0 AND kind = 'baseline' AND bs IS NULL THEN 'unclear'
        WHEN k = 0 THEN 'not_assessed'
        WHEN kind = 'recorded' THEN 'supported_by_evidence'
        WHEN signal = 'present' THEN 'supported_by_evidence'
        WHEN signal = 'absent' THEN otherwise ELSE 'unclear' END AS status FROM met),
    hyp AS (SELECT idx, ds, bs, n, issue_type, status,
        format('hyp-{{:03d}}', n) AS hypothesis_id,
        CASE WHEN k = 0 THEN 'not_applicable' WHEN kind = 'recorded' THEN 'low'
             WHEN signal = 'present' THEN strength
             WHEN signal = 'absent' AND status = 'not_supported_by_evidence' THEN 'low'
             ELSE 'not_applicable' END AS signal_level,
        CASE WHEN k > 0 AND (kind = 'recorded' OR signal = 'present')
            THEN ids ELSE '' END AS supporting,
        CASE WHEN k > 0 AND kind <> 'recorded' AND signal = 'absent'
            AND otherwise = 'not_supported_by_evidence' THEN ids ELSE '' END
            AS contradicting,
        CASE WHEN k > 0 AND kind <> 'recorded' AND signal <> 'present'
            AND NOT (signal = 'absent' AND otherwise = 'not_supported_by_evidence')
            THEN ids ELSE '' END AS inconclusive FROM judged)"""


def _reviewed(select: str, *extra: str) -> str:
    return _ledger(select, _hypotheses(), *extra)


ORACLE["hypotheses"] = _reviewed(
    f"""SELECT c.case_id, hypothesis_id, status, signal_level, supporting, contradicting,
    inconclusive FROM {_joined_cases('hyp')}"""
)
_SAID = ", ".join(
    f"('{t}', {n}, {_q(rule['statement'])})"
    for t, rules in wording.HYPOTHESES.items()
    for n, rule in enumerate(rules, start=1)
)


def _shown(ids: str) -> str:
    return f"CASE WHEN {ids} = '' THEN 'None' ELSE replace({ids}, ',', ', ') END AS {ids}"


ORACLE["report_hypothesis_rows"] = _reviewed(
    f"""SELECT c.case_id, hypothesis_id, status, signal_level, said.statement,
    {_shown('supporting')}, {_shown('contradicting')}, {_shown('inconclusive')}
    FROM {_joined_cases('hyp')}
    JOIN said ON said.issue_type = x.issue_type AND said.n = x.n""",
    f"said(issue_type, n, statement) AS (VALUES {_SAID})",
)
_COUNTS = ", ".join(
    f"count(*) FILTER (x.status = '{s}') AS {s}" for s in fixed.HYPOTHESIS_STATUSES
)
ORACLE["hypothesis_status_counts"] = _reviewed(
    f"""SELECT c.case_id, {_COUNTS} FROM cases c LEFT JOIN hyp x ON c.idx = x.idx
    AND c.ds = x.ds AND c.bs IS NOT DISTINCT FROM x.bs GROUP BY 1"""
)


def _finding(prefix: str, status: str, ids: str) -> str:
    return _reviewed(
        f"""SELECT c.case_id, item_id, hypothesis_id, evidence_ids
        FROM {_joined_cases('found')}""",
        f"""found AS (SELECT idx, ds, bs, hypothesis_id, {ids} AS evidence_ids,
        format('{prefix}-{{:03d}}', row_number() OVER
            (PARTITION BY idx, ds, bs ORDER BY n)) AS item_id
        FROM hyp WHERE status = '{status}')""",
    )


ORACLE["findings_supported"] = _finding("sig", fixed.SUPPORTED, "supporting")
ORACLE["findings_not_supported"] = _finding(
    "notsup", fixed.NOT_SUPPORTED, "contradicting"
)
_OPEN = f"""open AS (SELECT idx, ds, bs, hypothesis_id, evidence_ids,
    format('unc-{{:03d}}', row_number() OVER (PARTITION BY idx, ds, bs ORDER BY n))
    AS item_id FROM (
        SELECT idx, ds, bs, n, hypothesis_id, inconclusive AS evidence_ids FROM hyp
        WHERE status IN ('unclear', 'not_assessed')
        UNION ALL
        SELECT idx, ds, bs, 100 + g, '(open point)', '' FROM tally
        CROSS JOIN range(1, {len(wording.OPEN_POINTS) + 1}) AS q(g)
        WHERE issue_type <> 'missing_issue_statement'))"""
ORACLE["findings_unclear"] = _reviewed(
    f"""SELECT c.case_id, item_id, hypothesis_id, evidence_ids
    FROM {_joined_cases('open')}""",
    _OPEN,
)


def _check_texts() -> str:
    """CTE texts: recommended checks of each type, first occurrence kept."""
    rows = []
    for t, keys in wording.ROUTE_CHECKS.items():
        every = [*keys, *(k for rule in wording.HYPOTHESES[t] for k in rule["checks"])]
        for n, key in enumerate(every):
            rows.append(f"('{t}', {n}, {_q(wording.HUMAN_CHECKS[key])})")
    return f"""listed(issue_type, n, check_text) AS (VALUES {', '.join(rows)}),
    texts AS (SELECT issue_type, check_text,
        row_number() OVER (PARTITION BY issue_type ORDER BY min(n)) AS check_ordinal
        FROM listed GROUP BY issue_type, check_text)"""


ORACLE["findings_checks"] = f"""WITH {_statements()}, {_cases()}, {_check_texts()}
    SELECT case_id, check_ordinal, check_text FROM cases JOIN texts USING (issue_type)
    WHERE ds IS NOT NULL"""
ORACLE["findings_summary"] = _reviewed(
    f"""SELECT c.case_id,
    count(*) FILTER (status = 'supported_by_evidence') AS supported_signal_count,
    count(*) FILTER (status = 'not_supported_by_evidence') AS not_supported_signal_count,
    count(*) FILTER (status = 'unclear') AS unclear_signal_count,
    count(*) FILTER (status = 'not_assessed') AS not_assessed_count,
    'review_required' AS finding_status FROM {_joined_cases('hyp')} GROUP BY 1"""
)


def _key_metrics() -> str:
    """CTE km: the first four filled scalar metrics of every item."""
    branches = []
    for check, (issue_type, ordinal, *_rest) in _ITEMS.items():
        having = "AND has_b" if check.startswith("baseline_") else ""
        for n, (name, value) in enumerate(_metrics(check)):
            text, number = "NULL::VARCHAR", f"({value})::DOUBLE"
            if value.startswith("text:"):
                text, number = value.removeprefix("text:"), "NULL::DOUBLE"
            branches.append(
                f"""SELECT idx, ds, bs, {ordinal} AS item, {n} AS n, '{name}' AS metric,
                {number} AS value, {text} AS text FROM w
                WHERE issue_type = '{issue_type}' {having}"""
            )
    return f"""every AS ({' UNION ALL '.join(branches)}),
    km AS (SELECT *, row_number() OVER (PARTITION BY idx, ds, bs, item ORDER BY n)
        AS ordinal FROM every WHERE value IS NOT NULL OR text IS NOT NULL)"""


ORACLE["report_key_metrics"] = _ledger(
    f"""SELECT c.case_id, format('ev-{{:03d}}', item) AS evidence_id, ordinal, metric,
    coalesce(text, '') AS text, coalesce(value, -1.0) AS value
    FROM {_joined_cases('km')}""",
    _key_metrics(),
)
_NAMES = ", ".join(f"('{k}', {_q(v)})" for k, v in wording.CHECK_NAMES.items())
ORACLE["report_evidence_rows"] = _ledger(
    f"""SELECT c.case_id, evidence_id, check_name, signal, signal_strength,
    CASE WHEN related_columns = '' THEN 'None'
         ELSE replace(related_columns, ',', ', ') END AS related_columns
    FROM {_joined_cases('ev')} JOIN names USING (check_id)""",
    f"names(check_id, check_name) AS (VALUES {_NAMES})",
)

# --- safety and runs ----------------------------------------------------------


def _scan(name: str, relation: str) -> str:
    terms = [t.lower() for t in fixed.BLOCKED_TERMS]
    return f"""SELECT '{name}' AS table_name, count(*) AS rows_scanned,
        count(*) FILTER ({_any('lower(text)', terms)}) AS rows_hit FROM {relation}"""


ORACLE["scan_blocked_terms"] = " UNION ALL ".join(
    [
        _scan("documents", "documents"),
        _scan("conversations", "conversations"),
        _scan(
            "conversations_marked",
            "(SELECT CASE WHEN role = 'assistant' THEN text || ' Approved'"
            " ELSE text END AS text FROM conversations)",
        ),
    ]
)
ORACLE["validate_notes"] = """
    WITH d AS (SELECT source, length(text) > 1000 AS long_text,
        string_split(text, chr(10)) AS lines FROM documents),
    e AS (SELECT CASE source WHEN 'src0' THEN ['not_json'] WHEN 'src1'
        THEN ['not_an_object'] ELSE list_filter([
            CASE WHEN source = 'src2' THEN 'unexpected_keys' END,
            CASE WHEN source = 'src2' THEN 'missing_keys' END,
            CASE WHEN long_text THEN 'review_summary:too_long' END,
            CASE WHEN len(lines) > 8 THEN 'suggested_follow_up_questions:too_many_items'
                 WHEN len(list_filter(lines, lambda l: length(l) > 300)) > 0
                 THEN 'suggested_follow_up_questions:item_too_long' END,
            CASE WHEN source = 'src4' THEN 'suggested_human_checks:not_a_list' END,
            CASE WHEN source = 'src2' THEN 'communication_notes:not_a_list' END,
            CASE WHEN source = 'src3'
                 THEN 'limitations_to_keep_visible:item_not_text' END,
            CASE WHEN source = 'src5' THEN 'blocked_terms' END],
            lambda c: c IS NOT NULL) END AS codes FROM d)
    SELECT error_code, count(*) AS rows_affected FROM (
        SELECT unnest(CASE WHEN len(codes) = 0 THEN ['none'] ELSE codes END)
            AS error_code FROM e) GROUP BY 1"""
_HYPS = f"""hc AS (SELECT c.case_id, count(*) AS hyps,
    count(*) FILTER (status = 'supported_by_evidence') AS sup,
    count(*) FILTER (status = 'not_supported_by_evidence') AS nos,
    count(*) FILTER (status = 'unclear') AS unc FROM {_joined_cases('hyp')} GROUP BY 1),
    oc AS (SELECT c.case_id, count(*) AS opens FROM {_joined_cases('open')} GROUP BY 1)"""
ORACLE["safe_summary"] = _reviewed(
    """SELECT case_id, c.issue_type, items AS evidence_count, hyps AS hypothesis_count,
    opens AS unclear_count, checks_n AS check_count, true AS is_safe,
    statement, u.n AS current_rows, u.cols AS current_columns,
    coalesce(v.n, -1) AS baseline_rows, coalesce(v.cols, -1) AS baseline_columns,
    checks AS executed, coalesce(not_run, 0) AS not_run,
    sup AS supported_by_evidence, nos AS not_supported_by_evidence, unc AS unclear,
    hyps - sup - nos - unc AS not_assessed
    FROM cases c JOIN ec USING (case_id) JOIN hc USING (case_id) JOIN oc USING (case_id)
    LEFT JOIN nc USING (case_id) JOIN sums u ON u.dataset_id = c.ds
    LEFT JOIN sums v ON v.dataset_id = c.bs
    JOIN (SELECT issue_type, count(*) AS checks_n FROM texts GROUP BY 1) t
    ON t.issue_type = c.issue_type""",
    _plan(),
    _NOT_RUN,
    _COUNTED,
    _OPEN,
    _HYPS,
    _check_texts(),
)
ORACLE["run_status"] = _routing(
    """SELECT case_id, issue_type, route_name,
    CASE WHEN issue_type = 'missing_issue_statement' THEN 'plan_not_ready'
         WHEN ds IS NULL THEN 'planned' ELSE 'report_written' END AS status,
    CASE WHEN issue_type = 'missing_issue_statement' THEN 'missing_issue_statement'
         WHEN ds IS NULL THEN 'investigation_plan_created'
         ELSE 'markdown_report_created' END AS stage FROM cases"""
)
_STORED = ", ".join(f"({i}, {_list(stages)})" for i, stages in enumerate(STORED))
ORACLE["stored_status"] = f"""WITH {_statements()}, {_cases()},
    stored(k, stages) AS (VALUES {_STORED})
    SELECT case_id, issue_type, route_name, split_part(reached, '/', 1) AS status,
        split_part(reached, '/', 2) AS stage FROM (
        SELECT case_id, issue_type, route_name, CASE
            WHEN issue_type = 'missing_issue_statement'
                THEN 'plan_not_ready/missing_issue_statement'
            WHEN list_contains(stages, 'notes')
                THEN 'llm_notes_written/optional_llm_notes_created'
            WHEN list_contains(stages, 'notes failed')
                THEN 'report_written/llm_notes_failed_validation'
            WHEN list_contains(stages, 'report')
                THEN 'report_written/markdown_report_created'
            WHEN list_contains(stages, 'findings')
                THEN 'findings_summarized/hypotheses_and_findings_created'
            WHEN list_contains(stages, 'evidence')
                THEN 'evidence_recorded/deterministic_checks_recorded'
            WHEN ds IS NOT NULL THEN 'profiled_planned/dataset_profiled_plan_created'
            ELSE 'planned/investigation_plan_created' END AS reached
        FROM cases JOIN stored ON k = case_id % {len(STORED)})"""
_SECTIONS = {
    "supported_signals": ("findings_supported", "false"),
    "not_supported_signals": ("findings_not_supported", "false"),
    "unclear_items": ("findings_unclear", "true"),
}
ORACLE["report_finding_rows"] = " UNION ALL ".join(
    f"""SELECT case_id, '{section}' AS section, item_id,
    CASE WHEN evidence_ids = '' THEN 'None' ELSE replace(evidence_ids, ',', ', ') END
        AS evidence_ids, {filled} AS has_reason, {filled} AS has_check
    FROM ({ORACLE[source]})"""
    for section, (source, filled) in _SECTIONS.items()
)
ORACLE["cmp_sources"] = """SELECT 'orders_recent' AS current_id,
    'orders_earlier' AS baseline_id, 'orders.parquet' AS current_name,
    'parquet' AS current_format,
    (SELECT count(*) FROM orders WHERE o_orderdate >= '1998-01-01') AS current_row_count,
    (SELECT count(*) FROM (DESCRIBE orders)) AS current_column_count,
    'orders.parquet' AS baseline_name, 'parquet' AS baseline_format,
    (SELECT count(*) FROM orders WHERE o_orderdate < '1998-01-01') AS baseline_row_count,
    (SELECT count(*) FROM (DESCRIBE orders)) AS baseline_column_count
    UNION ALL SELECT 'customer', 'suppliers', 'customer.parquet', 'parquet',
    (SELECT count(*) FROM customer), (SELECT count(*) FROM (DESCRIBE customer)),
    '(none)', 'dataframe', (SELECT count(*) FROM supplier), 4"""
ORACLE["run_manifest"] = _reviewed(
    """SELECT case_id, c.issue_type, c.route_name,
    coalesce(c.ds, '(none)') AS dataset_id, coalesce(u.n, -1) AS row_count,
    coalesce(u.cols, -1) AS column_count, c.bs IS NOT NULL AS baseline_available,
    coalesce(m.signals, -1) AS comparison_signal_count,
    coalesce(m.shared, -1) AS compared_column_count,
    checks AS checks_executed_count, items AS evidence_item_count,
    coalesce(not_run, 0) AS checks_not_run_count, coalesce(hyps, 0) AS hypothesis_count,
    coalesce(sup, 0) AS supported_hypothesis_count,
    coalesce(nos, 0) AS not_supported_hypothesis_count,
    coalesce(unc, 0) AS unclear_hypothesis_count,
    coalesce(sup, 0) AS supported_signal_count,
    coalesce(opens, 0) AS unclear_item_count,
    CASE WHEN hyps IS NULL THEN '(none)' ELSE 'review_required' END AS finding_status
    FROM cases c LEFT JOIN sums u ON u.dataset_id = c.ds
    LEFT JOIN cmp m ON m.ds = c.ds AND m.bs = c.bs JOIN ec USING (case_id)
    LEFT JOIN nc USING (case_id) LEFT JOIN hc USING (case_id)
    LEFT JOIN oc USING (case_id)""",
    _plan(),
    _NOT_RUN,
    _COUNTED,
    _OPEN,
    _HYPS,
)
