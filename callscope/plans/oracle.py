"""DuckDB (RE2) re-expression of the operators, used as the correctness oracle.

The SQL rebuilds every test view from the raw parquet tables (pre-registered
as views by the checker) and evaluates the grammar with the RE2 dialect of the
same pattern fragments.  Where the Spark side works row-locally with arrays,
the SQL uses DuckDB list lambdas; reports are plain GROUP BY queries.
"""

from __future__ import annotations

from callscope.functions.grammar import ADMITS, RE2, sql_literal

R = RE2
WS_CHARS = "' ' || chr(9) || chr(10) || chr(13)"


def q(pattern: str) -> str:
    return sql_literal(pattern)


def rx(subject: str, pattern: str) -> str:
    return f"regexp_matches({subject}, {q(pattern)})"


def lexical_class(v: str) -> str:
    whens = " ".join(
        f"WHEN {rx(v, R.lexical(c))} THEN '{c}'"
        for c in ("integer", "number", "string", "boolean", "null")
    )
    return f"(CASE {whens} ELSE 'invalid' END)"


def admits(t: str, cls: str) -> str:
    parts = []
    for typ, classes in ADMITS.items():
        inlist = ", ".join(f"'{c}'" for c in classes)
        parts.append(f"({t} = '{typ}' AND {cls} IN ({inlist}))")
    return f"coalesce({' OR '.join(parts)}, false)"


def strip(v: str) -> str:
    return f"rtrim({v}, {WS_CHARS})"


def per_type(t: str, pattern_of, subject: str) -> str:
    whens = " ".join(
        f"WHEN '{typ}' THEN {rx(subject, pattern_of(typ))}"
        for typ in ("string", "integer", "number", "boolean", "null")
    )
    return f"coalesce(CASE {t} {whens} ELSE false END, false)"


def type_of(keys: str, types: str, k: str) -> str:
    return f"{types}[list_position({keys}, {k})]"


def canonical(t: str) -> str:
    return (
        f"(CASE lower({t}) WHEN 'string' THEN 'string' WHEN 'integer' THEN 'integer' "
        f"WHEN 'number' THEN 'number' WHEN 'float' THEN 'number' WHEN 'boolean' THEN 'boolean' "
        f"WHEN 'null' THEN 'null' END)"
    )


# --------------------------------------------------------------------------
# Fixture views
# --------------------------------------------------------------------------

def _ctes(**named: str) -> str:
    return ",\n".join(f"{name} AS (\n{body}\n)" for name, body in named.items())


SPECS_EVENTS = """
  SELECT event_type AS function, 0 AS ord, 'k' AS key, 'integer' AS type
  FROM (SELECT DISTINCT event_type FROM events)
"""

CALLS_EVENTS = r"""
  SELECT event_id AS call_id, event_type AS function,
    CASE WHEN r <= 5 THEN props
         WHEN r = 6 THEN '{"k":' || k || '}'
         WHEN r = 7 THEN ' { "k" : ' || k || ' ' || chr(13) || chr(10) || '} '
         WHEN r = 8 THEN '{"k": ' || k
         WHEN r = 9 THEN props || 'x'
         WHEN r = 10 THEN '{"k": "' || k || '"}'
         WHEN r = 11 THEN '{"k": ' || k || '.5}'
         WHEN r = 12 THEN '{"kk": ' || k || '}'
         WHEN r = 13 THEN '{}'
         WHEN r = 14 THEN '{"k": 0' || k || '}'
         WHEN r = 15 THEN '{"k": ' || k || ',"k": 1}'
         ELSE '{"k": ' || k || chr(13) || '}' END AS text
  FROM (SELECT event_id, event_type, props, event_id % 17 AS r,
               regexp_extract(props, '-?[0-9]+', 0) AS k FROM events)
"""

SPECS_WIDE = """
  SELECT f.function, p.ord, p.key,
         CASE WHEN p.key = 'o_totalprice' AND f.function <> 'order_f' THEN 'float'
              WHEN p.key = 'note' AND f.function = 'order_p' THEN 'string' ELSE p.type END AS type
  FROM (SELECT DISTINCT 'order_' || lower(o_orderstatus) AS function FROM orders) f,
       (VALUES (0, 'o_orderkey', 'integer'), (1, 'o_totalprice', 'number'),
               (2, 'o_orderstatus', 'string'), (3, 'urgent', 'boolean'), (4, 'note', 'null')) p(ord, key, type)
"""

CALLS_WIDE = r"""
  SELECT call_id, function,
    CASE WHEN d = 1 THEN '{' || chr(10) || '  ' || array_to_string(kept, ',' || chr(10) || '  ') || chr(10) || '}'
         WHEN d = 2 THEN '{' || array_to_string(kept, ', ')
         WHEN d = 6 THEN '{' || array_to_string(kept, ', ') || ',}'
         ELSE '{' || array_to_string(kept, ', ') || '}' END AS text
  FROM (
    SELECT call_id, function, d,
      CASE WHEN d = 5 THEN list_filter(rot, lambda x: NOT starts_with(x, '"note"'))
           WHEN d = 0 AND call_id % 11 = 3 THEN list_append(rot, '"o_orderkey": 0')
           WHEN d = 0 AND call_id % 11 = 7 THEN list_append(rot, '"o\"status": 1')
           WHEN d = 0 AND call_id % 11 IN (5, 8, 9) THEN list_transform(rot, lambda x: CASE WHEN NOT starts_with(x, '"note"') THEN x
             WHEN call_id % 11 = 5 THEN '"note": ' || repeat('{"note": [', CAST(call_id % 60 + 1 AS INTEGER)) || '1' || repeat(']}', CAST(call_id % 60 + 1 AS INTEGER))
             WHEN call_id % 11 = 8 THEN '"note": ' ELSE '"note" null' END)
           ELSE rot END AS kept
    FROM (
      SELECT call_id, function, d, list_slice(items, r + 1, 5) || list_slice(items, 1, r) AS rot
      FROM (
        SELECT o_orderkey AS call_id, 'order_' || lower(o_orderstatus) AS function,
               o_orderkey % 7 AS d, CAST(o_orderkey % 5 AS INTEGER) AS r,
               ['"o_orderkey": ' || CAST(o_orderkey AS STRING),
                '"o_totalprice": ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING),
                '"o_orderstatus": "' || o_orderstatus || '"',
                CASE WHEN o_orderkey % 7 = 3 THEN '"urgent": "yes"'
                     ELSE '"urgent": ' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END END,
                CASE WHEN o_orderkey % 7 = 4 THEN '"notes": null' ELSE '"note": null' END] AS items
        FROM orders)))
"""

SPECS_BENCH = """
  SELECT f.function, p.ord, p.key, p.type
  FROM (SELECT DISTINCT 'line_' || lower(l_linestatus) AS function FROM lineitem) f,
       (VALUES (0, 'l_orderkey', 'integer'), (1, 'l_quantity', 'number'),
               (2, 'l_returnflag', 'STRING')) p(ord, key, type)
"""

CALLS_BENCH = r"""
  SELECT l_orderkey * 8 + l_linenumber AS call_id, 'line_' || lower(l_linestatus) AS function,
    CASE WHEN l_linenumber = 2 THEN '{' || chr(10) || ' "l_returnflag": "' || rf || '",' || chr(10) || ' "l_orderkey": ' || ok || ',' || chr(10) || ' "l_quantity": ' || qy || chr(10) || '}'
         WHEN l_linenumber = 3 THEN '{"l_orderkey": ' || ok || ', "l_quantity": "' || qy || '", "l_returnflag": "' || rf || '"}'
         WHEN l_linenumber = 4 THEN '{"l_orderkey": ' || ok || ', "l_quantity": ' || qy || ', "l_returnflag": "' || rf
         WHEN l_linenumber = 6 THEN '{"l_orderkey": ' || ok || ', "l_quantity": ' || qy || ', "l_returnflag": "' || rf || '", "l_comment": "x"}'
         ELSE '{"l_orderkey": ' || ok || ', "l_quantity": ' || qy || ', "l_returnflag": "' || rf || '"}' END AS text
  FROM (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag AS rf,
               CAST(l_orderkey AS STRING) AS ok,
               CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING) AS qy FROM lineitem)
"""

FIXTURES = {
    "events": (SPECS_EVENTS, CALLS_EVENTS),
    "wide": (SPECS_WIDE, CALLS_WIDE),
    "bench": (SPECS_BENCH, CALLS_BENCH),
}


# --------------------------------------------------------------------------
# Parsing chain: calls -> schema -> head/tail -> status, fields
# --------------------------------------------------------------------------

SCHEMA = f"""
  SELECT function, list(key ORDER BY ord) AS keys, list({canonical('type')} ORDER BY ord) AS types
  FROM specs GROUP BY function
"""


def chain(source: str, tag: str) -> dict[str, str]:
    """Parsing CTEs over ``source(call_id, function, text, ...)``; last is ``{tag}parsed``."""
    p1 = f"""
  SELECT c.*,
         coalesce(s.keys, []::VARCHAR[]) AS keys, coalesce(s.types, []::VARCHAR[]) AS types,
         regexp_extract(c.text, {q(R.head)}, 0) AS head
  FROM {source} c LEFT JOIN schema s ON c.function = s.function
"""
    p2 = f"""
  SELECT *, regexp_extract_all(head, {q(R.item_comma)}, 1) AS hkeys,
         list_transform(regexp_extract_all(head, {q(R.item_comma)}, 2), lambda v: {strip('v')}) AS hvals,
         substr(text, length(head) + 1) AS tail
  FROM {tag}p1
"""
    p3 = f"""
  SELECT *, list_filter(keys, lambda k: NOT list_contains(hkeys, k)) AS rem,
         regexp_matches(tail, {q(R.tail_item)}) AS is_ti,
         regexp_extract(tail, {q(R.tail_item)}, 1) AS tkey,
         regexp_extract(tail, {q(R.tail_item)}, 2) AS colon,
         regexp_extract(tail, {q(R.tail_item)}, 3) AS rest,
         regexp_matches(tail, {q(R.open_key)}) AS is_pk,
         regexp_extract(tail, {q(R.open_key)}, 1) AS pkey,
         regexp_matches(tail, {q(R.leading_item)}) AS has_last,
         regexp_extract(tail, {q(R.leading_item)}, 1) AS lkey,
         {strip(f"regexp_extract(tail, {q(R.leading_item)}, 2)")} AS lval
  FROM {tag}p2
"""
    typed_ok = (
        "coalesce(list_bool_and(list_transform(hkeys, lambda k, i: "
        + admits(type_of("keys", "types", "k"), lexical_class("hvals[i]"))
        + ")), true)"
    )
    head_ok = f"(len(list_distinct(hkeys)) = len(hkeys) AND (len(hkeys) = 0 OR len(hkeys) < len(keys)) AND {typed_ok})"
    ttype = type_of("keys", "types", "tkey")
    tkey_ok = "(is_ti AND list_contains(rem, tkey))"
    closes = f"({tkey_ok} AND colon = ':' AND len(rem) = 1 AND {per_type(ttype, R.closing_value, 'rest')})"
    viable = f"({tkey_ok} AND (colon = '' OR {per_type(ttype, R.viable_value, 'rest')}))"
    pk_ok = "(is_pk AND coalesce(list_bool_or(list_transform(rem, lambda k: starts_with(k, pkey))), false))"
    p4 = f"""
  SELECT *,
    CASE WHEN text IS NULL THEN NULL
         WHEN NOT {rx('text', R.opened)} THEN CASE WHEN {rx('text', R.blank)} THEN 'INCOMPLETE' ELSE 'REJECTED' END
         WHEN NOT {head_ok} THEN 'REJECTED'
         WHEN {closes} THEN 'TERMINAL'
         WHEN tail = '' OR {pk_ok} OR {viable} THEN 'INCOMPLETE'
         ELSE 'REJECTED' END AS status,
    CASE WHEN head <> '' AND has_last THEN list_append(hkeys, lkey) ELSE hkeys END AS fkeys,
    CASE WHEN head <> '' AND has_last THEN list_append(hvals, lval) ELSE hvals END AS fvals
  FROM {tag}p3
"""
    return {f"{tag}p1": p1, f"{tag}p2": p2, f"{tag}p3": p3, f"{tag}parsed": p4}


# What each view's calls are, by construction: a call's form follows from its
# id, so status, items and violations are known without parsing its text.

TRUTH_EVENTS = """
  SELECT call_id, function, text, ['k'] AS keys, ['integer'] AS types,
    CASE WHEN r <= 7 THEN 'TERMINAL' WHEN r = 8 THEN 'INCOMPLETE' ELSE 'REJECTED' END AS status,
    CASE r WHEN 12 THEN ['kk'] WHEN 13 THEN []::VARCHAR[] WHEN 15 THEN ['k', 'k'] ELSE ['k'] END AS fkeys,
    CASE r WHEN 10 THEN ['"' || k || '"'] WHEN 11 THEN [k || '.5'] WHEN 13 THEN []::VARCHAR[]
           WHEN 14 THEN ['0' || k] WHEN 15 THEN [k, '1'] ELSE [k] END AS fvals,
    CASE r WHEN 8 THEN ['truncated'] WHEN 9 THEN ['trailing'] WHEN 10 THEN ['type'] WHEN 11 THEN ['type']
           WHEN 12 THEN ['unknown', 'missing'] WHEN 13 THEN ['missing'] WHEN 14 THEN ['type']
           WHEN 15 THEN ['duplicate'] WHEN 16 THEN ['syntax'] ELSE []::VARCHAR[] END AS violations
  FROM (SELECT c.*, event_id % 17 AS r, regexp_extract(props, '-?[0-9]+', 0) AS k
        FROM calls c JOIN events ON call_id = event_id)
"""

TRUTH_WIDE = """
  SELECT call_id, function, text,
    ['o_orderkey', 'o_totalprice', 'o_orderstatus', 'urgent', 'note'] AS keys,
    ['integer', 'number', 'string', 'boolean', CASE WHEN function = 'order_p' THEN 'string' ELSE 'null' END] AS types,
    CASE WHEN wrong_note OR twice OR odd >= 5 OR d IN (3, 4, 5, 6) THEN 'REJECTED' WHEN d = 2 THEN 'INCOMPLETE' ELSE 'TERMINAL' END AS status,
    list_transform(items, lambda x: x.k) AS fkeys, list_transform(items, lambda x: x.v) AS fvals,
    list_filter([
      CASE WHEN d = 4 OR odd = 7 THEN 'unknown' END, CASE WHEN d IN (4, 5) THEN 'missing' END, CASE WHEN twice THEN 'duplicate' END,
      CASE WHEN d = 3 OR wrong_note OR odd IN (5, 8, 9) THEN 'type' END, CASE WHEN d = 2 AND NOT wrong_note THEN 'truncated' END,
      CASE WHEN d = 6 AND NOT wrong_note THEN 'syntax' END], lambda x: x IS NOT NULL) AS violations
  FROM (
    SELECT *, function = 'order_p' AND d NOT IN (4, 5) AS wrong_note,
      CASE WHEN d = 5 THEN list_filter(rot, lambda x: x.k <> 'note')
           WHEN twice THEN list_append(rot, {'k': 'o_orderkey', 'v': '0'})
           WHEN odd = 7 THEN list_append(rot, {'k': 'o\\"status', 'v': '"o\\"status": 1'})
           WHEN odd >= 5 THEN list_transform(rot, lambda x: CASE WHEN x.k <> 'note' THEN x ELSE {'k': 'note', 'v':
             CASE odd WHEN 8 THEN '' WHEN 9 THEN '"note" null'
             ELSE repeat('{"note": [', CAST(call_id % 60 + 1 AS INTEGER)) || '1' || repeat(']}', CAST(call_id % 60 + 1 AS INTEGER)) END} END)
           ELSE rot END AS items
    FROM (
      SELECT *, list_slice(named, r + 1, 5) || list_slice(named, 1, r) AS rot
      FROM (
        SELECT c.*, o_orderkey % 7 AS d, CAST(o_orderkey % 5 AS INTEGER) AS r,
          o_orderkey % 7 = 0 AND o_orderkey % 11 = 3 AS twice,
          CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 11 IN (5, 7, 8, 9) THEN o_orderkey % 11 ELSE -1 END AS odd,
          [{'k': 'o_orderkey', 'v': CAST(o_orderkey AS STRING)},
           {'k': 'o_totalprice', 'v': CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)},
           {'k': 'o_orderstatus', 'v': '"' || o_orderstatus || '"'},
           {'k': 'urgent', 'v': CASE WHEN o_orderkey % 7 = 3 THEN '"yes"' WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END},
           {'k': CASE WHEN o_orderkey % 7 = 4 THEN 'notes' ELSE 'note' END, 'v': 'null'}] AS named
        FROM calls c JOIN orders ON call_id = o_orderkey)))
"""

TRUTH_BENCH = """
  SELECT call_id, function, text,
    CASE WHEN call_id % 8 IN (3, 6) THEN 'REJECTED' WHEN call_id % 8 = 4 THEN 'INCOMPLETE' ELSE 'TERMINAL' END AS status
  FROM calls
"""

TRUTH = {"events": TRUTH_EVENTS, "wide": TRUTH_WIDE, "bench": TRUTH_BENCH}


def json_class(v: str) -> str:
    """Lexical class of a raw value by DuckDB's own JSON reader."""
    kind = f"json_type({v})"
    return (
        f"(CASE WHEN NOT json_valid({v}) THEN 'invalid' WHEN {kind} IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' "
        f"WHEN {kind} = 'DOUBLE' THEN 'number' WHEN {kind} = 'VARCHAR' THEN 'string' WHEN {kind} = 'BOOLEAN' THEN 'boolean' "
        f"WHEN {kind} = 'NULL' THEN 'null' ELSE 'invalid' END)"
    )


def parse_ctes(fixture: str, **extra: str) -> str:
    """CTEs ``specs``, ``calls``, ``schema`` and ``parsed`` (what is known of each call) for one fixture."""
    specs, calls = FIXTURES[fixture]
    return _ctes(specs=specs, calls=calls, schema=SCHEMA, parsed=TRUTH[fixture], **extra)


def with_parse(fixture: str, select: str) -> str:
    return f"WITH {parse_ctes(fixture)}\n{select}"


def accepted_sql(fixture: str) -> str:
    return with_parse(fixture, "SELECT call_id, function, status = 'TERMINAL' AS accepted FROM parsed")


def status_sql(fixture: str) -> str:
    return with_parse(fixture, "SELECT call_id, function, status FROM parsed")


def conformance_sql(fixture: str) -> str:
    return with_parse(fixture, """
SELECT function, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE status = 'TERMINAL') AS BIGINT) AS n_terminal,
       CAST(count(*) FILTER (WHERE status = 'INCOMPLETE') AS BIGINT) AS n_incomplete,
       CAST(count(*) FILTER (WHERE status = 'REJECTED') AS BIGINT) AS n_rejected,
       round(count(*) FILTER (WHERE status = 'TERMINAL') / count(*), 6) AS accept_rate
FROM parsed GROUP BY function
""")


# --------------------------------------------------------------------------
# C3-C13, C15
# --------------------------------------------------------------------------

FIELDS_CTE = """
  SELECT call_id, function, keys, types, status, text,
         unnest(range(len(fkeys))) AS pos, unnest(fkeys) AS key, unnest(fvals) AS raw_value
  FROM parsed
"""


def first_error_sql(fixture: str) -> str:
    """C3 by brute force: the status of every prefix, no binary search."""
    pre = """
  SELECT call_id, function, text AS full_text, unnest(range(0, length(text) + 1)) AS len
  FROM parsed WHERE status = 'REJECTED'
"""
    pcalls = "  SELECT call_id, function, full_text, len, substr(full_text, 1, len) AS text FROM pre"
    extra = {"pre": pre, "pcalls": pcalls}
    extra.update(chain("pcalls", "q_"))
    return f"WITH {parse_ctes(fixture, **extra)}\n" + """
SELECT call_id, function, CAST(max(len) AS INTEGER) AS valid_prefix_len,
       substr(any_value(full_text), CAST(max(len) AS INTEGER) + 1, 1) AS bad_char
FROM q_parsed WHERE status <> 'REJECTED' GROUP BY call_id, function
"""


def fields_sql(fixture: str, select: str) -> str:
    return f"WITH {parse_ctes(fixture, fields=FIELDS_CTE)}\n{select}"


def call_fields_sql(fixture: str) -> str:
    return fields_sql(fixture, "SELECT call_id, function, CAST(pos AS INTEGER) AS pos, key, raw_value FROM fields")


def unknown_keys_sql(fixture: str) -> str:
    return fields_sql(fixture, """
SELECT call_id, function, CAST(pos AS INTEGER) AS pos, key, status
FROM fields WHERE NOT list_contains(keys, key)""")


def missing_keys_sql(fixture: str) -> str:
    return with_parse(fixture, """
SELECT call_id, function, key, status FROM (
  SELECT call_id, function, status,
         unnest(list_filter(keys, lambda k: NOT list_contains(fkeys, k))) AS key
  FROM parsed)""")


def duplicate_keys_sql(fixture: str) -> str:
    return fields_sql(fixture, """
SELECT call_id, function, key, CAST(count(*) AS BIGINT) AS n, status
FROM fields GROUP BY call_id, function, key, status HAVING count(*) > 1""")


def type_mismatches_sql(fixture: str) -> str:
    t = type_of("keys", "types", "key")
    cls = json_class("raw_value")
    return fields_sql(fixture, f"""
SELECT call_id, function, key, {t} AS type, raw_value, {cls} AS lexical_class, status
FROM fields WHERE {t} IS NOT NULL AND NOT {admits(t, cls)}""")


def param_profile_sql(fixture: str) -> str:
    cls = json_class("raw_value")
    counts = ",\n       ".join(
        f"CAST(count(*) FILTER (WHERE cls = '{c}') AS BIGINT) AS n_{c}"
        for c in ("integer", "number", "string", "boolean", "null", "invalid")
    )
    return fields_sql(fixture, f"""
SELECT *, CASE WHEN n_integer = n THEN 'integer'
               WHEN n_integer + n_number = n THEN 'number'
               WHEN n_string = n THEN 'string'
               WHEN n_boolean = n THEN 'boolean'
               WHEN n_null = n THEN 'null' ELSE 'mixed' END AS inferred_type
FROM (SELECT function, key, CAST(count(*) AS BIGINT) AS n,
       {counts}
      FROM (SELECT *, {cls} AS cls FROM fields) GROUP BY function, key)""")


def typed_parameters_sql(fixture: str) -> str:
    t = type_of("keys", "types", "key")
    return fields_sql(fixture, f"""
SELECT call_id, function, key, type, raw_value,
  CASE WHEN type = 'integer' THEN TRY_CAST(raw_value AS BIGINT) END AS as_bigint,
  CASE WHEN type IN ('integer', 'number') THEN TRY_CAST(raw_value AS DOUBLE) END AS as_double,
  CASE WHEN type = 'string' THEN json_extract_string(raw_value, '$') END AS as_string,
  CASE WHEN type = 'boolean' THEN raw_value = 'true' END AS as_bool
FROM (SELECT *, {t} AS type FROM fields WHERE status = 'TERMINAL')""")


def keys_left_sql(fixture: str) -> str:
    return with_parse(fixture, """
SELECT call_id, function, CAST(pos AS INTEGER) AS pos, key, CAST(keys_left AS INTEGER) AS keys_left FROM (
  SELECT call_id, function, unnest(range(len(fkeys))) AS pos, unnest(fkeys) AS key,
         unnest(list_transform(fkeys, lambda k, i:
             len(keys) - len(list_intersect(list_slice(fkeys, 1, i), keys)))) AS keys_left
  FROM parsed)""")


def violation_report_sql(fixture: str) -> str:
    return f"WITH {parse_ctes(fixture, viol="SELECT call_id, function, violations FROM parsed")}\n" + """
SELECT p.function, p.violation, p.n, round(p.n / t.calls, 6) AS share
FROM (SELECT function, violation, CAST(count(*) AS BIGINT) AS n
      FROM (SELECT function, unnest(violations) AS violation FROM viol) GROUP BY function, violation) p
JOIN (SELECT function, count(*) AS calls FROM viol GROUP BY function) t ON p.function = t.function
"""


DOMAIN_EVENTS = """
  SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 AS BIGINT) AS ord, name AS candidate
  FROM (SELECT DISTINCT event_type AS name FROM events)
  UNION ALL
  SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS ord, 'none' AS candidate FROM events
  HAVING count(*) > 0
"""

ROUTER_CALLS = """
  SELECT event_id AS call_id,
    CASE WHEN event_id % 6 = 1 THEN '{"name":"none"}'
         WHEN event_id % 6 = 2 THEN ' {"name" : "' || upper(event_type) || '" } '
         WHEN event_id % 6 = 3 THEN '{"name": "' || event_type || '", "k": 1}'
         WHEN event_id % 6 = 5 THEN '{"name": "' || event_type
         ELSE '{"name": "' || event_type || '"}' END AS text
  FROM events
"""

PARTIALS = """
  SELECT event_id AS partial_id,
    CASE WHEN event_id % 10 = 9 THEN '"' || upper(substr(event_type, 1, 2))
         ELSE substr('"' || event_type || '"', 1, CAST(event_id % (length(event_type) + 3) AS INTEGER)) END AS partial
  FROM events
"""


def router_sql() -> str:
    return "WITH " + _ctes(dom=DOMAIN_EVENTS, router=ROUTER_CALLS) + f"""
SELECT call_id, sel IS NOT NULL AS accepted, sel AS selected FROM (
  SELECT r.call_id, d.candidate AS sel
  FROM (SELECT call_id, CASE WHEN {rx('text', R.router)} THEN regexp_extract(text, {q(R.router)}, 1) END AS raw
        FROM router) r
  LEFT JOIN (SELECT DISTINCT candidate FROM dom) d ON r.raw = '"' || d.candidate || '"')
"""


def enum_completions_sql() -> str:
    pref = """
  SELECT cand, substr(cand, 1, CAST(len AS INTEGER)) AS prefix FROM (
    SELECT cand, unnest(range(0, length(cand) + 1)) AS len
    FROM (SELECT DISTINCT '"' || candidate || '"' AS cand FROM dom))
"""
    per = """
  SELECT p.partial, CAST(count(DISTINCT x.cand) AS BIGINT) AS n_candidates,
         array_to_string(list_sort(list_distinct(list(x.cand))), '|') AS candidates,
         array_to_string(list_sort(list_distinct(list(substr(x.cand, length(p.partial) + 1, 1)))), '') AS next_chars,
         bool_or(x.cand = p.partial) AS complete
  FROM (SELECT DISTINCT partial FROM partials) p JOIN pref x ON x.prefix = p.partial
  GROUP BY p.partial
"""
    return "WITH " + _ctes(dom=DOMAIN_EVENTS, partials=PARTIALS, pref=pref, per=per) + """
SELECT a.partial_id, a.partial, coalesce(b.n_candidates, 0) AS n_candidates,
       coalesce(b.candidates, '') AS candidates, coalesce(b.next_chars, '') AS next_chars,
       coalesce(b.n_candidates, 0) = 1 AS forced, coalesce(b.complete, false) AS complete
FROM partials a LEFT JOIN per b ON a.partial = b.partial
"""


# --------------------------------------------------------------------------
# B1-B6 over the combined catalog
# --------------------------------------------------------------------------

FN_ALL = """
  SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 AS BIGINT) AS ord, name FROM (SELECT DISTINCT event_type AS name FROM events)
  UNION ALL
  SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 + 100 AS BIGINT), name FROM (SELECT DISTINCT 'order_' || lower(o_orderstatus) AS name FROM orders)
  UNION ALL
  SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 + 200 AS BIGINT), name FROM (SELECT DISTINCT 'line_' || lower(l_linestatus) AS name FROM lineitem)
"""

SPECS_ALL = f"""
  SELECT function, CAST(ord AS INTEGER) AS ord, key, type FROM (
    {SPECS_EVENTS} UNION ALL {SPECS_WIDE} UNION ALL {SPECS_BENCH})
"""


def catalog_sql(select: str) -> str:
    return "WITH " + _ctes(fn_all=FN_ALL, specs_all=SPECS_ALL) + "\n" + select


def param_specs_sql() -> str:
    return catalog_sql("SELECT function, ord, key, type FROM specs_all")


def routing_domain_sql() -> str:
    return "WITH " + _ctes(dom=DOMAIN_EVENTS) + "\nSELECT ord, candidate FROM dom"


def merged_dictionary_sql() -> str:
    return catalog_sql("""
SELECT key, type, function FROM (
  SELECT s.key, s.type, s.function,
         row_number() OVER (PARTITION BY s.key ORDER BY f.ord DESC, s.ord DESC) AS rn
  FROM specs_all s JOIN fn_all f ON s.function = f.name)
WHERE rn = 1 AND key <> 'name'
UNION ALL
SELECT 'name', 'enum', NULL FROM fn_all HAVING count(*) > 0
""")


def resolve_types_sql() -> str:
    return catalog_sql(f"""
SELECT function, ord, key, type, {canonical('type')} AS canonical_type,
       CASE WHEN {canonical('type')} IS NULL THEN 'unsupported_type' END AS error
FROM specs_all""")


def key_conflicts_sql() -> str:
    return catalog_sql(f"""
SELECT key, CAST(count(DISTINCT ctype) AS BIGINT) AS n_types,
       array_to_string(list_sort(list_distinct(list(function))), ',') AS functions,
       array_to_string(list_sort(list_distinct(list(ctype))), ',') AS types
FROM (SELECT *, {canonical('type')} AS ctype FROM specs_all)
GROUP BY key HAVING count(DISTINCT ctype) > 1""")


def resolve_function_sql() -> str:
    names = """
  SELECT event_id AS name_id, CASE WHEN event_id % 4 = 0 THEN upper(event_type) ELSE event_type END AS name
  FROM events
"""
    cat = """
  SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 AS BIGINT) AS fn_ord, name,
         'Record a ' || name || ' event.' AS description, 'null' AS returns, 1 AS n_params
  FROM (SELECT DISTINCT event_type AS name FROM events)
"""
    return "WITH " + _ctes(names=names, cat=cat) + """
SELECT n.name_id, n.name, c.fn_ord, c.description, c.returns, CAST(c.n_params AS INTEGER) AS n_params
FROM names n LEFT JOIN cat c ON n.name = c.name
"""


# --------------------------------------------------------------------------
# Vocabulary tables
# --------------------------------------------------------------------------

PIECE = " ?\\p{L}+| ?[0-9]+| ?[^\\p{L}0-9 ]| +"
HEXD = "'0123456789ABCDEF'"


def byte_level_encode(x: str) -> str:
    """Text -> byte-level string, byte by byte through the hex form of its UTF-8."""
    b = (f"CAST((instr({HEXD}, substr(hex(encode({x})), 2 * i + 1, 1)) - 1) * 16 "
         f"+ instr({HEXD}, substr(hex(encode({x})), 2 * i + 2, 1)) - 1 AS INTEGER)")
    ch = (f"CASE WHEN {b} BETWEEN 33 AND 126 OR {b} BETWEEN 161 AND 172 OR {b} BETWEEN 174 AND 255 "
          f"THEN chr({b}) WHEN {b} <= 32 THEN chr(256 + {b}) WHEN {b} BETWEEN 127 AND 160 "
          f"THEN chr({b} + 162) ELSE chr(323) END")
    return f"array_to_string(list_transform(range(0, octet_length(encode({x}))), lambda i: {ch}), '')"


VOCAB = f"""
  SELECT CAST(row_number() OVER (ORDER BY text) - 1 AS BIGINT) AS token_id,
         CAST(row_number() OVER (ORDER BY text) - 1 AS BIGINT) AS ord, text
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, {q(PIECE)}, 0)) AS text FROM (
          SELECT text FROM benchmark
          UNION ALL SELECT text FROM conversations
          UNION ALL SELECT props AS text FROM events))
"""

RAW_VOCAB = f"""
  SELECT token_id, ord, {byte_level_encode('text')} AS raw, text FROM vocab
  UNION ALL
  SELECT CAST((SELECT count(*) FROM vocab) + row_number() OVER (ORDER BY raw) - 1 AS BIGINT) AS token_id,
         CAST((SELECT count(*) FROM vocab) + row_number() OVER (ORDER BY raw) - 1 AS BIGINT) AS ord,
         raw, chr(65533) AS text
  FROM (SELECT DISTINCT unnest(string_split({byte_level_encode('c')}, '')) AS raw
        FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM vocab) WHERE unicode(c) > 127)
"""

UNIQUE = """
  SELECT text, arg_max(token_id, ord) AS token_id, min(ord) AS first_ord
  FROM raw_vocab WHERE length(text) > 0 GROUP BY text
"""

TOKEN_PREFIXES = """
  SELECT text, token_id, first_ord, depth, substr(text, 1, CAST(depth AS INTEGER)) AS prefix
  FROM (SELECT *, unnest(range(1, length(text) + 1)) AS depth FROM uniq)
"""

NODES = """
  SELECT n.prefix, CAST(n.depth AS INTEGER) AS depth, n.first, u.token_id
  FROM (SELECT prefix, min(depth) AS depth, min(first_ord) AS first FROM tp GROUP BY prefix) n
  LEFT JOIN uniq u ON u.text = n.prefix
"""

DFS = """
  SELECT text AS prefix, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS dfs_ord
  FROM (SELECT tp.text, list(n.first ORDER BY tp.depth) AS path
        FROM tp JOIN nodes n ON tp.prefix = n.prefix GROUP BY tp.text)
"""

PREFIX_TABLE = """
  SELECT n.prefix, substr(n.prefix, 1, n.depth - 1) AS parent, n.depth, substr(n.prefix, n.depth, 1) AS char,
         n.token_id, n.first, d.dfs_ord
  FROM nodes n LEFT JOIN dfs d ON n.prefix = d.prefix
"""


def vocab_ctes(**extra: str) -> str:
    ctes = {"vocab": VOCAB, "raw_vocab": RAW_VOCAB, "uniq": UNIQUE, "tp": TOKEN_PREFIXES,
            "nodes": NODES, "dfs": DFS, "ptable": PREFIX_TABLE}
    ctes.update(extra)
    return "WITH " + _ctes(**ctes)


def decoded_vocab_sql() -> str:
    return vocab_ctes() + "\nSELECT token_id, ord, raw, text FROM raw_vocab WHERE length(text) > 0"


def unique_text_sql() -> str:
    return vocab_ctes() + "\nSELECT text, token_id, first_ord FROM uniq"


def prefix_table_sql() -> str:
    return vocab_ctes() + "\nSELECT * FROM ptable"


def prefix_fanout_sql() -> str:
    return vocab_ctes() + """
SELECT depth, CAST(count(*) AS BIGINT) AS n_nodes, CAST(count(token_id) AS BIGINT) AS n_terminal,
       round(avg(children), 6) AS avg_children, CAST(max(children) AS BIGINT) AS max_children
FROM (SELECT a.depth, a.token_id, coalesce(k.children, 0) AS children
      FROM (SELECT prefix, depth, token_id FROM ptable UNION ALL SELECT '', 0, NULL) a
      LEFT JOIN (SELECT parent, count(*) AS children FROM ptable GROUP BY parent) k ON a.prefix = k.parent)
GROUP BY depth
"""


QUERIES_SQL = """
  SELECT CAST(row_number() OVER (ORDER BY query) - 1 AS BIGINT) AS query_id, query FROM (
    SELECT DISTINCT unnest([substr(w, 1, 1), substr(w, 1, 2), substr(w, 1, 3)]) AS query
    FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+', 0)) AS w FROM benchmark))
"""


def prefix_search_sql() -> str:
    return vocab_ctes(queries=QUERIES_SQL) + """
SELECT qq.query_id, qq.query, p.token_id
FROM queries qq JOIN (SELECT token_id, substr(text, 1, CAST(d AS INTEGER)) AS prefix
                      FROM (SELECT *, unnest(range(0, length(text) + 1)) AS d FROM uniq)) p
ON qq.query = p.prefix
"""


STATES = """
  SELECT CAST(row_number() OVER (ORDER BY function, text) - 1 AS BIGINT) AS state_id, function, text FROM (
    SELECT DISTINCT function, substr(text, 1, CAST(n AS INTEGER)) AS text
    FROM (SELECT function, text, unnest(range(0, length(text) + 1)) AS n FROM calls))
"""


def allowed_tokens_ctes() -> dict[str, str]:
    """The mask by exact pre-filter: a token can only be allowed if its first
    character, then its first two are (viability is prefix-closed), then the
    whole text is checked."""
    specs, calls = FIXTURES["events"]
    ctes = {"vocab": VOCAB, "raw_vocab": RAW_VOCAB, "uniq": UNIQUE, "tp": TOKEN_PREFIXES,
            "nodes": NODES, "dfs": DFS, "ptable": PREFIX_TABLE,
            "specs": specs, "calls": calls, "schema": SCHEMA}
    ctes["states"] = STATES
    ctes.update(chain("states", "s_"))
    ctes["first_chars"] = "  SELECT DISTINCT substr(text, 1, 1) AS c FROM uniq"
    ctes["c1"] = """
  SELECT s.state_id, s.function, f.c, s.text || f.c AS text
  FROM s_parsed s, first_chars f WHERE s.status <> 'REJECTED'
"""
    ctes.update(chain("c1", "f_"))
    ctes["first_two"] = "  SELECT DISTINCT substr(text, 1, 1) AS c, substr(text, 1, 2) AS cc FROM uniq"
    ctes["c1b"] = """
  SELECT f.state_id, f.function, w.cc, s.text || w.cc AS text
  FROM f_parsed f JOIN first_two w ON w.c = f.c JOIN states s ON s.state_id = f.state_id
  WHERE f.status <> 'REJECTED'
"""
    ctes.update(chain("c1b", "g_"))
    ctes["c2"] = """
  SELECT g.state_id, g.function, u.token_id, s.text || u.text AS text
  FROM g_parsed g JOIN uniq u ON substr(u.text, 1, 2) = g.cc
  JOIN states s ON s.state_id = g.state_id
  WHERE g.status <> 'REJECTED'
"""
    ctes.update(chain("c2", "t_"))
    ctes["mask"] = """
  SELECT t.state_id, t.token_id, d.dfs_ord AS ord FROM t_parsed t
  JOIN uniq u ON u.token_id = t.token_id JOIN dfs d ON d.prefix = u.text
  WHERE t.status <> 'REJECTED'
"""
    return ctes


def allowed_tokens_sql() -> str:
    return "WITH " + _ctes(**allowed_tokens_ctes()) + "\nSELECT state_id, token_id, ord FROM mask"


def mask_size_sql() -> str:
    return "WITH " + _ctes(**allowed_tokens_ctes()) + """
SELECT s.state_id, coalesce(m.n, 0) AS n_allowed,
       round(coalesce(m.n, 0) / (SELECT count(*) FROM uniq), 6) AS share
FROM states s LEFT JOIN (SELECT state_id, CAST(count(*) AS BIGINT) AS n FROM mask GROUP BY state_id) m
ON s.state_id = m.state_id
"""


def charset_audit_sql() -> str:
    ws = q("\\A[ \\t\\n\\r\\f\\x0B]+\\z")
    ctrl = q("[\\x00-\\x1f\\x7f]")
    return vocab_ctes() + f"""
SELECT class, n FROM (
  SELECT
    CAST(count(*) FILTER (WHERE raw <> text) AS BIGINT) AS raw_differs,
    CAST(count(*) FILTER (WHERE starts_with(text, ' ')) AS BIGINT) AS space_prefixed,
    CAST(count(*) FILTER (WHERE regexp_matches(text, {ws})) AS BIGINT) AS whitespace_only,
    CAST(count(*) FILTER (WHERE regexp_matches(text, {ctrl}) AND NOT regexp_matches(text, {ws})) AS BIGINT) AS control_inside,
    CAST(count(*) FILTER (WHERE length(text) = 0) AS BIGINT) AS empty,
    CAST(count(*) FILTER (WHERE dup) AS BIGINT) AS duplicate_text
  FROM (SELECT r.*, coalesce(d.dup, false) AS dup FROM raw_vocab r
        LEFT JOIN (SELECT text, true AS dup FROM raw_vocab WHERE length(text) > 0
                   GROUP BY text HAVING count(*) > 1) d ON r.text = d.text))
UNPIVOT (n FOR class IN (raw_differs, space_prefixed, whitespace_only, control_inside, empty, duplicate_text))
"""


# --------------------------------------------------------------------------
# E: selection
# --------------------------------------------------------------------------

SCORES = """
  SELECT vec_id AS step_id, CAST(pos AS BIGINT) AS token_id, CAST(embedding[pos + 1] AS DOUBLE) AS score
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings)
"""

MASK = """
  SELECT vec_id AS step_id, CAST(pos AS BIGINT) AS token_id, CAST((pos * 5) % 64 AS BIGINT) AS ord FROM (
    SELECT vec_id, unnest(CASE WHEN vec_id % 13 = 0 THEN []::BIGINT[]
                               WHEN vec_id % 11 = 0 THEN [vec_id % len(embedding)]
                               ELSE list_filter(range(len(embedding)), lambda p: (vec_id + p) % 7 = 0) END) AS pos
    FROM embeddings)
"""


def select_sql(body: str) -> str:
    return "WITH " + _ctes(scores=SCORES, mask=MASK) + "\n" + body


def apply_mask_sql() -> str:
    return select_sql("SELECT s.step_id, s.token_id, m.ord, s.score FROM scores s JOIN mask m "
                      "ON s.step_id = m.step_id AND s.token_id = m.token_id")


def masked_argmax_sql() -> str:
    return select_sql("""
SELECT step_id, token_id, score FROM (
  SELECT s.step_id, s.token_id, s.score,
         row_number() OVER (PARTITION BY s.step_id ORDER BY s.score DESC, m.ord ASC) AS rn
  FROM scores s JOIN mask m ON s.step_id = m.step_id AND s.token_id = m.token_id)
WHERE rn = 1""")


def forced_choices_sql() -> str:
    return select_sql("SELECT step_id, min(token_id) AS token_id FROM mask GROUP BY step_id HAVING count(*) = 1")


def scoring_rows_sql() -> str:
    return select_sql("""
SELECT s.step_id, s.token_id, m.ord, s.score FROM scores s JOIN mask m
  ON s.step_id = m.step_id AND s.token_id = m.token_id
WHERE s.step_id NOT IN (SELECT step_id FROM mask GROUP BY step_id HAVING count(*) = 1)""")


def deadlocks_sql() -> str:
    return select_sql("SELECT vec_id AS step_id FROM embeddings WHERE vec_id NOT IN (SELECT step_id FROM mask)")


def route_calls_sql() -> str:
    return "WITH " + _ctes(dom=DOMAIN_EVENTS, router=ROUTER_CALLS) + f"""
, routed AS (
  SELECT r.call_id AS prompt_id, d.candidate AS selected
  FROM (SELECT call_id, CASE WHEN {rx('text', R.router)} THEN regexp_extract(text, {q(R.router)}, 1) END AS raw
        FROM router) r
  JOIN (SELECT DISTINCT candidate FROM dom) d ON r.raw = '"' || d.candidate || '"')
SELECT r.prompt_id, coalesce(f.name, 'none') AS name, f.name IS NOT NULL AS extract
FROM routed r LEFT JOIN (SELECT DISTINCT event_type AS name FROM events) f ON r.selected = f.name
"""


def over_budget_sql() -> str:
    steps = f"""
  SELECT doc_id AS prompt_id,
         CASE WHEN doc_id % 3 = 0 THEN 'route' WHEN doc_id % 3 = 1 THEN 'extract' ELSE 'other' END AS phase,
         CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token
  FROM (SELECT doc_id, regexp_extract_all(text, {q(PIECE)}, 0) AS l FROM documents)
"""
    return "WITH " + _ctes(steps=steps) + """
, b AS (SELECT *, CASE phase WHEN 'route' THEN 50 WHEN 'extract' THEN 300 ELSE 500 END AS budget FROM steps)
SELECT prompt_id, phase, CAST(count(*) AS BIGINT) AS n_tokens, CAST(any_value(budget) AS INTEGER) AS budget,
       string_agg(token, '' ORDER BY pos) FILTER (WHERE pos < budget) AS partial_text
FROM b GROUP BY prompt_id, phase HAVING count(*) > any_value(budget)
"""


# --------------------------------------------------------------------------
# D1-D3, E6, E9
# --------------------------------------------------------------------------

def _prompt_constants():
    from callscope.operators import prompts as P
    return P


CAT_EVENTS = """
  SELECT CAST(dense_rank() OVER (ORDER BY name) - 1 AS BIGINT) AS ord, name,
         'Record a ' || name || ' event.' AS description
  FROM (SELECT DISTINCT event_type AS name FROM events)
"""

PROMPTS = """
  SELECT conv_id * 1000 + turn AS prompt_id, text AS prompt FROM conversations WHERE role = 'user'
"""

EVENT_PROMPTS = """
  SELECT event_id AS prompt_id, event_type,
    CASE WHEN event_id % 4 = 0 THEN 'Record a ' || event_type || ' event with k ' || k
         WHEN event_id % 4 = 1 THEN 'Please log this ' || event_type || ' now'
         WHEN event_id % 4 = 2 THEN 'What is the weather like today?'
         ELSE upper(event_type) || ' happened, k=' || k || ' (value ' || CAST(CAST(value AS DECIMAL(10,2)) AS STRING) || ')' END AS prompt
  FROM (SELECT *, regexp_extract(props, '-?[0-9]+', 0) AS k FROM events)
"""


def router_prompts_sql() -> str:
    P = _prompt_constants()
    return "WITH " + _ctes(cat=CAT_EVENTS, prompts=PROMPTS) + f"""
, block AS (SELECT string_agg('- ' || name || ': ' || description || chr(10), '' ORDER BY ord) AS b FROM cat)
SELECT p.prompt_id, {sql_literal(P.ROUTER_HEADER)} || k.b || {sql_literal(P.ROUTER_EXAMPLES)}
       || 'User: "' || p.prompt || '"' || chr(10) || 'Output:' AS text
FROM prompts p, block k
"""


EXAMPLES = """
  SELECT DISTINCT event_type AS function, 'Do not count the ' || event_type || ' event.' || chr(10) AS contradiction,
    chr(10) || 'User: Record a ' || event_type || ' event with k 5' || chr(10) || 'Function: ' || event_type || chr(10)
    || 'Output: {"k": 5}' || chr(10) AS counter_examples
  FROM events WHERE event_type < 'q'
"""


def extractor_prompts_sql() -> str:
    P = _prompt_constants()
    return "WITH " + _ctes(prompts=EVENT_PROMPTS, ex=EXAMPLES) + f"""
SELECT prompt_id, event_type AS name,
  {sql_literal(P.EXTRACTOR_HEADER)} || 'Function: ' || event_type || chr(10) || coalesce(contradiction, '')
  || 'Parameters:' || chr(10) || '  k (integer)' || chr(10) || chr(10)
  || {sql_literal(P.EXTRACTOR_RULES)} || {sql_literal(P.EXTRACTOR_GENERIC_EXAMPLES)} || coalesce(counter_examples, '') || chr(10)
  || {sql_literal(P.EXTRACTOR_REMINDER)}
  || 'User: "' || prompt || '"' || chr(10) || 'Function: ' || event_type || chr(10) || 'Output:' || chr(10) AS text
FROM prompts LEFT JOIN ex ON event_type = function
"""


def attach_examples_sql() -> str:
    return "WITH " + _ctes(ex=EXAMPLES) + """
SELECT n.name_id, n.name, coalesce(e.contradiction, '') AS contradiction, coalesce(e.counter_examples, '') AS counter_examples
FROM (SELECT event_id AS name_id,
             CASE WHEN event_id % 4 = 0 THEN upper(event_type) ELSE event_type END AS name FROM events) n
LEFT JOIN ex e ON n.name = e.function
"""


TWO_PHASE = """
  SELECT p.prompt_id, p.prompt, p.event_type, r.name AS routed,
         regexp_extract(p.prompt, '-?[0-9]+(?:\\.[0-9]+)?', 0) AS k
  FROM prompts p LEFT JOIN (
    SELECT prompt_id, arg_min(c.name, c.ord) AS name
    FROM (SELECT prompt_id, unnest(regexp_extract_all(lower(prompt), '[\\p{L}0-9_]+', 0)) AS w FROM prompts) x
    JOIN cat c ON lower(c.name) = x.w GROUP BY prompt_id) r ON p.prompt_id = r.prompt_id
"""


def two_phase_results_sql() -> str:
    return "WITH " + _ctes(cat=CAT_EVENTS, prompts=EVENT_PROMPTS, tp=TWO_PHASE) + """
SELECT prompt_id, prompt, 'none' AS name, '{}' AS parameters FROM tp WHERE routed IS NULL
UNION ALL
SELECT prompt_id, prompt, routed AS name, '{"k": ' || k || '}' AS parameters
FROM tp WHERE routed IS NOT NULL AND regexp_matches(k, '\\A-?(?:0|[1-9][0-9]*)\\z')
"""


def two_phase_errors_sql() -> str:
    return "WITH " + _ctes(cat=CAT_EVENTS, prompts=EVENT_PROMPTS, tp=TWO_PHASE) + """
SELECT prompt_id, 'extract' AS phase, 'rejected' AS reason
FROM tp WHERE routed IS NOT NULL AND NOT regexp_matches(k, '\\A-?(?:0|[1-9][0-9]*)\\z')
"""


def result_coverage_sql() -> str:
    return "WITH " + _ctes(cat=CAT_EVENTS, prompts=EVENT_PROMPTS, tp=TWO_PHASE) + """
SELECT prompt_id, 'extract_rejected' AS reason
FROM tp WHERE routed IS NOT NULL AND NOT regexp_matches(k, '\\A-?(?:0|[1-9][0-9]*)\\z')
"""


# --------------------------------------------------------------------------
# G1, G2
# --------------------------------------------------------------------------

# By construction of the views: an event's call is complete and valid for
# event_id % 17 up to 7, and what happens to its output follows from its id.
EVALUATED = """
  SELECT event_type AS function,
    CASE WHEN event_id % 5 = 3 THEN '<missing>' WHEN event_id % 17 = 2 THEN '<repeated>'
         WHEN event_id % 5 = 1 THEN 'none' ELSE event_type END AS actual,
    event_id % 5 IN (0, 4) AND event_id % 11 NOT IN (3, 5, 7) AND event_id % 17 <> 2 AS params_ok
  FROM events WHERE event_id % 17 <= 7
"""

EVALUATED_ALL = EVALUATED + """
  UNION ALL
  SELECT '<unexpected>', event_type, false FROM events WHERE event_id % 17 <= 7 AND event_id % 13 = 0
"""


def accuracy_report_sql() -> str:
    return "WITH " + _ctes(j=EVALUATED_ALL) + """
SELECT coalesce(function, '__all__') AS function, n, routing_ok, params_ok, exact_ok, round(exact_ok / n, 6) AS accuracy
FROM (SELECT function, CAST(count(*) AS BIGINT) AS n,
             CAST(count(*) FILTER (WHERE actual = function) AS BIGINT) AS routing_ok,
             CAST(count(*) FILTER (WHERE params_ok) AS BIGINT) AS params_ok,
             CAST(count(*) FILTER (WHERE actual = function AND params_ok) AS BIGINT) AS exact_ok
      FROM j GROUP BY ROLLUP (function))
"""


def parameter_report_sql() -> str:
    return "WITH " + _ctes(j=EVALUATED) + """
SELECT function, 'k' AS key, 'integer' AS value_class, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE params_ok) AS BIGINT) AS n_ok, round(count(*) FILTER (WHERE params_ok) / count(*), 6) AS accuracy
FROM j GROUP BY function
"""


def routing_confusion_sql() -> str:
    return "WITH " + _ctes(j=EVALUATED_ALL) + """
SELECT function AS expected, actual, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2
"""


# --------------------------------------------------------------------------
# A1-A4
# --------------------------------------------------------------------------

CATALOG_DOCS = """
  SELECT 'catalog_' || lpad(CAST(g AS STRING), 6, '0') AS source,
         CASE WHEN g % 50 = 7 THEN '{"functions": [' || body || ']}'
              WHEN g % 50 = 13 THEN '[' || body
              WHEN g % 50 = 21 THEN '[' || body || ']]'
              WHEN g % 50 = 29 THEN '[' || body || '] trailing'
              WHEN g % 50 = 37 THEN '[' || body || '], [' || body || ']' ELSE '[' || body || ']' END AS text
  FROM (SELECT g, string_agg(elem, ', ' ORDER BY pk) AS body FROM (
    SELECT p_partkey // 4 AS g, p_partkey AS pk,
      '{' || CASE WHEN d = 1 THEN '' ELSE '"name": ' || CASE WHEN d = 6 THEN to_json('part"' || p_partkey) ELSE to_json('part_' || p_partkey) END || ', ' END
      || '"description": ' || CASE WHEN d = 5 THEN CAST(p_size AS STRING) ELSE to_json(p_name) END
      || ', "parameters": {"size": {"type": "integer"' || CASE WHEN d = 4 THEN ', "min": 0' ELSE '' END
      || '}, "price": {"type": "' || CASE WHEN d = 3 THEN 'decimal' ELSE 'number' END || '"}, "brand": {"type": "string"}}'
      || ', "returns": {"type": "' || CASE WHEN d = 7 THEN 'Integer' ELSE 'boolean' END || '"}'
      || CASE WHEN d = 2 THEN ', "version": 1' ELSE '' END || '}' AS elem
    FROM (SELECT *, p_partkey % 101 AS d FROM part)) GROUP BY g)
"""

PROMPT_DOCS = """
  SELECT 'prompts_' || lpad(CAST(conv_id AS STRING), 6, '0') || '_' || lpad(CAST(chunk AS STRING), 4, '0') AS source,
         '[' || string_agg(elem, ', ' ORDER BY turn) || ']'
         || CASE WHEN conv_id % 31 = 5 THEN ']' WHEN conv_id % 31 = 9 THEN ' x' ELSE '' END AS text
  FROM (SELECT conv_id, chunk, turn,
          '{"' || CASE WHEN conv_id % 9 = 4 AND first THEN 'question' ELSE 'prompt' END || '": ' || to_json(text)
          || CASE WHEN conv_id % 9 = 7 AND first THEN ', "role": "user"' ELSE '' END || '}' AS elem
        FROM (SELECT conv_id, turn, text, turn // 64 AS chunk,
                     turn = min(turn) OVER (PARTITION BY conv_id, turn // 64) AS first
              FROM conversations WHERE role = 'user'))
  GROUP BY conv_id, chunk
"""

BAD_ID = "'[\"\\\\\\x00-\\x1f]'"
TYPE_LIST = "('string', 'number', 'integer', 'float', 'boolean', 'null')"


def _type_field_rejects(src: str, raw: str, path: str) -> str:
    """Rows (source, ord, reason, field) for a {"type": name} value."""
    return f"""
  SELECT source, ord, 'not_object' AS reason, {path} AS field FROM {src} WHERE json_type({raw}) <> 'OBJECT'
  UNION ALL SELECT source, ord, 'missing_field', {path} || '.type' FROM {src}
    WHERE json_type({raw}) = 'OBJECT' AND NOT list_contains(json_keys({raw}), 'type')
  UNION ALL SELECT source, ord, 'extra_field', path0 || '.' || k FROM (
    SELECT source, ord, {path} AS path0, unnest(list_filter(json_keys({raw}), lambda x: x <> 'type')) AS k
    FROM {src} WHERE json_type({raw}) = 'OBJECT')
  UNION ALL SELECT source, ord, 'bad_type', {path} || '.type' FROM {src}
    WHERE json_type({raw}) = 'OBJECT' AND list_contains(json_keys({raw}), 'type')
      AND NOT coalesce(json_extract_string({raw}, '$.type') IN {TYPE_LIST}, false)
"""


def rejects_ctes(kind: str) -> dict[str, str]:
    docs = CATALOG_DOCS if kind == "function" else PROMPT_DOCS
    fields = ("name", "description", "parameters", "returns") if kind == "function" else ("prompt",)
    flist = "[" + ", ".join(f"'{f}'" for f in fields) + "]"
    ctes = {"docs": docs}
    ctes["els"] = """
  SELECT source, CAST(unnest(range(len(l))) AS BIGINT) AS ord, unnest(l) AS e
  FROM (SELECT source, json_extract(text, '$[*]') AS l FROM docs WHERE json_valid(text) AND json_type(text) = 'ARRAY')
"""
    parts = [
        "SELECT source, CAST(NULL AS BIGINT) AS ord, CASE WHEN NOT json_valid(text) THEN 'invalid_json' ELSE 'root_not_list' END AS reason, '' AS field FROM docs WHERE NOT json_valid(text) OR json_type(text) <> 'ARRAY'",
        "SELECT source, ord, 'not_object', '' FROM els WHERE json_type(e) <> 'OBJECT'",
    ]
    for f in fields:
        parts.append(f"SELECT source, ord, 'missing_field', '{f}' FROM els WHERE json_type(e) = 'OBJECT' AND NOT list_contains(json_keys(e), '{f}')")
    parts.append(f"SELECT source, ord, 'extra_field', k FROM (SELECT source, ord, unnest(list_filter(json_keys(e), lambda x: NOT list_contains({flist}, x))) AS k FROM els WHERE json_type(e) = 'OBJECT')")
    for f in (("name", "description") if kind == "function" else ("prompt",)):
        parts.append(f"SELECT source, ord, 'not_string', '{f}' FROM els WHERE list_contains(json_keys(e), '{f}') AND json_type(e, '$.{f}') <> 'VARCHAR'")
    if kind == "function":
        parts.append(f"SELECT source, ord, 'unsupported_identifier', 'name' FROM els WHERE json_type(e, '$.name') = 'VARCHAR' AND regexp_matches(json_extract_string(e, '$.name'), {BAD_ID})")
        parts.append("SELECT source, ord, 'not_object', 'parameters' FROM els WHERE list_contains(json_keys(e), 'parameters') AND json_type(e, '$.parameters') <> 'OBJECT'")
        ctes["pels"] = """
  SELECT source, ord, 'parameters.' || k AS path, k, json_extract(p, '$."' || k || '"') AS raw
  FROM (SELECT source, ord, p, unnest(json_keys(p)) AS k
        FROM (SELECT source, ord, json_extract(e, '$.parameters') AS p FROM els WHERE json_type(e, '$.parameters') = 'OBJECT'))
"""
        ctes["rels"] = "SELECT source, ord, 'returns' AS path, json_extract(e, '$.returns') AS raw FROM els WHERE list_contains(json_keys(e), 'returns')"
        parts.append(f"SELECT source, ord, 'unsupported_identifier', path FROM pels WHERE regexp_matches(k, {BAD_ID})")
        parts.append(_type_field_rejects("pels", "raw", "path"))
        parts.append(_type_field_rejects("rels", "raw", "path"))
    ctes["rejects"] = "\n  UNION ALL ".join(parts)
    return ctes


def definition_rejects_sql(kind: str) -> str:
    return "WITH " + _ctes(**rejects_ctes(kind)) + "\nSELECT source, ord, reason, field FROM rejects"


def parse_catalog_sql() -> str:
    return "WITH " + _ctes(**rejects_ctes("function")) + """
SELECT source, ord, json_extract_string(e, '$.name') AS name, json_extract_string(e, '$.description') AS description,
  array_to_string(list_transform(json_keys(json_extract(e, '$.parameters')),
      lambda k: k || ':' || json_extract_string(e, '$.parameters.' || k || '.type')), ',') AS params,
  json_extract_string(e, '$.returns.type') AS returns
FROM els WHERE source NOT IN (SELECT source FROM rejects)
"""


def parse_prompts_sql() -> str:
    return "WITH " + _ctes(**rejects_ctes("prompt")) + """
SELECT source, row_number() OVER (ORDER BY source, ord) - 1 AS prompt_id, json_extract_string(e, '$.prompt') AS prompt
FROM els WHERE source NOT IN (SELECT source FROM rejects)
"""


def written_results_sql() -> str:
    return "WITH " + _ctes(cat=CAT_EVENTS, prompts=EVENT_PROMPTS, tp=TWO_PHASE) + """
SELECT prompt, 'none' AS name, '{}' AS parameters FROM tp WHERE routed IS NULL
UNION ALL
SELECT prompt, routed AS name, '{"k":' || k || '}' AS parameters
FROM tp WHERE routed IS NOT NULL AND regexp_matches(k, '\\A-?(?:0|[1-9][0-9]*)\\z')
"""


def retry_sql() -> str:
    return "WITH " + parse_ctes("events") + """
SELECT call_id AS prompt_id, function, CASE WHEN status = 'INCOMPLETE' THEN text || '}' ELSE text END AS output
FROM parsed
"""
