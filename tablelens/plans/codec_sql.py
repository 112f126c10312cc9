"""SQL for comparison: which bodies are documents, and what is wrong with those that are.

Written from the rules of the codec, not from its code: a body is a document where each
check below holds. Left out is what no test table has: repeated keys, and objects that
could be types of two kinds.
"""

from __future__ import annotations


def _int(j: str, kind: str = "INTEGER") -> str:
    return f"coalesce(json_type({j}) IN ('BIGINT', 'UBIGINT') AND try_cast({j}->>'$' AS {kind}) IS NOT NULL, false)"


def _long(j: str) -> str:
    return _int(j, "BIGINT")


def _text(j: str) -> str:
    return f"coalesce(json_type({j}) = 'VARCHAR', false)"


def _bool(j: str) -> str:
    return f"coalesce(json_type({j}) = 'BOOLEAN', false)"


def _optional(j: str, check: str) -> str:
    return f"(coalesce(json_type({j}), 'NULL') = 'NULL' OR {check})"


def _items(j: str) -> str:
    return f"CASE json_type({j}) WHEN 'ARRAY' THEN json_extract({j}, '$[*]') ELSE []::JSON[] END"


def _list(j: str, x: str, check: str) -> str:
    """j is a list whose items x all pass a check."""
    return f"(coalesce(json_type({j}) = 'ARRAY', false) AND len(list_filter(json_extract({j}, '$[*]'), lambda {x}: NOT (coalesce(json_type({x}) = 'OBJECT', false) AND {check}))) = 0)"


def _member(j: str, key: str) -> str:
    return f"json_extract({j}, '$.\"' || {key} || '\"')"


def _map(j: str, k: str, check: str) -> str:
    """j is an object whose keys k all pass a check."""
    return f"(coalesce(json_type({j}) = 'OBJECT', false) AND len(list_filter(json_keys({j}), lambda {k}: NOT ({check}))) = 0)"


def _transform(j: str) -> str:
    return f"({_text(j)} AND regexp_full_match({j}->>'$', '(void|identity|year|month|day|hour)|(bucket|truncate)\\[0*([0-9]{{1,9}}|[1-3][0-9]{{9}}|4[01][0-9]{{8}}|42[0-8][0-9]{{7}}|429[0-3][0-9]{{6}}|4294[0-8][0-9]{{5}}|42949[0-5][0-9]{{4}}|429496[0-6][0-9]{{3}}|4294967[01][0-9]{{2}}|42949672[0-8][0-9]|429496729[0-5])\\]'))"


def _dialect(dialect: str) -> tuple[str, str, str]:
    """(type of a field x, whether x has one, primitive types) of a dialect."""
    plain = "boolean|int|long|float|double|date|time|timestamp|timestampz|string|uuid|binary"
    numbers = "decimal\\(0*[0-9]{1,9},BLANK0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\)|fixed\\[0*[0-9]{1,19}\\]"
    if dialect == "spec":
        return "coalesce(x->'field_type', x->'type')", "((x->'field_type') IS NULL OR (x->'type') IS NULL)", f"{plain}|timestamptz|{numbers.replace('BLANK', chr(92) + 's*')}"
    return "(x->'field_type')", "true", f"{plain}|{numbers.replace('BLANK', '')}"


def documents(dialect: str) -> str:
    """WITH ... ending in accepted (meta_id, d), the documents, and inside (meta_id, s, sid,
    id, t, ok), their fields at any depth with the position and id of their schema."""
    kind, single, primitive = _dialect(dialect)
    field_ok = f"({_int("x->'id'")} AND {_text("x->'name'")} AND {_bool("x->'required'")} AND {_optional("x->'doc'", _text("x->'doc'"))} AND {single})"
    field = f"{{'id': x->'id', 't': {kind}, 'ok': coalesce(json_type(x) = 'OBJECT', false) AND {field_ok}}}"
    # a name mapping may hold others; two levels are looked at
    names = lambda m, more: f"({_optional(f'{m}->{chr(39)}field-id{chr(39)}', _int(f'{m}->{chr(39)}field-id{chr(39)}'))} AND coalesce(json_type({m}->'names') = 'ARRAY', false) AND {more})"
    inner = _optional("m->'fields'", _list("m->'fields'", "o", names("o", "true")))
    mapping = _optional("x->'name-mapping'", f"(coalesce(json_type(x->'name-mapping') = 'OBJECT', false) AND {_list("x->'name-mapping'->'default'", 'm', names('m', inner))})")
    schema = f"({_int("x->'schema-id'")} AND coalesce(json_type(x->'fields') = 'ARRAY', false) AND {_optional("x->'identifier-field-ids'", f"coalesce(json_type(x->'identifier-field-ids') = 'ARRAY', false) AND len(list_filter(json_extract(x->'identifier-field-ids', '$[*]'), lambda i: NOT {_int('i')})) = 0")} AND {mapping})"
    spec_field = f"({_int("y->'source-id'")} AND {_int("y->'field-id'")} AND {_text("y->'name'")} AND {_transform("y->'transform'")})"
    sort_field = f"({_int("y->'source-id'")} AND {_transform("y->'transform'")} AND coalesce((y->>'direction') IN ('asc', 'desc'), false) AND coalesce((y->>'null-order') IN ('nulls-first', 'nulls-last'), false))"
    summary = f"({_map("x->'summary'", 'k', f"CASE WHEN k = 'operation' THEN coalesce(json_type(x->'summary'->'operation'), 'NULL') = 'NULL' OR coalesce((x->'summary'->>'operation') IN ('append', 'replace', 'overwrite', 'delete'), false) ELSE {_text(_member("(x->'summary')", 'k'))} END")})"
    snapshot = f"({_long("x->'snapshot-id'")} AND {_optional("x->'parent-snapshot-id'", _long("x->'parent-snapshot-id'"))} AND {_long("x->'sequence-number'")} AND {_long("x->'timestamp-ms'")} AND {_text("x->'manifest-list'")} AND {summary} AND {_optional("x->'schema-id'", _long("x->'schema-id'"))})"
    r = _member("(d->'refs')", "k")
    number = (lambda key, check: _optional(f"{r}->'{key}'", check(f"({r}->'{key}')"))) if dialect == "spec" else (lambda key, check: check(f"({r}->'{key}')"))
    age = number("max-ref-age-ms", _long)
    ref = f"(coalesce(json_type({r}) = 'OBJECT', false) AND {_long(f"({r}->'snapshot-id')")} AND CASE {r}->>'type' WHEN 'tag' THEN {age} WHEN 'branch' THEN {age} AND {number('max-snapshot-age-ms', _long)} AND {number('min-snapshots-to-keep', _int)} ELSE false END)"
    top = " AND ".join(
        [
            "coalesce(json_type(d) = 'OBJECT', false)", f"{_text("d->'table-uuid'")} AND regexp_full_match(lower(d->>'table-uuid'), '(urn:uuid:)?[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|[0-9a-f]{{32}}')".replace("{{", "{").replace("}}", "}"),
            _text("d->'location'"), *(_long(f"d->'{k}'") for k in ("last-sequence-number", "last-updated-ms", "default-sort-order-id")),
            *(_int(f"d->'{k}'") for k in ("last-column-id", "current-schema-id", "default-spec-id", "last-partition-id")),
            _list("d->'schemas'", "x", schema), _list("d->'partition-specs'", "x", f"({_int("x->'spec-id'")} AND {_list("x->'fields'", 'y', spec_field)})"),
            _list("d->'sort-orders'", "x", f"({_int("x->'order-id'")} AND {_list("x->'fields'", 'y', sort_field)})"),
            _optional("d->'properties'", _map("d->'properties'", "k", _text(_member("(d->'properties')", "k")))), _optional("d->'current-snapshot-id'", _long("d->'current-snapshot-id'")),
            _optional("d->'snapshots'", _list("d->'snapshots'", "x", snapshot)), _optional("d->'snapshot-log'", _list("d->'snapshot-log'", "x", f"({_long("x->'snapshot-id'")} AND {_long("x->'timestamp-ms'")})")),
            _optional("d->'metadata-log'", _list("d->'metadata-log'", "x", f"({_text("x->'metadata-file'")} AND {_long("x->'timestamp-ms'")})")), _optional("d->'refs'", _map("d->'refs'", "k", ref)),
        ]
    )
    return f"""
WITH RECURSIVE bodies AS (SELECT meta_id, try_cast(CASE WHEN left(body, 1) = chr(65279) THEN substr(body, 2) ELSE body END AS JSON) AS d FROM metadata_docs),
shaped AS (SELECT meta_id, d FROM bodies WHERE {top}),
schemas AS (SELECT meta_id, u.s AS s, (u.x->>'schema-id')::INTEGER AS sid, u.x AS x FROM (SELECT meta_id, unnest(list_transform({_items("d->'schemas'")}, lambda x, i: {{'s': i, 'x': x}})) AS u FROM shaped)),
inside AS (
    SELECT meta_id, s, sid, u.id AS id, u.t AS t, u.ok AS ok FROM (SELECT meta_id, s, sid, unnest(list_transform(json_extract(x, '$.fields[*]'), lambda x: {field})) AS u FROM schemas)
    UNION ALL
    SELECT meta_id, s, sid, u.id, u.t, u.ok FROM (SELECT meta_id, s, sid, unnest(CASE WHEN (t->'fields') IS NOT NULL THEN list_transform({_items("t->'fields'")}, lambda x: {field})
        WHEN (t->'element-id') IS NOT NULL THEN [{{'id': t->'element-id', 't': t->'element', 'ok': {_int("t->'element-id'")} AND {_bool("t->'element-required'")}}}]
        ELSE [{{'id': t->'key-id', 't': t->'key', 'ok': {_int("t->'key-id'")}}}, {{'id': t->'value-id', 't': t->'value', 'ok': {_int("t->'value-id'")} AND {_bool("t->'value-required'")}}}] END) AS u
        FROM inside WHERE json_type(t) = 'OBJECT')),
bad AS (SELECT meta_id FROM inside WHERE NOT ok OR coalesce(json_type(t), '') NOT IN ('OBJECT', 'VARCHAR') OR (json_type(t) = 'VARCHAR' AND NOT regexp_full_match(t->>'$', '{primitive}')) OR ((t->'fields') IS NOT NULL AND json_type(t->'fields') <> 'ARRAY')),
accepted AS (SELECT meta_id, d FROM shaped WHERE meta_id NOT IN (SELECT meta_id FROM bad))
"""


def parsed(dialect: str) -> str:
    return documents(dialect) + "SELECT b.meta_id, a.meta_id IS NOT NULL AS accepted, CASE WHEN a.meta_id IS NOT NULL THEN regexp_replace(replace(replace(lower(a.d->>'table-uuid'), 'urn:uuid:', ''), '-', ''), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') END AS table_uuid FROM bodies b LEFT JOIN accepted a ON a.meta_id = b.meta_id"


def round_trips(dialect: str) -> str:
    return documents(dialect) + "SELECT meta_id, true AS same FROM accepted"


def violations() -> str:
    """meta_id, code, detail of each violation of the documents, in the published spelling."""
    each = lambda part, x: f"(SELECT meta_id, d, u.i AS i, u.x AS {x} FROM (SELECT meta_id, d, unnest(list_transform({_items(f"d->'{part}'")}, lambda x, i: {{'i': i, 'x': x}})) AS u FROM accepted))"
    n = lambda key, kind="INTEGER": f"(d->>'{key}')::{kind}"
    return (
        documents("spec")
        + f""",
ids AS (SELECT meta_id, s, sid, (id->>'$')::INTEGER AS id FROM inside WHERE meta_id IN (SELECT meta_id FROM accepted)),
snaps AS (SELECT meta_id, d, (x->>'snapshot-id')::BIGINT AS id, (x->>'sequence-number')::BIGINT AS seq, (x->>'schema-id')::BIGINT AS sid FROM {each('snapshots', 'x')}),
specs AS (SELECT meta_id, d, i, (x->>'spec-id')::INTEGER AS id, x FROM {each('partition-specs', 'x')}),
parts AS (SELECT meta_id, d, i, id, u.j AS j, (u.y->>'source-id')::INTEGER AS source, (u.y->>'field-id')::INTEGER AS fid, u.y->>'name' AS name, u.y->>'transform' AS transform FROM (SELECT meta_id, d, i, id, unnest(list_transform(json_extract(x, '$.fields[*]'), lambda y, j: {{'j': j, 'y': y}})) AS u FROM specs)),
orders AS (SELECT meta_id, d, (x->>'order-id')::INTEGER AS id, x FROM {each('sort-orders', 'x')}),
refs_of AS (SELECT meta_id, d, k, {_member("(d->'refs')", "k")} AS r FROM (SELECT meta_id, d, unnest(json_keys(d->'refs')) AS k FROM accepted WHERE json_type(d->'refs') = 'OBJECT')),
now AS (SELECT *, (d->>'current-snapshot-id')::BIGINT AS c FROM accepted),
version AS (SELECT meta_id, CASE WHEN (d->>'format-version') = 'TableMetadataV2' THEN '2' ELSE d->>'format-version' END AS v FROM accepted WHERE coalesce(json_type(d->'format-version'), 'NULL') <> 'NULL')
SELECT meta_id, 'format-version' AS code, v || ' is not 2' AS detail FROM version WHERE coalesce(try_cast(v AS BIGINT), -1) <> 2
UNION ALL SELECT meta_id, 'current-schema-id', 'no schema ' || {n('current-schema-id')} FROM accepted a WHERE NOT EXISTS (SELECT 1 FROM schemas s WHERE s.meta_id = a.meta_id AND s.sid = {n('current-schema-id')})
UNION ALL SELECT meta_id, 'default-spec-id', 'no partition spec ' || {n('default-spec-id')} FROM accepted a WHERE NOT EXISTS (SELECT 1 FROM specs s WHERE s.meta_id = a.meta_id AND s.id = (a.d->>'default-spec-id')::INTEGER)
UNION ALL SELECT meta_id, 'default-sort-order-id', 'no sort order ' || {n('default-sort-order-id', 'BIGINT')} FROM accepted a WHERE {n('default-sort-order-id', 'BIGINT')} <> 0 AND NOT EXISTS (SELECT 1 FROM orders s WHERE s.meta_id = a.meta_id AND s.id = (a.d->>'default-sort-order-id')::BIGINT)
UNION ALL SELECT meta_id, 'current-snapshot-id', 'no snapshot ' || c FROM now a WHERE c <> -1 AND NOT EXISTS (SELECT 1 FROM snaps s WHERE s.meta_id = a.meta_id AND s.id = a.c)
UNION ALL SELECT r.meta_id, 'main', 'main is ' || (r->>'snapshot-id') || ', current is ' || coalesce(c::VARCHAR, 'None') FROM refs_of r JOIN now a ON a.meta_id = r.meta_id WHERE k = 'main' AND (r->>'snapshot-id')::BIGINT IS DISTINCT FROM c
UNION ALL SELECT meta_id, 'ref', k || ': no snapshot ' || (r->>'snapshot-id') FROM refs_of a WHERE NOT EXISTS (SELECT 1 FROM snaps s WHERE s.meta_id = a.meta_id AND s.id = (a.r->>'snapshot-id')::BIGINT)
UNION ALL SELECT meta_id, 'retention', k || ': ' || n || ' is not positive' FROM (SELECT meta_id, k, unnest(CASE r->>'type' WHEN 'branch' THEN [r->>'min-snapshots-to-keep', r->>'max-snapshot-age-ms', r->>'max-ref-age-ms'] ELSE [r->>'max-ref-age-ms'] END)::BIGINT AS n FROM refs_of) WHERE n <= 0
UNION ALL SELECT meta_id, 'field-id', 'schema ' || sid || ': ' || id || ' is used ' || count(*) || ' times' FROM ids GROUP BY meta_id, s, sid, id HAVING count(*) > 1
UNION ALL SELECT meta_id, 'identifier-field-id', 'schema ' || sid || ': no field ' || i FROM (SELECT meta_id, s, sid, unnest((x->'identifier-field-ids')::INTEGER[]) AS i FROM schemas WHERE meta_id IN (SELECT meta_id FROM accepted)) a WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.meta_id = a.meta_id AND ids.s = a.s AND ids.id = a.i)
UNION ALL SELECT meta_id, 'last-column-id', {n('last-column-id')} || ' is below field ' || m FROM (SELECT a.meta_id, any_value(d) AS d, coalesce(max(id), 0) AS m FROM accepted a LEFT JOIN ids ON ids.meta_id = a.meta_id GROUP BY a.meta_id) WHERE {n('last-column-id')} < m
UNION ALL SELECT meta_id, 'last-partition-id', {n('last-partition-id')} || ' is below partition field ' || m FROM (SELECT a.meta_id, any_value(a.d) AS d, coalesce(max(fid), 0) AS m FROM accepted a LEFT JOIN parts p ON p.meta_id = a.meta_id GROUP BY a.meta_id) WHERE {n('last-partition-id')} < m
UNION ALL SELECT meta_id, 'partition-source-id', 'spec ' || id || ': ' || name || ' has no source field ' || source FROM parts p WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.meta_id = p.meta_id AND ids.id = p.source)
UNION ALL SELECT meta_id, 'partition-field-id', 'spec ' || id || ': ' || fid || ' stands for two fields' FROM (SELECT *, first_value((source, transform)) OVER (PARTITION BY meta_id, fid ORDER BY i, j) AS meaning FROM parts) WHERE (source, transform) <> meaning
UNION ALL SELECT meta_id, 'sort-source-id', 'order ' || id || ': no source field ' || source FROM (SELECT meta_id, id, (unnest(json_extract(x, '$.fields[*]'))->>'source-id')::INTEGER AS source FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.meta_id = o.meta_id AND ids.id = o.source)
UNION ALL SELECT meta_id, 'snapshot-id', id || ' is used ' || count(*) || ' times' FROM snaps GROUP BY meta_id, id HAVING count(*) > 1
UNION ALL SELECT meta_id, 'last-sequence-number', {n('last-sequence-number', 'BIGINT')} || ' is below ' || m FROM (SELECT a.meta_id, any_value(a.d) AS d, coalesce(max(seq), 0) AS m FROM accepted a LEFT JOIN snaps s ON s.meta_id = a.meta_id GROUP BY a.meta_id) WHERE {n('last-sequence-number', 'BIGINT')} < m
UNION ALL SELECT meta_id, 'snapshot-schema-id', 'snapshot ' || id || ': no schema ' || sid FROM snaps a WHERE sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM schemas s WHERE s.meta_id = a.meta_id AND s.sid = a.sid)
"""
    )
