"""DuckDB SQL for the registered queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

_ENV = """
env AS (
  SELECT event_id AS seq, epoch_us(ts) AS t_us, 'tenant-' || CAST(user_id % 2 + 1 AS VARCHAR) AS tenant_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'OBJECT_CREATED' WHEN event_type IN ('purchase', 'signup') THEN 'OBJECT_DELETED' ELSE 'OBJECT_ACCESSED' END AS op,
    CASE WHEN event_id % 41 = 0 THEN 'warehouse/other/' ELSE 'warehouse/sales/' END
      || CASE WHEN event_id % 37 = 0 THEN '' ELSE 'dt=' || strftime(ts, '%Y-%m-%d') || '/region=R' || lpad(CAST(user_id % 5 AS VARCHAR), 3, '0') || '/' END
      || 'part-' || lpad(CAST(event_id % 2 AS VARCHAR), 4, '0')
      || CASE WHEN event_id % 31 = 0 THEN '_SUCCESS' WHEN event_id % 29 = 0 THEN '.parquet.crc' WHEN event_id % 23 = 0 THEN '.tmp' WHEN event_id % 19 = 0 THEN '.txt' WHEN event_id % 5 = 0 THEN '.orc' ELSE '.parquet' END AS object_key
  FROM events
), judged AS (
  SELECT *, string_split(object_key, '/') AS parts,
    CASE WHEN op NOT IN ('OBJECT_CREATED', 'OBJECT_DELETED') THEN 'invalid_op'
      WHEN ends_with(object_key, '_SUCCESS') OR ends_with(object_key, '.crc') OR ends_with(object_key, '.tmp')
        OR NOT (ends_with(object_key, '.parquet') OR ends_with(object_key, '.orc') OR ends_with(object_key, '.avro') OR ends_with(object_key, '.csv')) THEN 'non_data_file'
      WHEN NOT starts_with(object_key, 'warehouse/sales/') THEN 'out_of_root'
      WHEN len(list_filter(string_split(substr(object_key, 17), '/')[:-2], lambda s: contains(s, '='))) = 0 THEN 'no_partition'
      ELSE 'kept' END AS verdict
  FROM env
), intents AS (
  SELECT seq, t_us, tenant_id, 'warehouse.sales' AS table_fqn, partition_key, 'warehouse/sales/' || partition_key || '/' AS partition_prefix,
    CASE WHEN op = 'OBJECT_CREATED' THEN 'ADD_CANDIDATE' ELSE 'DROP_CANDIDATE' END AS kind, CASE WHEN op = 'OBJECT_CREATED' THEN object_key END AS proof, object_key
  FROM (SELECT *, array_to_string(list_filter(string_split(substr(object_key, 17), '/')[:-2], lambda s: contains(s, '=')), '/') AS partition_key FROM judged WHERE verdict = 'kept')
), objects AS (
  SELECT tenant_id, object_key, partition_key, arg_max(kind, seq) = 'ADD_CANDIDATE' AS live FROM intents GROUP BY ALL
)"""


def _with(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{_ENV.strip()}{', ' + extra.strip() if extra else ''}\n{body.strip()}"


def _limbs(text: str, n: int) -> str:
    """md5 of a text modulo n, by 32-bit limbs."""
    out = "0"
    for i in range(4):
        out = f"(({out} * {(1 << 32) % n} + CAST('0x' || substr(md5({text}), {1 + 8 * i}, 8) AS BIGINT)) % {n})"
    return out


def _unit(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


EVENT_VERDICTS = _with("SELECT verdict, count(*) AS n FROM judged GROUP BY verdict")
FILTER_ACCOUNTING = _with("SELECT count(*) AS received, count(*) FILTER (verdict <> 'kept') AS filtered, count(*) FILTER (verdict = 'kept') AS buffered FROM judged")
CANDIDATE_INTENTS = _with("SELECT seq, t_us, tenant_id, table_fqn, partition_key, partition_prefix, kind, proof FROM intents")
ROUTED_INTENTS = _with("""
SELECT seq, tenant_id, CASE WHEN starts_with(object_key, 'warehouse/sales/') THEN 'warehouse.sales' ELSE 'warehouse.other' END AS table_fqn, partition_key,
  substr(object_key, 1, 16) || partition_key || '/' AS partition_prefix, CASE WHEN op = 'OBJECT_CREATED' THEN 'ADD_CANDIDATE' ELSE 'DROP_CANDIDATE' END AS kind
FROM (SELECT *, array_to_string(list_filter(string_split(substr(object_key, 17), '/')[:-2], lambda s: contains(s, '=')), '/') AS partition_key
      FROM judged WHERE verdict IN ('kept', 'out_of_root') ) WHERE partition_key <> ''""")
OBJECT_PATHS = _with("""
SELECT DISTINCT object_key, regexp_replace(object_key, '[^/]*$', '') AS directory,
  CASE WHEN starts_with(object_key, 'warehouse/sales/') THEN array_to_string(list_filter(string_split(substr(object_key, 17), '/')[:-2], lambda s: contains(s, '=')), '/') ELSE '' END AS partition_key,
  parts[-1] AS file_name, CASE WHEN length(object_key) > 24 THEN substr(object_key, 1, 22) || '..' ELSE object_key END AS short
FROM judged""")


def _log(partitions: int) -> str:
    return f"""log AS (
  SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY seq) AS "offset"
  FROM (SELECT seq, regexp_replace(object_key, '[^/]*$', '') AS key, object_key AS value, CAST({_limbs("regexp_replace(object_key, '[^/]*$', '')", partitions)} AS INTEGER) AS "partition" FROM env))"""


ROUTE_OFFSETS = _with('SELECT "partition", "offset", seq, key FROM log', _log(2))
PARTITION_LAG = _with('SELECT "partition", count(*) AS produced, least(count(*), 1500) AS position, count(*) - least(count(*), 1500) AS lag FROM log GROUP BY "partition"', _log(3))
POLLED_MESSAGES = _with('SELECT "partition", "offset", value FROM log WHERE "offset" BETWEEN 41 AND 65', _log(3))
RECENT_MESSAGES = _with('SELECT "partition", "offset", value FROM log ORDER BY "partition" DESC, "offset" DESC LIMIT 20', _log(2))
EVENT_FEED = _with("""
SELECT seq, partition_key, kind, (SELECT count(*) FROM intents b WHERE b.partition_key = a.partition_key AND b.seq < a.seq) AS prev_count
FROM (SELECT * FROM intents ORDER BY seq DESC LIMIT 20) a""")

LIVE_INVENTORY = _with("SELECT tenant_id, object_key FROM objects WHERE live")
CONVERGED_CATALOG = _with("SELECT tenant_id, 'warehouse.sales' AS table_fqn, partition_key, count(*) AS n_objects FROM objects WHERE live GROUP BY ALL")
LIST_NONEMPTY = _with("""
SELECT p.tenant_id, p.partition_prefix, EXISTS (SELECT 1 FROM objects o WHERE o.live AND o.tenant_id = p.tenant_id AND starts_with(o.object_key, p.partition_prefix)) AS non_empty
FROM (SELECT DISTINCT tenant_id, partition_prefix FROM intents UNION SELECT DISTINCT tenant_id, regexp_replace(partition_prefix, '[^/]+/$', '') FROM intents) p""")
SCAN_REQUESTS = _with("""
SELECT tenant_id, 1 + count(DISTINCT string_split(partition_key, '/')[1]) + count(DISTINCT partition_key) AS requests FROM objects WHERE live GROUP BY tenant_id""")
PURGED_INVENTORY = _with("SELECT tenant_id, count(*) AS n FROM objects WHERE live AND NOT starts_with(object_key, 'warehouse/sales/dt=2024-01-0') GROUP BY tenant_id")

_CATALOG = f"""known AS (
  SELECT DISTINCT tenant_id, partition_key, partition_prefix AS location FROM intents WHERE {_limbs("partition_key", 3)} = 0
  UNION ALL SELECT 'tenant-1', 'dt=1999-01-01/region=R000', 'warehouse/sales/dt=1999-01-01/region=R000/'
), listed AS (SELECT tenant_id, partition_key, count(*) AS n_objects FROM objects WHERE live GROUP BY ALL)"""
SCAN_REPAIR_DIFF = _with("""
SELECT tenant_id, 'warehouse.sales' AS table_fqn, partition_key,
  CASE WHEN known.location IS NULL THEN 'ADD' WHEN n_objects IS NULL THEN 'DROP' ELSE 'KEEP' END AS action, coalesce(n_objects, 0) AS n_objects
FROM known FULL JOIN listed USING (tenant_id, partition_key)""", _CATALOG)

_UNEQUAL = _CATALOG + """, unequal AS (
  SELECT tenant_id, partition_key, CASE WHEN known.location IS NULL THEN 'ADD' ELSE 'DROP' END AS action
  FROM known FULL JOIN listed USING (tenant_id, partition_key) WHERE known.location IS NULL OR n_objects IS NULL)"""
TREE_REPAIR_DIFF = _with("SELECT tenant_id, 'warehouse.sales' AS table_fqn, partition_key, action FROM unequal", _UNEQUAL)
TREE_REQUESTS = _with("""
SELECT tenant_id, requests AS scan, coalesce(descent, 0) AS descent, coalesce(differences, 0) AS differences
FROM (SELECT tenant_id, 1 + count(DISTINCT string_split(partition_key, '/')[1]) + count(DISTINCT partition_key) AS requests FROM objects WHERE live GROUP BY tenant_id)
LEFT JOIN (SELECT tenant_id, 1 + count(DISTINCT string_split(partition_key, '/')[1]) AS descent, count(*) AS differences FROM unequal GROUP BY tenant_id) USING (tenant_id)""", _UNEQUAL)

QUIET_SESSIONS = _with("""
SELECT tenant_id, table_fqn, partition_key, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n, count(*) FILTER (kind = 'ADD_CANDIDATE') AS n_add, count(*) FILTER (kind = 'DROP_CANDIDATE') AS n_drop
FROM (SELECT *, sum(opens) OVER (PARTITION BY tenant_id, partition_key ORDER BY t_us, seq) AS sid
      FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY tenant_id, partition_key ORDER BY t_us, seq) <= 910000000 THEN 0 ELSE 1 END AS opens FROM intents))
GROUP BY tenant_id, table_fqn, partition_key, sid""")


def _sessions(window: int, grace: int, cap: int) -> str:
    """Rows of each key numbered in order, walked one step at a time for all keys at once."""
    w, g, c = (x * 1_000_000 for x in (window, grace, cap))
    return f"""placed AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, partition_key ORDER BY t_us, seq) AS rn FROM intents
), walk AS (
  SELECT tenant_id, partition_key, rn, t_us AS last_us, t_us AS first_us, CAST(1 AS BIGINT) AS sid FROM placed WHERE rn = 1
  UNION ALL
  SELECT p.tenant_id, p.partition_key, p.rn, p.t_us, CASE WHEN p.t_us <= least(k.last_us + {w}, k.first_us + {c}) + {g} THEN k.first_us ELSE p.t_us END,
    k.sid + CASE WHEN p.t_us <= least(k.last_us + {w}, k.first_us + {c}) + {g} THEN 0 ELSE 1 END
  FROM walk k JOIN placed p ON p.tenant_id = k.tenant_id AND p.partition_key = k.partition_key AND p.rn = k.rn + 1
), assigned AS (SELECT p.*, k.sid FROM placed p JOIN walk k USING (tenant_id, partition_key, rn)
), sess AS (
  SELECT tenant_id, table_fqn, partition_key, sid, CASE WHEN bool_or(kind = 'ADD_CANDIDATE') THEN 'ADD' ELSE 'DROP' END AS kind, count(*) AS n, arg_max(kind, rn) AS last_kind,
    min(t_us) AS first_us, max(t_us) AS last_us, least(max(t_us) + {w}, min(t_us) + {c}) AS flush_us, arg_min(partition_prefix, rn) AS partition_prefix,
    list(proof ORDER BY rn) FILTER (proof IS NOT NULL) AS proofs
  FROM assigned GROUP BY ALL)"""


def capped_sessions(window: int, grace: int, cap: int) -> str:
    return _with("SELECT tenant_id, table_fqn, partition_key, sid, kind, n, last_kind, first_us, last_us, flush_us FROM sess", _sessions(window, grace, cap), recursive=True)


EFFECTIVE_INTENTS = _with("""
SELECT tenant_id, table_fqn, partition_key, sid, partition_prefix, kind, coalesce(array_to_string(proofs[1:3], ','), '') AS proofs, CAST(coalesce(len(proofs[1:3]), 0) AS BIGINT) AS n_proofs FROM sess""", _sessions(3600, 10, 18000), recursive=True)
BUFFER_SNAPSHOT = _with("""
SELECT tenant_id, table_fqn, partition_key, n AS count, greatest(flush_us - now, 0) / 1e6 AS flush_in, (now - first_us) / 1e6 AS age_s, last_kind AS kind
FROM sess, (SELECT max(t_us) AS now FROM env) WHERE flush_us > now - 10000000""", _sessions(3600, 10, 18000), recursive=True)
FLUSHED_BETWEEN = _with("""
SELECT tenant_id, table_fqn, partition_key, count FROM (
  SELECT tenant_id, table_fqn, partition_key, sid, count(*) AS count, least(max(t_us) + 3600000000, min(t_us) + 18000000000) AS flush_us
  FROM assigned WHERE t_us <= (SELECT max(t_us) - 7200000000 FROM env) GROUP BY ALL
) p WHERE flush_us > (SELECT max(t_us) - 7200000000 - 10000000 FROM env)
  AND NOT EXISTS (SELECT 1 FROM sess s WHERE s.tenant_id = p.tenant_id AND s.partition_key = p.partition_key AND s.flush_us > (SELECT max(t_us) - 10000000 FROM env))""", _sessions(3600, 10, 18000), recursive=True)
COVERAGE = _with("SELECT tenant_id, count(DISTINCT partition_key) AS partitions, count(DISTINCT object_key) AS objects FROM intents GROUP BY tenant_id")

_ALL = """flushed AS (
  SELECT tenant_id, partition_key, arg_min(partition_prefix, seq) AS partition_prefix, bool_or(proof IS NOT NULL) AS adds, count(*) AS n,
    (list(proof ORDER BY t_us, seq) FILTER (proof IS NOT NULL))[1:3] AS proofs
  FROM intents GROUP BY ALL)"""
_HEADS = """tried AS (
  SELECT tenant_id, partition_key, unnest(proofs) AS object_key, unnest(range(1, len(proofs) + 1)) AS pos FROM flushed WHERE adds
), heads AS (
  SELECT tenant_id, partition_key, min(pos) FILTER (live) AS first_hit, coalesce(min(pos) FILTER (live), count(*)) AS heads
  FROM tried LEFT JOIN objects USING (tenant_id, partition_key, object_key) GROUP BY ALL)"""
HEAD_PROOFS = _with("SELECT tenant_id, 'warehouse.sales' AS table_fqn, partition_key, coalesce(first_hit, 0) AS first_hit, heads FROM heads", f"{_ALL}, {_HEADS}")


def _decided(enable_drop: bool = True, faults: bool = False) -> str:
    """Outcomes as 'status|reason|heads|lists', in the order of the decision table."""
    pick = lambda names, salt: f"(['{"', '".join(names)}'])[{_limbs(f"'{salt}' || partition_key", len(names))} + 1]"
    have = "TRUE" if faults else "FALSE"
    return f"""{_ALL}, {_HEADS}, {_CATALOG}, rows AS (
  SELECT tenant_id, partition_key, partition_prefix, n, first_hit, location IS NOT NULL AS there, n_objects IS NOT NULL AS stored,
    CASE WHEN adds AND {_limbs("tenant_id || partition_key", 4)} <> 1 THEN 'ADD' ELSE 'DROP' END AS kind, coalesce(heads, 0) AS tries,
    CASE WHEN {have} AND {_limbs("'any' || partition_key", 2)} = 0 THEN {pick(["head", "list", "create", "drop"], "call")} END AS call,
    CASE WHEN {have} AND {_limbs("'any' || partition_key", 2)} = 0 THEN {pick(["transient", "fatal"], "error")} END AS error
  FROM flushed LEFT JOIN heads USING (tenant_id, partition_key) LEFT JOIN known USING (tenant_id, partition_key) LEFT JOIN listed USING (tenant_id, partition_key)
), coded AS (
  SELECT *, CASE
    WHEN kind = 'ADD' AND there THEN CASE
      WHEN NOT {enable_drop} THEN 'NOOP|already_exists|0|0' WHEN call = 'list' THEN 'RETRY|storage_transient|0|1' WHEN stored THEN 'NOOP|already_exists_verified|0|1'
      WHEN call = 'drop' AND error = 'transient' THEN 'RETRY|catalog_transient|0|1' WHEN call = 'drop' THEN 'ERROR|catalog_fatal|0|1' ELSE 'RETRY|stale_catalog_entry_cleared|0|1' END
    WHEN kind = 'ADD' THEN CASE
      WHEN call = 'head' AND tries > 0 THEN 'RETRY|storage_transient|1|0'
      WHEN first_hit IS NULL AND call = 'list' THEN 'RETRY|storage_transient|' || tries || '|1'
      WHEN first_hit IS NULL AND NOT stored THEN 'RETRY|not_visible_yet|' || tries || '|1'
      WHEN call = 'create' AND error = 'transient' THEN 'RETRY|catalog_transient|' || tries || '|' || CASE WHEN first_hit IS NULL THEN 1 ELSE 0 END
      WHEN call = 'create' THEN 'ERROR|catalog_fatal|' || tries || '|' || CASE WHEN first_hit IS NULL THEN 1 ELSE 0 END
      ELSE 'APPLIED||' || tries || '|' || CASE WHEN first_hit IS NULL THEN 1 ELSE 0 END END
    WHEN NOT {enable_drop} THEN 'NOOP|drop_disabled|0|0' WHEN NOT there THEN 'NOOP|not_found|0|0' WHEN call = 'list' THEN 'RETRY|storage_transient|0|1' WHEN stored THEN 'NOOP|still_non_empty|0|1'
    WHEN call = 'drop' AND error = 'transient' THEN 'RETRY|catalog_transient|0|1' WHEN call = 'drop' THEN 'ERROR|catalog_fatal|0|1' ELSE 'APPLIED||0|1' END AS code
  FROM rows
), results AS (
  SELECT tenant_id, 'warehouse.sales' AS table_fqn, partition_key, partition_prefix, kind, n, string_split(code, '|')[1] AS status, string_split(code, '|')[2] AS reason,
    CAST(string_split(code, '|')[3] AS BIGINT) AS heads, CAST(string_split(code, '|')[4] AS BIGINT) AS lists, there AS in_catalog,
    CASE WHEN kind = 'ADD' AND starts_with(code, 'APPLIED') THEN TRUE WHEN code LIKE '%stale_catalog%' OR kind = 'DROP' AND starts_with(code, 'APPLIED') THEN FALSE ELSE there END AS in_catalog_after
  FROM coded)"""


LISTED_FOLDERS = _with("""
SELECT (SELECT count(*) FROM objects WHERE live) AS objects, CAST(sum(coalesce(below, 0) + 1) AS BIGINT) AS folders, (SELECT CAST(coalesce(sum(lists), 0) AS BIGINT) FROM results) AS lists
FROM (SELECT DISTINCT tenant_id FROM intents) LEFT JOIN (
  SELECT tenant_id, count(DISTINCT string_split(partition_key, '/')[1]) + count(DISTINCT partition_key) AS below FROM objects WHERE live GROUP BY tenant_id) USING (tenant_id)""", _decided())


def commit_decisions(enable_drop: bool, faults: bool = False) -> str:
    return _with("SELECT tenant_id, table_fqn, partition_key, kind, status, reason, heads, lists, in_catalog, in_catalog_after FROM results", _decided(enable_drop, faults))


def outcome_counts() -> str:
    return _with("SELECT kind, status, reason, count(*) AS n, CAST(sum(heads) AS BIGINT) AS heads, CAST(sum(lists) AS BIGINT) AS lists FROM results GROUP BY ALL", _decided())


def catalog_after() -> str:
    return _with("""
SELECT k.tenant_id, 'warehouse.sales' AS table_fqn, k.partition_key, k.location FROM known k LEFT JOIN results r USING (tenant_id, partition_key) WHERE coalesce(r.in_catalog_after, TRUE)
UNION ALL SELECT tenant_id, table_fqn, partition_key, partition_prefix FROM results WHERE in_catalog_after AND NOT in_catalog""", _decided())


def _cost(scan: str, requests: str = "requests") -> str:
    return f"round({requests} / greatest(committed, 1), 6) AS alpha_eff, round({scan} / greatest({requests}, 1), 6) AS reduction, round({requests} / 1000 * 0.005, 6) AS daily_cost"


_COST = _cost("456616")


def observed_counts() -> str:
    return f"""SELECT count(*) AS results, count(*) FILTER (status = 'APPLIED') AS applied, count(*) FILTER (status = 'NOOP') AS noop, count(*) FILTER (status = 'RETRY') AS retry,
  count(*) FILTER (status = 'ERROR') AS error, CAST(coalesce(sum(heads), 0) AS BIGINT) AS heads, CAST(coalesce(sum(lists), 0) AS BIGINT) AS lists FROM ({commit_decisions(True, faults=True)})"""


def updated_tree() -> str:
    return f"""WITH after AS ({catalog_after()}), folders AS (
  SELECT tenant_id, 0 AS level, '' AS prefix FROM after UNION ALL SELECT tenant_id, 1, string_split(partition_key, '/')[1] FROM after UNION ALL SELECT tenant_id, 2, partition_key FROM after)
SELECT tenant_id, CAST(level AS INTEGER) AS level, prefix, count(*) AS n FROM folders GROUP BY ALL"""


def request_cost() -> str:
    return _with(f"""
SELECT buffered, committed, buffered - committed AS coalesced, heads, lists, {_COST}
FROM (SELECT CAST(sum(n) AS BIGINT) AS buffered, count(*) FILTER (status = 'APPLIED') AS committed, CAST(sum(heads) AS BIGINT) AS heads, CAST(sum(lists) AS BIGINT) AS lists,
        CAST(sum(heads) + sum(lists) AS BIGINT) AS requests FROM results)""", _decided())


def session_replay(window: int, grace: int, cap: int, counts: bool = False) -> str:
    """Storage at each flush is looked up from scratch: the last operation of every object of the key so far."""
    states = f"""{_sessions(window, grace, cap)}, states AS (
  SELECT tenant_id, partition_key, sid, bool_or(live) AS stored FROM (
    SELECT s.tenant_id, s.partition_key, s.sid, e.object_key, arg_max(e.kind, e.rn) = 'ADD_CANDIDATE' AS live
    FROM sess s JOIN assigned e ON e.tenant_id = s.tenant_id AND e.partition_key = s.partition_key AND e.sid <= s.sid GROUP BY ALL)
  GROUP BY ALL
), told AS (
  SELECT s.tenant_id, s.table_fqn, s.partition_key, s.sid, s.kind, stored, lag(stored, 1, FALSE) OVER (PARTITION BY tenant_id, partition_key ORDER BY sid) AS there FROM sess s JOIN states USING (tenant_id, partition_key, sid)
), done AS (
  SELECT *, CASE WHEN kind = 'ADD' THEN CASE WHEN there AND stored THEN 'NOOP' WHEN there OR NOT stored THEN 'RETRY' ELSE 'APPLIED' END WHEN NOT there OR stored THEN 'NOOP' ELSE 'APPLIED' END AS status,
    CASE WHEN kind = 'ADD' THEN CASE WHEN there AND stored THEN 'already_exists_verified' WHEN there THEN 'stale_catalog_entry_cleared' WHEN stored THEN '' ELSE 'not_visible_yet' END
      WHEN NOT there THEN 'not_found' WHEN stored THEN 'still_non_empty' ELSE '' END AS reason
  FROM told)"""
    body = "SELECT kind, status, reason, count(*) AS n FROM done GROUP BY ALL" if counts else "SELECT tenant_id, table_fqn, partition_key, sid, kind, status, reason FROM done"
    return _with(body, states, recursive=True)


_REPLAYED = session_replay(3600, 10, 18000).rpartition("\nSELECT tenant_id")[0].removeprefix("WITH RECURSIVE ")
LATENCY_PERCENTILES = f"""WITH RECURSIVE {_REPLAYED}, lat AS (
  SELECT (flush_us + 10000000 - seen_us) / 1e6 AS latency_s, (flush_us + 10000000 - first_us) / 1e6 AS session_s
  FROM done JOIN sess USING (tenant_id, table_fqn, partition_key, sid, kind) JOIN (SELECT partition_key, min(t_us) AS seen_us FROM intents GROUP BY ALL) USING (partition_key) WHERE status = 'APPLIED')
SELECT 'latency_s' AS measure, count(*) AS n, round(median(latency_s), 3) AS median, round(list_sort(list(latency_s))[CAST(floor(0.95 * count(*)) AS INT) + 1], 3) AS p95, round(list_sort(list(latency_s))[CAST(floor(0.99 * count(*)) AS INT) + 1], 3) AS p99 FROM lat
UNION ALL SELECT 'session_s', count(*), round(median(session_s), 3), round(list_sort(list(session_s))[CAST(floor(0.95 * count(*)) AS INT) + 1], 3), round(list_sort(list(session_s))[CAST(floor(0.99 * count(*)) AS INT) + 1], 3) FROM lat"""

_TRIES = f"""keys AS (SELECT DISTINCT tenant_id, table_fqn, partition_key, {_limbs("partition_key", 8)} + 1 AS visible_at FROM intents
), waits AS (
  SELECT *, {_unit("partition_key || '#' || CAST(attempt AS VARCHAR)")} * least(pow(2, attempt), 60) AS wait_s FROM (SELECT *, unnest(range(1, 6)) AS attempt FROM keys)
), tries AS (SELECT *, sum(wait_s) OVER (PARTITION BY tenant_id, partition_key ORDER BY attempt) AS at_s FROM waits)"""
RETRY_SCHEDULE = _with("""
SELECT tenant_id, table_fqn, partition_key, CAST(attempt AS INTEGER) AS attempt, round(wait_s, 4) AS wait_s, round(at_s, 4) AS at_s,
  CASE WHEN attempt = visible_at THEN 'APPLIED' WHEN attempt = 5 THEN 'DLQ' ELSE 'RETRY' END AS status
FROM tries WHERE attempt <= visible_at""", _TRIES)
DEAD_LETTERS = _with("SELECT tenant_id, table_fqn, partition_key, 'ADD' AS kind, 'not_visible_yet' AS reason, CAST(5 AS INTEGER) AS attempts FROM keys WHERE visible_at > 5", _TRIES)

_SPACE = """space AS (
  SELECT i, format('dt=2024-{:02d}-{:02d}/region=R{:03d}/hour={:02d}', (i // 1200) // 30 + 1, (i // 1200) % 30 + 1, (i % 1200) // 24, i % 24) AS partition_key
  FROM (SELECT DISTINCT ((dayofyear(ts) - 1) * 50 + user_id % 50) * 24 + hour(ts) AS i FROM events)
), scan AS (SELECT 1 + count(DISTINCT i // 1200) + count(DISTINCT i // 24) + count(*) AS requests, count(*) AS total FROM space)"""


def _drawn(seed: int, *parts: str) -> str:
    return _unit(f"concat_ws('-', '{seed}', {', '.join(parts)})")


def _changed(fraction: float) -> str:
    return f"(SELECT least(greatest(1, CAST(round_even({fraction} * total, 0) AS BIGINT)), total) FROM scan)"


def _generated(fraction: float, name: str = "gen", seed: int = 42, files: int = 5, duplicates: float = 0.1) -> str:
    return f"""{name}_parts AS (SELECT i, partition_key FROM (SELECT *, row_number() OVER (ORDER BY {_drawn(seed, "CAST(i AS VARCHAR)")}, i) AS r FROM space) WHERE r <= {_changed(fraction)}
), {name} AS (
  SELECT partition_key, 'warehouse/sales/' || partition_key || '/part-' || lpad(CAST(file AS VARCHAR), 4, '0') || '.parquet' AS object_key,
    1704067200000000 + CAST(trunc(({_drawn(seed, "CAST(i AS VARCHAR)", "CAST(file AS VARCHAR)", "'t'")} * 20 - 10) * 1000000) AS BIGINT) + copy * 1000 AS t_us
  FROM (SELECT *, unnest(CASE WHEN {_drawn(seed, "CAST(i AS VARCHAR)", "CAST(file AS VARCHAR)", "'d'")} < {duplicates} THEN [0, 1] ELSE [0] END) AS copy FROM (SELECT *, unnest(range({files})) AS file FROM {name}_parts)))"""


GENERATED_EVENTS = f"""WITH {_SPACE}, {_generated(0.1)}
SELECT count(*) AS events, count(DISTINCT object_key) AS objects, CAST(sum(t_us - 1704067200000000) AS BIGINT) AS sum_t_us, CAST(sum({_limbs("object_key", 1_000_003)}) AS BIGINT) AS checksum FROM gen"""
PARTITION_SPACE = f"WITH {_SPACE} SELECT count(DISTINCT partition_key) AS partitions, min(partition_key) AS first, max(partition_key) AS last, (SELECT requests FROM scan) AS scan_requests FROM space"


def coalescing(fractions: list[float]) -> str:
    """Every proof is there, so each partition takes one HEAD and is committed."""
    runs = " UNION ALL ".join(
        f"SELECT CAST({f} AS DOUBLE) AS f, {_changed(f)} AS delta_p, (SELECT count(*) FROM g{i}) AS raw_events, (SELECT count(DISTINCT partition_key) FROM g{i}) AS committed" for i, f in enumerate(fractions)
    )
    return f"""WITH {_SPACE}, {", ".join(_generated(f, f"g{i}") for i, f in enumerate(fractions))}, runs AS (SELECT *, committed AS requests FROM ({runs}))
SELECT f, delta_p, raw_events, raw_events - committed AS coalesced, committed, runs.requests, {_cost("scan.requests", "runs.requests")} FROM runs, scan"""


def coalescing_jitter(fractions: list[float], rate: float) -> str:
    """Up to three proofs in order of arrival are asked for; where none shows, one LIST sees all objects that show."""
    seen = _unit("object_key || '#1'") + f" >= {rate}"
    runs = " UNION ALL ".join(
        f"SELECT CAST({f} AS DOUBLE) AS f, {_changed(f)} AS delta_p, partition_key, object_key, t_us FROM g{i}" for i, f in enumerate(fractions)
    )
    return f"""WITH {_SPACE}, {", ".join(_generated(f, f"g{i}") for i, f in enumerate(fractions))}, ev AS (
  SELECT *, {seen} AS seen, row_number() OVER (PARTITION BY f, partition_key ORDER BY t_us, object_key) AS place FROM ({runs})
), tried AS (
  SELECT f, delta_p, partition_key, count(*) AS n, bool_or(seen) AS shows, min(place) FILTER (seen AND place <= 3) AS hit FROM ev GROUP BY ALL
)
SELECT f, delta_p, CAST(sum(n) AS BIGINT) AS raw_events, count(*) FILTER (shows) AS committed, CAST(sum(coalesce(hit, 4)) AS BIGINT) AS requests,
  round(sum(coalesce(hit, 4)) / greatest(count(*) FILTER (shows), 1), 6) AS alpha_eff
FROM tried GROUP BY f, delta_p"""


CONVERGENCE = f"""WITH {_SPACE}, {_generated(0.01)}, sess AS (
  SELECT w, partition_key, min(t) AS first_us, least(max(t) + w * 1000000, min(t) + 5 * w * 1000000) AS flush_us
  FROM (SELECT partition_key, 1704067200000000 AS t FROM gen), (SELECT unnest([1, 5, 10, 30, 60, 120]) AS w) GROUP BY w, partition_key
), lat AS (SELECT w, (flush_us + 1000000 + 1000 - first_us) / 1e6 AS s FROM sess)
SELECT CAST(w AS DOUBLE) AS window_s, count(*) AS commits, round(median(s), 3) AS median, round(quantile_disc(s, 0.95), 3) AS p95, round(quantile_disc(s, 0.99), 3) AS p99 FROM lat GROUP BY w"""


def drop_sweep(fractions: list[float], changed: float = 0.1) -> str:
    """All objects of a share of the added partitions are deleted; a partition without live objects takes one LIST and is dropped."""
    events = f"unnest(CASE WHEN {_drawn(99, 'CAST(i AS VARCHAR)', 'CAST(file AS VARCHAR)', chr(39) + 'd' + chr(39))} < 0.1 THEN [0, 1] ELSE [0] END)"
    return f"""WITH {_SPACE}, {_generated(changed)}, ranked AS (SELECT i, partition_key, row_number() OVER (ORDER BY {_drawn(99, "CAST(i AS VARCHAR)")}, i) AS r FROM gen_parts
), gone AS (SELECT r, partition_key, 'warehouse/sales/' || partition_key || '/part-' || lpad(CAST(file AS VARCHAR), 4, '0') || '.parquet' AS object_key, {events} AS copy FROM (SELECT *, unnest(range(5)) AS file FROM ranked)
), shares AS (SELECT f, least(greatest(1, CAST(round_even(f * (SELECT count(*) FROM gen_parts), 0) AS BIGINT)), (SELECT count(*) FROM gen_parts)) AS n FROM (VALUES {", ".join(f"(CAST({f} AS DOUBLE))" for f in fractions)}) AS t(f)
), left_over AS (SELECT f, partition_key, count(*) FILTER (object_key NOT IN (SELECT object_key FROM gone WHERE r <= n)) AS live FROM shares, (SELECT DISTINCT partition_key, object_key FROM gen) GROUP BY f, partition_key
), asked AS (SELECT f, partition_key, count(*) AS n FROM shares JOIN gone ON r <= n GROUP BY f, partition_key
), runs AS (SELECT f, CAST(sum(n) AS BIGINT) AS drop_events, count(*) FILTER (live = 0) AS dropped, count(*) AS lists FROM asked JOIN left_over USING (f, partition_key) GROUP BY f)
SELECT f, drop_events, dropped, lists, lists / greatest(dropped, 1) AS alpha_drop, round(lists / 1000 * 0.005, 6) AS daily_cost FROM runs"""


SOUGHT_POSITIONS = _with("""
SELECT "partition", count(*) AS produced, count(*) FILTER (seq % 5 <> 4) + least(count(*) FILTER (seq % 5 = 4), 100) AS position, count(*) FILTER (seq % 5 = 4) - least(count(*) FILTER (seq % 5 = 4), 100) AS lag
FROM log GROUP BY "partition\"""", _log(3))
FLUSH_SEQUENCE = _with("SELECT tenant_id, table_fqn, partition_key, sid, kind, flush_us FROM sess ORDER BY flush_us, tenant_id, table_fqn, partition_key, sid LIMIT 100", _sessions(3600, 10, 18000), recursive=True)
LAST_FLUSHES = _with("""
SELECT tenant_id, table_fqn, partition_key, sid, kind, n, flush_us FROM sess WHERE flush_us <= (SELECT max(t_us) FROM env)
QUALIFY row_number() OVER (PARTITION BY tenant_id, table_fqn, partition_key ORDER BY flush_us DESC, sid DESC) = 1""", _sessions(3600, 10, 18000), recursive=True)
WORKER_CATALOG = _with("SELECT DISTINCT tenant_id, 'warehouse.sales' AS table_fqn, partition_key FROM objects WHERE live")
UNKNOWN_KINDS = _with("""
SELECT DISTINCT i.tenant_id, i.table_fqn, i.partition_key, 'MERGE' AS kind, 'ERROR' AS status, 'unknown_kind' AS reason, CAST(0 AS BIGINT) AS heads, CAST(0 AS BIGINT) AS lists,
  k.location IS NOT NULL AS in_catalog, k.location IS NOT NULL AS in_catalog_after
FROM intents i LEFT JOIN known k ON k.tenant_id = i.tenant_id AND k.partition_key = i.partition_key""", _CATALOG)
#: Attempts at which an object shows: each misses with a chance of 0.7, and three retries follow on the first one.
JITTERED_RETRIES = _with(f"""
SELECT tenant_id, 'warehouse.sales' AS table_fqn, partition_key, CASE WHEN least(coalesce(first, 9), 9) <= 4 THEN 'APPLIED' ELSE 'DLQ' END AS status,
  CASE WHEN coalesce(first, 9) <= 4 THEN '' ELSE 'not_visible_yet' END AS reason, CAST(least(coalesce(first, 9), 4) AS INTEGER) AS attempts
FROM (SELECT DISTINCT tenant_id, partition_key FROM intents WHERE kind = 'ADD_CANDIDATE') LEFT JOIN (
  SELECT tenant_id, partition_key, min(a) AS first FROM (SELECT *, unnest(range(1, 5)) AS a FROM objects WHERE live)
  WHERE {_unit("object_key || '#' || CAST(a AS VARCHAR)")} >= 0.7 GROUP BY ALL) USING (tenant_id, partition_key)""")
LATER_EPOCH = f"WITH {_SPACE}, {_generated(0.001, files=3, duplicates=0.2)} SELECT t_us, 'OBJECT_CREATED' AS op, object_key FROM gen ORDER BY t_us, object_key LIMIT 50"
SCRIPTED_EPOCHS = _with("""
SELECT DISTINCT epoch, tenant_id, partition_key FROM (
  SELECT e.epoch, j.tenant_id, j.partition_key, j.object_key, arg_max(j.kind = 'ADD_CANDIDATE', (j.t_us, j.seq)) AS live
  FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS epoch) e JOIN (SELECT *, seq * 4 // ((SELECT max(seq) FROM env) + 1) AS q FROM intents) j ON q <= e.epoch GROUP BY ALL)
WHERE live""")
