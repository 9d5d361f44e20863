"""ANSI SQL (DuckDB dialect) twins of the registered queries.

Each string re-derives the fixture tables from the raw test tables with the
same rules as ``sources/fixtures.py`` and then states the operator in SQL;
the driver runs it next to the Spark query and compares the results.
"""

from __future__ import annotations

from ..functions.principals import CONDITION_REPO_PATTERN, MEMBER_REPO_PATTERN, VALID_MEMBER_PATTERN
from ..functions.text import TOPICS, WORD_PATTERN_EXPLICIT
from ..operators.audit import ACCESS_TOKEN, ID_TOKEN
from ..operators.grants import EDITOR_ROLE, LOG_ROLES, ROLE_OF_LIST, VIEWER_ROLE
from ..operators.policies import WORKLOAD_IDENTITY_ROLE
from ..sources.fixtures import ACCESS, RUN_OFFSETS_DAYS
from ..sources.tables import SAMPLE_CONTENT, SAMPLE_ID_PREFIX
from . import queries as Q


def _s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_s(x) if isinstance(x, str) else str(x) for x in items) + "]"


def _draw(slot: int) -> str:
    return f"CAST(('0x' || substr(h, {1 + 8 * slot}, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"


def _features(src: str, keep: str = "") -> str:
    keep = f", {keep}" if keep else ""
    return f"""
    SELECT id, created_at, content, word_count, char_count,
           char_count::DOUBLE / NULLIF(word_count, 0)::DOUBLE AS avg_word_length,
           -1.0::DOUBLE + 2.0::DOUBLE * u0 AS sentiment_score,
           0.5::DOUBLE + 0.5::DOUBLE * u1 AS topic_confidence,
           {_list(TOPICS)}[CAST(floor(u2 * 4) AS INTEGER) + 1] AS predicted_topic,
           (SELECT as_of FROM clk) AS processing_timestamp{keep}
    FROM (SELECT *, {_draw(0)} AS u0, {_draw(1)} AS u1, {_draw(2)} AS u2
          FROM (SELECT *, CAST(len(regexp_extract_all(content, {_s(WORD_PATTERN_EXPLICIT)})) AS BIGINT) AS word_count,
                       CAST(length(content) AS BIGINT) AS char_count,
                       md5(id || '|ml') AS h
                FROM {src}))"""


_USER = "CASE WHEN starts_with(email, 'serviceAccount:') THEN email ELSE 'user:' || email END"

CTES: dict[str, tuple[list[str], str]] = {
    "tk": ([], """SELECT d.doc_id, 't' || CAST(d.doc_id AS VARCHAR) AS id, e.ts AS created_at,
                         d.text AS content
                  FROM documents d JOIN events e ON e.event_id = d.doc_id * 5"""),
    "t": (["tk"], "SELECT id, created_at, content FROM tk"),
    "clk": (["tk"], "SELECT max(created_at) AS as_of FROM tk"),
    "win30": (["t", "clk"], f"""SELECT * FROM t
               WHERE created_at >= (SELECT as_of FROM clk) - INTERVAL {Q.RECENT_DAYS} DAY"""),
    "win7": (["t", "clk"], f"""SELECT * FROM t
               WHERE created_at >= (SELECT as_of FROM clk) - INTERVAL {Q.MONITOR_DAYS} DAY"""),
    "feat30": (["win30", "clk"], _features("win30")),
    "featk": (["tk", "clk"], _features("tk", "doc_id")),
    "runs": (["featk", "clk"], f"""
        SELECT id, created_at, content, word_count, char_count, avg_word_length, sentiment_score,
               topic_confidence, predicted_topic,
               (SELECT as_of FROM clk) - to_days(CAST({_list(RUN_OFFSETS_DAYS)}[r + 1] AS INTEGER))
                 AS processing_timestamp
        FROM featk, range(0, {len(RUN_OFFSETS_DAYS)}) AS rr(r)
        WHERE r <= featk.doc_id % 3"""),
    "dirty": (["tk"], """
        SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE id END AS id,
               CASE WHEN doc_id % 11 = 0 THEN 'bad'
                    ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE content END AS content
        FROM tk"""),
    "acc": ([], """
        SELECT ['owner', 'writer', 'reader'][c_custkey % 3 + 1] AS list,
               CASE WHEN c_custkey % 10 = 0 THEN 'serviceAccount:' ELSE '' END
                 || 'u' || c_custkey || '@x.com' AS email
        FROM customer
        UNION ALL
        SELECT 'reader' AS list, 'u' || c_custkey || '@x.com' AS email
        FROM customer WHERE c_custkey % 50 = 1"""),
    "pf": ([], f"""
        SELECT DISTINCT 'p' || c_nationkey AS resource,
               CASE WHEN c_custkey % 4 = 3 THEN {_s(WORKLOAD_IDENTITY_ROLE)}
                    ELSE 'roles/' || lower(c_mktsegment) END AS role,
               CASE c_custkey % 4
                    WHEN 0 THEN 'user:u' || c_custkey || '@x.com'
                    WHEN 1 THEN 'group:g' || c_custkey || '@x.com'
                    WHEN 2 THEN 'serviceAccount:s' || c_custkey || '@x.com'
                    ELSE 'principalSet://pool/attribute.repository/org/repo-' || (c_custkey % 3) END
                 AS member
        FROM customer
        WHERE NOT (c_custkey % 4 = 3 AND c_nationkey % 5 = 0)"""),
    "prov": ([], """
        SELECT 'p' || n_nationkey AS resource,
               CASE WHEN n_nationkey % 6 = 0 THEN ''
                    ELSE 'assertion.repository == ''org/repo-' || (n_nationkey % 3) || '''' END
                 AS condition
        FROM nation"""),
    "stale": (["pf"], "SELECT DISTINCT * FROM pf WHERE member LIKE '%repo-2'"),
    "wanted": (["prov"], f"""
        SELECT resource, {_s(WORKLOAD_IDENTITY_ROLE)} AS role,
               'principalSet://pool/attribute.repository/' || repo AS member
        FROM (SELECT resource, regexp_extract(coalesce(condition, ''), {_s(CONDITION_REPO_PATTERN)}, 1) AS repo
              FROM prov)
        WHERE repo <> ''"""),
    "au": ([], f"""
        SELECT CAST(event_id AS VARCHAR) AS insert_id, ts,
               CASE event_type WHEN 'view' THEN {_s(ACCESS_TOKEN)}
                               WHEN 'click' THEN {_s(ID_TOKEN)} ELSE 'Other' END AS method,
               'projects/-/serviceAccounts/sa' || (event_id % 5) AS target,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'u' || user_id || '@x.com' END AS caller
        FROM events"""),
    "raw": (["au"], """
        SELECT insert_id, CAST(insert_id AS BIGINT) AS k, ts, method, target, caller,
               CASE WHEN CAST(insert_id AS BIGINT) % 19 = 0 THEN 'entry: malformed'
                    WHEN CAST(insert_id AS BIGINT) % 23 = 0 THEN 'timestamp: missing'
                    WHEN CAST(insert_id AS BIGINT) % 29 = 0 THEN 'timestamp: invalid' END AS errors
        FROM au"""),
    "unexp": (["au"], f"""
        SELECT * FROM au
        WHERE method = {_s(ACCESS_TOKEN)}
          AND NOT coalesce(regexp_matches(caller, {_s(chr(92) + 'Q' + Q.EXPECTED_CALLER + chr(92) + 'E')}), false)"""),
    "pr": ([], """
        SELECT s_name AS identity, TRUE AS dataset_exists, TRUE AS can_list_tables,
               TRUE AS can_get_dataset,
               (s_suppkey >> 2) & 1 = 1 AS can_create_table,
               s_suppkey & 1 = 1 AS can_read_data,
               (s_suppkey >> 1) & 1 = 1 AS can_write_data,
               (s_suppkey >> 3) & 1 = 1 AS can_delete_data,
               (s_suppkey >> 4) & 1 = 1 AS can_update_dataset
        FROM supplier"""),
}


def _with(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)
    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


def _topic_summary(src: str) -> str:
    return f"""SELECT predicted_topic, count(*) AS "count",
                      round(avg(sentiment_score), 6) AS avg_sentiment,
                      round(avg(word_count), 6) AS avg_words
               FROM {src} GROUP BY predicted_topic ORDER BY 2 DESC, 1"""


_SAMPLE = f"""
    SELECT {_s(SAMPLE_ID_PREFIX)} || i AS id,
           (SELECT as_of FROM clk) - to_days(CAST(i AS INTEGER)) AS created_at,
           {_list(SAMPLE_CONTENT)}[i + 1] AS content
    FROM range(0, {len(SAMPLE_CONTENT)}) AS s(i)"""


def _grant_rows() -> str:
    users = " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in ROLE_OF_LIST.items())
    rows = [f"SELECT CASE list {users} END AS role, {_USER} AS member FROM acc"]
    if ACCESS.ml_team_group:
        rows.append(f"SELECT {_s(EDITOR_ROLE)}, {_s('group:' + ACCESS.ml_team_group)}")
    sa = ACCESS.ml_pipeline_sa
    if sa:
        sa = sa if sa.startswith("serviceAccount:") else "serviceAccount:" + sa
        rows.append(f"SELECT {_s(EDITOR_ROLE)}, {_s(sa)}")
    if ACCESS.analysts_group:
        rows.append(f"SELECT {_s(VIEWER_ROLE)}, {_s('group:' + ACCESS.analysts_group)}")
    return "\nUNION ALL\n".join(rows)


def _summary_rows() -> str:
    rows = ["""SELECT CASE list WHEN 'owner' THEN 'data_owners' WHEN 'writer' THEN 'data_editors'
                                WHEN 'reader' THEN 'data_viewers' END AS access_group,
                      email AS member FROM acc"""]
    for group, value in [("data_editors", ACCESS.ml_pipeline_sa),
                         ("editor_groups", ACCESS.ml_team_group),
                         ("viewer_groups", ACCESS.analysts_group)]:
        if value:
            rows.append(f"SELECT {_s(group)}, {_s(value)}")
    return "SELECT DISTINCT access_group, member FROM (" + "\nUNION ALL\n".join(rows) + ")"


_LABEL = ("array_to_string(list_transform(string_split(replace(probe, '_', ' '), ' '), "
          "lambda w: upper(w[1]) || lower(w[2:])), ' ')")
_Q = chr(92) + "Q"
_E = chr(92) + "E"


def oracle_sql() -> dict[str, str]:
    cols = "id, created_at, content"
    wiu = _s(WORKLOAD_IDENTITY_ROLE)
    keys = "resource, role, member"
    same = "p.resource = s.resource AND p.role = s.role AND p.member = s.member"
    history = _with(f"""
            SELECT CAST(processing_timestamp AS DATE) AS process_date,
                   count(DISTINCT id) AS transcripts_processed,
                   count(DISTINCT predicted_topic) AS unique_topics,
                   min(processing_timestamp) AS first_process_time,
                   max(processing_timestamp) AS last_process_time
            FROM runs
            WHERE processing_timestamp >= (SELECT as_of FROM clk) - INTERVAL {Q.MONITOR_DAYS} DAY
            GROUP BY 1 ORDER BY 1 DESC""", "runs", "clk")
    retention = _with(f"""
            SELECT {cols} FROM t
            WHERE created_at > (SELECT as_of FROM clk) - to_milliseconds({Q.RETENTION_MS})""", "t", "clk")
    errors = """concat_ws('; ',
                       CASE WHEN id IS NULL THEN 'id: REQUIRED' END,
                       CASE WHEN created_at IS NULL THEN 'created_at: REQUIRED' END,
                       CASE WHEN created_at IS NOT NULL AND TRY_CAST(created_at AS TIMESTAMP) IS NULL
                            THEN 'created_at: invalid DATETIME' END,
                       CASE WHEN content IS NULL THEN 'content: REQUIRED' END)"""
    return {
        "daily_stats": _with("""
            SELECT CAST(created_at AS DATE) AS "date", count(*) AS transcript_count,
                   round(avg(length(content)), 6) AS avg_content_length,
                   min(created_at) AS earliest_transcript, max(created_at) AS latest_transcript
            FROM t GROUP BY 1 ORDER BY 1 DESC LIMIT 7""", "t"),
        "transcript_preview": _with(f"""
            SELECT id, created_at, CAST(length(content) AS BIGINT) AS content_length,
                   substr(content, 1, 50) AS content_preview
            FROM t ORDER BY id LIMIT {Q.PREVIEW_ROWS}""", "t"),
        "recent_transcripts": _with(f"SELECT {cols} FROM win30", "win30"),
        "rows_on_day": _with("""
            SELECT count(*) AS row_count FROM t
            WHERE CAST(created_at AS DATE) = (SELECT CAST(as_of AS DATE) FROM clk)""", "t", "clk"),
        "any_row": _with("SELECT 1 AS ok FROM t LIMIT 1", "t"),
        "sample_fallback": _with(f"""
            SELECT {cols} FROM win7
            UNION ALL
            SELECT * FROM ({_SAMPLE}) WHERE NOT EXISTS (SELECT 1 FROM win7)""", "win7", "clk"),
        "sample_fallback_empty": _with(f"""
            SELECT id, created_at + to_days({Q.EMPTY_AFTER_DAYS}) AS created_at, content FROM ({_SAMPLE})""", "clk"),
        "transcript_features": _with("SELECT * FROM feat30", "feat30"),
        "topic_summary": _with(_topic_summary("runs"), "runs"),
        "processing_history": history,
        "stored_history": history,
        "pipeline_summary": _with(_topic_summary("feat30"), "feat30"),
        "append_rows": _with(f"SELECT {cols} FROM t", "t"),
        "replace_processed": _with("SELECT * FROM feat30", "feat30"),
        "invalid_rows": _with(f"""
            SELECT id, created_at, errors FROM (SELECT id, created_at, {errors} AS errors FROM dirty)
            WHERE errors <> ''""", "dirty"),
        "ingest_errors": _with(f"""
            SELECT * FROM (SELECT {cols}, {errors} AS errors FROM dirty) WHERE errors <> ''""", "dirty"),
        "ingest_stream": _with("""
            SELECT id, TRY_CAST(created_at AS TIMESTAMP) AS created_at, content FROM dirty
            WHERE id IS NOT NULL AND content IS NOT NULL
              AND TRY_CAST(created_at AS TIMESTAMP) IS NOT NULL""", "dirty"),
        "create_as_select": _with(f"SELECT {cols} FROM t", "t"),
        "delete_where": _with(f"""
            SELECT {cols} FROM dirty
            WHERE NOT coalesce(length(content) < {Q.DELETE_BELOW_CHARS}, false)""", "dirty"),
        "delete_by_id": _with(f"SELECT {cols} FROM t WHERE id <> {_s(Q.DELETE_ID)}", "t"),
        "compacted_rows": _with(f"SELECT {cols} FROM t", "t"),
        "retention": retention,
        "expire_table": retention,
        "table_profile": _with("""
            SELECT count(*) AS num_rows, 'id,created_at,content' AS field_names FROM t""", "t"),
        "all_users": _with("SELECT DISTINCT email FROM acc", "acc"),
        "normalize_principals": _with(f"SELECT list, email, {_USER} AS member FROM acc", "acc"),
        "expand_grants": _with(_grant_rows(), "acc"),
        "log_viewers": _with(f"""
            SELECT r.role, {_USER} AS member
            FROM (SELECT DISTINCT email FROM acc) u,
                 (SELECT unnest({_list(LOG_ROLES)}) AS role) r""", "acc"),
        "grant_summary": _with(_summary_rows(), "acc"),
        "invalid_members": _with(f"""
            SELECT {keys} FROM pf
            WHERE NOT coalesce(regexp_matches(member, {_s(VALID_MEMBER_PATTERN)}), false)""", "pf"),
        "flatten_policy": _with(f"SELECT {keys} FROM pf", "pf"),
        "members_with_role": _with(f"SELECT resource, member FROM pf WHERE role = {wiu}", "pf"),
        "policy_has_member": _with(f"""
            SELECT DISTINCT resource FROM pf WHERE starts_with(member, {_s(Q.MEMBER_PREFIX)})""", "pf"),
        "stale_bindings": _with(f"""
            SELECT {keys} FROM pf p WHERE EXISTS (SELECT 1 FROM stale s WHERE {same})""", "pf", "stale"),
        "remove_bindings": _with(f"""
            SELECT {keys} FROM pf p WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE {same})""", "pf", "stale"),
        "ensure_bindings": _with(f"""
            SELECT {keys} FROM pf
            UNION ALL
            SELECT DISTINCT {keys} FROM wanted s
            WHERE NOT EXISTS (SELECT 1 FROM pf p WHERE {same})""", "pf", "wanted"),
        "missing_role": _with(f"""
            SELECT DISTINCT resource FROM pf
            WHERE resource NOT IN (SELECT resource FROM pf WHERE role = {wiu})""", "pf"),
        "repo_mismatch": _with(f"""
            SELECT b.resource, b.member, b.bound_repo, c.configured_repo,
                   contains(c.configured_repo, '-') AS hyphen_warning
            FROM (SELECT resource, member,
                         regexp_extract(member, {_s(MEMBER_REPO_PATTERN)}, 1) AS bound_repo
                  FROM pf WHERE role = {wiu}) b
            JOIN (SELECT resource,
                         regexp_extract(coalesce(condition, ''), {_s(CONDITION_REPO_PATTERN)}, 1)
                           AS configured_repo
                  FROM prov) c ON b.resource = c.resource
            WHERE b.bound_repo <> '' AND c.configured_repo <> ''
              AND b.bound_repo <> c.configured_repo""", "pf", "prov"),
        "members_like": _with(f"""
            SELECT {keys} FROM pf WHERE starts_with(member, {_s(Q.MEMBER_PREFIX)})""", "pf"),
        "policy_errors": """
            SELECT 'p' || c_nationkey AS resource, '{"bindings":[{"role":' AS policy, 'policy: malformed' AS errors
            FROM customer WHERE NOT (c_custkey % 4 = 3 AND c_nationkey % 5 = 0) AND c_nationkey % 4 = 1
            GROUP BY c_nationkey, CASE WHEN c_custkey % 4 = 3 THEN -1 ELSE c_custkey // 1000 END""",
        "missing_role_known": _with(f"""
            SELECT DISTINCT resource FROM pf
            WHERE CAST(substr(resource, 2) AS INTEGER) % 4 <> 1
              AND resource NOT IN (SELECT resource FROM pf WHERE role = {wiu})""", "pf"),
        "audit_errors": _with("""
            SELECT CASE WHEN k % 19 = 0 THEN '{"insertId":"' || insert_id || '","timestamp":'
                   ELSE '{"insertId":"' || insert_id || CASE WHEN k % 23 = 0 THEN '"' ELSE '","timestamp":"yesterday"' END
                     || ',"protoPayload":{"methodName":"' || method || '","request":{"name":"' || target || '"}'
                     || coalesce(',"authenticationInfo":{"principalEmail":"' || caller || '"}', '') || '}}' END AS entry, errors
            FROM raw WHERE errors IS NOT NULL""", "raw"),
        "audit_error_counts": _with("""
            SELECT errors, count(*) AS rows FROM raw WHERE errors IS NOT NULL GROUP BY errors""", "raw"),
        "audit_clean": _with("""
            SELECT insert_id, ts, method, target, caller FROM raw WHERE errors IS NULL""", "raw"),
        "audit_methods": _with(f"""
            SELECT insert_id, ts, method, target, caller FROM au
            WHERE method IN ({_s(ACCESS_TOKEN)}, {_s(ID_TOKEN)})""", "au"),
        "audit_for_target": _with(f"""
            SELECT insert_id, ts, caller, target FROM au
            WHERE method = {_s(ACCESS_TOKEN)}
              AND regexp_matches(target, {_s('serviceAccounts/' + _Q + Q.TARGET_ACCOUNT + _E)})""", "au"),
        "audit_unexpected": _with("SELECT insert_id, ts, method, target, caller FROM unexp", "unexp"),
        "audit_by_caller": _with(f"""
            SELECT insert_id, ts, method, target, caller FROM au
            WHERE method = {_s(ACCESS_TOKEN)} AND caller = {_s(Q.CALLER)}
            ORDER BY ts DESC, insert_id DESC LIMIT {Q.CALLER_ROWS}""", "au"),
        "suspicious_counts": _with(f"""
            SELECT time_bucket(INTERVAL '{Q.SUSPICIOUS_WINDOW}', ts) AS window_start,
                   time_bucket(INTERVAL '{Q.SUSPICIOUS_WINDOW}', ts) + INTERVAL '{Q.SUSPICIOUS_WINDOW}'
                     AS window_end,
                   count(*) AS suspicious_count
            FROM unexp GROUP BY 1, 2""", "unexp"),
        "suspicious_stream": _with(f"""
            SELECT time_bucket(INTERVAL '{Q.SUSPICIOUS_WINDOW}', ts) AS window_start,
                   time_bucket(INTERVAL '{Q.SUSPICIOUS_WINDOW}', ts) + INTERVAL '{Q.SUSPICIOUS_WINDOW}'
                     AS window_end,
                   count(*) AS suspicious_count
            FROM unexp GROUP BY 1, 2""", "unexp"),
        "probe_report": _with(f"""
            SELECT identity, {_LABEL} AS permission, ok
            FROM (UNPIVOT pr ON COLUMNS(* EXCLUDE (identity)) INTO NAME probe VALUE ok)""", "pr"),
        "access_level": _with("""
            SELECT identity,
                   CASE WHEN can_update_dataset AND can_delete_data THEN 'OWNER'
                        WHEN can_write_data AND can_create_table THEN 'WRITER'
                        WHEN can_read_data THEN 'READER' ELSE 'NONE' END AS access_level
            FROM pr""", "pr"),
    }
