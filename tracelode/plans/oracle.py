"""SQL for DuckDB, one text for each query, written apart from the operators."""

from __future__ import annotations

from tracelode.functions.text import STOPWORDS
from tracelode.plans import cases
from tracelode.sources.domain import SQL, WORDS

_ISSUES = "known AS (SELECT t.project, ticket_id, error, issue FROM ticket_error t JOIN issue_error i USING (project, error))"
_RECENT = """recent AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY project, ticket_id ORDER BY committed DESC, sha) AS rank
  FROM (SELECT DISTINCT f.project, ticket_id, sha, committed FROM flags f JOIN touches t USING (project, path))) WHERE rank <= 10)"""
_EVIDENCE = _RECENT + """, ev AS (
  SELECT a.project, ticket_id, path, role, CASE WHEN is_primary THEN 'feature_primary_file' ELSE 'feature_anchor' END AS type,
    CASE WHEN is_primary THEN 9.0::DOUBLE ELSE 3.0::DOUBLE END AS score, a.feature AS why
  FROM affects a JOIN file f ON a.project = f.project AND a.feature = f.feature
  UNION ALL
  SELECT r.project, ticket_id, t.path, role, 'recent_commit', 1.5::DOUBLE, r.sha
  FROM recent r JOIN touches t ON r.project = t.project AND r.sha = t.sha
  JOIN (SELECT DISTINCT project, path, role FROM file) f ON f.project = t.project AND f.path = t.path)"""
_SCORED = _EVIDENCE + """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY project, ticket_id, path, type ORDER BY score DESC) AS k FROM ev),
by_type AS (SELECT project, ticket_id, path, role, type, sum(score * pow(0.5::DOUBLE, k - 1)) AS points FROM ordered GROUP BY ALL),
raws AS (
  SELECT project, ticket_id, path, role, count(*) AS types,
    sum(points) + CASE WHEN bool_or(type NOT IN ('recent_commit', 'feature_anchor')) THEN 3.0::DOUBLE * least(count(*) - 1, 4) ELSE 0 END AS total
  FROM by_type GROUP BY project, ticket_id, path, role),
scored AS (
  SELECT * EXCLUDE (total),
    CAST(printf('%.1f', total + CASE WHEN role = 'doc' THEN CAST(printf('%.1f', raw * -0.75::DOUBLE) AS DOUBLE) ELSE 0 END) AS DOUBLE) AS score
  FROM (SELECT *, CAST(printf('%.1f', total) AS DOUBLE) AS raw FROM raws))"""
_CHANGES = """pairs AS (SELECT manifest, captured, lag(captured) OVER (PARTITION BY manifest ORDER BY captured) AS prior FROM (SELECT DISTINCT manifest, captured FROM snapshot)),
changes AS (
  SELECT manifest, captured, package, to_version, from_version,
    CASE WHEN from_version IS NULL THEN 'added' WHEN to_version IS NULL THEN 'removed' WHEN from_version <> to_version THEN 'changed' END AS change_kind
  FROM (SELECT s.manifest, s.captured, s.package, s.version AS to_version FROM snapshot s JOIN pairs p ON s.manifest = p.manifest AND s.captured = p.captured WHERE prior IS NOT NULL) n
  FULL JOIN (SELECT s.manifest, p.captured, s.package, s.version AS from_version FROM snapshot s JOIN pairs p ON s.manifest = p.manifest AND s.captured = p.prior) b USING (manifest, captured, package)
  WHERE from_version IS NULL OR to_version IS NULL OR from_version <> to_version)"""
_RUNS = """ends AS (
  SELECT run, arg_min(error, (occurred, event_id)) AS k, arg_max(event_type, (occurred, event_id)) AS last, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad
  FROM execution GROUP BY run),
runs AS (
  SELECT run, 'c' || k || '-1995' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') AS head_sha,
    CASE last WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'timed_out' WHEN 'view' THEN 'cancelled' END AS conclusion,
    CASE WHEN bad = n THEN 'terminal_failure' WHEN bad > 0 THEN 'retryable_failure' WHEN n > 1 THEN 'complete' END AS state
  FROM ends)"""
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = f"""list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({{0}}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
  '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g')), ' '), lambda w: len(w) > 2 AND w NOT IN ({_STOP})))"""
_SAID = f"""flatten(list_transform(list_filter(regexp_extract_all({{0}}, '[\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]{{{{2,}}}}')),
  lambda n: {_TOKENS.format('n')}))"""

_WORD = f"list_extract([{', '.join(repr(w) for w in WORDS)}], CAST(({{0}}) % {len(WORDS)} AS INTEGER) + 1)"
_TERMS = f"list_distinct(flatten(list_transform({{0}}, lambda t: {_TOKENS.format('t')})))"
_MEETING = f"list_filter({{0}}, lambda t: len(list_intersect({_TOKENS.format('t')}, {{1}})) > 0)"
# Brute force over all pairs of open tickets and their files.
_PACKET = f"""begun AS (SELECT * FROM ticket WHERE status = 'open'),
kinds AS (SELECT *, CASE WHEN role = 'test' THEN 'test' ELSE 'source' END AS kind FROM file),
mention AS (SELECT DISTINCT l.project, l.ticket_id, path FROM line l JOIN cat ON l_partkey = part WHERE l.status = 'open' AND l_tax >= 0.07 AND l_quantity >= 45),
wrong AS (SELECT b.project, b.ticket_id, {_TERMS.format("list_append(coalesce(e.names, []), 'slow ' || " + _WORD.format('b.ticket_id') + ")")} AS wrong FROM begun b
  LEFT JOIN (SELECT project, ticket_id, list({_WORD.format('error')} || '_E' || error) AS names FROM ticket_error GROUP BY ALL) e ON e.project = b.project AND e.ticket_id = b.ticket_id),
element AS (SELECT DISTINCT module, feature, [{_WORD.format("CAST(regexp_extract(feature, '([0-9]+)$', 1) AS INTEGER) + length(module)")} || 'Panel',
  {_WORD.format("CAST(regexp_extract(feature, '([0-9]+)$', 1) AS INTEGER) + length(module) + 5")} || '_view'] AS elements FROM cat),
modules AS (SELECT m.project, m.ticket_id, m.module, {_MEETING.format('elements', 'wrong')} AS matched FROM (
  SELECT DISTINCT l.project, l.ticket_id, module FROM line l JOIN cat ON l_partkey = part WHERE l.status = 'open' AND l_returnflag = 'N' AND l_tax <= 0.01) m
  JOIN element e ON e.module = m.module JOIN wrong w ON w.project = m.project AND w.ticket_id = m.ticket_id),
tokens AS (SELECT w.project, w.ticket_id, list_concat(wrong, {_TERMS.format('coalesce(matched, [])')}) AS narrow,
    list_concat(narrow, {_TERMS.format('list_concat(coalesce(features, []), coalesce(named, []))')}) AS broad FROM wrong w
  LEFT JOIN (SELECT project, ticket_id, list(feature) AS features FROM affects GROUP BY ALL) f ON f.project = w.project AND f.ticket_id = w.ticket_id
  LEFT JOIN (SELECT project, ticket_id, list(module) AS named, flatten(list(matched)) AS matched FROM modules GROUP BY ALL) m ON m.project = w.project AND m.ticket_id = w.ticket_id),
held AS (
  SELECT b.project, b.ticket_id, k.path, k.kind FROM begun b JOIN affects a ON a.project = b.project AND a.ticket_id = b.ticket_id JOIN kinds k ON k.project = a.project AND k.feature = a.feature
  UNION SELECT m.project, m.ticket_id, k.path, k.kind FROM modules m JOIN kinds k ON k.project = m.project AND k.module = m.module
  UNION SELECT project, ticket_id, path, CASE WHEN starts_with(path, 'tests/') THEN 'test' ELSE 'source' END FROM mention),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, ticket_id ORDER BY committed DESC, sha) AS nth
  FROM (SELECT DISTINCT h.project, h.ticket_id, sha, committed FROM held h JOIN touches t ON t.project = h.project AND t.path = h.path)) WHERE nth <= 10),
seen AS (SELECT h.*, l.sha, CAST(regexp_extract(l.sha, '^c([0-9]+)-', 1) AS BIGINT) AS author, CAST(right(l.sha, 2) AS INTEGER) AS month, broad, narrow FROM late l
  JOIN touches t ON t.project = l.project AND t.sha = l.sha JOIN held h ON h.project = l.project AND h.ticket_id = l.ticket_id AND h.path = t.path
  JOIN tokens k ON k.project = l.project AND k.ticket_id = l.ticket_id WHERE NOT starts_with(h.path, 'docs/')),
spoken AS (SELECT *, 'Rework ' || {_WORD.format('author + month')} || ' handling' AS message, {_MEETING.format("['load_' || " + _WORD.format('author + length(path)') + ", 'saveItem']", 'narrow')} AS defs FROM seen),
commits AS (
  SELECT project, ticket_id, path, kind, 'recent_commit' AS type, 1.5::DOUBLE AS score, 'Touched in recent commit ' || substr(sha, 1, 7) AS why FROM spoken
  UNION ALL SELECT project, ticket_id, path, kind, 'commit_message_match', 9.0::DOUBLE, message || ' · ' || substr(sha, 1, 7) FROM spoken WHERE len(list_intersect({_SAID.format('message')}, broad)) > 0
  UNION ALL SELECT project, ticket_id, path, kind, 'function_anchor_match', 6.0::DOUBLE, array_to_string(defs[1:3], ', ') || ' · ' || substr(sha, 1, 7) FROM spoken WHERE len(defs) > 0),
elements AS (SELECT m.project, m.ticket_id, path, kind, 'element_anchor_match' AS type, 6.0::DOUBLE AS score, array_to_string(matched[1:3], ', ') AS why
  FROM modules m JOIN kinds k ON k.project = m.project AND k.module = m.module WHERE len(matched) > 0 AND kind = 'source'),
mentions AS (SELECT project, ticket_id, path, CASE WHEN starts_with(path, 'tests/') THEN 'test' ELSE 'source' END AS kind, 'ticket_mention' AS type, 10.0::DOUBLE AS score,
  'File explicitly mentioned in ticket text' AS why FROM mention),
own AS (
  SELECT a.project, a.ticket_id, path, k.kind, CASE WHEN is_primary THEN 'feature_primary_file' ELSE 'feature_anchor' END AS type, CASE WHEN is_primary THEN 9.0::DOUBLE ELSE 3.0::DOUBLE END AS score, a.feature AS why
  FROM affects a JOIN begun b ON b.project = a.project AND b.ticket_id = a.ticket_id JOIN kinds k ON k.project = a.project AND k.feature = a.feature WHERE k.kind = 'source'
  UNION ALL SELECT m.project, m.ticket_id, path, kind, 'feature_primary_file', 9.0::DOUBLE, m.module FROM modules m JOIN kinds k ON k.project = m.project AND k.module = m.module WHERE kind = 'source'
  UNION ALL FROM elements UNION ALL FROM mentions UNION ALL FROM commits)"""
_FILES = """pieces AS (
  SELECT path, 'dependency_change' AS type, 5.0::DOUBLE AS score, strftime(captured, '%Y%m%d') || '/' || lpad(CAST(manifest AS VARCHAR), 20, '0') AS moment,
    package || ' ' || CASE WHEN from_version IS NULL THEN '' ELSE from_version || ' -> ' END || to_version || ' (' || manifest || '), used by ' || path AS why
  FROM changes JOIN cat ON package = part WHERE part % 10 = 0 AND to_version IS NOT NULL
  UNION ALL SELECT path, 'recent_test_failure', 9.0::DOUBLE, lpad(CAST(event_id AS VARCHAR), 20, '0'), 'failed in run ' || run FROM execution JOIN cat ON part = error AND role = 'test' WHERE event_type = 'error'),
of_files AS (SELECT path, type, count(*) AS pieces, sum(score * pow(0.5::DOUBLE, k - 1)) AS points, max_by(why, moment) AS last_why
  FROM (SELECT *, row_number() OVER (PARTITION BY path, type ORDER BY moment) AS k FROM pieces) GROUP BY ALL)"""
_PACKET_SCORES = """typed AS (
  SELECT project, ticket_id, path, kind, type, count(*) AS pieces, sum(score * pow(0.5::DOUBLE, k - 1)) AS points FROM (
    SELECT *, row_number() OVER (PARTITION BY project, ticket_id, path, type ORDER BY score DESC) AS k FROM own) GROUP BY ALL
  UNION ALL SELECT h.project, h.ticket_id, h.path, h.kind, f.type, f.pieces, f.points FROM held h JOIN of_files f ON f.path = h.path),
totals AS (
  SELECT project, ticket_id, path, kind, sum(points) + CASE WHEN bool_or(type NOT IN ('recent_commit', 'feature_anchor')) THEN 3.0::DOUBLE * least(count(*) - 1, 4) ELSE 0 END AS total,
    list_sort(list_concat(list(type || ':' || pieces), CASE WHEN starts_with(path, 'docs/') THEN ['doc_penalty:1'] ELSE [] END)) AS listed FROM typed GROUP BY project, ticket_id, path, kind),
points AS (SELECT *, CAST(printf('%.1f', total + CASE WHEN starts_with(path, 'docs/') THEN CAST(printf('%.1f', CAST(printf('%.1f', total) AS DOUBLE) * -0.75::DOUBLE) AS DOUBLE) ELSE 0 END) AS DOUBLE) AS score FROM totals),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, ticket_id, kind ORDER BY score DESC, path) AS rank FROM points) WHERE rank <= 20)"""


def _with(*parts: str, select: str) -> str:
    return ", ".join((SQL.strip(), *parts)) + "\n" + select


def queries() -> dict[str, str]:
    distinct = "coalesce(list_aggregate(list_sort(list(DISTINCT {}) FILTER (WHERE {})), 'string_agg', ','), '')"
    ranked = """(SELECT s.*, t.status, row_number() OVER (PARTITION BY s.project, s.ticket_id, role = 'test' ORDER BY score DESC, path) AS rank
            FROM scored s JOIN ticket t ON t.project = s.project AND t.ticket_id = s.ticket_id WHERE status = 'open')"""
    slugged = """(SELECT p_name AS name, CASE WHEN length(plain) > 40 THEN regexp_replace(substr(plain, 1, 40), '-[^-]*$', '') ELSE plain END AS slug
            FROM (SELECT p_name, regexp_replace(regexp_replace(lower(regexp_replace(p_name, '\\(s\\)', 's', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS plain FROM part))"""
    alike = """alike AS (SELECT project, ticket_id, CAST(s_nationkey AS BIGINT) AS issue, CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END AS weight FROM line
            JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 = 0 WHERE l_discount >= 0.05 AND l_returnflag IN ('R', 'N'))"""
    verdicts = ["valid", "unknown_slug", "evidence_too_short", "evidence_is_filler", "not_requested", "would_overwrite", "valid", "unknown_value", "not_a_list", "duplicates", "empty", "valid", "unknown_modules", "valid", "unknown_errors", "empty", "valid"]
    words = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 2)"
    part = lambda said, term: f"regexp_extract({said}, '(?i)(?:^|[^\\pL\\pN_])({term})(?:$|[^\\pL\\pN_])', 1)"
    match = " UNION ALL ".join(f"SELECT o_orderkey, '{t}' AS term, [{part('title', t)}, {part('body', t)}, {part("coalesce(message, '')", t)}] AS m FROM r" for t in ("Urgent", "order f", "error o", "medium", "low"))
    return {
        **{name: cases.sql(name) for name in cases.CASES},
        "rank_known_issues": _with(_ISSUES, alike, select="""SELECT project, ticket_id, issue, match_count, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY project, ticket_id ORDER BY match_count DESC, issue) AS rank FROM (SELECT project, ticket_id, issue, CAST(sum(weight) AS BIGINT) AS match_count FROM
            (SELECT project, ticket_id, issue, 1 AS weight FROM known UNION ALL SELECT * FROM alike) GROUP BY ALL)) WHERE rank <= 10"""),
        "text_tokens": f"SELECT doc_id, CAST(len(list_distinct({_SAID.format("coalesce(text, '')")})) AS INTEGER) AS tokens FROM documents",
        "closing_refs": """SELECT conv_id, turn, array_to_string(regexp_extract_all(coalesce(text, '') || ' closes #2 and FIX #' || conv_id, '(?i)(?:close|closes|fix|fixes|resolve|resolves)\\s+#([0-9]+)', 1), ',') AS closes,
            CAST(length(coalesce(text, '')) AS INTEGER) AS length FROM conversations WHERE role = 'user'""",
        "role_classify": _with(select="SELECT CASE role WHEN 'doc' THEN 'docs' ELSE role END AS role, CASE role WHEN 'doc' THEN 'markdown' ELSE 'python' END AS language, count(*) AS n FROM cat GROUP BY ALL"),
        "confidence_band": """SELECT c_custkey, score, greatest(0.0::DOUBLE, score - 0.06::DOUBLE) AS low, least(1.0::DOUBLE, score + 0.06::DOUBLE) AS high FROM (
            SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, b2 * (1 - 0.5::DOUBLE))) AS score FROM (SELECT c_custkey, b1 + 0.25::DOUBLE * (1 - b1) AS b2 FROM (
            SELECT c_custkey, b + 0.5::DOUBLE * (1 - b) AS b1 FROM (SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 10000)) AS b FROM customer))))""",
        "mirrored_coverage": """WITH s AS (SELECT DISTINCT p_partkey % 97 AS m, 'src/' || p_type || '/m' || (p_partkey % 97) || '.py' AS path FROM part),
            t AS (SELECT p_partkey % 97 AS m, 'tests/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '/test_m' || (p_partkey % 97) WHEN 1 THEN '/m' || (p_partkey % 97) || '_test' ELSE '/m' || (p_partkey % 97) END || '.py' AS test_path FROM part)
            SELECT test_path, count(*) AS covers, min(path) AS first_source FROM t JOIN s USING (m) GROUP BY test_path""",
        "proposal_verifier": f"SELECT p_partkey, list_extract({verdicts}, CAST(p_partkey % {len(verdicts)} AS INTEGER) + 1) AS verdict FROM part",
        "point_read": _with(select="SELECT * FROM ticket WHERE project = 'ASIA' AND ticket_id = 7"),
        "debug_packet": _with(_CHANGES, _PACKET, _FILES, _PACKET_SCORES, select="""SELECT b.project, b.ticket_id, b.kind, CAST(b.rank AS INTEGER) AS rank, b.path, score,
            CASE WHEN score >= 20 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(listed, ',') AS evidence, coalesce(o.why, '') AS why
            FROM best b LEFT JOIN (SELECT project, ticket_id, path, string_agg(why, '; ' ORDER BY why) AS why FROM own GROUP BY ALL) o ON o.project = b.project AND o.ticket_id = b.ticket_id AND o.path = b.path"""),
        "packet_mentions": _with(_PACKET, select="SELECT project, ticket_id, path, kind AS role, type, score, why FROM mentions"),
        "packet_elements": _with(_PACKET, select="SELECT project, ticket_id, path, kind AS role, type, score, why FROM elements"),
        "packet_commits": _with(_PACKET, select="SELECT project, ticket_id, path, kind AS role, type, score, why FROM commits"),
        "packet_file_evidence": _with(_CHANGES, _FILES, select="FROM of_files"),
        "add_edge": _with(select="SELECT project, ticket_id, feature FROM affects UNION SELECT f.project, f.ticket_id, c.feature FROM flags f JOIN file c ON c.project = f.project AND c.path = f.path"),
        "traverse_fixes": _with(select="""SELECT DISTINCT i.project, 'issue:' || i.issue AS start, 'fix:' || f.fix AS node FROM issue_error i JOIN issue_error j ON j.project = i.project AND j.error = i.error
            JOIN issue_fix f ON f.project = j.project AND f.issue = j.issue"""),
        "traverse_both": _with(select="SELECT DISTINCT a.project, 'module:' || a.module AS start, 'module:' || b.module AS node FROM file a JOIN file b ON a.project = b.project AND a.feature = b.feature"),
        "ad_hoc": _with(select="SELECT project, status, count(*) AS n FROM ticket WHERE status <> 'open' GROUP BY ALL"),
        "module_files": _with(select="""SELECT m.project, m.module, f.path FROM (SELECT DISTINCT project, module FROM file) m LEFT JOIN file f ON f.project = m.project AND f.module = m.module AND f.role <> 'test'
            WHERE NOT EXISTS (SELECT 1 FROM file p WHERE p.project = m.project AND p.module = m.module AND p.role = 'source' AND p.is_primary)"""),
        "commit_files": _with(_RECENT, select="""SELECT r.project, r.ticket_id, r.sha, CAST(r.rank AS INTEGER) AS rank, t.files, t.committed FROM recent r
            JOIN (SELECT project, sha, string_agg(path, ',' ORDER BY path) AS files, min(committed) AS committed FROM touches GROUP BY ALL) t ON t.project = r.project AND t.sha = r.sha"""),
        "touching_commits": _with(select="""SELECT f.project, f.path, f.node_type, count(t.sha) AS commits FROM (SELECT DISTINCT project, path, CASE role WHEN 'test' THEN 'test-file' ELSE 'file' END AS node_type FROM file) f
            LEFT JOIN touches t ON t.project = f.project AND t.path = f.path GROUP BY ALL"""),
        "feature_linker": f"""WITH f AS (SELECT 'item-' || item_id || '-' || list_reverse(list_sort(list_transform({words}, lambda w: {{'n': length(w), 'w': w}})))[1].w AS slug, coalesce({words}[1], '') AS name FROM benchmark WHERE text IS NOT NULL),
            own AS (SELECT DISTINCT slug, unnest({_TOKENS.format('slug')}) AS token FROM f UNION SELECT slug, unnest({_TOKENS.format('name')}) FROM f),
            telling AS (SELECT token, min(slug) AS slug FROM own GROUP BY token HAVING count(DISTINCT slug) = 1)
            SELECT DISTINCT doc_id, slug FROM (SELECT doc_id, unnest({_SAID.format("coalesce(text, '')")}) AS token FROM documents) JOIN telling USING (token)""",
        "error_matcher": f"""WITH r AS (SELECT o_orderkey, 'order ' || o_orderstatus AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'seen: Urgent_' || o_orderpriority ELSE 'all ' || lower(o_orderpriority) || '.' END AS body,
            CASE WHEN o_orderkey % 2 = 0 THEN 'ERROR ' || o_orderstatus || ' URGENT low' END AS message FROM orders), m AS ({match})
            SELECT o_orderkey, term, CASE WHEN m[1] <> '' THEN 'title' WHEN m[2] <> '' THEN 'body' ELSE 'message' END AS source_field, coalesce(nullif(m[1], ''), nullif(m[2], ''), m[3]) AS fragment FROM m WHERE array_to_string(m, '') <> ''""",
        "new_investigations": _with(_ISSUES, select="SELECT DISTINCT k.project, ticket_id || '--ki-' || issue || '--fix-' || fix || '--actionable' AS investigation FROM known k JOIN issue_fix USING (project, issue) WHERE fix <> 0"),
        "escalation_sweep": _with("""near AS (SELECT a.project, a.feature, a.ticket_id, t.created_on < DATE '1996-01-01' AS old, CAST(regexp_extract(a.feature, '([0-9]+)$', 1) AS INTEGER) AS k FROM affects a
            JOIN ticket t ON t.project = a.project AND t.ticket_id = a.ticket_id WHERE status = 'open')""",
            """counted AS (SELECT project, feature, k, count(*) AS tickets, count(*) FILTER (WHERE NOT old OR k % 3 = 0) AS added, bool_or(old) AS known FROM near GROUP BY ALL HAVING count(*) >= 3)""",
            select="""SELECT project, feature, action, CASE WHEN known THEN 1 ELSE 0 END + CASE action WHEN 'create' THEN 1 ELSE 0 END AS sequence, tickets, added FROM (
            SELECT *, CASE WHEN NOT known THEN 'create' WHEN k % 3 = 0 THEN 'retry' WHEN added = 0 THEN 'none' WHEN k % 2 = 1 THEN 'append' WHEN added >= 3 THEN 'create' ELSE 'none' END AS action FROM counted)"""),
        "slug_registry": """WITH n AS (SELECT p_partkey AS nth, lower(p_type) AS slug, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) || '  ' WHEN 2 THEN p_type || '!' ELSE upper(p_type) END AS name FROM part),
            m AS (SELECT *, trim(lower(name)) AS norm, first_value(trim(lower(name))) OVER (PARTITION BY slug ORDER BY nth) AS first FROM n)
            SELECT slug, max_by(name, (length(name), -nth)) AS name FROM m WHERE norm = first GROUP BY slug UNION ALL SELECT slug || '-2', max_by(name, nth) FROM m WHERE norm <> first GROUP BY slug""",
        "recall_feature": _with(select="""SELECT DISTINCT project, feature, 'module' AS node_type, module AS name FROM file UNION ALL
            SELECT DISTINCT project, feature, CASE role WHEN 'test' THEN 'test-file' ELSE 'file' END, path FROM file UNION ALL SELECT project, feature, 'customer-issue', CAST(ticket_id AS VARCHAR) FROM affects"""),
        "registry_list": _with(select="""SELECT project, feature, count(DISTINCT module) AS modules, count(*) FILTER (WHERE role <> 'test') AS files, count(*) FILTER (WHERE role = 'test') AS tests FROM file GROUP BY ALL"""),
        "fix_commit": _with(select="""SELECT f.project, f.fix, c.commit FROM (SELECT DISTINCT project, fix FROM issue_fix) f LEFT JOIN (
            SELECT project, CAST(regexp_extract(sha, '^c([0-9]+)-', 1) AS BIGINT) % 5 AS fix, substr(arg_min(sha, (committed, sha)), 1, 7) AS commit FROM touches GROUP BY ALL) c ON c.project = f.project AND c.fix = f.fix"""),
        "similarity_weighted_issues": _with(select="""SELECT project, ticket_id, issue, matches, similarity, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY project, ticket_id ORDER BY similarity DESC, matches DESC, issue) AS rank FROM (
            SELECT project, ticket_id, CAST(s_nationkey AS BIGINT) AS issue, count(*) AS matches, max(l_discount) AS similarity FROM line JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 = 0
            WHERE l_discount >= 0.05 AND l_returnflag IN ('R', 'N') GROUP BY ALL)) WHERE rank <= 10"""),
        "evidence_test_failure": _with(select="SELECT path, event_id, 'recent_test_failure' AS type, 9.0::DOUBLE AS score, run AS why FROM execution JOIN cat ON part = error AND role = 'test' WHERE event_type = 'error'"),
        "doc_penalty": _with(_SCORED, select="SELECT project, ticket_id, path, raw, score FROM scored WHERE role = 'doc'"),
        "confidence_label": _with(_SCORED, select=f"SELECT role, CASE WHEN score >= 20 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM {ranked} WHERE rank <= 20 GROUP BY ALL"),
        "slug_collisions": f"SELECT slug, max_by(name, (length(name), name)) AS kept, count(*) AS n FROM {slugged} GROUP BY slug HAVING count(*) > 1",
        "search_heading": "SELECT p_partkey AS doc, 2 AS level, 'Type: ' || p_type AS heading, 'type-' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 8 AS line_start, 9 AS line_end FROM part",
        "commit_edge_reconcile": _with(_RUNS, select="""SELECT run, unnest(CASE WHEN conclusion IN ('success', 'failure', 'timed_out') THEN ['TARGETED_COMMIT', 'TESTED_COMMIT'] ELSE ['TARGETED_COMMIT'] END) AS etype, head_sha
            FROM runs WHERE head_sha IN (SELECT sha FROM touches)"""),
        "expansion_backlog": _with(_RUNS, select="SELECT run, state FROM runs WHERE state NOT IN ('complete', 'terminal_failure')"),
        "flags_written_back": _with(_SCORED, select=f"""SELECT f.project, f.ticket_id, f.path FROM flags f JOIN ticket t ON t.project = f.project AND t.ticket_id = f.ticket_id WHERE t.status <> 'open'
            UNION ALL SELECT project, ticket_id, path FROM {ranked} WHERE rank <= 20 AND role = 'source' AND score >= 20"""),
        "pull_requests": _with(select="""SELECT o_orderkey AS number, CASE o_orderstatus WHEN 'F' THEN 'fix' ELSE 'ticket' END AS record, CASE WHEN o_orderstatus = 'F' THEN t.ticket_id END AS resolves
            FROM orders LEFT JOIN ticket t ON t.ticket_id = o_orderkey + 1 WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')"""),
        "stream_error_flagged": _with(select="SELECT DISTINCT project, ticket_id FROM ticket_error"),
        "stream_ci_corroboration": _with(select="SELECT event_id, error FROM execution WHERE event_type = 'error' AND error IN (SELECT error FROM ticket_error)"),
        "stream_root_cause": _with(select="SELECT a.project, feature FROM affects a JOIN ticket t ON t.project = a.project AND t.ticket_id = a.ticket_id WHERE status = 'open' GROUP BY ALL HAVING count(*) >= 3"),
        "stream_file_escalation": _with(select="""SELECT f.project, f.path, c.sha AS since_commit FROM flags f JOIN ticket t ON t.project = f.project AND t.ticket_id = f.ticket_id
            JOIN (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY committed DESC, sha DESC) AS rn FROM touches) c ON c.rn = 1 AND c.project = f.project AND c.path = f.path
            WHERE t.created_on > c.committed GROUP BY ALL HAVING count(DISTINCT f.ticket_id) >= 3"""),
        "debug_candidates": _with(_SCORED, select="""SELECT project, ticket_id, path, role, score, CASE WHEN score >= 20 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS confidence, types, CAST(rank AS INTEGER) AS rank
            FROM (SELECT s.*, row_number() OVER (PARTITION BY s.project, s.ticket_id, role = 'test' ORDER BY score DESC, path) AS rank FROM scored s JOIN ticket t ON t.project = s.project AND t.ticket_id = s.ticket_id WHERE status = 'open') WHERE rank <= 20"""),
        "ticket_features": _with(select="SELECT project, ticket_id, feature FROM affects"),
        "ticket_errors": _with(select="SELECT project, ticket_id, error FROM ticket_error"),
        "feature_files": _with(select="SELECT DISTINCT project, feature, module, path FROM file WHERE role <> 'test'"),
        "feature_tests": _with(select="SELECT DISTINCT project, feature, path FROM file WHERE role = 'test'"),
        "module_fallback_tests": _with(select="""SELECT DISTINCT m.project, m.module, m.feature, t.path FROM (SELECT DISTINCT project, module, feature FROM file) m
            LEFT JOIN file t ON t.project = m.project AND t.feature = m.feature AND t.role = 'test'
            WHERE NOT EXISTS (SELECT 1 FROM file f WHERE f.project = m.project AND f.module = m.module AND f.role = 'source' AND f.is_primary)"""),
        "error_known_issues": _with(_ISSUES, select="SELECT project, ticket_id, error, issue FROM known"),
        "known_issue_fixes": _with(_ISSUES, select="SELECT DISTINCT k.project, ticket_id, issue, fix FROM known k JOIN issue_fix USING (project, issue)"),
        "file_recent_commits": _with(_RECENT, select="SELECT project, ticket_id, sha, committed, CAST(rank AS INTEGER) AS rank FROM recent"),
        "traverse_degrees": _with("""e AS (SELECT project, CAST(ticket_id AS VARCHAR) AS a, 'AFFECTS' AS etype, feature AS b FROM affects UNION ALL
            SELECT project, CAST(ticket_id AS VARCHAR), 'HAS_ERROR', CAST(error AS VARCHAR) FROM ticket_error UNION ALL SELECT project, CAST(ticket_id AS VARCHAR), 'FLAGS', path FROM flags)""",
            select="SELECT project, a AS node, etype, count(*) AS n, 'out' AS direction FROM e GROUP BY ALL UNION ALL SELECT project, b, etype, count(*), 'in' FROM e GROUP BY ALL"),
        "evidence_primary": _with(_EVIDENCE, select="SELECT * FROM ev WHERE type <> 'recent_commit'"),
        "evidence_commits": _with(_EVIDENCE, select="SELECT * FROM ev WHERE type = 'recent_commit'"),
        "evidence_dependency": _with(_CHANGES, select="""SELECT package, count(DISTINCT sha) AS commits, count(*) AS changes FROM changes
            JOIN (SELECT DISTINCT CAST(regexp_extract(sha, '^c([0-9]+)-', 1) AS BIGINT) AS manifest, committed AS captured, sha FROM touches) USING (manifest, captured) GROUP BY package"""),
        "covered_tests": _with(_EVIDENCE, select="""SELECT a.project, a.ticket_id, f.path, string_agg(DISTINCT a.feature, ',' ORDER BY a.feature) AS covering FROM affects a
            JOIN file f ON f.project = a.project AND f.feature = a.feature AND f.role = 'test'
            WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.type = 'recent_commit' AND e.project = a.project AND e.ticket_id = a.ticket_id AND e.path = f.path) GROUP BY ALL"""),
        "score_decay": _with(_SCORED, select="SELECT project, ticket_id, path, role, raw, types, score FROM scored"),
        "rank_fixes": _with(_ISSUES, select="""SELECT project, ticket_id, fix, match_count, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY project, ticket_id ORDER BY match_count DESC, fix) AS rank
            FROM (SELECT k.project, ticket_id, fix, count(*) AS match_count FROM known k JOIN issue_fix USING (project, issue) GROUP BY ALL)) WHERE rank <= 10"""),
        "quick_summary": _with(select="""SELECT t.project, t.ticket_id, concat_ws(' · ', 'Features: ' || f.f, 'Errors: ' || e.e) AS summary FROM ticket t
            LEFT JOIN (SELECT project, ticket_id, string_agg(feature, ', ' ORDER BY feature) AS f FROM affects GROUP BY ALL) f ON f.project = t.project AND f.ticket_id = t.ticket_id
            LEFT JOIN (SELECT project, ticket_id, string_agg(CAST(error AS VARCHAR), ', ' ORDER BY error) AS e FROM ticket_error GROUP BY ALL) e ON e.project = t.project AND e.ticket_id = t.ticket_id"""),
        "status_counts": _with(select="""SELECT 'customer-issue' AS node_type, count(*) AS n FROM ticket UNION ALL SELECT 'feature', count(*) FROM (SELECT DISTINCT project, feature FROM file)
            UNION ALL SELECT 'module', count(*) FROM (SELECT DISTINCT project, module FROM file) UNION ALL SELECT CASE role WHEN 'test' THEN 'test-file' ELSE 'file' END, count(*) FROM (SELECT DISTINCT project, path, role FROM file) GROUP BY 1
            UNION ALL SELECT 'known-issue', count(*) FROM (SELECT DISTINCT project, issue FROM issue_error) UNION ALL SELECT 'commit', count(*) FROM (SELECT DISTINCT project, sha FROM touches)"""),
        "recall_module": _with(select=f"SELECT project, module, {distinct.format('feature', 'true')} AS features, {distinct.format('path', "role <> 'test'")} AS files, {distinct.format('path', "role = 'test'")} AS tests FROM file GROUP BY project, module"),
        "search_any": _with(select="""SELECT DISTINCT project, node_type, name FROM (SELECT project, 'file' AS node_type, path AS name FROM file UNION ALL SELECT project, 'module', module FROM file
            UNION ALL SELECT project, 'commit', sha FROM touches) WHERE contains(lower(name), 'small')"""),
        "diagnose": _with(_ISSUES, select="""SELECT project, feature, issue, paths, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project, feature ORDER BY paths DESC, issue) AS rank
            FROM (SELECT a.project, feature, issue, count(*) AS paths FROM affects a JOIN known k ON a.project = k.project AND a.ticket_id = k.ticket_id GROUP BY ALL)) WHERE rank <= 5"""),
        "upsert_latest": _with(select="SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred DESC, event_id DESC) AS rn FROM execution) WHERE rn = 1"),
        "replace_edges": _with("""fresh AS (SELECT DISTINCT project, ticket_id, feature FROM line JOIN cat ON l_partkey = part WHERE l_returnflag = 'R' AND l_linenumber = 1 AND status = 'open')""",
            select="SELECT a.* FROM affects a WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.project = a.project AND n.ticket_id = a.ticket_id) UNION ALL SELECT * FROM fresh"),
        "exists_semi": _with(select="SELECT * FROM ticket_error t WHERE EXISTS (SELECT 1 FROM issue_error i WHERE i.project = t.project AND i.error = t.error)"),
        "dangling_edges_anti": _with(select="SELECT * FROM ticket_error t WHERE NOT EXISTS (SELECT 1 FROM issue_error i WHERE i.project = t.project AND i.error = t.error)"),
        "ambiguous_tokens": _with(select=f"SELECT token, count(DISTINCT module) AS modules FROM (SELECT DISTINCT module, unnest({_TOKENS.format('module')}) AS token FROM cat) GROUP BY token HAVING count(DISTINCT module) > 1"),
        "tokenize": _with(select=f"SELECT module, unnest({_TOKENS.format('module')}) AS token FROM (SELECT DISTINCT module FROM cat)"),
        "error_linker": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))",
        "slugify": """SELECT slug, max_by(name, (length(name), name)) AS kept, count(*) AS n FROM (SELECT p_name AS name,
            CASE WHEN length(plain) > 40 THEN regexp_replace(substr(plain, 1, 40), '-[^-]*$', '') ELSE plain END AS slug
            FROM (SELECT p_name, regexp_replace(regexp_replace(lower(regexp_replace(p_name, '\\(s\\)', 's', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS plain FROM part)) GROUP BY slug""",
        "requirements_parse": """SELECT p_partkey, 'pkg:pypi/' || lower(regexp_replace(regexp_extract(replace(p_brand, '#', '-') || '_' || p_type, '^[A-Za-z0-9._-]*'), '[-_.]+', '-', 'g')) AS purl, '>=' || p_size AS spec FROM part""",
        "prior_snapshot_asof": _with(_CHANGES, select="SELECT manifest, captured, prior FROM pairs"),
        "manifest_diff": _with(_CHANGES, select="SELECT * FROM changes"),
        "manifest_change_counts": _with(_CHANGES, select="SELECT manifest, change_kind, count(*) AS n FROM changes GROUP BY ALL"),
        "cursor_prefix": _with(select="""SELECT user_id, CAST(sum(ok) AS BIGINT) AS processed, count(*) AS events FROM (SELECT *, CASE WHEN bool_or(event_type = 'error') OVER
            (PARTITION BY user_id ORDER BY occurred, event_id ROWS UNBOUNDED PRECEDING) THEN 0 ELSE 1 END AS ok FROM execution) GROUP BY user_id"""),
        "run_summary": _with(select="""SELECT run, count(*) AS executions, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(bool_or(event_type = 'error') AS INTEGER) AS any_failed,
            CAST(bool_and(event_type = 'error') AS INTEGER) AS all_failed FROM execution GROUP BY run"""),
        "test_path_resolution": _with(select="SELECT 'tests.test_' || part || '.TestCase' AS classname, 'resolved' AS link_state, path FROM cat WHERE role = 'test'"),
        "pattern_actionable": _with(_ISSUES, select="SELECT DISTINCT k.project, ticket_id, issue, fix FROM known k JOIN issue_fix USING (project, issue)"),
        "pattern_new_bug": _with(select="SELECT project, source_system, ticket_id FROM ticket WHERE kind = 'bug'"),
        "pattern_error_flagged": _with(select="SELECT project, source_system, ticket_id FROM ticket t WHERE EXISTS (SELECT 1 FROM ticket_error e WHERE e.project = t.project AND e.ticket_id = t.ticket_id)"),
        "pattern_ci_corroboration": _with(select="SELECT event_id, run, project, count(DISTINCT ticket_id) AS tickets FROM execution x JOIN ticket_error t ON t.error = x.error WHERE event_type = 'error' GROUP BY ALL"),
        "pattern_root_cause": _with(select="SELECT a.project, feature, count(*) AS open_tickets FROM affects a JOIN ticket t ON t.project = a.project AND t.ticket_id = a.ticket_id WHERE status = 'open' GROUP BY ALL HAVING count(*) >= 3"),
        "pattern_file_escalation": _with(select="""SELECT f.project, f.path, c.sha AS since_commit, count(DISTINCT f.ticket_id) AS tickets FROM flags f JOIN ticket t ON t.project = f.project AND t.ticket_id = f.ticket_id
            JOIN (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY committed DESC, sha DESC) AS rn FROM touches) c ON c.rn = 1 AND c.project = f.project AND c.path = f.path
            WHERE t.created_on > c.committed GROUP BY ALL HAVING count(DISTINCT f.ticket_id) >= 3"""),
        "milestone_first": _with(select="SELECT run, error, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run, error ORDER BY occurred, event_id) AS rn FROM execution WHERE event_type = 'error') WHERE rn = 1"),
        "escalation_sequence": _with(select="""SELECT project, feature, month, tickets, CAST(row_number() OVER (PARTITION BY project, feature ORDER BY month) AS INTEGER) AS sequence,
            CAST(month = max(month) OVER (PARTITION BY project, feature) AS INTEGER) AS is_open FROM (SELECT a.project, feature, CAST(date_trunc('month', created_on) AS DATE) AS month, count(DISTINCT a.ticket_id) AS tickets
            FROM affects a JOIN ticket t ON t.project = a.project AND t.ticket_id = a.ticket_id GROUP BY ALL HAVING count(DISTINCT a.ticket_id) >= 3)"""),
        "deleted_tickets": _with(select="SELECT project, ticket_id FROM ticket WHERE status <> 'deleted' AND ticket_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01')"),
        "backfill_created_at": _with(select="""SELECT t.project, t.ticket_id, coalesce(CASE WHEN status <> 'closed' THEN created_on END, f.first_seen) AS created_on FROM ticket t
            LEFT JOIN (SELECT project, ticket_id, min(CAST(l_shipdate AS DATE)) AS first_seen FROM line GROUP BY ALL) f ON f.project = t.project AND f.ticket_id = t.ticket_id"""),
        "unflagged_tickets": _with(select="SELECT project, ticket_id FROM ticket t WHERE status = 'open' AND NOT EXISTS (SELECT 1 FROM flags f WHERE f.project = t.project AND f.ticket_id = t.ticket_id)"),
        "merge_candidates": "SELECT p_brand, string_agg(p_type, ',' ORDER BY first) AS types FROM (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY ALL) GROUP BY p_brand",
        "module_groups": _with(select="SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder, count(*) AS files, count(DISTINCT part) AS stems FROM cat WHERE role = 'source' GROUP BY ALL HAVING count(*) >= 2"),
        "unclaimed_files": _with(select="SELECT path FROM cat WHERE role = 'source' AND part NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"),
        "duplicate_modules": """WITH s AS (SELECT p_brand, p_type, list_distinct(list(p_size)) AS s FROM part GROUP BY ALL)
            SELECT a.p_brand AS feature, a.p_type AS left_type, b.p_type AS right_type, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS common,
            CAST(len(list_intersect(a.s, b.s)) = least(len(a.s), len(b.s)) AS INTEGER) AS is_subset FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_type < b.p_type""",
        "py_symbols": """SELECT unnest(['class', 'function', 'method', 'attribute', 'import']) AS fact, unnest([n, n, n, n, 2 * n]) AS n, unnest([n, n, 1, 1, 2]) AS names FROM (SELECT count(*) AS n FROM part)""",
        "headings": """SELECT p_partkey AS doc, unnest([2, 3, 2, 2]) AS level, unnest(['About ' || p_brand, 'Size (s)', 'Type: ' || p_type, 'Price']) AS heading,
            unnest(['about-' || replace(lower(p_brand), '#', ''), 'size-s', 'type-' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-'), 'price']) AS slug,
            unnest([3, 6, 8, 10]) AS line_start, unnest([5, 7, 9, 11]) AS line_end FROM part""",
        "sections": """SELECT p_partkey AS doc, unnest([1, 3]) AS n, unnest(['About ' || p_brand, 'Price']) AS section, unnest(['body one' || chr(10) || chr(10) || '### Size (s)' || chr(10) || p_size, 'costs']) AS body FROM part""",
        "ticket_markdown": "SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, o_orderpriority AS source, 'status ' || o_orderstatus AS subject FROM orders",
        "git_log": """SELECT 'c' || s_suppkey AS sha, '2024-01-01' AS committed, s_name AS author, 'fix it' AS subject, unnest(['M', 'A']) AS status, unnest(['src/a' || s_nationkey || '.py', 'tests/b.py']) AS path FROM supplier""",
        "label_kind": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'bug' WHEN '2-HIGH' THEN 'feature_request' END AS kind FROM orders",
        "stream_actionable": _with(_ISSUES, select="SELECT DISTINCT k.project, ticket_id FROM known k JOIN issue_fix USING (project, issue)"),
        "stream_new_bug": _with(select="SELECT project, source_system, ticket_id FROM ticket WHERE kind = 'bug'"),
    }
