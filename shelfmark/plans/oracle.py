"""Checking SQL of the registered queries, written against the tables alone."""

from __future__ import annotations

from shelfmark import vocab
from shelfmark.plans.adapters import oracle_views
from shelfmark.plans.catalog_queries import CALLER_UID, NOW

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = oracle_views(body)


def quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def any_text(column: str, markers) -> str:
    return "(" + " OR ".join(f"contains({column}, '{marker}')" for marker in markers) + ")"


def parts(source: str, column: str = "url") -> str:
    """Subquery that adds scheme, location, host, port text, port, path and segments of a URL."""
    return f"""(SELECT *, CASE WHEN regexp_full_match(ptext, '[0-9]{{1,9}}') THEN CAST(ptext AS INT) END AS port,
        list_filter(string_split(regexp_replace(rawpath, ';[^/]*$', ''), '/'), lambda x: x <> '') AS segs
      FROM (SELECT *, lower(regexp_extract(hp, '^(\\[[^\\]]*\\]|[^:]*)', 1)) AS host,
              regexp_extract(hp, '^(?:\\[[^\\]]*\\]|[^:]*):(.*)$', 1) AS ptext
            FROM (SELECT *, lower(regexp_extract({column}, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//', 1)) AS sch,
                    regexp_extract({column}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS loc,
                    regexp_replace(regexp_extract({column}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', '') AS hp,
                    regexp_extract({column}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS rawpath
                  FROM {source}) a) b)"""


IDENT = """CASE WHEN sch NOT IN ('', 'file') AND host <> '' AND (ptext = '' OR coalesce(port <= 65535, false)) AND len(segs) > 0
  THEN sch || '|' || host || '|' || CASE WHEN port IS NULL OR (sch = 'http' AND port = 80) OR (sch = 'https' AND port = 443) THEN '' ELSE CAST(port AS VARCHAR) END || '|' || segs[1] END"""

_domains = " ".join(
    f"WHEN host = '{domain}' OR ends_with(host, '.{domain}') THEN '{name}'" for domain, name in vocab.PROVIDER_DOMAINS.items()
)
PROVIDER = f"""CASE WHEN host IS NULL THEN NULL
  WHEN host = 'api.osf.io' AND len(segs) >= 3 AND segs[1] = 'v2' AND segs[2] = 'nodes' THEN 'osf'
  WHEN host = 'osf.io' AND len(segs) > 0 AND regexp_full_match(segs[1], '[A-Za-z0-9]{{5}}') THEN 'osf'
  WHEN host = 'doi.org' AND regexp_full_match(array_to_string(segs, '/'), '10\\.(5281|5072)/(?i:zenodo)\\.[0-9]+') THEN 'zenodo'
  WHEN host IN ('zenodo.org', 'sandbox.zenodo.org') AND len(segs) >= 2 AND segs[1] IN ('record', 'records') AND regexp_full_match(segs[2], '[0-9]+') THEN 'zenodo'
  WHEN host IN ('zenodo.org', 'sandbox.zenodo.org') AND len(segs) >= 3 AND segs[1] = 'api' AND segs[2] = 'records' AND regexp_full_match(segs[3], '[0-9]+') THEN 'zenodo'
  {_domains} ELSE 'other' END"""

VERSION = f"""CASE WHEN ({PROVIDER}) = 'openneuro' THEN nullif(regexp_extract(regexp_replace(rawpath, ';[^/]*$', ''), '/versions/([0-9]+(?:\\.[0-9]+)*)', 1), '')
  WHEN ({PROVIDER}) = 'physionet' THEN nullif(regexp_extract(regexp_replace(rawpath, ';[^/]*$', ''), '/content/[^/]+/([0-9]+(?:\\.[0-9]+)+)(?:/|$)', 1), '') END"""

# -- Scans, sources, sinks --------------------------------------------------------------------

oracle("registry_scan", """
SELECT 'datasets' AS table_name, count(*) AS rows, count(DISTINCT dataset_id) AS datasets FROM datasets
UNION ALL SELECT 'dataset_aliases', count(*), count(DISTINCT dataset_id) FROM dataset_aliases
UNION ALL SELECT 'ingestion_jobs', count(*), count(DISTINCT dataset_id) FROM ingestion_jobs
UNION ALL SELECT 'health_history', count(*), count(DISTINCT dataset_id) FROM health_history""")

oracle("reconcile_schema", """
SELECT dataset_id, name, 'unknown' AS version, 'reference' AS storage_mode, true AS size_bytes_known, 'old ' || dataset_id AS legacy_note FROM datasets
UNION ALL SELECT dataset_id || '-new', name, version, storage_mode, size_bytes_known, NULL FROM datasets""")

oracle("osf_manifest", """
WITH RECURSIVE placed AS (SELECT o_orderkey, o_orderkey // 1000 AS src, (o_orderkey // 20) % 50 AS page, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
pages AS (SELECT DISTINCT src, page FROM placed),
links AS (
  SELECT src, page, CASE WHEN page = 19 THEN 15 WHEN page % 5 <> 4 THEN page + 1 END AS target FROM pages
  UNION ALL SELECT src, page, (page // 5 * 2 + 1) * 5 FROM pages WHERE page % 5 = 0 AND page // 5 * 2 + 1 < 10 AND NOT (page // 5 * 2 + 1 = 4 AND src % 3 = 1)
  UNION ALL SELECT src, page, (page // 5 * 2 + 2) * 5 FROM pages WHERE page % 5 = 0 AND page // 5 * 2 + 2 < 10 AND NOT (page // 5 * 2 + 2 = 4 AND src % 3 = 1)
  UNION ALL SELECT src, page, 0 FROM pages WHERE page = 45),
reach AS (SELECT src, CAST(0 AS BIGINT) AS page FROM pages WHERE page = 0
  UNION SELECT l.src, CAST(l.target AS BIGINT) FROM reach r JOIN links l ON l.src = r.src AND l.page = r.page JOIN pages p ON p.src = l.src AND p.page = l.target)
SELECT 'osf' || CAST(src AS VARCHAR) AS source_id, 'folder' || CAST(page // 5 AS VARCHAR) || '/file-' || CAST(o_orderkey AS VARCHAR) || '.bin' AS relative_path,
  size, 'https://files.osf.io/' || CAST(o_orderkey AS VARCHAR) AS download_url
FROM placed WHERE EXISTS (SELECT 1 FROM reach r WHERE r.src = placed.src AND r.page = placed.page)""")

oracle("zenodo_manifest", """
SELECT 'zen' || CAST(o_orderkey // 10 AS VARCHAR) AS source_id, 'data/' || CAST(o_orderkey AS VARCHAR) || '.bin' AS relative_path,
  CAST(floor(o_totalprice) AS BIGINT) AS size, 'https://zenodo.org/files/' || CAST(o_orderkey AS VARCHAR) AS download_url,
  CASE WHEN o_orderkey % 3 = 0 THEN 'md5:' || md5(CAST(o_orderkey AS VARCHAR)) END AS checksum FROM orders""")

oracle("hub_listing", """
SELECT 'hub' || CAST(o_orderkey // 25 AS VARCHAR) AS source_id, 'shard-' || CAST(o_orderkey AS VARCHAR) || '.fif' AS relative_path,
  CASE WHEN o_orderkey % 71 = 1 THEN CAST(-1 AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size,
  CASE WHEN o_orderkey % 71 = 1 THEN 'bad size' END AS problem FROM orders WHERE o_orderkey % 3 <> 0""")

BROKEN_PAGES = """placed AS (SELECT o_orderkey, o_orderkey // 1000 AS src, (o_orderkey // 1000) % 8 AS fault, (o_orderkey // 20) % 50 AS page, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
pages AS (SELECT DISTINCT src, fault, page FROM placed WHERE NOT (fault = 3 AND page = 12) AND NOT (fault = 4 AND page = 0)),
links AS (
  SELECT src, page, CASE WHEN page = 19 THEN 15 WHEN page % 5 <> 4 THEN page + 1 END AS target, 'next page is not stored' AS problem FROM pages WHERE NOT (fault = 6 AND page = 2)
  UNION ALL SELECT src, page, (page // 5 * 2 + 1) * 5, 'folder page is not stored' FROM pages WHERE page % 5 = 0 AND page // 5 * 2 + 1 < 10 AND NOT (page // 5 * 2 + 1 = 4 AND src % 3 = 1)
  UNION ALL SELECT src, page, (page // 5 * 2 + 2) * 5, 'folder page is not stored' FROM pages WHERE page % 5 = 0 AND page // 5 * 2 + 2 < 10 AND NOT (page // 5 * 2 + 2 = 4 AND src % 3 = 1)
  UNION ALL SELECT src, page, 0, 'folder page is not stored' FROM pages WHERE page = 45),
sound_links AS (SELECT * FROM links WHERE target IS NOT NULL AND NOT (src % 8 = 1 AND page = 3) AND NOT (src % 8 = 2 AND page = 7) AND NOT (src % 8 = 7 AND page = 0)),
reach AS (SELECT src, CAST(0 AS BIGINT) AS page FROM pages WHERE page = 0
  UNION SELECT l.src, CAST(l.target AS BIGINT) FROM reach r JOIN sound_links l ON l.src = r.src AND l.page = r.page JOIN pages p ON p.src = l.src AND p.page = l.target),
osf_files AS (SELECT p.src, p.page, p.o_orderkey, p.size FROM placed p JOIN reach r ON r.src = p.src AND r.page = p.page
  WHERE NOT (fault = 1 AND p.page = 3) AND NOT (fault = 2 AND p.page = 7) AND NOT (fault = 7 AND p.page = 0)),
osf_found AS (
  SELECT r.src, r.page, CAST(NULL AS BIGINT) AS entry, CASE r.src % 8 WHEN 1 THEN 'page is no object' WHEN 2 THEN 'data is no list' ELSE 'next page is no address' END AS problem
    FROM reach r WHERE (r.src % 8 = 1 AND r.page = 3) OR (r.src % 8 = 2 AND r.page = 7) OR (r.src % 8 = 6 AND r.page = 2)
  UNION ALL SELECT r.src, r.page, (SELECT count(*) FROM placed p WHERE p.src = r.src AND p.page = r.page) + k.i, k.problem FROM reach r,
    (VALUES (0, 'entry is neither file nor folder'), (1, 'entry is no object')) k(i, problem) WHERE r.src % 8 = 5 AND r.page = 1
  UNION ALL SELECT DISTINCT l.src, l.page, NULL, l.problem FROM sound_links l JOIN reach r ON r.src = l.src AND r.page = l.page
    LEFT JOIN pages p ON p.src = l.src AND p.page = l.target WHERE p.page IS NULL
  UNION ALL SELECT s.src, 0, NULL, 'first page is not stored' FROM (SELECT DISTINCT src FROM placed) s LEFT JOIN pages p ON p.src = s.src AND p.page = 0 WHERE p.page IS NULL
  UNION ALL SELECT p.src, p.page, NULL, 'stored page is not reachable' FROM pages p LEFT JOIN reach r ON r.src = p.src AND r.page = p.page WHERE r.page IS NULL
  UNION ALL SELECT s.src, NULL, NULL, 'listing has no files' FROM (SELECT DISTINCT src FROM placed) s WHERE s.src NOT IN (SELECT src FROM osf_files)),
zenodo_cases(fault, entry, problem) AS (VALUES (1, NULL, 'record is no object'), (2, NULL, 'files are neither list nor object'), (3, NULL, 'entries are no object'), (4, NULL, 'listing has no files'), (5, 0, 'file is no object')),
zenodo_found AS (SELECT record, entry, problem FROM (SELECT DISTINCT o_orderkey // 10 AS record FROM orders) r JOIN zenodo_cases ON fault = record % 9),
hub_records AS (SELECT o_orderkey // 25 AS listing, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 71 = 1 AS bad, o_orderkey % 3 <> 0 AS pending,
  row_number() OVER (PARTITION BY o_orderkey // 25 ORDER BY 'shard-' || CAST(o_orderkey AS VARCHAR) || '.fif') - 1 AS entry FROM orders),
hub_found AS (SELECT DISTINCT listing, CAST(NULL AS BIGINT) AS entry, 'listing is no list' AS problem FROM hub_records WHERE listing % 7 = 1
  UNION ALL SELECT listing, entry, 'bad size' FROM hub_records WHERE listing % 7 <> 1 AND bad AND pending)"""

oracle("listing_problems", f"""WITH RECURSIVE {BROKEN_PAGES}
SELECT 'osf' AS provider, 'osf' || CAST(src AS VARCHAR) AS source_id, 'https://api.osf.io/v2/nodes/osf' || CAST(src AS VARCHAR) || '/files/osfstorage/p' || CAST(page AS VARCHAR) || '/?page%5Bsize%5D=100' AS place, entry, problem FROM osf_found
UNION ALL SELECT 'zenodo', 'zen' || CAST(record AS VARCHAR), NULL, entry, problem FROM zenodo_found
UNION ALL SELECT 'huggingface', 'hub' || CAST(listing AS VARCHAR), NULL, entry, problem FROM hub_found""")

oracle("listing_verdicts", f"""WITH RECURSIVE {BROKEN_PAGES},
osf_ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY page IS NULL, CAST(page AS VARCHAR) || '/', coalesce(entry, -1), problem) AS n FROM osf_found WHERE problem <> 'stored page is not reachable'),
osf_counts AS (SELECT s.src, (SELECT count(*) FROM osf_files f WHERE f.src = s.src) AS files, (SELECT count(*) FROM osf_ranked p WHERE p.src = s.src) AS problems,
  (SELECT count(*) FROM osf_found p WHERE p.src = s.src AND p.problem = 'stored page is not reachable') AS notes,
  (SELECT coalesce(sum(size), 0) FROM osf_files f WHERE f.src = s.src) AS bytes, (SELECT problem FROM osf_ranked p WHERE p.src = s.src AND n = 1) AS first_problem
  FROM (SELECT DISTINCT src FROM placed) s),
zenodo_counts AS (SELECT r.record, CASE WHEN f.problem IS NULL THEN r.files WHEN r.record % 9 = 5 THEN 1 ELSE 0 END AS files, CASE WHEN r.record % 9 = 5 THEN 1 ELSE 0 END AS rejected,
  CASE WHEN f.problem IS NULL THEN r.bytes ELSE 0 END AS bytes, f.problem
  FROM (SELECT o_orderkey // 10 AS record, count(*) AS files, sum(CAST(floor(o_totalprice) AS BIGINT)) AS bytes FROM orders GROUP BY 1) r LEFT JOIN zenodo_found f ON f.record = r.record),
hub_counts AS (SELECT listing, CASE WHEN listing % 7 = 1 THEN 0 ELSE count(*) FILTER (pending) END AS files, CASE WHEN listing % 7 = 1 THEN 0 ELSE coalesce(sum(size) FILTER (pending AND NOT bad), 0) END AS bytes,
  (SELECT count(*) FROM hub_found f WHERE f.listing = r.listing) AS problems, (SELECT max(problem) FROM hub_found f WHERE f.listing = r.listing) AS first_problem FROM hub_records r GROUP BY listing)
SELECT 'osf' AS provider, 'osf' || CAST(src AS VARCHAR) AS source_id, files, 0::BIGINT AS rejected, problems, notes, CAST(bytes AS BIGINT) AS bytes, first_problem, problems = 0 AS usable FROM osf_counts
UNION ALL SELECT 'zenodo', 'zen' || CAST(record AS VARCHAR), files, rejected, CASE WHEN problem IS NULL THEN 0 ELSE 1 END, 0, CAST(bytes AS BIGINT), problem, problem IS NULL FROM zenodo_counts
UNION ALL SELECT 'huggingface', 'hub' || CAST(listing AS VARCHAR), files, 0, problems, 0, CAST(bytes AS BIGINT), first_problem, problems = 0 FROM hub_counts""")

oracle("listing_outcomes", f"""WITH RECURSIVE {BROKEN_PAGES},
sound AS (SELECT o_orderkey // 10 AS record, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS size,
  (o_orderkey // 10) % 2 = 1 AND o_orderkey % 2 = 1 AS pending FROM orders),
per AS (SELECT record, count(*) AS files, count(*) FILTER (pending) AS pending, coalesce(sum(size) FILTER (pending), 0) AS bytes, min('data/' || CAST(k AS VARCHAR) || '.bin') FILTER (pending) AS first_pending FROM sound GROUP BY record)
SELECT 'zen' || CAST(p.record AS VARCHAR) AS source_id, CASE WHEN f.problem IS NOT NULL THEN 'reject' WHEN pending > 0 THEN 'transfer' ELSE 'complete' END AS action,
  CASE WHEN f.problem IS NULL THEN files WHEN p.record % 9 = 5 THEN 1 ELSE 0 END AS files, f.problem AS first_problem,
  CASE WHEN f.problem IS NULL THEN pending ELSE 0 END AS pending, CAST(CASE WHEN f.problem IS NULL THEN bytes ELSE 0 END AS BIGINT) AS pending_bytes, CASE WHEN f.problem IS NULL THEN first_pending END AS first_pending
FROM per p LEFT JOIN zenodo_found f ON f.record = p.record""")

EVENT = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^ ]*)Z (DEBUG|INFO|WARNING|ERROR|CRITICAL) ([^ ]+)(?: (.*))?$"
ACTION = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^ ]*) (START|FAILED|SUCCEEDED)(?: (.*))?$"
# The checking engine has no look-ahead: cut the text before every " key=" and split each piece.
PARSED = f"""parsed AS (SELECT *, CASE WHEN rest IS NULL THEN NULL ELSE list_filter(list_transform(string_split(regexp_replace(' ' || rest, '\\s(\\w+)=', chr(1) || '\\1=', 'g'), chr(1)), lambda x: x), lambda x: regexp_matches(x, '^\\w+=')) END AS pairs
  FROM (SELECT *, CASE WHEN regexp_matches(line, '{EVENT}') THEN regexp_extract(line, '{EVENT}', 1) WHEN regexp_matches(line, '{ACTION}') THEN regexp_extract(line, '{ACTION}', 1) END AS ts_text,
    CASE WHEN regexp_matches(line, '{EVENT}') THEN regexp_extract(line, '{EVENT}', 2) END AS level,
    CASE WHEN regexp_matches(line, '{EVENT}') THEN regexp_extract(line, '{EVENT}', 3) WHEN regexp_matches(line, '{ACTION}') THEN regexp_extract(line, '{ACTION}', 2) END AS event,
    CASE WHEN regexp_matches(line, '{EVENT}') THEN regexp_extract(line, '{EVENT}', 4) WHEN regexp_matches(line, '{ACTION}') THEN regexp_extract(line, '{ACTION}', 3) END AS rest
    FROM log_lines) l)"""

oracle("parse_run_logs", f"""WITH {PARSED}
SELECT source, line_no, ts_text, level, event, array_to_string(list_sort(pairs), ' ') AS fields FROM parsed""")

SIZE = "CASE WHEN size_bytes_known THEN size_bytes END"
LABEL = """CASE WHEN size_bytes IS NULL THEN '-' WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' B'
  WHEN size_bytes / 1024.0 < 1024 THEN printf('%.1f KB', size_bytes / 1024.0) WHEN size_bytes / 1048576.0 < 1024 THEN printf('%.1f MB', size_bytes / 1048576.0)
  WHEN size_bytes / 1073741824.0 < 1024 THEN printf('%.1f GB', size_bytes / 1073741824.0) ELSE printf('%.1f TB', size_bytes / 1099511627776.0) END"""


def listed(kind: str) -> str:
    return f"coalesce((SELECT list_sort(list(DISTINCT a.value)) FROM dataset_aliases a WHERE a.dataset_id = d.dataset_id AND a.kind = '{kind}'), [])"


oracle("manifest_documents", f"""
SELECT dataset_id, CAST(to_json({{'record': 'dataset', 'dataset_id': dataset_id, 'name': name, 'provider': provider, 'source_url': source_url, 'version': version, 'modalities': modalities,
  'size_bytes': {SIZE}, 'status': status, 'storage_path': storage_path, 'storage_mode': storage_mode}}) AS VARCHAR) AS document FROM datasets d
UNION ALL SELECT DISTINCT dataset_id, CAST(to_json({{'record': 'alias', 'dataset_id': dataset_id, 'kind': kind, 'value': value}}) AS VARCHAR) AS document
FROM dataset_aliases WHERE value IS NOT NULL""")

oracle("serialize_datasets", f"""
SELECT dataset_id, name, provider, source_url, version, array_to_string(modalities, '|') AS modalities, size_bytes, status, storage_path, storage_mode,
  len(aliases) AS aliases, len(url_aliases) AS url_aliases, len(path_aliases) AS path_aliases,
  {LABEL} AS size_label
FROM (SELECT dataset_id, name, provider, source_url, version, modalities, {SIZE} AS size_bytes, status, storage_path, storage_mode,
  {listed('name_alias')} AS aliases, {listed('url')} AS url_aliases, {listed('path')} AS path_aliases FROM datasets d) r""")

oracle("alias_rollup", """
SELECT DISTINCT dataset_id, kind, value FROM dataset_aliases WHERE value IS NOT NULL""")

# -- Derived columns --------------------------------------------------------------------------

oracle("classify_source_urls", f"""
SELECT {PROVIDER} AS provider, count(*) AS urls, min(url) AS first_url FROM {parts('source_urls')} p GROUP BY 1""")

oracle("url_identity", f"""
SELECT {IDENT} AS identity, count(*) AS urls, min(url) AS first_url FROM {parts('source_urls')} p GROUP BY 1""")

oracle("infer_url_versions", f"""
SELECT request_id, provider, inferred, CASE WHEN requested_version IS NULL THEN inferred ELSE nullif(trim(requested_version), '') END AS version,
  CASE WHEN trim(requested_version) = '' THEN 'version is blank' WHEN requested_version IS NULL AND inferred IS NULL THEN 'version is required' END AS problem
FROM (SELECT *, {PROVIDER} AS provider, {VERSION} AS inferred FROM {parts('source_urls')} p) q""")

IDS = f"""ids AS (SELECT request_id, url, provider,
  CASE WHEN u AND sch NOT IN ('http', 'https') THEN 'not an http url' WHEN u AND host NOT IN ('osf.io', 'www.osf.io') THEN 'not a project host'
    WHEN osf_c IS NULL THEN 'no project id' WHEN NOT regexp_full_match(osf_c, '[A-Za-z0-9]+') THEN 'project id is not alphanumeric' END AS osf_problem, lower(osf_c) AS osf_c,
  CASE WHEN u AND (sch NOT IN ('http', 'https') OR loc = '') THEN 'not an http url' WHEN u AND len(followers) <> 1 THEN 'no single record id'
    WHEN NOT regexp_full_match(zen_c, '[0-9]+') THEN 'record id is not numeric' END AS zenodo_problem, zen_c,
  CASE WHEN u AND (sch NOT IN ('http', 'https') OR loc = '') THEN 'not an http url' WHEN u AND (len(segs) NOT IN (2, 4) OR segs[1] <> 'datasets') THEN 'not a dataset path'
    WHEN u AND len(segs) = 4 AND segs[3] <> 'versions' THEN 'not a version path' WHEN NOT regexp_full_match(neuro_c, 'ds[0-9]+') THEN 'dataset id is malformed'
    WHEN neuro_v IS NOT NULL AND NOT regexp_full_match(neuro_v, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN 'version is malformed' END AS openneuro_problem, neuro_c, neuro_v
  FROM (SELECT *, CASE WHEN u THEN segs[1] ELSE t END AS osf_c, CASE WHEN u THEN followers[1] ELSE t END AS zen_c, CASE WHEN u THEN segs[2] ELSE t END AS neuro_c,
      CASE WHEN u AND len(segs) = 4 THEN segs[4] END AS neuro_v
    FROM (SELECT *, {PROVIDER} AS provider, contains(t, '://') AS u,
        list_filter(list_transform(range(1, len(segs)), lambda i: CASE WHEN segs[i] IN ('record', 'records') THEN segs[i + 1] END), lambda x: x IS NOT NULL) AS followers
      FROM {parts("(SELECT *, trim(url) AS t FROM source_urls)", 't')} p) q) r)"""

oracle("extract_provider_ids", f"""WITH {IDS}
SELECT request_id, url, CASE WHEN osf_problem IS NULL THEN osf_c END AS osf_id, osf_problem, CASE WHEN zenodo_problem IS NULL THEN zen_c END AS zenodo_id, zenodo_problem,
  CASE WHEN openneuro_problem IS NULL THEN neuro_c END AS openneuro_id, CASE WHEN openneuro_problem IS NULL THEN neuro_v END AS openneuro_version, openneuro_problem
FROM ids""")

oracle("source_worklist", f"""WITH {IDS}
SELECT provider, source_key, version, CASE provider WHEN 'osf' THEN 'https://api.osf.io/v2/nodes/' || source_key || '/files/osfstorage/'
  WHEN 'zenodo' THEN 'https://zenodo.org/api/records/' || source_key ELSE 'https://github.com/OpenNeuroDatasets/' || source_key || '.git' END AS listing_url, count(*) AS requests
FROM (SELECT provider, osf_c AS source_key, NULL AS version FROM ids WHERE provider = 'osf' AND osf_problem IS NULL
  UNION ALL SELECT provider, zen_c, NULL FROM ids WHERE provider = 'zenodo' AND zenodo_problem IS NULL
  UNION ALL SELECT provider, neuro_c, neuro_v FROM ids WHERE provider = 'openneuro' AND openneuro_problem IS NULL) w
WHERE source_key IS NOT NULL GROUP BY 1, 2, 3, 4""")


def slug(x: str) -> str:
    return f"coalesce(nullif(lower(trim(regexp_replace({x}, '[^a-zA-Z0-9._-]+', '-', 'g'), '.-')), ''), 'dataset')"


LAST_PART = "regexp_extract(regexp_replace(coalesce(source_url, ''), '/+$', ''), '([^/]*)$', 1)"
oracle("storage_paths", f"""
SELECT dataset_id, destination, workspace, log_name, count(*) OVER (PARTITION BY workspace) AS sharing FROM (
  SELECT dataset_id, '/registry/datasets/' || {slug('name')} || '-' || {slug('version')} || '-' || dataset_id AS destination,
    'download-' || provider || '-' || {slug(LAST_PART)} || '-' || {slug('version')} AS workspace,
    'ingest-' || {slug('name')} || '-' || {slug('version')} || '.log' AS log_name FROM datasets) p""")

SP = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def masked(column: str) -> str:
    """Assignments and bearer tokens masked."""
    return (
        f"regexp_replace(regexp_replace({column}, '(?i)(authorization|cookie|password|secret|token|api[_-]?key)([{SP}]*[:=][{SP}]*)([^{SP},;]+)', '\\1\\2<redacted>', 'g'), "
        f"'(?i)\\bBearer[{SP}]+[^{SP},;]+', 'Bearer <redacted>', 'g')"
    )


LINK = rf"https?://[^{SP}\]\[)(}}{{<>\"'']+"


def cleaned(column: str) -> str:
    """URLs in an already masked text cleaned, by weaving the texts between with the cleaned URLs."""
    def x(pattern: str) -> str:
        return f"regexp_extract(v, '{pattern}', 1)"

    host_port = f"regexp_replace({x('^https?://([^/?#]*)')}, '^.*@', '')"
    port = f"regexp_extract({host_port}, ':(.*)$', 1)"
    clean = (
        f"CASE WHEN {port} <> '' AND NOT coalesce(TRY_CAST(CASE WHEN regexp_full_match({port}, '[0-9]{{1,9}}') THEN {port} END AS INT) <= 65535, false) THEN '<redacted-url>' "
        f"ELSE {x('^(https?)')} || '://' || lower(regexp_extract({host_port}, '^([^:]*)', 1)) || CASE WHEN {port} = '' THEN '' ELSE ':' || CAST(TRY_CAST({port} AS INT) AS VARCHAR) END "
        f"|| {x('^https?://[^/?#]*([^?#]*)')} END"
    )
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({column}, '{LINK}'), list_transform(regexp_extract_all({column}, '{LINK}'), lambda v: {clean})), "
        f"lambda z: z[1] || coalesce(z[2], '')), '')"
    )


oracle("redact_text", f"SELECT text_id, {cleaned('m')} AS redacted FROM (SELECT text_id, {masked('text')} AS m FROM log_texts) t")

FIELD_KEY, FIELD_VALUE = "regexp_extract(p, '^(\\w+)=', 1)", "regexp_extract(p, '^\\w+=(.*)$', 1)"
oracle("redact_fields", f"""WITH {PARSED},
fields AS (SELECT source, line_no, {FIELD_KEY} AS k, {FIELD_VALUE} AS raw FROM (SELECT source, line_no, unnest(pairs) AS p FROM parsed WHERE event IS NOT NULL) u),
clean AS (SELECT source, line_no, k, {cleaned('m')} AS v FROM (SELECT source, line_no, k, {masked('raw')} AS m FROM fields) t)
SELECT p.source, p.line_no,
  coalesce((SELECT string_agg(k || '=' || CASE WHEN lower(k) IN ({quoted(vocab.SENSITIVE_FIELDS)}) THEN '<redacted>' ELSE v END, ' ' ORDER BY k) FROM clean c WHERE c.source = p.source AND c.line_no = p.line_no), '') AS fields,
  coalesce((SELECT string_agg(k || '=' || v, ' ' ORDER BY k) FILTER (WHERE k IN ({quoted(vocab.SAFE_CONFIGURATION_KEYS)})) FROM clean c WHERE c.source = p.source AND c.line_no = p.line_no), '') AS configuration
FROM parsed p WHERE event IS NOT NULL""")

MODS = "list_sort(list_distinct(list_transform(modalities, lambda v: lower(trim(v)))))"
BAD_MODS = f"list_filter({MODS}, lambda v: v NOT IN ({quoted(vocab.MODALITIES)}))"
oracle("normalize_modalities", f"""
SELECT request_id, CASE WHEN len({BAD_MODS}) = 0 THEN array_to_string({MODS}, ',') END AS normalized, array_to_string({BAD_MODS}, ',') AS unknown FROM intake_requests""")


def aliases_of(column: str, canonical: str | None) -> str:
    keep = f" AND lower(trim(x)) <> lower({canonical})" if canonical else ""
    trimmed = f"list_transform({column}, lambda v: lower(trim(v)))"
    return (
        f"list_transform(list_filter({column}, lambda x, i: list_position({trimmed}, lower(trim(x))) = i{keep}), lambda x: trim(x))"
    )


oracle("normalize_aliases", f"""
SELECT request_id, len(list_filter(aliases, lambda v: trim(v) = '')) > 0 AS has_blank, array_to_string({aliases_of('aliases', 'trim(name)')}, '|') AS normalized FROM intake_requests""")

MANAGED = "CASE WHEN kind = 'symlink' THEN NULL WHEN kind = 'dir' OR (mode & 73) <> 0 THEN 493 ELSE 420 END"
PUBLIC = "CASE WHEN kind = 'symlink' THEN NULL WHEN kind = 'dir' THEN mode | 5 ELSE mode | 4 END"
oracle("access_plan", f"""
SELECT dataset_id, count(*) AS entries, count(*) FILTER (WHERE managed = 493) AS executable, count(*) FILTER (WHERE managed = 420) AS plain,
  count(*) FILTER (WHERE managed IS NULL) AS links, count(*) FILTER (WHERE public <> mode) AS changes
FROM (SELECT *, {MANAGED} AS managed, {PUBLIC} AS public FROM file_inventory) f GROUP BY dataset_id""")

oracle("access_report", f"""
SELECT dataset_id, changes, blocked, first_blocked, blocked = 0 AS publishable FROM (
  SELECT dataset_id, count(*) FILTER (WHERE public <> mode) AS changes, count(*) FILTER (WHERE public <> mode AND uid <> {CALLER_UID}) AS blocked,
    min(relative_path) FILTER (WHERE public <> mode AND uid <> {CALLER_UID}) AS first_blocked
  FROM (SELECT *, {PUBLIC} AS public FROM file_inventory) f GROUP BY dataset_id) g""")

# -- Filters ----------------------------------------------------------------------------------

oracle("find_datasets", """
SELECT dataset_id, name, provider, status, CAST(epoch(created_at) AS BIGINT) AS created_epoch FROM datasets d
WHERE status NOT IN ('missing', 'broken') AND array_to_string(modalities, ',') ILIKE '%eeg%'
  AND (name ILIKE '%rc1_%' OR EXISTS (SELECT 1 FROM dataset_aliases a WHERE a.dataset_id = d.dataset_id AND a.kind IN ('name', 'name_alias') AND a.value ILIKE '%rc1_%'))""")

oracle("eligible_nodes", f"""WITH members AS (
  SELECT g.name AS "group", CAST(generate_subscripts(g.members, 1) - 1 AS INT) AS position, unnest(g.members) AS node FROM proxies g WHERE lower(g.type) = 'selector'),
fitting AS (SELECT m.* FROM members m LEFT JOIN proxies p ON p.name = m.node WHERE contains(m.node, '-cheap') AND coalesce(lower(p.type), '') NOT IN ({quoted(vocab.GROUP_PROXY_TYPES)}))
SELECT "group", position, node, NULL AS problem FROM fitting
UNION ALL SELECT name, NULL, NULL, 'no direct node' FROM proxies WHERE lower(type) = 'selector' AND name NOT IN (SELECT "group" FROM fitting)
UNION ALL SELECT name, NULL, NULL, 'not a selector' FROM proxies WHERE lower(type) IN ('fallback', 'loadbalance', 'relay', 'urltest')""")

_hex = " OR ".join(f"regexp_full_match(sum_text, '{a}:[0-9a-fA-F]{{{n}}}')" for a, n in vocab.CHECKSUM_HEX_LENGTHS.items())
JUDGED = f"""judged AS (SELECT source_id, nullif(norm, '') AS relative_path, size, download_url, lower(sum_text) AS checksum,
  concat_ws(', ', CASE WHEN coalesce(norm, '') = '' THEN 'empty path' END, CASE WHEN list_contains(pp, '..') THEN 'unsafe path' END, CASE WHEN size IS NULL OR size < 0 THEN 'bad size' END,
    CASE WHEN NOT coalesce(regexp_matches(download_url, '^(?i:https?)://([^/?#]*@)?[^/?#:@]'), false) THEN 'bad url' END,
    CASE WHEN sum_text IS NOT NULL AND NOT ({_hex}) THEN 'bad checksum' END,
    CASE WHEN norm <> '' AND count(*) OVER (PARTITION BY source_id, norm) > 1 THEN 'duplicate path' END) AS errors
  FROM (SELECT *, array_to_string(pp, '/') AS norm FROM (SELECT *, list_filter(string_split(relative_path, '/'), lambda x: x NOT IN ('', '.')) AS pp, nullif(checksum, '') AS sum_text FROM manifest_files) a) b),
good AS (SELECT * FROM judged WHERE errors = '')"""
oracle("validate_manifest", f"WITH {JUDGED} SELECT * FROM judged")

INTAKE = f"""checked AS (SELECT *, concat_ws(', ', CASE WHEN clean_name = '' THEN 'name is blank' END, CASE WHEN blank_alias THEN 'alias is blank' END, CASE WHEN bad_mod THEN 'unknown modality' END) AS errors FROM (
  SELECT request_id, requested_at, source, storage_mode, size_bytes, source_is_dir, trim(name) AS clean_name,
    CASE WHEN url <> '' THEN {PROVIDER} ELSE provider END AS provider, {PROVIDER} AS url_provider, {VERSION} AS inferred, version AS raw_version,
    coalesce(nullif(CASE WHEN version IS NULL AND url <> '' THEN {VERSION} ELSE version END, ''), 'unknown') AS version,
    {MODS} AS modalities, {aliases_of('aliases', 'trim(name)')} AS aliases, CASE WHEN url <> '' THEN url ELSE 'file://' || source END AS source_reference,
    url IS NOT NULL AS has_remote_url, len(list_filter(aliases, lambda v: trim(v) = '')) > 0 AS blank_alias, len({BAD_MODS}) > 0 AS bad_mod
  FROM {parts('intake_requests')} p) q)"""
oracle("validate_intake_requests", f"""WITH {INTAKE}
SELECT request_id, clean_name AS name, provider, version, array_to_string(modalities, ',') AS modalities, array_to_string(aliases, '|') AS aliases, source_reference, has_remote_url, errors,
  concat_ws(', ', nullif(errors, ''), CASE WHEN trim(raw_version) = '' OR (raw_version IS NULL AND inferred IS NULL) THEN 'no version' END,
    CASE WHEN coalesce(url_provider, 'other') = 'other' THEN 'unknown provider' END) AS download_errors,
  CASE WHEN raw_version IS NULL THEN inferred ELSE nullif(trim(raw_version), '') END AS download_version FROM checked""")

oracle("allowed_sources", """
SELECT request_id, source, verdict = 'ok' AS accepted, verdict FROM (SELECT request_id, source, CASE WHEN NOT is_dir THEN 'not a directory'
  WHEN source = '/registry/incoming' OR starts_with(source, '/registry/incoming/') THEN 'ok' WHEN source = '/registry' OR starts_with(source, '/registry/') THEN 'inside managed storage'
  WHEN source IN ('/shared/raw', '/lab') OR starts_with(source, '/shared/raw/') OR starts_with(source, '/lab/') THEN 'ok' ELSE 'outside allowed roots' END AS verdict FROM source_paths) s""")

# -- Joins ------------------------------------------------------------------------------------

oracle("search_by_name", """WITH labels_of AS (SELECT dataset_id, name AS label FROM datasets UNION SELECT dataset_id, value FROM dataset_aliases WHERE kind IN ('name', 'name_alias')),
hits AS (SELECT DISTINCT q.request_id, l.dataset_id FROM needles q JOIN labels_of l ON l.label ILIKE '%' || q.needle || '%')
SELECT q.request_id, q.needle, count(h.dataset_id) AS match_count, arg_max(h.dataset_id, (d.created_at, d.dataset_id)) AS newest_dataset_id
FROM needles q LEFT JOIN hits h ON h.request_id = q.request_id LEFT JOIN datasets d ON d.dataset_id = h.dataset_id GROUP BY 1, 2""")

LOCATED = f"""located AS (SELECT dataset_id, kind, location, {IDENT} AS ident FROM {parts("(SELECT dataset_id, 'url' AS kind, source_url AS location FROM datasets WHERE source_url IS NOT NULL UNION ALL SELECT dataset_id, kind, value FROM dataset_aliases WHERE kind IN ('url', 'path'))", 'location')} p)"""

oracle("find_by_url", f"""WITH {LOCATED},
asked AS (SELECT {IDENT} AS ident FROM {parts("(SELECT 'https://zenodo.org/records/1' AS url)")} p)
SELECT dataset_id, name, provider, status FROM datasets WHERE dataset_id IN (
  SELECT dataset_id FROM located l, asked a WHERE l.location = 'https://zenodo.org/records/1' OR (l.kind = 'url' AND l.ident = a.ident))""")

oracle("find_of_provider", """SELECT dataset_id, name, status, array_to_string(modalities, ',') AS modalities FROM datasets
WHERE provider = 'openneuro' AND list_contains(modalities, 'meg')""")

oracle("match_urls", f"""WITH {LOCATED},
asked AS (SELECT request_id, url, {IDENT} AS ident FROM {parts('source_urls')} p),
pairs AS (SELECT DISTINCT a.request_id, l.dataset_id FROM asked a JOIN located l ON l.kind = 'url' AND l.ident = a.ident
  UNION SELECT a.request_id, l.dataset_id FROM asked a JOIN located l ON l.location = a.url)
SELECT a.request_id, count(p.dataset_id) AS match_count, arg_max(p.dataset_id, (d.created_at, d.dataset_id)) AS newest_dataset_id
FROM asked a LEFT JOIN pairs p ON p.request_id = a.request_id LEFT JOIN datasets d ON d.dataset_id = p.dataset_id GROUP BY 1""")

oracle("ambiguous_urls", f"""WITH {LOCATED},
shown AS (SELECT * FROM datasets WHERE status NOT IN ('missing', 'broken')),
vis AS (SELECT l.* FROM located l WHERE l.dataset_id IN (SELECT dataset_id FROM shown)),
asked AS (SELECT request_id, url, {IDENT} AS ident FROM {parts('source_urls')} p),
pairs AS (SELECT a.request_id, 'i|' || l.ident AS match_key, l.dataset_id FROM asked a JOIN vis l ON l.kind = 'url' AND l.ident = a.ident
  UNION SELECT a.request_id, 'x|' || l.location, l.dataset_id FROM asked a JOIN vis l ON l.location = a.url
    WHERE NOT EXISTS (SELECT 1 FROM vis m WHERE m.dataset_id = l.dataset_id AND m.kind = 'url' AND m.ident = a.ident)),
many AS (SELECT request_id FROM pairs GROUP BY 1 HAVING count(*) > 1)
SELECT match_key, count(*) AS requests, d.dataset_id, name, array_to_string(modalities, ', ') AS modalities, source_url, d.size_bytes, {LABEL.replace('size_bytes', 'd.size_bytes')} AS size_label
FROM pairs p JOIN many USING (request_id) JOIN (SELECT * REPLACE ({SIZE} AS size_bytes) FROM shown) d ON d.dataset_id = p.dataset_id
GROUP BY match_key, d.dataset_id, name, modalities, source_url, d.size_bytes""")

KEYS = """keys AS (SELECT 'id|' || dataset_id AS key, dataset_id FROM datasets UNION SELECT 'name|' || lower(name), dataset_id FROM datasets
  UNION SELECT 'name|' || lower(value), dataset_id FROM dataset_aliases WHERE kind IN ('name', 'name_alias')
  UNION SELECT 'ref|' || source_url, dataset_id FROM datasets WHERE source_url IS NOT NULL UNION SELECT 'ref|' || value, dataset_id FROM dataset_aliases WHERE kind IN ('url', 'path'))"""
OWNERS = KEYS + """, owners AS (SELECT key, arg_max(d.dataset_id, (d.created_at, d.dataset_id)) AS owner_id, max(d.created_at) AS created_at FROM keys JOIN datasets d USING (dataset_id) GROUP BY key)"""


def resolved(requests: str) -> str:
    return f"""asked AS (SELECT *, {IDENT} AS ident FROM {parts(f"(SELECT *, coalesce(nullif(url, ''), identifier) AS loc_text FROM {requests})", 'loc_text')} p),
given AS (SELECT *, (CASE WHEN identifier <> '' THEN 1 ELSE 0 END) + (CASE WHEN name <> '' THEN 1 ELSE 0 END) + (CASE WHEN url <> '' THEN 1 ELSE 0 END) AS n,
  coalesce(url <> '', false) OR (coalesce(identifier <> '', false) AND ident IS NOT NULL) AS by_url FROM asked),
hits AS (SELECT g.request_id, l.dataset_id FROM given g JOIN located l ON l.kind = 'url' AND l.ident = g.ident WHERE g.n = 1 AND g.by_url
  UNION SELECT g.request_id, l.dataset_id FROM given g JOIN located l ON l.location = g.loc_text WHERE g.n = 1 AND g.by_url
  UNION SELECT g.request_id, k.dataset_id FROM given g JOIN keys k ON k.key = 'id|' || g.identifier WHERE g.n = 1 AND NOT g.by_url
  UNION SELECT g.request_id, k.dataset_id FROM given g JOIN keys k ON k.key = 'ref|' || g.identifier WHERE g.n = 1 AND NOT g.by_url
  UNION SELECT g.request_id, k.dataset_id FROM given g JOIN keys k ON k.key = 'name|' || lower(coalesce(nullif(g.identifier, ''), g.name)) WHERE g.n = 1 AND NOT g.by_url),
resolved AS (SELECT g.request_id, CASE WHEN any_value(g.n) <> 1 THEN 'invalid' WHEN count(h.dataset_id) = 0 THEN 'not found' WHEN count(h.dataset_id) > 1 THEN 'ambiguous' ELSE 'found' END AS outcome,
  CASE WHEN count(h.dataset_id) = 1 THEN min(h.dataset_id) END AS dataset_id FROM given g LEFT JOIN hits h USING (request_id) GROUP BY g.request_id)"""


oracle("resolve_identifiers", f"WITH {LOCATED}, {KEYS}, {resolved('identifier_requests')} SELECT * FROM resolved")

ALIAS_KEYS = "unnest(['id|' || alias, 'name|' || lower(alias), 'ref|' || alias])"


def alias_hits(name: str, source: str) -> str:
    """Newest owner of each alias of a (request_id, dataset_id, pos, alias) source."""
    return f"""{name} AS (SELECT request_id, dataset_id, pos, alias, arg_max(owner_id, (created_at, owner_id)) AS owner_id FROM (
      SELECT s.*, {ALIAS_KEYS} AS key FROM {source} s) k JOIN owners USING (key) GROUP BY 1, 2, 3, 4)"""


def identity_verdict(source: str) -> str:
    """Conflict of every request of (request_id, clean_name, source_reference, aliases) with the registry."""
    return f"""by_own AS (SELECT r.request_id, o.owner_id, o.created_at, 1 AS by_name FROM {source} r JOIN owners o ON o.key = 'name|' || lower(r.clean_name)
    UNION ALL SELECT r.request_id, o.owner_id, o.created_at, 0 FROM {source} r JOIN owners o ON o.key = 'ref|' || r.source_reference),
own AS (SELECT request_id, arg_max(owner_id, (created_at, owner_id)) AS owner_id, arg_max(by_name, (created_at, owner_id, by_name)) AS by_name FROM by_own GROUP BY 1),
listed AS (SELECT request_id, CAST(NULL AS VARCHAR) AS dataset_id, CAST(generate_subscripts(aliases, 1) - 1 AS INT) AS pos, unnest(aliases) AS alias FROM {source}),
{alias_hits('per_alias', 'listed')},
other AS (SELECT request_id, arg_min(owner_id, pos) AS owner_id, arg_min(alias, pos) AS alias FROM per_alias GROUP BY 1)"""


oracle("identity_conflicts", f"""WITH {INTAKE}, {OWNERS}, {identity_verdict('checked')}
SELECT c.request_id, CASE WHEN coalesce(own.owner_id, other.owner_id) IS NULL THEN 'accepted' ELSE 'conflict' END AS outcome,
  CASE WHEN own.by_name = 1 THEN 'name' WHEN own.owner_id IS NOT NULL THEN 'source URL/path' WHEN other.owner_id IS NOT NULL THEN 'name alias' END AS reason,
  CASE WHEN own.owner_id IS NULL THEN other.alias END AS alias, coalesce(own.owner_id, other.owner_id) AS owner_id, d.name AS owner_name, d.version AS owner_version, d.storage_path AS owner_path
FROM checked c LEFT JOIN own USING (request_id) LEFT JOIN other USING (request_id) LEFT JOIN datasets d ON d.dataset_id = coalesce(own.owner_id, other.owner_id)""")

oracle("alias_conflicts", f"""WITH {OWNERS},
listed AS (SELECT request_id, dataset_id, CAST(generate_subscripts(al, 1) - 1 AS INT) AS pos, unnest(al) AS alias FROM (
  SELECT request_id, replace(request_id, 'a-', 'ds-') AS dataset_id, list_filter({aliases_of('aliases', None)}, lambda x: x <> '') AS al FROM alias_requests) a),
{alias_hits('per_alias', 'listed')}
SELECT request_id, dataset_id, pos, alias, owner_id FROM per_alias WHERE owner_id <> dataset_id""")

oracle("source_reference_conflicts", f"""WITH {KEYS}
SELECT r.request_id, r.dataset_id, r.url AS source_reference, arg_max(d.dataset_id, (d.created_at, d.dataset_id)) AS owner_id
FROM (SELECT request_id, replace(request_id, 'u-', 'ds-') AS dataset_id, url FROM update_requests WHERE url IS NOT NULL) r
JOIN keys k ON k.key = 'ref|' || r.url JOIN datasets d ON d.dataset_id = k.dataset_id WHERE d.dataset_id <> r.dataset_id GROUP BY 1, 2, 3""")

oracle("conflict_owner", f"WITH {OWNERS} SELECT key, owner_id FROM owners")

oracle("constraint_violations", """
SELECT 'dataset id repeats' AS rule, dataset_id AS subject, count(*) AS rows FROM datasets GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'source version repeats', provider || '|' || source_url || '|' || version, count(*) FROM datasets WHERE source_url IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'alias value repeats', value, count(*) FROM dataset_aliases GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'alias without dataset', dataset_id, count(*) FROM dataset_aliases WHERE dataset_id NOT IN (SELECT dataset_id FROM datasets) GROUP BY 2
UNION ALL SELECT 'job without dataset', dataset_id, count(*) FROM ingestion_jobs WHERE dataset_id NOT IN (SELECT dataset_id FROM datasets) GROUP BY 2
UNION ALL SELECT 'health check without dataset', dataset_id, count(*) FROM health_history WHERE dataset_id NOT IN (SELECT dataset_id FROM datasets) GROUP BY 2""")

COMPARED = JUDGED + """, compared AS (SELECT g.*, l.kind AS lkind, l.size AS lsize, l.checksum AS lsum,
  NOT coalesce(l.kind = 'file' AND l.size = g.size AND (g.checksum IS NULL OR coalesce(l.checksum = g.checksum, false)), false) AS pending
  FROM good g LEFT JOIN local_files l USING (source_id, relative_path))"""
oracle("pending_files", f"WITH {COMPARED} SELECT source_id, relative_path, size, coalesce(lkind, 'absent') AS found, lsize AS found_size FROM compared WHERE pending")

oracle("transfer_plan", f"""WITH {COMPARED}, acted AS (SELECT c.source_id, c.relative_path, c.size, p.size AS psize,
  CASE WHEN NOT pending THEN 'skip' WHEN lkind IS NOT NULL THEN 'conflict' WHEN p.kind <> 'file' THEN 'reject_partial' WHEN p.size > c.size THEN 'partial_too_large'
    WHEN p.size = c.size AND (c.checksum IS NULL OR coalesce(p.checksum = c.checksum, false)) THEN 'publish' WHEN p.size = c.size THEN 'partial_corrupt' WHEN p.size > 0 THEN 'resume' ELSE 'download' END AS action
  FROM compared c LEFT JOIN local_files p ON p.source_id = c.source_id AND p.relative_path = c.relative_path || '.part')
SELECT source_id, relative_path, size, action, CASE action WHEN 'resume' THEN psize WHEN 'download' THEN CAST(0 AS BIGINT) END AS "offset" FROM acted""")

MISSING = """missing AS (SELECT DISTINCT dataset_id, relative_path FROM file_inventory WHERE kind = 'symlink' AND coalesce(target_kind, '') <> 'dir' AND NOT content_present
  AND relative_path <> '.git' AND NOT starts_with(relative_path, '.git/'))"""
oracle("missing_content", f"WITH {MISSING} SELECT * FROM missing")

MISSING_SUMMARY = MISSING + """, first_five AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY relative_path) AS rn FROM missing),
missing_summary AS (SELECT dataset_id, count(*) AS missing, string_agg(relative_path, ', ' ORDER BY relative_path) FILTER (WHERE rn <= 5) AS examples FROM first_five GROUP BY 1)"""
oracle("missing_content_summary", f"""WITH {MISSING_SUMMARY}
SELECT dataset_id, missing, examples, 'Annexed content is not present locally: ' || examples AS message FROM missing_summary""")

oracle("discover_selector", """WITH fresh AS (SELECT * FROM connections c WHERE snapshot = 'after' AND (lower(host) = 'speed.example.net' OR coalesce(lower(sniff_host), '') = 'speed.example.net' OR coalesce(lower(destination_ip), '') = 'speed.example.net')
  AND NOT EXISTS (SELECT 1 FROM connections b WHERE b.snapshot = 'before' AND b.discovery_id = c.discovery_id AND b.id = c.id)),
counted AS (SELECT discovery_id, count(*) AS matches FROM fresh GROUP BY 1),
walked AS (SELECT f.discovery_id, generate_subscripts(f.chains, 1) AS pos, unnest(f.chains) AS hop FROM fresh f JOIN counted c ON c.discovery_id = f.discovery_id AND c.matches = 1),
outer_hop AS (SELECT w.discovery_id, arg_max(w.hop, w.pos) AS selector FROM walked w JOIN proxies p ON p.name = w.hop AND lower(p.type) = 'selector' GROUP BY 1)
SELECT d.discovery_id, coalesce(matches, 0) AS matches, CASE WHEN matches IS NULL THEN 'none' WHEN matches > 1 THEN 'ambiguous' WHEN selector IS NULL THEN 'no selector' ELSE 'found' END AS outcome, selector
FROM (SELECT DISTINCT discovery_id FROM connections) d LEFT JOIN counted USING (discovery_id) LEFT JOIN outer_hop USING (discovery_id)""")

LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY started_at DESC, check_id DESC) AS rn FROM health_history) h WHERE rn = 1)"
oracle("latest_health", f"WITH {LATEST} SELECT dataset_id, check_id, result, resulting_status, message FROM latest")
oracle("health_problems", f"""WITH {LATEST} SELECT dataset_id, d.name, l.check_id, l.result, l.message FROM latest l JOIN datasets d USING (dataset_id)
WHERE l.result IN ('missing', 'broken', 'error')""")

oracle("workspace_plan", f"""WITH held AS (SELECT workspace, count(relative_path) AS entries, coalesce(bool_or(relative_path = '.git' OR starts_with(relative_path, '.git/')), false) AS checkout, max(exact_tag) AS tag FROM workspaces GROUP BY 1),
asked AS (SELECT request_id, version, 'download-' || provider || '-' || {slug("regexp_extract(url, '([^/]*)$', 1)")} || '-' || {slug('version')} AS workspace FROM download_requests)
SELECT request_id, workspace, action, CASE WHEN action = 'reject' THEN CASE WHEN checkout THEN 'version differs' ELSE 'not a checkout' END END AS reason FROM (
  SELECT a.*, h.checkout, CASE WHEN h.entries IS NULL THEN 'new' WHEN checkout AND tag IS DISTINCT FROM version THEN 'reject' WHEN checkout THEN 'resume' WHEN entries = 0 THEN 'retry' ELSE 'reject' END AS action
  FROM asked a LEFT JOIN held h USING (workspace)) x""")

# -- Aggregations -----------------------------------------------------------------------------

SIZES = """sizes AS (SELECT d.dataset_id, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, count(size) AS inodes FROM (SELECT DISTINCT dataset_id FROM file_inventory) d
  LEFT JOIN (SELECT dataset_id, dev, ino, max(size) AS size FROM file_inventory
  WHERE NOT is_dangling AND (kind = 'file' OR (kind = 'symlink' AND target_kind = 'file')) GROUP BY 1, 2, 3) i USING (dataset_id) GROUP BY 1)"""
oracle("dataset_sizes", f"WITH {SIZES} SELECT * FROM sizes")

MARKERS = """markers AS (SELECT dataset_id, count(*) AS entries,
  bool_or(NOT regexp_matches(relative_path, '(^|/)\\.') AND (kind IN ('file', 'special') OR (kind = 'symlink' AND coalesce(target_kind, '') <> 'dir'))) AS has_payload,
  bool_or(relative_path = '.git' OR starts_with(relative_path, '.git/')) AND (bool_or(relative_path = '.datalad' OR starts_with(relative_path, '.datalad/')) OR bool_or(relative_path = '.git/annex' OR starts_with(relative_path, '.git/annex/'))) AS is_checkout
  FROM file_inventory GROUP BY 1)"""
oracle("payload_markers", f"WITH {MARKERS} SELECT * FROM markers")

oracle("transfer_summary", f"""WITH {COMPARED} SELECT source_id, count(*) AS files, count(*) FILTER (WHERE pending) AS pending, CAST(coalesce(sum(size) FILTER (WHERE pending), 0) AS BIGINT) AS pending_bytes,
  round(coalesce(sum(size) FILTER (WHERE pending), 0) / 1073741824.0, 2) AS pending_gib, round(max(size) FILTER (WHERE pending) / 1048576.0, 2) AS largest_mib FROM compared GROUP BY 1""")

oracle("verify_complete", f"""WITH {COMPARED} SELECT source_id, count(*) AS pending, min(relative_path) AS first_pending,
  'download verification found ' || CAST(count(*) AS VARCHAR) || ' pending files; first pending file: ' || min(relative_path) || '.' AS message FROM compared WHERE pending GROUP BY 1""")

oracle("duplicate_paths", """SELECT source_id, norm AS relative_path, count(*) AS copies FROM (
  SELECT source_id, array_to_string(list_filter(string_split(relative_path, '/'), lambda x: x NOT IN ('', '.')), '/') AS norm FROM manifest_files) m WHERE norm <> '' GROUP BY 1, 2 HAVING count(*) > 1""")


def profiles(table: str, phase: str) -> str:
    return f"""SELECT node, node_order, count(*) FILTER (WHERE ok) AS successes, count(*) AS attempts, count(*) FILTER (WHERE ok) / count(*) AS success_ratio,
      quantile_cont(value, 0.5) FILTER (WHERE ok) AS median_latency FROM {table} WHERE phase = '{phase}' GROUP BY 1, 2"""


oracle("latency_profiles", f"""SELECT node, node_order, successes, attempts, round(success_ratio, 6) AS success_ratio, round(median_latency, 6) AS median_latency FROM ({profiles('node_probes_open', 'latency')}) p""")

SCORES = """SELECT node, node_order, count(*) FILTER (WHERE ok AND phase = 'latency') AS latency_successes, count(*) FILTER (WHERE phase = 'latency') AS latency_attempts,
  count(*) FILTER (WHERE ok AND phase = 'throughput') AS throughput_successes, count(*) FILTER (WHERE phase = 'throughput') AS throughput_attempts,
  count(*) FILTER (WHERE ok) / count(*) AS overall_ratio, coalesce(quantile_cont(value, 0.5) FILTER (WHERE ok AND phase = 'throughput'), 0.0) AS median_throughput,
  quantile_disc(value, 0.95) FILTER (WHERE ok AND phase = 'latency') AS p95_latency FROM node_probes_open WHERE phase IN ('latency', 'throughput') GROUP BY 1, 2"""
oracle("node_scores", f"SELECT * REPLACE (round(overall_ratio, 6) AS overall_ratio, round(median_throughput, 6) AS median_throughput) FROM ({SCORES}) s")


def ranking(size: int) -> str:
    return f"""shortlist AS (SELECT node FROM ({profiles('node_probes_open', 'latency')}) p WHERE successes > 0 ORDER BY success_ratio DESC, median_latency ASC NULLS LAST, node_order LIMIT {size}),
ranked AS (SELECT row_number() OVER (ORDER BY throughput_successes DESC, overall_ratio DESC, median_throughput DESC, p95_latency ASC NULLS LAST, node_order) AS rank, * FROM ({SCORES}) s JOIN shortlist USING (node) WHERE throughput_successes > 0)"""


oracle("rank_nodes", f"""WITH {ranking(3)} SELECT CAST(rank AS INT) AS rank, node, throughput_successes, round(overall_ratio, 6) AS overall_ratio, round(median_throughput, 6) AS median_throughput, round(p95_latency, 6) AS p95_latency FROM ranked""")

oracle("benchmark_groups", f"""WITH all_members AS (
  SELECT g.name AS "group", CAST(generate_subscripts(g.members, 1) - 1 AS INT) AS position, unnest(g.members) AS node FROM proxies g WHERE lower(g.type) = 'selector'),
fitting AS (SELECT m."group", m.node, min(m.position) AS position FROM all_members m LEFT JOIN proxies p ON p.name = m.node WHERE contains(m.node, '-cheap') AND coalesce(lower(p.type), '') NOT IN ({quoted(vocab.GROUP_PROXY_TYPES)}) GROUP BY 1, 2),
resting AS (SELECT node FROM group_failures WHERE failed_at <= TIMESTAMP '{NOW}' GROUP BY node HAVING epoch_us(max(failed_at)) + 86400000000 > epoch_us(TIMESTAMP '{NOW}')),
candidates AS (SELECT * FROM fitting WHERE node NOT IN (SELECT node FROM resting)),
cheap AS ({profiles('group_probes', 'latency')}), real_probe AS (SELECT node, min(value) AS real_latency FROM group_probes WHERE phase = 'real_latency' AND ok GROUP BY 1),
judged AS (SELECT c.*, p.successes, p.attempts, p.success_ratio, p.median_latency, coalesce(p.successes > 0, false) AS passed, r.real_latency FROM candidates c LEFT JOIN cheap p USING (node) LEFT JOIN real_probe r USING (node)),
slots AS (SELECT "group", least(3, count(*)) - count(*) FILTER (passed) AS slots FROM judged GROUP BY 1),
filling AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY position) AS slot FROM judged WHERE NOT passed AND real_latency IS NOT NULL),
passing AS (SELECT "group", node, position, success_ratio AS ratio, median_latency AS latency, successes, attempts FROM judged WHERE passed
  UNION ALL SELECT f."group", node, position, 1.0, real_latency, 1, 1 FROM filling f JOIN slots s ON s."group" = f."group" WHERE slot <= slots),
shortlist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY ratio DESC, latency, position) AS place FROM passing) p WHERE place <= 3),
read AS (SELECT * FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY node, sample_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sample_chunks) c WHERE before < {vocab.THROUGHPUT_SAMPLE_BYTES}),
samples AS (SELECT node, sample_id, least(sum(bytes), {vocab.THROUGHPUT_SAMPLE_BYTES}) AS bytes, max(seconds) AS seconds FROM read GROUP BY 1, 2),
speeds AS (SELECT node, count(*) FILTER (bytes > 0 AND seconds > 0) AS throughput_successes, count(*) AS throughput_attempts, quantile_cont(bytes / 1048576.0 / seconds, 0.5) FILTER (bytes > 0 AND seconds > 0) AS median_throughput FROM samples GROUP BY 1),
slow AS (SELECT node, quantile_disc(value, 0.95) AS p95 FROM group_probes WHERE phase = 'latency' AND ok GROUP BY 1),
scored AS (SELECT s.*, t.throughput_successes, t.median_throughput, (s.successes + t.throughput_successes) / (s.attempts + t.throughput_attempts) AS overall_ratio, coalesce(l.p95, s.latency) AS p95_latency
  FROM shortlist s JOIN speeds t USING (node) LEFT JOIN slow l USING (node) WHERE t.throughput_successes > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY throughput_successes DESC, overall_ratio DESC, median_throughput DESC, p95_latency, position) AS rank FROM scored)
SELECT "group", CAST(rank AS INT) AS rank, node, throughput_successes, round(overall_ratio, 6) AS overall_ratio, round(median_throughput, 6) AS median_throughput, round(p95_latency, 6) AS p95_latency, NULL AS problem FROM ranked
UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN lower(type) <> 'selector' THEN 'not a selector' WHEN name NOT IN (SELECT "group" FROM fitting) THEN 'no direct node'
  WHEN name NOT IN (SELECT "group" FROM candidates) THEN 'all nodes rest' WHEN name NOT IN (SELECT "group" FROM shortlist) THEN 'no node passed the probes' ELSE 'no node passed a speed test' END
FROM proxies WHERE lower(type) IN ({quoted(vocab.GROUP_PROXY_TYPES)}) AND name NOT IN (SELECT "group" FROM ranked)""")

oracle("supplement_shortlist", f"""WITH cheap AS ({profiles('node_probes', 'latency')}), real_probe AS ({profiles('node_probes', 'real_latency')}),
need AS (SELECT least(3, count(*)) - count(*) FILTER (WHERE successes > 0) AS slots FROM cheap),
fill AS (SELECT *, row_number() OVER (ORDER BY node_order) AS slot FROM real_probe WHERE successes > 0 AND node NOT IN (SELECT node FROM cheap WHERE successes > 0))
SELECT node, node_order, successes, attempts, 'probe' AS origin FROM cheap WHERE successes > 0
UNION ALL SELECT node, node_order, successes, attempts, 'real probe' FROM fill, need WHERE slot <= slots""")

oracle("probe_throughput", f"""SELECT sample_id, bytes, seconds, problem, CASE WHEN problem IS NULL THEN round(bytes / 1048576.0 / seconds, 6) END AS mib_per_second FROM (
  SELECT *, CASE WHEN bytes <= 0 THEN 'no bytes' WHEN seconds <= 0 THEN 'no time' END AS problem FROM (
    SELECT sample_id, CAST(least(sum(bytes), {vocab.THROUGHPUT_SAMPLE_BYTES}) AS BIGINT) AS bytes, max(seconds) AS seconds FROM stream_chunks GROUP BY 1) s) t""")

oracle("run_outcomes", f"""WITH {PARSED}, runs AS (SELECT source, line_no, event, pairs, list_filter(pairs, lambda p: starts_with(p, 'category='))[1] AS cat, list_filter(pairs, lambda p: starts_with(p, 'delay_seconds='))[1] AS delay FROM parsed WHERE starts_with(source, 'run-'))
SELECT source, coalesce(arg_max(CASE event WHEN 'download_completed' THEN 'completed' WHEN 'download_failed' THEN 'failed' WHEN 'download_interrupted' THEN 'interrupted' END, line_no) FILTER (WHERE event IN ('download_completed', 'download_failed', 'download_interrupted')), 'started') AS outcome,
  count(*) FILTER (WHERE event = 'download_attempt_started') AS attempts, count(*) FILTER (WHERE event = 'download_attempt_failed') AS failures,
  arg_max(substr(cat, 10), line_no) FILTER (WHERE cat IS NOT NULL) AS last_category, round(coalesce(sum(TRY_CAST(substr(delay, 15) AS DOUBLE)) FILTER (WHERE event = 'download_retry_scheduled'), 0.0), 3) AS scheduled_delay
FROM runs GROUP BY 1""")

# -- Failures ---------------------------------------------------------------------------------

_types = quoted(vocab.NETWORK_ERROR_TYPES)


def status_in(values) -> str:
    return f"coalesce(outer_status IN ({', '.join(str(v) for v in values)}), false)"


def text_hit(markers, guard: str = "") -> str:
    def side(prefix: str) -> str:
        skip = f" AND {prefix}_type NOT IN ({quoted(vocab.LOCAL_FILE_ERROR_TYPES)})" if guard else ""
        return f"coalesce({prefix}_type IS NOT NULL AND {any_text(f'lower({prefix}_message)', markers)}{skip}, false)"

    return f"({side('outer')} OR {side('inner')})"


DECIDED = f"""classed AS (SELECT *, CASE WHEN {text_hit(vocab.TERMINAL_ERROR_TEXTS)} THEN 'terminal' WHEN {status_in(vocab.TERMINAL_HTTP_STATUSES)} THEN 'terminal' WHEN {status_in([429])} THEN 'rate_limit'
  WHEN {status_in(vocab.NETWORK_HTTP_STATUSES)} THEN 'network' WHEN coalesce(outer_status BETWEEN 500 AND 599, false) THEN 'server'
  WHEN outer_type = 'MihomoUnavailableError' THEN 'mihomo' WHEN outer_type IN ({_types}) OR coalesce(inner_type IN ({_types}), false) THEN 'network'
  WHEN transport IN ('http', 'xet', 'datalad') AND {text_hit(vocab.NETWORK_ERROR_TEXTS, 'local files')} THEN 'network' ELSE 'terminal' END AS category FROM attempts_flat),
decided AS (SELECT *, category <> 'terminal' AS retryable, category = 'network' AS rotate_node,
  CASE WHEN category = 'rate_limit' THEN CASE WHEN TRY_CAST(outer_retry_after AS DOUBLE) IS NOT NULL THEN greatest(0.0, TRY_CAST(outer_retry_after AS DOUBLE))
    WHEN try_strptime(regexp_extract(outer_retry_after, '(\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} \\d{{2}}:\\d{{2}}:\\d{{2}})', 1), '%d %b %Y %H:%M:%S') IS NOT NULL
    THEN greatest(0.0, CAST(epoch(try_strptime(regexp_extract(outer_retry_after, '(\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} \\d{{2}}:\\d{{2}}:\\d{{2}})', 1), '%d %b %Y %H:%M:%S')) - epoch(TIMESTAMP '{NOW}') AS DOUBLE)) END END AS retry_after FROM classed)"""
oracle("classify_failures", f"WITH {DECIDED} SELECT operation, attempt, category, retryable, rotate_node, retry_after FROM decided")

RUNS = DECIDED + """, islands AS (SELECT *, sum(CASE WHEN category = 'server' THEN 0 ELSE 1 END) OVER (PARTITION BY operation ORDER BY attempt) AS island FROM decided),
runs AS (SELECT operation, attempt, category, CASE WHEN category = 'server' THEN CAST(sum(CASE WHEN category = 'server' THEN 1 ELSE 0 END) OVER (PARTITION BY operation, island ORDER BY attempt) AS BIGINT) ELSE 0 END AS server_run FROM islands)"""
oracle("server_failure_runs", f"WITH {RUNS} SELECT *, CASE WHEN category = 'server' THEN server_run >= 2 ELSE category = 'network' END AS rotate FROM runs")

SCHEDULE = """CASE WHEN NOT retryable THEN 'fail_now' WHEN attempt_limit > 0 AND attempt >= attempt_limit THEN 'give_up' ELSE 'retry' END"""
DELAY = "greatest(least(300.0, 5.0 * pow(2, attempt - 1)), coalesce(retry_after, 0.0))"
oracle("retry_schedule", f"""WITH {DECIDED} SELECT operation, attempt, {SCHEDULE} AS action, CASE WHEN {SCHEDULE} = 'retry' THEN CAST({DELAY} AS DOUBLE) END AS delay_seconds FROM decided""")
oracle("retry_plan", f"""WITH {RUNS} SELECT d.operation, d.attempt, d.category, {SCHEDULE} AS action, CASE WHEN {SCHEDULE} = 'retry' THEN CAST({DELAY} AS DOUBLE) END AS delay_seconds, r.server_run,
  CASE WHEN {SCHEDULE} = 'retry' THEN CASE WHEN d.category = 'server' THEN r.server_run >= 2 ELSE d.category = 'network' END ELSE false END AS rotate_node
FROM (SELECT * FROM decided) d JOIN runs r USING (operation, attempt)""")

oracle("classify_command_output", f"""SELECT run_id, exit_code, CASE WHEN exit_code = 0 THEN 'ok' WHEN {any_text('lower(msg)', vocab.TERMINAL_COMMAND_TEXTS)} THEN 'terminal' WHEN {any_text('lower(msg)', vocab.NETWORK_COMMAND_TEXTS)} THEN 'network' ELSE 'terminal' END AS category,
  command || ' exited with status ' || CAST(exit_code AS VARCHAR) || ': ' || msg AS detail, CASE WHEN trim(output) = '' THEN 'exit status ' || CAST(exit_code AS VARCHAR) ELSE right(trim(output), 4000) END AS command_text
FROM (SELECT *, coalesce(nullif(trim({cleaned('m')}), ''), 'command produced no diagnostic output') AS msg FROM (SELECT *, {masked('output')} AS m FROM command_outputs) a) b""")

# -- Windows ----------------------------------------------------------------------------------

GATE = """WITH RECURSIVE kept AS (SELECT environment, min(epoch_us(ts)) AS kept_us FROM environment_runs GROUP BY 1
  UNION ALL SELECT k.environment, (SELECT min(epoch_us(e.ts)) FROM environment_runs e WHERE e.environment = k.environment AND epoch_us(e.ts) >= k.kept_us + 86400000000) AS kept_us FROM kept k WHERE k.kept_us IS NOT NULL)
SELECT environment, kept_us FROM kept WHERE kept_us IS NOT NULL"""
oracle("cooldown_gate", GATE)
oracle("stream_cooldown_gate", GATE)


def resting(now: str) -> str:
    return f"""cooling AS (SELECT node, count(*) AS failures, epoch_us(max(failed_at)) / 1000000.0 + 1800 AS rests_until, epoch_us(max(failed_at)) + 1800000000 <= epoch_us(TIMESTAMP '{now}') AS available
      FROM node_failures WHERE failed_at <= TIMESTAMP '{now}' GROUP BY 1)"""


oracle("node_cooldowns", f"WITH {resting(NOW)} SELECT node, failures, round(rests_until, 3) AS rests_until, available FROM cooling")

oracle("failover_choice", f"""WITH {ranking(10)}, {resting('2024-01-30 12:00:00')},
avail AS (SELECT r.rank, r.node, coalesce(c.available, true) AS available FROM ranked r LEFT JOIN cooling c USING (node)),
good AS (SELECT DISTINCT node FROM node_probes_open WHERE phase = 'throughput' AND ok),
failover AS (SELECT arg_min(node, rank) AS node FROM avail WHERE node <> 'node-3' AND available AND node IN (SELECT node FROM good)),
step AS (SELECT CASE WHEN bool_or(node = 'node-1' AND available) THEN 'node-1' ELSE arg_min(node, rank) FILTER (WHERE available) END AS node, coalesce(bool_or(node = 'node-1' AND available), false) AS stays FROM avail)
SELECT 'failover' AS decision, CASE WHEN node IS NULL THEN 'none' ELSE 'switch' END AS action, node FROM failover
UNION ALL SELECT 'next attempt', CASE WHEN stays THEN 'keep' WHEN node IS NULL THEN 'rank' ELSE 'switch' END, node FROM step""")

# -- Registry writes --------------------------------------------------------------------------

oracle("merge_modalities", """SELECT d.dataset_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(d.modalities, list_transform(u.modality_names, lambda v: lower(trim(v)))), lambda v: v <> ''))), ',') AS modalities
FROM datasets d JOIN update_requests u ON d.dataset_id = replace(u.request_id, 'u-', 'ds-')""")

REGISTER = f"""WITH RECURSIVE {INTAKE}, {OWNERS}, valid AS (SELECT *, CASE WHEN NOT source_is_dir THEN 'source is not a directory' WHEN size_bytes < 0 THEN 'size is negative' END AS failure FROM checked WHERE errors = ''),
{identity_verdict('valid')},
able AS (SELECT *, row_number() OVER (ORDER BY requested_at, request_id) AS n, list_concat(list_transform(list_concat([clean_name], aliases), lambda v: 'name|' || lower(v)), list_transform(list_concat([clean_name, source_reference], aliases), lambda v: 'value|' || v)) AS keys
  FROM valid WHERE failure IS NULL AND request_id NOT IN (SELECT request_id FROM own) AND request_id NOT IN (SELECT request_id FROM other)
    AND request_id NOT IN (SELECT request_id FROM (SELECT request_id, unnest(list_concat([clean_name, source_reference], aliases)) AS held FROM valid) z WHERE held IN (SELECT value FROM dataset_aliases))),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS request_id, false AS ok
  UNION ALL SELECT a.n, CASE WHEN list_has_any(w.taken, a.keys) THEN w.taken ELSE list_concat(w.taken, a.keys) END, a.request_id, NOT list_has_any(w.taken, a.keys) FROM walk w JOIN able a ON a.n = w.n + 1),
won AS (SELECT v.*, 'ds-' || left(sha256(clean_name || chr(31) || source_reference || chr(31) || version), 32) AS new_id FROM valid v JOIN walk w ON w.request_id = v.request_id AND w.ok),
batch_keys AS (SELECT 'name|' || lower(clean_name) AS key, request_id, requested_at, new_id FROM won UNION SELECT 'ref|' || source_reference, request_id, requested_at, new_id FROM won
  UNION SELECT 'id|' || new_id, request_id, requested_at, new_id FROM won UNION SELECT 'name|' || lower(unnest(aliases)), request_id, requested_at, new_id FROM won),
probes AS (SELECT request_id, requested_at, 1 AS own_probe, 1 AS by_name, 0 AS pos, 'name|' || lower(clean_name) AS key FROM valid UNION ALL SELECT request_id, requested_at, 1, 0, 0, 'ref|' || source_reference FROM valid
  UNION ALL SELECT request_id, requested_at, 0, 0, pos, unnest(['id|' || alias, 'name|' || lower(alias), 'ref|' || alias]) FROM (SELECT request_id, requested_at, CAST(generate_subscripts(aliases, 1) AS INT) AS pos, unnest(aliases) AS alias FROM valid) z),
met AS (SELECT p.request_id, p.own_probe, p.by_name, p.pos, o.owner_id AS owner, o.created_at FROM probes p JOIN owners o USING (key)
  UNION ALL SELECT p.request_id, p.own_probe, p.by_name, p.pos, b.new_id, b.requested_at FROM probes p JOIN batch_keys b USING (key) WHERE (b.requested_at, b.request_id) < (p.requested_at, p.request_id)),
verdict AS (SELECT request_id, bool_or(own_probe = 1) AS has_own, arg_max(owner, (created_at, owner)) FILTER (WHERE own_probe = 1) AS own_owner, arg_max(by_name, (created_at, owner, by_name)) FILTER (WHERE own_probe = 1) AS by_name,
  arg_max(owner, (-pos, created_at, owner)) FILTER (WHERE own_probe = 0) AS alias_owner FROM met GROUP BY 1),
judged AS (SELECT c.request_id, c.errors, v.failure, w.new_id, CASE WHEN x.has_own THEN CASE WHEN x.by_name = 1 THEN 'name' ELSE 'source URL/path' END WHEN x.request_id IS NOT NULL THEN 'name alias' END AS clash, CASE WHEN x.has_own THEN own_owner ELSE alias_owner END AS clash_owner
  FROM checked c LEFT JOIN valid v USING (request_id) LEFT JOIN won w USING (request_id) LEFT JOIN verdict x USING (request_id))
SELECT request_id, outcome, CASE outcome WHEN 'invalid' THEN errors WHEN 'conflict' THEN coalesce(clash, 'stored value repeats') WHEN 'failed' THEN failure END AS reason,
  CASE WHEN outcome = 'conflict' THEN clash_owner END AS owner_id, CASE WHEN outcome = 'accepted' THEN new_id END AS dataset_id
FROM (SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN new_id IS NOT NULL THEN 'accepted' WHEN clash IS NOT NULL THEN 'conflict' WHEN failure IS NOT NULL THEN 'failed' ELSE 'conflict' END AS outcome FROM judged) j"""
oracle("register_batch", REGISTER)
oracle("stream_intake_gate", REGISTER)

WON = REGISTER.split("batch_keys AS")[0].rstrip().rstrip(",")
oracle("registered_datasets", f"""{WON} SELECT new_id AS dataset_id, clean_name AS name, provider, source_reference AS source_url, version, array_to_string(modalities, ',') AS modalities,
  coalesce(size_bytes, 0) AS size_bytes, size_bytes IS NOT NULL AS size_bytes_known, 'available' AS status,
  CASE WHEN storage_mode = 'reference' THEN source ELSE '/registry/datasets/' || {slug('clean_name')} || '-' || {slug('version')} || '-' || new_id END AS storage_path,
  storage_mode, CAST(epoch(requested_at) AS BIGINT) AS created_at FROM won""")
oracle("registered_aliases", f"""{WON} SELECT new_id AS dataset_id, CASE WHEN has_remote_url THEN 'url' ELSE 'path' END AS kind, source_reference AS value FROM won
  UNION ALL SELECT new_id, 'name', clean_name FROM won UNION ALL SELECT new_id, 'name_alias', unnest(aliases) FROM won""")
oracle("registered_jobs", f"""{WON} SELECT 'job-' || request_id AS job_id, new_id AS dataset_id, 'succeeded' AS status, 'local' AS mode, CAST(NULL AS VARCHAR) AS message,
  CAST(epoch(requested_at) AS BIGINT) AS created_at FROM won""")

WALK_ALIASES = """walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS request_id, false AS ok
  UNION ALL SELECT a.n, CASE WHEN blocked THEN a.taken ELSE list_concat(a.taken, a.held) END, a.request_id, NOT blocked
    FROM (SELECT f.n, w.taken, f.request_id, f.held, len(list_filter(w.taken, lambda t: list_contains(f.keys, split_part(t, chr(31), 2)) AND split_part(t, chr(31), 1) <> f.dataset_id)) > 0 AS blocked FROM walk w JOIN free f ON f.n = w.n + 1) a)"""

oracle("add_aliases", f"""WITH RECURSIVE {LOCATED}, {OWNERS}, asks AS (SELECT request_id, identifier, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS url FROM alias_requests), {resolved('asks')},
staged AS (SELECT r.request_id, s.outcome AS found, s.dataset_id, len(list_filter(r.aliases, lambda v: trim(v) = '')) > 0 AS blank, {aliases_of('r.aliases', "coalesce(d.name, '')")} AS al
  FROM alias_requests r JOIN resolved s USING (request_id) LEFT JOIN datasets d ON d.dataset_id = s.dataset_id),
usable AS (SELECT * FROM staged WHERE found = 'found' AND NOT blank),
listed AS (SELECT request_id, dataset_id, CAST(generate_subscripts(al, 1) - 1 AS INT) AS pos, unnest(al) AS alias FROM usable),
{alias_hits('per_alias', 'listed')},
hit AS (SELECT request_id, arg_min(alias, pos) AS alias, arg_min(owner_id, pos) AS owner_id FROM per_alias WHERE owner_id <> dataset_id GROUP BY 1),
free AS (SELECT *, row_number() OVER (ORDER BY request_id) AS n, list_transform(keys, lambda k: dataset_id || chr(31) || k) AS held FROM (
  SELECT request_id, dataset_id, list_concat(list_transform(al, lambda v: 'name|' || lower(v)), list_transform(al, lambda v: 'value|' || v)) AS keys FROM usable WHERE request_id NOT IN (SELECT request_id FROM hit)) u),
{WALK_ALIASES}
SELECT s.request_id, s.dataset_id, CASE WHEN s.blank THEN 'invalid' WHEN s.found <> 'found' THEN s.found WHEN h.request_id IS NOT NULL OR NOT w.ok THEN 'conflict' ELSE 'accepted' END AS outcome, h.alias, h.owner_id
FROM staged s LEFT JOIN hit h USING (request_id) LEFT JOIN walk w USING (request_id)""")

UPD = "list_filter(modality_names, lambda v: v <> '')"
oracle("update_metadata", f"""WITH RECURSIVE {LOCATED}, {OWNERS}, asks AS (SELECT request_id, identifier, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS url FROM update_requests), {resolved('asks')},
req AS (SELECT request_id, new_url, new_version, given_provider, force, url_provider, mods, al0, coalesce(url_provider, given_provider) AS effective,
    has_url, has_version FROM (SELECT *, CASE WHEN new_url IS NULL THEN NULL ELSE {PROVIDER} END AS url_provider FROM {parts(f"(SELECT request_id, trim(url) AS new_url, url IS NOT NULL AS has_url, version IS NOT NULL AS has_version, trim(version) AS new_version, provider AS given_provider, force, {UPD} AS mods, list_filter(alias_names, lambda v: v <> '') AS al0 FROM update_requests)", 'new_url')} p) q),
cur AS (SELECT r.*, s.outcome AS found, s.dataset_id, d.name AS canonical, d.provider AS old_provider, d.source_url AS old_url, d.version AS old_version,
    coalesce(regexp_extract(d.source_url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) NOT IN ('', 'file'), false) AS has_remote,
    r.new_url IS NOT NULL AND r.new_url IS DISTINCT FROM d.source_url AS changes_url, {aliases_of('r.al0', "coalesce(d.name, '')")} AS al
  FROM req r JOIN resolved s USING (request_id) LEFT JOIN datasets d ON d.dataset_id = s.dataset_id),
err AS (SELECT *, concat_ws(', ', CASE WHEN NOT has_url AND given_provider IS NULL AND NOT has_version AND len(mods) = 0 AND len(al0) = 0 THEN 'nothing to update' END,
    CASE WHEN len(list_filter(mods, lambda v: lower(trim(v)) NOT IN ({quoted(vocab.MODALITIES)}))) > 0 THEN 'unknown modality' END, CASE WHEN new_url = '' THEN 'url is blank' END, CASE WHEN new_version = '' THEN 'version is blank' END,
    CASE WHEN given_provider IS NOT NULL AND new_url <> '' AND given_provider <> url_provider THEN 'provider conflicts with url' END) AS early,
  concat_ws(', ', CASE WHEN changes_url AND has_remote THEN 'url cannot be replaced' END,
    CASE WHEN effective <> old_provider AND old_provider <> 'other' AND NOT force THEN 'provider is set' END,
    CASE WHEN new_version <> old_version AND old_version <> 'unknown' AND NOT force THEN 'version is set' END) AS late FROM cur),
sound AS (SELECT * FROM err WHERE found = 'found' AND early = '' AND late = ''),
taken_url AS (SELECT r.request_id, arg_max(d.dataset_id, (d.created_at, d.dataset_id)) AS owner_id FROM (SELECT * FROM err WHERE found = 'found' AND early = '') r JOIN keys k ON k.key = 'ref|' || r.new_url JOIN datasets d ON d.dataset_id = k.dataset_id
  WHERE r.changes_url AND NOT r.has_remote AND d.dataset_id <> r.dataset_id GROUP BY 1),
listed AS (SELECT request_id, dataset_id, CAST(generate_subscripts(al, 1) - 1 AS INT) AS pos, unnest(al) AS alias FROM sound),
{alias_hits('per_alias', 'listed')},
hit AS (SELECT request_id, arg_min(owner_id, pos) AS owner_id FROM per_alias WHERE owner_id <> dataset_id GROUP BY 1),
free AS (SELECT *, row_number() OVER (ORDER BY request_id) AS n, list_transform(keys, lambda k: dataset_id || chr(31) || k) AS held FROM (
  SELECT request_id, dataset_id, list_concat(list_concat(list_transform(al, lambda v: 'name|' || lower(v)), list_transform(al, lambda v: 'value|' || v)), CASE WHEN changes_url THEN ['value|' || new_url] ELSE [] END) AS keys,
    row_number() OVER (PARTITION BY dataset_id ORDER BY request_id) AS turn FROM sound WHERE request_id NOT IN (SELECT request_id FROM taken_url) AND request_id NOT IN (SELECT request_id FROM hit)) u WHERE turn = 1),
{WALK_ALIASES}
SELECT e.request_id, e.dataset_id, CASE WHEN early <> '' THEN 'invalid' WHEN found <> 'found' THEN found WHEN changes_url AND has_remote THEN 'rejected' WHEN t.owner_id IS NOT NULL THEN 'conflict' WHEN late <> '' THEN 'rejected' WHEN h.owner_id IS NOT NULL OR NOT w.ok THEN 'conflict' WHEN w.ok THEN 'accepted' ELSE 'deferred' END AS outcome,
  concat_ws(', ', nullif(early, ''), nullif(late, '')) AS errors, coalesce(t.owner_id, h.owner_id) AS owner_id
FROM err e LEFT JOIN taken_url t USING (request_id) LEFT JOIN hit h USING (request_id) LEFT JOIN walk w USING (request_id)""")

oracle("storage_transitions", f"""WITH judged AS (SELECT r.request_id, r.dataset_id, r.mode, d.name, d.version, CASE WHEN r.mode NOT IN ('move', 'copy') THEN 'invalid' WHEN d.dataset_id IS NULL THEN 'not found' WHEN d.storage_mode <> 'reference' THEN 'conflict'
  WHEN d.storage_path IS NULL OR NOT r.path_is_dir THEN 'invalid' WHEN r.destination_exists THEN 'conflict' END AS problem FROM transition_requests r LEFT JOIN datasets d USING (dataset_id)),
turns AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, problem IS NULL ORDER BY request_id) AS turn FROM judged)
SELECT request_id, dataset_id, mode, coalesce(problem, CASE WHEN turn = 1 THEN 'ok' ELSE 'conflict' END) AS outcome,
  CASE WHEN problem IS NULL AND turn = 1 THEN '/registry/datasets/' || {slug('name')} || '-' || {slug('version')} || '-' || dataset_id END AS new_path FROM turns""")

MOVED = f"""judged AS (SELECT r.request_id, r.mode, d.*, CASE WHEN r.mode NOT IN ('move', 'copy') OR d.dataset_id IS NULL OR d.storage_mode <> 'reference' OR d.storage_path IS NULL OR NOT r.path_is_dir OR r.destination_exists THEN 1 END AS problem
  FROM transition_requests r LEFT JOIN datasets d USING (dataset_id)),
moved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY request_id) AS turn FROM judged WHERE problem IS NULL) t WHERE turn = 1)"""
oracle("moved_datasets", f"""WITH {MOVED}, {SIZES}
SELECT m.dataset_id, name, provider, source_url, version, array_to_string(modalities, ',') AS modalities, coalesce(s.total_bytes, 0) AS size_bytes, true AS size_bytes_known, status,
  '/registry/datasets/' || {slug('name')} || '-' || {slug('version')} || '-' || m.dataset_id AS storage_path, mode AS storage_mode, CAST(epoch(created_at) AS BIGINT) AS created_at
FROM moved m LEFT JOIN sizes s ON s.dataset_id = m.dataset_id""")
oracle("transition_jobs", f"WITH {MOVED} SELECT 'job-' || request_id AS job_id, dataset_id, 'succeeded' AS status, 'storage-transition-' || mode AS mode FROM moved")

oracle("ingest_audit", "SELECT mode, status, count(*) AS jobs, CAST(epoch(min(created_at)) AS BIGINT) AS first_at, CAST(epoch(max(created_at)) AS BIGINT) AS last_at FROM ingestion_jobs GROUP BY 1, 2")

# -- Health -----------------------------------------------------------------------------------


def checked_health(with_repairs: bool, evidence: bool = False) -> str:
    """SQL of the deep check; ``evidence`` takes the state after repairs from the later inventory, and knows the roots."""
    joins = "LEFT JOIN repairs r ON r.dataset_id = d.dataset_id" if with_repairs else ""
    repair = (
        "CASE WHEN verdict0 <> 'incomplete' THEN NULL WHEN NOT r_tool THEN 'no repair tool' WHEN exit_code <> 0 OR repair_error IS NOT NULL THEN 'repair failed' WHEN recheck_error IS NOT NULL THEN 'recheck failed' WHEN missing_after > 0 THEN 'still missing' ELSE 'repaired' END"
        if with_repairs else "CAST(NULL AS VARCHAR)"
    )
    extra = "r.tool_present AS r_tool, r.exit_code, r.error AS repair_error, r.missing_after, r.recheck_error" if with_repairs else "CAST(NULL AS VARCHAR) AS repair_error, CAST(NULL AS VARCHAR) AS recheck_error"
    missing_after, remaining, root, after = "r.missing_after", "''", "m.entries IS NOT NULL", ""
    if evidence:
        missing_after, remaining, root = "coalesce(y.missing, 0)", "coalesce(': ' || y.examples, '')", "coalesce(o.is_directory, m.entries IS NOT NULL)"
        after = f", {MISSING_SUMMARY.replace('missing_summary', 'after_summary').replace('first_five', 'after_five').replace('missing AS', 'missing_later AS').replace('FROM missing)', 'FROM missing_later)').replace('file_inventory', 'file_inventory_after')}"
        joins += " LEFT JOIN after_summary y ON y.dataset_id = d.dataset_id LEFT JOIN storage_roots o ON o.dataset_id = d.dataset_id"
    extra = extra.replace("r.missing_after", f"{missing_after} AS missing_after") + f", {remaining} AS remaining"
    return f"""{MISSING_SUMMARY}{after}, {SIZES}, {MARKERS},
facts AS (SELECT d.*, m.entries, m.has_payload, m.is_checkout, s.total_bytes, x.missing, 'Annexed content is not present locally: ' || x.examples AS mm, coalesce(i.tool_present, true) AS tool, i.error, i.size_error, {extra},
  CASE WHEN d.storage_path IS NULL THEN 'Dataset has no registered storage path.' WHEN NOT {root} THEN 'Dataset path does not exist or is not a directory: ' || d.storage_path WHEN NOT coalesce(m.has_payload, false) THEN 'Dataset directory has no non-hidden payload files: ' || d.storage_path END AS gone
  FROM datasets d LEFT JOIN markers m USING (dataset_id) LEFT JOIN sizes s USING (dataset_id) LEFT JOIN missing_summary x USING (dataset_id) LEFT JOIN annex_inspections i USING (dataset_id) {joins}),
verdicts AS (SELECT *, CASE WHEN gone IS NOT NULL THEN 'missing' WHEN NOT is_checkout THEN 'plain' WHEN NOT tool THEN 'no tool' WHEN error IS NOT NULL THEN 'uninspected' WHEN missing IS NULL THEN 'complete' ELSE 'incomplete' END AS verdict0 FROM facts),
repaired AS (SELECT *, {repair} AS repair FROM verdicts),
sound AS (SELECT *, verdict0 IN ('plain', 'complete') OR coalesce(repair = 'repaired', false) AS fine FROM repaired),
checks AS (SELECT dataset_id, status AS previous_status, name, storage_path,
  CASE WHEN fine AND size_error IS NOT NULL THEN 'error' WHEN fine THEN 'healthy' WHEN verdict0 = 'missing' THEN 'missing' WHEN verdict0 IN ('no tool', 'uninspected') THEN 'error' ELSE 'broken' END AS result,
  CASE WHEN fine AND size_error IS NOT NULL THEN CASE WHEN verdict0 = 'incomplete' THEN 'broken' ELSE status END WHEN verdict0 = 'plain' THEN CASE WHEN status IN ('missing', 'broken') THEN 'available' ELSE status END
    WHEN fine THEN 'available' WHEN verdict0 = 'missing' THEN 'missing' WHEN verdict0 = 'incomplete' THEN 'broken' ELSE status END AS resulting_status,
  CASE WHEN fine AND size_error IS NULL THEN coalesce(total_bytes, 0) ELSE size_bytes END AS size_bytes, CASE WHEN fine AND size_error IS NULL THEN true ELSE size_bytes_known END AS size_bytes_known,
  CASE WHEN verdict0 = 'missing' THEN gone WHEN fine AND size_error IS NOT NULL THEN 'Dataset size calculation failed: ' || size_error WHEN verdict0 = 'plain' THEN 'Dataset path contains payload files.'
    WHEN verdict0 = 'no tool' THEN 'Health check could not run because git-annex is missing.' WHEN verdict0 = 'uninspected' THEN 'Annex availability could not be determined: git-annex availability check failed: ' || error
    WHEN verdict0 = 'complete' THEN 'git-annex reports all annexed content is present locally.' WHEN repair = 'repaired' THEN 'DataLad repaired all locally missing annexed content.'
    WHEN repair = 'no repair tool' THEN mm || '; DataLad repair could not start: datalad is missing.' WHEN repair = 'repair failed' THEN mm || '; DataLad retrieval failed: ' || coalesce(repair_error, '')
    WHEN repair = 'recheck failed' THEN mm || '; post-repair annex availability could not be determined: ' || recheck_error WHEN repair = 'still missing' THEN mm || '; annexed content is still absent after repair' || remaining ELSE mm END AS message,
  coalesce(repair <> 'no repair tool', false) AS repair_attempted, CASE WHEN repair <> 'no repair tool' THEN repair = 'repaired' END AS repair_succeeded FROM sound)"""


CHECK_COLUMNS = "dataset_id, previous_status, result, resulting_status, size_bytes, size_bytes_known, message, repair_attempted, repair_succeeded, result IN ('missing', 'broken', 'error') AS log_problem"
oracle("health_check", f"WITH {checked_health(False)} SELECT {CHECK_COLUMNS} FROM checks")
oracle("repair_outcomes", f"WITH {checked_health(True)} SELECT {CHECK_COLUMNS} FROM checks WHERE repair_attempted OR contains(message, 'repair could not start')")
oracle("apply_health", f"WITH {checked_health(True)} SELECT dataset_id, resulting_status AS status, size_bytes, size_bytes_known, storage_path FROM checks")
oracle("health_history", f"""WITH {checked_health(True)} SELECT 'run1-' || dataset_id AS check_id, dataset_id, result, previous_status, resulting_status, message, repair_attempted, repair_succeeded,
  CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) AS started_at, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) AS completed_at FROM checks""")
oracle("problem_log_sink", f"""WITH {checked_health(True)} SELECT dataset_id, 'run1-' || dataset_id AS health_check_id, message, name, result, storage_path, '2024-01-31T00:00:00Z' AS timestamp
FROM checks WHERE result IN ('missing', 'broken', 'error')""")

oracle("repair_evidence", f"WITH {checked_health(True, evidence=True)} SELECT {CHECK_COLUMNS} FROM checks")

oracle("inventory_changes", """WITH facts AS (SELECT dataset_id, relative_path, kind, target_kind, size, is_dangling, content_present, checksum FROM file_inventory),
later AS (SELECT dataset_id, relative_path, kind, target_kind, size, is_dangling, content_present, checksum FROM file_inventory_after),
old AS (SELECT dataset_id, relative_path, list_sort(list(CAST(row(kind, target_kind, size, is_dangling, content_present, checksum) AS VARCHAR))) AS held FROM facts GROUP BY 1, 2),
new AS (SELECT dataset_id, relative_path, list_sort(list(CAST(row(kind, target_kind, size, is_dangling, content_present, checksum) AS VARCHAR))) AS held FROM later GROUP BY 1, 2)
SELECT coalesce(o.dataset_id, n.dataset_id) AS dataset_id, coalesce(o.relative_path, n.relative_path) AS relative_path,
  CASE WHEN o.held IS NULL THEN 'added' WHEN n.held IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.dataset_id = n.dataset_id AND o.relative_path = n.relative_path WHERE o.held IS DISTINCT FROM n.held""")

oracle("quick_check_roots", f"""WITH {MARKERS}, facts AS (SELECT d.*, m.is_checkout, (SELECT count(*) FROM repairs r WHERE r.dataset_id = d.dataset_id AND r.exit_code <> 0) > 0 AS busy,
  CASE WHEN d.storage_path IS NULL THEN 'Dataset has no registered storage path.' WHEN NOT o.is_directory THEN 'Dataset path does not exist or is not a directory: ' || d.storage_path WHEN NOT coalesce(m.has_payload, false) THEN 'Dataset directory has no non-hidden payload files: ' || d.storage_path END AS gone
  FROM datasets d LEFT JOIN markers m USING (dataset_id) JOIN storage_roots o USING (dataset_id))
SELECT dataset_id, CASE WHEN gone IS NOT NULL THEN 'missing' WHEN NOT is_checkout THEN 'healthy' WHEN busy THEN 'skipped' ELSE 'running' END AS result,
  CASE WHEN gone IS NOT NULL THEN 'missing' WHEN NOT is_checkout AND status IN ('missing', 'broken') THEN 'available' ELSE status END AS status,
  coalesce(gone, CASE WHEN is_checkout AND status IN ('missing', 'broken') THEN 'Dataset is unavailable; DataLad verification and repair are in process. Please try again later.' END) AS warning FROM facts""")

oracle("quick_check_flags", f"""WITH {MARKERS}, facts AS (SELECT d.*, m.is_checkout, (SELECT count(*) FROM repairs r WHERE r.dataset_id = d.dataset_id AND r.exit_code <> 0) > 0 AS busy,
  CASE WHEN d.storage_path IS NULL THEN 'Dataset has no registered storage path.' WHEN m.entries IS NULL THEN 'Dataset path does not exist or is not a directory: ' || d.storage_path WHEN NOT m.has_payload THEN 'Dataset directory has no non-hidden payload files: ' || d.storage_path END AS gone
  FROM datasets d LEFT JOIN markers m USING (dataset_id))
SELECT dataset_id, CASE WHEN gone IS NOT NULL THEN 'missing' WHEN NOT is_checkout THEN 'healthy' WHEN busy THEN 'skipped' ELSE 'running' END AS result,
  CASE WHEN gone IS NOT NULL THEN 'missing' WHEN NOT is_checkout AND status IN ('missing', 'broken') THEN 'available' ELSE status END AS status,
  coalesce(gone, CASE WHEN is_checkout AND status IN ('missing', 'broken') THEN 'Dataset is unavailable; DataLad verification and repair are in process. Please try again later.' END) AS warning,
  gone IS NULL AND is_checkout AND status IN ('missing', 'broken') AS repair_in_progress, gone IS NULL AND is_checkout AS needs_verification FROM facts""")

# -- Streams: the SQL of their batch twins ----------------------------------------------------

oracle("stream_redacted_logs", f"""WITH {PARSED},
fields AS (SELECT source, line_no, {FIELD_KEY} AS k, {FIELD_VALUE} AS raw FROM (SELECT source, line_no, unnest(pairs) AS p FROM parsed WHERE event IS NOT NULL) u),
clean AS (SELECT source, line_no, k, CASE WHEN lower(k) IN ({quoted(vocab.SENSITIVE_FIELDS)}) THEN '<redacted>' ELSE {cleaned('m')} END AS v FROM (SELECT source, line_no, k, {masked('raw')} AS m FROM fields) t),
joined AS (SELECT source, line_no, string_agg(k || '=' || v, ' ' ORDER BY k) AS content FROM clean GROUP BY 1, 2)
SELECT p.source, p.line_no, p.ts_text, p.level, p.event, CASE WHEN p.event IS NULL THEN {cleaned('lm')} ELSE coalesce(j.content, '') END AS content
FROM (SELECT *, {masked('line')} AS lm FROM parsed) p LEFT JOIN joined j USING (source, line_no)""")

oracle("stream_problem_alerts", "SELECT check_id, dataset_id, message, result FROM health_history WHERE result IN ('missing', 'broken', 'error')")
oracle("stream_latest_status", f"WITH {LATEST} SELECT dataset_id, check_id, result, resulting_status FROM latest")
