"""Catalog tables derived from the driver's tables.

Each catalog table is one SELECT over the given Parquet tables, written once and rendered for
Spark or for the checking engine. The few spellings that differ are on ``Dialect``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shelfmark import vocab
from shelfmark.session import fresh_dir

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
EPOCH = 1704067200


class Dialect:
    """Spellings of one SQL engine."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def table(self, name: str) -> str:
        return "{" + name + "}" if self.spark else name

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def ts(self, seconds: str) -> str:
        return f"timestamp_seconds({seconds})" if self.spark else f"make_timestamp(({seconds}) * 1000000)"

    def as_ts(self, column: str) -> str:
        return f"CAST({column} AS TIMESTAMP)"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def unnest(self, array: str) -> str:
        return f"explode({array})" if self.spark else f"unnest({array})"

    def split_csv(self, text: str) -> str:
        return f"split({text}, ',')" if self.spark else f"string_split({text}, ',')"

    def json_k(self, column: str) -> str:
        pattern = '"k": ([0-9]+)'
        return f"CAST(regexp_extract({column}, '{pattern}', 1) AS BIGINT)"


def pick(index: str, values: list[str | None]) -> str:
    """CASE that takes the value at an integer index."""
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if value is None else chr(39) + value + chr(39)}" for i, value in enumerate(values)
    )
    return f"CASE {index} {arms} END"


def s(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _dataset_url(n: str, lang: str) -> str:
    return f"""CASE WHEN {n} % 37 = 0 THEN NULL ELSE CASE {n} % 12
      WHEN 0 THEN 'https://openneuro.org/datasets/ds' || lpad({s(n)}, 6, '0') || '/versions/1.0.' || {s(f'{n} % 4')}
      WHEN 1 THEN 'https://osf.io/' || lpad({s(f'{n} % 100000')}, 5, 'a') || '/files/osfstorage'
      WHEN 2 THEN 'https://zenodo.org/records/' || {s(n)}
      WHEN 3 THEN 'https://www.physionet.org/content/set' || {s(n)} || '/1.' || {s(f'{n} % 5')} || '/'
      WHEN 4 THEN 'https://doi.org/10.5281/zenodo.' || {s(n)}
      WHEN 5 THEN 'file:///data/sets/' || {s(n)}
      WHEN 6 THEN 'https://data.example.org/' || {lang} || '/' || {s(n)}
      WHEN 7 THEN 'HTTPS://API.OSF.IO/v2/nodes/N' || {s(n)} || '/'
      WHEN 8 THEN 'https://zenodo.org:443/records/' || {s(n)}
      WHEN 9 THEN 'https://host' || {s(f'{n} % 7')} || '.example.net:99999/x/' || {s(n)}
      WHEN 10 THEN 'https://user:pw@neurovault.org/collections/' || {s(n)} || '/?page=2#top'
      ELSE 'https://nemar.org' END END"""


def _name(alias: str = "") -> str:
    return f"{alias}source || '_' || {alias}lang || '-' || {s(alias + 'doc_id')}"


def datasets(d: Dialect) -> str:
    return f"""SELECT 'ds-' || {s('doc_id')} AS dataset_id, {_name()} AS name,
      {pick('doc_id % 11', vocab.PROVIDERS)} AS provider,
      {_dataset_url('doc_id', 'lang')} AS source_url,
      CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE {s('1 + doc_id % 3')} || '.0.0' END AS version,
      {d.split_csv(pick('doc_id % 9', ['eeg', 'meg', 'ieeg', 'fmri,smri', 'fnris', 'pet', 'dmri,fmri', 'ephys', 'eeg,meg']))} AS modalities,
      CAST(n_chars AS BIGINT) * 37 AS size_bytes, doc_id % 11 <> 0 AS size_bytes_known,
      {pick('doc_id % 7', ['available', 'available', 'missing', 'broken', 'quarantined', 'deprecated', 'ingesting'])} AS status,
      CASE WHEN doc_id % 13 = 0 THEN NULL ELSE '/registry/datasets/' || {s('doc_id')} END AS storage_path,
      {pick('doc_id % 3', vocab.STORAGE_MODES)} AS storage_mode,
      {d.ts(f'{EPOCH} + doc_id * 60')} AS created_at
    FROM {d.table('documents')}"""


def dataset_aliases(d: Dialect) -> str:
    docs, labels = d.table("documents"), d.table("labels")
    url = _dataset_url("doc_id", "lang")
    return f"""SELECT 'ds-' || {s('doc_id')} AS dataset_id, 'name' AS kind, {_name()} AS value FROM {docs}
    UNION ALL
    SELECT 'ds-' || {s('doc_id')}, CASE WHEN doc_id % 12 = 5 THEN 'path' ELSE 'url' END, {url}
      FROM {docs} WHERE doc_id % 37 <> 0 AND doc_id % 12 <> 11
    UNION ALL
    SELECT 'ds-' || {s('doc_id')}, 'path', 'file:///mirror/' || {s('doc_id')} FROM {docs} WHERE doc_id % 10 = 3
    UNION ALL
    SELECT 'ds-' || {s('b.doc_id')}, 'name_alias', 'Study ' || d.lang || ' ' || {s('b.doc_id')}
      FROM {labels} b JOIN {docs} d ON b.doc_id = d.doc_id
    UNION ALL
    SELECT 'ds-' || {s('b.doc_id')}, 'name_alias', d.source || ' Corpus ' || {s('b.doc_id')}
      FROM {labels} b JOIN {docs} d ON b.doc_id = d.doc_id WHERE b.quality = 1
    UNION ALL
    SELECT 'ds-' || {s('b.doc_id')}, 'name_alias', d.lang || ' Shared ' || {s('b.doc_id % 50')}
      FROM {labels} b JOIN {docs} d ON b.doc_id = d.doc_id WHERE b.toxic = 1
    UNION ALL
    SELECT 'ds-' || {s('b.doc_id')}, 'url', 'https://mirror.example.org/' || d.source || '/' || {s('b.doc_id')}
      FROM {labels} b JOIN {docs} d ON b.doc_id = d.doc_id WHERE b.toxic = 1"""


def source_urls(d: Dialect) -> str:
    return f"""SELECT 'p-' || {s('page_id')} AS request_id, url,
      {pick('page_id % 4', [None, None, ' 2.1 ', ' '])} AS requested_version FROM {d.table('pages')}
    UNION ALL
    SELECT 'd-' || {s('doc_id')}, {_dataset_url('doc_id', 'lang')}, {pick('doc_id % 5', [None, None, None, ' 3.0', ''])}
      FROM {d.table('documents')}
    UNION ALL
    SELECT 'o-' || {s('o_orderkey')}, CASE o_orderkey % 11
      WHEN 0 THEN 'https://openneuro.org/datasets/ds' || lpad({s('o_custkey')}, 6, '0')
      WHEN 1 THEN 'https://openneuro.org/datasets/dsABC/versions/bad'
      WHEN 2 THEN 'https://sandbox.zenodo.org/records/' || {s('o_custkey')} || '/files'
      WHEN 3 THEN 'https://osf.io/'
      WHEN 4 THEN 'AG' || {s('o_custkey')}
      WHEN 5 THEN 'ds' || {s('o_custkey')}
      WHEN 6 THEN {s('o_custkey')}
      WHEN 7 THEN 'ftp://osf.io/abcde'
      WHEN 8 THEN 'https://zenodo.org/communities/x/' || {s('o_custkey')}
      WHEN 9 THEN 'https://www.osf.io/' || lpad({s('o_custkey')}, 5, 'B') || '/'
      ELSE 'file:///data/sets/' || {s(d.div('o_orderkey', 15))} END, NULL
      FROM {d.table('orders')}"""


def identifier_requests(d: Dialect) -> str:
    m = d.div("o.o_orderkey", 12)
    return f"""SELECT 'r-' || {s('o.o_orderkey')} AS request_id,
      CASE o.o_orderkey % 8 WHEN 0 THEN 'ds-' || {s(m)} WHEN 1 THEN upper({_name('t.')})
        WHEN 4 THEN {_dataset_url('t.doc_id', 't.lang')} || '?x=1' WHEN 5 THEN 'file:///mirror/' || {s(m)}
        WHEN 6 THEN 'ds-' || {s(m)} END AS identifier,
      CASE o.o_orderkey % 8 WHEN 2 THEN upper({_name('t.')}) WHEN 6 THEN 'both' WHEN 7 THEN t.lang || ' SHARED ' || {s('t.doc_id % 50')} END AS name,
      CASE o.o_orderkey % 8 WHEN 3 THEN {_dataset_url('t.doc_id', 't.lang')} END AS url
    FROM {d.table('orders')} o LEFT JOIN {d.table('documents')} t ON t.doc_id = {m}"""


def needles(d: Dialect) -> str:
    return f"""SELECT 'q-' || {s('c_custkey')} AS request_id, CASE c_custkey % 6
      WHEN 0 THEN {pick('c_custkey % 4', ['en', 'fr', 'de', 'es'])} || '-' || {s('c_custkey % 1000')}
      WHEN 1 THEN 'SRC' || {s('c_custkey % 20')} || '_'
      WHEN 2 THEN 'study ' || {pick('c_custkey % 4', ['en', 'fr', 'de', 'es'])} || ' ' || {s('c_custkey % 500')}
      WHEN 3 THEN {s('c_custkey % 100')}
      WHEN 4 THEN 'corpus%' || {s('c_custkey % 300')}
      ELSE 'absent ' || {s('c_custkey')} END AS needle
    FROM {d.table('customer')}"""


def intake_requests(d: Dialect) -> str:
    n = d.div("o.c_custkey", 2)
    k = "o.c_custkey"
    return f"""SELECT 'i-' || lpad({s(k)}, 12, '0') AS request_id,
      '/incoming/' || {s(k)} AS source,
      CASE WHEN {k} % 29 = 0 THEN '  ' WHEN {k} % 5 = 0 THEN 'new_' || {s(f'{k} % 400')}
        WHEN {k} % 7 = 0 THEN upper(t.source || '_' || t.lang || '-' || {s('t.doc_id')}) ELSE ' Set ' || {s(k)} END AS name,
      {pick(f'{k} % 4', ['other', 'local', 'openneuro', 'zenodo'])} AS provider,
      CASE {k} % 6 WHEN 0 THEN 'https://openneuro.org/datasets/ds' || {s(f'{k} % 3000')} || '/versions/2.0.0'
        WHEN 1 THEN {_dataset_url('t.doc_id', 't.lang')} WHEN 2 THEN 'https://zenodo.org/records/' || {s(f'{k} + 100000')} END AS url,
      {pick(f'{k} % 5', [None, '1.0', None, ' 2.0 ', '3.1'])} AS version,
      {d.split_csv(pick(f'{k} % 7', ['EEG', 'meg, eeg', 'bogus', 'fmri', 'pet,PET', 'ieeg', 'smri']))} AS modalities,
      {pick(f'{k} % 3', vocab.STORAGE_MODES)} AS storage_mode,
      {d.split_csv(f"CASE {k} % 9 WHEN 0 THEN 'Alt ' || {s(f'{k} % 700')} || ',alt ' || {s(f'{k} % 700')} WHEN 1 THEN 'Study ' || t.lang || ' ' || {s('t.doc_id')} WHEN 2 THEN 'a ' || {s(k)} || ', b ' || {s(k)} ELSE 'Own ' || {s(k)} END")} AS aliases,
      CASE WHEN {k} % 8 = 0 THEN NULL WHEN {k} % 41 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST({k} * 100 AS BIGINT) END AS size_bytes,
      {k} % 31 <> 0 AS source_is_dir,
      {d.ts(f'{EPOCH} + 86400 * 30 + ({k} * 7919) % 100000')} AS requested_at
    FROM {d.table('customer')} o JOIN {d.table('documents')} t ON t.doc_id = {n}"""


def alias_requests(d: Dialect) -> str:
    return f"""SELECT 'a-' || {s('doc_id')} AS request_id,
      CASE WHEN doc_id % 9 = 0 THEN 'nobody' WHEN doc_id % 2 = 0 THEN 'ds-' || {s('doc_id')} ELSE {_name()} END AS identifier,
      {d.split_csv(f"CASE doc_id % 5 WHEN 0 THEN ' New ' || {s('doc_id')} || ',new ' || {s('doc_id')} || ',Extra ' || {s('doc_id')} WHEN 1 THEN 'study ' || lang || ' ' || {s('doc_id')} WHEN 2 THEN 'ds-' || {s('doc_id + 1')} WHEN 3 THEN 'x, ' ELSE {_name()} || ',Other ' || {s('doc_id % 40')} END")} AS aliases
    FROM {d.table('documents')}"""


def update_requests(d: Dialect) -> str:
    return f"""SELECT 'u-' || {s('doc_id')} AS request_id,
      CASE WHEN doc_id % 17 = 0 THEN 'nobody' ELSE 'ds-' || {s('doc_id')} END AS identifier,
      CASE doc_id % 6 WHEN 0 THEN 'https://openneuro.org/datasets/ds9' || {s('doc_id')} WHEN 1 THEN {_dataset_url('doc_id', 'lang')}
        WHEN 2 THEN {_dataset_url('doc_id + 4', 'lang')} WHEN 3 THEN ' ' END AS url,
      {pick('doc_id % 7', [None, 'openneuro', None, 'zenodo', None, 'other', None])} AS provider,
      {pick('doc_id % 8', [None, '1.0.0', None, '9.9', None, ' ', None, '2.0.0'])} AS version,
      {d.split_csv(pick('doc_id % 4', ['meg,EEG,meg', '', 'bogus', '']))} AS modality_names,
      {d.split_csv(f"CASE doc_id % 5 WHEN 0 THEN 'Updated ' || {s('doc_id')} || ',updated ' || {s('doc_id')} WHEN 1 THEN 'Study ' || lang || ' ' || {s('doc_id')} ELSE '' END")} AS alias_names,
      doc_id % 3 = 0 AS force
    FROM {d.table('documents')}"""


def transition_requests(d: Dialect) -> str:
    return f"""SELECT 't-' || {s('doc_id')} AS request_id,
      CASE WHEN doc_id % 19 = 0 THEN 'ds-x' || {s('doc_id')} ELSE 'ds-' || {s('doc_id')} END AS dataset_id,
      {pick('doc_id % 4', ['move', 'copy', 'reference', 'copy'])} AS mode,
      doc_id % 23 <> 0 AS path_is_dir, doc_id % 29 = 0 AS destination_exists
    FROM {d.table('documents')}"""


def ingestion_jobs(d: Dialect) -> str:
    return f"""SELECT 'job-' || {s('o_orderkey')} AS job_id, 'ds-' || {s('o_custkey')} AS dataset_id,
      {pick('o_orderkey % 5', ['succeeded', 'succeeded', 'failed', 'running', 'pending'])} AS status,
      {pick('o_orderkey % 3', ['local', 'storage-transition-move', 'storage-transition-copy'])} AS mode,
      o_orderpriority AS message, {d.as_ts('o_orderdate')} AS created_at
    FROM {d.table('orders')}"""


def health_history(d: Dialect) -> str:
    return f"""SELECT 'c-' || lpad({s('event_id')}, 12, '0') AS check_id, 'ds-' || {s('user_id * 7')} AS dataset_id,
      CASE event_type WHEN 'view' THEN 'healthy' WHEN 'click' THEN 'missing' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'broken' ELSE 'skipped' END AS result,
      'available' AS previous_status,
      CASE event_type WHEN 'click' THEN 'missing' WHEN 'purchase' THEN 'broken' ELSE 'available' END AS resulting_status,
      props AS message, event_id % 2 = 0 AS repair_attempted,
      CASE WHEN event_id % 2 = 0 THEN event_id % 4 = 0 END AS repair_succeeded,
      {d.as_ts('ts')} AS started_at, {d.as_ts('ts')} AS completed_at
    FROM {d.table('events')}"""


def environment_runs(d: Dialect) -> str:
    return f"SELECT 'env-' || {s('user_id')} AS environment, {d.as_ts('ts')} AS ts FROM {d.table('events')}"


def file_inventory(d: Dialect) -> str:
    return f"""SELECT 'ds-' || {s('dsno')} AS dataset_id,
      CASE WHEN dsno % 17 = 0 THEN '.git/annex/objects/' ELSE '' END ||
      CASE k WHEN 0 THEN CASE WHEN dsno % 5 IN (1, 2) THEN 'sub-0/' ELSE '.git/annex/objects/' END || 'k' || {s('ino')} || '.bin'
        WHEN 1 THEN CASE WHEN dsno % 5 IN (1, 3) THEN 'sub-1/' ELSE '.datalad/' END || 'config-' || {s('ino')}
        WHEN 2 THEN 'sub-' || {s('ino')} WHEN 3 THEN 'sub-3/link-' || {s('ino')} || '.dat'
        WHEN 4 THEN 'sub-3/gone-' || {s('ino')} || '.dat' WHEN 5 THEN 'sub-3/dirlink-' || {s('ino')}
        WHEN 6 THEN 'sub-3/pipe-' || {s('ino')} WHEN 7 THEN '.hidden-' || {s('ino')}
        ELSE 'sub-' || {s('ino % 9')} || '/run-' || {s('ino')} || '.bin' END AS relative_path,
      CASE WHEN k = 2 THEN 'dir' WHEN k IN (3, 4, 5) THEN 'symlink' WHEN k = 6 THEN 'special' ELSE 'file' END AS kind,
      CASE WHEN k = 3 THEN 'file' WHEN k = 5 THEN 'dir' END AS target_kind,
      CAST(1 AS BIGINT) AS dev, ino, CAST(floor(l_quantity) AS BIGINT) * 100 AS size,
      {pick('(ino * 3 + k) % 7', ['384', '416', '420', '488', '493', '448', '480']).replace("'", '')} AS mode,
      1000 + l_suppkey % 3 AS uid, k = 4 AS is_dangling,
      k <> 4 AND NOT (k = 3 AND (dsno % 3 = 0) AND l_quantity < 25) AS content_present,
      'md5:' || md5({s('ino')}) AS checksum
    FROM (SELECT {d.div('l_orderkey', 16)} AS dsno, l_orderkey * 8 + l_linenumber AS ino,
            (l_orderkey * 7 + l_linenumber * 3) % 20 AS k, l_quantity, l_suppkey FROM {d.table('lineitem')}) base"""


def file_inventory_after(d: Dialect) -> str:
    """The inventory after repairs: content fetched in three of four datasets, some entries gone."""
    dataset = "CAST(substr(dataset_id, 4) AS BIGINT)"
    return f"""SELECT dataset_id, relative_path, kind, target_kind, dev, ino, size, mode, uid, is_dangling,
      content_present OR ({dataset} % 4 <> 1 AND ({dataset} % 4 = 2 OR ino % 3 = 0)) AS content_present, checksum
    FROM ({file_inventory(d)}) listed WHERE ino % 501 <> 7"""


def storage_roots(d: Dialect) -> str:
    return f"SELECT 'ds-' || {s('doc_id')} AS dataset_id, doc_id % 9 <> 4 AS is_directory FROM {d.table('documents')}"


def annex_inspections(d: Dialect) -> str:
    return f"""SELECT 'ds-' || {s('doc_id')} AS dataset_id, doc_id % 14 <> 0 AS tool_present,
      CASE WHEN doc_id % 10 = 9 THEN 'exit status 128' END AS error, CASE WHEN doc_id % 25 = 7 THEN 'Permission denied' END AS size_error
    FROM {d.table('documents')}"""


def repairs(d: Dialect) -> str:
    return f"""SELECT 'ds-' || {s('doc_id')} AS dataset_id, doc_id % 4 <> 0 AS tool_present,
      CAST(CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS INT) AS exit_code, CASE WHEN doc_id % 5 = 1 THEN 'network down' END AS error,
      CAST(CASE WHEN doc_id % 7 = 2 THEN 3 ELSE 0 END AS BIGINT) AS missing_after,
      CASE WHEN doc_id % 11 = 3 THEN 'exit status 1' END AS recheck_error
    FROM {d.table('documents')}"""


def manifest_files(d: Dialect) -> str:
    return f"""SELECT 'src-' || {s('o_custkey')} AS source_id,
      CASE WHEN o_orderkey % 97 = 1 THEN '../' || {s('o_orderkey')} WHEN o_orderkey % 97 = 2 THEN '//' WHEN o_orderkey % 97 = 3 THEN NULL
        WHEN o_orderkey % 97 = 4 THEN '/a/./b//' || {s('o_orderkey')} || '/' WHEN o_orderkey % 89 = 5 THEN 'dup.bin'
        ELSE o_orderpriority || '/' || {s('o_orderkey')} || '.bin' END AS relative_path,
      CASE WHEN o_orderkey % 101 = 7 THEN CAST(-5 AS BIGINT) WHEN o_orderkey % 101 = 8 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size,
      CASE WHEN o_orderkey % 103 = 9 THEN 'ftp://files.example.org/x' WHEN o_orderkey % 103 = 10 THEN 'https:///x' WHEN o_orderkey % 103 = 11 THEN NULL
        ELSE 'https://files.example.org/' || {s('o_orderkey')} END AS download_url,
      CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 107 = 12 THEN 'md5:abc' WHEN o_orderkey % 107 = 13 THEN 'crc:12' WHEN o_orderkey % 107 = 14 THEN ''
        WHEN o_orderkey % 2 = 0 THEN 'md5:' || upper(md5({s('o_orderkey')})) ELSE 'sha256:' || {'sha2(' + s('o_orderkey') + ', 256)' if d.spark else 'sha256(' + s('o_orderkey') + ')'} END AS checksum
    FROM {d.table('orders')}"""


def local_files(d: Dialect) -> str:
    sha = f"sha2({s('o_orderkey')}, 256)" if d.spark else f"sha256({s('o_orderkey')})"
    path = f"o_orderpriority || '/' || {s('o_orderkey')} || '.bin'"
    return f"""SELECT 'src-' || {s('o_custkey')} AS source_id, {path} AS relative_path,
      {pick('o_orderkey % 13', ['dir'] + ['symlink'] + ['file'] * 11)} AS kind,
      CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS size,
      CASE WHEN o_orderkey % 2 = 0 THEN 'md5:' || md5({s('o_orderkey')}) WHEN o_orderkey % 11 = 1 THEN 'sha256:00' ELSE 'sha256:' || {sha} END AS checksum
    FROM {d.table('orders')} WHERE o_orderkey % 3 = 0
    UNION ALL
    SELECT 'src-' || {s('o_custkey')}, {path} || '.part', {pick('o_orderkey % 9', ['symlink'] + ['file'] * 8)},
      CASE o_orderkey % 5 WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) WHEN 1 THEN CAST(floor(o_totalprice) AS BIGINT) + 9 WHEN 2 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice / 2) AS BIGINT) END,
      CASE WHEN o_orderkey % 15 = 10 THEN 'md5:bad' WHEN o_orderkey % 2 = 0 THEN 'md5:' || md5({s('o_orderkey')}) ELSE 'sha256:' || {sha} END
    FROM {d.table('orders')} WHERE o_orderkey % 4 <> 3"""


ERROR_ARMS = [
    # (type, message, http status, Retry-After) of the outer error by event number modulo the list length
    ("HTTPStatusError", "Client error", 404, None),
    ("HTTPStatusError", "Too many requests", 429, "17"),
    ("HTTPStatusError", "Server error", 503, None),
    ("HTTPStatusError", "Server error", 502, None),
    ("ReadError", "", None, None),
    ("RuntimeError", "Connection RESET by peer", None, None),
    ("FileExistsError", "existing file proxy.bin has 3 bytes", None, None),
    ("RuntimeError", "disk full", None, None),
    ("HTTPStatusError", "Too many requests", 429, "Wed, 21 Oct 2099 07:28:00 GMT"),
    ("MihomoUnavailableError", "all nodes cool down", None, None),
    ("RuntimeError", "407 Proxy Authentication Required", None, None),
    ("HTTPStatusError", "Request timeout", 408, None),
    ("DryRunError", "listing failed", None, None),
    ("HTTPStatusError", "Server error", 500, None),
    ("HTTPStatusError", "Too many requests", 429, "-4"),
    ("HTTPStatusError", "Teapot", 418, None),
    ("HTTPStatusError", "Too many requests", 429, "soon"),
]


def _error_column(position: int, numeric: bool, index: str) -> str:
    def literal(value) -> str:
        if value is None:
            return "NULL"
        return str(value) if numeric else f"'{value}'"

    arms = " ".join(f"WHEN {i} THEN {literal(arm[position])}" for i, arm in enumerate(ERROR_ARMS))
    return f"CASE {index} {arms} END"


def attempts_flat(d: Dialect) -> str:
    index = f"(event_id * 5 + user_id) % {len(ERROR_ARMS)}"
    return f"""SELECT 'op-' || {s(d.div('event_id', 8))} AS operation, CAST(1 + event_id % 8 AS INT) AS attempt, {d.as_ts('ts')} AS ts,
      {pick('event_id % 4', ['http', 'xet', 'datalad', 'git'])} AS transport, CAST(CASE WHEN {d.div('event_id', 8)} % 6 = 0 THEN 0 ELSE 5 + {d.div('event_id', 8)} % 4 END AS INT) AS attempt_limit,
      {_error_column(0, False, index)} AS outer_type, {_error_column(1, False, index)} AS outer_message,
      CAST({_error_column(2, True, index)} AS INT) AS outer_status, {_error_column(3, False, index)} AS outer_retry_after,
      CASE event_type WHEN 'error' THEN 'ConnectionResetError' WHEN 'signup' THEN 'ValueError' WHEN 'purchase' THEN 'PermissionError' END AS inner_type,
      CASE event_type WHEN 'error' THEN 'reset at https://cdn.example/file?token=hidden' WHEN 'signup' THEN 'bad value' WHEN 'purchase' THEN 'shared drive refused' END AS inner_message
    FROM {d.table('events')}"""


def command_outputs(d: Dialect) -> str:
    return f"""SELECT 'cmd-' || {s('event_id')} AS run_id, 'datalad' AS command, CAST(event_id % 5 AS INT) AS exit_code,
      {pick('event_id % 9', ['fatal: unable to access: Could not resolve host github.com', 'error: RPC failed; curl 56 GnuTLS recv error', 'remote: Repository not found.', 'No space left on device while fetching', 'fatal: Authentication failed for https://user:pw@git.example.org/x?token=abc', '  ', 'Connection timed out', 'merge conflict in file', 'fatal: TLS handshake; permission denied'])} || CASE WHEN event_id % 9 = 5 THEN '' ELSE ' #' || props END AS output
    FROM {d.table('events')}"""


def node_probes(d: Dialect) -> str:
    return f"""SELECT 'node-' || {s('user_id % 25')} AS node, CAST(user_id % 25 AS BIGINT) AS node_order,
      CASE WHEN event_id % 5 = 0 THEN 'throughput' WHEN event_id % 5 = 1 THEN 'real_latency' ELSE 'latency' END AS phase,
      event_type <> 'error' AND NOT (user_id % 25 IN (3, 4) AND event_id % 5 = 0) AND NOT (user_id % 25 > 1 AND event_id % 5 > 1) AS ok,
      value, {d.as_ts('ts')} AS ts FROM {d.table('events')}"""


def node_probes_open(d: Dialect) -> str:
    return f"""SELECT 'node-' || {s('user_id % 25')} AS node, CAST(user_id % 25 AS BIGINT) AS node_order,
      CASE WHEN event_id % 3 = 0 THEN 'throughput' ELSE 'latency' END AS phase,
      event_type <> 'error' AND user_id % 25 <> 7 AND NOT (user_id % 25 = 9 AND event_id % 3 = 0) AS ok,
      value, {d.as_ts('ts')} AS ts FROM {d.table('events')}"""


def node_failures(d: Dialect) -> str:
    return f"""SELECT 'node-' || {s('user_id % 25')} AS node, {d.as_ts('ts')} AS failed_at
    FROM {d.table('events')} WHERE event_type = 'error'"""


def proxies(d: Dialect) -> str:
    members = d.array(*[f"CASE WHEN s_suppkey % {m} = 0 THEN 'group-x' ELSE 'node-' || {s(f's_suppkey * 4 + {m}')} || {pick(f's_suppkey % 3', ['', '-cheap', '-cheap'])} END" for m in (2, 3, 5, 7)])
    return f"""SELECT 'group-' || {s('s_suppkey')} AS name, {pick('s_suppkey % 4', ['Selector', 'selector', 'URLTest', 'Selector'])} AS type,
      {members} AS members FROM {d.table('supplier')}
    UNION ALL SELECT 'group-x', 'Fallback', {d.array("'node-1'")}
    UNION ALL SELECT DISTINCT 'node-' || {s('member')} || {pick('s_suppkey % 3', ['', '-cheap', '-cheap'])}, 'Shadowsocks', {d.array("'none'")}
      FROM (SELECT s_suppkey, {d.unnest(d.array(*[f's_suppkey * 4 + {m}' for m in (2, 3, 5, 7)]))} AS member FROM {d.table('supplier')}) m"""


def _member(k: str, pick_m: str) -> str:
    return f"'node-' || {s(f'({k}) * 4 + {pick_m}')} || {pick(f'({k}) % 3', ['', '-cheap', '-cheap'])}"


def group_probes(d: Dialect) -> str:
    m = "CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 7 END"
    phase = "CASE WHEN event_id % 7 = 0 THEN 'real_latency' ELSE 'latency' END"
    return f"""SELECT {_member('1 + user_id % 40', m)} AS node, CAST(0 AS BIGINT) AS node_order, {phase} AS phase,
      event_type <> 'error' AND NOT (user_id % 5 = 1 AND event_id % 7 <> 0) AND user_id % 6 <> 2 AS ok, value, {d.as_ts('ts')} AS ts
    FROM {d.table('events')}"""


def group_failures(d: Dialect) -> str:
    m = "CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 7 END"
    return f"""SELECT {_member('1 + user_id % 40', m)} AS node, {d.as_ts('ts')} AS failed_at
    FROM {d.table('events')} WHERE event_type = 'error' AND user_id % 3 <> 0"""


def sample_chunks(d: Dialect) -> str:
    m = "CASE l_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 7 END"
    return f"""SELECT {_member('1 + l_orderkey % 40', m)} AS node, 'sample-' || {s('l_orderkey')} AS sample_id, CAST(l_linenumber AS BIGINT) AS chunk_no,
      CASE WHEN l_orderkey % 13 = 0 OR l_orderkey % 40 = 8 THEN CAST(0 AS BIGINT) ELSE CAST(floor(l_extendedprice) AS BIGINT) * 8 END AS bytes,
      CAST(l_linenumber AS DOUBLE) * (1 + l_orderkey % 6) AS seconds
    FROM {d.table('lineitem')}"""


def connections(d: Dialect) -> str:
    return f"""SELECT 'k-' || {s('event_id')} AS connection_id, 'w-' || {s(d.div('event_id', 6))} AS discovery_id,
      CASE WHEN event_id % 6 < 2 THEN 'before' ELSE 'after' END AS snapshot,
      CASE WHEN event_id % 6 = 2 THEN 'k-' || {s('event_id - 2')} ELSE 'k-' || {s('event_id')} END AS id,
      CASE event_type WHEN 'view' THEN 'Speed.Example.net' WHEN 'click' THEN 'other.example.net' ELSE '' END AS host,
      CASE WHEN event_type = 'signup' THEN 'speed.example.net' END AS sniff_host,
      CASE WHEN event_type = 'error' THEN '10.0.0.1' END AS destination_ip,
      {d.array("'node-' || " + s('user_id % 40'), "'group-' || " + s('user_id % 100'), "'group-' || " + s('(user_id + 1) % 100'))} AS chains
    FROM {d.table('events')}"""


def log_lines(d: Dialect) -> str:
    n = "event_id"
    return f"""SELECT 'run-' || {s(d.div(n, 10))} || '.log' AS source, CAST({n} AS BIGINT) AS line_no,
      CASE {n} % 10 WHEN 0 THEN '2024-01-01T00:00:' || lpad({s(f'{n} % 60')}, 2, '0') || 'Z INFO download_started provider=osf token=abc' || {s(n)}
        WHEN 9 THEN '2024-01-01T00:09:' || lpad({s(f'{n} % 60')}, 2, '0') || 'Z ' || CASE event_type WHEN 'error' THEN 'ERROR traceback' WHEN 'click' THEN 'INFO download_completed status=success' WHEN 'view' THEN 'INFO download_failed exception=boom exception_type=RuntimeError' ELSE 'INFO download_interrupted signal=SIGINT' END
        WHEN 8 THEN 'RuntimeError: see https://U:p@CDN.example.org/file/' || {s(n)} || '?sig=1#x'
        ELSE CASE {n} % 3 WHEN 0 THEN '2024-01-01T00:0' || {s(f'{n} % 10')} || ':00Z INFO download_attempt_started attempt=' || {s(f'{n} % 10')} || ' operation=file ' || {s(n)} || ' transport=http'
          WHEN 1 THEN '2024-01-01T00:0' || {s(f'{n} % 10')} || ':30Z INFO download_attempt_failed attempt=' || {s(f'{n} % 10')} || ' category=' || {pick('user_id % 3', ['network', 'server', 'rate_limit'])} || ' exception=reset at https://cdn.example/' || {s(n)} || '?token=hidden operation=file retryable=True'
          ELSE '2024-01-01T00:0' || {s(f'{n} % 10')} || ':45Z INFO download_retry_scheduled attempt=' || {s(f'{n} % 10')} || ' category=network delay_seconds=' || {s(f'5 * (1 + {n} % 4)')} || '.5 operation=file rotate_node=False' END END AS line
    FROM {d.table('events')}
    UNION ALL
    SELECT 'ingest-' || {s('doc_id % 50')} || '.log', CAST(doc_id AS BIGINT), '2024-02-01T10:00:00+00:00 ' || CASE doc_id % 3 WHEN 0 THEN 'START provider=' || source || ' version=1.0 source=/in/' || {s('doc_id')}
      WHEN 1 THEN 'SUCCEEDED dataset_id=ds-' || {s('doc_id')} || ' storage_path=/registry/' || {s('doc_id')} ELSE 'FAILED ValueError: bad source' END
    FROM {d.table('documents')}"""


def log_texts(d: Dialect) -> str:
    return f"""SELECT 'doc-' || {s('doc_id')} AS text_id, text || ' Authorization: Bearer k' || {s('doc_id')} || ' at HTTPS://X.org/a?b, https://User:pw@Files.Example.ORG:8080/data/' || {s('doc_id')} || '?api_key=q#frag and (http://h.org:70000/z) password=p' || {s('doc_id')} AS text
    FROM {d.table('documents')}
    UNION ALL SELECT 'conv-' || {s('conv_id')} || '-' || {s('turn')}, role || '_token : ' || text FROM {d.table('conversations')}"""


def workspaces(d: Dialect) -> str:
    return f"""SELECT 'download-openneuro-ds' || {s('o_custkey')} || '-1.0' AS workspace,
      CASE o_orderkey % 4 WHEN 0 THEN '.git/config' WHEN 1 THEN 'data/file-' || {s('o_orderkey')} ELSE NULL END AS relative_path,
      CASE o_orderkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'file' ELSE NULL END AS kind,
      CASE WHEN o_custkey % 3 = 0 THEN '1.0' WHEN o_custkey % 3 = 1 THEN '2.0' END AS exact_tag
    FROM {d.table('orders')} WHERE o_custkey % 2 = 0 AND (o_custkey % 6 <> 2 OR o_orderkey % 4 >= 2)"""


def download_requests(d: Dialect) -> str:
    return f"""SELECT 'dl-' || {s('c_custkey')} AS request_id, 'openneuro' AS provider,
      'https://openneuro.org/datasets/ds' || {s('c_custkey')} AS url, '1.0' AS version FROM {d.table('customer')}"""


def source_paths(d: Dialect) -> str:
    return f"""SELECT 'sp-' || {s('p_partkey')} AS request_id, {pick('p_partkey % 8', ['/registry/incoming', '/registry', '/shared/raw', '/lab', '/home', '/registry/incoming-old', '/shared/raw2', '/registry/datasets'])} || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/' || p_name END AS source,
      p_size % 10 <> 0 AS is_dir FROM {d.table('part')}"""


def stream_chunks(d: Dialect) -> str:
    return f"""SELECT 'sample-' || {s('l_orderkey')} AS sample_id, CAST(l_linenumber AS BIGINT) AS chunk_no,
      CASE WHEN l_orderkey % 13 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(l_extendedprice) AS BIGINT) * 2 END AS bytes,
      CAST(CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE 1 + l_orderkey % 6 END AS DOUBLE) AS seconds
    FROM {d.table('lineitem')}"""


ADAPTERS = {
    function.__name__: function
    for function in (
        datasets, dataset_aliases, source_urls, identifier_requests, needles, intake_requests, alias_requests,
        update_requests, transition_requests, ingestion_jobs, health_history, environment_runs, file_inventory,
        file_inventory_after, storage_roots,
        annex_inspections, repairs, manifest_files, local_files, attempts_flat, command_outputs, node_probes,
        node_probes_open, node_failures, proxies, connections, log_lines, log_texts, workspaces,
        download_requests, source_paths, stream_chunks, group_probes, group_failures, sample_chunks,
    )
}


# Unions of many parts that jobs read several times: registry tables are files, not views.
STORED = {"dataset_aliases"}
_WRITTEN: dict[tuple[str, str, str], str] = {}


class Catalog:
    """Catalog tables of one data folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ADAPTERS:
            raise AttributeError(name)
        if name not in self._built:
            text = ADAPTERS[name](Dialect(spark=True))
            used = {table: self.raw(table) for table in DRIVER_TABLES if "{" + table + "}" in text}
            derived = self.spark.sql(text, **used)
            self._built[name] = self._stored(name, derived) if name in STORED else derived
        return self._built[name]

    def _stored(self, name: str, derived: DataFrame) -> DataFrame:
        """Write a registry table once per application and folder, as a registry would hold it."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            path = fresh_dir(self.spark, name)
            derived.write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.schema(derived.schema).parquet(_WRITTEN[key])

    @cached_property
    def attempts(self) -> DataFrame:
        """Attempts with their error chain as an array, outermost error first."""
        return self.attempts_flat.selectExpr(
            "operation", "attempt", "ts", "transport", "attempt_limit",
            """filter(array(
                 named_struct('type', outer_type, 'message', outer_message, 'http_status', outer_status, 'retry_after', outer_retry_after),
                 named_struct('type', inner_type, 'message', inner_message, 'http_status', cast(null as int), 'retry_after', cast(null as string))
               ), e -> e.type is not null) AS chain""",
        )


def oracle_views(body: str) -> str:
    """Put the adapter views a checking query names in front of it."""
    import re

    needed: list[str] = []
    for name in ADAPTERS:
        if re.search(rf"\b{name}\b", body):
            needed.append(name)
    views = [f"{name} AS ({ADAPTERS[name](Dialect(spark=False))})" for name in needed]
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(views + [stripped[len("WITH RECURSIVE"):].strip()])
    if stripped.upper().startswith("WITH"):
        return "WITH " + ",\n".join(views + [stripped[len("WITH"):].strip()])
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + stripped
