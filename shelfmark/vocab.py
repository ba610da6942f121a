"""Fixed values of the catalog: vocabularies, markers, limits and patterns.

The spellings are part of the data contract, so they are stated here as they are.
"""

# Vocabularies.
PROVIDERS = [
    "openneuro", "osf", "zenodo", "dandi", "physionet", "kaggle",
    "neurovault", "nemar", "synapse", "other", "local",
]
DATASET_STATUSES = ["ingesting", "available", "missing", "broken", "quarantined", "deprecated"]
HIDDEN_STATUSES = ["missing", "broken"]
JOB_STATUSES = ["pending", "running", "succeeded", "failed"]
STORAGE_MODES = ["reference", "move", "copy"]
MODALITIES = ["eeg", "meg", "ieeg", "fmri", "fnris", "pet", "smri", "dmri", "ephys", "other"]
NAME_KINDS = ["name", "name_alias"]
LOCATION_KINDS = ["url", "path"]
PROBLEM_RESULTS = ["missing", "broken", "error"]

# Domain suffix of a source host and the provider it stands for.
PROVIDER_DOMAINS = {
    "openneuro.org": "openneuro",
    "dandiarchive.org": "dandi",
    "nemar.org": "nemar",
    "physionet.org": "physionet",
    "kaggle.com": "kaggle",
    "neurovault.org": "neurovault",
    "synapse.org": "synapse",
}

# HTTP status classes of a failed transfer.
TERMINAL_HTTP_STATUSES = [400, 401, 403, 404, 405, 407, 410]
NETWORK_HTTP_STATUSES = [408, 425]
RATE_LIMIT_HTTP_STATUS = 429

# Error texts that end a transfer at once.
TERMINAL_ERROR_TEXTS = ["invalid proxy url", "proxy authentication required"]

# Error texts that mean the network failed.
NETWORK_ERROR_TEXTS = [
    "bad gateway", "broken pipe", "cas service error", "channel closed", "connection",
    "could not resolve", "dispatch failure", "dns", "early eof", "error decoding response body",
    "error reading a body", "error reading response", "error sending request", "failed to connect",
    "failed to receive", "failed to send", "gateway timeout", "gnutls", "handshake failure",
    "http2 error", "http/2 stream", "hyper error", "incomplete", "network", "peer closed", "proxy",
    "remote end hung up", "request middleware error", "reqwest", "reset by peer", "rpc failed",
    "server disconnected", "service unavailable", "stream", "temporary failure in name resolution",
    "timed out", "timeout", "tls", "transport", "unexpected end of file", "unexpected eof",
]

# Exception type names. A table row has no class hierarchy, so the
# subclasses of each network type are named beside it.
NODE_UNAVAILABLE_TYPES = ["MihomoUnavailableError"]
NETWORK_ERROR_TYPES = [
    "BrokenPipeError", "ConnectionAbortedError", "ConnectionError", "ConnectionRefusedError",
    "ConnectionResetError", "RemoteDisconnected", "EOFError", "IncompleteReadError", "IncompleteRead",
    "TransportError", "TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout",
    "NetworkError", "ReadError", "WriteError", "ConnectError", "CloseError", "ProxyError",
    "UnsupportedProtocol", "ProtocolError", "LocalProtocolError", "RemoteProtocolError",
    "gaierror", "TimeoutError", "SSLError", "SSLZeroReturnError", "SSLWantReadError",
    "SSLWantWriteError", "SSLSyscallError", "SSLEOFError", "SSLCertVerificationError",
    "URLError", "urllib.error.HTTPError", "ContentTooShortError",
    "MaxRetryError", "NewConnectionError", "ReadTimeoutError",
    "DryRunError", "IncompleteSnapshotError",
]
LOCAL_FILE_ERROR_TYPES = ["FileExistsError", "PermissionError"]
TEXT_MATCHED_TRANSPORTS = ["http", "xet", "datalad"]

# Texts in the output of a provider command.
NETWORK_COMMAND_TEXTS = [
    "broken pipe", "connection reset", "curl 5", "could not resolve", "connection timed out",
    "could not resolve host", "failed to connect", "gnutls", "http/2 stream",
    "network is unreachable", "operation timed out", "remote end hung up", "rpc failed",
    "temporary failure in name resolution", "tls", "unexpected disconnect",
]
TERMINAL_COMMAND_TEXTS = [
    "authentication failed", "could not read username", "disk quota exceeded",
    "no space left on device", "permission denied", "repository not found", "unknown option",
]
COMMAND_TEXT_LIMIT = 4000

# Fields whose whole value is secret, and configuration keys that may be logged.
SENSITIVE_FIELDS = ["authorization", "cookie", "password", "secret", "token"]
SAFE_CONFIGURATION_KEYS = [
    "destination", "dry_run", "endpoint", "max_workers", "provider", "proxy_url", "repo",
    "retry_attempts", "retry_base_delay", "retry_max_delay", "storage", "timeout", "transport",
    "version", "xet_adaptive_concurrency", "xet_range_concurrency",
]

# Proxy types that are groups of nodes, not nodes.
GROUP_PROXY_TYPES = ["fallback", "loadbalance", "relay", "selector", "urltest"]

# Limits.
SHORTLIST_SIZE = 3
RANKING_LIFETIME_SECONDS = 6 * 60 * 60
NODE_COOLDOWN_SECONDS = 30 * 60
HEALTH_COOLDOWN_SECONDS = 24 * 60 * 60
RETRY_ATTEMPTS = 8
RETRY_BASE_SECONDS = 5.0
RETRY_CAP_SECONDS = 300.0
LISTING_PAGE_SIZE = 100
THROUGHPUT_SAMPLE_BYTES = 512 * 1024
MIB = 1024 * 1024

# Access bits.
EXECUTE_BITS = 0o111
MANAGED_DIRECTORY_MODE = 0o755
MANAGED_EXECUTABLE_MODE = 0o755
MANAGED_FILE_MODE = 0o644
PUBLIC_DIRECTORY_BITS = 0o005
PUBLIC_FILE_BITS = 0o004

# Checksum algorithms and their hexadecimal digest lengths.
CHECKSUM_HEX_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}

# Texts of health checks, which readers of the history and of problem logs rely on.
NO_STORAGE_PATH = "Dataset has no registered storage path."
NO_DIRECTORY = "Dataset path does not exist or is not a directory: "
NO_PAYLOAD = "Dataset directory has no non-hidden payload files: "
SIZE_FAILED = "Dataset size calculation failed: "
HAS_PAYLOAD = "Dataset path contains payload files."
NO_INSPECTION_TOOL = "Health check could not run because git-annex is missing."
NOT_INSPECTED = "Annex availability could not be determined: git-annex availability check failed: "
CONTENT_PRESENT = "git-annex reports all annexed content is present locally."
CONTENT_MISSING = "Annexed content is not present locally: "
REPAIRED = "DataLad repaired all locally missing annexed content."
NO_REPAIR_TOOL = "; DataLad repair could not start: datalad is missing."
REPAIR_FAILED = "; DataLad retrieval failed: "
RECHECK_FAILED = "; post-repair annex availability could not be determined: "
STILL_ABSENT = "; annexed content is still absent after repair"
VERIFYING = "Dataset is unavailable; DataLad verification and repair are in process. Please try again later."
NO_DIAGNOSTICS = "command produced no diagnostic output"
