from fleetlens.functions.logtext import (  # noqa: F401
    conninfo_value,
    key_values,
    log_timestamp,
    slow_query_line,
    syslog_line,
)
from fleetlens.functions.numeric import (  # noqa: F401
    ceil_places,
    hit_ratio,
    interval_ms,
    lsn_diff,
    lsn_position,
    ratio4,
    round_up2,
    round_up4,
)
from fleetlens.functions.text import (  # noqa: F401
    clean_query,
    fingerprint,
    is_collector_comment,
    obfuscate_explain,
    obfuscate_query,
    query_comment,
    redact_ip,
    strip_comments,
    truncate_bytes,
    truncate_query,
)
from fleetlens.functions.version import version_compare, version_gt, version_gte  # noqa: F401
