from mlscout.sources.audits import (
    audit_columns,
    audit_dimensions,
    audit_files,
    audit_target,
    check_schema,
    guard_trainable,
)
from mlscout.sources.readers import (
    preview,
    read_stat_files,
    read_table,
    resolve_format,
    sniff_delimiter,
)
from mlscout.sources.sinks import sanitize, write_cleaned, write_predictions

__all__ = [
    "audit_columns",
    "audit_dimensions",
    "audit_files",
    "audit_target",
    "check_schema",
    "guard_trainable",
    "preview",
    "read_stat_files",
    "read_table",
    "resolve_format",
    "sanitize",
    "sniff_delimiter",
    "write_cleaned",
    "write_predictions",
]
