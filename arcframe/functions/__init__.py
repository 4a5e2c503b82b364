"""Column expressions over entry tables; all native, none needs Python at run time."""

from .attributes import encryption_scheme, extended_timestamps, external_attributes, is_directory, is_encrypted, is_symlink, unix_ids, unix_mode, uses_data_descriptor
from .checks import cross_check_error, declared_size_error, extent_error, limit_error, ratio
from .names import cp437_to_string, decode_name, glob, name_error, sanitize_path, written_name
from .times import dos_to_timestamp, timestamp_to_dos

__all__ = [
    "cp437_to_string", "cross_check_error", "declared_size_error", "decode_name", "dos_to_timestamp", "encryption_scheme", "extended_timestamps", "extent_error", "external_attributes", "glob", "is_directory",
    "is_encrypted", "is_symlink", "limit_error", "name_error", "ratio", "sanitize_path", "timestamp_to_dos", "unix_ids", "unix_mode", "uses_data_descriptor", "written_name",
]
