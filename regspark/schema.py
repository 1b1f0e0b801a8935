"""Schemas, type names and limits of registry data."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the registry format: value types by code.
REG_TYPES = {
    0: "REG_NONE",
    1: "REG_SZ",
    2: "REG_EXPAND_SZ",
    3: "REG_BINARY",
    4: "REG_DWORD",
    5: "REG_DWORD_BE",
    6: "REG_LINK",
    7: "REG_MULTI_SZ",
    8: "REG_RESOURCE_LIST",
    9: "REG_FULL_RESOURCE_DESCRIPTOR",
    10: "REG_RESOURCE_REQUIREMENTS_LIST",
    11: "REG_QWORD",
}
# Short names of types that patches and commands use.
TYPE_ALIASES = {
    "NONE": 0, "SZ": 1, "STRING": 1, "EXPAND_SZ": 2, "EXPAND_STRING": 2, "BINARY": 3, "DWORD": 4, "DWORD_LE": 4,
    "DWORD_BE": 5, "DWORD_BIG_ENDIAN": 5, "LINK": 6, "MULTI_SZ": 7, "MULTI_STRING": 7, "RESOURCE_LIST": 8, "FULL_RESOURCE_DESCRIPTOR": 9,
    "RESOURCE_REQUIREMENTS_LIST": 10, "QWORD": 11,
}
# Names of root keys that a path may begin with.
ROOTS = [
    "HKEY_LOCAL_MACHINE",
    "HKEY_CURRENT_USER",
    "HKEY_CLASSES_ROOT",
    "HKEY_USERS",
    "HKEY_CURRENT_CONFIG",
    "HKLM",
    "HKCU",
    "HKCR",
    "HKU",
    "HKCC",
]

CREATE, DELETE_KEY, SET, DELETE_VALUE = "create_key", "delete_key", "set_value", "delete_value"
#: Order of a key's operations in a plan.
PRIORITY = {CREATE: 0, DELETE_KEY: 1, DELETE_VALUE: 2, SET: 3}


@dataclass(frozen=True)
class Limits:
    """Most of each; the defaults are those of the system's documentation."""

    subkeys: int = 512
    values: int = 16_384
    value_size: int = 1 << 20
    key_name: int = 255
    value_name: int = 16_383
    depth: int = 512
    total_size: int = 2 << 30

    @staticmethod
    def relaxed() -> Limits:
        return Limits(subkeys=65_535, value_size=10 << 20, depth=1024, total_size=4 << 30)

    @staticmethod
    def strict() -> Limits:
        return Limits(subkeys=256, values=1024, value_size=64 << 10, key_name=128, value_name=255, depth=128, total_size=100 << 20)
