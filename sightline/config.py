"""Job settings (plain values passed to the plans)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    scope_include: str = ""
    scope_exclude: str = ""
    ignore_static_assets: bool = True
    scan_secrets: bool = True
    run_passive_checks: bool = True
    analyze_library_js: bool = False
    min_severity: str = "INFO"
    muted_categories: tuple[str, ...] = ()
    retention_cap: int = 0
    user_rules: tuple = field(default_factory=tuple)
