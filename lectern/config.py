"""Settings: defaults, then a YAML file, then what the caller sets. Maps are merged key by key, lists replaced."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

#: Settings that a user's files override.
DEFAULTS: dict[str, Any] = {
    "download": {
        "base_url": "https://www.pbs.gov.pk/sites/default/files/population/2017/results/",
        "file_pattern": "{district_code}{data_type}.pdf",
        "district_range": [1, 135],
        "data_type": "09",
        "output_dir": "./downloads",
        "delay_seconds": 3,
        "verify_ssl": True,
        "timeout": 30,
    },
    "conversion": {"output_dir": "./images", "image_format": "JPEG", "dpi": 300},
    "ocr": {
        "engine": "tesseract",
        "tesseract_config": "--psm 6 --oem 1",
        "preprocessing": {"grayscale": True, "resize_factor": 1.2, "interpolation": "cubic"},
    },
    "parsing": {
        "data_format": "census",
        "keywords": {
            "census": ["FR", "DISTRICT", "TEHSIL", "DIVISION", "AGENCY", "TALUKA", "MUSAKHEL", "DE-EXCLUDED", "F.R"],
            "election": ["CONSTITUENCY", "POLLING", "STATION", "WARD", "DISTRICT", "DIVISION"],
        },
        "column_mappings": {
            "census_religion_7": ["SEX", "TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "QADIANI/AHMADI", "CASTE/SCHEDULED"],
            "census_religion_8": ["SEX", "TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "QADIANI/AHMADI", "CASTE/SCHEDULED", "OTHERS"],
            "census_religion_9": ["SEX", "TOTAL", "MUSLIM", "CHRISTIAN", "HINDU", "QADIANI/AHMADI", "CASTE/SCHEDULED", "OTHERS", "EXTRACOL"],
            "election_standard": ["POLLING_STATION", "REGISTERED_VOTERS", "VOTES_CAST", "VALID_VOTES", "REJECTED_VOTES"],
        },
        "filters": ["OVERALL", "RURAL", "URBAN"],
    },
    "export": {"output_dir": "./output", "format": "excel", "output_filename": "extracted_data"},
    "logging": {"level": "INFO", "file": "lectern.log", "console": True},
}
DATA_FORMATS = ("census", "election", "generic")
EXPORT_FORMATS = ("excel", "csv", "json")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(base)
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        else:
            out[key] = copy.deepcopy(value)
    return out


class Config:
    """Settings by section. Instances share nothing."""

    def __init__(self, path: str | Path | None = None, values: dict[str, Any] | None = None):
        self.values = merged(DEFAULTS, values or {})
        if path is not None and Path(path).exists():
            self.load(path)

    def load(self, path: str | Path) -> None:
        import yaml

        self.values = merged(self.values, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    def save(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.dump(self.values, sort_keys=False, allow_unicode=True), encoding="utf-8")

    def get(self, *keys: str, default: Any = None) -> Any:
        """What stands under these keys, at any depth; the default if any of them is missing."""
        part: Any = self.values
        for key in keys:
            if not isinstance(part, dict) or key not in part:
                return default
            part = part[key]
        return part

    def set(self, *keys_and_value: Any) -> None:
        """The value (last) under the keys before it; missing sections are made."""
        *sections, key, value = keys_and_value
        part = self.values
        for section in sections:
            if not isinstance(part.get(section), dict):
                part[section] = {}
            part = part[section]
        part[key] = value

    def keywords(self) -> list[str]:
        return list(self.get("parsing", "keywords", self.get("parsing", "data_format"), default=[]))

    def problems(self) -> list[str]:
        """What makes the settings unusable; empty if nothing does."""
        out = []
        if not self.get("download", "base_url"):
            out.append("download.base_url is empty")
        if self.get("parsing", "data_format") not in DATA_FORMATS:
            out.append(f"parsing.data_format must be one of {', '.join(DATA_FORMATS)}")
        if self.get("export", "format") not in EXPORT_FORMATS:
            out.append(f"export.format must be one of {', '.join(EXPORT_FORMATS)}")
        return out
