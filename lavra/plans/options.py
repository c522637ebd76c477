"""All switches of the document pipeline, with defaults, a mapping on top, and command-line values on top of that."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    mode: str = "forense"
    output_format: str = "md"
    separate: bool = False
    remove_headers_footers: bool = True
    detect_citations: bool = True
    extract_metadata: bool = False
    extract_procedural: bool = False
    separate_enums: bool = False
    wrap_notes: bool = False
    preserve_inline_formatting: bool = True
    page_range: str = ""
    detect_columns: bool = True
    generate_toc: bool = False
    rag_optimize: bool = False
    strip_footnotes: bool = True
    strip_artifacts: bool = True
    strip_references: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("forense", "doutrina", "google"):
            raise ValueError(f"unknown mode: {self.mode}")
        if self.output_format not in ("md", "html", "docx"):
            raise ValueError(f"unknown output format: {self.output_format}")

    def over(self, values: dict) -> Options:
        """These options with the known, non-null ``values`` put over them."""
        names = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in names and v is not None})


def load(path: str | None = None, cli: dict | None = None) -> Options:
    """Defaults, then a JSON (or, if its library is there, YAML) file, then ``cli``; a bad file warns and is passed over."""
    found = Options()
    if path:
        try:
            text = Path(path).read_text(encoding="utf-8")
            if path.endswith(".json"):
                values = json.loads(text)
            else:
                import yaml

                values = yaml.safe_load(text)
            found = found.over(values or {})
            if unknown := sorted(set(values or {}) - {f.name for f in fields(Options)}):
                warnings.warn(f"{path} has values that are no options: {', '.join(map(str, unknown))}", stacklevel=2)
        except (OSError, ValueError, ImportError, AttributeError) as e:
            warnings.warn(f"{path} is passed over: {e}", stacklevel=2)
    return found.over(cli or {})
