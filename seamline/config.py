"""Defaults of every operator, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

SPLITS = ("train", "dev", "test")
TYPE1, TYPE2, TYPE3 = "type1_single_boundary", "type2_single_internal_segment", "type3_multiple_internal_segments"
TYPES = (TYPE1, TYPE2, TYPE3)

# Titles, patterns and word lists that decide what an article and a sentence are.
TITLE_PREFIXES = (
    "Talk:", "User:", "User talk:", "Wikipedia:", "WP:", "WT:", "File:", "Image:", "MediaWiki:", "Template:",
    "Help:", "Category:", "Portal:", "Draft:", "Book:", "Module:", "Special:", "සාකච්ඡාව:", "සාමාජික:",
    "විකිපීඩියා:", "ගොනුව:", "ගොනු:", "රූපය:", "සැකිල්ල:", "උදවු:", "ප්‍රවර්ගය:", "ද්වාරය:", "මොඩියුලය:", "විශේෂ:",
)
EXACT_TITLES = ("මුල් පිටුව", "Main Page")
REDIRECT = (r"(?i)^\s*#\s*(?:REDIRECT|redirect)", r"^\s*#\s*යළි[\s\-]*යොමු")
DISAMBIGUATION = ("බහුරුත්හරණය", r"(?i)\{\{\s*disambig", r"(?i)\{\{\s*(?:hndis|geodis|surname|given name)\s*[\|\}]")
STUB = (r"දියුණු\s*කරන්න", r"(?i)\{\{[^}]{0,40}stub\s*\}\}")
LIST_TITLE = ("ලැයිස්තුව", r"(?i)^List of\b", r"(?i)^Index of\b")
TERMINATORS = (".", "?", "!", "෴", "…")
ABBREVIATIONS = (
    "ආචාර්ය", "මහාචාර්ය", "පූජ්‍ය", "ශ්‍රී", "මයා", "මිය", "අංක", "ක්‍රි.ව", "ක්‍රි.පූ", "ඉ.පෙ", "පි.ව",
    "Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Jr", "Sr", "vs", "etc", "No", "Fig", "Vol", "pp", "ed", "eds", "cf", "al",
)
PREAMBLE = (
    r"(?i)^\s*(?:sure|certainly|of course|okay|ok)\b",
    r"(?i)^\s*here(?:'s| is)\b",
    r"(?i)^\s*(?:as requested|i have|i've|below is)",
    r"(?i)^\s*(?:rewritten|continuation|translation|output|response)\s*:",
    r"^\s*මෙන්න",
    r"^\s*මෙහි\s+(?:දැක්වෙන|ඇත්තේ)",
    r"^\s*පහත\s+දැක්වෙන",
)
MARKDOWN = (
    r"(?m)^\s{0,3}#{1,6}\s",
    r"\*\*[^*]+\*\*",
    r"(?m)^\s{0,3}[-*+]\s+",
    r"(?m)^\s{0,3}\d+[.)]\s+",
    r"```",
    r"(?m)^\s*>\s",
    r"\[[^\]]+\]\([^)]+\)",
)


@dataclass(frozen=True)
class Columns:
    """Names of the raw table's columns."""

    id: str = "id"
    title: str = "title"
    url: str = "url"
    text: str = "raw_mediawiki"


@dataclass(frozen=True)
class Clean:
    prefixes: tuple[str, ...] = TITLE_PREFIXES
    exact_titles: tuple[str, ...] = EXACT_TITLES
    redirect: tuple[str, ...] = REDIRECT
    disambiguation: tuple[str, ...] = DISAMBIGUATION
    stub: tuple[str, ...] = STUB
    list_title: tuple[str, ...] = LIST_TITLE
    max_bullet_ratio: float = 0.35
    min_sentences: int = 8
    min_words: int = 120
    min_chars: int = 400
    min_script_ratio: float = 0.55
    min_paragraph_chars: int = 60


@dataclass(frozen=True)
class Segment:
    terminators: tuple[str, ...] = TERMINATORS
    abbreviations: tuple[str, ...] = ABBREVIATIONS
    min_chars: int = 15


@dataclass(frozen=True)
class Windows:
    min_sentences: int = 6
    max_sentences: int = 12
    per_source: int = 1
    min_words: int = 100


@dataclass(frozen=True)
class Construction:
    """Bounds of one way of replacing sentences; those that a type doesn't use are left alone."""

    min_sentences: int
    low: float = 0.2
    high: float = 0.8
    min_human: int = 2
    min_machine: int = 2
    span_min: int = 1
    span_max: int = 3
    ratio_min: float = 0.15
    ratio_max: float = 0.35
    context: int = 2
    spans_min: int = 2
    spans_max: int = 3
    gap: int = 1


@dataclass(frozen=True)
class Generator:
    slug: str
    role: str
    splits: tuple[str, ...] = SPLITS
    temperature: float = 0.8
    top_p: float = 0.95
    max_tokens: int = 1200
    price_prompt: float = 0.0
    price_completion: float = 0.0


@dataclass(frozen=True)
class Validate:
    attempts: int = 3
    length_tolerance: float = 0.25
    sentence_tolerance: int = 0
    min_script_ratio: float = 0.60
    max_latin_ratio: float = 0.25
    preamble: tuple[str, ...] = PREAMBLE
    markdown: tuple[str, ...] = MARKDOWN
    max_copy: float = 0.92


@dataclass(frozen=True)
class Config:
    seed: int = 42
    columns: Columns = Columns()
    clean: Clean = Clean()
    segment: Segment = Segment()
    windows: Windows = Windows()
    split: tuple[float, float] = (0.70, 0.15)
    constructions: dict[str, Construction] = field(
        default_factory=lambda: {TYPE1: Construction(4), TYPE2: Construction(6), TYPE3: Construction(8, span_max=2, ratio_min=0.0, ratio_max=0.45)}
    )
    generators: dict[str, Generator] = field(
        default_factory=lambda: {
            "alpha": Generator("vendor/alpha", "seen", price_prompt=2.5e-7, price_completion=1e-6),
            "beta": Generator("vendor/beta", "seen", price_prompt=2.5e-6, price_completion=1e-5),
            "gamma": Generator("vendor/gamma", "held_out", ("dev", "test"), price_prompt=1.25e-6, price_completion=1e-5),
        }
    )
    validate: Validate = Validate()
    type_mix: dict[str, float] = field(default_factory=lambda: {TYPE1: 0.40, TYPE2: 0.30, TYPE3: 0.30})


def from_mapping(values: dict[str, Any], base: Config | None = None) -> Config:
    """A Config with the fields that a nested mapping (such as a parsed YAML file) names."""

    def over(old: Any, new: dict[str, Any]) -> Any:
        changes = {}
        for k, v in new.items():
            was = getattr(old, k)
            if isinstance(v, dict) and not isinstance(was, dict):
                v = over(was, v)
            elif isinstance(was, tuple) and isinstance(v, list):
                v = tuple(v)
            elif isinstance(was, dict):
                kind = type(next(iter(was.values()), None))
                v = {**{}, **{n: (over(was[n], x) if n in was and isinstance(x, dict) else kind(**x) if isinstance(x, dict) else x) for n, x in v.items()}}
            changes[k] = v
        return replace(old, **changes)

    return over(base or Config(), values)


def load(path: str, base: Config | None = None) -> Config:
    """from_mapping() of a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {}, base)


def environment(path: str) -> dict[str, str]:
    """The KEY=VALUE lines of a file, on the driver; what the process's environment has wins, and a missing file has none.

    Blank lines and those that begin with # say nothing. Quotes around a value come off; of a repeated key, the first counts.
    """
    import os

    said: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            pairs = [x.strip().partition("=") for x in f if not x.lstrip().startswith("#")]
        for key, equals, value in pairs:
            if equals:
                said.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return {k: os.environ.get(k, v) for k, v in said.items()}
