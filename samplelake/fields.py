"""Field specifications: what a metadata row holds and where each value comes from."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "str"
    description: str = ""
    ref: tuple[str, ...] | None = None
    options: tuple[str, ...] | None = None
    copy_from_ref: bool = False
    map_to_umls: bool = False

    @property
    def copied(self) -> bool:
        return self.copy_from_ref and self.ref is not None and len(self.ref) == 1

    def source(self) -> tuple[str, str]:
        """(entity kind, attribute) that a copy field reads."""
        name = self.ref[0]
        if name.startswith("Series_"):
            return "SERIES", name.removeprefix("Series_")
        return "SAMPLE", name.removeprefix("Sample_")


@dataclass(frozen=True)
class Group:
    """Fields that one prompt asks for together."""

    group_id: int
    fields: tuple[Field, ...]

    def refs(self) -> tuple[str, ...] | None:
        """The attributes the group reads, in field order; None (all of them) unless every
        field names some."""
        if any(f.ref is None for f in self.fields):
            return None
        return tuple(dict.fromkeys(r for f in self.fields for r in f.ref))


def read_fields(path: str | Path) -> list[Field]:
    """Fields from a JSON array of objects with the members of ``Field``."""
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    tuples = {"ref", "options"}
    return [Field(**{k: tuple(v) if k in tuples and v is not None else v for k, v in r.items()}) for r in rows]


def split_fields(fields: Sequence[Field]) -> tuple[list[Field], list[Group]]:
    """Copy fields, and groups of model-answered fields: all plain ones together, and on its own
    each field that is to be copied but names several attributes."""
    plain = tuple(f for f in fields if not f.copy_from_ref)
    alone = [(f,) for f in fields if f.copy_from_ref and not f.copied]
    members = ([plain] if plain else []) + alone
    return [f for f in fields if f.copied], [Group(i, m) for i, m in enumerate(members)]


# Names, kinds and sources of the default fields. Other names would change the
# columns of a result.
_ASKED = (
    ("sample storage", "how the sample was kept, such as fresh, frozen or FFPE"),
    ("library preparation platform", "platform and chemistry version used for the library"),
    ("library kit", "kit used to extract the RNA"),
    ("software for read quality control", "tool that trimmed or checked the reads"),
    ("software for read alignment", "aligner"),
    ("software for read quantification", "tool that counted the reads"),
    (
        "expression calculation in the supplementary files",
        "unit of the values in the supplementary files (counts, CPM, FPKM, TPM; log scale or not)",
    ),
    ("reference genome", "genome build"),
    ("genome annotation file", "annotation release"),
    ("bulk or single-cell or single-nucleus", "which of the three the sample is"),
    ("condition", "healthy, or the diseases or infections of the donor"),
    ("organ/tissue", "organ or tissue the sample comes from"),
    ("cell line", "name of the cell line, for cell line samples"),
    ("gender", ""),
    ("age", ""),
    ("alcohol use", "what the donor drinks or drank"),
    ("tobacco use", "what the donor smokes or smoked"),
    ("tumor site", "for tumours: primary, metastasis, relapse or adjacent tissue"),
    ("stage/state", "stage of a disease or of development"),
    ("sampling site", "exact place the sample was taken from"),
    ("treatment", "therapies and drugs given"),
    ("survival time", "all survival times that are stated, each with its kind"),
    ("length of sequencing reads", "read length in bases"),
    ("pair-end", "single-end or paired-end"),
)
_LINKED = ("condition", "organ/tissue", "sampling site", "treatment")
_COPIED = (
    ("title", "Sample_title"),
    ("type", "Sample_type"),
    ("series_id", "Sample_series_id"),
    ("pubmed_id", "Series_pubmed_id"),
    ("platform_id", "Sample_platform_id"),
    ("relation", "Sample_relation"),
)

DEFAULT_FIELDS = (
    *(Field(name, description=text, map_to_umls=name in _LINKED) for name, text in _ASKED),
    *(Field(name, description=name, ref=(ref,), copy_from_ref=True) for name, ref in _COPIED),
)
