"""What a linkage is about: which columns identify, classify and describe a case."""

from __future__ import annotations

from dataclasses import dataclass, field

CORE, EXT = "core", "ext"
CATEGORICAL, TAGS = "categorical", "tags"
SAME_TYPE, SAME_FAMILY, CROSS_TYPE = "same_type", "same_family", "cross_type"


@dataclass(frozen=True)
class FieldSpec:
    """A scoreable column.  Core fields apply to every class, ext fields to the named families
    (all, if none is named).  Tag columns are arrays: empty means recorded and none observed, null
    means no evidence."""

    name: str
    kind: str = CATEGORICAL
    section: str = CORE
    families: tuple[str, ...] = ()


@dataclass(frozen=True)
class LinkageSpec:
    """Column names of a case table.  ``family_of`` maps a class to its family; classes that aren't
    named are families of their own."""

    id: str = "case_id"
    cls: str = "crime_type"
    entity: str = "entity"
    text: str = "narrative_text"
    fields: tuple[FieldSpec, ...] = ()
    family_of: dict[str, str] = field(default_factory=dict)

    def of(self, section: str) -> tuple[FieldSpec, ...]:
        return tuple(f for f in self.fields if f.section == section)

    def applicable(self, cls: str) -> tuple[str, ...]:
        """The fields of a class: core, then its family's."""
        family = self.family_of.get(cls, cls)
        return tuple(f.name for f in self.fields if f.section == CORE or not f.families or family in f.families)

    def with_family(self, cases):
        """Adds the column ``family``."""
        from pyspark.sql import functions as F

        out = F.col(self.cls)
        for cls, family in self.family_of.items():
            out = F.when(F.col(self.cls) == cls, family).otherwise(out)
        return cases.withColumn("family", out)
