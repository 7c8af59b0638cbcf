"""Checks of a configuration before anything runs: each problem as (where, what)."""

from __future__ import annotations

from datetime import datetime

from fslink.operators.generate import ValueModel, World
from fslink.operators.normalise import DERIVED, FREE_TEXT, NONE_OBSERVED, TEXT_COLUMN, Feed, Vocabulary

Problem = tuple[str, str]
TOLERANCE = 1e-6
NEEDED = ("fir_no", "crime_type", "occurred_from", "occurred_to", "registered_at")


def _model(where: str, m: ValueModel, axes: int) -> list[Problem]:
    out = []
    if len(set(m.values)) < len(m.values):
        out.append((where, "a value stands twice"))
    if not len(m.values) == len(m.chance) == len(m.loading):
        return [*out, (where, "values, chances and loadings differ in number")]
    if any(not 0 <= p <= 1 for p in m.chance):
        out.append((where, "a chance lies outside 0 to 1"))
    elif not m.tags and abs(sum(m.chance) - 1) > TOLERANCE:
        out.append((where, f"chances sum to {sum(m.chance):.6f}"))
    if any(len(row) != axes for row in m.loading):
        out.append((where, f"a value hasn't {axes} loadings"))
    return out


def check_bands(bands: dict[str, tuple[int, int]]) -> list[Problem]:
    """Bands must hold every hour of the day exactly once."""
    hours = [h % 24 for a, b in bands.values() for h in range(a, b if b > a else b + 24)]
    return [("bands", f"hour {h} is in {hours.count(h)} bands") for h in range(24) if hours.count(h) != 1]


def check_world(world: World, confusable: dict[str, list[tuple[str, str]]] | None = None) -> list[Problem]:
    """Chances, loadings, shares, places and neighbours of a generator's world."""
    out = _model("classes", world.classes, world.axes)
    out += [("fields", f"class {c} isn't described") for c in world.classes.values if c not in world.fields]
    out += [("fields", f"class {c} isn't known") for c in world.fields if c not in world.classes.values]
    for cls, models in world.fields.items():
        for name, m in models.items():
            out += _model(f"fields.{cls}.{name}", m, world.axes)
    if abs(sum(world.shares.values()) - 1) > TOLERANCE:
        out.append(("shares", f"sum to {sum(world.shares.values()):.6f}"))
    out += [("places", f"{c} has no districts") for c in world.shares if not world.places.get(c)]
    for place, others in world.neighbours.items():
        out += [(f"neighbours.{place}", f"{o} isn't a place beside it") for o in others if o == place or o not in world.shares]
    if abs(sum(w for w, _ in world.gaps) - 1) > TOLERANCE:
        out.append(("gaps", "weights don't sum to 1"))
    if not world.reference_frequency < world.repeat_rate <= 1:
        out.append(("repeat_rate", "must be above the reference frequency and at most 1"))
    if world.bands:
        out += check_bands(world.bands)
    known: dict[str, set[str]] = {"crime_type": set(world.classes.values)}
    for models in world.fields.values():
        for name, m in models.items():
            known.setdefault(name, set()).update(m.values)
    for name, edges in (confusable or {}).items():
        if name != "crime_type":
            out += [(f"confusable.{name}", f"{v} isn't a value") for edge in edges for v in edge if v not in known.get(name, set())]
        out += [(f"confusable.{name}", f"{a} is confused with itself") for a, b in edges if a == b]
    return out


def check_feed(feed: Feed, vocabulary: Vocabulary) -> list[Problem]:
    """Columns, labels, delimiter and formats of one feed."""
    at, out = f"feeds.{feed.code}", []
    out += [(at, f"no column for {c}") for c in NEEDED if c not in feed.columns]
    if len(set(feed.columns.values())) < len(feed.columns):
        out.append((at, "two columns share a native name"))
    if feed.layout == FREE_TEXT and TEXT_COLUMN not in feed.columns and "narrative" not in feed.columns:
        out.append((at, "a free-text feed needs a description or a narrative"))
    out += [(at, f"{f} is absent and has a column") for f in feed.absent if f in feed.columns]
    classes = [labels[feed.code] for labels in vocabulary.classes.values() if feed.code in labels]
    if len(set(classes)) < len(classes):
        out.append((f"{at}.crime_type", "two classes share a label"))
    for name in (f for f in vocabulary.every if f in feed.columns and f != DERIVED):
        values = vocabulary.fields.get(name, {})
        labels = [x[feed.code] for x in values.values() if feed.code in x]
        out += [(f"{at}.{name}", f"no label for {v}") for v, x in values.items() if feed.code not in x]
        if len(set(labels)) < len(labels):
            out.append((f"{at}.{name}", "two values share a label"))
        if name in vocabulary.tags:
            if NONE_OBSERVED not in values:
                out.append((f"{at}.{name}", "no label for none observed"))
            if not feed.delimiter:
                out.append((f"{at}.{name}", "tags need a delimiter"))
            else:
                out += [(f"{at}.{name}", f"label {x} holds the delimiter") for x in labels if feed.delimiter in x]
    sample = datetime(2023, 11, 28, 17, 46)
    for form, what in ((feed.date_format, sample), (feed.date_only_format, datetime(2023, 11, 28))):
        try:
            if datetime.strptime(sample.strftime(form), form) != what:
                out.append((at, f"format {form} loses part of a date"))
        except ValueError as e:
            out.append((at, f"format {form}: {e}"))
    return out


def check_all(world: World, feeds: list[Feed], vocabulary: Vocabulary, confusable: dict[str, list[tuple[str, str]]] | None = None) -> list[Problem]:
    out = check_world(world, confusable) + check_bands(vocabulary.bands)
    out += [("feeds", f"none for {c}") for c in world.shares if c not in {f.code for f in feeds}]
    for feed in feeds:
        out += check_feed(feed, vocabulary)
    for name, values in vocabulary.fields.items():
        clauses = [x.get("en") for x in values.values()]
        out += [(f"vocabulary.{name}", "a value has no clause")] if None in clauses else []
        out += [(f"vocabulary.{name}", "two values share a clause")] if len(set(clauses)) < len(clauses) else []
    return list(dict.fromkeys(out))
