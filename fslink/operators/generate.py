"""Synthetic cases with known entities: serial offenders with habits, and one-off background cases.

A configuration gives marginals per class and field, loadings of each value on style axes, shares of
classes and places, and the shapes of series.  Every offender and every background case has a random
stream of its own, named by (seed, kind, number), so a table is the same however it is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fslink.functions.evidence import alpha_of, case_id
from fslink.operators.normalise import DERIVED, UNKNOWABLE, time_band
from fslink.operators.statistics import running, serial_numbers

SERIAL, BACKGROUND = 1, 2


@dataclass(frozen=True)
class ValueModel:
    """One field of one class: its values, style-neutral chances and loadings (values x axes)."""

    values: tuple[str, ...]
    chance: tuple[float, ...]
    loading: tuple[tuple[float, ...], ...]
    tags: bool = False

    def tilted(self, style: np.ndarray, tau: float) -> np.ndarray:
        """Chances under a style: a softmax shift for one-of-many, a logistic one per tag.  Chances of
        0 and 1 stay."""
        p = np.asarray(self.chance, dtype=float)
        shift = tau * np.asarray(self.loading, dtype=float).reshape(len(p), -1) @ style
        if self.tags:
            inside = (p > 0) & (p < 1)
            safe = np.where(inside, p, 0.5)
            return np.where(inside, 1 / (1 + np.exp(-(np.log(safe / (1 - safe)) + shift))), p)
        weight = p * np.exp(shift - shift.max())
        return weight / weight.sum()

    def habit(self, style: np.ndarray, tau: float, alpha: float, rng: np.random.Generator) -> np.ndarray:
        """An offender's own chances: Dirichlet (or a Beta per tag) around the tilted ones, the
        tighter the larger alpha."""
        q = self.tilted(style, tau)
        if self.tags:
            inside = (q > 0) & (q < 1)
            safe = np.where(inside, q, 0.5)
            return np.where(inside, rng.beta(np.maximum(alpha * safe, 1e-6), np.maximum(alpha * (1 - safe), 1e-6)), q)
        drawn = rng.gamma(np.maximum(alpha * q, 1e-9))
        return drawn / drawn.sum() if drawn.sum() > 0 else np.eye(len(q))[rng.choice(len(q), p=q)]

    def draw(self, chance: np.ndarray, rng: np.random.Generator) -> str:
        if self.tags:
            return ";".join(v for v, hit in zip(self.values, rng.random(len(self.values)) < chance) if hit)
        return self.values[min(int(np.searchsorted(np.cumsum(chance), rng.random(), side="right")), len(self.values) - 1)]


@dataclass(frozen=True)
class World:
    """What the generator needs to know, all of it small."""

    classes: ValueModel
    fields: dict[str, dict[str, ValueModel]]
    places: dict[str, tuple[str, ...]]
    shares: dict[str, float]
    neighbours: dict[str, tuple[str, ...]]
    days: int = 1826
    start: str = "2021-01-01"
    tau: float = 0.75
    repeat_rate: float = 0.5
    reference_frequency: float = 0.1
    least_length: int = 2
    extra_mean: float = 2.0
    extra_shape: float = 1.0
    gaps: tuple[tuple[float, float], ...] = ((0.7, 20.0), (0.3, 120.0))
    moving: float = 0.35
    dormant: tuple[float, float] = (90.0, 365.0)
    same_district: float = 0.7
    axes: int = 3
    stations: int = 6
    copies: dict[str, tuple[str, float]] = field(default_factory=dict)
    bands: dict[str, tuple[int, int]] = field(default_factory=dict)
    widths: dict[str, tuple[float, float]] = field(default_factory=dict)
    width_field: str = "occupancy"
    width: tuple[float, float] = (8.0, 0.8)
    delay: tuple[float, float] = (18.0, 1.0)

    @property
    def alpha(self) -> float:
        return alpha_of(self.repeat_rate, self.reference_frequency)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(f for fields in self.fields.values() for f in fields))


def stream(seed: int, kind: int, number: int) -> np.random.Generator:
    return np.random.default_rng([seed, kind, number])


def _values(world: World, cls: str, chances: dict[str, np.ndarray], rng: np.random.Generator) -> dict[str, str]:
    drawn = {f: m.draw(chances[f], rng) for f, m in world.fields[cls].items()}
    for name, (source, chance) in world.copies.items():
        if name in drawn and source in drawn and rng.random() < chance:
            drawn[name] = drawn[source]
    return drawn


def _clock(world: World, cls: str, values: dict[str, str], rng: np.random.Generator) -> tuple[float, float, float]:
    """Time of day, window width and delay of registration, in hours.

    The time falls into the case's band if it has one.  Widths are log-normal (median, sigma): those
    of the value of ``width_field``, else of the class, else ``width``.
    """
    a, b = world.bands.get(values.get(DERIVED), (0, 24))
    hour = (a + ((b - a) % 24 or 24) * rng.random()) % 24
    median, sigma = world.widths.get(values.get(world.width_field)) or world.widths.get(cls) or world.width
    late, spread = world.delay
    return hour, median * math.exp(sigma * rng.normal()), late * math.exp(spread * rng.normal())


def fitted(days: np.ndarray, last: float, share: float) -> np.ndarray:
    """A series' days, from 0 on, moved to begin at a share of the room that they leave before ``last``;
    a longer series is cut there, but drawn together if only its first crime would be left."""
    span = days[-1]
    if span <= last:
        return days + share * (last - span)
    if (days <= last).sum() < 2:
        days = days * (last / span)
    return days[days <= last]


def series(world: World, seed: int, number: int) -> list[dict]:
    """The crimes of one serial offender, in order; at least two."""
    rng = stream(seed, SERIAL, number)
    style = rng.normal(size=world.axes)
    length = max(2, world.least_length) + int(rng.poisson(rng.gamma(world.extra_shape, world.extra_mean / world.extra_shape)))
    means = np.array([m for _, m in world.gaps])
    gaps = rng.exponential(means[rng.choice(len(means), size=length - 1, p=[w for w, _ in world.gaps])])
    classes = world.classes.habit(style, world.tau, world.alpha, rng)
    habits: dict[str, dict[str, np.ndarray]] = {}
    state = _pick(world.shares, rng)
    moves_at = int(rng.integers(1, length)) if rng.random() < world.moving and world.neighbours.get(state) else None
    if moves_at:
        gaps[moves_at - 1] += rng.uniform(*world.dormant)
    district, out = str(rng.choice(world.places[state])), []
    for k, day in enumerate(fitted(np.concatenate([[0.0], np.cumsum(gaps)]), float(world.days), rng.random())):
        if k == moves_at:
            state = str(rng.choice(world.neighbours[state]))
            district = str(rng.choice(world.places[state]))
        cls = world.classes.draw(classes, rng)
        if cls not in habits:
            habits[cls] = {f: m.habit(style, world.tau, world.alpha, rng) for f, m in world.fields[cls].items()}
        here = district if rng.random() < world.same_district else str(rng.choice(world.places[state]))
        out.append(_case(f"S{number:07d}", True, k, state, here, cls, _values(world, cls, habits[cls], rng), min(float(day), world.days - 1e-6), rng, world))
    return out


def one_off(world: World, seed: int, number: int) -> dict:
    """A background case at the neutral style."""
    rng = stream(seed, BACKGROUND, number)
    neutral = np.zeros(world.axes)
    cls = world.classes.draw(np.asarray(world.classes.chance), rng)
    state = _pick(world.shares, rng)
    chances = {f: m.tilted(neutral, 0.0) for f, m in world.fields[cls].items()}
    return _case(f"B{number:07d}", False, 0, state, str(rng.choice(world.places[state])), cls, _values(world, cls, chances, rng), world.days * rng.random(), rng, world)


def _pick(shares: dict[str, float], rng: np.random.Generator) -> str:
    names, p = list(shares), np.array(list(shares.values()))
    return names[int(rng.choice(len(names), p=p / p.sum()))]


def _case(entity, serial, k, state, district, cls, values, day, rng, world) -> dict:
    hour, width, delay = _clock(world, cls, values, rng)
    at = pd.Timestamp(world.start) + pd.Timedelta(days=math.floor(day), hours=hour)
    begin = at - pd.Timedelta(hours=width * rng.random())
    end = begin + pd.Timedelta(hours=width)
    minute = lambda t: t.floor("min")
    return {"entity": entity, "is_serial": serial, "series_index": k, "state_code": state, "district": district, "police_station": f"{district[:3].upper()}-{int(rng.integers(world.stations)) + 1:02d}", "crime_type": cls, "occurred_from": minute(begin), "occurred_to": minute(end), "registered_at": minute(end + pd.Timedelta(hours=delay)), **values}


def truth(spark: SparkSession, world: World, offenders: int, background: int, seed: int = 7) -> DataFrame:
    """True cases of so many serial offenders and background one-offs, with register numbers and ids."""
    columns = world.columns
    schema = "entity string, is_serial boolean, series_index int, state_code string, district string, police_station string, crime_type string, occurred_from timestamp, occurred_to timestamp, registered_at timestamp, " + ", ".join(f"`{c}` string" for c in columns)
    names = [part.split()[0].strip("`") for part in schema.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[dict] = []
            for kind, number in zip(frame["kind"], frame["number"]):
                rows += series(world, seed, int(number)) if kind == SERIAL else [one_off(world, seed, int(number))]
            yield pd.DataFrame(rows, columns=names)

    numbered = spark.range(offenders).selectExpr(f"{SERIAL} AS kind", "id AS number").union(spark.range(background).selectExpr(f"{BACKGROUND} AS kind", "id AS number"))
    cases = numbered.repartition("kind", "number").mapInPandas(run, schema).withColumn("year", F.year("registered_at"))
    cases = serial_numbers(cases, ["police_station", "year"], ["registered_at", "entity", "series_index"], "fir_serial")
    fir = F.concat_ws("/", F.concat_ws("-", "state_code", "police_station"), F.lpad(F.col("fir_serial").cast("string"), 4, "0"), F.col("year").cast("string"))
    return cases.withColumn("fir_no", fir).withColumn("case_id", case_id(F.col("state_code"), F.col("fir_no"), F.col("year"))).drop("fir_serial", "year")


def offenders_for(spark: SparkSession, world: World, serial_cases: int, seed: int = 7) -> tuple[int, int]:
    """How many offenders, from number 0 on, it takes until they have at least so many cases, and how many
    cases they have."""
    if serial_cases <= 0:
        return 0, 0
    tried = max(8, math.ceil(1.2 * serial_cases / (max(2, world.least_length) + world.extra_mean)))

    def lengths(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"number": frame["number"], "n": [len(series(world, seed, int(k))) for k in frame["number"]]})

    while True:
        counted = spark.range(tried).selectExpr("id AS number").repartition("number").mapInPandas(lengths, "number long, n long")
        run = running(counted, [], [F.col("number").asc()], {"cases": F.col("n")})
        found = run.where(F.col("cases") >= serial_cases).agg(F.min(F.struct("number", "cases")).alias("first")).first()["first"]
        if found is not None:
            return int(found["number"]) + 1, int(found["cases"])
        tried *= 2


def corpus(spark: SparkSession, world: World, cases: int, serial_fraction: float, seed: int = 7) -> DataFrame:
    """True cases, so many in all: serial offenders until they have their share, background after that."""
    offenders, serial = offenders_for(spark, world, round(cases * serial_fraction), seed)
    return truth(spark, world, offenders, max(cases - serial, 0), seed)


def uniform(seed: int, slot: str, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the row's keys, the slot and the seed alone: the first 32 bits
    of an MD5."""
    told = F.concat_ws(":", F.lit(str(seed)), F.lit(slot), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def neighbours_of(edges: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Values that may be confused, from undirected edges."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    return out


def _confused(value: Column, near: dict[str, list[str]], wrong: Column, valid: dict[str, tuple[str, ...]] | None, slot: str, seed: int, *keys: str | Column) -> Column:
    """The value, or with chance ``wrong`` one of its neighbours that the case's class allows."""
    mixed = value
    for v, options in near.items():
        for cls, allowed in (valid or {None: None}).items():
            fine = [o for o in options if allowed is None or o in allowed]
            if fine:
                pick = F.get(F.array(*map(F.lit, fine)), F.floor(uniform(seed, f"pick:{slot}", *keys) * len(fine)).cast("int"))
                mixed = F.when((value == v) & (F.lit(True) if cls is None else F.col("crime_type") == cls), pick).otherwise(mixed)
    return F.when(uniform(seed, f"confuse:{slot}", *keys) < wrong, mixed).otherwise(value)


def recorded(cases: DataFrame, fields: list[str], dropout: dict[str, dict[str, float]], confusion: dict[str, float], confusable: dict[str, list[tuple[str, str]]], absent: dict[str, list[str]], seed: int = 7, world: World | None = None, tags: frozenset[str] = frozenset(), unknowable_above_hours: float = 12) -> DataFrame:
    """Adds rec_<field>: what each place wrote down.  dropout and absent are per place and field
    ('default' for all others), confusion per place; a confused value becomes a neighbour.

    With a world, neighbours that a case's class doesn't know are left out, and a time band is that
    of the recorded window (null, too, if the window is too wide to place).  Each of several tags is
    confused on its own.  The class (``crime_type``) is never blank.
    """
    def per_place(of) -> Column:
        out = F.lit(0.0)
        for place in {*dropout, *confusion}:
            out = F.when(F.col("state_code") == place, F.lit(float(of(place)))).otherwise(out)
        return out

    made = {}
    for f in fields:
        drop = per_place(lambda place, f=f: 0.0 if f == "crime_type" else dropout.get(place, {}).get(f, dropout.get(place, {}).get("default", 0.0)))
        wrong = per_place(lambda place: confusion.get(place, 0.0))
        near = neighbours_of(confusable.get(f, []))
        valid = {cls: models[f].values for cls, models in world.fields.items() if f in models} if world and f != "crime_type" else None
        if f == DERIVED and world and world.bands:
            band = time_band(F.col("occurred_from"), F.col("occurred_to"), world.bands, unknowable_above_hours)
            said = F.when(band != UNKNOWABLE, band)
        elif f in tags:
            each = F.transform(F.split(F.when(F.col(f) != "", F.col(f)), ";"), lambda t: _confused(t, near, wrong, valid, f, seed, "case_id", t))  # noqa: B023
            said = F.when(F.col(f) == "", "").otherwise(F.array_join(F.array_sort(F.array_distinct(each)), ";"))
        else:
            said = _confused(F.col(f), near, wrong, valid, f, seed, "case_id")
        gone = F.col("state_code").isin(*[p for p, names in absent.items() if f in names]) if any(f in x for x in absent.values()) else F.lit(False)
        kept = ~gone & (uniform(seed, f"drop:{f}", "case_id") >= drop)
        made[f"rec_{f}"] = F.when(kept, said)
        if f == DERIVED:
            made["timed"] = kept
    return cases.withColumns(made)


def narrative(fields: list[str], clauses: dict[str, dict[str, str]], mention: float = 0.8, seed: int = 7) -> Column:
    """A sentence of the recorded values' clauses, each mentioned with a chance, in an order drawn
    per case."""
    parts = []
    for f in fields:
        said = F.lit(None).cast("string")
        for value, clause in clauses.get(f, {}).items():
            said = F.when(F.col(f) == value, clause).otherwise(said)
        parts.append(F.when(said.isNotNull() & (uniform(seed, f"mention:{f}", "case_id") < mention), F.struct(uniform(seed, f"order:{f}", "case_id").alias("at"), said.alias("said"))))
    told = F.transform(F.array_sort(F.array_compact(F.array(*parts))), lambda x: x["said"])
    return F.when(F.size(told) > 0, F.concat(F.lit("The accused "), F.array_join(told, ", "), F.lit("."))).otherwise(F.lit("Details are not known."))


def expected_drift(model: ValueModel, tau: float, axes: int = 3, n: int = 20_000, seed: int = 1) -> np.ndarray:
    """How far each value's mean chance over styles is from its neutral chance, relatively."""
    rng = np.random.default_rng(seed)
    mean = np.mean([model.tilted(s, tau) for s in rng.normal(size=(n, axes))], axis=0)
    p = np.asarray(model.chance, dtype=float)
    return np.where(p > 0, mean / np.where(p > 0, p, 1) - 1, 0.0)


def world_of(config: dict) -> World:
    """A World from the configuration files 'marginals', 'loadings', 'corpus' and 'states'."""
    axes = config["corpus"]["style"]["axes"]
    loads = config["loadings"]

    def model(values: dict[str, float], loading: dict, tags: bool) -> ValueModel:
        return ValueModel(tuple(values), tuple(map(float, values.values())), tuple(tuple(float(loading.get(v, {}).get(a, 0.0)) for a in axes) for v in values), tags)

    flat = {f: entries for section, part in loads.items() if section != "crime_type" for f, entries in _fields(part)}
    shares = config["marginals"]["crime_types"]["share"]
    fields = {}
    for cls, entries in config["marginals"]["by_crime_type"].items():
        fields[cls] = {f: model(e.get("p") or e["rate"], flat.get(f, {}), "rate" in e) for f, e in entries.items() if isinstance(e, dict) and ("p" in e or "rate" in e)}
    corpus, states = config["corpus"], config["states"]["states"]
    days = (pd.Timestamp(corpus["date_range"]["end"]) - pd.Timestamp(corpus["date_range"]["start"])).days + 1
    length = corpus["series_length"]
    return World(
        classes=model(shares, loads["crime_type"], False), fields=fields, places={c: tuple(s["districts"]) for c, s in states.items()}, shares={c: float(s["case_share"]) for c, s in states.items()},
        neighbours={c: tuple(s["neighbours"]) for c, s in states.items()}, days=days, start=corpus["date_range"]["start"], tau=float(corpus["tau"]), repeat_rate=corpus["repeat_rate"]["value"],
        reference_frequency=corpus["repeat_rate"]["reference_frequency"], least_length=length["minimum"], extra_mean=length["extra_mean"], extra_shape=length["extra_dispersion"],
        gaps=tuple((g["weight"], g["mean"]) for g in corpus["gap_days"]), moving=corpus["relocation"]["probability"], dormant=tuple(corpus["relocation"]["dormancy_days"]), same_district=corpus["geography"]["same_district_rate"], axes=len(axes),
        copies={"exit_mode": ("approach_mode", corpus["exit_same_as_approach"])}, bands={b: tuple(span) for b, span in corpus["time_band"]["hours"].items()},
        widths={k: (w["median"], w["sigma"]) for part in corpus["occurrence_window_hours"].values() for k, w in part.items()}, delay=(corpus["registration_delay_hours"]["median"], corpus["registration_delay_hours"]["sigma"]),
    )


def _fields(part: dict) -> Iterator[tuple[str, dict]]:
    """(field, entries) at either depth: fields of a section, or of a family within it."""
    for name, entries in part.items():
        inner = [x for x in entries.values() if isinstance(x, dict)]
        if any(isinstance(y, dict) for x in inner for y in x.values()):
            yield from entries.items()
        else:
            yield name, entries
