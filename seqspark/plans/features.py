"""A registry of group features, of which a plan builds only what is asked for, and the settings that scoring is run with.

A family is a builder of many columns at once (its names are read off its plan, which nothing runs). A feature of one's own is an aggregate over the
rows of a grain: the actions, the hands, or the hands as all actors played them; those of one grain share one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession

from seqspark.operators import groups, hands, redundancy
from seqspark.sources.tables import Sequences

#: Grain -> the rows that a feature of that grain sums up by group.
GRAINS: dict[str, Callable[[Sequences], DataFrame]] = {"action": lambda seq: seq.actions, "hand": hands.hand_features, "actor": hands.actor_features}


@dataclass(frozen=True)
class Feature:
    """An aggregate over ``inputs`` of a grain's rows; ``fill`` stands for groups without rows or value."""

    name: str
    grain: str
    inputs: tuple[str, ...]
    build: Callable[[], Column]
    fill: float | None = 0.0

    def __post_init__(self) -> None:
        if self.grain not in GRAINS:
            raise ValueError(f"{self.name}: no grain {self.grain}")


@dataclass(frozen=True)
class Family:
    """Columns by group_id that one builder makes together."""

    name: str
    build: Callable[[Sequences], DataFrame]
    fill: float | None = 0.0


FAMILIES = (
    Family("hand_statistics", lambda seq: groups.hand_statistics(hands.hand_features(seq))),
    Family("consistency", lambda seq: groups.consistency(hands.hand_features(seq)).withColumnRenamed("mean_roundness", "mean_roundness_of_hands")),
    Family("pooled_sizes", groups.pooled_sizes),
    Family("policy", groups.policy),
    Family("actor_statistics", lambda seq: groups.actor_statistics(hands.actor_features(seq))),
    Family("actor_group", groups.actor_group),
    Family("redundancy", redundancy.redundancy_features, None),
)


@dataclass(frozen=True)
class Registry:
    """Families and features by name; ``having`` gives another registry, this one stays."""

    families: tuple[Family, ...] = FAMILIES
    features: Mapping[str, Feature] = field(default_factory=dict)

    def having(self, *features: Feature) -> Registry:
        for f in features:
            if f.name in self.features:
                raise ValueError(f"there is a feature {f.name}")
        return replace(self, features={**self.features, **{f.name: f for f in features}})

    def plan(self, seq: Sequences, names: Sequence[str]) -> DataFrame:
        """group_id and the asked columns, in their order: nothing else is aggregated. A name that is registered as a feature hides a family's."""
        own = [self.features[n] for n in names if n in self.features]
        left = {n for n in names if n not in self.features}
        out = seq.hands.select("group_id").distinct()
        for grain in dict.fromkeys(f.grain for f in own):
            mine = [f for f in own if f.grain == grain]
            rows = GRAINS[grain](seq).select("group_id", *dict.fromkeys(c for f in mine for c in f.inputs))
            out = out.join(rows.groupBy("group_id").agg(*[f.build().alias(f.name) for f in mine]), "group_id", "left")
            filled = {f.name: f.fill for f in mine if f.fill is not None}
            out = out.fillna(filled) if filled else out
        for family in self.families if left else ():
            made = family.build(seq)
            asked = [n for n in made.columns if n in left]
            if not asked:
                continue
            left -= set(asked)
            out = out.join(made.select("group_id", *asked), "group_id", "left")
            out = out if family.fill is None else out.fillna(family.fill, asked)
            if not left:
                break
        if left:
            raise ValueError(f"no features {sorted(left)}")
        return out.select("group_id", *names)


@dataclass(frozen=True)
class Settings:
    """How scores are served and judged. ``of`` reads ``seqspark.<name>`` of a session; what is not set there stays as it is here."""

    rank_fraction: float = 0.125
    min_batch: int = 4
    min_positives: int = 1
    positive_budget: float = 0.16
    max_fpr: float = 0.05
    max_shift: float = 5.0
    pool_cap: int = 3000

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(f"seqspark.{f.name}", None) for f in fields(cls)}
        return cls(**{n: type(getattr(cls, n))(v) for n, v in given.items() if v is not None})
