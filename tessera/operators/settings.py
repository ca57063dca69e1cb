"""What a workplace shows: features switched on and off, presets, what depends on what, and the settings file.

Features and presets are bounded dimensions given as parameters; a user's settings are one map column, so everything is an expression on a row. Null maps
are empty ones; a feature that a map lacks is off, but for core ones, which are always on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The version of stored settings, and the name of a choice that is no preset.
VERSION, OWN = 1, "свой"
#: Unknown names that a note lists; it says how many more there are.
LISTED = 6
FILE = "`вид` STRING, `версия` DOUBLE, `пресет` STRING, `функции` MAP<STRING, STRING>"


@dataclass(frozen=True)
class Feature:
    id: str
    core: bool = False
    needs: str | None = None
    tab: str | None = None


@dataclass(frozen=True)
class Plan:
    """The features, the presets (name to ids of features that it switches on) and the preset that new users get."""

    features: tuple[Feature, ...]
    presets: dict[str, tuple[str, ...]]
    default: str
    by_id: dict[str, Feature] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_id", {f.id: f for f in self.features})

    @property
    def free(self) -> list[str]:
        return [f.id for f in self.features if not f.core]


def _names(ids: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in sorted(ids)]) if ids else F.array().cast("array<string>")


def _switch(flags: Column, id_: str) -> Column:
    return F.coalesce(flags[F.lit(id_)], F.lit(False))


def _map(plan: Plan, value) -> Column:
    return F.create_map(*[c for f in plan.features for c in (F.lit(f.id), F.lit(True) if f.core else value(f.id))])


def of_preset(plan: Plan, preset: Column) -> Column:
    """The map that a preset makes; an unknown name makes the default's."""
    known = F.when(preset.isin(*plan.presets), preset).otherwise(plan.default)
    return _map(plan, lambda i: known.isin(*[p for p, on in plan.presets.items() if i in on]))


def matching(plan: Plan, flags: Column) -> Column:
    """The first preset that switches on just what is on, or the name for none."""
    out = F.lit(OWN)
    for name, ids in reversed(plan.presets.items()):
        out = F.when(_fits(plan, flags, ids), name).otherwise(out)
    return out


def _fits(plan: Plan, flags: Column, ids: tuple[str, ...]) -> Column:
    on = F.filter(_names(plan.free), lambda i: F.coalesce(flags[i], F.lit(False)))
    return on == _names([i for i in plan.free if i in ids])


def applied(plan: Plan, flags: Column, preset: Column) -> Column:
    """The map after a preset is chosen; an unknown name changes nothing."""
    return F.when(preset.isin(*plan.presets), of_preset(plan, preset)).otherwise(flags)


def toggled(plan: Plan, flags: Column, feature: Column, on: Column) -> Column:
    """The map with one feature switched; core and unknown ones stay."""
    rest = F.map_filter(F.coalesce(flags, F.create_map().cast("map<string,boolean>")), lambda k, v: k != feature)
    return F.when(feature.isin(*plan.free), F.map_concat(rest, F.create_map(feature, F.coalesce(on, F.lit(False))))).otherwise(flags)


def enabled(plan: Plan, flags: Column, id_: str) -> Column:
    """Whether a feature is on together with all that it needs; what is stored for it doesn't change when its need is switched off."""
    out, at, seen = F.lit(True), plan.by_id.get(id_), set()
    if at is None:
        return F.lit(False)
    while at is not None and not at.core and at.id not in seen:
        seen.add(at.id)
        out = out & _switch(flags, at.id)
        at = plan.by_id.get(at.needs) if at.needs else None
    return out


def visible(plan: Plan, flags: Column) -> Column:
    """The tabs that are shown, in the features' order."""
    return F.array_compact(F.array(*[F.when(enabled(plan, flags, f.id), f.tab) for f in plan.features if f.tab]))


def switched_off(plan: Plan, flags: Column) -> Column:
    """The features that aren't on with all that they need, in their order."""
    return F.array_compact(F.array(*[F.when(~enabled(plan, flags, i), i) for i in plan.free]))


def to_file(plan: Plan, kind: str, flags: Column, preset: Column) -> Column:
    """A settings file: what is on and the preset; how often something was used stays at home."""
    switches = F.create_map(*[c for i in plan.free for c in (F.lit(i), _switch(flags, i))])
    return F.to_json(F.struct(F.lit(kind).alias("вид"), F.lit(VERSION).alias("версия"), F.coalesce(preset, F.lit(OWN)).alias("пресет"), switches.alias("функции")))


def from_file(plan: Plan, kind: str, raw: Column) -> Column:
    """error, preset, flags, notes of a settings file. A file of another kind is an error and has none of the rest.

    A feature that the file doesn't name has its preset's value, or the default's; a value that is neither true nor false counts as what it would be as a
    condition, with a note. What is switched decides about the preset, not its name."""
    c = F.from_json(raw, FILE)
    form = F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), r"\A(.)", 1)
    found = c["функции"]
    error = F.when((form != "{") | c.isNull(), "no settings").when(F.coalesce(c["вид"], F.lit("")) != kind, F.concat(F.lit("another file: "), F.coalesce(c["вид"], F.lit("none"))))
    base = of_preset(plan, c["пресет"])
    keys = F.coalesce(F.map_keys(found), F.array().cast("array<string>"))

    def value(i: str) -> Column:
        v = F.coalesce(found[F.lit(i)], F.lit(""))
        return F.when(F.array_contains(keys, i), ~v.isin("", "false", "0")).otherwise(base[F.lit(i)])

    flags = _map(plan, value)
    odd = [F.when(F.array_contains(keys, i) & ~F.coalesce(found[F.lit(i)].isin("true", "false"), F.lit(False)), F.lit(f"{i}: neither true nor false")) for i in plan.free]
    core = [F.when(F.array_contains(keys, f.id) & (F.coalesce(found[F.lit(f.id)], F.lit("")) != "true"), F.lit(f"{f.id}: a core feature stays on")) for f in plan.features if f.core]
    more = F.array_sort(F.array_except(keys, _names(list(plan.by_id))))
    others = F.size(more) - LISTED
    unknown = F.concat(F.lit("unknown features dropped: "), F.array_join(F.slice(more, 1, LISTED), ", "), F.when(others > 0, F.concat(F.lit(" and "), others.cast("string"), F.lit(" more"))).otherwise(""))
    name = F.coalesce(c["пресет"], F.lit(""))
    notes = F.array(
        F.when(c["версия"] > VERSION, F.lit("a newer version: unknown fields are dropped")),
        *[n for pair in (core, odd) for n in pair],
        F.when(F.size(more) > 0, unknown),
        F.when(~name.isin("", OWN, *plan.presets), F.concat(F.lit("unknown preset: "), name)),
    )
    ok = error.isNull()
    # The preset that the file names stays if it fits, also where an earlier one fits too.
    fits = F.coalesce(F.map_from_arrays(F.array(*map(F.lit, plan.presets)), F.array(*[_fits(plan, flags, ids) for ids in plan.presets.values()]))[name], F.lit(False))
    return F.struct(
        error.alias("error"),
        F.when(ok, F.when(fits, name).otherwise(matching(plan, flags))).alias("preset"),
        F.when(ok, flags).alias("flags"),
        F.when(ok, F.filter(notes, lambda n: n.isNotNull())).alias("notes"),
    )
