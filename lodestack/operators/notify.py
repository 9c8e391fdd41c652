"""Change rules on records before and after an interval, observations, digests and inquiries.

A rule names a path, how members of both sides are paired, and the fields whose change counts. The
rules are data; comparing is one function, so a rule can be read, tested and added by itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.jsontree import get_path
from lodestack.functions.text import differs as differs_in_text
from lodestack.functions.text import life_span_differs

#: Observations of one changed record; beyond it the record's own rule is used instead.
MAX_OBSERVATIONS = 20


def text_differs(before, after) -> bool:
    """``text.differs`` on what may be no text at all."""
    return differs_in_text(before if isinstance(before, str) else None, after if isinstance(after, str) else None)


def part_differs(before, after) -> bool:
    """Whether two organisations that both belong to a larger one belong to others, or are other units of it."""
    a, b = before.get("isPartOf"), after.get("isPartOf")
    if not isinstance(a, dict) or not isinstance(b, dict):
        return False
    return a.get("name") != b.get("name") or before.get("marc:subordinateUnit") != after.get("marc:subordinateUnit")


def differs(before, after) -> bool:
    return before != after


# The fields of an agent that make it another one, by type; "*" compares the whole.
AGENT_FIELDS: dict[str, dict[str, Callable]] = {
    "Person": {"familyName": text_differs, "givenName": text_differs, "name": text_differs, "lifeSpan": life_span_differs},
    "Organization": {"name": differs, "*": part_differs},
    "Meeting": {"place": differs, "date": differs, "name": differs},
    "Jurisdiction": {"*": differs},
    "Family": {"*": differs},
}


def agent_changed(before, after) -> bool:
    """Whether two agents of one type are no longer the same."""
    if not isinstance(before, dict) or not isinstance(after, dict) or before.get("@type") != after.get("@type"):
        return False
    for name, test in AGENT_FIELDS.get(before.get("@type"), {}).items():
        x, y = (before, after) if name == "*" else (before.get(name), after.get(name))
        if test(x, y):
            return True
    return False


@dataclass(frozen=True)
class Rule:
    """``pick`` takes the members to compare at ``path``; ``changed`` decides on a pair; sets compare as a whole."""

    name: str
    path: tuple
    pick: Callable[[dict], bool] = lambda x: True
    part: str | None = None
    changed: Callable[[object, object], bool] = differs
    as_set: bool = False
    also: tuple = ()  # a second path whose members count with the first one's

    def members(self, record: dict) -> list:
        found = []
        for path in filter(None, (self.path, self.also)):
            at = get_path(record, list(path))
            found += at if isinstance(at, list) else [] if at is None else [at]
        found = [x for x in found if not isinstance(x, dict) or self.pick(x)]
        return [x.get(self.part) if self.part and isinstance(x, dict) else x for x in found]

    def __call__(self, before: dict, after: dict) -> tuple | None:
        a, b = self.members(before), self.members(after)
        if not a or not b:
            return None
        if self.as_set:
            key = lambda xs: sorted(json.dumps(x, sort_keys=True) for x in xs)
            return (a, b) if key(a) != key(b) else None
        return next(((x, y) for x in a for y in b if self.changed(x, y)), None)


def _typed(*names: str) -> Callable[[dict], bool]:
    return lambda x: x.get("@type") in names


def _titled(name: str) -> Callable[[dict], bool]:
    return lambda x: x.get("@type") == name and bool(x.get("mainTitle"))


# The rules for instances, in their order.
INSTANCE_RULES = [
    Rule("primaryContribution", ("mainEntity", "instanceOf", "contribution"), _typed("PrimaryContribution"), "agent", agent_changed),
    Rule("intendedAudience", ("mainEntity", "instanceOf", "intendedAudience"), as_set=True),
    Rule("subject", ("mainEntity", "instanceOf", "subject"), as_set=True),
    Rule("ddc", ("mainEntity", "instanceOf", "classification"), _typed("ClassificationDdc"), "code", as_set=True, also=("mainEntity", "classification")),
    Rule("sab", ("mainEntity", "instanceOf", "classification"), lambda x: (x.get("inScheme") or {}).get("code") == "kssb", "code", as_set=True, also=("mainEntity", "classification")),
    Rule("mainTitle", ("mainEntity", "hasTitle"), _titled("Title"), "mainTitle", text_differs),
    Rule("keyTitle", ("mainEntity", "hasTitle"), _titled("KeyTitle"), "mainTitle", text_differs),
    Rule("serialRelation", ("mainEntity", "precededBy"), as_set=True),
    Rule("serialEnd", ("mainEntity", "publication"), lambda x: x.get("endYear") is not None, "endYear", differs),
]
AGENT_RULE = Rule("agent", ("mainEntity",), changed=agent_changed)


def observations(pairs: DataFrame, key: str, before: str, after: str, rules: list[Rule] | None = None, changed_by: str | None = None) -> DataFrame:
    """``key, rule, old, new``: what changed in each record between two JSON texts.

    ``changed_by`` names a column with the record whose change caused it; if that gives more than
    ``MAX_OBSERVATIONS`` rows use ``collapse`` on the result.
    """
    kind = pairs.schema[key].dataType.simpleString()
    extra = [changed_by] if changed_by else []
    kinds = "".join(f", `{c}` {pairs.schema[c].dataType.simpleString()}" for c in extra)
    rules = rules or INSTANCE_RULES

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf[[key, before, after, *extra]].itertuples(index=False):
                if row[1] is None or row[2] is None:
                    continue
                a, b = json.loads(row[1]), json.loads(row[2])
                for rule in rules:
                    if (hit := rule(a, b)) is not None:
                        rows.append((row[0], rule.name, json.dumps(hit[0], sort_keys=True), json.dumps(hit[1], sort_keys=True), *row[3:]))
            yield pd.DataFrame(rows, columns=[key, "rule", "old", "new", *extra])

    return pairs.select(key, before, after, *extra).mapInPandas(run, f"`{key}` {kind}, rule string, old string, new string{kinds}")


def collapse(found: DataFrame, cause: str, most: int = MAX_OBSERVATIONS) -> DataFrame:
    """Observations of causes with at most ``most`` of them, and one row for each other cause (``rule``: agent)."""
    n = found.groupBy(cause).agg(F.count("*").alias("_n"))
    counted = found.join(n, cause)
    few = counted.where(F.col("_n") <= most).drop("_n")
    other = [c for c in found.columns if c not in (cause, "rule")]
    many = n.where(F.col("_n") > most).select(cause, F.lit("agent").alias("rule"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in other])
    return few.unionByName(many)


def inquiries(actions: DataFrame, created: str, since, holders: DataFrame) -> DataFrame:
    """New actions since a time with everyone who holds their object. ``holders``: ``object, holder``."""
    return actions.where(F.col(created) > since).join(holders.distinct(), "object")
