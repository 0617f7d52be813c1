"""A query plan: entities, hops between them, and the entity asked for.

A plan is a few lines long, so it lives on the driver; what it describes runs on the
cluster. `check` gives every structural fault at once; `join_order` starts at pinned
entities, lets every step touch one already bound, and closes cycles last.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path


class PlanError(ValueError):
    """The plan cannot run; the message holds every reason."""


@dataclass(frozen=True)
class Entity:
    ref: str
    category: str | None = None
    ids: tuple[str, ...] = ()
    is_variable: bool = True


@dataclass(frozen=True)
class Hop:
    subject: str
    predicate: str
    object: str
    descendants: bool = False
    negated: bool = False
    filters: tuple[tuple[str, str, object], ...] = ()


@dataclass(frozen=True)
class Plan:
    entities: tuple[Entity, ...]
    hops: tuple[Hop, ...]
    returns: str
    path_id: str = "P1"
    extra: dict = field(default_factory=dict, compare=False)

    MAX_HOPS = 5

    @staticmethod
    def read(source: str | dict | Path) -> Plan:
        """A plan from a dict, JSON text or a file."""
        if isinstance(source, Path):
            source = source.read_text()
        doc = json.loads(source) if isinstance(source, str) else source
        entities = tuple(Entity(e["ref"], e.get("category"), tuple(e.get("ids", ())), e.get("is_variable", not e.get("ids"))) for e in doc["entities"])
        hops = tuple(Hop(h["subject"], h["predicate"], h["object"], h.get("descendants", False), h.get("negated", False), tuple(map(tuple, h.get("filters", ())))) for h in doc["hops"])
        return Plan(entities, hops, doc["returns"], doc.get("path_id", "P1"))

    def entity(self, ref: str) -> Entity:
        return next(e for e in self.entities if e.ref == ref)

    def check(self, known_predicates: set[str] | None = None) -> list[str]:
        """All structural faults."""
        faults = []
        refs = [e.ref for e in self.entities]
        faults += [f"entity {r} is declared twice" for r in sorted({r for r in refs if refs.count(r) > 1})]
        faults += [f"{r!r} is no entity name" for r in refs if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", r)]
        if not self.hops:
            faults.append("there is no hop")
        if len(self.hops) > self.MAX_HOPS:
            faults.append(f"there are more than {self.MAX_HOPS} hops")
        used: set[str] = set()
        for i, h in enumerate(self.hops, 1):
            faults += [f"hop {i} names {r}, which is no entity" for r in (h.subject, h.object) if r not in refs]
            if h.subject == h.object:
                faults.append(f"hop {i} leads from {h.subject} to itself")
            if known_predicates is not None and h.predicate not in known_predicates:
                faults.append(f"hop {i} has the unknown predicate {h.predicate}")
            used |= {h.subject, h.object}
        pinned = {e.ref for e in self.entities if e.ids}
        if self.hops and not used & pinned:
            faults.append("no entity of the path is pinned")
        if self.returns not in used:
            faults.append(f"the path does not reach {self.returns}")
        elif self.returns in refs and not self.entity(self.returns).is_variable:
            faults.append(f"{self.returns} is asked for but fixed")
        faults += [f"entity {r} is fixed but unused" for r in sorted(pinned - used)]
        if self.hops and not faults and self._reached() != used:
            faults.append("the hops are not connected")
        return faults

    def _reached(self) -> set[str]:
        seen = {self.hops[0].subject}
        for _ in self.hops:
            for h in self.hops:
                if {h.subject, h.object} & seen:
                    seen |= {h.subject, h.object}
        return seen

    def join_order(self) -> list[int]:
        """Hop numbers in the order of the joins."""
        bound = {e.ref for e in self.entities if e.ids and any(e.ref in (h.subject, h.object) for h in self.hops)}
        start, left, order = set(bound), list(range(len(self.hops))), []
        seen: set[str] = set()
        while left:
            closing = [i for i in left if {self.hops[i].subject, self.hops[i].object} <= seen]
            reach = [i for i in left if {self.hops[i].subject, self.hops[i].object} & (seen or start)]
            opening = [i for i in reach if i not in closing]
            pick = (closing or opening or [None])[0]
            if pick is None:
                raise PlanError(f"{self.path_id}: hop {left[0] + 1} touches nothing that is bound")
            order.append(pick)
            left.remove(pick)
            seen |= {self.hops[pick].subject, self.hops[pick].object}
        return order

    def fingerprint(self) -> str:
        """A digest of what the plan asks, not of how it is written: the order of entities
        and ids does not count, the order of hops does."""
        doc = {
            "entities": sorted([e.ref, e.category, sorted(e.ids), e.is_variable] for e in self.entities),
            "hops": [[h.subject, h.predicate, h.object, h.descendants, h.negated, sorted(map(list, h.filters), key=str)] for h in self.hops],
            "returns": self.returns,
        }
        return hashlib.sha256(json.dumps(doc, sort_keys=True).encode()).hexdigest()

    def differences(self, other: Plan) -> list[tuple[str, object, object]]:
        """(place, here, there) for each field in which two plans differ."""

        def flat(p: Plan) -> dict[str, object]:
            out: dict[str, object] = {"returns": p.returns}
            for e in p.entities:
                out |= {f"entities.{e.ref}.category": e.category, f"entities.{e.ref}.ids": sorted(e.ids)}
            for i, h in enumerate(p.hops):
                out |= {f"hops.{i}.{k}": getattr(h, k) for k in ("subject", "predicate", "object", "descendants", "negated", "filters")}
            return out

        a, b = flat(self), flat(other)
        return [(k, a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
