"""Query sessions: one query over the sources that are members of a data set, kept up to date as rows and members change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lattisca.functions.expressions import QueryError
from lattisca.plans.engine import Result, evaluate
from lattisca.plans.nodes import relations_of
from lattisca.plans.validate import validate
from lattisca.sources.relations import RelationInput
from lattisca.sources.shared import hold
from lattisca.streaming.maintenance import Change, ChangeError, Session, StaleBasis, Stored


@dataclass
class Source:
    """A source's relations, each with its rows; authority: the scope that a session must have to read it; close: called when its mount ends."""

    id: str
    relations: dict[str, RelationInput]
    authority: str = ""
    close: Callable[[], None] = lambda: None


@dataclass
class Member:
    """A place in the data set. source: None while it is unresolved. expectation: without a ``required`` one the result is incomplete."""

    id: str
    source: Source | None = None
    expectation: str = "required"
    linked: bool = False
    basis: int = 0
    stored: dict[str, Stored] = field(default_factory=dict)


class QuerySession:
    """One plan over mounted sources.

    A required member that is unresolved, or that may not be read, leaves no rows, completeness ``unknown``; with partial the rows of
    the others are a ``lower-bound``, as far as the plan lets them be one. Optional members count only when they are there. A
    relation of one source is maintained by its changes; with rows of several sources, and after a change of members,
    the result is computed anew. Subscribers hear ('reset', rows), ('diff', removed, added) and ('invalidation',).

    links: a plan whose rows name sources in their column ``target`` and, in ``expectation`` if they have it, whether they are required
    (they are, unless all rows of a target say optional). It is asked again after each change until no further source comes up; open_source
    opens those that are new (None: it stays unresolved), and one that nothing reachable names any more is closed. Links are read to
    the driver, at most ``most`` sources, beyond which ``discovery.budget_exceeded`` is raised.
    """

    def __init__(
        self, spark: SparkSession, root: dict, members: list[Member], authority: str = "", can_read: Callable[[Source], bool] | None = None, partial: bool = False,
        links: dict | None = None, open_source: Callable[[str], Source | None] | None = None, most: int = 1000, **options,
    ):
        if len({m.id for m in members}) != len(members) or any(m.expectation not in ("required", "optional") for m in members):
            raise ValueError("members need ids of their own, and are required or optional")
        for plan in [root] + [links] * (links is not None):
            if problems := validate(plan, None, set(options["parameters"]) if options.get("parameters") else None):
                raise QueryError("query.plan_invalid", "; ".join(f"{p}: {c}" for p, c in problems))
        self.spark, self.root, self.authority, self.partial, self.options = spark, root, authority, partial, options
        self.can_read = can_read or (lambda source: source.authority == self.authority)
        self.links, self.open_source, self.most = links, open_source, most
        self.members: dict[str, Member] = {}
        self.revision, self.closed, self.settled, self.subscribers = 0, False, False, []
        try:
            for m in members:
                self._mount(replace(m, stored={}))
            self._settle()
            self._open()
        except BaseException:
            self._unmount(list(self.members))
            raise

    # What a session shows.

    @property
    def rows(self) -> DataFrame | None:
        return self.session.rows if self.session else self.result.df

    @property
    def completeness(self) -> str:
        return self.session.completeness if self.session else self.result.completeness

    @property
    def issues(self) -> tuple[str, ...]:
        return tuple(f"dataset.member_unresolved: {m.id}" for m in self._absent()) + (self.session.issues if self.session else self.result.issues)

    def subscribe(self, hear: Callable) -> Callable[[], None]:
        self.subscribers.append(hear)
        hear(("reset", self.rows))
        return lambda: self.subscribers.remove(hear)

    # Changes of members and of rows.

    def resolve(self, member: str, source: Source) -> None:
        """Mounts the source of an unresolved member."""
        self._alive()
        if self.members[member].source is not None:
            raise ValueError("the member has a source")
        self._mount(replace(self.members[member], source=source))
        self._moved()

    def attach(self, member: Member) -> None:
        self._alive()
        if member.id in self.members:
            raise ValueError("the member is there")
        self._mount(replace(member, stored={}))
        self._moved()

    def detach(self, member: str) -> None:
        """Ends a member and its mount."""
        self._alive()
        self._unmount([member])
        self._moved()

    def update(self, member: str, changes: dict[str, Change], expected: int) -> int:
        """Changes of a member's relations that build on its basis ``expected``; the basis after them. A refused update changes nothing, and subscribers hear of it."""
        self._alive()
        m = self.members[member]
        if expected != m.basis or m.source is None:
            self._tell(("invalidation",))
            raise StaleBasis(f"expected {expected}, at {m.basis}")
        if set(changes) - set(m.stored):
            raise ChangeError(", ".join(sorted(set(changes) - set(m.stored))))
        told = None
        own = {r: c for r, c in changes.items() if r in relations_of(self.root)}
        if self.session and own and self._readable(m):
            told = self.session.update(own, self.session.basis, self.session.basis + 1)
        for r, c in changes.items():
            m.stored[r] = m.stored[r].after(hold(c.removed, "change"), hold(c.added, "change"))
        m.basis += 1
        before = self.revision
        if self.links is not None:
            self._settle()
        if self.revision != before or own and not self.session and self._readable(m):
            self._open()
            self._tell(("reset", self.rows))
        elif told is not None:
            self._tell(("diff", *told))
        return m.basis

    def close(self) -> None:
        """Ends all mounts, the last first."""
        if not self.closed:
            self.closed, self.subscribers = True, []
            self._unmount(list(self.members)[::-1])

    # Inside.

    def _alive(self) -> None:
        if self.closed:
            raise ValueError("the session is closed")

    def _tell(self, event: tuple) -> None:
        for hear in list(self.subscribers):
            hear(event)

    def _readable(self, m: Member) -> bool:
        return m.source is not None and self.can_read(m.source)

    def _absent(self) -> list[Member]:
        return [m for m in self.members.values() if m.expectation == "required" and not self._readable(m)]

    def _mount(self, m: Member) -> None:
        if m.source is not None:
            m.stored = {r: Stored(self.spark, i.df, list(i.occurrence)) for r, i in m.source.relations.items()}
        self.members[m.id] = m
        self.revision += 1

    def _unmount(self, ids: list[str]) -> None:
        for i in ids:
            m = self.members.pop(i)
            self.revision += 1
            if m.source is not None:
                m.source.close()

    def _moved(self) -> None:
        self._settle()
        self._open()
        self._tell(("reset", self.rows))

    def _inputs(self, plan: dict, known: str | None, among: set[str] | None = None) -> dict[str, list[RelationInput]]:
        out: dict[str, list[RelationInput]] = {r: [] for r in relations_of(plan)}
        for m in self.members.values():
            if self._readable(m) and (among is None or m.id in among):
                for r in set(out) & set(m.stored):
                    own = m.source.relations[r]
                    out[r].append(replace(own, df=m.stored[r].df, source=own.source or m.source.id, attachment=m.id, completeness=known if known and own.completeness == "exact" else own.completeness))
        return {r: own for r, own in out.items() if own}

    def _open(self) -> None:
        """The result over the members as they are."""
        absent = self._absent()
        inputs = self._inputs(self.root, ("lower-bound" if self.partial else "unknown") if absent else None)
        lone = not absent and set(inputs) == relations_of(self.root) and all(len(own) == 1 for own in inputs.values())
        self.session = Session(self.spark, self.root, inputs, **self.options) if lone else None
        if not lone:
            there = set(inputs) == relations_of(self.root)
            self.result = evaluate(self.spark, self.root, inputs, **self.options) if there else Result(None, "unknown", ("query.relation_missing",))

    def _settle(self) -> None:
        """Follows links from the members that weren't found by links, until no source comes up that wasn't reached; ends those not reached any more."""
        if self.links is None:
            self.settled = True
            return
        self.settled = False
        roots = [m for m in self.members.values() if not m.linked]
        known = {m.id for m in roots} | {m.source.id for m in roots if m.source is not None}
        reached, wanted = {m.id for m in roots}, {}
        while True:
            asked, new = self._named(reached), []
            for target, said in asked.items():
                if target not in known:
                    wanted[target] = "required" if "required" in (said, wanted.get(target)) else said
                    if target not in reached:
                        new.append(target)
            if len(wanted) > self.most:
                raise ValueError("discovery.budget_exceeded")
            if not new:
                break
            for t in sorted(new):
                if t not in self.members:
                    self._mount(Member(t, self.open_source(t) if self.open_source else None, linked=True))
                reached.add(t)
        for t, said in wanted.items():
            if self.members[t].expectation != said:
                self.members[t].expectation = said
                self.revision += 1
        self._unmount([i for i in self.members if i not in reached])
        self.settled = True

    def _named(self, among: set[str]) -> dict[str, str]:
        """Sources that the link rows of some members name, with their expectation."""
        inputs = self._inputs(self.links, None, among)
        if set(inputs) != relations_of(self.links):
            return {}
        found = evaluate(self.spark, self.links, inputs, **self.options)
        if found.df is None:
            raise QueryError("query.links_incomplete", ", ".join(found.issues))
        columns = [c for c in ("target", "expectation") if c in found.df.columns]
        out: dict[str, str] = {}
        for r in found.df.filter("target IS NOT NULL").select(*columns).distinct().limit(3 * self.most + 1).collect():
            said = r["expectation"] if "expectation" in columns and r["expectation"] else "required"
            out[r["target"]] = "required" if "required" in (said, out.get(r["target"])) else said
        return out
