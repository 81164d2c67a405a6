"""Process diagrams (BPMN), also with weights on their flows: reading, writing, and the diagrams of nets, trees and orders."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from fractions import Fraction
from xml.etree import ElementTree as E

from ..models.nets import Net, is_safe
from ..models.powl import END, START, Powl
from ..models.trees import Node, Tree

NAMESPACE = "http://www.omg.org/spec/BPMN/20100524/MODEL"
#: namespace of the weights, unless another one is asked for; the reader takes any
WEIGHTS = "urn:stochastic-bpmn"
#: fixed tag names of the format and what they are here
KINDS = {
    "startEvent": "start",
    "endEvent": "end",
    "intermediateCatchEvent": "event",
    "intermediateThrowEvent": "event",
    "task": "task",
    "exclusiveGateway": "exclusive",
    "parallelGateway": "parallel",
    "inclusiveGateway": "inclusive",
    "eventBasedGateway": "event gateway",
}
TAGS = {"start": "startEvent", "end": "endEvent", "event": "intermediateThrowEvent", "task": "task", "exclusive": "exclusiveGateway", "parallel": "parallelGateway", "inclusive": "inclusiveGateway", "event gateway": "eventBasedGateway"}


@dataclass
class Diagram:
    """Elements by id: (process, kind, label); flows and messages between them: (source, target, weight or None)."""

    elements: dict[str, tuple[str, str, str | None]] = field(default_factory=dict)
    flows: list[tuple[str, str, Fraction | None]] = field(default_factory=list)
    messages: list[tuple[str, str]] = field(default_factory=list)
    processes: list[str] = field(default_factory=lambda: ["process_1"])

    def add(self, kind: str, label: str | None = None) -> str:
        name = f"{kind.replace(' ', '_')}_{len(self.elements)}"
        self.elements[name] = (self.processes[-1], kind, label)
        return name

    def flow(self, source: str, target: str, weight: Fraction | None = None) -> None:
        self.flows.append((source, target, weight))

    def check(self) -> Diagram:
        """Flows stay within a process, messages go from one to another, starts have no way in and ends none out."""
        for s, t, w in self.flows:
            if s not in self.elements or t not in self.elements:
                raise ValueError(f"a flow from {s!r} to {t!r}, of which one doesn't exist")
            if self.elements[s][0] != self.elements[t][0]:
                raise ValueError(f"the flow from {s!r} to {t!r} leaves its process")
            if self.elements[t][1] == "start" or self.elements[s][1] == "end":
                raise ValueError(f"the flow from {s!r} to {t!r} leads into a start or out of an end")
            if w is not None and w < 0:
                raise ValueError(f"weight {w}")
        for s, t in self.messages:
            ends = [self.elements[x][0] if x in self.elements else x for x in (s, t)]
            if ends[0] == ends[1] or not set(ends) <= set(self.processes):
                raise ValueError(f"a message from {s!r} to {t!r}")
        return self


def read_bpmn(text: str) -> Diagram:
    """A diagram with or without weights. All kinds of tasks are tasks; lanes and what is drawn don't count."""
    try:
        root = E.fromstring(text)
    except E.ParseError as e:
        raise ValueError(f"no XML: {e}") from None
    tag = lambda e: e.tag.rpartition("}")[2]
    if tag(root) != "definitions":
        raise ValueError("no BPMN definitions")
    out = Diagram(processes=[])
    pools: dict[str, str] = {}
    names: set[str] = set()

    def element(e: E.Element, process: str) -> None:
        kind = KINDS.get(tag(e)) or ("task" if tag(e).endswith("Task") or tag(e) == "callActivity" else None)
        if kind is None and tag(e) != "subProcess":
            return
        if (i := e.get("id")) is None or i in names:
            raise ValueError(f"element id {i!r}")
        names.add(i)
        if kind:
            out.elements[i] = (process, kind, e.get("name") if kind == "task" else None)
            return
        raise ValueError("processes within processes aren't read")

    for p in (e for e in root if tag(e) == "process"):
        process = p.get("id") or f"process_{len(out.processes) + 1}"
        out.processes.append(process)
        for e in p:
            if tag(e) == "sequenceFlow":
                weight = next((Fraction(w.get("constant")) for w in e.iter() if tag(w) == "weight"), None)
                out.flows.append((e.get("sourceRef"), e.get("targetRef"), weight))
            else:
                element(e, process)
    for c in (e for e in root if tag(e) == "collaboration"):
        pools |= {e.get("id"): e.get("processRef") for e in c if tag(e) == "participant"}
        out.messages += [(pools.get(e.get("sourceRef"), e.get("sourceRef")), pools.get(e.get("targetRef"), e.get("targetRef"))) for e in c if tag(e) == "messageFlow"]
    return out.check()


def write_bpmn(diagram: Diagram | Net, weights: bool = False, namespace: str = WEIGHTS) -> str:
    """The diagram as BPMN; with ``weights`` each flow bears one, 1 where it has none. Of a net its diagram is written."""
    d = diagram_of_net(diagram) if isinstance(diagram, Net) else diagram
    E.register_namespace("weighted", namespace)
    top = E.Element("definitions", {"xmlns": NAMESPACE, "id": "definitions"})
    number = itertools.count()
    at = {}
    for p in d.processes:
        at[p] = E.SubElement(top, "process", {"id": p, "isExecutable": "true"})
        for i, (own, kind, label) in d.elements.items():
            if own == p:
                e = E.SubElement(at[p], TAGS[kind], {"id": i} | ({"name": label} if label is not None else {}))
                for way, side in (("incoming", 1), ("outgoing", 0)):
                    for k, f in enumerate(d.flows):
                        if f[side] == i:
                            E.SubElement(e, way).text = f"flow_{k}"
    for s, t, w in d.flows:
        e = E.SubElement(at[d.elements[s][0]], "sequenceFlow", {"id": f"flow_{next(number)}", "sourceRef": s, "targetRef": t})
        if weights:
            E.SubElement(e, f"{{{namespace}}}weight", {"constant": str(Fraction(1) if w is None else w)})
    if d.messages:
        c = E.SubElement(top, "collaboration", {"id": "collaboration"})
        for p in d.processes:
            E.SubElement(c, "participant", {"id": f"pool_{p}", "processRef": p})
        for k, (s, t) in enumerate(d.messages):
            E.SubElement(c, "messageFlow", {"id": f"message_{k}", "sourceRef": f"pool_{s}" if s in at else s, "targetRef": f"pool_{t}" if t in at else t})
    return E.tostring(top, encoding="unicode")


def diagram_of_net(net: Net) -> Diagram:
    """Places are exclusive gateways or ends, transitions tasks (labelled) or parallel gateways.

    Arcs heavier than 1, nets that may put more than one token on a place, and nets without a marking can't be drawn. Of a
    net that isn't free-choice the diagram may choose earlier than the net does.
    """
    if net.marking is None or any(k > 1 for t in net.transitions for k in (*t.inputs.values(), *t.outputs.values())) or not is_safe(net):
        raise ValueError("only safe, unweighted nets with a marking")
    d = Diagram()
    start = d.add("start")
    left = {p for t in net.transitions for p in t.inputs}
    place = [d.add("exclusive" if p in left else "end") for p in range(net.places)]
    marked = [p for p, k in enumerate(net.marking) if k]
    if len(marked) != 1:
        split = d.add("parallel")
        d.flow(start, split)
        start = split
    for p in marked:
        d.flow(start, place[p])
    for t in net.transitions:
        first = last = d.add("parallel" if t.label is None else "task", t.label)
        if t.label is not None and len(t.inputs) > 1:
            first = d.add("parallel")
            d.flow(first, last)
        if t.label is not None and len(t.outputs) > 1:
            after = d.add("parallel")
            d.flow(last, after)
            last = after
        for p in t.inputs:
            d.flow(place[p], first, t.weight)
        for p in t.outputs:
            d.flow(last, place[p])
    return d


Part = tuple[str, str]


def _chain(d: Diagram, parts: list[Part]) -> Part:
    for (_, a), (b, _) in itertools.pairwise(parts):
        d.flow(a, b)
    return parts[0][0], parts[-1][1]


def _branches(d: Diagram, kind: str, parts: list[Part]) -> Part:
    split, join = d.add(kind), d.add(kind)
    for first, last in parts:
        d.flow(split, first)
        d.flow(last, join)
    return split, join


def _closed(d: Diagram, part: Part | None) -> Diagram:
    if part:
        start, end = d.add("start"), d.add("end")
        d.flow(start, part[0])
        d.flow(part[1], end)
    return d


def diagram_of_tree(tree: Tree) -> Diagram:
    """Each operator is a part with one way in and one way out; a silent leaf is a gateway that one passes.

    Interleaved children: a gateway for each set of those still to come, between which each child stands once for each set.
    """
    d = Diagram()

    def part(n: Node) -> Part:
        if not n.children:
            own = d.add("exclusive" if n.label is None else "task", n.label)
            return own, own
        if n.kind == "sequence" or (n.kind == "loop" and len(n.children) == 1):
            return _chain(d, [part(c) for c in n.children])
        if n.kind == "interleaved":
            every = frozenset(range(len(n.children)))
            gate = {frozenset(c): d.add("exclusive") for k in range(len(every) + 1) for c in itertools.combinations(sorted(every), k)}
            for left, at in gate.items():
                for i in sorted(left):
                    first, last = part(n.children[i])
                    d.flow(at, first)
                    d.flow(last, gate[left - {i}])
            return gate[every], gate[frozenset()]
        if n.kind == "loop":
            back, on = d.add("exclusive"), d.add("exclusive")
            for k, c in enumerate(n.children):
                first, last = part(c)
                d.flow(on if k else back, first)
                d.flow(last, back if k else on)
            return back, on
        return _branches(d, {"xor": "exclusive", "concurrent": "parallel", "or": "inclusive"}[n.kind], [part(c) for c in n.children])

    return _closed(d, part(tree.root) if tree.root else None)


def diagram_of_powl(model: Powl | None) -> Diagram:
    """Each child of a partial order waits at a parallel gateway for those before it; choices lead by exclusive gateways."""
    d = Diagram()

    def part(n: Powl) -> Part:
        first, last = inner(n)
        if n.repeatable:
            back, on = d.add("exclusive"), d.add("exclusive")
            _chain(d, [(back, back), (first, last), (on, on)])
            d.flow(on, back)
            first, last = back, on
        if n.skippable:
            split, join = d.add("exclusive"), d.add("exclusive")
            _chain(d, [(split, split), (first, last), (join, join)])
            d.flow(split, join)
            first, last = split, join
        return first, last

    def inner(n: Powl) -> Part:
        if n.kind == "activity":
            own = d.add("exclusive" if n.label is None else "task", n.label)
            return own, own
        kind = "parallel" if n.kind == "partial_order" else "exclusive"
        ends = {START: d.add(kind), END: d.add(kind)}
        around = []
        for c in n.children:
            before, after = d.add(kind), d.add(kind)
            _chain(d, [(before, before), part(c), (after, after)])
            around.append((before, after))
        edges = set(n.edges)
        if n.kind == "partial_order":
            edges |= {(START, i) for i in range(len(around)) if not any(t == i for _, t in n.edges)}
            edges |= {(i, END) for i in range(len(around)) if not any(s == i for s, _ in n.edges)}
        for s, t in sorted(edges):
            d.flow(ends[s] if s == START else around[s][1], ends[t] if t == END else around[t][0])
        return ends[START], ends[END]

    return _closed(d, part(model) if model else None)
